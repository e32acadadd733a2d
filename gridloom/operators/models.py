"""Training and scoring with MLlib.

A fitted model is one ``PipelineModel`` (imputing, scaling, encoding and the
regressor), so it is saved, loaded and applied like any MLlib model.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from gridloom.functions.numeric import finite, from_log
from gridloom.operators import forest
from gridloom.operators.features import FORBIDDEN_V1, assert_predictors, features_v1_columns
from gridloom.operators.scale import group_medians, lookup_join, with_position
from gridloom.operators.validation import split_valid, validate_requests, warn_inputs
from gridloom.session import materialize

SEED = 42
#: Sums of nodes that one task may hold; every task of an executor holds as much at a time, and again while it hands them on.
TREE_MEMORY_MB = 256


@dataclass(frozen=True)
class NumericFit:
    """Training medians, means and population deviations."""

    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]

    def expression(self, c: str) -> str:
        median, mean, std = self.medians[c], self.means[c], self.deviations[c]
        return f"(coalesce(CAST(`{c}` AS DOUBLE), {median!r}D) - {mean!r}D) / {std!r}D"


def fit_numeric(train: DataFrame, columns: Sequence[str]) -> NumericFit:
    """Median imputing and standardizing figures, from training rows only."""
    slim = train.select(*[F.col(c).cast("double").alias(c) for c in columns])
    found = group_medians(slim, [], columns).first().asDict()
    medians = {c: float(found[c] if found[c] is not None else 0.0) for c in columns}
    filled = slim.select(*[F.coalesce(c, F.lit(medians[c])).alias(c) for c in columns])
    row = filled.agg(
        *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]
    ).first()
    means = {c: float(row[f"{c}_m"]) for c in columns}
    deviations = {c: float(row[f"{c}_s"]) or 1.0 for c in columns}
    return NumericFit(medians, means, deviations)


def apply_numeric(df: DataFrame, fit: NumericFit, suffix: str = "_z") -> DataFrame:
    return df.select("*", *[F.expr(fit.expression(c)).alias(f"{c}{suffix}") for c in fit.medians])


def most_frequent(train: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent known value per column; of equal counts the smallest value."""
    modes = {}
    for c in columns:
        counts = train.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias(c)).count()
        modes[c] = counts.agg(F.min_by(c, F.struct(-F.col("count"), F.col(c))).alias("m")).first()["m"] or ""
    return modes


def fit_codes(train: DataFrame, column: str) -> DataFrame:
    """Sorted training categories with codes 0..k-1."""
    names = train.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()
    return with_position(names, [F.col(column)], "code").select(column, F.col("code").cast("int").alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, column: str, name: str) -> DataFrame:
    """Add the code of each category, -1 where training never saw it."""
    renamed = codes.select(F.col(column), F.col("code").alias(name))
    return lookup_join(df, renamed, [column]).withColumn(name, F.coalesce(name, F.lit(-1)))


@dataclass(frozen=True)
class FeatureSpec:
    """What a model reads."""

    numeric: list[str]
    categorical: list[str]
    target: str
    log_target: bool = False
    label: str = "_label"
    forbidden: tuple[str, ...] = tuple(FORBIDDEN_V1)

    def __post_init__(self) -> None:
        assert_predictors([*self.numeric, *self.categorical], self.forbidden)


def categorical_stages(train: DataFrame, columns: Sequence[str]) -> list:
    """Most-frequent imputing and one-hot encoding; unseen categories become all zeros."""
    modes = most_frequent(train, columns)
    parts = []
    for c in columns:
        quoted = modes[c].replace("\\", "\\\\").replace("'", "\\'")
        parts.append(f"coalesce(CAST(`{c}` AS STRING), '{quoted}') AS `{c}__s`")
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"),
        StringIndexer(
            inputCols=[f"{c}__s" for c in columns],
            outputCols=[f"{c}__i" for c in columns],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=[f"{c}__i" for c in columns], outputCols=[f"{c}__v" for c in columns], dropLast=True),
    ]


def numeric_stage(train: DataFrame, columns: Sequence[str]) -> SQLTransformer:
    numbers = fit_numeric(train, columns)
    parts = [f"{numbers.expression(c)} AS `{c}__z`" for c in columns]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def _preprocess(train: DataFrame, spec: FeatureSpec) -> Pipeline:
    stages = [numeric_stage(train, spec.numeric)]
    if spec.categorical:
        stages += categorical_stages(train, spec.categorical)
    inputs = [f"{c}__z" for c in spec.numeric] + [f"{c}__v" for c in spec.categorical]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features")])


def estimator(kind: str, label: str, **options) -> Estimator:
    """Regressors with the published settings; ``options`` override single ones."""
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "raw_prediction"}
    memory = {"maxMemoryInMB": TREE_MEMORY_MB}
    # Deep trees stay with the driver: rows keep the number of their node, no task gets a copy of the trees.
    deep = {**memory, "cacheNodeIds": True}
    # The published model settings.
    settings = {
        "linear": (LinearRegression, {"regParam": 0.0, "solver": "normal"}),
        "tree": (DecisionTreeRegressor, {"maxDepth": 16, "minInstancesPerNode": 20, "seed": SEED, **deep}),
        "forest": (
            RandomForestRegressor,
            {"numTrees": 30, "maxDepth": 16, "minInstancesPerNode": 20, "featureSubsetStrategy": "0.7", "seed": SEED, **deep},
        ),
        "forest_electricity": (
            RandomForestRegressor,
            {"numTrees": 60, "maxDepth": 18, "minInstancesPerNode": 5, "featureSubsetStrategy": "1.0", "seed": SEED, **deep},
        ),
        "boosted": (GBTRegressor, {"maxIter": 150, "maxDepth": 5, "stepSize": 0.08, "seed": SEED, **memory}),
        "boosted_deep": (
            GBTRegressor,
            {"maxIter": 300, "maxDepth": 8, "stepSize": 0.06, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20, "seed": SEED, **memory},
        ),
    }
    cls, base = settings[kind]
    return cls(**{**common, **base, **options})


def ridge_estimator(train: DataFrame, label: str, alpha: float = 10.0) -> LinearRegression:
    """Ridge with the usual penalty; MLlib scales it by the label's deviation per row."""
    row = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
    strength = alpha * float(row["s"] or 0.0) / max(1, row["n"])
    return LinearRegression(
        featuresCol="features",
        labelCol=label,
        predictionCol="raw_prediction",
        regParam=strength,
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
    )


def labelled(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    target = F.col(spec.target).cast("double")
    return df.withColumn(spec.label, F.log1p(target) if spec.log_target else target)


#: Tasks of every pass of a learner.
FIT_PARTITIONS = 32
#: Rows beyond which a forest is grown by ``forest.fit_forest``, and rows of its tasks.
FOREST_ROWS = 250_000


def fit(kind: str, train: DataFrame, spec: FeatureSpec, validation: DataFrame | None = None, partitions: int = FIT_PARTITIONS, **options) -> PipelineModel:
    """Fit preprocessing on ``train`` and the regressor on the prepared rows.

    ``train`` should be a written table: it is read several times. Sampling
    inside a learner follows the layout of its rows, so these are always dealt
    to ``partitions`` by a hash of the row and put in its order: the same
    rows and seed give the same model on any cluster. Boosting stops early on
    ``validation`` when it is given. A forest of more than ``FOREST_ROWS`` rows
    draws its bags and columns otherwise than MLlib, whose passes would not end.
    """
    known = labelled(train.where(F.col(spec.target).isNotNull()), spec)
    prepare = _preprocess(known, spec).fit(known)
    keep = ["features", spec.label]
    learner = ridge_estimator(known, spec.label, **options) if kind == "ridge" else estimator(kind, spec.label, **options)
    plain = [f.name for f in known.schema if f.dataType.typeName() not in ("map", "variant")]
    dealt = known.withColumn("_row", F.xxhash64(*[F.col(c) for c in plain]))
    if isinstance(learner, RandomForestRegressor) and forest.supported(learner):
        size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(spec.label)).alias("most")).first()
        if size["n"] > FOREST_ROWS and math.isfinite(size["most"]):
            narrow = dealt.select("_row", *spec.numeric, *spec.categorical, spec.label)
            narrow = narrow.repartition(max(partitions, -(-size["n"] // FOREST_ROWS)), "_row").sortWithinPartitions("_row")
            rows = [prepare.transform(df).select(*keep) for df in (known, narrow)]
            return PipelineModel([*prepare.stages, forest.fit_forest(*rows, learner, size["n"], size["most"])])
    dealt = dealt.repartition(partitions, "_row").sortWithinPartitions("_row")
    ready = prepare.transform(dealt).select(*keep)
    if validation is not None and isinstance(learner, GBTRegressor):
        held = prepare.transform(labelled(validation.where(F.col(spec.target).isNotNull()), spec)).select(*keep)
        ready = ready.withColumn("_held", F.lit(False)).unionByName(held.withColumn("_held", F.lit(True)))
        learner = learner.setValidationIndicatorCol("_held")
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = learner.fit(ready)
    finally:
        ready.unpersist()
    return PipelineModel([*prepare.stages, model])


def fit_median(train: DataFrame, target: str) -> float:
    """The constant predictor."""
    return group_medians(train, [], [target]).first()[target]


def predict(model: PipelineModel, df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """``df`` with ``raw_prediction`` on the target's scale, held at 0 in ``prediction``."""
    scored = model.transform(df).select(*df.columns, "raw_prediction")
    if spec.log_target:
        scored = scored.withColumn("raw_prediction", from_log(F.col("raw_prediction")))
    return scored.withColumn("prediction", F.greatest(F.col("raw_prediction"), F.lit(0.0)))


def feature_names(model: PipelineModel, spec: FeatureSpec) -> list[str]:
    names = list(spec.numeric)
    if spec.categorical:
        indexer = next(s for s in model.stages if isinstance(s, StringIndexerModel))
        for c, labels in zip(spec.categorical, indexer.labelsArray):
            names += [f"{c}={value}" for value in labels]
    return names


def importance(model: PipelineModel, spec: FeatureSpec, spark) -> DataFrame:
    """Tree importances, or absolute coefficients of linear models."""
    last = model.stages[-1]
    tree = hasattr(last, "featureImportances")
    values = last.featureImportances.toArray() if tree else abs(last.coefficients.toArray())
    rows = [(n, float(v)) for n, v in zip(feature_names(model, spec), values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def top_importance(df: DataFrame, n: int = 20, column: str = "importance") -> DataFrame:
    return df.orderBy(F.abs(F.col(column)).desc(), F.col("feature")).limit(n)


def _places(model: PipelineModel, spec: FeatureSpec) -> dict[str, tuple[int, int]] | None:
    """First place (from 1) and width of each input column in the feature vector; None for a model without one."""
    if not isinstance(model, PipelineModel) or not any(isinstance(s, VectorAssembler) for s in model.stages[-2:-1]):
        return None
    widths = dict.fromkeys(spec.numeric, 1)
    if spec.categorical:
        indexer = next(s for s in model.stages if isinstance(s, StringIndexerModel))
        widths |= {c: len(labels) for c, labels in zip(spec.categorical, indexer.labelsArray)}
    ends = accumulate(widths.values(), initial=1)
    return {c: (first, width) for (c, width), first in zip(widths.items(), ends)}


def _shuffled_vectors(
    model: PipelineModel, df: DataFrame, spec: FeatureSpec, key: str, places: list[tuple[int, int]], repeats: int, seed: int
) -> list[float]:
    """Rise of the absolute error per entry of ``places``, over vectors that are prepared once.

    An input column has places of its own in the vector, so shuffling it replaces
    these. A row whose places stay as they were keeps its error and is not scored again.
    """
    learner = model.stages[-1]
    error = F.abs(F.col("prediction") - F.col(spec.target))
    ready = PipelineModel(model.stages[:-1]).transform(df.select(key, spec.target, *spec.numeric, *spec.categorical))
    ready = predict(learner, ready.select(key, spec.target, "features"), spec).withColumn("_error", error)
    base = with_position(ready.select(key, spec.target, "_error", vector_to_array("features").alias("_own")), [F.col(key)], "_at")
    cuts = F.array(*[F.struct(F.lit(i).alias("f"), F.lit(a).alias("a"), F.lit(n).alias("n")) for i, (a, n) in enumerate(places)])
    total = None
    for r in range(repeats):
        order = [F.xxhash64(F.col(key), F.lit(seed + r)), F.col(key)]
        mixed = with_position(base.select(key, F.col("_own").alias("_other")), order, "_at").drop(key)
        pairs = base.where(F.col(spec.target).isNotNull()).join(mixed, "_at").withColumn("_cut", F.explode(cuts))
        pairs = pairs.where("slice(_own, _cut.a, _cut.n) <> slice(_other, _cut.a, _cut.n)")
        vector = "concat(slice(_own, 1, _cut.a - 1), slice(_other, _cut.a, _cut.n), slice(_own, _cut.a + _cut.n, size(_own)))"
        spread = pairs.select(F.col("_cut.f").alias("_f"), spec.target, "_error", array_to_vector(F.expr(vector)).alias("features"))
        rises = predict(learner, spread, spec).groupBy("_f").agg(F.sum(error - F.col("_error")).alias("rise"))
        total = rises if total is None else total.unionByName(rises)
    own = base.agg(F.count("_error").alias("n"), F.avg("_error").alias("mae")).first()
    if not own["n"]:
        raise ValueError("no row has a target")
    found = {r["_f"]: r["rise"] / own["n"] / repeats for r in total.groupBy("_f").agg(F.sum("rise").alias("rise")).collect()}
    # a target that is not a number leaves no importance that is one
    return [found.get(i, 0.0) + own["mae"] * 0.0 for i in range(len(places))]


def permutation_importance(
    model: PipelineModel,
    df: DataFrame,
    spec: FeatureSpec,
    key: str,
    features: Sequence[str] | None = None,
    repeats: int = 2,
    seed: int = SEED,
) -> DataFrame:
    """Mean rise of the absolute error when one input column is shuffled.

    Row i gets the value of the row at place i in a seeded order. The two
    orders meet on the exact position, and all columns are scored in one pass.
    A model of ``fit`` prepares its rows once, not once per column.
    """
    names = list(features or [*spec.numeric, *spec.categorical])
    inputs = [*spec.numeric, *spec.categorical]
    places = _places(model, spec)
    if places is not None:
        rises = _shuffled_vectors(model, df, spec, key, [places[c] for c in names], repeats, seed)
        return df.sparkSession.createDataFrame(list(zip(names, rises)), "feature string, importance double")
    base = with_position(df.select(key, spec.target, *inputs), [F.col(key)], "_at")
    total = None
    for r in range(repeats):
        mixed = with_position(
            df.select(key, *[F.col(c).alias(f"_s_{c}") for c in names]),
            [F.xxhash64(F.col(key), F.lit(seed + r)), F.col(key)],
            "_at",
        ).drop(key)
        paired = base.join(mixed, "_at")
        spread = paired.withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(-1, len(names))])))
        for i, c in enumerate(names):
            spread = spread.withColumn(c, F.when(F.col("_f") == i, F.col(f"_s_{c}")).otherwise(F.col(c)))
        scored = predict(model, spread.select("_f", spec.target, *inputs), spec)
        errors = scored.groupBy("_f").agg(F.avg(F.abs(F.col("prediction") - F.col(spec.target))).alias("mae"))
        total = errors if total is None else total.unionByName(errors)
    mean = total.groupBy("_f").agg(F.avg("mae").alias("mae"))
    found = {r["_f"]: r["mae"] for r in mean.collect()}
    rows = [(c, float(found[i] - found[-1])) for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def score_batch(
    requests: DataFrame, json_column: str, model: PipelineModel, spec: FeatureSpec, profile: dict, version: str
) -> tuple[DataFrame, DataFrame]:
    """(scored valid requests, quarantined requests with errors).

    The checked requests are written once: both outputs read them, and a
    filter on the errors would otherwise be pushed down and parse them again.
    """
    good, bad = split_valid(materialize(validate_requests(requests, json_column), "requests"))
    warned = warn_inputs(good, profile)
    ready = warned.select("*", *[e.alias(n) for n, e in features_v1_columns().items() if n not in warned.columns])
    scored = predict(model, ready, spec)
    clipped = F.when(F.col("raw_prediction") < 0, F.array(F.lit("clipped_to_zero"))).otherwise(F.array().cast("array<string>"))
    usable = finite(F.col("raw_prediction"))
    out = scored.select(
        *requests.columns,
        F.when(usable, F.col("prediction")).alias("predicted_meter_reading"),
        F.lit(version).alias("model_version"),
        F.col("timestamp").alias("input_timestamp"),
        F.concat(
            F.col("warnings"), clipped, F.when(usable, F.array().cast("array<string>")).otherwise(F.array(F.lit("invalid_output")))
        ).alias("warnings"),
        F.lit("by meter: electricity, chilled water, steam or hot water").alias("units"),
    )
    return out, bad.select(*requests.columns, "errors")
