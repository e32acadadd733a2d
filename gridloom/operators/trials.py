"""Trials of learners: fitted, stored, loaded again, scored and measured; and the choice between them.

A trial stores its model, loads it back and scores with the loaded one, so
that what is measured is what would be used. Its predictions are written once
(label, part and prediction only) and all metrics read that narrow table. The
comparison has one row per learner and target strategy.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import metrics as mt
from gridloom.operators import models as ml
from gridloom.operators.boosting import Booster, Settings, fit_booster
from gridloom.operators.sampling import even_subset, systematic_sample
from gridloom.session import materialize, scratch_path

PROBE_ROWS = 1000
PARTS = ("validation", "testing")
METRICS = ("row_count", "rmse", "mae", "r2", "rmsle")


@dataclass(frozen=True)
class Learner:
    """``kind`` is ``median``, ``leafwise`` or one of ``models.fit``; ``options`` are the learner's own."""

    name: str
    kind: str
    log_target: bool = False
    options: dict[str, Any] = field(default_factory=dict)

    @property
    def strategy(self) -> str:
        return "log" if self.log_target else "raw"


@dataclass(frozen=True)
class LeafwiseModel:
    """Codes of the categories and the boosted trees over numbers and codes."""

    codes: PipelineModel
    booster: Booster

    def transform(self, df: DataFrame) -> DataFrame:
        return self.codes.transform(df).withColumn("raw_prediction", self.booster.scored())

    def save(self, spark: SparkSession, path: str) -> None:
        self.codes.save(f"{path}/codes")
        self.booster.save(spark, f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LeafwiseModel:
        return LeafwiseModel(PipelineModel.load(f"{path}/codes"), Booster.load(spark, f"{path}/trees"))


@dataclass(frozen=True)
class Trial:
    """A learner's stored model, where it lies, its predictions and its row of the comparison."""

    learner: Learner
    model: PipelineModel | LeafwiseModel
    path: str
    spec: ml.FeatureSpec
    predictions: DataFrame
    row: dict[str, Any]


def fit_constant(train: DataFrame, spec: ml.FeatureSpec) -> PipelineModel:
    """The median of the label as a model that is saved and applied like the others."""
    value = ml.fit_median(ml.labelled(train, spec), spec.label)
    if value is None:
        raise ValueError("no training row has a target")
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {float(value)!r}D AS raw_prediction FROM __THIS__")])


def fit_leafwise(train: DataFrame, spec: ml.FeatureSpec, **options: Any) -> LeafwiseModel:
    """Leaf-wise boosting; a category is its place in the sorted training values, unseen ones come last."""
    known = ml.labelled(train, spec)
    stages = ml.categorical_stages(known, spec.categorical)[:2] if spec.categorical else []
    codes = Pipeline(stages=stages).fit(known)
    columns = [*spec.numeric, *[f"{c}__i" for c in spec.categorical]]
    return LeafwiseModel(codes, fit_booster(codes.transform(known), columns, spec.label, settings=Settings(**options)))


def fit(learner: Learner, train: DataFrame, spec: ml.FeatureSpec, validation: DataFrame | None = None) -> PipelineModel | LeafwiseModel:
    """Only gradient boosting of ``models.fit`` looks at ``validation``, to stop early."""
    spec = replace(spec, log_target=learner.log_target)
    if learner.kind == "median":
        return fit_constant(train, spec)
    if learner.kind == "leafwise":
        return fit_leafwise(train, spec, **learner.options)
    return ml.fit(learner.kind, train, spec, validation, **learner.options)


def store(spark: SparkSession, model: PipelineModel | LeafwiseModel, path: str) -> int:
    """Save a model to a folder that must not exist yet; its size in bytes, all files together."""
    if isinstance(model, LeafwiseModel):
        model.save(spark, path)
    else:
        model.save(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def load(spark: SparkSession, learner: Learner, path: str) -> PipelineModel | LeafwiseModel:
    return LeafwiseModel.load(spark, path) if learner.kind == "leafwise" else PipelineModel.load(path)


def _unequal(first: Any, second: Any, probe: DataFrame, spec: ml.FeatureSpec) -> int:
    """Rows of ``probe`` that two models predict differently."""
    one = ml.predict(first, probe, spec).drop("prediction").withColumnRenamed("raw_prediction", "_first")
    both = ml.predict(second, one, spec)
    return both.where(~F.col("_first").eqNullSafe(F.col("raw_prediction"))).count()


def run(learner: Learner, rows: DataFrame, spec: ml.FeatureSpec, path: str, train: DataFrame | None = None) -> Trial:
    """One trial over a written table with a ``split`` column.

    It is fitted on ``train`` (all training rows by default) and measured on every
    validation and testing row with a target. Predictions are held at 0. A part
    without rows has null metrics. Raises if the loaded model does not predict
    ``PROBE_ROWS`` held-out rows as the fitted one does.
    """
    spark = rows.sparkSession
    spec = replace(spec, log_target=learner.log_target)
    train = rows.where("split = 'training'") if train is None else train
    begun = time.perf_counter()
    fitted = fit(learner, train, spec, rows.where("split = 'validation'"))
    fit_seconds = time.perf_counter() - begun
    size = store(spark, fitted, path)
    model = load(spark, learner, path)
    held = rows.where(F.col("split").isin(*PARTS) & F.col(spec.target).isNotNull())
    wrong = _unequal(fitted, model, held.limit(PROBE_ROWS), spec)
    if wrong:
        raise RuntimeError(f"{learner.name}: the stored model predicts {wrong} rows differently")
    begun = time.perf_counter()
    scored = ml.predict(model, held, spec).select("split", F.col(spec.target).cast("double").alias("actual"), "prediction")
    scored = materialize(scored, "predictions")
    score_seconds = time.perf_counter() - begun
    found = {r["split"]: r for r in mt.clipped_metrics(scored, "actual", "prediction", ["split"]).collect()}
    row = {
        "model": f"{learner.name}_{learner.strategy}",
        "learner": learner.name,
        "target_strategy": learner.strategy,
        "training_rows": train.where(F.col(spec.target).isNotNull()).count(),
        "fit_seconds": fit_seconds,
        "score_seconds": score_seconds,
        "artifact_bytes": size,
        **{f"{s}_{m}": found[s][m] if s in found else None for s in PARTS for m in METRICS},
    }
    return Trial(learner, model, path, spec, scored, row)


def comparison(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    """One row per trial: what was fitted on how many rows, metrics of both parts, times and stored size."""
    numbers = ", ".join(f"{s}_{m} {'long' if m == 'row_count' else 'double'}" for s in PARTS for m in METRICS)
    schema = f"model string, learner string, target_strategy string, training_rows long, fit_seconds double, score_seconds double, artifact_bytes long, {numbers}"
    return spark.createDataFrame([t.row for t in trials], schema)


#: Rules of choice: columns in order, True where larger is better.
RULES: dict[str, list[tuple[str, bool]]] = {
    "published": [("validation_mae", False), ("validation_rmsle", False), ("validation_r2", True)],
    "best_validation": [("validation_rmse", False), ("validation_mae", False)],
    "best_testing": [("testing_rmse", False)],
    "fastest": [("score_seconds", False)],
    "smallest": [("artifact_bytes", False)],
}


def choices(table: DataFrame, rules: dict[str, list[tuple[str, bool]]] = RULES) -> DataFrame:
    """(rule, best_model), of equal ones the first name; a model without the rule's metrics never wins."""
    picked = [
        mt.select_best(table.where(" AND ".join(f"{c} IS NOT NULL" for c, _ in order)), "model", order).select(F.lit(n).alias("rule"), "best_model")
        for n, order in rules.items()
    ]
    out = picked[0]
    for more in picked[1:]:
        out = out.unionByName(more)
    return out


def run_all(learners: Sequence[Learner], rows: DataFrame, spec: ml.FeatureSpec, out: str | None = None, train: DataFrame | None = None) -> list[Trial]:
    """A trial per learner, stored below ``out`` under its name and target strategy."""
    root = out or scratch_path(rows.sparkSession, "models")
    names = [f"{x.name}_{x.strategy}" for x in learners]
    if len(set(names)) < len(names):
        raise ValueError(f"learners share a name: {sorted(names)}")
    return [run(x, rows, spec, f"{root}/{n}", train) for x, n in zip(learners, names)]


def screened(
    learners: Sequence[Learner],
    rows: DataFrame,
    spec: ml.FeatureSpec,
    order: Sequence[str],
    train_rows: int = 2_000_000,
    validation_rows: int = 500_000,
    out: str | None = None,
) -> tuple[list[Trial], list[Trial]]:
    """(screening trials, final trials).

    Every learner is tried on the raw and on the log target over evenly spaced
    rows of training and validation (bounded, both ends included). The strategy
    with the smaller validation RMSE, then MAE, is then fitted on all training
    rows and measured on all held-out rows. ``order`` tells all rows apart.
    """
    root = out or scratch_path(rows.sparkSession, "models")
    parts = {"training": train_rows, "validation": validation_rows}
    few = [even_subset(rows.where(F.col("split") == s), n, order) for s, n in parts.items()]
    small = materialize(few[0].unionByName(few[1]), "screening")
    both = [replace(x, log_target=strategy) for x in learners for strategy in (False, True)]
    tried = run_all(both, small, spec, f"{root}/screen")
    final = []
    for x in learners:
        own = [t for t in tried if t.learner.name == x.name]
        best = min(own, key=lambda t: (t.row["validation_rmse"], t.row["validation_mae"], t.row["model"]))
        final.append(best.learner)
    return tried, run_all(final, rows, spec, f"{root}/final")


#: The published learners of the electricity path and their settings.
ELECTRICITY_LEARNERS = [
    Learner("dummy", "median"),
    Learner("linear_regression", "linear"),
    Learner("ridge", "ridge", options={"alpha": 10.0}),
    Learner("random_forest", "forest_electricity"),
    Learner("hist_gradient_boosting", "leafwise", options={"trees": 150, "leaves": 31, "rate": 0.08}),
]


def electricity_trials(
    rows: DataFrame,
    spec: ml.FeatureSpec,
    order: Sequence[str],
    cap: int | None = None,
    learners: Sequence[Learner] = ELECTRICITY_LEARNERS,
    out: str | None = None,
) -> tuple[list[Trial], DataFrame]:
    """(trials, metrics per model, part and band of the actual value).

    Learners are fitted on every training row with a target, and all held-out rows
    are measured. The bands' limits are quantiles of the whole training target. A
    ``cap`` fits every stride-th row of ``order`` instead, ``cap`` at most.
    """
    train = rows.where((F.col("split") == "training") & F.col(spec.target).isNotNull())
    if cap is not None:
        train = materialize(systematic_sample(train, cap, order), "training-sample")
    limits = mt.band_thresholds(train, spec.target).first().asDict()
    trials = run_all(learners, rows, spec, out, train)
    banded = None
    for t in trials:
        own = t.predictions.withColumn("model", F.lit(t.row["model"]))
        banded = own if banded is None else banded.unionByName(own)
    return trials, mt.band_metrics(banded, "actual", "prediction", limits, ["model", "split"])


def importances(trials: Sequence[Trial], rows: DataFrame, key: str, repeats: int = 2) -> DataFrame:
    """(model, feature, native_importance, permutation_importance) per input column of every trial.

    Native values of a category's levels are summed; a model without such values has null.
    The permutation works on ``rows`` with a target; ``key`` tells them apart.
    """
    spark = rows.sparkSession
    out = None
    for t in trials:
        known = rows.where(F.col(t.spec.target).isNotNull())
        shuffled = ml.permutation_importance(t.model, known, t.spec, key, repeats=repeats).withColumnRenamed("importance", "permutation_importance")
        if isinstance(t.model, LeafwiseModel):
            native = t.model.booster.importance(spark).withColumn("feature", F.regexp_replace("feature", "__i$", ""))
        elif t.learner.kind == "median":
            native = spark.createDataFrame([], "feature string, importance double")
        else:
            native = ml.importance(t.model, t.spec, spark).withColumn("feature", F.regexp_replace("feature", "=.*$", ""))
        native = native.groupBy("feature").agg(F.sum("importance").alias("native_importance"))
        table = shuffled.join(native, "feature", "left").select(F.lit(t.row["model"]).alias("model"), "feature", "native_importance", "permutation_importance")
        out = table if out is None else out.unionByName(table)
    return out
