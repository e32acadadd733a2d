"""Split, preprocessing, training, metric and selection queries."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridloom.operators import features as ft
from gridloom.operators import metrics as mt
from gridloom.operators import models as ml
from gridloom.operators import quality as qa
from gridloom.operators import sampling as sm
from gridloom.plans import bindings as b
from gridloom.plans.q_features import floats
from gridloom.plans.registry import query
from gridloom.session import materialize

_SPLIT = f"""CASE WHEN {{t}} <= TIMESTAMP '{b.TRAIN_END}' THEN 'training' WHEN {{t}} <= TIMESTAMP '{b.VALID_END}' THEN 'validation'
  ELSE 'testing' END"""
_OSPLIT = f"""CASE WHEN o_orderdate <= TIMESTAMP '{b.ORDER_TRAIN_END}' THEN 'training'
  WHEN o_orderdate <= TIMESTAMP '{b.ORDER_VALID_END}' THEN 'validation' ELSE 'testing' END"""


def split_orders(spark, sf):
    return mt.chronological_split(b.scored(spark, sf), "o_orderdate", b.ORDER_TRAIN_END, b.ORDER_VALID_END)


_SPLIT_SUM = """SELECT split, row_count, first_time, last_time, round_even(row_count * 100.0 / sum(row_count) OVER (), 4) AS share_pct
  FROM (SELECT {s} AS split, count(*) AS row_count, min({t}) AS first_time, max({t}) AS last_time FROM {f} GROUP BY 1)"""


@query("chronological_split", _SPLIT_SUM.format(s=_SPLIT.format(t="ts"), t="ts", f="readings"))
def chronological_split(spark, sf):
    return mt.split_summary(b.readings(spark, sf), "ts", b.TRAIN_END, b.VALID_END)


@query("chronological_split_rows", f"SELECT o_orderkey, {_OSPLIT} AS split FROM scored")
def chronological_split_rows(spark, sf):
    return split_orders(spark, sf).select("o_orderkey", "split")


_NUM = ["square_feet", "year_built", "floor_count", "air_temperature", "wind_speed"]


@query(
    "impute_scale",
    "WITH m AS (SELECT "
    + ", ".join(f"median({c}) AS {c}" for c in _NUM)
    + f" FROM enriched WHERE timestamp <= TIMESTAMP '{b.TRAIN_END}'), s AS (SELECT "
    + ", ".join(f"avg(coalesce(e.{c}, m.{c})) AS {c}_m, stddev_pop(coalesce(e.{c}, m.{c})) AS {c}_s" for c in _NUM)
    + f" FROM enriched e LEFT JOIN m ON true WHERE timestamp <= TIMESTAMP '{b.TRAIN_END}') SELECT event_id, "
    + ", ".join(f"round((coalesce(e.{c}, m.{c}) - s.{c}_m) / s.{c}_s, 6) AS {c}_z" for c in _NUM)
    + " FROM enriched e LEFT JOIN m ON true LEFT JOIN s ON true",
)
def impute_scale(spark, sf):
    df = b.enriched(spark, sf).select("event_id", "timestamp", *_NUM)
    fitted = ml.fit_numeric(df.where(F.col("timestamp") <= F.lit(b.TRAIN_END).cast("timestamp_ntz")), _NUM)
    return floats(ml.apply_numeric(df, fitted).select("event_id", *[f"{c}_z" for c in _NUM]), 6)


_SEEN = "SELECT * FROM enriched WHERE primary_use <> 'MACHINERY'"


@query(
    "impute_mode_onehot",
    f"""WITH t AS ({_SEEN}), k AS (SELECT list(DISTINCT primary_use ORDER BY primary_use) AS known FROM t),
    m AS (SELECT primary_use AS mode FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT event_id, array_to_string(list_transform(known, lambda x: CASE WHEN x = coalesce(primary_use, mode) THEN '1' ELSE '0' END), ',') AS code
    FROM enriched LEFT JOIN k ON true LEFT JOIN m ON true""",
)
def impute_mode_onehot(spark, sf):
    df = b.enriched(spark, sf).select("event_id", "primary_use")
    train = df.where("primary_use <> 'MACHINERY'")
    encoder = Pipeline(stages=ml.categorical_stages(train, ["primary_use"])).fit(train)
    bits = F.transform(vector_to_array("primary_use__v"), lambda x: x.cast("int").cast("string"))
    return encoder.transform(df).select("event_id", F.array_join(bits, ",").alias("code"))


@query(
    "ordinal_codes",
    f"""WITH k AS (SELECT primary_use, CAST(row_number() OVER (ORDER BY primary_use) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT primary_use FROM ({_SEEN})))
    SELECT event_id, coalesce(code, -1) AS code FROM enriched e LEFT JOIN k ON e.primary_use = k.primary_use""",
)
def ordinal_codes(spark, sf):
    df = b.enriched(spark, sf).select("event_id", "primary_use")
    codes = ml.fit_codes(df.where("primary_use <> 'MACHINERY'"), "primary_use")
    return ml.apply_codes(df, codes, "primary_use", "code").select("event_id", "code")


@query(
    "train_dummy_median",
    f"""WITH s AS (SELECT *, {_OSPLIT} AS split FROM scored), m AS (SELECT median(y) AS m FROM s WHERE split = 'training')
    SELECT split, count(*) AS row_count, round(avg(abs(y - m)), 4) AS mae FROM s LEFT JOIN m ON true GROUP BY 1""",
)
def train_dummy_median(spark, sf):
    df = split_orders(spark, sf)
    constant = ml.fit_median(df.where("split = 'training'"), "y")
    scored = df.withColumn("p", F.lit(constant))
    return floats(mt.clipped_metrics(scored, "y", "p", ["split"]).select("split", "row_count", "mae"))


def _clipped_sql(by, source, r2=6):
    g = f"{by}, " if by else ""
    return f"""SELECT {g}count(*) AS row_count, round(avg(abs(h - y)), 4) AS mae, round(sqrt(avg((h - y) ** 2)), 4) AS rmse,
    round(1 - sum((h - y) ** 2) / (sum(y * y) - count(*) * avg(y) ** 2), {r2}) AS r2,
    round(sqrt(avg((ln(1 + h) - ln(1 + y)) ** 2)), 6) AS rmsle FROM (SELECT *, greatest(p, 0) AS h FROM {source}) t
    {f'GROUP BY {by}' if by else ''}"""


def _round_metrics(df, r2=6):
    kinds = dict(df.dtypes)
    digits = {"r2": r2, "rmsle": 6}
    return df.select(
        *[
            F.round(c, next((d for k, d in digits.items() if c.endswith(k)), 4)).alias(c) if kinds[c] == "double" else F.col(c)
            for c in df.columns
        ]
    )


@query(
    "regression_metrics",
    """SELECT count(*) AS row_count, round(sqrt(avg((p - y) ** 2)), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae,
    round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
    round(sqrt(avg((ln(1 + greatest(p, 0)) - ln(1 + y)) ** 2)), 6) AS rmsle,
    round(median(abs(p - y)), 4) AS median_absolute_error,
    round(100.0 * count(*) FILTER (WHERE p < 0) / count(*), 4) AS negative_pct FROM scored""",
)
def regression_metrics(spark, sf):
    return _round_metrics(mt.regression_metrics(b.scored(spark, sf), "y", "p"))


@query("clipped_metrics", _clipped_sql("", "scored"))
def clipped_metrics(spark, sf):
    return _round_metrics(mt.clipped_metrics(b.scored(spark, sf), "y", "p"))


def _untied(df, *columns):
    """Small groups often have a mean that ends in a 5: move off the tie before rounding."""
    return df.withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in columns})


_LIMITS = f"""SELECT quantile_cont(y, 0.5) AS small_max, quantile_cont(y, 0.9) AS medium_max, quantile_cont(y, 0.99) AS large_max
  FROM (SELECT y, {_OSPLIT} AS split FROM scored) WHERE split = 'training'"""


@query("band_thresholds", f"SELECT round(small_max, 4) AS small_max, round(medium_max, 4) AS medium_max, round(large_max, 4) AS large_max FROM ({_LIMITS})")
def band_thresholds(spark, sf):
    return floats(mt.band_thresholds(split_orders(spark, sf).where("split = 'training'"), "y"))


@query(
    "band_metrics",
    f"""WITH l AS ({_LIMITS}), banded AS (SELECT *, CASE WHEN y <= small_max THEN 'small' WHEN y <= medium_max THEN 'medium'
    WHEN y <= large_max THEN 'large' ELSE 'peak' END AS band FROM scored LEFT JOIN l ON true) """
    + _clipped_sql("band", "banded", 3),
)
def band_metrics(spark, sf):
    df = split_orders(spark, sf)
    limits = mt.band_thresholds(df.where("split = 'training'"), "y").first().asDict()
    return _round_metrics(mt.band_metrics(df, "y", "p", limits), 3)


_DIMS = ["o_orderpriority", "o_orderstatus", "month", "target_decile"]


@query(
    "subgroup_metrics",
    """WITH d AS (SELECT o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, y, p,
    CAST(CAST(greatest(0, ceil((r - 1) * 10.0 / (n - 1)) - 1) AS INTEGER) AS VARCHAR) AS target_decile FROM (
    SELECT *, row_number() OVER (ORDER BY y, o_orderkey) AS r, count(*) OVER () AS n FROM scored)) """
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS dimension, {c} AS value, count(*) AS row_count, round(sqrt(avg((p - y) ** 2)) + 1e-7, 4) AS rmse,
        round(avg(abs(p - y)) + 1e-7, 4) AS mae FROM d GROUP BY {c}"""
        for c in _DIMS
    ),
)
def subgroup_metrics(spark, sf):
    df = b.scored(spark, sf).withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return _untied(mt.subgroup_metrics(df, "y", "p", _DIMS[:3], ["o_orderkey"]), "rmse", "mae")


_ZERO = "(SELECT *, greatest(0, y - 150000) AS z FROM scored)"


@query(
    "zero_nonzero_error",
    f"""SELECT count(*) FILTER (WHERE z = 0) AS zero_rows, round(avg(abs(p - z)) FILTER (WHERE z = 0), 4) AS zero_mae,
    count(*) FILTER (WHERE z > 0) AS nonzero_rows, round(avg(abs(p - z)) FILTER (WHERE z > 0), 4) AS nonzero_mae FROM {_ZERO}""",
)
def zero_nonzero_error(spark, sf):
    df = b.scored(spark, sf).withColumn("z", F.greatest(F.lit(0.0), F.col("y") - 150000))
    return _round_metrics(mt.zero_nonzero_error(df, "z", "p"))


@query(
    "high_consumption_error",
    f"""WITH t AS (SELECT quantile_cont(y, 0.999) AS t FROM (SELECT y, {_OSPLIT} AS split FROM scored) WHERE split = 'training')
    SELECT round(max(t), 4) AS threshold, count(*) AS row_count, round(sqrt(avg((p - y) ** 2)), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae
    FROM scored LEFT JOIN t ON true WHERE y >= t""",
)
def high_consumption_error(spark, sf):
    df = split_orders(spark, sf)
    limit = mt.extreme_threshold(df.where("split = 'training'"), "y")
    return _round_metrics(mt.high_consumption_error(df, "y", "p", limit))


@query(
    "building_error_summary",
    """SELECT count(*) AS building_count, round(median(m) + 1e-7, 4) AS median_building_mae, round(max(m) + 1e-7, 4) AS maximum_building_mae
    FROM (SELECT avg(abs(p - y)) AS m FROM scored GROUP BY o_custkey)""",
)
def building_error_summary(spark, sf):
    return _untied(mt.building_error_summary(b.scored(spark, sf), "y", "p", "o_custkey"), "median_building_mae", "maximum_building_mae")


@query(
    "split_drift",
    f"""WITH s AS (SELECT *, {_OSPLIT} AS split FROM scored), t AS (SELECT quantile_cont(y, 0.999) AS t FROM s WHERE split = 'training')
    SELECT split, count(*) AS row_count, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std, max(y) AS maximum,
    round(100.0 * avg(CASE WHEN y = 0 THEN 1 ELSE 0 END), 4) AS zero_pct,
    round(100.0 * avg(CASE WHEN y >= t THEN 1 ELSE 0 END), 4) AS extreme_pct, round(median(y), 4) AS median,
    round(max(t), 4) AS extreme_threshold FROM s LEFT JOIN t ON true GROUP BY 1""",
)
def split_drift(spark, sf):
    df = split_orders(spark, sf)
    limit = mt.extreme_threshold(df.where("split = 'training'"), "y")
    return _round_metrics(mt.split_drift(df, "y", "split", limit))


@query("residual_table", "SELECT o_orderkey, round(p - y, 4) AS residual FROM scored")
def residual_table(spark, sf):
    return floats(mt.residuals(b.scored(spark, sf), "y", "p").select("o_orderkey", "residual"))


def _trend(grain):
    return f"""SELECT CAST(date_trunc('{grain}', o_orderdate) AS TIMESTAMP) AS period, round(avg(abs(p - y)) + 1e-7, 4) AS mae,
    count(*) AS row_count FROM scored GROUP BY 1"""


@query("error_trend", _trend("day"))
def error_trend(spark, sf):
    return _untied(mt.error_trend(b.scored(spark, sf), "o_orderdate", "y", "p", "day"), "mae")


@query("error_trend_month", _trend("month"))
def error_trend_month(spark, sf):
    return _untied(mt.error_trend(b.scored(spark, sf), "o_orderdate", "y", "p", "month"), "mae")


# Stand-in models over the same rows: name and prediction, in both notations.
_RUNS = {"reference": "p", "scaled": "y * 0.93 + 900", "shifted": "y + (o_orderkey % 7 - 3) * 6000", "flat": "240000.0 + o_orderkey % 5"}
_RUNS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS model, {_OSPLIT} AS split, y, CAST({e} AS DOUBLE) AS p FROM scored" for n, e in _RUNS.items()
)
_PARTS = ("validation", "testing")
_METRICS = ("row_count", "rmse", "mae", "r2", "rmsle")
_COMPARE = f"""WITH runs AS ({_RUNS_SQL}), s AS (SELECT model, split, count(*) AS row_count, sqrt(avg((h - y) ** 2)) AS rmse, avg(abs(h - y)) AS mae,
  1 - sum((h - y) ** 2) / (sum(y * y) - count(*) * avg(y) ** 2) AS r2, sqrt(avg((ln(1 + h) - ln(1 + y)) ** 2)) AS rmsle
  FROM (SELECT *, greatest(p, 0) AS h FROM runs) GROUP BY 1, 2), c AS (SELECT model, """ + ", ".join(
    f"max({m}) FILTER (WHERE split = '{s}') AS {s}_{m}" for s in _PARTS for m in _METRICS
) + " FROM s GROUP BY 1)"


def _comparison(spark, sf):
    """All stand-in models scored in one pass over the rows."""
    runs = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.expr(e).cast("double").alias("p")) for n, e in _RUNS.items()]))
    df = b.scored(spark, sf).select("o_orderdate", "y", runs.alias("r")).select("o_orderdate", "y", "r.model", "r.p")
    df = mt.chronological_split(df, "o_orderdate", b.ORDER_TRAIN_END, b.ORDER_VALID_END)
    return mt.model_comparison(mt.clipped_metrics(df, "y", "p", ["model", "split"]), "model", "split")


@query(
    "model_comparison",
    _COMPARE
    + " SELECT model, "
    + ", ".join(
        f"{s}_{m}" if m == "row_count" else f"round({s}_{m}, {6 if m in ('r2', 'rmsle') else 4}) AS {s}_{m}" for s in _PARTS for m in _METRICS
    )
    + " FROM c",
)
def model_comparison(spark, sf):
    return _round_metrics(_comparison(spark, sf))


@query(
    "select_best_model",
    _COMPARE
    + """ SELECT 'mae_rmsle_r2' AS rule, (SELECT model FROM c ORDER BY validation_mae, validation_rmsle, -validation_r2, model LIMIT 1) AS best_model
    UNION ALL SELECT 'rmse_mae', (SELECT model FROM c ORDER BY validation_rmse, validation_mae, model LIMIT 1)
    UNION ALL SELECT 'test_rmse', (SELECT model FROM c ORDER BY testing_rmse, model LIMIT 1)""",
)
def select_best_model(spark, sf):
    table = materialize(_comparison(spark, sf), "comparison")
    rules = {
        "mae_rmsle_r2": [("validation_mae", False), ("validation_rmsle", False), ("validation_r2", True)],
        "rmse_mae": [("validation_rmse", False), ("validation_mae", False)],
        "test_rmse": [("testing_rmse", False)],
    }
    parts = [mt.select_best(table, "model", o).select(F.lit(n).alias("rule"), "best_model") for n, o in rules.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query(
    "promotion_rule",
    _COMPARE
    + """ SELECT 'reference' AS champion, c.model AS challenger, c.validation_rmse <= h.validation_rmse * 0.99
    AND c.validation_mae <= h.validation_mae AND c.testing_rmse <= h.testing_rmse AS promote
    FROM c LEFT JOIN c h ON h.model = 'reference' WHERE c.model <> 'reference'""",
)
def promotion_rule(spark, sf):
    return mt.promotion(materialize(_comparison(spark, sf), "comparison"), "model", "reference")


_PROFILE_SQL = f"""SELECT min(building_id) AS building_min, max(building_id) AS building_max, min(site_id) AS site_min,
  max(site_id) AS site_max, min(timestamp) AS timestamp_min, max(timestamp) AS timestamp_max,
  array_to_string(list_sort(list(DISTINCT primary_use) FILTER (WHERE primary_use IS NOT NULL)), ',') AS categories
  FROM enriched WHERE timestamp <= TIMESTAMP '{b.TRAIN_END}'"""


def training_rows(spark, sf):
    return b.enriched(spark, sf).where(F.col("timestamp") <= F.lit(b.TRAIN_END).cast("timestamp_ntz"))


@query("training_profile", _PROFILE_SQL)
def training_profile(spark, sf):
    df = mt.training_profile(training_rows(spark, sf), "building_id", "site_id", "timestamp", "primary_use")
    return df.withColumn("categories", F.array_join("categories", ","))


@query(
    "subset_coverage",
    """WITH p AS (SELECT *, row_number() OVER (ORDER BY timestamp, event_id) - 1 AS pos, count(*) OVER () AS n FROM enriched),
    s AS (SELECT * FROM p WHERE n <= 400 OR pos IN (SELECT k * ((SELECT max(n) FROM p) - 1) // 399 FROM (SELECT unnest(range(400)) AS k))) """
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM enriched) AS full_values,
        (SELECT count(DISTINCT {c}) FROM s) AS subset_values"""
        for c in ("meter", "primary_use", "building_id")
    ),
)
def subset_coverage(spark, sf):
    df = b.enriched(spark, sf).select("event_id", "timestamp", "meter", "primary_use", "building_id")
    part = sm.even_subset(df, 400, ["timestamp", "event_id"])
    return qa.subset_coverage(df, part, ["meter", "primary_use", "building_id"])


_MODEL_NUMERIC = [
    "square_feet",
    "year_built",
    "floor_count",
    *b.WEATHER,
    *ft.V1_FEATURES,
]


def v1_spec(**options):
    return ml.FeatureSpec(_MODEL_NUMERIC, ["primary_use", "meter"], "meter_reading", **options)


def model_rows(spark, sf):
    """The first feature set with its chronological part, written once for the passes of a fit."""
    feats = ft.features_v1(b.clean(spark, sf), keep=["event_id"])
    return materialize(mt.chronological_split(feats, "timestamp", b.TRAIN_END, b.VALID_END), "features")


def fitted(spark, sf, kind, log_target=False, **options):
    rows = model_rows(spark, sf)
    spec = v1_spec(log_target=log_target)
    train, held = rows.where("split = 'training'"), rows.where("split = 'validation'")
    return rows, spec, ml.fit(kind, train, spec, held, **options)


def _evaluated(spark, sf, kind, **options):
    rows, spec, model = fitted(spark, sf, kind, **options)
    scored = ml.predict(model, rows.where("split <> 'training'"), spec)
    return mt.clipped_metrics(scored, "meter_reading", "raw_prediction", ["split"])


@query("train_linear")
def train_linear(spark, sf):
    return _evaluated(spark, sf, "linear")


@query("train_ridge")
def train_ridge(spark, sf):
    return _evaluated(spark, sf, "ridge")


@query("train_decision_tree")
def train_decision_tree(spark, sf):
    return _evaluated(spark, sf, "tree")


@query("train_random_forest")
def train_random_forest(spark, sf):
    return _evaluated(spark, sf, "forest")


@query("train_boosted")
def train_boosted(spark, sf):
    return _evaluated(spark, sf, "boosted", log_target=True)


@query("feature_importance")
def feature_importance(spark, sf):
    _, spec, model = fitted(spark, sf, "tree")
    return ml.importance(model, spec, spark)


@query("top_importance")
def top_importance(spark, sf):
    _, spec, model = fitted(spark, sf, "linear")
    return ml.top_importance(ml.importance(model, spec, spark), 20)


@query("permutation_importance")
def permutation_importance(spark, sf):
    rows, spec, model = fitted(spark, sf, "tree")
    found = ml.permutation_importance(model, rows.where("split = 'validation'"), spec, "event_id")
    return ml.top_importance(found, 25)
