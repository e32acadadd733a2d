"""Stored models with their measured cost, and the choice between real fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import features as ft
from gridloom.operators import metrics as mt
from gridloom.operators import models as ml
from gridloom.operators import trials as tr
from gridloom.plans import bindings as b
from gridloom.plans.q_features import treated
from gridloom.plans.registry import query
from gridloom.session import materialize

# The first three fifths of the feed are fitted, the fourth validates, the fifth tests.
_HOUR = "CASE WHEN reading_id % 11 = 0 THEN NULL ELSE CAST(hour(ts) AS DOUBLE) END"
_FEED_PART = "CASE WHEN 5 * (reading_id - lo) < 3 * (hi - lo) THEN 'training' WHEN 5 * (reading_id - lo) < 4 * (hi - lo) THEN 'validation' ELSE 'testing' END"


def feed_split(spark, sf):
    """Readings with an hour (unknown for some), and their part by place in time."""
    feed = b.feeds(spark, sf)
    ends = feed.agg(F.min("reading_id").alias("lo"), F.max("reading_id").alias("hi"))
    lo, hi = (F.lit(v) for v in ends.first())
    rows = feed.select("reading_id", F.expr(_HOUR).alias("hour"), "value", lo.alias("lo"), hi.alias("hi"))
    return materialize(rows.select("reading_id", "hour", "value", F.expr(_FEED_PART).alias("split")), "feed-split")


FEED_SPEC = ml.FeatureSpec(["hour"], [], "value", forbidden=("value", "reading_id"))
FEED_LEARNERS = [
    tr.Learner(name, kind, log, options)
    for name, kind, options in (("median", "median", {}), ("linear", "linear", {}), ("ridge", "ridge", {"alpha": 500.0}))
    for log in (False, True)
]

# Least squares and ridge on one standardized column have a closed form: slope n * cov / (n + alpha), through the means.
_CLOSED = f"""WITH f AS (SELECT f.*, {_HOUR} AS x0, {_FEED_PART} AS split
    FROM feeds f CROSS JOIN (SELECT min(reading_id) AS lo, max(reading_id) AS hi FROM feeds) e WHERE value IS NOT NULL),
  m AS (SELECT median(x0) AS mid FROM f WHERE split = 'training'),
  x AS (SELECT split, value, coalesce(x0, mid) AS x, ln(1 + value) AS logged FROM f CROSS JOIN m),
  s AS (SELECT avg(x) AS mx, var_pop(x) AS vx, count(*) AS n, avg(value) AS m_raw, avg(logged) AS m_log, covar_pop(x, value) AS c_raw,
    covar_pop(x, logged) AS c_log, median(value) AS q_raw, median(logged) AS q_log FROM x WHERE split = 'training'),
  p AS (SELECT split, value AS y, unnest([
    {{'model': 'median_raw', 'p': q_raw}}, {{'model': 'median_log', 'p': exp(q_log) - 1}},
    {{'model': 'linear_raw', 'p': m_raw + c_raw / vx * (x - mx)}}, {{'model': 'linear_log', 'p': exp(m_log + c_log / vx * (x - mx)) - 1}},
    {{'model': 'ridge_raw', 'p': m_raw + n / (n + 500.0) * c_raw / vx * (x - mx)}},
    {{'model': 'ridge_log', 'p': exp(m_log + n / (n + 500.0) * c_log / vx * (x - mx)) - 1}}]) AS r
    FROM x CROSS JOIN s WHERE split <> 'training'),
  h AS (SELECT split, y, r.model AS model, greatest(r.p, 0) AS p FROM p),
  k AS (SELECT model, split, count(*) AS row_count, sqrt(avg((p - y) ** 2)) AS rmse, avg(abs(p - y)) AS mae,
    1 - sum((p - y) ** 2) / (sum(y * y) - count(*) * avg(y) ** 2) AS r2, sqrt(avg((ln(1 + p) - ln(1 + y)) ** 2)) AS rmsle FROM h GROUP BY 1, 2),
  c AS (SELECT model, """ + ", ".join(
    f"max({m}) FILTER (WHERE split = '{s}') AS {s}_{m}" for s in tr.PARTS for m in tr.METRICS
) + " FROM k GROUP BY 1)"


def _rounded(name):
    return name if name.endswith("row_count") else f"round({name} + 1e-8, {5 if name.endswith(('r2', 'rmsle')) else 3}) AS {name}"


_COLUMNS = ", ".join(_rounded(f"{s}_{m}") for s in tr.PARTS for m in tr.METRICS)


@query("stored_trials", _CLOSED + f" SELECT model, (SELECT n FROM s) AS training_rows, {_COLUMNS} FROM c")
def stored_trials(spark, sf):
    """Median, least squares and ridge on the raw and on the log target: stored, loaded, scored on all held-out readings."""
    table = tr.comparison(spark, tr.run_all(FEED_LEARNERS, feed_split(spark, sf), FEED_SPEC))
    return table.selectExpr("model", "training_rows", *[_rounded(f"{s}_{m}") for s in tr.PARTS for m in tr.METRICS])


@query(
    "chosen_trials",
    _CLOSED
    + """ SELECT 'published' AS rule, (SELECT model FROM c ORDER BY validation_mae, validation_rmsle, -validation_r2, model LIMIT 1) AS best_model
    UNION ALL SELECT 'best_validation', (SELECT model FROM c ORDER BY validation_rmse, validation_mae, model LIMIT 1)
    UNION ALL SELECT 'best_testing', (SELECT model FROM c ORDER BY testing_rmse, model LIMIT 1)""",
)
def chosen_trials(spark, sf):
    """The choice by each rule of quality, from these fits; what is fastest and smallest depends on the machine."""
    table = tr.comparison(spark, tr.run_all(FEED_LEARNERS, feed_split(spark, sf), FEED_SPEC))
    return tr.choices(table, {n: tr.RULES[n] for n in ("published", "best_validation", "best_testing")})


def electricity_spec():
    derived = [*ft.electricity_columns()]
    flags = [f"{c}_missing" for c in b.WEATHER]
    numeric = ["square_feet", "year_built", "floor_count", *b.WEATHER, *flags, *[c for c in derived if c != "season"]]
    return ml.FeatureSpec(numeric, ["primary_use", "season"], "meter_reading")


def electricity_rows(spark, sf):
    rows = ft.electricity_features(treated(spark, sf), keep=["event_id"])
    return materialize(mt.chronological_split(rows, "timestamp", b.TRAIN_END, b.VALID_END), "electricity")


# The published settings have 60 trees and 150 rounds; the query names fewer, the operator's defaults stay.
SHORT_LEARNERS = [
    *tr.ELECTRICITY_LEARNERS[:3],
    tr.Learner("random_forest", "forest_electricity", options={"numTrees": 12}),
    tr.Learner("hist_gradient_boosting", "leafwise", options={"trees": 12, "leaves": 31, "rate": 0.08}),
]


@query("electricity_trials")
def electricity_trials(spark, sf):
    """Five learners on the electricity features: metrics of both parts, times and stored size of each."""
    trials, _ = tr.electricity_trials(electricity_rows(spark, sf), electricity_spec(), ["timestamp", "event_id"], learners=SHORT_LEARNERS)
    return tr.comparison(spark, trials)


@query("screened_trials")
def screened_trials(spark, sf):
    """Raw and log target of two learners on evenly spaced rows, then the better one of each on all rows."""
    learners = [tr.Learner("linear", "linear"), tr.Learner("tree", "tree")]
    tried, final = tr.screened(learners, electricity_rows(spark, sf), electricity_spec(), ["timestamp", "event_id"])
    stage = [tr.comparison(spark, t).withColumn("stage", F.lit(n)) for n, t in (("screen", tried), ("final", final))]
    return stage[0].unionByName(stage[1])
