"""Target codes and leaf-wise boosting over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import boosting, encoding
from gridloom.operators import metrics as mt
from gridloom.plans import bindings as b
from gridloom.plans import q_models
from gridloom.plans.registry import query
from gridloom.session import materialize

SEED = 42


@query(
    "ordered_target_codes",
    f"""WITH o AS (SELECT *, substr(sha256('{SEED}:' || reading_id), 1, 16) AS h FROM feeds),
    s AS (SELECT reading_id, coalesce(sum(value) OVER before, 0) AS total, count(value) OVER before AS n FROM o
      WINDOW before AS (PARTITION BY meter_id ORDER BY h, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT reading_id, round((total + (SELECT avg(value) FROM feeds)) / (n + 1) + 1e-8, 6) AS code FROM s""",
)
def ordered_target_codes(spark, sf):
    """Each reading's meter as the mean of that meter's readings before it in a seeded order."""
    return encoding.ordered_target_codes(b.feeds(spark, sf), "reading_id", "meter_id", "value", SEED).withColumn("code", F.round(F.col("code") + 1e-8, 6))


@query(
    "target_codes",
    """SELECT meter_id, round((sum(value) + (SELECT avg(value) FROM feeds)) / (count(value) + 1) + 1e-8, 6) AS code FROM feeds GROUP BY 1""",
)
def target_codes(spark, sf):
    feed = b.feeds(spark, sf)
    codes = encoding.target_codes(feed, "meter_id", "value")
    return codes.select(F.when(F.col("_known"), F.col("_cat")).alias("meter_id"), F.round(F.col("code") + 1e-8, 6).alias("code"))


FEED_COLUMNS = ["hour", "weekday", "meter_code", "site_code"]


def feed_rows(spark, sf):
    """Readings with coded meter and site; the last fifth by time is held out and gets the codes of the rest."""
    feed = b.feeds(spark, sf).where("value IS NOT NULL")
    span = feed.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("z")).first()
    cut = span["a"] + (span["z"] - span["a"]) * 4 // 5 if span["a"] is not None else 0
    feed = feed.select(
        "*",
        (F.unix_micros(F.col("ts").cast("timestamp")) >= cut).alias("held"),
        F.hour("ts").alias("hour"),
        F.weekday("ts").alias("weekday"),
        F.log1p("value").alias("target"),
    )
    train, held = feed.where("NOT held"), feed.where("held")
    for column, name in (("meter_id", "meter_code"), ("site", "site_code")):
        prior = encoding.target_prior(train, "target")
        ordered = encoding.ordered_target_codes(train, "reading_id", column, "target", SEED, prior=prior, name=name)
        train = train.join(ordered, "reading_id")
        held = encoding.apply_target_codes(held, encoding.target_codes(train, column, "target", prior=prior, name=name), column, prior, name)
    return materialize(train.unionByName(held), "feed-features")


@query("boosted_feeds")
def boosted_feeds(spark, sf):
    """Metrics of leaf-wise boosting on the size of the documents, learnt from the earlier four fifths."""
    rows = feed_rows(spark, sf)
    settings = boosting.Settings(trees=10, leaves=15, rate=0.2, patience=5)
    model = boosting.fit_booster(rows, FEED_COLUMNS, "target", F.col("held"), settings)
    scored = rows.select("value", F.when(F.col("held"), "held").otherwise("training").alias("split"), F.expm1(model.scored()).alias("raw_prediction"))
    return mt.clipped_metrics(scored, "value", "raw_prediction", ["split"])


# The published settings of the histogram learner.
HISTOGRAM = {"leaves": 31, "bins": 255, "least_rows": 20, "rate": 0.08, "l2": 0.0}


@query("train_boosted_leafwise")
def train_boosted_leafwise(spark, sf):
    """Metrics of leaf-wise boosting on the first feature set, on the log of the target."""
    rows = q_models.model_rows(spark, sf)
    rows = rows.withColumns({"held": F.col("split") == "validation", "log_target": F.log1p(F.col("meter_reading").cast("double"))})
    train = rows.where("split <> 'testing' AND meter_reading IS NOT NULL")
    settings = boosting.Settings(trees=30, patience=10, **HISTOGRAM)
    model = boosting.fit_booster(train, q_models._MODEL_NUMERIC, "log_target", F.col("held"), settings)
    scored = rows.where("split <> 'training'").select("meter_reading", "split", F.expm1(model.scored()).alias("raw_prediction"))
    return mt.clipped_metrics(scored, "meter_reading", "raw_prediction", ["split"])
