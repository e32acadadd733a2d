"""Streams with keyed state over the feed of documents: each is cut in two, with a restart in between."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.plans import bindings as b
from gridloom.plans.registry import query
from gridloom.session import scratch_path
from gridloom.streaming import ingest, keyed

RECORDS, IDLE_HOURS = 40, 12
ENTER, LEAVE = 6000.0, 3000.0


def _streamed(spark, sf, build):
    """What ``build`` makes of the feed as it arrives: the earlier half, a stop, and the rest from the checkpoint."""
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("feed", "stream-out", "stream-checkpoint"))
    feed = b.feeds(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).select("meter_id", "ts", "value")
    ends = feed.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).select((F.unix_micros("a") / 2 + F.unix_micros("z") / 2).cast("long")).first()
    half = F.unix_micros("ts") < F.lit(ends[0])
    for part in (half, ~half):
        feed.where(part).write.mode("append").parquet(folder)
        source = ingest.read_stream(spark, folder, feed.schema)
        ingest.start_append(build(source), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


def _naive(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(
    "stream_rolling_anomalies",
    f"""WITH f AS (SELECT meter_id, ts, value, lag(ts) OVER past AS before FROM feeds WHERE ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM feeds)
      WINDOW past AS (PARTITION BY meter_id ORDER BY ts, value)),
    r AS (SELECT *, sum(CASE WHEN ts - before > INTERVAL {IDLE_HOURS} HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY meter_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS run
      FROM f),
    w AS (SELECT meter_id, ts, value, list(value) OVER (PARTITION BY meter_id, run ORDER BY ts, value ROWS BETWEEN {RECORDS - 1} PRECEDING AND CURRENT ROW) AS v FROM r),
    c AS (SELECT *, list_median(v) AS center FROM w),
    s AS (SELECT *, 1.4826 * list_median(list_transform(v, lambda x: abs(x - center))) AS scale FROM c)
    SELECT meter_id, ts, value AS actual_kwh, round(center, 6) AS expected_kwh, CASE WHEN value > center THEN 'spike' ELSE 'drop' END AS anomaly_type FROM s
    WHERE len(v) >= 3 AND scale > 0 AND abs(value - center) / scale >= 3.5""",
)
def stream_rolling_anomalies(spark, sf):
    """Each reading against the newest readings of its meter; a long silence starts a meter anew."""
    build = lambda s: keyed.rolling_anomalies(s, "meter_id", "ts", "value", RECORDS, IDLE_HOURS * 3600)
    found = _streamed(spark, sf, build).withColumn("expected_kwh", F.round("expected_kwh", 6))
    return _naive(found, "ts").select("meter_id", "ts", "actual_kwh", "expected_kwh", "anomaly_type")


@query(
    "stream_threshold_alerts",
    f"""WITH w AS (SELECT meter_id, time_bucket(INTERVAL 15 MINUTE, ts) + to_minutes(15 * k) AS noticed_at, avg(value) AS level
      FROM feeds, (SELECT unnest(range(1, 5)) AS k) GROUP BY 1, 2),
    closed AS (SELECT * FROM w WHERE noticed_at <= (SELECT max(ts) - INTERVAL 1 HOUR FROM feeds)),
    s AS (SELECT *, coalesce(last_value(CASE WHEN level >= {ENTER} THEN 1 WHEN level < {LEAVE} THEN 0 END IGNORE NULLS)
      OVER (PARTITION BY meter_id ORDER BY noticed_at ROWS UNBOUNDED PRECEDING), 0) AS open FROM closed),
    e AS (SELECT *, coalesce(lag(open) OVER past, 0) AS earlier FROM s WINDOW past AS (PARTITION BY meter_id ORDER BY noticed_at)),
    n AS (SELECT *, sum(CASE WHEN open = 1 AND earlier = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY meter_id ORDER BY noticed_at ROWS UNBOUNDED PRECEDING) AS excursion FROM e),
    x AS (SELECT meter_id, excursion, min(noticed_at) AS opened_at, max(level) AS peak, count(*) AS windows FROM n WHERE open = 1 GROUP BY 1, 2)
    SELECT n.meter_id, 'opened' AS event, noticed_at AS opened_at, noticed_at, level AS peak, CAST(1 AS BIGINT) AS windows FROM n WHERE open = 1 AND earlier = 0
    UNION ALL SELECT n.meter_id, 'cleared', x.opened_at, n.noticed_at, x.peak, x.windows FROM n JOIN x ON n.meter_id = x.meter_id AND n.excursion = x.excursion
    WHERE n.open = 0 AND n.earlier = 1""",
)
def stream_threshold_alerts(spark, sf):
    """One opened and one cleared row per excursion of the hourly mean, every quarter of an hour."""
    build = lambda s: keyed.threshold_alerts(s, "meter_id", "ts", "value", ENTER, LEAVE)
    return _naive(_streamed(spark, sf, build), "opened_at", "noticed_at")


_OUTCOMES = """WITH o AS (SELECT p.meter_id, p.ts + INTERVAL 1 HOUR AS ts, p.value AS predicted, a.value AS actual
  FROM feeds p LEFT JOIN feeds a ON a.meter_id = p.meter_id AND a.ts = p.ts + INTERVAL 1 HOUR),
  e AS (SELECT *, predicted - actual AS error FROM o WHERE actual IS NOT NULL OR ts <= (SELECT max(ts) - INTERVAL 2 HOUR FROM feeds))"""


def _outcomes(spark, sf):
    """Each reading predicts the one an hour later."""

    def build(source):
        later = source.select("meter_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.col("value").alias("predicted"))
        return keyed.prediction_outcomes(later, source.withColumnRenamed("value", "actual"), "meter_id", "ts", "predicted", "actual")

    return _streamed(spark, sf, build)


@query("stream_prediction_outcomes", _OUTCOMES + " SELECT meter_id, ts, predicted, actual, error, abs(error) AS absolute_error FROM e")
def stream_prediction_outcomes(spark, sf):
    return _naive(_outcomes(spark, sf), "ts")


@query(
    "stream_prediction_accuracy",
    _OUTCOMES + """ SELECT meter_id, count(*) AS predictions, count(actual) AS met, round(avg(error), 6) AS bias, round(avg(abs(error)), 6) AS mae,
    round(sqrt(avg(error * error)), 6) AS rmse FROM e GROUP BY 1""",
)
def stream_prediction_accuracy(spark, sf):
    found = keyed.accuracy(_outcomes(spark, sf), "meter_id")
    return found.select("meter_id", "predictions", "met", *[F.round(c, 6).alias(c) for c in ("bias", "mae", "rmse")])
