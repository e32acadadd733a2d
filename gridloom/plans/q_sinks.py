"""Sinks and sources checked by writing and reading back, and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import meter_label
from gridloom.operators import history as hs
from gridloom.operators import profile as pf
from gridloom.operators import quality as qa
from gridloom.plans import bindings as b
from gridloom.plans.q_profile import rounded
from gridloom.plans.registry import query
from gridloom.session import scratch_path
from gridloom.sources import paged, readers, versioned, writers
from gridloom.streaming import ingest


@query("read_csv_typed", "SELECT building_id, meter, CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', ts) END AS timestamp, meter_reading, event_id % 9 = 0 AS bad_timestamp FROM readings")
def read_csv_typed(spark, sf):
    path = scratch_path(spark, "readings-csv")
    text = F.when(F.col("event_id") % 9 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    writers.write_csv(b.readings(spark, sf).select("building_id", "meter", text.alias("timestamp"), "meter_reading"), path)
    return readers.read_readings(spark, path)


@query("write_parquet_snappy", "SELECT event_id, building_id, meter_reading FROM readings")
def write_parquet_snappy(spark, sf):
    path = scratch_path(spark, "readings")
    writers.write_table(b.readings(spark, sf).select("event_id", "building_id", "meter_reading"), path)
    return readers.read_table(spark, path)


def _export_columns():
    return {
        "event_id": F.col("event_id"),
        "meter": F.coalesce(meter_label(F.col("meter")), F.col("meter").cast("string")),
        "site": F.col("site_id"),
        "reading": F.col("meter_reading"),
    }


@query(
    "write_csv_export",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE meter WHEN 0 THEN 'Electricity' WHEN 1 THEN 'Chilled water' WHEN 2 THEN 'Steam'
    WHEN 3 THEN 'Hot water' ELSE CAST(meter AS VARCHAR) END AS meter, coalesce(CAST(site_id AS VARCHAR), '') AS site,
    round(meter_reading, 4) AS reading FROM enriched""",
)
def write_csv_export(spark, sf):
    path = scratch_path(spark, "export")
    writers.export_report(b.enriched(spark, sf), path, _export_columns())
    back = spark.read.option("header", True).schema("event_id string, meter string, site string, reading double").csv(path)
    return back.select("event_id", "meter", F.coalesce("site", F.lit("")).alias("site"), F.round("reading", 4).alias("reading"))


@query(
    "safe_overwrite",
    "SELECT 'refused' AS second_write, CAST(count(*) AS BIGINT) AS row_count FROM readings WHERE meter = 1",
)
def safe_overwrite(spark, sf):
    """A second write without leave is refused, one with leave replaces the table."""
    path = scratch_path(spark, "guarded")
    df = b.readings(spark, sf).select("event_id", "meter")
    writers.write_table(df, path)
    try:
        writers.write_table(df, path)
        outcome = "allowed"
    except Exception:  # noqa: BLE001
        outcome = "refused"
    writers.write_table(df.where("meter = 1"), path, overwrite=True)
    return readers.read_table(spark, path).agg(F.lit(outcome).alias("second_write"), F.count("*").alias("row_count"))


@query(
    "write_site_month",
    """SELECT site_id, strftime(timestamp, '%Y%m') AS month, count(*) AS row_count, round(sum(meter_reading), 4) AS total
    FROM enriched WHERE site_id IS NOT NULL GROUP BY 1, 2""",
)
def write_site_month(spark, sf):
    path = scratch_path(spark, "site-month")
    df = b.enriched(spark, sf).where("site_id IS NOT NULL").select("event_id", "site_id", "timestamp", "meter_reading")
    writers.write_partitioned(df, path, "site_id", "timestamp", files=4)
    back = spark.read.schema("event_id long, timestamp timestamp_ntz, meter_reading double, site_id int, month string").parquet(path)
    return back.groupBy("site_id", "month").agg(F.count("*").alias("row_count"), F.round(F.sum("meter_reading"), 4).alias("total"))


@query(
    "write_stats_json",
    """SELECT 'meter_reading' AS column_name, count(meter_reading) AS filled, round(avg(meter_reading), 6) AS mean FROM readings
    UNION ALL SELECT 'building_id', count(building_id), round(avg(building_id), 6) FROM readings""",
)
def write_stats_json(spark, sf):
    path = scratch_path(spark, "stats")
    writers.write_stats(pf.numeric_stats(b.readings(spark, sf), ["meter_reading", "building_id"]), path)
    back = spark.read.schema("column_name string, filled long, mean double").json(path)
    return rounded(back, 6, "mean")


@query("canonical_order", "SELECT event_id, site_id, timestamp, building_id, row_number() OVER (ORDER BY site_id NULLS FIRST, timestamp, building_id) - 1 AS place FROM enriched")
def canonical_order(spark, sf):
    """The written order is read back through the files' own row order."""
    from gridloom.operators.scale import with_position

    df = b.enriched(spark, sf).select("event_id", "site_id", "timestamp", "building_id")
    order = [F.col("site_id"), F.col("timestamp"), F.col("building_id")]
    return with_position(hs.canonical_sort(df, "site_id", "timestamp", "building_id"), order, "place")


@query(
    "check_contract",
    """SELECT 'forbidden_column' AS rule, 'meter' AS detail UNION ALL SELECT 'missing_column', 'season'
    UNION ALL SELECT 'row_count', CAST(count(*) AS VARCHAR) || ' for ' || CAST(count(*) + 1 AS VARCHAR) FROM readings""",
)
def check_contract(spark, sf):
    df = b.enriched(spark, sf)
    return qa.check_contract(df, [*df.columns, "season"], forbidden=["meter"], rows=b.readings(spark, sf).count() + 1)


@query(
    "row_count_guard",
    "SELECT count(*) AS before, count(*) AS after FROM readings",
)
def row_count_guard(spark, sf):
    before = b.readings(spark, sf)
    after = b.enriched(spark, sf)
    return before.agg(F.count("*").alias("before")).withColumn("after", F.lit(after.count()).cast("long"))


def _event_stream(spark, sf):
    schema = b.table(spark, sf, "events").schema
    return ingest.read_stream(spark, sf, schema, pattern="events.parquet")


@query("stream_ingest_readings", "SELECT event_id, user_id, ts, value FROM events")
def stream_ingest_readings(spark, sf):
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    source = _event_stream(spark, sf).select("event_id", "user_id", "ts", "value")
    doubled = source.unionByName(source)
    ingest.ingest_stream(doubled, "user_id", "ts", out, checkpoint, "60 days").awaitTermination()
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "stream_daily_profile",
    """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, round(sum(value), 4) AS total, count(value) AS row_count,
    round(avg(value), 6) AS mean FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
    GROUP BY 1""",
)
def stream_daily_profile(spark, sf):
    """Days still open at the watermark are withheld, so only closed days come out."""
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    daily = ingest.daily_stream(_event_stream(spark, sf), "ts", "value")
    ingest.start_append(daily, out, checkpoint).awaitTermination()
    back = spark.read.parquet(out).withColumn("period", F.col("period").cast("timestamp_ntz"))
    return rounded(rounded(back, 4, "total"), 6, "mean")


@query(
    "stream_detect_anomalies",
    """WITH c AS (SELECT user_id, median(value) AS center FROM events GROUP BY 1),
    s AS (SELECT e.user_id, 1.4826 * median(abs(value - center)) AS scale FROM events e JOIN c ON e.user_id = c.user_id GROUP BY 1)
    SELECT e.user_id, e.ts, value AS actual_kwh, round(center, 6) AS expected_kwh FROM events e JOIN c ON e.user_id = c.user_id
    JOIN s ON e.user_id = s.user_id WHERE scale > 0 AND abs(value - center) / scale >= 3.5""",
)
def stream_detect_anomalies(spark, sf):
    store, checkpoint = scratch_path(spark, "anomalies"), scratch_path(spark, "stream-checkpoint")
    source = _event_stream(spark, sf).select("user_id", "ts", "value")
    ingest.stream_anomalies(source, "user_id", "ts", "value", store, checkpoint).awaitTermination()
    return _found(spark, store)


_CUTS = ("2024-01-10", "2024-01-20")


@query(
    "stream_detect_growing_history",
    f"""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < TIMESTAMP '{_CUTS[0]}' THEN 0 WHEN ts < TIMESTAMP '{_CUTS[1]}' THEN 1 ELSE 2 END AS batch
    FROM events),
    k AS (SELECT t.batch, e.user_id, ts, value FROM e JOIN (SELECT DISTINCT batch, user_id FROM e) t ON e.user_id = t.user_id AND e.batch <= t.batch
    QUALIFY row_number() OVER (PARTITION BY t.batch, e.user_id ORDER BY ts DESC, value) <= 40),
    c AS (SELECT batch, user_id, median(value) AS center FROM k GROUP BY 1, 2),
    s AS (SELECT k.batch, k.user_id, 1.4826 * median(abs(value - center)) AS scale FROM k JOIN c USING (batch, user_id) GROUP BY 1, 2)
    SELECT user_id, ts, value AS actual_kwh, round(center, 6) AS expected_kwh FROM k JOIN c USING (batch, user_id) JOIN s USING (batch, user_id)
    WHERE scale > 0 AND abs(value - center) / scale >= 3.5
    QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY batch, value) = 1""",
)
def stream_detect_growing_history(spark, sf):
    """Three micro-batches; each is judged against the newest 40 readings per meter seen so far."""
    arrived, store, kept = scratch_path(spark, "arrived"), scratch_path(spark, "anomalies"), scratch_path(spark, "history")
    events = b.table(spark, sf, "events", "user_id", "ts", "value")
    first, second = (F.lit(c).cast("timestamp_ntz") for c in _CUTS)
    for part in (F.col("ts") < first, (F.col("ts") >= first) & (F.col("ts") < second), F.col("ts") >= second):
        events.where(part).repartition(4).write.mode("append").parquet(arrived)
    source = ingest.read_stream(spark, arrived, events.schema, files_per_batch=4)
    checkpoint = scratch_path(spark, "stream-checkpoint")
    ingest.stream_anomalies(source, "user_id", "ts", "value", store, checkpoint, kept=kept, records=40).awaitTermination()
    return _found(spark, store)


def _found(spark, store):
    shape = T.StructType.fromDDL(
        "user_id long, ts timestamp, anomaly_type string, severity string, actual_kwh double, expected_kwh double, "
        "deviation_pct double, description string"
    )
    found = ingest.stored_anomalies(spark, store, shape)
    return found.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "actual_kwh", F.round("expected_kwh", 6).alias("expected_kwh"))


_SITE_MONTHS = """SELECT site, strftime(ts, '%Y%m') AS month, {label} AS version, count(*) AS row_count, sum(value) AS total
    FROM feeds WHERE {keep} GROUP BY 1, 2"""


@query(
    "versioned_site_month",
    " UNION ALL ".join(
        _SITE_MONTHS.format(label=n, keep=keep) for n, keep in enumerate(["value >= 500", "true", "value IS NOT NULL", "true"], 1)
    ),
)
def versioned_site_month(spark, sf):
    """A table by site and month through four versions, each read whole: written, added to, rewritten from itself, restored."""
    path = scratch_path(spark, "versioned")
    df = b.feeds(spark, sf).select("reading_id", "site", F.date_format("ts", "yyyyMM").alias("month"), "value")
    high = F.coalesce(F.col("value") >= 500, F.lit(False))
    versioned.write_version(df.where(high), path, partition_by=["site", "month"], batch=("load", 0))
    for _ in range(2):  # a batch that is sent again adds nothing
        versioned.write_version(df.where(~high), path, append=True, batch=("load", 1))
    whole = versioned.read_version(spark, path)
    versioned.write_version(whole.where("value IS NOT NULL"), path, partition_by=["site", "month"], expected=2)
    versioned.restore(spark, path, 2)
    told = None
    for n in range(1, 5):
        rows = versioned.read_version(spark, path, n).groupBy("site", "month")
        part = rows.agg(F.count("*").alias("row_count"), F.sum("value").alias("total")).withColumn("version", F.lit(n))
        told = part if told is None else told.unionByName(part)
    return told.select("site", "month", "version", "row_count", "total")


@query(
    "seek_pages",
    """WITH p AS (SELECT reading_id, meter_id, value, row_number() OVER (ORDER BY value DESC NULLS LAST, reading_id) - 1 AS position, count(*) OVER () AS n FROM feeds)
    SELECT reading_id, meter_id, value, position FROM p WHERE position // 8 IN (0, 99, (n - 1) // 16, (n - 1) // 8)""",
)
def seek_pages(spark, sf):
    """The first, the hundredth, a middle and the last page of the feed by size, each read through the index."""
    path = scratch_path(spark, "pages")
    rows = b.feeds(spark, sf).select("reading_id", "meter_id", "value")
    n = paged.write_pages(rows, path, [F.col("value").desc_nulls_last(), F.col("reading_id")])
    wanted = sorted({1, 100, max(n - 1, 0) // 16 + 1, max(n - 1, 0) // 8 + 1})
    found = [paged.read_page(spark, path, k, 8, "position") for k in wanted]
    out = found[0]
    for page in found[1:]:
        out = out.unionByName(page)
    return out
