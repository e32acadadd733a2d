"""Meter-shaped views over the given tables, for Spark and as SQL text.

The same rules are written twice on purpose: once as DataFrames, once as the
SQL the oracle runs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.joins import enrich
from gridloom.sources.readers import read_table

WEATHER = [
    "air_temperature",
    "cloud_coverage",
    "dew_temperature",
    "precip_depth_1_hr",
    "sea_level_pressure",
    "wind_direction",
    "wind_speed",
]
MERGED = [
    "building_id",
    "meter",
    "timestamp",
    "meter_reading",
    "site_id",
    "primary_use",
    "square_feet",
    "year_built",
    "floor_count",
    *WEATHER,
]
SITES = 25
TRAIN_END = "2024-01-20 23:59:59"
VALID_END = "2024-01-25 23:59:59"
FEED_START = "2024-01-01 00:00:00"
ORDER_TRAIN_END = "1998-12-31 23:59:59"
ORDER_VALID_END = "1999-12-31 23:59:59"


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", list(columns) or None)


def hour_of(column: str):
    return F.date_trunc("hour", F.col(column)).cast("timestamp_ntz")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    meter = (
        F.when(kind == "click", 0).when(kind == "error", 1).when(kind == "purchase", 2).when(kind == "signup", 3).otherwise(4)
    )
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("building_id"),
        meter.alias("meter"),
        "ts",
        hour_of("ts").alias("ts_hour"),
        F.col("value").alias("meter_reading"),
    )


def buildings(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").where(key % 50 != 7).select(
        key.alias("building_id"),
        F.col("c_nationkey").alias("site_id"),
        F.col("c_mktsegment").alias("primary_use"),
        (500 + key * 7).alias("square_feet"),
        F.when(key % 3 == 0, None).otherwise((1900 + key % 125).cast("double")).alias("year_built"),
        F.when(key % 4 == 0, None).otherwise((1 + key % 9).cast("double")).alias("floor_count"),
    )


def weather(spark: SparkSession, sf: str) -> DataFrame:
    hours = table(spark, sf, "events", "ts").select(hour_of("ts").alias("ts_hour")).distinct()
    slots = hours.select(F.explode(F.sequence(F.lit(0), F.lit(SITES - 1))).alias("site_id"), "ts_hour")
    k = (F.dayofyear("ts_hour") - 1) * 24 + F.hour("ts_hour")
    site = F.col("site_id")

    def gap(every: int, value):
        return F.when((F.col("k") + site) % every == 0, None).otherwise(value.cast("double"))

    k_col = F.col("k")
    return (
        slots.withColumn("k", k)
        .where((k_col + 3 * site) % 11 != 0)
        .select(
            "site_id",
            "ts_hour",
            gap(7, (k_col * 13 + site * 5) % 45 - 10).alias("air_temperature"),
            gap(4, (k_col * 3 + site) % 10).alias("cloud_coverage"),
            gap(5, (k_col * 7 + site) % 30 - 15).alias("dew_temperature"),
            gap(6, (k_col * 5 + site) % 8 - 1).alias("precip_depth_1_hr"),
            gap(8, 990 + (k_col * 17 + site) % 50).alias("sea_level_pressure"),
            gap(9, (k_col * 37) % 361).alias("wind_direction"),
            ((k_col * 11 + site) % 20).cast("double").alias("wind_speed"),
        )
    )


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with building and weather columns; site comes from the building."""
    joined = enrich(readings(spark, sf), buildings(spark, sf), ["building_id"])
    joined = enrich(joined, weather(spark, sf), ["site_id", "ts_hour"])
    return joined.select("event_id", "ts_hour", *[F.col("ts").alias(c) if c == "timestamp" else F.col(c) for c in MERGED])


def feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as readings: a source is a meter that reports a size once a minute, its language is the site."""
    return table(spark, sf, "documents", "doc_id", "source", "lang", "n_chars").select(
        F.col("doc_id").alias("reading_id"),
        F.col("source").alias("meter_id"),
        F.col("lang").alias("site"),
        F.timestamp_micros(F.unix_micros(F.lit(FEED_START).cast("timestamp")) + F.col("doc_id") * 60_000_000).cast("timestamp_ntz").alias("ts"),
        F.col("n_chars").cast("double").alias("value"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderdate",
        "o_orderpriority",
        "o_orderstatus",
        price.alias("y"),
        (price * (0.8 + 0.05 * (F.col("o_orderkey") % 9)) - 2000).alias("p"),
    )


_GAP = "CASE WHEN (k + site_id) % {0} = 0 THEN NULL ELSE CAST({1} AS DOUBLE) END AS {2}"
VIEWS = {
    "readings": """SELECT event_id, user_id AS building_id,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS meter,
  ts, date_trunc('hour', ts) AS ts_hour, value AS meter_reading FROM events""",
    "buildings": """SELECT c_custkey AS building_id, c_nationkey AS site_id, c_mktsegment AS primary_use,
  500 + c_custkey * 7 AS square_feet,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(1900 + c_custkey % 125 AS DOUBLE) END AS year_built,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(1 + c_custkey % 9 AS DOUBLE) END AS floor_count
  FROM customer WHERE c_custkey % 50 <> 7""",
    "slots": f"""SELECT CAST(unnest(range({SITES})) AS INTEGER) AS site_id, ts_hour
  FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts_hour FROM events)""",
    "slot_index": "SELECT site_id, ts_hour, (dayofyear(ts_hour) - 1) * 24 + hour(ts_hour) AS k FROM slots",
    "weather": "SELECT site_id, ts_hour, "
    + ", ".join(
        [
            _GAP.format(7, "(k * 13 + site_id * 5) % 45 - 10", "air_temperature"),
            _GAP.format(4, "(k * 3 + site_id) % 10", "cloud_coverage"),
            _GAP.format(5, "(k * 7 + site_id) % 30 - 15", "dew_temperature"),
            _GAP.format(6, "(k * 5 + site_id) % 8 - 1", "precip_depth_1_hr"),
            _GAP.format(8, "990 + (k * 17 + site_id) % 50", "sea_level_pressure"),
            _GAP.format(9, "(k * 37) % 361", "wind_direction"),
            "CAST((k * 11 + site_id) % 20 AS DOUBLE) AS wind_speed",
        ]
    )
    + " FROM slot_index WHERE (k + 3 * site_id) % 11 <> 0",
    "enriched": """SELECT r.event_id, r.ts_hour, r.building_id, r.meter, r.ts AS timestamp, r.meter_reading, b.site_id, b.primary_use,
  b.square_feet, b.year_built, b.floor_count, w.air_temperature, w.cloud_coverage, w.dew_temperature,
  w.precip_depth_1_hr, w.sea_level_pressure, w.wind_direction, w.wind_speed
  FROM readings r LEFT JOIN buildings b ON r.building_id = b.building_id
  LEFT JOIN weather w ON b.site_id = w.site_id AND r.ts_hour = w.ts_hour""",
    "scored": """SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice AS y,
  o_totalprice * (0.8 + 0.05 * (o_orderkey % 9)) - 2000 AS p FROM orders""",
    "feeds": f"""SELECT doc_id AS reading_id, source AS meter_id, lang AS site, TIMESTAMP '{FEED_START}' + to_minutes(doc_id) AS ts,
  CAST(n_chars AS DOUBLE) AS value FROM documents""",
    "history": """SELECT building_id AS meter_id, ts AS timestamp, meter_reading AS consumption_kwh,
  event_id, event_id % 17 <> 3 AS is_valid FROM readings""",
    "predictions": """SELECT o_orderkey AS id, o_custkey AS meter_id, o_orderdate AS predicted_at,
  o_totalprice AS predicted_kwh FROM orders""",
}


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Energy records: one meter per building, every 17th record flagged invalid."""
    return readings(spark, sf).select(
        F.col("building_id").alias("meter_id"),
        F.col("ts").alias("timestamp"),
        F.col("meter_reading").alias("consumption_kwh"),
        "event_id",
        (F.col("event_id") % 17 != 3).alias("is_valid"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("meter_id"),
        F.col("o_orderdate").alias("predicted_at"),
        F.col("o_totalprice").alias("predicted_kwh"),
    )


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the view definitions it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    sql = sql.strip()
    visit(sql)
    if not needed:
        return sql
    head = "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if sql.startswith("WITH "):
        return f"{head},\n{sql[5:]}"
    return f"{head}\n{sql}"


STATIC = ["year_built", "floor_count"]


def clean(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched readings with both imputation lookups applied."""
    from gridloom.operators.impute import impute_bidirectional

    return impute_bidirectional(
        enriched(spark, sf), "building_id", "site_id", "ts_hour", "primary_use", STATIC, WEATHER
    )


def electric(spark: SparkSession, sf: str) -> DataFrame:
    """Electricity readings without negatives, enriched."""
    from gridloom.operators.quality import clean_readings

    joined = enrich(clean_readings(readings(spark, sf), "meter_reading", "meter", 0), buildings(spark, sf), ["building_id"])
    joined = enrich(joined, weather(spark, sf), ["site_id", "ts_hour"])
    return joined.select("event_id", "ts_hour", *[F.col("ts").alias(c) if c == "timestamp" else F.col(c) for c in MERGED])


def _interpolated_sql() -> str:
    marks = ", ".join(
        f"""last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER ahead AS {c}_pr,
  last_value({c} IGNORE NULLS) OVER ahead AS {c}_pv,
  first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER behind AS {c}_nr,
  first_value({c} IGNORE NULLS) OVER behind AS {c}_nv"""
        for c in WEATHER
    )
    values = ", ".join(
        f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_pr IS NULL THEN {c}_nv WHEN {c}_nr IS NULL THEN {c}_pv
  ELSE {c}_pv + ({c}_nv - {c}_pv) / ({c}_nr - {c}_pr) * (rn - {c}_pr) END AS {c}"""
        for c in WEATHER
    )
    return f"""SELECT site_id, ts_hour, {values} FROM (SELECT *, {marks}
  FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts_hour) AS rn FROM spine)
  WINDOW ahead AS (PARTITION BY site_id ORDER BY ts_hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  behind AS (PARTITION BY site_id ORDER BY ts_hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _carried_sql() -> str:
    values = ", ".join(
        f"coalesce(last_value(s.{c} IGNORE NULLS) OVER past, m.{c}, g.{c}) AS {c}, CAST(s.{c} IS NULL AS INTEGER) AS {c}_missing"
        for c in WEATHER
    )
    return f"""SELECT s.site_id, s.ts_hour, {values} FROM e_spine s LEFT JOIN e_site m ON s.site_id = m.site_id LEFT JOIN e_all g ON true
  WINDOW past AS (PARTITION BY s.site_id ORDER BY s.ts_hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


_MAXES = ", ".join(f"max({c}) AS {c}" for c in WEATHER)
_MEDIANS = ", ".join(f"median({c}) AS {c}" for c in WEATHER)
VIEWS.update(
    {
        "spine": f"SELECT site_id, ts_hour, {_MAXES} FROM enriched WHERE site_id IS NOT NULL GROUP BY 1, 2",
        "interpolated": _interpolated_sql(),
        "lookup": "SELECT building_id, max(primary_use) AS primary_use, max(year_built) AS year_built, "
        "max(floor_count) AS floor_count FROM enriched GROUP BY 1",
        "lookup_use": "SELECT primary_use, median(year_built) AS year_built, median(floor_count) AS floor_count FROM lookup GROUP BY 1",
        "lookup_all": "SELECT median(year_built) AS year_built, median(floor_count) AS floor_count FROM lookup",
        "static_filled": """SELECT l.building_id, l.primary_use,
  coalesce(l.year_built, round_even(coalesce(u.year_built, g.year_built), 0)) AS year_built,
  coalesce(l.floor_count, round_even(coalesce(u.floor_count, g.floor_count), 0)) AS floor_count
  FROM lookup l LEFT JOIN lookup_use u ON l.primary_use = u.primary_use LEFT JOIN lookup_all g ON true""",
        "clean": """SELECT e.event_id, e.ts_hour, e.building_id, e.meter, e.timestamp, e.meter_reading, e.site_id, e.primary_use,
  e.square_feet, coalesce(e.year_built, s.year_built) AS year_built, coalesce(e.floor_count, s.floor_count) AS floor_count, """
        + ", ".join(f"coalesce(e.{c}, i.{c}) AS {c}" for c in WEATHER)
        + """ FROM enriched e LEFT JOIN static_filled s ON e.building_id = s.building_id
  LEFT JOIN interpolated i ON e.site_id = i.site_id AND e.ts_hour = i.ts_hour""",
        "electric": "SELECT * FROM enriched WHERE meter = 0 AND meter_reading >= 0",
        "e_spine": f"SELECT site_id, ts_hour, {_MAXES} FROM electric WHERE site_id IS NOT NULL GROUP BY 1, 2",
        "e_all": f"SELECT {_MEDIANS} FROM e_spine WHERE ts_hour <= TIMESTAMP '{TRAIN_END}'",
        "e_known": f"SELECT site_id, {_MEDIANS} FROM e_spine WHERE ts_hour <= TIMESTAMP '{TRAIN_END}' GROUP BY 1",
        "e_site": "SELECT k.site_id, "
        + ", ".join(f"coalesce(k.{c}, g.{c}) AS {c}" for c in WEATHER)
        + " FROM e_known k LEFT JOIN e_all g ON true",
        "e_filled": _carried_sql(),
        "treated": "SELECT e.event_id, "
        + ", ".join(f"e.{c}" for c in MERGED if c not in WEATHER)
        + ", "
        + ", ".join(
            f"coalesce(f.{c}, e.{c}, g.{c}) AS {c}, coalesce(f.{c}_missing, CAST(e.{c} IS NULL AS INTEGER)) AS {c}_missing"
            for c in WEATHER
        )
        + " FROM electric e LEFT JOIN e_filled f ON e.site_id = f.site_id AND e.ts_hour = f.ts_hour LEFT JOIN e_all g ON true",
    }
)
