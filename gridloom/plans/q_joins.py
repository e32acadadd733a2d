"""Join, set, sort and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import history as hs
from gridloom.operators import joins as jn
from gridloom.operators import profile as pf
from gridloom.operators import quality as qa
from gridloom.operators import windows as wn
from gridloom.operators.anomaly import detect_and_store, mad_anomalies
from gridloom.operators.outlook import forecast_steps, peak_outlook
from gridloom.plans import bindings as b
from gridloom.plans.q_features import floats
from gridloom.plans.q_profile import rounded
from gridloom.plans.registry import query


@query(
    "assert_lookup_key",
    """SELECT count(*) AS row_count, count(*) FILTER (WHERE l_orderkey IS NULL OR k IS NULL) AS null_keys,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, nullif(l_linenumber, 7) AS k FROM lineitem)) AS duplicate_keys
    FROM (SELECT l_orderkey, nullif(l_linenumber, 7) AS k FROM lineitem)""",
)
def assert_lookup_key(spark, sf):
    df = b.table(spark, sf, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(7)).alias("k"))
    return jn.key_report(df, ["l_orderkey", "k"])


@query(
    "join_metadata",
    """SELECT r.event_id, r.building_id, b.site_id, b.primary_use, b.square_feet, b.year_built, b.floor_count
    FROM readings r LEFT JOIN buildings b ON r.building_id = b.building_id""",
)
def join_metadata(spark, sf):
    joined = jn.guarded_join(b.readings(spark, sf), b.buildings(spark, sf), ["building_id"], "buildings")
    return joined.select("event_id", "building_id", "site_id", "primary_use", "square_feet", "year_built", "floor_count")


@query("join_weather", "SELECT event_id, " + ", ".join(b.MERGED) + " FROM enriched")
def join_weather(spark, sf):
    return b.enriched(spark, sf).select("event_id", *b.MERGED)


@query(
    "match_rates",
    """SELECT n AS row_count, nb AS unmatched_buildings, nw AS unmatched_weather,
    round_even(100.0 * (n - nb) / n, 4) AS building_success_pct, round_even(100.0 * (n - nw) / n, 4) AS weather_success_pct,
    100.0::DOUBLE AS retention_pct FROM (SELECT count(*) AS n, count(*) FILTER (WHERE site_id IS NULL) AS nb,
    count(*) FILTER (WHERE wind_speed IS NULL) AS nw FROM enriched)""",
)
def match_rates(spark, sf):
    return jn.match_rates(b.enriched(spark, sf), "building_id", "wind_speed", "site_id")


_SITED = """SELECT r.event_id, b.site_id, r.ts_hour FROM readings r LEFT JOIN buildings b ON r.building_id = b.building_id"""


def _sited(spark, sf):
    return jn.map_column(b.readings(spark, sf), b.buildings(spark, sf), "building_id", "site_id").select(
        "event_id", "site_id", "ts_hour"
    )


@query(
    "semi_weather_coverage",
    f"SELECT * FROM ({_SITED}) f WHERE EXISTS (SELECT 1 FROM weather w WHERE w.site_id = f.site_id AND w.ts_hour = f.ts_hour)",
)
def semi_weather_coverage(spark, sf):
    return jn.covered(_sited(spark, sf), b.weather(spark, sf), ["site_id", "ts_hour"])


@query(
    "anti_weather_coverage",
    f"SELECT * FROM ({_SITED}) f WHERE NOT EXISTS (SELECT 1 FROM weather w WHERE w.site_id = f.site_id AND w.ts_hour = f.ts_hour)",
)
def anti_weather_coverage(spark, sf):
    return jn.uncovered(_sited(spark, sf), b.weather(spark, sf), ["site_id", "ts_hour"])


@query("unmatched_keys", "SELECT DISTINCT building_id FROM readings WHERE building_id NOT IN (SELECT building_id FROM buildings)")
def unmatched_keys(spark, sf):
    return jn.unmatched_keys(b.readings(spark, sf), b.buildings(spark, sf), "building_id")


@query("map_lookup", f"SELECT event_id, site_id FROM ({_SITED})")
def map_lookup(spark, sf):
    return _sited(spark, sf).select("event_id", "site_id")


@query(
    "first_row_per_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_extendedprice, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""",
)
def first_row_per_key(spark, sf):
    df = b.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    first = jn.first_row(df, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_extendedprice", "l_suppkey"])
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(
    "insert_if_absent",
    """WITH old AS (SELECT o_custkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (
      PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1),
    new AS (SELECT o_custkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (
      PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'F') WHERE rn = 1)
    SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS
    (SELECT 1 FROM old o WHERE o.o_custkey = n.o_custkey AND o.o_orderpriority = n.o_orderpriority)""",
)
def insert_if_absent(spark, sf):
    df = b.table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    keys = ["o_custkey", "o_orderpriority"]
    old = jn.first_row(df.where("o_orderstatus = 'F'"), keys, ["o_orderkey"]).drop("o_orderstatus")
    new = df.where("o_orderstatus <> 'F'").drop("o_orderstatus")
    return jn.insert_if_absent(old, new, keys, ["o_orderkey"]).drop("o_orderkey")


@query(
    "fill_actuals",
    """SELECT p.id, p.meter_id, p.predicted_kwh, a.actual_kwh FROM predictions p LEFT JOIN (SELECT l_orderkey AS id,
    sum(l_quantity) - 20 AS actual_kwh FROM lineitem WHERE l_linenumber = 3 GROUP BY 1) a ON p.id = a.id""",
)
def fill_actuals(spark, sf):
    seen = b.table(spark, sf, "lineitem").where("l_linenumber = 3").groupBy(F.col("l_orderkey").alias("id")).agg(
        (F.sum("l_quantity") - 20).alias("observed")
    )
    out = jn.attach_actuals(b.predictions(spark, sf), seen, ["id"], "observed", "actual_kwh")
    return out.select("id", "meter_id", "predicted_kwh", "actual_kwh")


@query(
    "fill_actuals_all_lines",
    """SELECT p.id, p.meter_id, p.predicted_kwh, a.actual_kwh FROM predictions p LEFT JOIN (SELECT l_orderkey AS id,
    sum(l_quantity) - 20 AS actual_kwh FROM lineitem GROUP BY 1) a ON p.id = a.id""",
)
def fill_actuals_all_lines(spark, sf):
    seen = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.sum("l_quantity") - 20).alias("observed"))
    out = jn.attach_actuals(b.predictions(spark, sf), seen, ["id"], "observed", "actual_kwh")
    return out.select("id", "meter_id", "predicted_kwh", "actual_kwh")


@query(
    "union_partials",
    """SELECT l_returnflag, sum(l_quantity) AS quantity, CAST(count(*) AS BIGINT) AS row_count FROM lineitem GROUP BY 1""",
)
def union_partials(spark, sf):
    df = b.table(spark, sf, "lineitem")
    parts = [
        df.where(F.col("l_linestatus") == s).groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("row_count"))
        for s in ("O", "F")
    ]
    return pf.union_partials(parts, ["l_returnflag"], ["quantity", "row_count"])


@query("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, sf):
    a = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return qa.difference(a, b.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query(
    "multiset_equal",
    """SELECT coalesce(x.l_orderkey, y.l_orderkey) AS l_orderkey, coalesce(x.k, y.k) AS k, coalesce(n, 0) AS copies_before,
    coalesce(m, 0) AS copies_after FROM (SELECT l_orderkey, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1, 2) x FULL JOIN
    (SELECT l_orderkey, CASE WHEN l_orderkey % 100 = 5 THEN 9 ELSE l_linenumber END AS k, count(*) AS m FROM lineitem GROUP BY 1, 2) y
    ON x.l_orderkey = y.l_orderkey AND x.k = y.k WHERE coalesce(n, 0) <> coalesce(m, 0)""",
)
def multiset_equal(spark, sf):
    df = b.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    before = df.select("l_orderkey", F.col("l_linenumber").alias("k"))
    after = df.select("l_orderkey", F.when(F.col("l_orderkey") % 100 == 5, 9).otherwise(F.col("l_linenumber")).alias("k"))
    return qa.multiset_diff(before, after)


@query(
    "report_filter",
    """SELECT id, meter_id, predicted_at, predicted_kwh FROM predictions WHERE predicted_at >= TIMESTAMP '1997-03-01'
    AND predicted_at <= TIMESTAMP '1999-06-30 23:59:59' AND meter_id = 42""",
)
def report_filter(spark, sf):
    return hs.report_filter(b.predictions(spark, sf), "predicted_at", "1997-03-01", "1999-06-30", "meter_id", 42)


@query(
    "valid_history",
    """SELECT meter_id, timestamp, consumption_kwh FROM (SELECT * FROM history WHERE is_valid ORDER BY meter_id, timestamp LIMIT 500)""",
)
def valid_history(spark, sf):
    df = hs.valid_history(b.history(spark, sf), "meter_id", "timestamp", "is_valid", limit=500)
    return df.select("meter_id", "timestamp", "consumption_kwh")


@query(
    "energy_summary",
    """SELECT count(*) AS row_count, round(coalesce(sum(consumption_kwh), 0), 4) AS total,
    round(coalesce(avg(consumption_kwh), 0), 6) AS average FROM history""",
)
def energy_summary(spark, sf):
    return rounded(rounded(hs.energy_summary(b.history(spark, sf), "consumption_kwh"), 4, "total"), 6, "average")


@query(
    "prediction_summary",
    """SELECT count(*) AS row_count, round(sum(predicted_kwh), 2) AS total, round(avg(predicted_kwh), 4) AS average,
    round(coalesce(sum(predicted_kwh) FILTER (WHERE CAST(predicted_at AS DATE) = DATE '1998-10-03'), 0), 2) AS today_total
    FROM predictions""",
)
def prediction_summary(spark, sf):
    df = hs.prediction_summary(b.predictions(spark, sf), "predicted_at", "predicted_kwh", "1998-10-03")
    return rounded(rounded(df, 2, "total", "today_total"), 4, "average")


@query("latest_records", "SELECT * FROM history ORDER BY timestamp DESC, event_id DESC LIMIT 100")
def latest_records(spark, sf):
    return hs.latest(b.history(spark, sf), "timestamp", 100, "event_id")


@query("latest_predictions", "SELECT * FROM predictions ORDER BY predicted_at DESC, id DESC LIMIT 100")
def latest_predictions(spark, sf):
    return hs.latest(b.predictions(spark, sf), "predicted_at", 100, "id")


@query("paged_rows", "SELECT * FROM predictions ORDER BY predicted_at DESC, id DESC LIMIT 8 OFFSET 16")
def paged_rows(spark, sf):
    return hs.page(b.predictions(spark, sf), [F.col("predicted_at").desc(), F.col("id").desc()], 3)


@query(
    "top_buildings",
    """SELECT building_id, round(avg(meter_reading), 6) AS mean FROM readings GROUP BY 1 ORDER BY avg(meter_reading) DESC, 1 LIMIT 20""",
)
def top_buildings(spark, sf):
    usage = pf.usage_by(b.readings(spark, sf), "building_id", "meter_reading").select("building_id", "mean")
    return rounded(hs.top_k(usage, [F.col("mean").desc(), F.col("building_id")], 20), 6, "mean")


@query("recent_trend", "SELECT * FROM predictions ORDER BY predicted_at DESC, id DESC LIMIT 12")
def recent_trend(spark, sf):
    return hs.recent_trend(b.predictions(spark, sf), "predicted_at", "id")


@query(
    "recent_trend_oldest",
    """SELECT * FROM (SELECT * FROM predictions ORDER BY predicted_at DESC, id DESC LIMIT 100) ORDER BY predicted_at, id LIMIT 12""",
)
def recent_trend_oldest(spark, sf):
    return hs.recent_trend(b.predictions(spark, sf), "predicted_at", "id", oldest=True)


_NEWEST = """SELECT meter_id, timestamp, consumption_kwh, event_id, row_number() OVER (PARTITION BY meter_id ORDER BY timestamp DESC) AS r
  FROM history WHERE is_valid"""


def _valid(spark, sf):
    return hs.valid_history(b.history(spark, sf), "meter_id", "timestamp", "is_valid").drop("is_valid")


@query(
    "latest_per_meter",
    f"""SELECT meter_id, timestamp, consumption_kwh, event_id, row_number() OVER (PARTITION BY meter_id ORDER BY timestamp) AS place
    FROM ({_NEWEST}) WHERE r <= 12""",
)
def latest_per_meter(spark, sf):
    return wn.latest_per_key(_valid(spark, sf), "meter_id", "timestamp", 12).withColumn("place", F.col("place").cast("long"))


_STEPS = f"""SELECT meter_id, timestamp, r, consumption_kwh AS v, consumption_kwh - lag(consumption_kwh) OVER o AS step,
  (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER o)) / 1000000.0 AS gap FROM ({_NEWEST}) WHERE r <= 500
  WINDOW o AS (PARTITION BY meter_id ORDER BY timestamp)"""
_CHANGE = f"""SELECT meter_id, avg(step) FILTER (WHERE r <= 3) AS change, median(gap) FILTER (WHERE r <= 3) AS gap,
  max(v) FILTER (WHERE r = 1) AS last_value, max(timestamp) AS last_time, count(*) AS n, median(v) AS baseline,
  list(v ORDER BY v) AS vs FROM ({_STEPS}) GROUP BY 1"""


@query(
    "recent_change",
    f"""SELECT meter_id, round(change, 6) AS average_change, round(gap, 7) AS interval_seconds, last_value, last_time FROM ({_CHANGE})""",
)
def recent_change(spark, sf):
    history = wn.latest_per_key(_valid(spark, sf), "meter_id", "timestamp", 500)
    df = wn.recent_change(history, "meter_id", "timestamp", "consumption_kwh")
    return rounded(rounded(df, 6, "average_change"), 7, "interval_seconds")


@query(
    "history_quality",
    f"""SELECT meter_id, n AS history_records, CAST(0 AS BIGINT) AS bad_values, CAST(0 AS BIGINT) AS bad_times,
    CASE WHEN n < 3 THEN 'too_few' ELSE 'ok' END AS status FROM ({_CHANGE})""",
)
def history_quality(spark, sf):
    history = wn.latest_per_key(_valid(spark, sf), "meter_id", "timestamp", 500)
    return wn.history_quality(history, "meter_id", "timestamp", "consumption_kwh")


@query(
    "history_quality_defects",
    """WITH h AS (SELECT meter_id, event_id, CASE WHEN event_id % 11 = 0 THEN -1 ELSE consumption_kwh END AS v,
      CASE WHEN event_id % 13 = 0 THEN date_trunc('day', timestamp) ELSE timestamp END AS t FROM history),
    c AS (SELECT meter_id, count(*) AS history_records, count(*) FILTER (WHERE v < 0) AS bad_values,
      count(*) FILTER (WHERE p >= t) AS bad_times FROM (SELECT *, lag(t) OVER (PARTITION BY meter_id ORDER BY t) AS p FROM h) GROUP BY 1)
    SELECT *, CASE WHEN history_records < 3 THEN 'too_few' WHEN bad_values > 0 THEN 'bad_value' WHEN bad_times > 0 THEN 'bad_time'
    ELSE 'ok' END AS status FROM c""",
)
def history_quality_defects(spark, sf):
    df = b.history(spark, sf)
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz")
    bad = df.select(
        "meter_id",
        "event_id",
        F.when(F.col("event_id") % 11 == 0, -1.0).otherwise(F.col("consumption_kwh")).alias("v"),
        F.when(F.col("event_id") % 13 == 0, day).otherwise(F.col("timestamp")).alias("t"),
    )
    history = wn.latest_per_key(bad, "meter_id", "t", 500, "event_id")
    return wn.history_quality(history, "meter_id", "t", "v")


_MAD = """WITH c AS (SELECT meter_id, median(consumption_kwh) AS center FROM {src} GROUP BY 1),
  s AS (SELECT h.meter_id, 1.4826 * median(abs(consumption_kwh - center)) AS scale FROM {src} h JOIN c ON h.meter_id = c.meter_id GROUP BY 1),
  found AS (SELECT h.meter_id, h.timestamp, CASE WHEN consumption_kwh > center THEN 'spike' ELSE 'drop' END AS anomaly_type,
  CASE WHEN abs(consumption_kwh - center) / scale >= 3.5 * 1.5 THEN 'high' ELSE 'medium' END AS severity,
  consumption_kwh AS actual_kwh, center AS expected_kwh,
  CASE WHEN center = 0 THEN 0 ELSE (consumption_kwh - center) / abs(center) * 100 END AS deviation_pct,
  abs(consumption_kwh - center) / scale AS score FROM {src} h JOIN c ON h.meter_id = c.meter_id JOIN s ON h.meter_id = s.meter_id
  WHERE scale > 0 AND abs(consumption_kwh - center) / scale >= 3.5)"""
_VALID_SQL = "(SELECT * FROM history WHERE is_valid)"


@query(
    "mad_anomalies",
    _MAD.format(src=_VALID_SQL)
    + """ SELECT meter_id, timestamp, anomaly_type, severity, actual_kwh, round(expected_kwh, 6) AS expected_kwh,
    round(deviation_pct, 4) AS deviation_pct, round(score, 5) AS score FROM found""",
)
def mad_anomaly_query(spark, sf):
    df = mad_anomalies(_valid(spark, sf), "meter_id", "timestamp", "consumption_kwh").drop("description")
    return rounded(rounded(rounded(df, 6, "expected_kwh"), 4, "deviation_pct"), 5, "score")


def _stored_and_history(spark, sf):
    """The even events' anomalies are stored already, then the whole history is examined."""
    df = _valid(spark, sf)
    half = df.where("event_id % 2 = 0").select("meter_id", "timestamp", "consumption_kwh")
    stored = mad_anomalies(half, "meter_id", "timestamp", "consumption_kwh").drop("score")
    return df.select("meter_id", "timestamp", "consumption_kwh"), stored


_HALF_SQL = "(SELECT * FROM history WHERE is_valid AND event_id % 2 = 0)"


def _detect_sql(tail: str) -> str:
    old = _MAD.format(src=_HALF_SQL).replace("WITH c AS", "WITH c0 AS").replace("JOIN c ON", "JOIN c0 c ON").replace(" s AS (", " s0 AS (")
    old = old.replace("JOIN s ON", "JOIN s0 s ON").replace("found AS (", "stored AS (")
    new = _MAD.format(src=_VALID_SQL)[5:]
    return f"{old}, {new}, fresh AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM stored o WHERE o.meter_id = f.meter_id AND o.timestamp = f.timestamp)) {tail}"


@query(
    "detect_and_store",
    _detect_sql(
        """SELECT meter_id, timestamp, anomaly_type, severity, actual_kwh, round(expected_kwh, 6) AS expected_kwh,
        round(deviation_pct, 4) AS deviation_pct FROM (SELECT * FROM stored UNION ALL SELECT * FROM fresh)"""
    ),
)
def detect_and_store_query(spark, sf):
    history, stored = _stored_and_history(spark, sf)
    after, _ = detect_and_store(history, stored, "meter_id", "timestamp", "consumption_kwh")
    return rounded(rounded(after.drop("description"), 6, "expected_kwh"), 4, "deviation_pct")


@query(
    "detect_and_store_counts",
    _detect_sql(
        f"""SELECT 'examined' AS measure, count(*) AS n FROM {_VALID_SQL} UNION ALL SELECT 'detected', count(*) FROM found
        UNION ALL SELECT 'added', count(*) FROM fresh"""
    ),
)
def detect_and_store_counts(spark, sf):
    history, stored = _stored_and_history(spark, sf)
    return detect_and_store(history, stored, "meter_id", "timestamp", "consumption_kwh")[1]


@query(
    "peak_outlook",
    f"""SELECT meter_id, CASE WHEN n < 3 THEN 'too_few' ELSE 'ok' END AS status, n AS history_records,
    round(CASE WHEN n >= 3 THEN f END, 6) AS forecast_kwh,
    CASE WHEN n >= 3 THEN date_trunc('second', last_time + to_microseconds(CAST(round(gap * step * 1000000) AS BIGINT))) END AS peak_timestamp,
    CASE WHEN n >= 3 THEN th END AS peak_threshold_kwh, CASE WHEN n >= 3 THEN f >= th END AS is_peak_likely,
    round(CASE WHEN n >= 3 THEN baseline END, 6) AS baseline_kwh, 6 AS horizon_records
    FROM (SELECT *, greatest(0, last_value + change * step) AS f, vs[least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) + 1] AS th
    FROM (SELECT *, CASE WHEN change > 0 THEN 6 ELSE 1 END AS step FROM ({_CHANGE})))""",
)
def peak_outlook_query(spark, sf):
    df = peak_outlook(_valid(spark, sf), "meter_id", "timestamp", "consumption_kwh", 6)
    df = df.withColumn("peak_timestamp", F.date_trunc("second", "peak_timestamp").cast("timestamp_ntz"))
    return rounded(df, 6, "forecast_kwh", "baseline_kwh")


@query(
    "outlook_series",
    f"""SELECT meter_id, step, date_trunc('second', last_time + to_microseconds(CAST(round(gap * step * 1000000) AS BIGINT))) AS target_time,
    round(greatest(0, last_value + change * step), 6) AS forecast_kwh
    FROM (SELECT *, unnest(range(1, 7)) AS step FROM ({_CHANGE}) WHERE n >= 3)""",
)
def outlook_series(spark, sf):
    df = forecast_steps(_valid(spark, sf), "meter_id", "timestamp", "consumption_kwh", 6)
    return floats(df.withColumn("target_time", F.date_trunc("second", "target_time").cast("timestamp_ntz")), 6)
