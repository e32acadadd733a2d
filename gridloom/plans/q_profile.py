"""Profile and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import profile as pf
from gridloom.operators import quality as qa
from gridloom.plans import bindings as b
from gridloom.plans.registry import query


def rounded(df, digits: int, *columns):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _union(columns, template):
    return " UNION ALL ".join(template.format(i=i, c=c) for i, c in enumerate(columns))


_READ_COLS = [
    ("event_id", "bigint"),
    ("ts_hour", "timestamp_ntz"),
    ("building_id", "bigint"),
    ("meter", "int"),
    ("timestamp", "timestamp_ntz"),
    ("meter_reading", "double"),
    ("site_id", "int"),
    ("primary_use", "string"),
    ("square_feet", "bigint"),
    ("year_built", "double"),
    ("floor_count", "double"),
    *[(c, "double") for c in b.WEATHER],
]


@query(
    "null_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS missing,
        round(100.0 * (count(*) - count({c})) / count(*), 4) AS missing_pct,
        count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS distinct_values FROM enriched"""
        for c, t in _READ_COLS
    ),
)
def null_profile(spark, sf):
    return pf.null_profile(b.enriched(spark, sf))


@query(
    "duplicate_keys",
    """SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def duplicate_keys(spark, sf):
    return qa.duplicate_count(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_rows",
    """SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus)""",
)
def duplicate_rows(spark, sf):
    df = b.table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus")
    return qa.duplicate_count(df, df.columns)


@query(
    "duplicate_rows_all_columns",
    """SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows
    FROM lineitem""",
)
def duplicate_rows_all_columns(spark, sf):
    df = b.table(spark, sf, "lineitem")
    return qa.duplicate_count(df, df.columns)


@query(
    "duplicate_key_exists",
    """SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2
    HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 1""",
)
def duplicate_key_exists(spark, sf):
    return qa.first_duplicate(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_STATS = ["meter_reading", "square_feet", "year_built", *b.WEATHER]


@query(
    "numeric_stats",
    _union(
        _STATS,
        """SELECT '{c}' AS column_name, count({c}) AS filled, round(avg({c}), 6) AS mean,
        round(stddev_pop({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS minimum, CAST(max({c}) AS DOUBLE) AS maximum
        FROM enriched""",
    ),
)
def numeric_stats(spark, sf):
    return rounded(pf.numeric_stats(b.enriched(spark, sf), _STATS), 6, "mean", "std")


@query(
    "describe_percentiles",
    """SELECT count(meter_reading) AS filled, round(avg(meter_reading), 6) AS mean,
    round(stddev_samp(meter_reading), 6) AS std, min(meter_reading) AS minimum, max(meter_reading) AS maximum, """
    + ", ".join(f"round(quantile_cont(meter_reading, {p}), 6) AS {n}" for n, p in pf.DESCRIBE_POINTS.items())
    + " FROM readings",
)
def describe_percentiles(spark, sf):
    df = pf.describe_pct(b.readings(spark, sf), "meter_reading")
    return rounded(df, 6, "mean", "std", *pf.DESCRIBE_POINTS)


@query(
    "target_summary",
    """SELECT round(avg(meter_reading), 6) AS mean, round(stddev_pop(meter_reading), 6) AS std,
    min(meter_reading) AS minimum, max(meter_reading) AS maximum,
    count(*) FILTER (WHERE meter_reading = 0) AS zero_count,
    round(100.0 * count(*) FILTER (WHERE meter_reading = 0) / count(*), 4) AS zero_pct,
    round(skewness(meter_reading), 6) AS skewness, round(median(meter_reading), 6) AS median,
    round(quantile_cont(meter_reading, 0.99), 6) AS p99 FROM readings""",
)
def target_summary(spark, sf):
    df = pf.target_summary(b.readings(spark, sf), "meter_reading")
    return rounded(df, 6, "mean", "std", "skewness", "median", "p99")


@query(
    "entity_counts",
    _union(
        ["building_id", "site_id"],
        "SELECT '{c}' AS entity, count(DISTINCT {c}) AS distinct_values FROM enriched",
    ),
)
def entity_counts(spark, sf):
    return pf.entity_counts(b.enriched(spark, sf), ["building_id", "site_id"])


@query("value_counts", "SELECT primary_use, count(*) AS row_count FROM enriched GROUP BY 1")
def value_counts(spark, sf):
    return pf.value_counts(b.enriched(spark, sf), "primary_use")


@query("value_counts_meter", "SELECT meter, count(*) AS row_count FROM readings GROUP BY 1")
def value_counts_meter(spark, sf):
    return pf.value_counts(b.readings(spark, sf), "meter")


_CONST = """SELECT column_name FROM ({}) WHERE n <= 1"""


@query(
    "constant_columns",
    _CONST.format(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS column_name, count(DISTINCT {e}) + CASE WHEN count(*) > count({e}) THEN 1 ELSE 0 END AS n
            FROM events"""
            for n, e in [
                ("event_id", "event_id"),
                ("value", "value"),
                ("year", "year(ts)"),
                ("blank", "CAST(nullif(value, value) AS VARCHAR)"),
                ("half", "CASE WHEN event_id % 2 = 0 THEN 1 END"),
            ]
        )
    ),
)
def constant_columns(spark, sf):
    df = b.table(spark, sf, "events").select(
        "event_id",
        "value",
        F.year("ts").alias("year"),
        F.lit(None).cast("string").alias("blank"),
        F.when(F.col("event_id") % 2 == 0, 1).alias("half"),
    )
    return pf.constant_columns(df)


def _usage(by, source, alias=None):
    return f"""SELECT {by} AS {alias or by}, round(sum(meter_reading), 4) AS total, count(meter_reading) AS row_count,
    round(avg(meter_reading), 6) AS mean FROM {source} GROUP BY 1"""


def _round_usage(df):
    return rounded(rounded(df, 4, "total"), 6, "mean")


@query("hourly_profile", _usage("CAST(hour(ts) AS INTEGER)", "readings", "period"))
def hourly_profile(spark, sf):
    return _round_usage(pf.time_profile(b.readings(spark, sf), "ts", "meter_reading", "hour"))


@query("daily_profile", _usage("date_trunc('day', ts)", "readings", "period").replace("date_trunc('day', ts)", "CAST(date_trunc('day', ts) AS TIMESTAMP)"))
def daily_profile(spark, sf):
    return _round_usage(pf.time_profile(b.readings(spark, sf), "ts", "meter_reading", "day"))


@query(
    "daily_profile_filled",
    """WITH sparse AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS period, sum(o_totalprice) AS total,
      count(o_totalprice) AS row_count, avg(o_totalprice) AS mean FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 50 = 7
      GROUP BY 1),
    day_list AS (SELECT unnest(generate_series((SELECT min(period) FROM sparse), (SELECT max(period) FROM sparse), INTERVAL 1 DAY)) AS period)
    SELECT s.period, round(total, 4) AS total, coalesce(row_count, 0) AS row_count, round(mean, 6) AS mean
    FROM day_list s LEFT JOIN sparse p ON s.period = p.period""",
)
def daily_profile_filled(spark, sf):
    """Sparse series on purpose (one priority, a few customers) so that days are missing."""
    df = b.table(spark, sf, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 50 == 7))
    return _round_usage(pf.time_profile(df, "o_orderdate", "o_totalprice", "day", fill=True))


@query(
    "daily_profile_filled_by_site",
    """WITH sparse AS (SELECT c_nationkey AS site, o_orderpriority AS priority, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS period,
      sum(o_totalprice) AS total, count(o_totalprice) AS row_count, avg(o_totalprice) AS mean
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
    day_list AS (SELECT site, priority, unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS period FROM sparse GROUP BY 1, 2)
    SELECT s.site, s.priority, s.period, round(total, 4) AS total, coalesce(row_count, 0) AS row_count, round(mean, 6) AS mean
    FROM day_list s LEFT JOIN sparse p ON s.period = p.period AND s.site IS NOT DISTINCT FROM p.site
      AND s.priority IS NOT DISTINCT FROM p.priority""",
)
def daily_profile_filled_by_site(spark, sf):
    """All orders by the customer's nation and priority; days are missing by themselves in small tables."""
    sites = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("site"))
    df = b.table(spark, sf, "orders").join(sites, "o_custkey", "left").withColumnRenamed("o_orderpriority", "priority")
    return _round_usage(pf.time_profile(df, "o_orderdate", "o_totalprice", "day", fill=True, by=["site", "priority"]))


@query(
    "monthly_profile",
    """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, round(sum(o_totalprice), 4) AS total,
    count(o_totalprice) AS row_count, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1""",
)
def monthly_profile(spark, sf):
    return _round_usage(pf.time_profile(b.table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month"))


@query("usage_by_meter", _usage("meter", "readings"))
def usage_by_meter(spark, sf):
    return _round_usage(pf.usage_by(b.readings(spark, sf), "meter", "meter_reading"))


@query("usage_by_building", _usage("building_id", "readings"))
def usage_by_building(spark, sf):
    return _round_usage(pf.usage_by(b.readings(spark, sf), "building_id", "meter_reading"))


@query("usage_by_site", _usage("site_id", "enriched"))
def usage_by_site(spark, sf):
    return _round_usage(pf.usage_by(b.enriched(spark, sf), "site_id", "meter_reading"))


@query("median_by_use", "SELECT primary_use, round(median(meter_reading), 6) AS median FROM enriched GROUP BY 1")
def median_by_use(spark, sf):
    return rounded(pf.median_by(b.enriched(spark, sf), "primary_use", "meter_reading"), 6, "median")


@query("median_by_meter", "SELECT meter, round(median(meter_reading), 6) AS median FROM readings GROUP BY 1")
def median_by_meter(spark, sf):
    return rounded(pf.median_by(b.readings(spark, sf), "meter", "meter_reading"), 6, "median")


_CORR = ["meter_reading", "square_feet", "air_temperature", "dew_temperature"]


def _spearman_sql():
    parts = []
    for i, a in enumerate(_CORR):
        for c in _CORR[i + 1 :]:
            parts.append(
                f"""SELECT '{a}' AS first_column, '{c}' AS second_column, count(*) AS row_count, round(corr(rx, ry), 6) AS spearman
                FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
                FROM (SELECT {a} AS x, {c} AS y FROM enriched WHERE {a} IS NOT NULL AND {c} IS NOT NULL))"""
            )
    return " UNION ALL ".join(parts)


@query("spearman_matrix", _spearman_sql())
def spearman_matrix(spark, sf):
    return rounded(pf.spearman(b.enriched(spark, sf), _CORR), 6, "spearman")


@query(
    "skewness_profile",
    _union(_STATS, "SELECT '{c}' AS column_name, round(skewness({c}), 6) AS skewness FROM enriched"),
)
def skewness_profile(spark, sf):
    return rounded(pf.skewness_profile(b.enriched(spark, sf), _STATS), 6, "skewness")


def _hist_sql(value, source, bins):
    return f"""WITH v AS (SELECT {value} AS v FROM {source} WHERE {value} IS NOT NULL),
    e AS (SELECT min(v) AS a, max(v) - min(v) AS w FROM v)
    SELECT i.bin, round(a + i.bin * (w / {bins}), 6) AS bin_start, coalesce(row_count, 0) AS row_count
    FROM (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin) i CROSS JOIN e LEFT JOIN (
    SELECT CAST(least(floor((v - (SELECT a FROM e)) / (SELECT w FROM e) * {bins}), {bins - 1}) AS INTEGER) AS bin,
    count(*) AS row_count FROM v GROUP BY 1) c ON i.bin = c.bin"""


@query("histogram", _hist_sql("ln(1 + meter_reading)", "readings", 80))
def histogram(spark, sf):
    return rounded(pf.histogram(b.readings(spark, sf), F.log(1 + F.col("meter_reading")), 80), 6, "bin_start")


@query("histogram_area", _hist_sql("CAST(square_feet AS DOUBLE)", "buildings", 50))
def histogram_area(spark, sf):
    return rounded(pf.histogram(b.buildings(spark, sf), F.col("square_feet"), 50), 6, "bin_start")


@query("histogram_weather", _hist_sql("air_temperature", "weather", 35))
def histogram_weather(spark, sf):
    return rounded(pf.histogram(b.weather(spark, sf), F.col("air_temperature"), 35), 6, "bin_start")


@query(
    "box_summary",
    """WITH v AS (SELECT meter, ln(1 + meter_reading) AS v FROM readings),
    q AS (SELECT meter, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1)
    SELECT v.meter, round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3,
    round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)), 6) AS low_whisker,
    round(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)), 6) AS high_whisker
    FROM v JOIN q ON v.meter = q.meter GROUP BY 1""",
)
def box_summary(spark, sf):
    df = pf.box_summary(b.readings(spark, sf), "meter", F.log1p("meter_reading"))
    return rounded(df, 6, "q1", "median", "q3", "low_whisker", "high_whisker")


@query(
    "time_coverage",
    """SELECT min(ts) AS first_time, max(ts) AS last_time,
    CAST(floor((epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) / 3600) + 1 AS BIGINT) AS expected_hours,
    count(DISTINCT date_trunc('hour', ts)) AS observed_hours, count(*) - count(ts) AS null_timestamps FROM readings""",
)
def time_coverage(spark, sf):
    return pf.time_coverage(b.readings(spark, sf), "ts", "ts_hour")


@query(
    "category_cardinality",
    _union(
        ["primary_use", "meter"],
        "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM enriched",
    ),
)
def category_cardinality(spark, sf):
    return pf.category_cardinality(b.enriched(spark, sf), ["primary_use", "meter"])


def _overview_sql():
    shapes = {"customer": 5, "orders": 6, "lineitem": 11, "events": 6}
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, count(*) AS row_count, {c} AS column_count,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_rows FROM {t}"""
        for t, c in shapes.items()
    )


@query("dataset_overview", _overview_sql())
def dataset_overview(spark, sf):
    return pf.overview({t: b.table(spark, sf, t) for t in ("customer", "orders", "lineitem", "events")})


@query(
    "invalid_building_counts",
    """SELECT count(*) FILTER (WHERE square_feet IS NULL OR square_feet <= 0) AS invalid_area_rows,
    count(*) FILTER (WHERE year_built IS NULL OR year_built < 1800 OR year_built > year(timestamp)) AS invalid_year_rows,
    count(*) FILTER (WHERE floor_count IS NULL OR floor_count <= 0) AS invalid_floor_rows FROM enriched""",
)
def invalid_building_counts(spark, sf):
    return qa.invalid_building_counts(b.enriched(spark, sf))


@query(
    "nan_inf_counts",
    _union(
        _STATS,
        """SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL OR isnan(CAST({c} AS DOUBLE))) AS missing,
        count(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE))) AS infinite FROM enriched""",
    ),
)
def nan_inf_counts(spark, sf):
    return pf.nan_inf_counts(b.enriched(spark, sf), _STATS)


@query(
    "weather_conflicts",
    """SELECT count(*) FILTER (WHERE a > 1) AS l_quantity, count(*) FILTER (WHERE t > 1) AS l_tax FROM (
    SELECT count(DISTINCT l_quantity) AS a, count(DISTINCT l_tax) AS t FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def weather_conflicts(spark, sf):
    return qa.conflicts(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@query(
    "weather_conflicts_tolerant",
    """SELECT count(*) FILTER (WHERE hi - lo > 0.01 + 0.05 * greatest(abs(lo), abs(hi))) AS l_quantity FROM (
    SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def weather_conflicts_tolerant(spark, sf):
    return qa.conflicts(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity"], 0.05, 0.01)


@query(
    "first_non_null",
    """SELECT site_id, CAST(date_trunc('day', ts_hour) AS TIMESTAMP) AS day,
    first(air_temperature ORDER BY ts_hour) FILTER (WHERE air_temperature IS NOT NULL) AS air_temperature,
    first(dew_temperature ORDER BY ts_hour) FILTER (WHERE dew_temperature IS NOT NULL) AS dew_temperature
    FROM weather GROUP BY 1, 2""",
)
def first_non_null(spark, sf):
    df = b.weather(spark, sf).withColumn("day", F.date_trunc("day", "ts_hour").cast("timestamp_ntz"))
    return qa.first_non_null(df, ["site_id", "day"], ["air_temperature", "dew_temperature"], F.col("ts_hour"))


@query("filter_meter", "SELECT event_id, building_id, meter, meter_reading FROM readings WHERE meter = 0")
def filter_meter(spark, sf):
    return qa.filter_meter(b.readings(spark, sf), 0).select("event_id", "building_id", "meter", "meter_reading")


@query(
    "reject_negative_keep_zero",
    """SELECT count(*) AS source_rows, count(*) FILTER (WHERE c_nationkey <> 3) AS selected_rows,
    count(*) FILTER (WHERE c_nationkey <> 3 AND c_acctbal < 0) AS rejected_rows,
    count(*) FILTER (WHERE c_nationkey <> 3 AND c_acctbal = 0) AS zero_rows,
    count(*) FILTER (WHERE c_nationkey <> 3 AND c_acctbal >= 0) AS output_rows, true AS balanced FROM customer""",
)
def reject_negative_keep_zero(spark, sf):
    return qa.accounting(b.table(spark, sf, "customer"), "c_acctbal", F.col("c_nationkey") != 3)


@query("clean_readings", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
def clean_readings(spark, sf):
    return qa.clean_readings(b.table(spark, sf, "customer", "c_custkey", "c_acctbal"), "c_acctbal")


@query(
    "validate_observations",
    """SELECT count(*) FILTER (WHERE meter <> 0) AS bad_meter_rows,
    count(*) FILTER (WHERE meter_reading < 0 OR meter_reading IS NULL) AS bad_target_rows,
    count(*) FILTER (WHERE timestamp IS NULL) AS bad_timestamp_rows,
    (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT CAST(meter AS VARCHAR) AS m FROM readings WHERE meter <> 0)) AS bad_meters
    FROM enriched""",
)
def validate_observations(spark, sf):
    return qa.validate_observations(b.enriched(spark, sf), "meter", "meter_reading", "timestamp")


@query(
    "impossible_value_counts",
    """SELECT count(*) FILTER (WHERE meter_reading < 0) AS negative_meter_reading,
    count(*) FILTER (WHERE square_feet <= 0) AS nonpositive_square_feet,
    count(*) FILTER (WHERE building_id < 0) AS negative_building_id, count(*) FILTER (WHERE site_id < 0) AS negative_site_id,
    count(*) FILTER (WHERE meter NOT IN (0, 1, 2, 3)) AS invalid_meter_code,
    count(*) FILTER (WHERE timestamp IS NULL) AS invalid_timestamp,
    count(*) FILTER (WHERE air_temperature IS NULL OR air_temperature < -100 OR air_temperature > 70) AS air_temperature_outside_range,
    count(*) FILTER (WHERE wind_speed < 0) AS negative_wind_speed,
    count(*) FILTER (WHERE wind_direction IS NULL OR wind_direction < 0 OR wind_direction > 360) AS wind_direction_outside_circle
    FROM enriched""",
)
def impossible_value_counts(spark, sf):
    return qa.impossible_counts(b.enriched(spark, sf))


@query(
    "downcast_types",
    """SELECT CAST(event_id AS INTEGER) AS event_id, CAST(user_id AS INTEGER) AS user_id,
    round(CAST(value AS FLOAT), 3) AS value FROM events""",
)
def downcast_types(spark, sf):
    df = qa.downcast(b.table(spark, sf, "events", "event_id", "user_id", "value"))
    return df.select(F.col("event_id").cast("int"), F.col("user_id").cast("int"), F.round("value", 3).alias("value"))


@query(
    "row_limited_scan",
    "SELECT event_id, ts, user_id, value FROM events ORDER BY ts, event_id LIMIT 300",
)
def row_limited_scan(spark, sf):
    from gridloom.sources.readers import limit_rows

    return limit_rows(b.table(spark, sf, "events", "event_id", "ts", "user_id", "value"), 300, ["ts", "event_id"])


@query("read_parquet_projected", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def read_parquet_projected(spark, sf):
    return b.table(spark, sf, "lineitem", "l_orderkey", "l_extendedprice")
