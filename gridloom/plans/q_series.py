"""Series analytics over the feed of documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gridloom.operators import outlook as ol
from gridloom.operators import series as sr
from gridloom.plans import bindings as b
from gridloom.plans.registry import query

BAND = 500


@query(
    "flat_runs",
    f"""WITH f AS (SELECT meter_id, ts, CAST(floor(value / {BAND}) AS BIGINT) AS band FROM feeds WHERE value IS NOT NULL),
    m AS (SELECT *, CASE WHEN band = lag(band) OVER past THEN 0 ELSE 1 END AS fresh FROM f WINDOW past AS (PARTITION BY meter_id ORDER BY ts, band)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY meter_id ORDER BY ts, band ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT meter_id, CAST(min(band) AS BIGINT) AS band, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS readings FROM g GROUP BY meter_id, run HAVING count(*) >= 3""",
)
def flat_runs(spark, sf):
    """Stretches of three or more readings in one band of values, cut by days."""
    feed = b.feeds(spark, sf).where("value IS NOT NULL").withColumn("band", F.floor(F.col("value") / BAND))
    return sr.flat_runs(feed, "meter_id", "ts", "band", 3, "day")


@query(
    "level_breaks",
    f"""WITH f AS (SELECT meter_id, ts, value, count(*) OVER (PARTITION BY meter_id) AS n, sum(value) OVER (PARTITION BY meter_id) AS s,
      stddev_pop(value) OVER (PARTITION BY meter_id) AS sd, row_number() OVER past - 1 AS pos, sum(value) OVER past - value AS upto FROM feeds WHERE value IS NOT NULL
      WINDOW past AS (PARTITION BY meter_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, abs(upto - pos * (s / n)) AS far FROM f),
    t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY far DESC, pos) = 1)
    SELECT meter_id, n AS readings, CASE WHEN sd > 0 THEN ts END AS break_at, CASE WHEN sd > 0 THEN round(upto / pos + 1e-7, 4) END AS before,
      CASE WHEN sd > 0 THEN round((s - upto) / (n - pos) + 1e-7, 4) END AS after, CASE WHEN sd > 0 THEN round(far / (sd * sqrt(n)), 6) ELSE 0 END AS statistic,
      CASE WHEN sd > 0 THEN far / (sd * sqrt(n)) > {sr.BREAK_95} ELSE false END AS broken FROM t""",
)
def level_breaks(spark, sf):
    """The likeliest change of level of every meter, cut by days."""
    found = sr.level_breaks(b.feeds(spark, sf), "meter_id", "ts", "value", "day")
    return found.withColumns({"before": F.round(F.col("before") + 1e-7, 4), "after": F.round(F.col("after") + 1e-7, 4), "statistic": F.round("statistic", 6)})


_HOURLY = "SELECT site, date_trunc('hour', ts) AS hour, sum(value) AS value FROM feeds WHERE site IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2"


@query(
    "seasonal_decomposition",
    f"""WITH h AS ({_HOURLY}),
    w AS (SELECT *, CASE WHEN count(*) OVER wide = 7 THEN (sum(value) OVER wide + sum(value) OVER narrow) / 2 / 6 END AS trend, CAST(epoch(hour) // 3600 AS BIGINT) % 6 AS phase FROM h
      WINDOW wide AS (PARTITION BY site ORDER BY hour RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND INTERVAL 3 HOUR FOLLOWING),
      narrow AS (PARTITION BY site ORDER BY hour RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND INTERVAL 2 HOUR FOLLOWING)),
    p AS (SELECT site, phase, avg(value - trend) AS m FROM w WHERE trend IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT site, phase, m - avg(m) OVER (PARTITION BY site) AS seasonal FROM p)
    SELECT w.site, hour, value, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(value - trend - seasonal, 4) AS remainder
    FROM w LEFT JOIN s ON w.site = s.site AND w.phase = s.phase""",
)
def seasonal_decomposition(spark, sf):
    """Hourly sums per site by trend, place in a period of six hours and remainder, in blocks of two days."""
    parts = sr.decompose(sr.hourly_series(b.feeds(spark, sf), "site", "ts", "value"), "site", period=6, block_hours=48)
    return parts.withColumns({c: F.round(c, 4) for c in ("trend", "seasonal", "remainder")})


@query(
    "week_profile",
    """SELECT meter_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, round(avg(value) + 1e-7, 4) AS mean, count(*) AS row_count
    FROM feeds WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
)
def week_profile(spark, sf):
    return sr.week_profile(b.feeds(spark, sf), "meter_id", "ts", "value").withColumn("mean", F.round(F.col("mean") + 1e-7, 4))


@query(
    "meter_comparison",
    """WITH g AS (SELECT site, meter_id, date_trunc('day', ts) AS period, CAST(grouping_id(site, meter_id, date_trunc('day', ts)) AS BIGINT) AS level,
      sum(value) AS total, count(*) AS row_count FROM feeds WHERE value IS NOT NULL
      GROUP BY GROUPING SETS ((site, meter_id, period), (site, meter_id), (site, period), (site), (period), ())),
    a AS (SELECT period, total FROM g WHERE level >= 6)
    SELECT g.site, g.meter_id, CAST(g.period AS TIMESTAMP) AS period, level, g.total, row_count, round(g.total / row_count, 4) AS mean, round(g.total / a.total, 6) AS share
    FROM g JOIN a ON g.period IS NOT DISTINCT FROM a.period""",
)
def meter_comparison(spark, sf):
    """Totals per site, meter and day, per site and meter, per site, and over all, with their share of the day."""
    found = sr.period_totals(b.feeds(spark, sf), ["site", "meter_id"], "ts", "value", "day")
    return found.withColumns({"mean": F.round("mean", 4), "share": F.round("share", 6)})


@query(
    "feed_days_filled",
    """WITH d AS (SELECT meter_id, date_trunc('day', ts) AS period, sum(value) AS total, count(value) AS row_count FROM feeds WHERE meter_id IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT meter_id, unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS period FROM d GROUP BY 1)
    SELECT s.meter_id, CAST(s.period AS TIMESTAMP) AS period, coalesce(total, 0) AS total, coalesce(row_count, 0) AS row_count
    FROM s LEFT JOIN d ON s.meter_id = d.meter_id AND s.period = d.period""",
)
def feed_days_filled(spark, sf):
    """Daily sums of every meter from its first to its last day; days without readings count 0."""
    feed = b.feeds(spark, sf).where("meter_id IS NOT NULL")
    daily = feed.groupBy("meter_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("period")).agg(F.sum("value").alias("total"), F.count("value").alias("row_count"))
    spans = daily.groupBy("meter_id").agg(F.min("period").alias("a"), F.max("period").alias("z"))
    spine = spans.select("meter_id", F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 DAY"))).alias("period"))
    filled = spine.join(daily, ["meter_id", "period"], "left")
    return filled.select("meter_id", "period", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("row_count", F.lit(0)).alias("row_count"))


# every reading as an origin: its change, and the reading that came k steps later
_TRIED = """o AS (SELECT meter_id, ts, value, row_number() OVER past AS n, lag(value, 2) OVER past AS two, lag(value, 3) OVER past AS three,
      list(value) OVER (past ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS vs, list(ts) OVER (past ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS tt
      FROM feeds WHERE value >= 0 WINDOW past AS (PARTITION BY meter_id ORDER BY ts, value)),
    c AS (SELECT *, CASE WHEN n > 3 THEN (value - three) / 3 ELSE (value - two) / 2 END AS change FROM o WHERE n >= 3),
    k AS (SELECT *, unnest(range(1, 7)) AS step FROM c),
    r AS (SELECT meter_id, ts, step, tt[step] AS target, vs[step] - greatest(0, value + change * step) AS err FROM k WHERE step <= len(vs))"""
_TAILS = ", ".join(f"quantile_cont(err, {q}) AS {n}" for n, q in (("l80", 0.1), ("h80", 0.9), ("l95", 0.025), ("h95", 0.975)))
_CUT_AT = "2024-01-03 00:00:00"


@query(
    "outlook_bounds",
    f"""WITH {_TRIED},
    q AS (SELECT meter_id, step, count(*) AS tried, {_TAILS} FROM r GROUP BY 1, 2),
    last AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY meter_id, step ORDER BY n DESC) = 1)
    SELECT l.meter_id, CAST(l.step AS INTEGER) AS step, round(greatest(0, l.value + l.change * l.step) + 1e-7, 4) AS forecast_kwh, coalesce(tried, 0) AS tried,
      """
    + ", ".join(
        f"CASE WHEN tried > 0 THEN round(greatest(0, greatest(0, l.value + l.change * l.step) + {c[0]}{n}) + 1e-7, 4) END AS {'low' if c[0] == 'l' else 'high'}_{n}"
        for n in (80, 95)
        for c in ("l", "h")
    )
    + " FROM last AS l LEFT JOIN q ON l.meter_id IS NOT DISTINCT FROM q.meter_id AND l.step = q.step",
)
def outlook_bounds(spark, sf):
    """Six steps ahead of every feed, with bounds from the errors of the same forecast on the feed's whole past."""
    found = ol.outlook_bounds(b.feeds(spark, sf).where("value IS NOT NULL"), "meter_id", "ts", "value", 6, block=5000)
    return found.drop("target_time").withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in ("forecast_kwh", "low_80", "high_80", "low_95", "high_95")})


@query(
    "outlook_coverage",
    f"""WITH {_TRIED},
    q AS (SELECT meter_id, step, {_TAILS} FROM r WHERE target < TIMESTAMP '{_CUT_AT}' GROUP BY 1, 2)
    SELECT CAST(r.step AS INTEGER) AS step, count(*) AS judged, round(avg(CASE WHEN err BETWEEN l80 - 1e-9 AND h80 + 1e-9 THEN 1 ELSE 0 END), 6) AS within_80,
      round(avg(CASE WHEN err BETWEEN l95 - 1e-9 AND h95 + 1e-9 THEN 1 ELSE 0 END), 6) AS within_95
    FROM r JOIN q ON r.meter_id IS NOT DISTINCT FROM q.meter_id AND r.step = q.step WHERE r.ts >= TIMESTAMP '{_CUT_AT}' GROUP BY 1""",
)
def outlook_coverage(spark, sf):
    """Share of the feeds' later readings inside the bounds learnt from the first two days."""
    found = ol.bound_coverage(b.feeds(spark, sf), "meter_id", "ts", "value", datetime.fromisoformat(_CUT_AT), 6, block=5000)
    return found.withColumns({c: F.round(c, 6) for c in ("within_80", "within_95")})


@query(
    "outlook_backcasts",
    f"""WITH {_TRIED}
    SELECT meter_id, ts AS origin_time, CAST(step AS INTEGER) AS step, target AS target_time, round(err + 1e-7, 4) AS error FROM r""",
)
def outlook_backcasts(spark, sf):
    """The error of the outlook from every reading of every feed, six steps ahead."""
    tried = ol.backcasts(b.feeds(spark, sf), "meter_id", "ts", "value", 6, block=5000)
    return tried.select("meter_id", "origin_time", "step", "target_time", F.round(F.col("actual") - F.col("forecast") + 1e-7, 4).alias("error"))
