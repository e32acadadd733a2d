"""Analytics on long series: flat stretches, breaks of level, seasonal parts, totals by period.

A series is cut into blocks of time (a month, a day), so that one meter with most
of the readings is spread over tasks. What a block can't know, such as a run
that goes on, a running sum or the neighbours of its first hours, comes from
summaries of blocks or from copies of the rows next to the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.scale import lookup_join
from gridloom.session import materialize

# Fixed value: the 95 % point of the largest distance of a Brownian bridge from zero.
BREAK_95 = 1.358


def _block(ts: Column, grain: str) -> Column:
    return F.date_trunc(grain, ts)


def flat_runs(df: DataFrame, key: str, ts: str, value: str, least: int = 3, grain: str = "month") -> DataFrame:
    """(key, value, started_at, ended_at, readings) of every run of at least ``least`` equal consecutive values.

    Readings without time or value are left out and end no run; of equal times
    the smaller value comes first. Runs are found within blocks; the first and
    the last of each block then merge over the cuts. A null meter is a meter.
    """
    known = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(key, F.col(ts).alias("_ts"), F.col(value).alias("_v"), _block(F.col(ts), grain).alias("_b"))
    order = Window.partitionBy(key, "_b").orderBy("_ts", "_v")
    fresh = F.coalesce((F.col("_v") != F.lag("_v").over(order)).cast("int"), F.lit(0))
    marked = known.withColumn("_new", fresh)
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = marked.groupBy(key, "_b", "_run").agg(F.first("_v").alias("_v"), F.min("_ts").alias("a"), F.max("_ts").alias("z"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(key, "_b")
    runs = materialize(runs.withColumns({"_head": F.col("_run") == 0, "_tail": F.col("_run") == F.max("_run").over(whole)}), "runs")
    inner = runs.where("NOT _head AND NOT _tail").select(key, "_v", "a", "z", "n")
    # one or two rows a block: a run goes on where a block's last run and the next block's first have one value
    series = Window.partitionBy(key).orderBy("_b", "_run")
    ends = runs.where("_head OR _tail").withColumns({"_pv": F.lag("_v").over(series), "_pb": F.lag("_b").over(series)})
    joined = F.col("_head") & F.col("_pb").isNotNull() & (F.col("_pb") != F.col("_b")) & (F.col("_pv") == F.col("_v"))
    ends = ends.withColumn("_group", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(series.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = ends.groupBy(key, "_group").agg(F.first("_v").alias("_v"), F.min("a").alias("a"), F.max("z").alias("z"), F.sum("n").alias("n")).drop("_group")
    found = inner.unionByName(merged).where(F.col("n") >= least)
    return found.select(key, F.col("_v").alias(value), F.col("a").alias("started_at"), F.col("z").alias("ended_at"), F.col("n").alias("readings"))


def level_breaks(df: DataFrame, key: str, ts: str, value: str, grain: str = "month") -> DataFrame:
    """(key, readings, break_at, before, after, statistic, broken): the likeliest change of level of every meter.

    The cumulative sum of the distances from the meter's mean is farthest from
    zero just before the level changes; ``break_at`` is the first reading of the
    new level. The statistic is that distance over the deviation and the root of
    the number of readings, and ``broken`` says whether it exceeds the 95 %
    point. Of equal distances the earliest counts. Blocks hand their sums to
    later blocks, so a meter is cut over tasks. A meter whose values don't
    differ has no break and statistic 0. Readings without time or value are left
    out; of equal times the smaller value comes first.
    """
    v = F.col(value).cast("double")
    known = df.where(F.col(ts).isNotNull() & v.isNotNull()).select(F.col(key).alias("_k"), F.col(ts).alias("_ts"), v.alias("_v"), _block(F.col(ts), grain).alias("_b"))
    known = known.withColumn("_null", F.col("_k").isNull()).withColumn("_k", F.coalesce(F.col("_k").cast("string"), F.lit("")))
    names = ["_null", "_k"]
    blocks = materialize(known.groupBy(*names, "_b").agg(F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q"), F.count(F.lit(1)).alias("n")), "block-sums")
    earlier = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(*names)
    offsets = blocks.select(
        *names, "_b",
        F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n0"),
        F.sum("s").over(all_of).alias("_s"), F.sum("q").over(all_of).alias("_q"), F.sum("n").over(all_of).alias("_n"),
    )
    inside = Window.partitionBy(*names, "_b").orderBy("_ts", "_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = lookup_join(known, offsets, [*names, "_b"])
    upto = F.col("_s0") + F.coalesce(F.sum("_v").over(inside), F.lit(0.0))
    count = F.col("_n0") + F.count("_v").over(inside)
    # sums of what lies before a reading: the break is where that reading starts the new level
    walk = placed.select(*names, "_ts", "_s", "_q", "_n", upto.alias("_upto"), count.alias("_at"))
    walk = walk.withColumn("_far", F.abs(F.col("_upto") - F.col("_at") * (F.col("_s") / F.col("_n"))))
    top = walk.groupBy(*names).agg(
        F.first("_s").alias("s"), F.first("_q").alias("q"), F.first("_n").alias("n"), F.max("_far").alias("far"),
        F.max_by(F.struct("_ts", "_upto", "_at"), F.struct(F.col("_far"), -F.col("_at"))).alias("at"),
    )
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    statistic = F.when(spread > 0, F.col("far") / (spread * F.sqrt(F.col("n")))).otherwise(0.0)
    moves = (spread > 0) & (F.col("at._at") > 0)
    kind = df.schema[key].dataType
    return top.select(
        F.when(~F.col("_null"), F.col("_k")).cast(kind).alias(key),
        F.col("n").alias("readings"),
        F.when(moves, F.col("at._ts")).alias("break_at"),
        F.when(moves, F.col("at._upto") / F.col("at._at")).alias("before"),
        F.when(moves, (F.col("s") - F.col("at._upto")) / (F.col("n") - F.col("at._at"))).alias("after"),
        statistic.alias("statistic"),
        (statistic > BREAK_95).alias("broken"),
    )


def hourly_series(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, hour, value): sums per meter and hour; rows without time, value or meter are left out."""
    known = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(key, F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("hour")).agg(F.sum(F.col(value).cast("double")).alias("value"))


def decompose(series: DataFrame, key: str, hour: str = "hour", value: str = "value", period: int = 24, block_hours: int = 24 * 28) -> DataFrame:
    """``series`` (one row per meter and hour) with trend, seasonal part and remainder, which add up to the value.

    The trend is the centred mean over one period (an even period takes half of
    both outer hours), null where an hour of it is missing. The seasonal part is
    the mean distance from the trend at that hour of the period, less the mean of
    these means. Rows next to a cut are copied to the neighbouring block, so no
    block needs another.
    """
    half, even = period // 2, period % 2 == 0
    if block_hours < 2 * period:
        raise ValueError("a block must hold two periods")
    at = F.unix_micros(F.col(hour).cast("timestamp")) / 3_600_000_000
    slim = series.select(F.col(key).alias("_k"), F.col(hour).alias("_hour"), F.col(value).cast("double").alias("_v"), at.cast("long").alias("_at"))
    home = F.floor(F.col("_at") / block_hours)
    near = F.array_distinct(F.array(*[F.floor((F.col("_at") + d) / block_hours) for d in (-half, 0, half)]))
    spread = slim.select("*", home.alias("_home"), F.explode(near).alias("_b"))
    order = Window.partitionBy("_k", "_b").orderBy("_at")
    wide, narrow = order.rangeBetween(-half, half), order.rangeBetween(-half + 1, half - 1)
    total = (F.sum("_v").over(wide) + F.sum("_v").over(narrow)) / 2 if even else F.sum("_v").over(wide)
    trend = F.when(F.count("_v").over(wide) == 2 * half + 1, total / period)
    own = spread.select("*", trend.alias("trend")).where("_b = _home").withColumn("_phase", F.pmod("_at", F.lit(period)))
    parted = materialize(own.select("_k", "_hour", "_v", "_phase", "trend"), "trend")
    phases = parted.where("trend IS NOT NULL").groupBy("_k", "_phase").agg(F.avg(F.col("_v") - F.col("trend")).alias("m"))
    seasonal = phases.select("_k", "_phase", (F.col("m") - F.avg("m").over(Window.partitionBy("_k"))).alias("seasonal"))
    return lookup_join(parted, seasonal, ["_k", "_phase"]).select(
        F.col("_k").alias(key), F.col("_hour").alias(hour), F.col("_v").alias(value), "trend", "seasonal",
        (F.col("_v") - F.col("trend") - F.col("seasonal")).alias("remainder"),
    )


def week_profile(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, weekday, hour, mean, row_count); Monday is 0, missing cells have no row."""
    known = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(key, F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("row_count"))


def period_totals(df: DataFrame, keys: Sequence[str], ts: str, value: str, grain: str = "day") -> DataFrame:
    """Totals, counts, means and shares for every prefix of ``keys`` and with or without the period, in one scan.

    ``level`` is the grouping id: a set bit says that the key at that place (the
    last one is the period) is summed over, which tells a total from a null key.
    ``share`` is the part of the total over all meters in the same period.
    """
    keys = list(keys)
    cells = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*keys, F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz").alias("period"), F.col(value).cast("double").alias("_v"))
    cells = cells.groupBy(*keys, "period").agg(F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_c"))
    sets = [[*keys[:i], *p] for i in range(len(keys), -1, -1) for p in (["period"], [])]
    grouped = cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*keys, "period")])
    out = grouped.agg(F.grouping_id().alias("level"), F.sum("_s").alias("total"), F.sum("_c").alias("row_count"))
    whole = F.max(F.when(F.col("level").bitwiseAND(F.lit((1 << (len(keys) + 1)) - 2)) == (1 << (len(keys) + 1)) - 2, F.col("total")))
    alone = out.groupBy("period", F.col("level").bitwiseAND(F.lit(1)).alias("_open")).agg(whole.alias("_all"))
    joined = out.withColumn("_open", F.col("level").bitwiseAND(F.lit(1))).alias("o").join(
        alone.alias("a"), F.col("o.period").eqNullSafe(F.col("a.period")) & (F.col("o._open") == F.col("a._open")), "left"
    )
    return joined.select(
        *[F.col(f"o.{c}") for c in (*keys, "period")], "level", "total", "row_count", (F.col("total") / F.col("row_count")).alias("mean"),
        F.try_divide(F.col("total"), F.col("_all")).alias("share"),
    )
