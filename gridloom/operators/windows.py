"""Latest-N history, recent change and history checks per meter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.numeric import finite


GROUP_LIMIT = 1000
SALTS = 64


def latest_per_key(df: DataFrame, key: str, ts: str, n: int, tiebreak: str | None = None) -> DataFrame:
    """Newest ``n`` rows of every key; ``place`` counts from the oldest kept row.

    Spark applies a small rank limit before the shuffle too, so a key with any
    number of rows sends at most ``n`` per input task. It does not for limits
    above ``GROUP_LIMIT``; there the newest ``n`` of each salted part of a key
    are taken first, which bounds what the final ranking of a key sees.
    """
    newest = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    rows = df
    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS))
        part = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*newest))
        rows = df.withColumn("_salt", salt).withColumn("_part", part).where(F.col("_part") <= n).drop("_part", "_salt")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*newest))
    kept = rows.withColumn("_rank", rank).where(F.col("_rank") <= n)
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    return kept.withColumn("place", size - F.col("_rank") + 1).drop("_rank")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _stepped(history: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Every kept reading with its place from the newest and its step from the one before."""
    order = Window.partitionBy(key).orderBy(ts)
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc())
    return history.select(
        key,
        F.row_number().over(newest).alias("_r"),
        F.col(value).alias("_v"),
        (F.col(value) - F.lag(value).over(order)).alias("_step"),
        ((micros(ts) - F.lag(micros(ts)).over(order)) / F.lit(1_000_000)).alias("_gap"),
        F.col(ts).alias("_t"),
        F.lag(ts).over(order).alias("_before"),
    )


def _quality() -> list[Column]:
    bad_value = ~F.coalesce(finite(F.col("_v")) & (F.col("_v") >= 0), F.lit(False))
    return [
        F.count(F.lit(1)).alias("history_records"),
        F.count_if(bad_value).alias("bad_values"),
        F.count_if(F.col("_t").isNull() | (F.col("_before") >= F.col("_t"))).alias("bad_times"),
    ]


def _change() -> list[Column]:
    recent = F.col("_r") <= 3
    return [
        F.avg(F.when(recent, F.col("_step"))).alias("average_change"),
        F.median(F.when(recent, F.col("_gap"))).alias("interval_seconds"),
        F.max(F.when(F.col("_r") == 1, F.col("_v"))).alias("last_value"),
        F.max("_t").alias("last_time"),
    ]


def _status() -> Column:
    return (
        F.when(F.col("history_records") < 3, "too_few")
        .when(F.col("bad_values") > 0, "bad_value")
        .when(F.col("bad_times") > 0, "bad_time")
        .otherwise("ok")
    )


def history_quality(history: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Status per meter: ok, too_few, bad_value or bad_time (first that applies).

    ``history`` is the bounded latest-N history.
    """
    return _stepped(history, key, ts, value).groupBy(key).agg(*_quality()).withColumn("status", _status())


def recent_change(history: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Mean change of the last (up to four) readings and median of the last intervals.

    The mean of successive differences telescopes to (last - first) / steps.
    """
    return _stepped(history, key, ts, value).groupBy(key).agg(*_change())


def history_summary(history: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``history_quality`` and ``recent_change`` with the median and the sorted values.

    One grouping on the partitioning that ``latest_per_key`` left, so that the
    history is read and shuffled once. A row holds one meter's bounded history.
    """
    shape = [F.median("_v").alias("median"), F.sort_array(F.collect_list("_v")).alias("sorted_values")]
    grouped = _stepped(history, key, ts, value).groupBy(key).agg(*_quality(), *_change(), *shape)
    return grouped.withColumn("status", _status())
