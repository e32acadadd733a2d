"""Short peak outlook for every meter at once."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.numeric import finite
from gridloom.operators.scale import group_quantiles, lookup_join, with_position
from gridloom.operators.windows import history_summary, latest_per_key
from gridloom.session import materialize

# Bounds of the settings.
MAX_HORIZON = 24
HISTORY_RANGE = (3, 5000)


def _check(horizon: int, records: int) -> None:
    if not isinstance(horizon, int) or isinstance(horizon, bool) or not 1 <= horizon <= MAX_HORIZON:
        raise ValueError("the horizon must be a whole number from 1 to 24")
    if not HISTORY_RANGE[0] <= records <= HISTORY_RANGE[1]:
        raise ValueError("the history must have from 3 to 5000 records")


def _later(base, secs):
    """``base`` moved by a number of seconds, to the microsecond."""
    micros = F.unix_micros(base.cast("timestamp")) + F.round(secs * 1_000_000).cast("long")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def peak_outlook(
    df: DataFrame,
    key: str,
    ts: str,
    value: str,
    horizon: int = 1,
    records: int = 500,
    tiebreak: str | None = None,
) -> DataFrame:
    """Largest extrapolated reading of the next ``horizon`` intervals, per meter.

    Of equal forecasts the earliest step counts. Meters whose history cannot be
    used come out with a status and null forecasts.
    """
    _check(horizon, records)
    history = latest_per_key(df, key, ts, records, tiebreak)
    joined = history_summary(history, key, ts, value)
    good = F.col("status") == "ok"
    ahead = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda k: F.greatest(F.lit(0.0), F.col("last_value") + F.col("average_change") * k),
    )
    forecast = F.array_max(ahead)
    step = F.array_position(ahead, forecast)
    size = F.size("sorted_values")
    cut = F.least(size - 1, F.floor(F.lit(0.9) * size).cast("int"))
    threshold = F.element_at("sorted_values", cut + 1)
    return joined.select(
        key,
        "status",
        "history_records",
        F.when(good, forecast).alias("forecast_kwh"),
        F.when(good, _later(F.col("last_time"), F.col("interval_seconds") * step)).alias("peak_timestamp"),
        F.when(good, threshold).alias("peak_threshold_kwh"),
        F.when(good, forecast >= threshold).alias("is_peak_likely"),
        F.when(good, F.col("median")).alias("baseline_kwh"),
        F.lit(horizon).alias("horizon_records"),
    )


def forecast_steps(
    df: DataFrame,
    key: str,
    ts: str,
    value: str,
    horizon: int = 1,
    records: int = 500,
    tiebreak: str | None = None,
) -> DataFrame:
    """Every forecast step of every meter with a usable history."""
    _check(horizon, records)
    history = latest_per_key(df, key, ts, records, tiebreak)
    usable = history_summary(history, key, ts, value).where("status = 'ok'")
    steps = usable.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(
        key,
        "step",
        _later(F.col("last_time"), F.col("interval_seconds") * F.col("step")).alias("target_time"),
        F.greatest(F.lit(0.0), F.col("last_value") + F.col("average_change") * F.col("step")).alias("forecast_kwh"),
    )


#: Readings of one meter that a task sees together when the outlook is tried on its past.
BLOCK = 100_000


def backcasts(df: DataFrame, key: str, ts: str, value: str, horizon: int = 1, block: int = BLOCK) -> DataFrame:
    """(key, origin_time, step, target_time, forecast, actual): the outlook from every reading on, against what came.

    An origin has at least two readings before it, and is extrapolated as the
    outlook is, by the mean of its last three changes (two for a meter's third
    reading). Readings without time or a finite value from 0 on are left out; of
    equal times the smaller value comes first; a null meter is a meter. A meter's
    readings are numbered and cut into blocks of ``block``, each with copies of
    the three before it and the ``horizon`` after it, so that one meter with most
    of the rows is many tasks.
    """
    _check(horizon, HISTORY_RANGE[0])
    if block < max(3, horizon):
        raise ValueError("a block must hold the horizon and three readings")
    good = F.col(ts).isNotNull() & finite(F.col(value)) & (F.col(value) >= 0)
    known = df.where(good).select(F.struct(key).alias("_g"), F.col(ts).alias("_t"), F.col(value).cast("double").alias("_v"))
    placed = with_position(known, [F.col("_g"), F.col("_t"), F.col("_v")], "_pos")
    first = placed.groupBy("_g").agg(F.min("_pos").alias("_first"))
    rows = lookup_join(placed, first, ["_g"]).withColumn("_n", F.col("_pos") - F.col("_first"))
    at = F.col("_n") % block
    home = ((F.col("_n") - at) / block).cast("long")
    seen = F.array_compact(F.array(home, F.when(at < horizon, home - 1), F.when(at >= block - 3, home + 1)))
    rows = rows.select("_g", "_t", "_v", "_n", home.alias("_home"), F.explode(seen).alias("_b"))
    # said outright: a table already dealt by meter would pass for dealt by meter and block, and keep a hot meter in one task
    rows = rows.repartition("_g", "_b")
    along = Window.partitionBy("_g", "_b").orderBy("_n")

    def back(k: int):
        return (F.col("_v") - F.lag("_v", k).over(along)) / k

    change = F.when(F.col("_n") >= 3, back(3)).when(F.col("_n") == 2, back(2))
    ahead = [F.struct(F.lead("_t", k).over(along).alias("t"), F.lead("_v", k).over(along).alias("v")) for k in range(1, horizon + 1)]
    tried = rows.select("_g", "_t", "_v", (F.col("_b") == F.col("_home")).alias("_own"), change.alias("_change"), F.array(*ahead).alias("_ahead"))
    tried = tried.where("_own AND _change IS NOT NULL").select("_g", "_t", "_v", "_change", F.posexplode("_ahead").alias("_k", "_a"))
    step = F.col("_k") + 1
    return tried.where("_a.v IS NOT NULL").select(
        F.col("_g")[key].alias(key),
        F.col("_t").alias("origin_time"),
        step.alias("step"),
        F.col("_a.t").alias("target_time"),
        F.greatest(F.lit(0.0), F.col("_v") + F.col("_change") * step).alias("forecast"),
        F.col("_a.v").alias("actual"),
    )


def _tails(levels: Sequence[int]) -> dict[str, float]:
    if not levels or any(not isinstance(n, int) or isinstance(n, bool) or not 1 <= n <= 99 for n in levels):
        raise ValueError("levels are whole per cents from 1 to 99")
    tails = {}
    for n in levels:
        tails[f"low_{n}"], tails[f"high_{n}"] = (100 - n) / 200, (100 + n) / 200
    return tails


def _errors(tried: DataFrame, key: str, levels: Sequence[int], rows_in_task: int | None) -> DataFrame:
    """(_g, tried, low_N, high_N) with _g = (key, step): exact quantiles of actual minus forecast."""
    errors = tried.select(F.struct(key, "step").alias("_g"), (F.col("actual") - F.col("forecast")).alias("_e"))
    cut = group_quantiles(errors, ["_g"], "_e", _tails(levels), rows_in_task)
    return lookup_join(cut, errors.groupBy("_g").agg(F.count(F.lit(1)).alias("tried")), ["_g"])


def outlook_bounds(
    df: DataFrame,
    key: str,
    ts: str,
    value: str,
    horizon: int = 1,
    records: int = 500,
    levels: Sequence[int] = (80, 95),
    tiebreak: str | None = None,
    block: int = BLOCK,
    rows_in_task: int | None = None,
) -> DataFrame:
    """``forecast_steps`` with bounds: (key, step, target_time, forecast_kwh, tried, low_80, high_80, low_95, high_95).

    The bounds of a meter and step are the forecast plus the exact quantiles of
    the errors that the same forecast made from every earlier reading of the
    meter; no bound is below 0. ``tried`` counts those errors; without any the
    bounds are null.
    """
    _tails(levels)
    steps = forecast_steps(df, key, ts, value, horizon, records, tiebreak)
    tried = materialize(backcasts(df, key, ts, value, horizon, block), "backcasts")
    errors = _errors(tried, key, levels, rows_in_task)
    joined = lookup_join(steps.withColumn("_g", F.struct(key, "step")), errors, ["_g"])
    # greatest() skips nulls, so a missing bound is kept missing by hand
    bounds = [F.when(F.col("tried") > 0, F.greatest(F.lit(0.0), F.col("forecast_kwh") + F.col(c))).alias(c) for c in _tails(levels)]
    return joined.select(key, "step", "target_time", "forecast_kwh", F.coalesce("tried", F.lit(0).cast("long")).alias("tried"), *bounds)


def bound_coverage(
    df: DataFrame,
    key: str,
    ts: str,
    value: str,
    split_at: datetime,
    horizon: int = 1,
    levels: Sequence[int] = (80, 95),
    block: int = BLOCK,
    rows_in_task: int | None = None,
) -> DataFrame:
    """(step, judged, within_80, within_95): share of later readings inside the bounds learnt before ``split_at``.

    Errors count for the bounds when their target is before the split, and are
    judged when their origin is at or after it, so that no reading does both.
    Meters without an error before the split are not judged.
    """
    tried = materialize(backcasts(df, key, ts, value, horizon, block), "backcasts")
    split = F.lit(split_at).cast("timestamp_ntz")
    known = _errors(tried.where(F.col("target_time") < split), key, levels, rows_in_task)
    later = tried.where(F.col("origin_time") >= split).withColumn("_g", F.struct(key, "step"))
    judged = lookup_join(later, known, ["_g"]).where("tried IS NOT NULL")
    error = F.col("actual") - F.col("forecast")
    shares = [F.avg(error.between(F.col(f"low_{n}"), F.col(f"high_{n}")).cast("int")).alias(f"within_{n}") for n in levels]
    return judged.groupBy("step").agg(F.count(F.lit(1)).alias("judged"), *shares)
