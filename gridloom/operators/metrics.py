"""Model error metrics, error breakdowns and model selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.sampling import decile
from gridloom.operators.scale import group_medians, group_quantiles


def _count() -> Column:
    return F.count(F.lit(1))


def chronological_split(df: DataFrame, ts: str, train_end: str, valid_end: str, name: str = "split") -> DataFrame:
    when = F.col(ts)
    part = (
        F.when(when <= F.lit(train_end).cast("timestamp_ntz"), "training")
        .when(when <= F.lit(valid_end).cast("timestamp_ntz"), "validation")
        .otherwise("testing")
    )
    return df.withColumn(name, part)


def split_summary(df: DataFrame, ts: str, train_end: str, valid_end: str) -> DataFrame:
    """Rows, share and time bounds per part; every part must have rows."""
    parts = chronological_split(df, ts, train_end, valid_end).groupBy("split").agg(
        _count().alias("row_count"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time")
    )
    found = parts.collect()
    if len(found) != 3:
        raise ValueError(f"empty part in the split, found only {sorted(r['split'] for r in found)}")
    rows = sum(r["row_count"] for r in found)
    small = df.sparkSession.createDataFrame(found, parts.schema)
    return small.withColumn("share_pct", F.bround(F.col("row_count") * F.lit(100.0) / F.lit(float(rows)), 4))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Errors on the raw prediction; the log error uses the prediction held at 0."""
    gap = F.col(p) - F.col(y)
    median = group_medians(df.select(F.abs(gap).alias("_gap")), [], ["_gap"]).first()["_gap"]
    log_gap = F.log1p(F.greatest(F.col(p), F.lit(0.0))) - F.log1p(y)
    sums = df.agg(
        _count().alias("row_count"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sum(gap * gap).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.sqrt(F.avg(log_gap * log_gap)).alias("rmsle"),
        (F.avg((F.col(p) < 0).cast("double")) * 100).alias("negative_pct"),
    )
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.nullif(F.col("_sst"), F.lit(0.0))).otherwise(
        F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)
    )
    return sums.select(
        "row_count", "rmse", "mae", r2.alias("r2"), "rmsle", F.lit(median).alias("median_absolute_error"), "negative_pct"
    )


def clipped_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Errors on the prediction held at 0, from sums that add up across tasks."""
    held = F.greatest(F.col(p), F.lit(0.0))
    gap = held - F.col(y)
    log_gap = F.log1p(held) - F.log1p(y)
    sums = df.groupBy(*by).agg(
        _count().alias("row_count"),
        F.sum(F.abs(gap)).alias("_abs"),
        F.sum(gap * gap).alias("_sq"),
        F.sum(log_gap * log_gap).alias("_log"),
        F.sum(y).alias("_y"),
        F.sum(F.col(y) * F.col(y)).alias("_yy"),
    )
    n = F.col("row_count")
    total = F.col("_yy") - n * (F.col("_y") / n) * (F.col("_y") / n)
    return sums.select(
        *by,
        "row_count",
        (F.col("_abs") / n).alias("mae"),
        F.sqrt(F.col("_sq") / n).alias("rmse"),
        F.when(total > 0, 1 - F.col("_sq") / F.nullif(total, F.lit(0.0))).otherwise(0.0).alias("r2"),
        F.sqrt(F.col("_log") / n).alias("rmsle"),
    )


# Shares of the training target that bound the bands.
BAND_POINTS = {"small_max": 0.5, "medium_max": 0.9, "large_max": 0.99}


def band_thresholds(train: DataFrame, y: str) -> DataFrame:
    return group_quantiles(train, [], y, BAND_POINTS)


def band(y: Column, limits: dict[str, float]) -> Column:
    return (
        F.when(y <= limits["small_max"], "small")
        .when(y <= limits["medium_max"], "medium")
        .when(y <= limits["large_max"], "large")
        .otherwise("peak")
    )


def band_metrics(df: DataFrame, y: str, p: str, limits: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    return clipped_metrics(df.withColumn("band", band(F.col(y), limits)), y, p, [*by, "band"])


def subgroup_metrics(df: DataFrame, y: str, p: str, dimensions: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """Rows, RMSE and MAE per value of every dimension, from one pass.

    With ``tiebreak`` the target decile is added as a dimension.
    """
    slim = df.select(*dict.fromkeys([*dimensions, y, p, *tiebreak]))
    work = decile(slim, y, tiebreak, "target_decile") if tiebreak else slim
    names = [*dimensions, *(["target_decile"] if tiebreak else [])]
    tall = work.select(*[F.col(c).cast("string").alias(c) for c in names], (F.col(p) - F.col(y)).alias("_gap"))
    grouped = tall.groupingSets([[F.col(c)] for c in names], *names).agg(
        *[F.grouping(c).alias(f"_g_{c}") for c in names],
        _count().alias("row_count"),
        F.sqrt(F.avg(F.col("_gap") * F.col("_gap"))).alias("rmse"),
        F.avg(F.abs("_gap")).alias("mae"),
    )
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in names:
        chosen = F.col(f"_g_{c}") == 0
        dimension = F.when(chosen, F.lit(c)).otherwise(dimension)
        value = F.when(chosen, F.col(c)).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "row_count", "rmse", "mae")


def zero_nonzero_error(df: DataFrame, y: str, p: str) -> DataFrame:
    gap = F.abs(F.col(p) - F.col(y))
    zero, positive = F.col(y) == 0, F.col(y) > 0
    return df.agg(
        F.count_if(zero).alias("zero_rows"),
        F.avg(F.when(zero, gap)).alias("zero_mae"),
        F.count_if(positive).alias("nonzero_rows"),
        F.avg(F.when(positive, gap)).alias("nonzero_mae"),
    )


def extreme_threshold(train: DataFrame, y: str) -> float:
    return group_quantiles(train, [], y, {"extreme": 0.999}).first()["extreme"]


def high_consumption_error(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    gap = F.col(p) - F.col(y)
    return df.where(F.col(y) >= threshold).agg(
        F.lit(threshold).alias("threshold"),
        _count().alias("row_count"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
    )


def building_error_summary(df: DataFrame, y: str, p: str, building: str) -> DataFrame:
    per = df.groupBy(building).agg(F.avg(F.abs(F.col(p) - F.col(y))).alias("_mae"))
    median = group_medians(per, [], ["_mae"]).first()["_mae"]
    return per.agg(
        _count().alias("building_count"),
        F.lit(median).alias("median_building_mae"),
        F.max("_mae").alias("maximum_building_mae"),
    )


def split_drift(df: DataFrame, y: str, split: str, threshold: float) -> DataFrame:
    medians = group_medians(df, [split], [y]).select(split, F.col(y).alias("median"))
    stats = df.groupBy(split).agg(
        _count().alias("row_count"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.max(y).alias("maximum"),
        (F.avg((F.col(y) == 0).cast("double")) * 100).alias("zero_pct"),
        (F.avg((F.col(y) >= threshold).cast("double")) * 100).alias("extreme_pct"),
    )
    return stats.join(F.broadcast(medians), split).withColumn("extreme_threshold", F.lit(threshold))


def residuals(df: DataFrame, y: str, p: str) -> DataFrame:
    """Prediction minus actual: positive means predicted too high."""
    return df.withColumn("residual", F.col(p) - F.col(y))


def error_trend(df: DataFrame, ts: str, y: str, p: str, grain: str) -> DataFrame:
    period = F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz")
    return df.groupBy(period.alias("period")).agg(F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"), _count().alias("row_count"))


def model_comparison(scores: DataFrame, model: str, split: str) -> DataFrame:
    """One row per model with its validation and testing metrics side by side."""

    def pick(part: str, metric: str) -> Column:
        return F.max(F.when(F.col(split) == part, F.col(metric))).alias(f"{part}_{metric}")

    return scores.groupBy(model).agg(
        *[pick(s, m) for s in ("validation", "testing") for m in ("row_count", "rmse", "mae", "r2", "rmsle")]
    )


def select_best(comparison: DataFrame, model: str, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Model with the smallest metrics in the stated order (True: larger is better)."""
    parts = [(-F.col(c) if larger else F.col(c)).alias(f"k{i}") for i, (c, larger) in enumerate(order)]
    return comparison.agg(F.min_by(F.col(model), F.struct(*parts, F.col(model))).alias("best_model"))


# How much better a challenger must be.
PROMOTION_RATIO = 0.99


def promotion(comparison: DataFrame, model: str, champion: str) -> DataFrame:
    """Which models may replace the champion."""
    held = comparison.where(F.col(model) == champion).first()
    if held is None:
        raise ValueError(f"no model named {champion}")
    wins = (
        (F.col("validation_rmse") <= held["validation_rmse"] * PROMOTION_RATIO)
        & (F.col("validation_mae") <= held["validation_mae"])
        & (F.col("testing_rmse") <= held["testing_rmse"])
    )
    return comparison.where(F.col(model) != champion).select(
        F.lit(champion).alias("champion"), F.col(model).alias("challenger"), wins.alias("promote")
    )


def training_profile(df: DataFrame, building: str, site: str, ts: str, category: str) -> DataFrame:
    """One row: identifier and time ranges and the sorted known categories."""
    named = (("building", building), ("site", site), ("timestamp", ts))
    return df.agg(
        *[F.min(c).alias(f"{n}_min") for n, c in named],
        *[F.max(c).alias(f"{n}_max") for n, c in named],
        F.sort_array(F.collect_set(category)).alias("categories"),
    )
