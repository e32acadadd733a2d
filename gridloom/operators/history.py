"""Prediction and energy history: filters, totals, pages and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_history(
    df: DataFrame, key: str, ts: str, valid: str, meter_id: int | None = None, limit: int | None = None
) -> DataFrame:
    """Valid records by meter and time. ``limit`` counts over all meters together,
    so later meters may be cut off; without it the whole history is meant."""
    kept = df.where(F.col(valid))
    if meter_id is not None:
        kept = kept.where(F.col(key) == meter_id)
    return kept if limit is None else kept.orderBy(key, ts).limit(limit)


def energy_summary(df: DataFrame, value: str) -> DataFrame:
    """Count, total and mean over all records, valid or not; zero when there are none."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("average"),
    )


def prediction_summary(df: DataFrame, ts: str, value: str, today: str) -> DataFrame:
    same_day = F.to_date(F.col(ts)) == F.lit(today).cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("average"),
        F.coalesce(F.sum(F.when(same_day, F.col(value))), F.lit(0.0)).alias("today_total"),
    )


def report_filter(
    df: DataFrame, ts: str, start: str | None = None, end: str | None = None, key: str | None = None, meter_id: int | None = None
) -> DataFrame:
    """Inclusive day range on the prediction time and an optional meter."""
    kept = df
    if start:
        kept = kept.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        kept = kept.where(F.col(ts) <= F.lit(f"{end} 23:59:59").cast("timestamp_ntz"))
    if meter_id is not None:
        kept = kept.where(F.col(key) == meter_id)
    return kept


def latest(df: DataFrame, ts: str, n: int = 100, tiebreak: str | None = None) -> DataFrame:
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 8) -> DataFrame:
    """Page ``number`` (from 1) of a list in the stated order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def top_k(df: DataFrame, by: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def recent_trend(df: DataFrame, ts: str, tiebreak: str, n: int = 12, listed: int = 100, oldest: bool = False) -> DataFrame:
    """Latest ``n`` points of the listed history; ``oldest`` takes the end of the
    newest-first list instead, that is the oldest of the listed ones."""
    rows = latest(df, ts, listed, tiebreak)
    if oldest:
        return rows.orderBy(F.col(ts).asc(), F.col(tiebreak).asc()).limit(n)
    return latest(rows, ts, n, tiebreak)


def canonical_sort(df: DataFrame, site: str, ts: str, building: str) -> DataFrame:
    """Total order by site, time and building (a range shuffle, no single task)."""
    return df.orderBy(site, ts, building)
