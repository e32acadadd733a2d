"""Key checks, enrichment joins and idempotent appends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.numeric import pct
from gridloom.operators.scale import has_key, lookup_join


def key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: total rows, rows with a null key, surplus rows per key."""
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("null_key", null_key)
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("null_key"), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"),
    )


def assert_unique(df: DataFrame, keys: Sequence[str], label: str = "lookup") -> DataFrame:
    """Stop when a lookup key is null or repeated; else hand the lookup back."""
    found = key_report(df, keys).first()
    if found["null_keys"] or found["duplicate_keys"]:
        raise ValueError(f"{label}: {found['null_keys']} null and {found['duplicate_keys']} repeated keys on {list(keys)}")
    return df


def enrich(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left many-to-one join of facts to a dimension with a unique key."""
    return lookup_join(df, dim, on)


def guarded_join(df: DataFrame, dim: DataFrame, on: Sequence[str], label: str = "lookup") -> DataFrame:
    """``enrich`` after proving the key unique, which proves the row count is kept."""
    return enrich(df, assert_unique(dim, on, label), on)


def assert_same_count(before: DataFrame, after: DataFrame) -> int:
    a, b = before.count(), after.count()
    if a != b:
        raise ValueError(f"row count changed from {a} to {b}")
    return a


def match_rates(df: DataFrame, building_key: str, weather_mark: str, building_mark: str) -> DataFrame:
    """Unmatched rows and success percentages of the two enrichment joins."""
    rows = F.count(F.lit(1))
    no_building = F.count_if(F.col(building_mark).isNull())
    no_weather = F.count_if(F.col(weather_mark).isNull())
    sums = df.agg(
        rows.alias("row_count"),
        no_building.alias("unmatched_buildings"),
        no_weather.alias("unmatched_weather"),
        F.count(building_key).alias("kept"),
    )
    return sums.select(
        "row_count",
        "unmatched_buildings",
        "unmatched_weather",
        pct(F.col("row_count") - F.col("unmatched_buildings"), F.col("row_count")).alias("building_success_pct"),
        pct(F.col("row_count") - F.col("unmatched_weather"), F.col("row_count")).alias("weather_success_pct"),
        pct(F.col("kept"), F.col("row_count")).alias("retention_pct"),
    )


def covered(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return has_key(df, keys, on, present=True)


def uncovered(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return has_key(df, keys, on, present=False)


def unmatched_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of ``a`` that ``b`` lacks."""
    return has_key(a.select(key).where(F.col(key).isNotNull()).distinct(), b, [key], present=False)


def map_column(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    return lookup_join(df, dim.select(key, value), [key])


def fill_from(df: DataFrame, lookup: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace only the nulls of ``columns`` by the lookup's values; column order stays."""
    renamed = lookup.select(*on, *[F.col(c).alias(f"{c}__fill") for c in columns])
    joined = lookup_join(df, renamed, on)
    return joined.select(
        *[F.coalesce(F.col(c), F.col(f"{c}__fill")).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First whole row per key in a stated order.

    The rank filter lets Spark cut each key to one row before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Stored rows after an idempotent append: stored rows win, then the first new row per key."""
    fresh = has_key(first_row(new, keys, order), existing, keys, present=False)
    return existing.unionByName(fresh)


def attach_actuals(predictions: DataFrame, actuals: DataFrame, on: Sequence[str], value: str, name: str) -> DataFrame:
    """Predictions with the observed value where one exists (zero is a value, null is not)."""
    return lookup_join(predictions, actuals.select(*on, F.col(value).alias(name)), on)
