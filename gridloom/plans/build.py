"""The two dataset builds, from raw tables to a checked, written feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import features as ft
from gridloom.operators import impute as im
from gridloom.operators import joins as jn
from gridloom.operators import quality as qa
from gridloom.operators.profile import nan_inf_counts, numeric_columns
from gridloom.schemas import WEATHER_COLUMNS
from gridloom.session import materialize
from gridloom.sources.readers import limit_rows
from gridloom.sources.writers import write_table

KEYS_AND_TARGET = ["building_id", "timestamp", "meter_reading"]
SORT = ["site_id", "timestamp", "building_id"]


def merge_readings(readings: DataFrame, buildings: DataFrame, weather: DataFrame) -> DataFrame:
    """Readings with building and weather columns; both lookups are proven unique first."""
    joined = jn.guarded_join(readings, buildings, ["building_id"], "buildings")
    return jn.guarded_join(joined, weather, ["site_id", "timestamp"], "weather").select(*ft.RAW_COLUMNS)


def _publish(before: DataFrame, table: DataFrame, columns: list[str], out: str, overwrite: bool) -> DataFrame:
    """Check the finished table, write it, and return its audit row.

    The checks run on a scratch copy, so a table that fails them never
    reaches ``out``.
    """
    staged = materialize(table, "build")
    broken = qa.check_contract(staged, columns, rows=before.count()).collect()
    if broken:
        raise ValueError(f"contract broken: {[tuple(r) for r in broken]}")
    if not qa.multiset_equal(before.select(*KEYS_AND_TARGET), staged.select(*KEYS_AND_TARGET)):
        raise ValueError("keys or targets changed")
    numbers = numeric_columns(staged)
    infinite = nan_inf_counts(staged, numbers).agg(F.sum("infinite").alias("n")).first()["n"]
    if infinite:
        raise ValueError(f"{infinite} infinite values")
    unresolved = " OR ".join(f"`{c}` IS NULL" for c in WEATHER_COLUMNS)
    audit = staged.agg(
        F.count(F.lit(1)).alias("output_rows"),
        F.count_if(F.col("meter_reading") == 0).alias("zero_targets"),
        F.count_if(F.expr(unresolved)).alias("unresolved_weather_rows"),
    )
    if audit.first()["unresolved_weather_rows"]:
        raise ValueError("weather values are still missing")
    write_table(staged, out, overwrite, SORT)
    return audit


def build_electricity(
    readings: DataFrame,
    buildings: DataFrame,
    weather: DataFrame,
    out: str,
    train_end: str,
    overwrite: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Electricity readings, cleaned, enriched, causally filled, as 49 feature columns."""
    kept = qa.clean_readings(readings, "meter_reading", "meter", 0)
    merged = merge_readings(kept, buildings, weather)
    return build_electricity_features(merged, out, train_end, overwrite, rows)


def build_electricity_features(
    merged: DataFrame, out: str, train_end: str, overwrite: bool = False, rows: int | None = None
) -> DataFrame:
    """The feature step alone, from merged readings; ``rows`` caps the source rows.

    Stops if a site-hour comes with two values of one weather column.
    """
    source = merged if rows is None else limit_rows(merged, rows, ["timestamp", "building_id"])
    qa.assert_observations(source, "meter", "meter_reading", "timestamp")
    at_odds = qa.conflicts(source.where("site_id IS NOT NULL"), ["site_id", "timestamp"], WEATHER_COLUMNS).first().asDict()
    if any(at_odds.values()):
        raise ValueError(f"conflicting weather: {({c: n for c, n in at_odds.items() if n})}")
    spine = im.weather_spine(source, "site_id", "timestamp", WEATHER_COLUMNS)
    site, overall = im.fit_weather(spine, "site_id", "timestamp", WEATHER_COLUMNS, train_end)
    table = ft.electricity_features(ft.treat_weather(source, spine, "site_id", "timestamp", site, overall))
    columns = [*ft.ELECTRICITY_RAW, *[f"{c}_missing" for c in WEATHER_COLUMNS], *ft.electricity_columns()]
    return _publish(source, table, columns, out, overwrite)


def build_v1(
    readings: DataFrame, buildings: DataFrame, weather: DataFrame, out: str, overwrite: bool = False
) -> DataFrame:
    """All meters, bidirectionally imputed, as the 46 columns of the first feature set."""
    merged = merge_readings(readings, buildings, weather)
    filled = im.impute_bidirectional(
        merged, "building_id", "site_id", "timestamp", "primary_use", ["year_built", "floor_count"], WEATHER_COLUMNS
    )
    qa.assert_core_possible(filled)
    columns = [*ft.RAW_COLUMNS, *ft.features_v1_columns()]
    return _publish(merged, ft.features_v1(filled), columns, out, overwrite)
