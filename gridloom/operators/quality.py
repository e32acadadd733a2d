"""Audits: duplicates, impossible values, conflicts, contracts and set comparisons."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.scale import lookup_join

def rows() -> Column:
    return F.count(F.lit(1))


def filter_meter(df: DataFrame, code: int, column: str = "meter") -> DataFrame:
    return df.where(F.col(column) == code)


def clean_readings(df: DataFrame, value: str, meter: str | None = None, code: int = 0) -> DataFrame:
    """Readings of one meter type without negatives; zeros stay."""
    kept = filter_meter(df, code, meter) if meter else df
    return kept.where(F.col(value) >= 0)


def accounting(df: DataFrame, value: str, selected: Column | None = None) -> DataFrame:
    """Source, selected, rejected, zero and output counts, and whether they add up."""
    chosen = F.lit(True) if selected is None else selected
    sums = df.agg(
        rows().alias("source_rows"),
        F.count_if(chosen).alias("selected_rows"),
        F.count_if(chosen & ~F.coalesce(F.col(value) >= 0, F.lit(False))).alias("rejected_rows"),
        F.count_if(chosen & (F.col(value) == 0)).alias("zero_rows"),
        F.count_if(chosen & (F.col(value) >= 0)).alias("output_rows"),
    )
    balanced = F.col("selected_rows") == F.col("rejected_rows") + F.col("output_rows")
    return sums.withColumn("balanced", balanced)


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and surplus rows per key (nulls are equal); copies merge before the shuffle."""
    per_key = df.groupBy(*keys).agg(rows().alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def first_duplicate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest key that occurs more than once."""
    return df.groupBy(*keys).agg(rows().alias("row_count")).where("row_count > 1").orderBy(*keys).limit(1)


def not_in(condition: Column) -> Column:
    """Negated test under which a null value counts as failing."""
    return F.coalesce(~condition, F.lit(True))


def impossible_checks() -> dict[str, Column]:
    temperature, direction = F.col("air_temperature"), F.col("wind_direction")
    return {
        "negative_meter_reading": F.col("meter_reading") < 0,
        "nonpositive_square_feet": F.col("square_feet") <= 0,
        "negative_building_id": F.col("building_id") < 0,
        "negative_site_id": F.col("site_id") < 0,
        "invalid_meter_code": not_in(F.col("meter").isin(0, 1, 2, 3)),
        "invalid_timestamp": F.col("timestamp").isNull(),
        "air_temperature_outside_range": not_in(temperature.between(-100, 70)),
        "negative_wind_speed": F.col("wind_speed") < 0,
        "wind_direction_outside_circle": not_in(direction.between(0, 360)),
    }


# The checks that must find nothing.
CORE_CHECKS = [
    "negative_meter_reading",
    "nonpositive_square_feet",
    "negative_building_id",
    "negative_site_id",
    "invalid_meter_code",
    "invalid_timestamp",
]


def impossible_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(n) for n, c in impossible_checks().items()])


def assert_core_possible(df: DataFrame) -> None:
    row = impossible_counts(df).select(*CORE_CHECKS).first().asDict()
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise ValueError(f"impossible core records: {bad}")


def invalid_building_counts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Rows whose area, construction year or floor count cannot be used."""
    year_ok = F.col("year_built").between(F.lit(1800), F.year(ts))
    return df.agg(
        F.count_if(not_in(F.col("square_feet") > 0)).alias("invalid_area_rows"),
        F.count_if(not_in(year_ok)).alias("invalid_year_rows"),
        F.count_if(not_in(F.col("floor_count") > 0)).alias("invalid_floor_rows"),
    )


def validate_observations(df: DataFrame, meter: str, value: str, ts: str, shown: int = 10) -> DataFrame:
    """Counts of rows an electricity feature build must refuse, with up to ten bad meters."""
    wrong = not_in(F.col(meter) == 0)
    counts = df.agg(
        F.count_if(wrong).alias("bad_meter_rows"),
        F.count_if(not_in(F.col(value) >= 0)).alias("bad_target_rows"),
        F.count_if(F.col(ts).isNull()).alias("bad_timestamp_rows"),
    )
    bad = df.where(wrong).select(F.coalesce(F.col(meter).cast("string"), F.lit("null")).alias("m")).distinct()
    listed = [r["m"] for r in bad.orderBy("m").limit(shown).collect()]
    return counts.withColumn("bad_meters", F.lit(",".join(listed)))


def assert_observations(df: DataFrame, meter: str, value: str, ts: str) -> None:
    row = validate_observations(df, meter, value, ts).first()
    if row["bad_meter_rows"]:
        raise ValueError(f"meters other than electricity: {row['bad_meters']}")
    if row["bad_target_rows"] or row["bad_timestamp_rows"]:
        raise ValueError(f"{row['bad_target_rows']} bad targets, {row['bad_timestamp_rows']} bad timestamps")


def conflicts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], rtol: float = 0.0, atol: float = 0.0) -> DataFrame:
    """Keys with more than one known value, per column (optionally within a tolerance)."""
    spread = df.groupBy(*keys).agg(
        *[F.min(c).alias(f"{c}_lo") for c in columns], *[F.max(c).alias(f"{c}_hi") for c in columns]
    )

    def differs(c: str) -> Column:
        low, high = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        if rtol == 0 and atol == 0:
            return low != high
        return (high - low) > F.lit(atol) + F.lit(rtol) * F.greatest(F.abs(low), F.abs(high))

    return spread.agg(*[F.count_if(differs(c)).alias(c) for c in columns])


def first_non_null(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Column) -> DataFrame:
    """Earliest known value of each column per key; partial aggregates, no window."""
    return df.groupBy(*keys).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    )


def check_contract(
    df: DataFrame,
    ordered: Sequence[str],
    forbidden: Sequence[str] = (),
    rows: int | None = None,
    types: T.StructType | None = None,
) -> DataFrame:
    """Contract violations as rows (rule, detail); an empty result is a pass."""
    found: list[tuple[str, str]] = []
    for c in ordered:
        if c not in df.columns:
            found.append(("missing_column", c))
    for c in forbidden:
        if c in df.columns:
            found.append(("forbidden_column", c))
    if not found and list(df.columns) != list(ordered):
        found.append(("column_order", ",".join(df.columns)))
    if types is not None:
        for f in types.fields:
            if f.name in df.columns and df.schema[f.name].dataType != f.dataType:
                found.append(("column_type", f"{f.name} {df.schema[f.name].dataType.simpleString()}"))
    if rows is not None:
        have = df.count()
        if have != rows:
            found.append(("row_count", f"{have} for {rows}"))
    return df.sparkSession.createDataFrame(found, "rule string, detail string")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` not in ``b``."""
    return a.subtract(b)


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with both numbers.

    Copies are counted per side first, so a row repeated any number of times
    moves as one counted row.
    """
    left = a.select(*a.columns, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    right = b.select(*a.columns, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    counted = left.unionByName(right).groupBy(*a.columns).agg(
        F.sum("_a").alias("copies_before"), F.sum("_b").alias("copies_after")
    )
    return counted.where("copies_before <> copies_after")


def multiset_equal(a: DataFrame, b: DataFrame) -> bool:
    """Equal row multisets; unequal fingerprints settle it before any shuffle."""

    def mark(df: DataFrame):
        h = F.xxhash64(*[F.col(c) for c in a.columns]).cast("decimal(38,0)")
        return df.agg(rows().alias("n"), F.sum(h).alias("h")).first()

    if mark(a) != mark(b):
        return False
    return multiset_diff(a, b).isEmpty()


def unchanged(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Differences between two tables on the columns that must not change."""
    return multiset_diff(before.select(*columns), after.select(*columns))


def leakage_check(df: DataFrame, features: Callable[[DataFrame], DataFrame], target: str) -> DataFrame:
    """Rows of the feature table that change when the target is replaced."""
    changed = df.withColumn(target, (F.col(target) * -3 + 17).cast(df.schema[target].dataType))
    a, b = features(df).drop(target), features(changed).drop(target)
    return multiset_diff(a, b)


def downcast(df: DataFrame) -> DataFrame:
    """Double to float; long to short where the values fit, else to int."""
    longs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)]
    small: set[str] = set()
    if longs:
        ends = df.agg(*[F.min(c).alias(f"{c}_lo") for c in longs], *[F.max(c).alias(f"{c}_hi") for c in longs]).first()
        for c in longs:
            low, high = ends[f"{c}_lo"], ends[f"{c}_hi"]
            if low is not None and low >= -32768 and high <= 32767:
                small.add(c)

    def narrow(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.DoubleType):
            return F.col(f.name).cast("float").alias(f.name)
        if f.name in small:
            return F.col(f.name).cast("short").alias(f.name)
        if isinstance(f.dataType, T.LongType):
            return F.col(f.name).cast("int").alias(f.name)
        return F.col(f.name)

    return df.select(*[narrow(f) for f in df.schema.fields])


def subset_coverage(full: DataFrame, part: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column in a table and in a sample of it."""
    from gridloom.operators.profile import distinct_counts

    a = distinct_counts(full, columns).withColumnRenamed("distinct_values", "full_values")
    b = distinct_counts(part, columns).withColumnRenamed("distinct_values", "subset_values")
    return lookup_join(a, b, ["column_name"])
