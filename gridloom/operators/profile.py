"""Aggregate profiles of a table: counts, moments, quantiles, time profiles."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.numeric import pct
from gridloom.operators.scale import group_medians, group_quantiles, lookup_join, running_sum
from gridloom.session import materialize

def rows() -> Column:
    return F.count(F.lit(1))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def per_column(df: DataFrame, columns: Sequence[str], measures: dict, label: str = "column_name") -> DataFrame:
    """One aggregate over all columns, then one output row per column.

    ``measures`` maps an output name to a function from column name to an
    aggregate expression.
    """
    aggs = [fn(c).alias(f"{i}_{m}") for i, c in enumerate(columns) for m, fn in measures.items()]
    wide = df.agg(*aggs)
    entries = [
        F.struct(F.lit(c).alias(label), *[F.col(f"{i}_{m}").alias(m) for m in measures]) for i, c in enumerate(columns)
    ]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column in one pass; values are combined before they move."""
    return per_column(df, columns, {"distinct_values": lambda c: F.count_distinct(c)})


def null_profile(df: DataFrame) -> DataFrame:
    """Missing count and share, distinct values (null counts as one) and type per column."""
    stats = per_column(
        df,
        df.columns,
        {
            "row_count": lambda c: F.count(F.lit(1)),
            "missing": lambda c: F.count_if(F.col(c).isNull()),
            "distinct_values": lambda c: F.count_distinct(c),
        },
    )
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return stats.select(
        "column_name",
        types[F.col("column_name")].alias("data_type"),
        "missing",
        pct(F.col("missing"), F.col("row_count")).alias("missing_pct"),
        (F.col("distinct_values") + F.when(F.col("missing") > 0, 1).otherwise(0)).alias("distinct_values"),
    )


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value, null counting as a value."""
    stats = per_column(
        df,
        df.columns,
        {
            "missing": lambda c: F.count_if(F.col(c).isNull()),
            "differs": lambda c: F.min(c) != F.max(c),
            "filled": lambda c: F.count(c),
        },
    )
    same = ~F.coalesce(F.col("differs"), F.lit(False)) & ((F.col("missing") == 0) | (F.col("filled") == 0))
    return stats.where(same).select("column_name")


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, population deviation and range per numeric column."""
    return per_column(
        df,
        list(columns or numeric_columns(df)),
        {
            "filled": lambda c: F.count(c),
            "mean": lambda c: F.avg(c),
            "std": lambda c: F.stddev_pop(c),
            "minimum": lambda c: F.min(F.col(c).cast("double")),
            "maximum": lambda c: F.max(F.col(c).cast("double")),
        },
    )


# The percentiles of the published description.
DESCRIBE_POINTS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def describe_pct(df: DataFrame, column: str) -> DataFrame:
    points = group_quantiles(df, [], column, DESCRIBE_POINTS).first()
    stats = df.agg(
        F.count(column).alias("filled"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("minimum"),
        F.max(column).alias("maximum"),
    )
    return stats.select("*", *[F.lit(points[n]).alias(n) for n in DESCRIBE_POINTS])


def corrected_skewness(column: str) -> Column:
    """Sample skewness; the built-in one is the population value.

    Null below three rows, zero for a constant column.
    """
    n = F.count(column).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n > 2, F.coalesce(F.skewness(column) * factor, F.lit(0.0)))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    points = group_quantiles(df, [], target, {"median": 0.5, "p99": 0.99}).first()
    zero = F.count_if(F.col(target) == 0)
    return df.agg(
        F.avg(target).alias("mean"),
        F.stddev_pop(target).alias("std"),
        F.min(target).alias("minimum"),
        F.max(target).alias("maximum"),
        zero.alias("zero_count"),
        pct(zero, rows()).alias("zero_pct"),
        corrected_skewness(target).alias("skewness"),
    ).select("*", F.lit(points["median"]).alias("median"), F.lit(points["p99"]).alias("p99"))


def skewness_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_column(df, columns, {"skewness": corrected_skewness})


def entity_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = distinct_counts(df, columns)
    return counts.withColumnRenamed("column_name", "entity")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(rows().alias("row_count"))


def usage(value: str) -> list[Column]:
    return [F.sum(value).alias("total"), F.count(value).alias("row_count"), F.avg(value).alias("mean")]


def usage_by(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(*usage(value))


def time_profile(df: DataFrame, ts: str, value: str, grain: str, fill: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Sum, count and mean per hour of day, calendar day or month, of each ``by`` where given.

    ``fill`` adds the days without rows (null mean), as resampling would, between the first and last of each ``by``.
    """
    if grain == "hour":
        return df.groupBy(*by, F.hour(ts).alias("period")).agg(*usage(value))
    period = F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz")
    found = df.groupBy(*by, period.alias("period")).agg(*usage(value))
    if not fill:
        return found
    step = F.expr("INTERVAL 1 DAY") if grain == "day" else F.expr("INTERVAL 1 MONTH")
    ends = df.groupBy(*by).agg(F.min(period).alias("a"), F.max(period).alias("b"))
    spine = ends.select(*by, F.explode(F.sequence("a", "b", step)).alias("period"))
    if not by:
        whole = spine.join(found, "period", "left")
    else:
        # null is a group of its own
        spine = spine.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("period").alias("_period"))
        same = F.col("_period") == F.col("period")
        for c in by:
            same = same & F.col(f"_{c}").eqNullSafe(F.col(c))
        whole = spine.join(found, same, "left").drop(*by, "period").withColumnsRenamed({f"_{c}": c for c in (*by, "period")})
    return whole.withColumn("row_count", F.coalesce("row_count", F.lit(0)))


def median_by(df: DataFrame, by: str, value: str) -> DataFrame:
    return group_medians(df.where(F.col(value).isNotNull()), [by], [value]).withColumnRenamed(value, "median")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every column pair over the rows where both are known.

    All pairs share one pass: value pairs are counted, each side's values get
    average ranks from a running count, and weighted moments give the result.
    """
    pairs = list(combinations(columns, 2))
    cells = (
        df.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("pair"),
                            F.col(a).cast("double").alias("x"),
                            F.col(b).cast("double").alias("y"),
                        )
                        for i, (a, b) in enumerate(pairs)
                    ]
                )
            ).alias("e")
        )
        .select("e.*")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("pair", "x", "y")
        .agg(rows().alias("w"))
    )
    sides = F.array(
        F.struct(F.lit("x").alias("side"), F.col("x").alias("v")), F.struct(F.lit("y").alias("side"), F.col("y").alias("v"))
    )
    values = (
        cells.select("pair", "w", F.explode(sides).alias("e"))
        .groupBy("pair", "e.side", "e.v")
        .agg(F.sum("w").alias("c"))
    )
    ranked = running_sum(values, ["pair", "side", "v"], "c", "before")
    starts = ranked.groupBy("pair", "side").agg(F.min("before").alias("start"))
    ranked = lookup_join(ranked, starts, ["pair", "side"]).withColumn(
        "rank", F.col("before") - F.col("start") + (F.col("c") + 1) / 2
    )
    rank_x = ranked.where("side = 'x'").select("pair", F.col("v").alias("x"), F.col("rank").alias("rx"))
    rank_y = ranked.where("side = 'y'").select("pair", F.col("v").alias("y"), F.col("rank").alias("ry"))
    both = lookup_join(lookup_join(cells, rank_x, ["pair", "x"]), rank_y, ["pair", "y"])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    sums = both.groupBy("pair").agg(
        F.sum(w).cast("double").alias("n"),
        F.sum(w * rx).alias("sx"),
        F.sum(w * ry).alias("sy"),
        F.sum(w * rx * rx).alias("sxx"),
        F.sum(w * ry * ry).alias("syy"),
        F.sum(w * rx * ry).alias("sxy"),
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = F.sqrt((n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy))
    first = F.element_at(F.array(*[F.lit(a) for a, _ in pairs]), F.col("pair") + 1)
    second = F.element_at(F.array(*[F.lit(b) for _, b in pairs]), F.col("pair") + 1)
    return sums.select(
        first.alias("first_column"),
        second.alias("second_column"),
        F.col("n").cast("long").alias("row_count"),
        ((n * F.col("sxy") - sx * sy) / F.nullif(spread, F.lit(0.0))).alias("spearman"),
    )


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Rows per equal-width bin, empty bins included; the last bin is closed, a constant column lies mid-range."""
    known = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    ends = known.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    if ends["a"] is None:
        return known.select(F.lit(0).alias("bin"), F.lit(0.0).alias("bin_start"), F.lit(0).cast("long").alias("row_count")).limit(0)
    low, width = ends["a"], ends["b"] - ends["a"]
    if width == 0:
        low, width = low - 0.5, 1.0
    place = F.least(F.floor((F.col("v") - low) / width * bins), F.lit(bins - 1)).cast("int")
    counted = known.groupBy(place.alias("bin")).agg(rows().alias("row_count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # at most ``bins`` rows on both sides
    whole = every.join(counted, "bin", "left")
    start = F.lit(low) + F.col("bin") * F.lit(width / bins)
    return whole.select("bin", start.alias("bin_start"), F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"))


def box_summary(df: DataFrame, by: str, value: Column) -> DataFrame:
    """Quartiles and the outermost values within 1.5 quartile ranges, per group."""
    slim = df.select(by, value.alias("v")).where(F.col("v").isNotNull() & F.col(by).isNotNull())
    quartiles = materialize(group_quantiles(slim, [by], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}), "quartiles")
    joined = lookup_join(slim, quartiles, [by])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    return joined.groupBy(by).agg(
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("high_whisker"),
    )


def time_coverage(df: DataFrame, ts: str, hour: str) -> DataFrame:
    """Range, expected hours, hours seen and null timestamps."""
    hours = df.where(F.col(hour).isNotNull()).groupBy(hour).agg(
        rows().alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b")
    )
    seen = hours.agg(F.min("a").alias("first_time"), F.max("b").alias("last_time"), rows().alias("observed_hours"))
    nulls = int(df.agg(F.count_if(F.col(ts).isNull()).alias("n")).first()["n"])
    span = F.unix_seconds(F.col("last_time").cast("timestamp")) - F.unix_seconds(F.col("first_time").cast("timestamp"))
    return seen.select(
        "first_time",
        "last_time",
        (F.floor(span / 3600) + 1).alias("expected_hours"),
        "observed_hours",
        F.lit(nulls).cast("long").alias("null_timestamps"),
    )


def feature_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_column(
        df,
        columns,
        {
            "minimum": lambda c: F.min(F.col(c).cast("double")),
            "maximum": lambda c: F.max(F.col(c).cast("double")),
        },
        "feature",
    )


def nan_inf_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing (null or NaN) and infinite values per numeric column."""

    def number(c: str) -> Column:
        return F.col(c).cast("double")

    return per_column(
        df,
        columns,
        {
            "missing": lambda c: F.count_if(F.col(c).isNull() | F.isnan(number(c))),
            "infinite": lambda c: F.count_if(F.abs(number(c)) == F.lit(float("inf"))),
        },
        "feature",
    )


def category_cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return distinct_counts(df, columns)


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and surplus copies per table."""
    from gridloom.operators.quality import duplicate_count

    parts = None
    for name, df in tables.items():
        row = duplicate_count(df, df.columns).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            F.col("duplicate_rows"),
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts


def union_partials(partials: Sequence[DataFrame], keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Concatenate partial aggregates and add them up again."""
    stacked = partials[0]
    for part in partials[1:]:
        stacked = stacked.unionByName(part)
    return stacked.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
