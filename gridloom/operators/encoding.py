"""Target statistics as codes of categories, without a row seeing its own target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.scale import _range_sorted, lookup_join

SEED = 42


def _category(column: str) -> list[Column]:
    """The category as a text and whether it is known: a null is a category of its own."""
    return [F.coalesce(F.col(column).cast("string"), F.lit("")).alias("_cat"), F.col(column).isNotNull().alias("_known")]


def seeded(key: str, seed: int) -> Column:
    """A place in the seeded order: 16 hex digits of the SHA-256 of seed and key."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), 1, 16)


def target_prior(df: DataFrame, target: str) -> float:
    return float(df.agg(F.avg(F.col(target).cast("double")).alias("m")).first()["m"] or 0.0)


def ordered_target_codes(
    df: DataFrame, key: str, category: str, target: str, seed: int = SEED, weight: float = 1.0, prior: float | None = None, name: str = "code"
) -> DataFrame:
    """(key, code): the mean target of earlier rows of the same category in a seeded order.

    The order of the rows is that of a hash of ``key`` (unique) and ``seed``. The
    prior, by default the mean target of all rows, counts as ``weight`` rows, so a
    category's first row gets the prior. A row without target gets a code and adds
    nothing; a null category is a category.

    Rows are sorted by category and hash over range partitions, so a category
    with most of the rows is cut over as many tasks as it fills. Running sums are
    taken inside a partition; what lies in earlier partitions is one row per
    partition and category.
    """
    prior = target_prior(df, target) if prior is None else prior
    slim = df.select(F.col(key), *_category(category), seeded(key, seed).alias("_hash"), F.col(target).cast("double").alias("_y"))
    ordered = _range_sorted(slim, [F.col(c) for c in ("_known", "_cat", "_hash", key)])
    parts = ordered.groupBy("_known", "_cat", "_pid").agg(F.count("_y").alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("s"))
    earlier = Window.partitionBy("_known", "_cat").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_known", "_cat", "_pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("_s"))
    inside = Window.partitionBy("_known", "_cat", "_pid").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    count = F.col("_n") + F.count("_y").over(inside)
    total = F.col("_s") + F.coalesce(F.sum("_y").over(inside), F.lit(0.0))
    placed = lookup_join(ordered, before, ["_known", "_cat", "_pid"])
    return placed.select(key, ((total + prior * weight) / (count + weight)).alias(name))


def target_codes(train: DataFrame, category: str, target: str, weight: float = 1.0, prior: float | None = None, name: str = "code") -> DataFrame:
    """(_known, _cat, code) from all rows of ``train``, for rows that are not in it."""
    prior = target_prior(train, target) if prior is None else prior
    y = F.col(target).cast("double")
    sums = train.groupBy(*_category(category)).agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("s"), F.count(y).alias("n"))
    return sums.select("_known", "_cat", ((F.col("s") + prior * weight) / (F.col("n") + weight)).alias(name))


def apply_target_codes(df: DataFrame, codes: DataFrame, category: str, prior: float, name: str = "code") -> DataFrame:
    """``df`` with the code of its category, the prior for categories that were never seen."""
    cat, known = _category(category)
    found = lookup_join(df.withColumns({"_cat": cat, "_known": known}), codes.select("_known", "_cat", name), ["_known", "_cat"])
    return found.withColumn(name, F.coalesce(name, F.lit(prior))).drop("_known", "_cat")
