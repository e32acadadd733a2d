"""Sorted tables that give any page for the same cost.

``write_pages`` sorts once over range partitions and keeps, beside the rows, how
many rows lie before each partition. A page is then one or two partitions by
arithmetic, and inside them the row groups that hold its places; page a million
reads as much as page one. Sorting and skipping anew for every page reads the
whole table each time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART, ROW = "gridloom_part", "gridloom_row"
INDEX_SCHEMA = "part int, first long, n long"


def write_pages(df: DataFrame, path: str, order: Sequence[Column], row_group_bytes: int = 8 << 20) -> int:
    """Write ``df`` in the given order and return its number of rows. Refuses an existing path.

    ``order`` must decide between any two different rows (end it with a unique
    column). Small row groups let a page skip most of its partition. The driver
    holds a row per range partition.
    """
    if {PART, ROW} & set(df.columns):
        raise ValueError(f"{PART} and {ROW} are names of the table's own columns")
    spark, root = df.sparkSession, path.rstrip("/")
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias(ROW), F.shiftright("_id", 33).cast("int").alias(PART))
    out = placed.sortWithinPartitions(PART, ROW).write.mode("errorifexists").partitionBy(PART)
    out.option("parquet.block.size", row_group_bytes).parquet(f"{root}/rows")
    rows = _rows(spark, root, df.schema)
    sizes = sorted((r[PART], r["n"]) for r in rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect())
    first = list(accumulate((n for _, n in sizes), initial=0))
    index = spark.createDataFrame([(p, f, n) for (p, n), f in zip(sizes, first)], INDEX_SCHEMA)
    index.coalesce(1).write.parquet(f"{root}/index")
    # last, so that a table whose writing died has no page rather than a wrong one
    spark.createDataFrame([(df.schema.json(), first[-1])], "columns string, n long").coalesce(1).write.parquet(f"{root}/about")
    return first[-1]


def _rows(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    own = [T.StructField(ROW, T.LongType()), T.StructField(PART, T.IntegerType())]
    return spark.read.schema(T.StructType([*schema.fields, *own])).parquet(f"{root}/rows")


def read_range(spark: SparkSession, path: str, first: int, count: int, position: str | None = None) -> DataFrame:
    """Rows at the places first, first + 1, ... (from 0), in order; fewer at the end. ``position`` names a column for the place."""
    if first < 0 or count < 0:
        raise ValueError("places and counts start at 0")
    root = path.rstrip("/")
    about = spark.read.schema("columns string, n long").parquet(f"{root}/about").first()
    schema = T.StructType.fromJson(json.loads(about["columns"]))
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{root}/index")
    inside = (F.col("first") < first + count) & (F.col("first") + F.col("n") > first)
    hit = index.where(inside).collect() if count else []
    rows = _rows(spark, root, schema)
    parts = F.lit(False)
    place = F.lit(None).cast("long")
    for r in hit:
        low, high = max(0, first - r["first"]), min(r["n"], first + count - r["first"])
        here = F.col(PART) == r["part"]
        parts = parts | (here & (F.col(ROW) >= low) & (F.col(ROW) < high))
        place = F.when(here, F.col(ROW) + r["first"]).otherwise(place)
    own = [place.alias(position)] if position else []
    return rows.where(parts).orderBy(PART, ROW).select(*[F.col(f"`{f.name}`") for f in schema], *own)


def read_page(spark: SparkSession, path: str, number: int, size: int = 8, position: str | None = None) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows; pages beyond the last are empty."""
    if number < 1 or size < 1:
        raise ValueError("pages count from 1 and hold a row at least")
    return read_range(spark, path, (number - 1) * size, size, position)


def page_count(spark: SparkSession, path: str, size: int = 8) -> int:
    n = spark.read.schema("columns string, n long").parquet(f"{path.rstrip('/')}/about").first()["n"]
    return -(-n // size)
