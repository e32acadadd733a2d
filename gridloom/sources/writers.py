"""Sinks. Output is written aside and swapped in, so a failed overwrite keeps the old table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _not_own_input(df: DataFrame, path: str) -> None:
    target = path.rstrip("/")
    sources = {f.split(":", 1)[-1].lstrip("/") for f in df.inputFiles()}
    if any(s == target.lstrip("/") or s.startswith(target.lstrip("/") + "/") for s in sources):
        raise ValueError("the output path is one of the inputs")


def _store(df: DataFrame, path: str, overwrite: bool, write: Callable[[str], None]) -> None:
    """Run ``write`` on ``path``, or with ``overwrite`` beside it and swap by renaming; the old output goes last."""
    if not overwrite:
        write(path)
        return
    _not_own_input(df, path)
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    target, tag = path.rstrip("/"), uuid.uuid4().hex
    new, old = place(f"{target}.new-{tag}"), place(f"{target}.old-{tag}")
    files = new.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(new.toString())
        if files.exists(place(target)) and not files.rename(place(target), old):
            raise OSError(f"{target} can't be moved aside")
        if not files.rename(new, place(target)):
            files.rename(old, place(target))
            raise OSError(f"{target} can't be replaced")
    finally:
        files.delete(new, True)
    files.delete(old, True)


def write_table(df: DataFrame, path: str, overwrite: bool = False, sort: Sequence[str] = ()) -> None:
    """Snappy Parquet. Refuses an existing output unless told to replace it, and its own input."""
    out = df.sortWithinPartitions(*sort) if sort else df
    _store(df, path, overwrite, out.write.option("compression", "snappy").parquet)


def by_partition(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of one partition together, in tasks of a like size.

    A partition above ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` is cut
    over several tasks and small ones share a task, both from measured bytes, so
    the number of files follows the rows and not tasks times partitions.
    """
    return df.hint("rebalance", *[F.col(f"`{c}`") for c in columns])


def write_partitioned(df: DataFrame, path: str, site: str, ts: str, overwrite: bool = False, files: int | None = None) -> None:
    """Parquet by site and month.

    Rows of one site and month are written by as many tasks as their bytes ask
    for, or are spread over ``files`` tasks by a hash of the row, so a site with
    most of the rows is not written by one task.
    """
    month = F.date_format(F.col(ts), "yyyyMM")
    marked = df.withColumn("month", month)
    if files:
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files))
        marked = marked.repartition(site, "month", spread)
    else:
        marked = by_partition(marked, [site, "month"])
    _store(df, path, overwrite, marked.write.partitionBy(site, "month").option("compression", "snappy").parquet)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    _store(df, path, overwrite, df.write.option("header", True).csv)


def export_report(df: DataFrame, path: str, columns: dict[str, Column], overwrite: bool = False) -> None:
    """Report export: a fixed column list, nulls as empty fields, a header line."""
    text = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in columns.items()]
    _store(df, path, overwrite, df.select(*text).write.option("header", True).option("emptyValue", "").csv)


def write_stats(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Audit figures as JSON lines; nulls are written out."""
    _store(df, path, overwrite, df.write.option("ignoreNullFields", "false").json)
