"""Typed scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom import schemas
from gridloom.functions.numeric import nan_to_null


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan that reads only the named columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def without_nan(df: DataFrame) -> DataFrame:
    """NaN in any floating column is a missing value."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floating})


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, time_column: str = "timestamp") -> DataFrame:
    """CSV scan with a declared schema.

    Time text that is no timestamp becomes null and is flagged in
    ``bad_timestamp`` so it can be counted. NaN text becomes null.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType() if f.name == time_column else f.dataType) for f in schema])
    df = without_nan(spark.read.schema(raw).option("header", True).csv(path))
    parsed = F.expr(f"try_cast(`{time_column}` AS TIMESTAMP_NTZ)")
    return df.withColumn("bad_timestamp", F.col(time_column).isNotNull() & parsed.isNull()).withColumn(time_column, parsed)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_typed(spark, path, schemas.READINGS)


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    return without_nan(spark.read.schema(schemas.BUILDINGS).option("header", True).csv(path))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_typed(spark, path, schemas.WEATHER)


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """Relational table read in ``parts`` key ranges, so no single task pulls it whole."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts)
        .load()
    )


def limit_rows(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """First ``n`` rows in a stated order (a row cap asked for by the caller)."""
    return df.orderBy(*order).limit(n)
