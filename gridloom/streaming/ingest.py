"""Streaming ingest, daily profiles and anomaly detection per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.anomaly import check_settings, mad_anomalies
from gridloom.operators.joins import first_row
from gridloom.operators.scale import has_key


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    """Parquet folder as a stream; naive times become instants, as watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.parquet(path)
    naive = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def clean_stream(source: DataFrame, meter: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Arrival time for missing times, then one row per meter and time within the delay."""
    timed = source.withColumn(ts, F.coalesce(F.col(ts), F.current_timestamp()))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([meter, ts])


def ingest_stream(source: DataFrame, meter: str, ts: str, out: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Append cleaned readings to Parquet, exactly once per checkpoint."""
    return (
        clean_stream(source, meter, ts, delay)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def daily_stream(source: DataFrame, ts: str, value: str, delay: str = "1 hour") -> DataFrame:
    """Sum, count and mean per calendar day; rows later than the delay are dropped."""
    day = F.window(F.col(ts), "1 day")
    sums = source.withWatermark(ts, delay).groupBy(day.alias("w")).agg(
        F.sum(value).alias("total"), F.count(value).alias("row_count"), F.avg(value).alias("mean")
    )
    return sums.select(F.col("w.start").alias("period"), "total", "row_count", "mean")


def start_append(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_anomalies(
    source: DataFrame,
    key: str,
    ts: str,
    value: str,
    store: str,
    checkpoint: str,
    history: DataFrame | None = None,
    threshold: float = 3.5,
    kept: str | None = None,
    records: int | None = None,
) -> StreamingQuery:
    """Detect per micro-batch against the history and append only new (meter, time) rows.

    The history grows: each batch adds its readings to the folder ``kept``, and
    all readings of the meters in the batch seen so far, with those of
    ``history``, give the medians; ``records`` keeps only the newest of each
    meter. Without ``kept`` a batch is judged with
    ``history`` alone. A batch that runs twice adds nothing the second time:
    its readings and its anomalies go to folders of their own, replaced on a
    rerun, and it does not see those of later batches.
    """
    check_settings(threshold, records)
    spark = source.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(key, ts, value)
        if kept:
            rows.write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")
            rows = spark.read.schema(rows.schema).parquet(f"{kept}/batch={batch_id}")
        meters = rows.select(key).distinct()
        known = rows
        if history is not None:
            known = known.unionByName(has_key(history.select(key, ts, value), meters, [key]))
        if kept and batch_id:
            whole = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])
            earlier = spark.read.schema(whole).parquet(kept).where(F.col("batch") < batch_id).drop("batch")
            known = known.unionByName(has_key(earlier, meters, [key]))
        if records is not None:
            newest = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(value))
            known = known.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= records).drop("_place")
        found = mad_anomalies(known, key, ts, value, threshold).drop("score")
        fresh = first_row(found, [key, ts], [F.col("actual_kwh")])
        earlier = stored_anomalies(spark, store, fresh.schema, before=batch_id)
        fresh = has_key(fresh, earlier.select(key, ts), [key, ts], present=False)
        fresh.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return (
        source.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_anomalies(spark: SparkSession, store: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Stored anomalies, optionally only those of earlier batches; empty before the first."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    df = spark.read.schema(full).parquet(store) if exists else spark.createDataFrame([], full)
    return (df if before is None else df.where(F.col("batch") < before)).drop("batch")
