"""Weather provider payloads (JSON text) to the seven model fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit factors.
OKTAS_PER_PERCENT_NUM, OKTAS_PER_PERCENT_DEN = 9, 100
MM_PER_INCH = 25.4
FORECAST_HOURS = 3

_RECORD = (
    "struct<dt:double,main:struct<temp:double,dew_point:double,pressure:double,sea_level:double>,"
    "clouds:struct<all:double>,rain:struct<`1h`:double,`3h`:double>,wind:struct<deg:double,speed:double>>"
)


def normalize_weather(df: DataFrame, json_column: str, mode: str = "current") -> DataFrame:
    """Add the model fields, the observation time and ``payload_ok``.

    ``mode`` is ``current`` (rain per hour) or ``forecast`` (first list entry,
    rain per three hours). Anything missing is null. Sea-level pressure falls
    back to ``pressure`` only when its key is absent.
    """
    if mode not in ("current", "forecast"):
        raise ValueError("mode is current or forecast")
    text = F.col(json_column)
    record = text if mode == "current" else F.get_json_object(text, "$.list[0]")
    staged = df.withColumn("_text", record)
    staged = staged.withColumn("_r", F.from_json("_text", _RECORD))
    main_keys = F.coalesce(F.json_object_keys(F.get_json_object("_text", "$.main")), F.array().cast("array<string>"))
    rain: Column = (
        F.col("_r.rain.1h") * (1 / MM_PER_INCH) if mode == "current" else F.col("_r.rain.3h") * (1 / (FORECAST_HOURS * MM_PER_INCH))
    )
    pressure = F.when(F.array_contains(main_keys, "sea_level"), F.col("_r.main.sea_level")).otherwise(F.col("_r.main.pressure"))
    seen = F.timestamp_micros((F.col("_r.dt") * 1_000_000).cast("long"))
    return staged.select(
        *df.columns,
        F.col("_r.main.temp").alias("air_temperature"),
        (F.col("_r.clouds.all") * OKTAS_PER_PERCENT_NUM / OKTAS_PER_PERCENT_DEN).alias("cloud_coverage"),
        F.col("_r.main.dew_point").alias("dew_temperature"),
        rain.alias("precip_depth_1_hr"),
        pressure.alias("sea_level_pressure"),
        F.col("_r.wind.deg").alias("wind_direction"),
        F.col("_r.wind.speed").alias("wind_speed"),
        seen.cast("timestamp_ntz").alias("observation_at"),
        F.lit(mode).alias("mode"),
        F.col("_text").isNotNull().alias("payload_ok"),
    )
