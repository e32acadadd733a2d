"""Declared table types and column contracts."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _I = T.DoubleType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


# Names and order of the published tables.
WEATHER_COLUMNS = [
    "air_temperature",
    "cloud_coverage",
    "dew_temperature",
    "precip_depth_1_hr",
    "sea_level_pressure",
    "wind_direction",
    "wind_speed",
]

READINGS = _struct(building_id=_I, meter=T.ByteType(), timestamp=T.TimestampNTZType(), meter_reading=_D)
BUILDINGS = _struct(
    site_id=_I, building_id=_I, primary_use=T.StringType(), square_feet=_I, year_built=_D, floor_count=_D
)
WEATHER = T.StructType(
    [T.StructField("site_id", _I), T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(c, _D) for c in WEATHER_COLUMNS]
)
ENERGY_RECORDS = _struct(
    id=T.LongType(),
    meter_id=T.LongType(),
    timestamp=T.TimestampType(),
    consumption_kwh=_D,
    voltage=_D,
    current=_D,
    power=_D,
    power_factor=_D,
    source=T.StringType(),
    is_valid=T.BooleanType(),
)
METERS = _struct(
    id=T.LongType(),
    meter_id=T.StringType(),
    name=T.StringType(),
    location=T.StringType(),
    capacity_kw=_D,
    meter_type=T.StringType(),
    owner_id=T.LongType(),
    is_active=T.BooleanType(),
)
PREDICTIONS = _struct(
    id=T.LongType(),
    meter_id=T.LongType(),
    model_id=T.LongType(),
    horizon=T.StringType(),
    predicted_at=T.TimestampType(),
    target_start=T.TimestampType(),
    target_end=T.TimestampType(),
    predicted_kwh=_D,
    actual_kwh=_D,
    confidence=_D,
)
ANOMALIES = _struct(
    id=T.LongType(),
    meter_id=T.LongType(),
    timestamp=T.TimestampType(),
    detected_at=T.TimestampType(),
    anomaly_type=T.StringType(),
    severity=T.StringType(),
    actual_kwh=_D,
    expected_kwh=_D,
    deviation_pct=_D,
    description=T.StringType(),
    is_resolved=T.BooleanType(),
)
ALERT_CONFIGS = _struct(
    user_id=T.LongType(),
    meter_id=T.LongType(),
    threshold_kwh=_D,
    email_enabled=T.BooleanType(),
    sms_enabled=T.BooleanType(),
    is_enabled=T.BooleanType(),
)
MODEL_REGISTRY = _struct(
    name=T.StringType(),
    version=T.StringType(),
    algorithm=T.StringType(),
    horizon=T.StringType(),
    status=T.StringType(),
    metrics=T.MapType(T.StringType(), _D),
    artifact_path=T.StringType(),
    trained_at=T.TimestampType(),
)
