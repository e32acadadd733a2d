"""Whole builds on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.operators import features as ft
from gridloom.plans import build
from gridloom.schemas import WEATHER_COLUMNS
from tests.test_cases import merged  # noqa: F401

T0 = dt.datetime(2016, 1, 1)
END = "2016-08-31 23:59:59"


def test_feature_build_checks_and_refuses_a_second_run(spark, merged, tmp_path):  # noqa: F811
    out = str(tmp_path / "features")
    audit = build.build_electricity_features(merged, out, END).first()
    assert (audit.output_rows, audit.zero_targets, audit.unresolved_weather_rows) == (4, 1, 0)
    written = spark.read.parquet(out)
    assert len(written.columns) == 49 and written.count() == 4
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        build.build_electricity_features(merged, out, END)
    assert build.build_electricity_features(merged, out, END, overwrite=True, rows=3).first().output_rows == 3


def test_failed_checks_leave_nothing(merged, tmp_path):  # noqa: F811
    out = tmp_path / "never"
    with pytest.raises(ValueError):
        build.build_electricity_features(merged.withColumn("meter", F.lit(2)), str(out), END)
    assert not out.exists()


def test_conflicting_weather_stops_the_build(merged, tmp_path):  # noqa: F811
    out = tmp_path / "never"
    row = merged.where("air_temperature IS NOT NULL AND site_id IS NOT NULL").limit(1)
    other = row.withColumns({"air_temperature": F.col("air_temperature") + 1, "building_id": F.col("building_id") + 1000})
    with pytest.raises(ValueError, match="conflicting weather: {'air_temperature': 1}"):
        build.build_electricity_features(merged.unionByName(other), str(out), END)
    assert not out.exists()


@pytest.fixture(scope="module")
def raw(spark):
    hours = [T0 + dt.timedelta(hours=h) for h in range(0, 1500, 30)]
    readings = spark.createDataFrame(
        [(b, m, t, float(i % 9) if m else float(i % 7 - 1)) for i, t in enumerate(hours) for b in (1, 2, 3) for m in (0, 1)],
        "building_id int, meter int, timestamp timestamp_ntz, meter_reading double",
    )
    buildings = spark.createDataFrame(
        [(0, 1, "Office", 1000, 1990.0, None), (0, 2, "Office", 2000, None, 3.0), (1, 3, "School", 500, 1950.0, 1.0)],
        "site_id int, building_id int, primary_use string, square_feet int, year_built double, floor_count double",
    )
    weather = spark.createDataFrame(
        [(s, t, *[None if (i + j) % 4 == 0 else float(i + j) for j in range(7)]) for s in (0, 1) for i, t in enumerate(hours) if i % 5],
        "site_id int, timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in WEATHER_COLUMNS),
    )
    return readings, buildings, weather


def test_electricity_build(spark, raw, tmp_path):
    readings, buildings, weather = raw
    out = str(tmp_path / "e")
    audit = build.build_electricity(readings, buildings, weather, out, END).first()
    expected = readings.where("meter = 0 and meter_reading >= 0")
    assert audit.output_rows == expected.count()
    assert audit.zero_targets == expected.where("meter_reading = 0").count()
    assert "meter" not in spark.read.parquet(out).columns


def test_v1_build(spark, raw, tmp_path):
    readings, buildings, weather = raw
    kept = readings.where("meter_reading >= 0")
    out = str(tmp_path / "v1")
    assert build.build_v1(kept, buildings, weather, out).first().output_rows == kept.count()
    written = spark.read.parquet(out)
    assert written.columns == [*ft.RAW_COLUMNS, *ft.features_v1_columns()]
    nulls = written.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in written.columns]).first().asDict()
    assert not any(nulls.values())
    with pytest.raises(ValueError):
        build.build_v1(readings, buildings, weather, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        build.build_v1(kept, buildings.unionByName(buildings), weather, str(tmp_path / "bad"))
