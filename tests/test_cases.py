"""Hand-checkable cases: small tables with known answers."""

from __future__ import annotations

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import features as ft
from gridloom.operators import impute as im
from gridloom.operators import joins as jn
from gridloom.operators import metrics as mt
from gridloom.operators import quality as qa
from gridloom.operators import validation as vd
from gridloom.operators.anomaly import check_settings, detect_and_store, mad_anomalies
from gridloom.operators.outlook import forecast_steps, peak_outlook
from gridloom.schemas import WEATHER_COLUMNS
from gridloom.sources.weather_payload import normalize_weather

T0 = dt.datetime(2016, 1, 1)
MERGED = (
    "building_id int, meter int, timestamp timestamp_ntz, meter_reading double, site_id int, primary_use string, square_feet double, "
    "year_built double, floor_count double, " + ", ".join(f"{c} double" for c in WEATHER_COLUMNS)
)


@pytest.fixture(scope="module")
def merged(spark):
    none = [None] * 7
    rows = [
        (1, 0, T0, 0.0, 0, "Education", 1000.0, 2000.0, 2.0, *none),
        (1, 0, T0 + dt.timedelta(hours=1), 10.0, 0, "Education", 1000.0, 2000.0, 2.0, 20.0, 2.0, 10.0, 0.0, 1010.0, 90.0, 2.0),
        (2, 0, dt.datetime(2016, 3, 5, 12), 20.0, 1, "Office", None, 2020.0, 0.0, 25.0, 3.0, 15.0, 1.0, 1011.0, 180.0, 3.0),
        (2, 0, dt.datetime(2016, 7, 2, 23), 30.0, 1, "Office", None, 2020.0, 0.0, 30.0, 4.0, 20.0, 0.0, 1012.0, 270.0, 4.0),
    ]
    return spark.createDataFrame(rows, MERGED)


@pytest.fixture(scope="module")
def featured(merged):
    return ft.electricity_features(merged.fillna(1.0, WEATHER_COLUMNS)).orderBy("timestamp").collect()


def test_calendar(featured):
    first, _, spring, summer = featured
    assert (first.year, first.quarter, first.week_of_year, first.weekday, first.season) == (2016, 1, 53, 4, "winter")
    assert first.hour_sin == 0 and first.hour_cos == 1
    assert (spring.season, summer.season) == ("spring", "summer")


def test_strict_building_features(featured):
    assert featured[0].building_age == 16
    assert featured[2].building_age is None and featured[2].log_square_feet is None and featured[2].area_per_floor is None


def test_feature_table_has_49_columns(merged):
    out = ft.electricity_features(merged)
    assert len(out.columns) == 49 and "meter" not in out.columns
    assert len(ft.features_v1(merged).columns) == 46
    assert ft.features_v1(merged, target=False).columns == [c for c in ft.features_v1(merged).columns if c != "meter_reading"]


def test_target_never_leaks(merged):
    assert qa.leakage_check(merged, ft.electricity_features, "meter_reading").isEmpty()
    leaking = qa.leakage_check(merged, lambda d: d.withColumn("x", F.col("meter_reading") * 2), "meter_reading")
    assert leaking.count() > 0


def test_forbidden_predictors(merged):
    assert "meter" not in ft.predictors(merged) and "meter_reading" not in ft.predictors(merged)
    with pytest.raises(ValueError):
        ft.assert_predictors(["square_feet", "meter"])


def test_causal_fill_uses_training_medians_only_without_history(spark, merged):
    spine = im.weather_spine(merged.where("site_id = 0"), "site_id", "timestamp", WEATHER_COLUMNS)
    site = spark.createDataFrame([(0, *[7.0] * 7)], "site_id int, " + ", ".join(f"{c} double" for c in WEATHER_COLUMNS))
    out = im.ffill_causal(spine, "site_id", "timestamp", WEATHER_COLUMNS, site, dict.fromkeys(WEATHER_COLUMNS, 9.0))
    first, second = out.orderBy("timestamp").collect()
    assert first.air_temperature == 7.0 and first.air_temperature_missing == 1
    assert second.air_temperature == 20.0 and second.air_temperature_missing == 0


def test_empty_training_period_is_an_error(merged):
    with pytest.raises(ValueError):
        im.fit_weather(merged, "site_id", "timestamp", WEATHER_COLUMNS, "2015-01-01 00:00:00")


def test_interpolation(spark):
    values = [None, 1.0, None, None, 4.0, None]
    days = [0, 1, 30, 31, 45, 100]
    rows = [(s, T0 + dt.timedelta(days=d), v, None if s == 2 else v) for s in (1, 2) for d, v in zip(days, values)]
    df = spark.createDataFrame(rows, "s int, t timestamp_ntz, a double, b double")
    out = im.interpolate(df, "s", "t", ["a", "b"]).orderBy("s", "t").collect()
    assert [r.a for r in out] == [1, 1, 2, 3, 4, 4] * 2
    assert [r.b for r in out[6:]] == [2.5] * 6


def test_static_median_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 4.0), (3, "a", None), (4, "b", None)], "b int, u string, y double")
    got = {r.b: r.y for r in im.impute_static(df, "u", ["y"]).collect()}
    assert got == {1: 1.0, 2: 4.0, 3: 2.0, 4: 2.0}


HISTORY = "meter_id long, timestamp timestamp_ntz, consumption_kwh double"


def hourly(values, meter=1):
    return [(meter, T0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)]


def test_spike(spark):
    df = spark.createDataFrame(hourly([10.0, 10.0, 11.0, 9.0, 10.0, 100.0]) + hourly([5.0] * 4, 2), HISTORY)
    (row,) = mad_anomalies(df, "meter_id", "timestamp", "consumption_kwh").collect()
    assert (row.anomaly_type, row.severity, row.actual_kwh, row.expected_kwh) == ("spike", "high", 100.0, 10.0)
    assert row.deviation_pct == pytest.approx(900)
    assert row.description == f"Robust deviation score: {90 / 0.7413:.2f}."
    same = mad_anomalies(df, "meter_id", "timestamp", "consumption_kwh", rows_in_task=0).collect()
    assert same == [row]


def test_detection_is_idempotent(spark):
    df = spark.createDataFrame(hourly([10.0, 10.0, 11.0, 9.0, 10.0, 100.0]), HISTORY)
    empty = mad_anomalies(df, "meter_id", "timestamp", "consumption_kwh").drop("score").limit(0)
    once, counts = detect_and_store(df, empty, "meter_id", "timestamp", "consumption_kwh")
    assert {r.measure: r.n for r in counts.collect()} == {"examined": 6, "detected": 1, "added": 1}
    kept = spark.createDataFrame(once.collect(), once.schema)
    twice, counts = detect_and_store(df, kept, "meter_id", "timestamp", "consumption_kwh")
    assert twice.count() == 1 and {r.measure: r.n for r in counts.collect()}["added"] == 0
    more = df.unionByName(spark.createDataFrame([(1, T0 + dt.timedelta(hours=9), 1000.0)], HISTORY))
    third, _ = detect_and_store(more, kept, "meter_id", "timestamp", "consumption_kwh")
    assert sorted(r.actual_kwh for r in third.collect()) == [100.0, 1000.0]


def test_setting_bounds():
    for threshold in (0, 10.5):
        with pytest.raises(ValueError):
            check_settings(threshold)
    with pytest.raises(ValueError):
        check_settings(3.5, 2)


@pytest.mark.parametrize("horizon,kwh,hours", [(1, 10, 4), (3, 14, 6)])
def test_peak(spark, horizon, kwh, hours):
    df = spark.createDataFrame(hourly([2.0, 4.0, 6.0, 8.0]), HISTORY)
    (row,) = peak_outlook(df, "meter_id", "timestamp", "consumption_kwh", horizon).collect()
    assert row.forecast_kwh == kwh and row.peak_timestamp == T0 + dt.timedelta(hours=hours)
    assert row.history_records == 4 and row.status == "ok" and row.is_peak_likely and row.baseline_kwh == 5
    steps = forecast_steps(df, "meter_id", "timestamp", "consumption_kwh", horizon).orderBy("step").collect()
    assert [s.forecast_kwh for s in steps] == [10.0, 12.0, 14.0][:horizon]


def test_peak_of_three_records_and_ties(spark):
    df = spark.createDataFrame(hourly([2.0, 4.0, 6.0]) + hourly([5.0] * 4, 2) + hourly([9.0, 5.0, 1.0], 3), HISTORY)
    got = {r.meter_id: r for r in peak_outlook(df, "meter_id", "timestamp", "consumption_kwh", 5).collect()}
    assert got[1].forecast_kwh == 16 and got[1].peak_timestamp == T0 + dt.timedelta(hours=7)
    assert got[2].peak_timestamp == T0 + dt.timedelta(hours=4)
    assert got[3].forecast_kwh == 0 and got[3].peak_timestamp == T0 + dt.timedelta(hours=3)


@pytest.mark.parametrize("operator", [peak_outlook, forecast_steps])
def test_outlooks_read_the_history_once(spark, tmp_path, operator):
    spark.createDataFrame(hourly([1.0, 2.0, 3.0], 1), HISTORY).write.parquet(f"{tmp_path}/history")
    df = operator(spark.read.parquet(f"{tmp_path}/history"), "meter_id", "timestamp", "consumption_kwh", 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_unusable_histories(spark):
    rows = hourly([1.0, 2.0], 1) + hourly([1.0, math.nan, 2.0], 2) + hourly([1.0, -2.0, 2.0], 3)
    rows += [(4, T0, 1.0), (4, T0, 2.0), (4, T0, 3.0)]
    got = {r.meter_id: r for r in peak_outlook(spark.createDataFrame(rows, HISTORY), "meter_id", "timestamp", "consumption_kwh").collect()}
    assert {k: r.status for k, r in got.items()} == {1: "too_few", 2: "bad_value", 3: "bad_value", 4: "bad_time"}
    assert all(r.forecast_kwh is None for r in got.values())
    for horizon in (0, 25, 1.5):
        with pytest.raises(ValueError):
            peak_outlook(spark.createDataFrame(rows, HISTORY), "meter_id", "timestamp", "consumption_kwh", horizon)


REQUEST = {
    "building_id": 0, "meter": 0, "timestamp": "2016-07-15T14:00:00", "site_id": 0, "primary_use": "Education",
    "square_feet": 7432, "year_built": 2008, "floor_count": 4, "air_temperature": 25, "cloud_coverage": 6,
    "dew_temperature": 20, "precip_depth_1_hr": 0, "sea_level_pressure": 1019.7, "wind_direction": 180, "wind_speed": 3.1,
}
BROKEN = {
    "meter_code": {"meter": 4},
    "negative:square_feet": {"square_feet": -1},
    "year_built_range": {"year_built": 1700},
    "floor_count_range": {"floor_count": 0},
    "wind_direction_range": {"wind_direction": 361},
    "not_finite:wind_speed": {"wind_speed": "Infinity"},
    "not_finite:air_temperature": {"air_temperature": "NaN"},
    "timestamp_invalid": {"timestamp": "2016-02-30T00:00:00"},
    "timestamp_zone": {"timestamp": "2016-07-15T14:00:00+02:00"},
    "timestamp_year": {"timestamp": "1899-07-15T14:00:00"},
    "primary_use_blank": {"primary_use": "  "},
    "target_supplied": {"meter_reading": 5},
    "unexpected_field": {"extra": 1},
    "not_numeric:meter": {"meter": True},
    "not_integer:building_id": {"building_id": 1.5},
    "negative:site_id": {"site_id": -1},
}


def test_requests(spark):
    cases = {"ok": REQUEST, **{k: {**REQUEST, **v} for k, v in BROKEN.items()}}
    cases |= {f"missing:{k}": {x: y for x, y in REQUEST.items() if x != k} for k in REQUEST}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()] + [("not_an_object", "[")], "name string, body string")
    got = {r.name: r for r in vd.validate_requests(df, "body").collect()}
    assert got["ok"].errors == [] and got["ok"].timestamp == dt.datetime(2016, 7, 15, 14) and got["ok"].square_feet == 7432
    assert "not_an_object" in got["not_an_object"].errors
    for name in cases:
        if name != "ok":
            assert got[name].errors == [name], (name, got[name].errors)
    good, bad = vd.split_valid(vd.validate_requests(df, "body"))
    assert good.count() == 1 and bad.count() == len(cases)


STRICT = {
    "zone name": ({"timestamp": "2016-07-15 14:00:00 Europe/Paris"}, "timestamp_zone"),
    "zone UTC": ({"timestamp": "2016-07-15 14:00:00 UTC"}, "timestamp_zone"),
    "zone glued": ({"timestamp": "2016-07-15T14:00:00Z"}, "timestamp_zone"),
    "time alone": ({"timestamp": "14:00:00"}, "timestamp_invalid"),
    "suffix d": ({"square_feet": "5d"}, "not_numeric:square_feet"),
    "suffix f": ({"wind_speed": "5f"}, "not_numeric:wind_speed"),
    "tab": ({"primary_use": "\t\n"}, "primary_use_blank"),
    "wide space": ({"primary_use": "\u2003"}, "primary_use_blank"),
}


def test_strict_requests(spark):
    rows = [(k, json.dumps({**REQUEST, **v})) for k, (v, _) in STRICT.items()]
    odd = {**REQUEST, "square_feet": " 5e2 ", "timestamp": "2016-07-15 14:00", "primary_use": "\tEducation\n"}
    df = spark.createDataFrame([*rows, ("ok", json.dumps(odd))], "name string, body string")
    got = {r.name: r for r in vd.validate_requests(df, "body").collect()}
    assert {k: got[k].errors for k in STRICT} == {k: [e] for k, (_, e) in STRICT.items()}
    assert got["ok"].errors == [] and got["ok"].square_feet == 500 and got["ok"].primary_use == "Education"


def test_strict_feature_rows(spark):
    def body(meter, x):
        return f'{{"meter": {meter}, "input_timestamp": "2016-07-15T14:00:00", "features": {{"x": {x}, "use": "a"}}}}'

    cases = {"ok": body("0", "1.5"), "null": body("0", "null"), "text": body('"0"', "1"), "huge": body("0", "1e400"), "one": body("1", "1")}
    df = spark.createDataFrame(list(cases.items()), "name string, body string")
    got = {r.name: r.errors for r in vd.validate_features(df, "body", ["x", "use"], {"use": ["a"]}).collect()}
    assert got == {"ok": [], "null": [], "text": ["meter_code"], "huge": ["not_numeric:x"], "one": ["meter_code"]}


def test_unknown_inputs_warn(spark):
    odd = {**REQUEST, "building_id": 999999, "site_id": 999999, "primary_use": "Casino"}
    df = spark.createDataFrame([(json.dumps(odd),)], "body string")
    profile = {
        "categories": ["Education"], "building_min": 0, "building_max": 9, "site_min": 0, "site_max": 9,
        "timestamp_min": dt.datetime(2016, 1, 1), "timestamp_max": dt.datetime(2016, 8, 31),
    }
    (row,) = vd.warn_inputs(vd.validate_requests(df, "body"), profile).collect()
    assert row.errors == [] and row.warnings == ["unknown_primary_use", "unseen_building_id", "unseen_site_id"]


PAYLOADS = [
    (
        '{"dt":1700000000,"main":{"temp":20.5,"dew_point":12.25,"pressure":1012,"sea_level":1015.4},"clouds":{"all":50},'
        '"rain":{"1h":25.4},"wind":{"deg":271,"speed":3.6}}',
        (20.5, 4.5, 12.25, 1.0, 1015.4, 271.0, 3.6),
    ),
    ('{"main":{"temp":8},"wind":{}}', (8.0, None, None, None, None, None, None)),
    ('{"main":{"pressure":1008.2}}', (None, None, None, None, 1008.2, None, None)),
    ('{"main":{"pressure":1008.2,"sea_level":null}}', (None,) * 7),
]


@pytest.mark.parametrize("body,expected", PAYLOADS)
def test_current_weather(spark, body, expected):
    (row,) = normalize_weather(spark.createDataFrame([(body,)], "j string"), "j").collect()
    assert tuple(row[c] for c in WEATHER_COLUMNS) == pytest.approx(expected)


def test_forecast_weather(spark):
    df = spark.createDataFrame([('{"list":[{"dt":1700000000,"rain":{"3h":76.2}}]}',), ('{"list":[]}',)], "j string")
    first, empty = normalize_weather(df, "j", "forecast").collect()
    assert first.precip_depth_1_hr == pytest.approx(1.0) and first.observation_at == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert first.payload_ok and not empty.payload_ok


def test_split_bounds(spark):
    times = ["2016-08-31 23:59:59", "2016-09-01 00:00:00", "2016-10-31 23:59:59", "2016-11-01 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    out = mt.chronological_split(df, "t", "2016-08-31 23:59:59", "2016-10-31 23:59:59").orderBy("t").collect()
    assert [r.split for r in out] == ["training", "validation", "validation", "testing"]
    with pytest.raises(ValueError):
        mt.split_summary(df, "t", "2016-08-31 23:59:59", "2017-10-31 23:59:59")


def test_bands(spark):
    limits = {"small_max": 10.0, "medium_max": 50.0, "large_max": 100.0}
    df = spark.createDataFrame([(0.0,), (11.0,), (51.0,), (101.0,)], "y double").orderBy("y")
    assert [r.b for r in df.select(mt.band(F.col("y"), limits).alias("b")).collect()] == ["small", "medium", "large", "peak"]


def test_best_model(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0, 0.5), ("b", 2.0, 0.9, 0.4), ("c", 3.0, 0.1, 0.9)], "m string, mae double, rmsle double, r2 double")
    assert mt.select_best(df, "m", [("mae", False), ("rmsle", False), ("r2", True)]).first().best_model == "b"


def test_metric_edge_cases(spark):
    df = spark.createDataFrame([(5.0, -3.0), (5.0, 5.0)], "y double, p double")
    clipped = mt.clipped_metrics(df, "y", "p").first()
    assert clipped.r2 == 0.0 and clipped.mae == 2.5
    plain = mt.regression_metrics(df, "y", "p").first()
    assert plain.mae == 4.0 and plain.negative_pct == 50.0 and plain.median_absolute_error == 4.0


def test_actuals_keep_zero(spark):
    p = spark.createDataFrame([(1, 163.704), (2, 174.3), (3, 1.0)], "id int, predicted double")
    a = spark.createDataFrame([(1, 500.0), (3, 0.0)], "id int, v double")
    got = {r.id: r.actual for r in jn.attach_actuals(p, a, ["id"], "v", "actual").collect()}
    assert got == {1: 500.0, 2: None, 3: 0.0}


def test_lookup_keys_must_be_unique(spark):
    good = spark.createDataFrame([(1,), (2,)], "k int")
    assert jn.assert_unique(good, ["k"]) is good
    for rows in ([(1,), (1,)], [(1,), (None,)]):
        with pytest.raises(ValueError):
            jn.assert_unique(spark.createDataFrame(rows, "k int"), ["k"])
    with pytest.raises(ValueError):
        jn.assert_same_count(good, good.limit(1))


def test_meters_other_than_electricity_are_refused(spark, merged):
    qa.assert_observations(merged, "meter", "meter_reading", "timestamp")
    with pytest.raises(ValueError):
        qa.assert_observations(merged.withColumn("meter", F.lit(1)), "meter", "meter_reading", "timestamp")


def test_null_rules_of_the_checks(spark, merged):
    got = qa.impossible_counts(merged).first()
    assert got.air_temperature_outside_range == 1 and got.wind_direction_outside_circle == 1 and got.negative_wind_speed == 0
    qa.assert_core_possible(merged)
    with pytest.raises(ValueError):
        qa.assert_core_possible(merged.withColumn("meter", F.lit(7)))


def test_contract(spark, merged):
    assert qa.check_contract(merged, merged.columns, rows=4, types=merged.schema).isEmpty()
    rules = {r.rule for r in qa.check_contract(merged, ["site_id", *[c for c in merged.columns if c != "site_id"]], rows=5).collect()}
    assert rules == {"column_order", "row_count"}


def test_multisets(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, 3)], "x int, y int")
    assert qa.multiset_equal(a, a.orderBy("x"))
    assert not qa.multiset_equal(a, a.distinct())
    assert qa.multiset_diff(a, a.distinct()).count() == 1


def test_downcast(spark):
    df = spark.createDataFrame([(1, 100000, 0.5), (2, -5, 1.5)], "a long, b long, c double")
    assert dict(qa.downcast(df).dtypes) == {"a": "smallint", "b": "int", "c": "float"}


def test_whole_electricity_build(spark, merged):
    spine = im.weather_spine(merged, "site_id", "timestamp", WEATHER_COLUMNS)
    site, overall = im.fit_weather(spine, "site_id", "timestamp", WEATHER_COLUMNS, "2016-08-31 23:59:59")
    out = ft.electricity_features(ft.treat_weather(merged, spine, "site_id", "timestamp", site, overall))
    assert out.count() == 4
    assert qa.unchanged(merged, out, ["building_id", "timestamp", "meter_reading"]).isEmpty()
    assert out.where(" or ".join(f"{c} is null" for c in WEATHER_COLUMNS)).isEmpty()
    assert out.where("meter_reading = 0").count() == 1
    assert out.orderBy("timestamp").first().air_temperature == 20.0


def test_profiles_are_filled_per_group(spark):
    from datetime import datetime

    from gridloom.operators.profile import time_profile

    rows = [("a", datetime(2020, 1, 1), 1.0), ("a", datetime(2020, 1, 4), 2.0), (None, datetime(2020, 1, 2), 3.0), (None, datetime(2020, 1, 3), 4.0), ("b", None, 5.0)]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz, v double")
    got = sorted((r["site"] or "", r["period"].day, r["row_count"], r["total"]) for r in time_profile(df, "ts", "v", "day", True, ["site"]).collect())
    assert got == [("", 2, 1, 3.0), ("", 3, 1, 4.0), ("a", 1, 1, 1.0), ("a", 2, 0, None), ("a", 3, 0, None), ("a", 4, 1, 2.0)]
