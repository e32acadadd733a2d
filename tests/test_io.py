"""Sinks, sources, streaming and training on small tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gridloom.functions.text import redact_parameter
from gridloom.operators import models as ml
from gridloom.session import scratch_path
from gridloom.sources import readers, writers
from gridloom.streaming import ingest

T0 = dt.datetime(2024, 1, 1)


def test_overwrite_needs_leave(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.write_table(spark.range(5), path)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        writers.write_table(spark.range(6), path)
    assert spark.read.parquet(path).count() == 5
    writers.write_table(spark.range(6), path, overwrite=True)
    assert spark.read.parquet(path).count() == 6
    with pytest.raises(ValueError):
        writers.write_table(spark.read.parquet(path), path, overwrite=True)
    assert spark.read.parquet(path).count() == 6


def test_failed_write_leaves_no_table(spark, tmp_path):
    path = tmp_path / "bad"
    broken = spark.range(10).select(F.expr("IF(id = 7, raise_error('stop'), id)").alias("id"))
    with pytest.raises(Exception, match="stop"):
        writers.write_table(broken, str(path))
    assert not list(path.glob("part-*")) and not (path / "_SUCCESS").exists()


def test_bad_times_are_counted(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("building_id,meter,timestamp,meter_reading\n1,0,2016-01-01 00:00:00,5\n1,0,never,6\n1,0,,7\n")
    rows = readers.read_readings(spark, str(folder)).orderBy("meter_reading").collect()
    assert [r.timestamp for r in rows] == [dt.datetime(2016, 1, 1), None, None]
    assert [r.bad_timestamp for r in rows] == [False, True, False]


def test_partitioned_by_site_and_month(spark, tmp_path):
    df = spark.createDataFrame([(s, T0 + dt.timedelta(days=20 * i), float(i)) for s in (1, 2) for i in range(4)], "site int, t timestamp_ntz, v double")
    path = tmp_path / "p"
    writers.write_partitioned(df, str(path), "site", "t", files=2)
    assert sorted(p.name for p in (path / "site=1").iterdir()) == ["month=202401", "month=202402", "month=202403"]
    assert spark.read.parquet(str(path)).count() == 8


def _stream(spark, folder, rows, name):
    spark.createDataFrame(rows, "m long, t timestamp, v double").coalesce(1).write.mode("append").parquet(str(folder))
    return ingest.read_stream(spark, str(folder), spark.createDataFrame([], "m long, t timestamp, v double").schema)


def test_stream_drops_repeats_and_fills_missing_times(spark, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    rows = [(1, T0, 1.0), (1, T0, 1.0), (2, T0, 2.0), (3, None, 3.0)]
    source = _stream(spark, tmp_path / "in", rows, "a")
    ingest.ingest_stream(source, "m", "t", out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    assert spark.read.parquet(out).where("t is null").isEmpty()
    source = _stream(spark, tmp_path / "in", [(4, dt.datetime(2100, 1, 1), 1.0)], "b")
    ingest.ingest_stream(source, "m", "t", out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_stream_profile_drops_late_rows(spark, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    days = [(1, T0 + dt.timedelta(days=d), 1.0) for d in range(4)]
    for rows in (days, [(1, T0, 50.0), (1, T0 + dt.timedelta(days=9), 1.0)]):
        daily = ingest.daily_stream(_stream(spark, tmp_path / "in", rows, "a"), "t", "v")
        ingest.start_append(daily, out, check).awaitTermination()
    got = {r.period.day: r.total for r in spark.read.parquet(out).collect()}
    assert got[1] == 1.0 and set(got) == {1, 2, 3, 4}


def test_stream_anomalies_are_stored_once(spark, tmp_path):
    store, check = str(tmp_path / "store"), str(tmp_path / "check")
    rows = [(1, T0 + dt.timedelta(hours=i), v) for i, v in enumerate([10.0, 10.0, 11.0, 9.0, 10.0, 100.0])]
    schema = "m long, t timestamp, anomaly_type string, severity string, actual_kwh double, expected_kwh double, deviation_pct double, description string"
    shape = spark.createDataFrame([], schema).schema
    for _ in range(2):
        source = _stream(spark, tmp_path / "in", rows, "a")
        ingest.stream_anomalies(source, "m", "t", "v", store, check).awaitTermination()
        assert ingest.stored_anomalies(spark, store, shape).count() == 1


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        a, b, kind = rng.random() * 10, (rng.random() if i % 7 else None), rng.choice(["x", "y", "z", None])
        rows.append((i, a, b, kind, 3 * a + (5 if kind == "x" else 0) + rng.random()))
    return spark.createDataFrame(rows, "id int, a double, b double, kind string, target double").repartition(4).cache()


SPEC = ml.FeatureSpec(["a", "b"], ["kind"], "target")


def _mae(model, df, spec=SPEC):
    return ml.predict(model, df, spec).agg(F.avg(F.abs(F.col("prediction") - F.col("target")))).first()[0]


@pytest.mark.parametrize(
    "kind,options",
    [
        ("linear", {}),
        ("ridge", {"alpha": 1.0}),
        ("tree", {}),
        ("forest", {"numTrees": 5, "maxDepth": 8}),
        ("boosted", {"maxIter": 10, "stepSize": 0.3}),
    ],
)
def test_models_beat_the_constant(training, kind, options):
    model = ml.fit(kind, training, SPEC, training if kind == "boosted" else None, **options)
    constant = ml.fit_median(training, "target")
    dummy = training.agg(F.avg(F.abs(F.col("target") - constant))).first()[0]
    assert _mae(model, training) < dummy / 2


def test_ridge_is_the_closed_form(training):
    import numpy as np

    model = ml.fit("ridge", training, SPEC, alpha=50.0)
    ready = PipelineModel(model.stages[:-1]).transform(training).select("features", "target").collect()
    x = np.array([r.features.toArray() for r in ready])
    y = np.array([r.target for r in ready])
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 50.0 * np.eye(x.shape[1]), xc.T @ yc)
    np.testing.assert_allclose(model.stages[-1].coefficients.toArray(), want, rtol=1e-6)


def test_unknown_category_and_reload(spark, training, tmp_path):
    spec = ml.FeatureSpec(["a", "b"], ["kind"], "target", log_target=True)
    model = ml.fit("tree", training, spec)
    model.save(str(tmp_path / "model"))
    odd = training.withColumn("kind", F.lit("never seen"))
    again = PipelineModel.load(str(tmp_path / "model"))
    a = ml.predict(model, odd, spec).select("id", "prediction")
    assert a.exceptAll(ml.predict(again, odd, spec).select("id", "prediction")).isEmpty()
    assert ml.feature_names(model, spec) == ["a", "b", "kind=x", "kind=y", "kind=z"]


def test_importances(training):
    model = ml.fit("tree", training, SPEC)
    native = ml.top_importance(ml.importance(model, SPEC, training.sparkSession), 1).first()
    shuffled = {r.feature: r.importance for r in ml.permutation_importance(model, training, SPEC, "id").collect()}
    assert native.feature == "a"
    assert max(shuffled, key=shuffled.get) == "a" and set(shuffled) == {"a", "b", "kind"}
    assert abs(shuffled["b"]) < shuffled["kind"] < shuffled["a"]


def test_scoring_quarantines_bad_requests(spark):
    from gridloom.operators import features as ft
    from tests.test_cases import REQUEST

    import json

    rng = random.Random(2)
    bodies = [json.dumps({**REQUEST, "square_feet": rng.randrange(100, 9000), "meter": i % 5}) for i in range(50)]
    requests = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    from gridloom.operators.validation import split_valid, validate_requests

    good, _ = split_valid(validate_requests(requests, "body"))
    rows = good.select("*", *[e.alias(n) for n, e in ft.features_v1_columns().items()]).withColumn("meter_reading", F.col("square_feet") / 100)
    spec = ml.FeatureSpec(["square_feet", "log_square_feet"], ["primary_use", "meter"], "meter_reading")
    model = ml.fit("linear", rows, spec)
    profile = {
        "categories": ["Education"], "building_min": 0, "building_max": 9, "site_min": 0, "site_max": 9,
        "timestamp_min": dt.datetime(2017, 1, 1), "timestamp_max": dt.datetime(2018, 8, 31),
    }
    scored, bad = ml.score_batch(requests, "body", model, spec, profile, "v1")
    assert scored.count() == 40 and bad.count() == 10
    row = scored.first()
    assert row.warnings == ["outside_training_period"] and row.predicted_meter_reading >= 0 and row.model_version == "v1"


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


def _fake_session(app, master, **conf):
    from types import SimpleNamespace

    settings = _Conf(conf)
    context = SimpleNamespace(applicationId=app, master=master, getConf=lambda: settings)
    return SimpleNamespace(conf=settings, sparkContext=context)


def test_scratch_follows_the_cluster_setting():
    on_cluster = _fake_session("app-1", "yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert scratch_path(on_cluster, "x").startswith("hdfs:///shared/gridloom-")
    with pytest.raises(RuntimeError):
        scratch_path(_fake_session("app-2", "yarn"), "x")


def test_failed_overwrite_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "kept")
    writers.write_table(spark.range(5), path)
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        writers.write_table(broken, path, overwrite=True)
    assert spark.read.parquet(path).count() == 5
    writers.write_table(spark.range(2), path, overwrite=True)
    assert spark.read.parquet(path).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["kept"]


def test_nan_text_is_missing(spark, tmp_path):
    (tmp_path / "r.csv").write_text("building_id,meter,timestamp,meter_reading\n1,0,2016-01-01 00:00:00,NaN\n1,0,2016-01-01 01:00:00,2.5\n")
    got = readers.read_readings(spark, str(tmp_path / "r.csv"))
    assert got.agg(F.max("meter_reading")).first()[0] == 2.5


def test_redaction_escapes_and_knows_all_separators(spark):
    row = spark.createDataFrame([("http://x/?a.b=1;key=2&aXb=3&KEY=4#top key=5",)], "u string")
    assert row.select(redact_parameter(F.col("u"), "a.b", "key")).first()[0] == (
        "http://x/?a.b=[REDACTED];key=[REDACTED]&aXb=3&KEY=[REDACTED]#top key=5"
    )
