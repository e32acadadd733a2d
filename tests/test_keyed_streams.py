"""Streams with keyed state: any cut of the input and a restart give the batch result."""

from __future__ import annotations

import datetime as dt
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.streaming import ingest, keyed

START = dt.datetime(2024, 3, 1)
RECORDS, IDLE, LIMIT = 7, 6 * 3600, 3.0


def readings(seed=1):
    rng = random.Random(seed)
    rows = []
    for meter in ("a", "b", None):
        at = START
        for _ in range(160):
            at += dt.timedelta(minutes=rng.choice([1, 5, 15, 45]) if rng.random() < 0.97 else 60 * 9)
            value = rng.choice([rng.gauss(10, 1), rng.gauss(10, 1), 10.0, rng.gauss(40, 9)])
            rows.append((meter, at, value))
    rows += [("a", START, 5.0), ("a", START, 4.0), ("b", rows[9][1], None)]
    return rows


def late_mark(rows, delay):
    return max(r[1] for r in rows if r[2] is not None) - delay


def run(spark, tmp_path, build, batches, schema):
    """Each batch is one file and one start of the query on the same checkpoint."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        source = ingest.read_stream(spark, folder, spark.createDataFrame([], schema).schema)
        ingest.start_append(build(source), out, str(tmp_path / "checkpoint")).awaitTermination()
    return spark.read.parquet(out)


def cuts(rows, parts, seed=0, spread=20):
    """Rows in time order, locally shuffled within the delay, cut into ``parts``."""
    rng = random.Random(seed)
    timed = sorted(rows, key=lambda r: (r[1] + dt.timedelta(minutes=rng.uniform(0, spread)), str(r)))
    size = -(-len(timed) // parts)
    return [timed[i : i + size] for i in range(0, len(timed), size)]


def rolling(rows, mark):
    out = []
    for meter in {r[0] for r in rows}:
        window, last = [], None
        for at, value in sorted((r[1], r[2]) for r in rows if r[0] == meter and r[2] is not None):
            if at >= mark:
                continue
            if last is not None and (at - last).total_seconds() > IDLE:
                window = []
            window, last = [*window, value][-RECORDS:], at
            center = median(window)
            scale = keyed.MAD_SCALE * median(abs(v - center) for v in window)
            if len(window) >= 3 and scale > 0 and abs(value - center) / scale >= LIMIT:
                out.append((str(meter), at, value, round(center, 9)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 3])
def test_rolling_anomalies_do_not_depend_on_the_cut(spark, tmp_path, parts):
    rows = readings()
    build = lambda s: keyed.rolling_anomalies(s, "meter", "ts", "value", RECORDS, IDLE, LIMIT, "1 hour")
    got = run(spark, tmp_path, build, cuts(rows, parts), "meter string, ts timestamp, value double")
    want = rolling(rows, late_mark(rows, dt.timedelta(hours=1)))
    assert sorted((str(r["meter"]), r["ts"], r["actual_kwh"], round(r["expected_kwh"], 9)) for r in got.collect()) == want
    assert len(want) > 10


def test_rolling_scores_match_plain_medians(monkeypatch):
    monkeypatch.setattr(keyed, "WINDOW_VALUES", 30)
    values = np.random.default_rng(0).integers(0, 9, 60).astype(float)
    for known, records in ((0, 5), (3, 5), (20, 10), (0, 100)):
        centers, scales, sizes = keyed.rolling_scores(values, known, records)
        for i in range(known, len(values)):
            part = values[max(0, i + 1 - records) : i + 1]
            c = np.median(part)
            assert (centers[i - known], sizes[i - known]) == (c, len(part))
            assert scales[i - known] == keyed.MAD_SCALE * np.median(np.abs(part - c))


def test_idle_meters_leave_no_state(spark, tmp_path):
    rows = [("idle", START, 1.0), ("idle", START + dt.timedelta(minutes=1), 2.0), ("busy", START + dt.timedelta(days=2), 1.0)]
    schema = "meter string, ts timestamp, value double"
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    source = ingest.read_stream(spark, folder, spark.createDataFrame([], schema).schema)
    query = ingest.start_append(keyed.rolling_anomalies(source, "meter", "ts", "value", 5, IDLE), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    state = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "meter").load()
    assert [r[0] for r in state.select("key.g_key").collect()] == ["=busy"]


def alerts(rows, mark, enter, leave):
    out = []
    hour, step = dt.timedelta(hours=1), dt.timedelta(minutes=15)
    for meter in {r[0] for r in rows}:
        known = [(r[1], r[2]) for r in rows if r[0] == meter and r[2] is not None]
        ends, at = [], min(k[0] for k in known).replace(minute=0, second=0)
        while at <= mark:
            part = [v for t, v in known if at - hour <= t < at]
            if part:
                ends.append((at, sum(part) / len(part)))
            at += step
        opened, peak, n = None, None, 0
        for at, level in ends:
            if opened is None and level >= enter:
                opened, peak, n = at, level, 1
                out.append((str(meter), "opened", at, at, round(level, 9), 1))
            elif opened is not None and level < leave:
                out.append((str(meter), "cleared", opened, at, round(peak, 9), n))
                opened = None
            elif opened is not None:
                peak, n = max(peak, level), n + 1
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 4])
def test_one_alert_per_excursion(spark, tmp_path, parts):
    rows = readings(2)
    build = lambda s: keyed.threshold_alerts(s, "meter", "ts", "value", 20.0, 14.0)
    got = run(spark, tmp_path, build, cuts(rows, parts), "meter string, ts timestamp, value double")
    want = alerts(rows, late_mark(rows, dt.timedelta(hours=1)), 20.0, 14.0)
    assert sorted((str(r["meter"]), r["event"], r["opened_at"], r["noticed_at"], round(r["peak"], 9), r["windows"]) for r in got.collect()) == want
    assert sum(r[1] == "opened" for r in want) > 3
    with pytest.raises(ValueError):
        keyed.threshold_alerts(spark.readStream.format("rate").load().select("timestamp", "value"), "value", "timestamp", "value", 1.0, 2.0)


def test_predictions_meet_readings(spark, tmp_path):
    """Late, missing and repeated readings; the last batches only move the watermark."""
    at = lambda m: START + dt.timedelta(minutes=m)
    schema = "kind string, meter string, ts timestamp, value double"
    batches = [
        [("p", "a", at(0), 1.0), ("p", "a", at(60), 2.0), ("p", "b", at(0), 3.0), ("p", "b", at(120), 4.0), ("a", "a", at(0), 1.5)],
        [("a", "a", at(0), 9.0), ("a", "b", at(120), 5.0), ("a", "z", at(5), 7.0), ("p", None, at(0), 1.0), ("a", None, at(0), 1.0)],
        [("a", "a", at(60), 2.5), ("p", "c", at(60), 8.0)],
        [("p", "x", at(2000), 0.0), ("a", "x", at(2000), 0.25)],
        [("a", "c", at(60), 8.5), ("p", "x", at(2001), 0.0), ("a", "y", at(2001), 0.0)],
    ]

    def build(source):
        part = lambda kind, name: source.where(F.col("kind") == kind).select("meter", "ts", F.col("value").alias(name))
        return keyed.prediction_outcomes(part("p", "predicted"), part("a", "actual"), "meter", "ts", "predicted", "actual")

    got = run(spark, tmp_path, build, batches, schema)
    found = sorted((str(r["meter"]), r["ts"], r["predicted"], r["actual"]) for r in got.collect())
    assert found == sorted(
        [("a", at(0), 1.0, 1.5), ("a", at(60), 2.0, 2.5), ("b", at(0), 3.0, None), ("b", at(120), 4.0, 5.0), ("c", at(60), 8.0, None), ("None", at(0), 1.0, None), ("x", at(2000), 0.0, 0.25)],
        key=lambda r: r[:3],
    )
    row = {r["meter"]: r for r in keyed.accuracy(got, "meter").collect()}["b"]
    assert (row["predictions"], row["met"], row["mae"], row["bias"]) == (2, 1, 1.0, -1.0)
