"""Bounds of the outlook: plain loops, cuts at any place, coverage of hours that were held out."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators.outlook import backcasts, bound_coverage, outlook_bounds

START = datetime(2024, 1, 1)
SCHEMA = "meter string, at timestamp_ntz, kwh double, note string"


def _walk(meter, n, seed, noise=3.0):
    rng, level, out = random.Random(seed), 50.0, []
    for i in range(n):
        level = max(5.0, level + rng.gauss(0, 0.5))
        out.append((meter, START + timedelta(hours=i), max(0.0, level + rng.gauss(0, noise)), "x"))
    return out


def _plain(rows, horizon):
    """{(meter, step): [(origin, target, forecast, actual)]}"""
    by = defaultdict(list)
    for m, t, v, _ in rows:
        if t is not None and v is not None and math.isfinite(v) and v >= 0:
            by[m].append((t, v))
    out = defaultdict(list)
    for m, xs in by.items():
        xs.sort()
        for i in range(2, len(xs)):
            back = min(3, i)
            change = (xs[i][1] - xs[i - back][1]) / back
            for k in range(1, horizon + 1):
                if i + k < len(xs):
                    out[m, k].append((xs[i][0], xs[i + k][0], max(0.0, xs[i][1] + change * k), xs[i + k][1]))
    return out


@pytest.fixture(scope="module")
def rows():
    out = _walk("a", 200, 1) + _walk("b", 40, 2) + _walk(None, 30, 3) + _walk("short", 2, 4) + _walk("three", 3, 5) + _walk("four", 4, 6)
    out += [("b", START, None, "x"), ("b", None, 3.0, "x"), ("b", START, float("nan"), "x"), ("b", START, -1.0, "x")]
    out += [("tie", START + timedelta(hours=i // 2), float(i % 5), "x") for i in range(12)]
    out += [("same", START, 4.0, "x")] * 6
    random.Random(7).shuffle(out)
    return out


@pytest.mark.parametrize("block", [4, 7, 64, 100_000])
def test_backcasts_equal_a_loop_wherever_the_cut_is(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = defaultdict(list)
    for r in backcasts(df, "meter", "at", "kwh", 4, block).collect():
        got[r["meter"], r["step"]].append((r["origin_time"], r["target_time"], r["forecast"], r["actual"]))
    want = _plain(rows, 4)
    assert got.keys() == want.keys()
    for key in want:
        assert [x[:2] for x in sorted(got[key])] == [x[:2] for x in sorted(want[key])]
        assert np.allclose([x[2:] for x in sorted(got[key])], [x[2:] for x in sorted(want[key])])


@pytest.mark.parametrize("in_task", [None, 10])
def test_bounds_are_exact_quantiles(spark, rows, in_task):
    usable = [r for r in rows if r[0] not in ("tie", "same") and r[1] is not None and r[2] is not None and r[2] >= 0]
    df = spark.createDataFrame(usable, SCHEMA)
    got = {(r["meter"], r["step"]): r for r in outlook_bounds(df, "meter", "at", "kwh", 3, levels=(80, 95), block=16, rows_in_task=in_task).collect()}
    want = _plain(usable, 3)
    assert {m for m, _ in got} == {"a", "b", None, "three", "four"}
    for key, r in got.items():
        errors = [actual - forecast for _, _, forecast, actual in want.get(key, [])]
        assert r["tried"] == len(errors)
        if not errors:
            assert r["low_80"] is r["high_80"] is r["low_95"] is r["high_95"] is None
            continue
        for n in (80, 95):
            for side, q in (("low", (100 - n) / 200), ("high", (100 + n) / 200)):
                assert r[f"{side}_{n}"] == pytest.approx(max(0.0, r["forecast_kwh"] + np.quantile(errors, q)))
        assert r["low_95"] <= r["low_80"] <= r["high_80"] <= r["high_95"]
    assert got["three", 1]["tried"] == 0 and got["four", 1]["tried"] == 1


def test_held_out_hours_are_covered(spark):
    """Noise of one kind throughout: within three points of 80 and two of 95 on some 2,000 later hours a step, two meters."""
    data = _walk("a", 3000, 11) + _walk("b", 3000, 12, noise=8.0)
    split = START + timedelta(hours=2000)
    got = bound_coverage(spark.createDataFrame(data, SCHEMA), "meter", "at", "kwh", split, 4, block=500).collect()
    assert sorted(r["step"] for r in got) == [1, 2, 3, 4]
    for r in got:
        assert r["judged"] == 2 * (1000 - r["step"])
        assert abs(r["within_80"] - 0.80) <= 0.03 and abs(r["within_95"] - 0.95) <= 0.02


def test_no_reading_is_learnt_from_and_judged(spark):
    data = _walk("a", 100, 13)
    split = START + timedelta(hours=60)
    r = bound_coverage(spark.createDataFrame(data, SCHEMA), "meter", "at", "kwh", split, 1).first()
    # origins 60 to 98; the error from 59 to 60 is neither learnt from nor judged
    assert r["judged"] == 39
    assert bound_coverage(spark.createDataFrame(data, SCHEMA), "meter", "at", "kwh", START, 1).count() == 0


def test_empty_tables_and_refused_settings(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert outlook_bounds(none, "meter", "at", "kwh", 2).count() == 0
    for bad in ({"horizon": 0}, {"horizon": 30}, {"levels": ()}, {"levels": (100,)}, {"levels": (True,)}, {"block": 2}):
        with pytest.raises(ValueError):
            outlook_bounds(none, "meter", "at", "kwh", **bad)


def test_a_hot_meter_is_dealt_by_block(spark):
    """The windows see blocks in tasks of their own, whatever partitioning the join before them left."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(_walk("hot", 600, 1), SCHEMA)
        tried = backcasts(df, "meter", "at", "kwh", 2, 20).withColumn("task", F.spark_partition_id())
        assert tried.select("task").distinct().count() > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
