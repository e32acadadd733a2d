"""Series analytics against plain loops; cuts and hot meters don't matter."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from itertools import groupby
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from gridloom.operators import series as sr

START = dt.datetime(2024, 1, 30)


def rows(seed=0):
    rng = random.Random(seed)
    out = []
    for meter, n in (("hot", 900), ("b", 60), (None, 40), ("one", 1), ("flat", 30)):
        at, value = START, 1
        for i in range(n):
            at += dt.timedelta(minutes=rng.choice([0, 7, 60, 300]) if meter == "hot" else 60)
            value = 4 if meter == "flat" else value if rng.random() < 0.6 else rng.randint(1, 4) + (3 if i > n // 2 else 0)
            out.append((meter, at, float(value) if rng.random() < 0.95 else None))
    return [*out, ("b", None, 1.0), out[0], out[0]]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "meter string, ts timestamp_ntz, v double").repartition(4).cache()


def per_meter(data):
    out = defaultdict(list)
    for meter, at, value in data:
        if at is not None and value is not None:
            out[meter].append((at, value))
    return {m: sorted(r) for m, r in out.items()}


@pytest.mark.parametrize(("grain", "least"), [("month", 3), ("day", 3), ("hour", 1), ("day", 6)])
def test_flat_runs(df, data, grain, least):
    want = []
    for meter, series in per_meter(data).items():
        for value, run in groupby(series, key=lambda r: r[1]):
            run = list(run)
            if len(run) >= least:
                want.append((str(meter), value, run[0][0], run[-1][0], len(run)))
    got = sr.flat_runs(df, "meter", "ts", "v", least, grain)
    assert got.columns == ["meter", "v", "started_at", "ended_at", "readings"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    assert sr.flat_runs(df.limit(0), "meter", "ts", "v").count() == 0


@pytest.mark.parametrize("grain", ["month", "hour"])
def test_level_breaks(df, data, grain):
    got = {r["meter"]: r for r in sr.level_breaks(df, "meter", "ts", "v", grain).collect()}
    plain = per_meter(data)
    assert got.keys() == plain.keys()
    for meter, series in plain.items():
        values = [v for _, v in series]
        n, total, spread = len(values), sum(values), pstdev(values)
        far = [abs(sum(values[:i]) - i * (total / n)) for i in range(n)]
        at = far.index(max(far))
        r = got[meter]
        assert r["readings"] == n
        if spread == 0:
            assert (r["break_at"], r["statistic"], r["broken"]) == (None, 0.0, False)
            continue
        assert r["break_at"] == series[at][0] and abs(r["before"] - fmean(values[:at])) < 1e-9 and abs(r["after"] - fmean(values[at:])) < 1e-9
        assert abs(r["statistic"] - far[at] / spread / n**0.5) < 1e-9 and r["broken"] == (r["statistic"] > 1.358)
    assert got["hot"]["broken"] and not got["flat"]["broken"]


@pytest.mark.parametrize(("period", "block"), [(24, 48), (7, 30), (6, 1000)])
def test_decompose(spark, period, block):
    rng = random.Random(3)
    hours = [START + dt.timedelta(hours=h) for h in range(400) if h not in (50, 51, 222)]
    data = [(m, h, rng.random() * 5 + (h.hour % 6) * 3 + i / 50) for m in ("a", "b") for i, h in enumerate(hours)]
    series = spark.createDataFrame(data, "meter string, hour timestamp_ntz, value double").repartition(3)
    got = {(r["meter"], r["hour"]): r for r in sr.decompose(series, "meter", period=period, block_hours=block).collect()}
    assert len(got) == len(data)
    half = period // 2
    for m in ("a", "b"):
        known = {h: v for n, h, v in data if n == m}
        trend = {}
        for h in known:
            near = [known.get(h + dt.timedelta(hours=d)) for d in range(-half, half + 1)]
            if None not in near:
                trend[h] = (sum(near) - ((near[0] + near[-1]) / 2 if period % 2 == 0 else 0)) / period
        place = lambda h: int((h - dt.datetime(1970, 1, 1)).total_seconds() // 3600) % period
        means = {p: fmean([known[h] - trend[h] for h in trend if place(h) == p]) for p in range(period)}
        middle = fmean(means.values())
        for h, v in known.items():
            r = got[m, h]
            assert (r["trend"] is None) == (h not in trend) and abs(r["seasonal"] - means[place(h)] + middle) < 1e-9
            if h in trend:
                assert abs(r["trend"] - trend[h]) < 1e-9 and abs(r["trend"] + r["seasonal"] + r["remainder"] - v) < 1e-9
    with pytest.raises(ValueError):
        sr.decompose(series, "meter", period=24, block_hours=30)


def test_period_totals_tell_null_keys_from_totals(spark):
    at = lambda d: START + dt.timedelta(days=d, hours=5)
    data = [("s", "a", at(0), 1.0), ("s", "a", at(1), 2.0), ("s", None, at(0), 4.0), (None, "b", at(0), 8.0), ("s", "a", None, 9.0), ("s", "a", at(0), None)]
    df = spark.createDataFrame(data, "site string, meter string, ts timestamp_ntz, v double")
    out = sr.period_totals(df, ["site", "meter"], "ts", "v")
    got = {(r["site"], r["meter"], r["period"], r["level"]): (r["total"], r["row_count"], r["share"]) for r in out.collect()}
    one, two = START, START + dt.timedelta(days=1)
    assert got[None, None, None, 7] == (15.0, 4, 1.0) and got[None, None, one, 6] == (13.0, 3, 1.0) and got[None, None, two, 6] == (2.0, 1, 1.0)
    assert got["s", None, None, 3] == (7.0, 3, 7 / 15) and got[None, None, None, 3] == (8.0, 1, 8 / 15)
    assert got["s", None, None, 1] == (4.0, 1, 4 / 15) and got["s", "a", one, 0] == (1.0, 1, 1 / 13) and got["s", None, one, 2] == (5.0, 2, 5 / 13)
    assert out.count() == len(got)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sr.period_totals(df.limit(0), ["site"], "ts", "v").where("level = 0").count() == 0 and "Expand" in plan


def test_week_profile(df, data):
    cells = defaultdict(list)
    for meter, series in per_meter(data).items():
        for at, v in series:
            cells[meter, at.weekday(), at.hour].append(v)
    got = {(r[0], r[1], r[2]): (r["mean"], r["row_count"]) for r in sr.week_profile(df, "meter", "ts", "v").collect()}
    assert got.keys() == cells.keys() and all(abs(got[k][0] - fmean(v)) < 1e-9 and got[k][1] == len(v) for k, v in cells.items())


def test_hourly_series(df, data):
    got = {(r[0], r[1]): r[2] for r in sr.hourly_series(df, "meter", "ts", "v").collect()}
    want = defaultdict(float)
    for meter, series in per_meter(data).items():
        for at, v in series if meter is not None else []:
            want[meter, at.replace(minute=0)] += v
    assert got == dict(want)
    assert df.where(F.col("meter").isNull()).count() > 0
