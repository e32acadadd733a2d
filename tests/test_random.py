"""Randomized comparison with plain pandas and Python definitions."""

from __future__ import annotations

import datetime as dt
import random
from statistics import median

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import impute as im
from gridloom.operators import profile as pf
from gridloom.operators import sampling as sm
from gridloom.operators.anomaly import mad_anomalies
from gridloom.operators.outlook import peak_outlook

T0 = dt.datetime(2016, 1, 20)


def series(seed):
    rng = random.Random(seed)
    rows = []
    for site in range(5):
        hours = sorted(rng.sample(range(2500), 150))
        for h in hours:
            rows.append((site, T0 + dt.timedelta(hours=h), *[rng.uniform(-10, 30) if rng.random() < p else None for p in (0.3, 0.02)]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_interpolation_like_pandas(spark, seed):
    rows = series(seed)
    df = spark.createDataFrame(rows, "site int, t timestamp_ntz, a double, b double")
    got = im.interpolate(df, "site", "t", ["a", "b"]).orderBy("site", "t").toPandas()
    want = pd.DataFrame(rows, columns=["site", "t", "a", "b"]).sort_values(["site", "t"])
    for c in ("a", "b"):
        want[c] = want[c].astype("float64")
        want[c] = want.groupby("site")[c].transform(lambda s: s.interpolate(method="linear", limit_direction="both"))
        want[c] = want[c].fillna(want[c].median())
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9)


@pytest.mark.parametrize("seed", [3, 4])
def test_causal_fill_like_pandas(spark, seed):
    rows = series(seed)
    df = spark.createDataFrame(rows, "site int, t timestamp_ntz, a double, b double")
    medians = spark.createDataFrame([(s, float(s), float(-s)) for s in range(4)], "site int, a double, b double")
    got = im.ffill_causal(df, "site", "t", ["a", "b"], medians, {"a": 99.0, "b": 98.0}).orderBy("site", "t").toPandas()
    want = pd.DataFrame(rows, columns=["site", "t", "a", "b"]).sort_values(["site", "t"])
    for c, sign, last in (("a", 1, 99.0), ("b", -1, 98.0)):
        want[c] = want[c].astype("float64")
        np.testing.assert_array_equal(got[f"{c}_missing"], want[c].isna())
        fallback = want["site"].map({s: float(sign * s) for s in range(4)}).fillna(last)
        np.testing.assert_allclose(got[c], want.groupby("site")[c].ffill().fillna(fallback))


@pytest.mark.parametrize("n", [1, 2, 25, 103, 1000])
def test_decile_like_pandas(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.randrange(40) / 2) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, y double")
    got = {r.id: r.decile for r in sm.decile(df, "y", ["id"]).collect()}
    y = pd.Series([v for _, v in rows])
    want = pd.qcut(y.rank(method="first"), 10, labels=False) if n > 1 else pd.Series([0])
    assert got == dict(enumerate(int(v) for v in want))


@pytest.mark.parametrize("n,limit", [(1000, 7), (1000, 999), (50, 50), (50, 80), (10, 1), (977, 100)])
def test_even_subset_like_linspace(spark, n, limit):
    got = sorted(r.id for r in sm.even_subset(spark.range(n), limit, ["id"]).collect())
    want = list(range(n)) if n <= limit else sorted({int(i) for i in np.linspace(0, n - 1, limit, dtype=np.int64)})
    assert got == want


def test_systematic_sample(spark):
    got = sorted(r.id for r in sm.systematic_sample(spark.range(1003), 100, ["id"]).collect())
    assert got == list(range(0, 1003, 11))[:100]


def histories(seed):
    rng = random.Random(seed)
    rows = []
    for meter in range(30):
        t = T0
        for _ in range(rng.randrange(1, 40)):
            t += dt.timedelta(seconds=rng.randrange(1, 7200))
            rows.append((meter, t, round(rng.choice([0.0, 5.0, rng.uniform(0, 9), rng.expovariate(0.1)]), 2)))
    return rows


@pytest.mark.parametrize("seed,limit", [(5, None), (6, 0)])
def test_anomalies_like_the_definition(spark, seed, limit):
    rows = histories(seed)
    df = spark.createDataFrame(rows, "m long, t timestamp_ntz, v double")
    got = {(r.m, r.t): (r.anomaly_type, r.severity) for r in mad_anomalies(df, "m", "t", "v", 2.5, limit).collect()}
    want = {}
    for m in range(30):
        values = [(t, v) for k, t, v in rows if k == m]
        center = median(v for _, v in values)
        scale = 1.4826 * median(abs(v - center) for _, v in values)
        for t, v in values:
            if scale and abs(v - center) / scale >= 2.5:
                want[m, t] = ("spike" if v > center else "drop", "high" if abs(v - center) / scale >= 3.75 else "medium")
    assert got == want


@pytest.mark.parametrize("horizon", [1, 4, 24])
def test_outlook_like_the_definition(spark, horizon):
    rows = histories(horizon)
    df = spark.createDataFrame(rows, "m long, t timestamp_ntz, v double")
    got = {r.m: r for r in peak_outlook(df, "m", "t", "v", horizon).collect()}
    for m in range(30):
        values = [(t, v) for k, t, v in rows if k == m]
        if len(values) < 3:
            assert got[m].status == "too_few"
            continue
        recent = [v for _, v in values[-4:]]
        gaps = [(b - a).total_seconds() for (a, _), (b, _) in zip(values[-4:], values[-3:])]
        if len(values) == 3:
            gaps = [(values[i + 1][0] - values[i][0]).total_seconds() for i in range(2)]
        change = sum(b - a for a, b in zip(recent, recent[1:])) / (len(recent) - 1)
        steps = [max(0.0, recent[-1] + change * k) for k in range(1, horizon + 1)]
        ordered = sorted(v for _, v in values)
        assert got[m].forecast_kwh == pytest.approx(max(steps), abs=1e-9)
        assert got[m].peak_threshold_kwh == ordered[min(len(ordered) - 1, int(0.9 * len(ordered)))]
        assert got[m].baseline_kwh == pytest.approx(median(ordered))
        step = 1 + int(np.argmax(np.round(steps, 9)))
        assert abs((got[m].peak_timestamp - values[-1][0]).total_seconds() - median(gaps) * step) < 1e-3


def test_spearman_like_pandas(spark):
    rng = random.Random(8)
    rows = [tuple(rng.choice([None, 1.0, 2.0, 5.0, rng.random() * 9]) for _ in range(3)) for _ in range(400)]
    got = {(r.first_column, r.second_column): r.spearman for r in pf.spearman(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    want = pd.DataFrame(rows, columns=["a", "b", "c"], dtype="float64")
    for (x, y), v in got.items():
        both = want[[x, y]].dropna().rank()
        assert v == pytest.approx(both[x].corr(both[y]))


def test_skewness_like_pandas(spark):
    rng = random.Random(9)
    values = [rng.expovariate(1) for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    assert pf.skewness_profile(df, ["a"]).first().skewness == pytest.approx(pd.Series(values).skew())
    assert pf.skewness_profile(df.limit(2), ["a"]).first().skewness is None
    assert pf.skewness_profile(df.withColumn("a", F.lit(1.5)), ["a"]).first().skewness == 0


def test_histogram_like_numpy(spark):
    rng = random.Random(10)
    values = [rng.gauss(0, 3) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    got = {r.bin: r.row_count for r in pf.histogram(df, F.col("a"), 20).collect()}
    want = np.histogram(values, bins=20)[0]
    assert got == dict(enumerate(want))
    flat = pf.histogram(df.withColumn("a", F.lit(4.0)), F.col("a"), 4).collect()
    assert [(r.bin, r.row_count) for r in sorted(flat)] == [(0, 0), (1, 0), (2, 500), (3, 0)]
