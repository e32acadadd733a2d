"""Forests of many rows against a plain tree, MLlib's forest and themselves on other layouts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from gridloom.operators import forest as fo
from gridloom.operators import models as ml
from gridloom.operators import scale
from gridloom.session import scratch_path

SPEC = ml.FeatureSpec(["a", "b", "c"], ["kind"], "y", forbidden=("y", "id"))
SMALL = {"numTrees": 4, "maxDepth": 7}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(6000):
        a, b, c, kind = rng.normal(), float(rng.integers(0, 7)), rng.exponential(), ["x", "y", None][i % 3]
        y = 3 * np.sin(2 * a) + b + (2 * c if kind == "x" else 0) + 0.3 * rng.normal()
        data.append((i, float(a) if i % 11 else None, b, float(c), kind, float(y) if i % 41 else None))
    data += data[:500]  # rows that come twice
    return spark.createDataFrame(data, "id long, a double, b double, c double, kind string, y double").repartition(5, "id").cache()


def _fit(rows, monkeypatch, node_rows=fo.NODE_ROWS, most=1000, **options):
    made = fo.settings_of
    monkeypatch.setattr(ml, "FOREST_ROWS", most)
    monkeypatch.setattr(fo, "settings_of", lambda learner, width: made(learner, width, node_rows=node_rows))
    try:
        return ml.fit("forest", rows, SPEC, **SMALL | options)
    finally:
        monkeypatch.undo()


def _trees(model):
    """Splits and leaves without what belongs to the run."""
    return model.stages[-1].toDebugString.split("\n")[1:]


def _rounded(lines):
    return [" ".join(f"{float(w):.9g}" if w.replace(".", "", 1).replace("-", "").isdigit() else w for w in line.replace(")", " )").split()) for line in lines]


def _plain(codes, y, w, bins, depth, least):
    """One row per node, parents first: (column, cut, rows), grown by trying every cut."""
    n, s = w.sum(), (w * y).sum()
    best = (0.0, -1, 0)
    if depth and n >= 2 * least and (w * y * y).sum() / n - (s / n) ** 2 > 1e-12:
        for c in range(len(codes)):
            for cut in range(bins - 1):
                left = codes[c] <= cut
                nl, sl = w[left].sum(), (w * y)[left].sum()
                if nl >= least and n - nl >= least:
                    gain = (sl**2 / nl + (s - sl) ** 2 / (n - nl) - s**2 / n) / n
                    if gain > best[0] + 1e-12:
                        best = (gain, c, cut)
    if best[1] < 0:
        return [(-1, 0, n)]
    left = codes[best[1]] <= best[2]
    halves = [_plain(codes[:, part], y[part], w[part], bins, depth - 1, least) for part in (left, ~left)]
    return [(best[1], best[2], n), *halves[0], *halves[1]]


def test_lower_nodes_are_those_of_a_plain_tree(monkeypatch):
    rng = np.random.default_rng(2)
    codes, w = rng.integers(0, 6, (5, 400)).astype(np.uint8), rng.integers(1, 4, 400).astype(np.uint8)
    y = np.round(rng.normal(size=400) + codes[1] * (codes[3] > 2), 3)
    settings = fo.Settings(1, 9, 3, 0.0, 5, 6, 42)
    for at_once in (fo.NODES_AT_ONCE, 2):
        monkeypatch.setattr(fo, "NODES_AT_ONCE", at_once)
        column, cut, left, right, n, s, q, gain = fo.grow(codes, y, w, 6, 2, 0, 4, settings)
        assert all(v > i for side in (left, right) for i, v in enumerate(side) if v >= 0)

        def walk(i):
            return [(column[i], cut[i], n[i]), *walk(left[i]), *walk(right[i])] if left[i] >= 0 else [(-1, 0, n[i])]

        assert walk(0) == _plain(codes, y, w.astype(float), 6, 7, 3)
        assert sum(q[i] for i in range(len(n)) if left[i] < 0) == pytest.approx((w * y * y).sum())


def test_where_nodes_are_cut_and_how_rows_lie_leaves_the_trees_as_they_are(rows, monkeypatch):
    below = _fit(rows, monkeypatch)
    above = _fit(rows, monkeypatch, node_rows=150)
    assert below.stages[-1].totalNumNodes > 4 * 20
    assert _rounded(_trees(above)) == _rounded(_trees(below))
    assert _trees(_fit(rows.repartition(9, "b"), monkeypatch)) == _trees(below)


def test_large_forest_is_as_good_as_the_one_of_mllib(spark, rows, monkeypatch):
    train, held = rows.where("id < 5000"), rows.where("id >= 5000 AND y IS NOT NULL")
    error = F.sqrt(F.avg((F.col("raw_prediction") - F.col("y")) ** 2))
    own, usual = _fit(train, monkeypatch, node_rows=800), _fit(train, monkeypatch, most=10**9)
    found, want = (ml.predict(m, held, SPEC).agg(error).first()[0] for m in (own, usual))
    assert found == pytest.approx(want, rel=0.1)
    forest = own.stages[-1]
    assert isinstance(forest, RandomForestRegressionModel) and forest.getNumTrees == 4 and max(t.depth for t in forest.trees) == 7
    # every row is in a bag once on average, and none is left out of the trees
    assert abs(sum(t._call_java("rootNode").impurityStats().count() for t in forest.trees) / 4 / train.where("y IS NOT NULL").count() - 1) < 0.05
    assert forest.featureImportances.toArray()[:3] == pytest.approx(usual.stages[-1].featureImportances.toArray()[:3], abs=0.05)
    path = scratch_path(spark, "model")
    own.save(path)
    both = ml.predict(PipelineModel.load(path), ml.predict(own, held, SPEC).drop("prediction").withColumnRenamed("raw_prediction", "p"), SPEC)
    assert both.where("p <> raw_prediction").count() == 0


def test_small_forests_and_labels_that_are_no_numbers_stay_with_mllib(rows, monkeypatch):
    called = []
    monkeypatch.setattr(fo, "fit_forest", lambda *a: called.append(a))
    ml.fit("forest", rows, SPEC, numTrees=1, maxDepth=2)
    monkeypatch.setattr(ml, "FOREST_ROWS", 1000)
    with pytest.raises(Exception, match="NaN"):  # its own refusal of such labels
        ml.fit("forest", rows.withColumn("y", F.expr("if(id = 7, double('NaN'), y)")), SPEC, numTrees=1, maxDepth=2)
    ml.fit("forest", rows, SPEC, numTrees=1, maxDepth=2, subsamplingRate=0.5)
    assert not called


def test_thresholds_come_from_all_rows(spark):
    """One value in 40,000 is a threshold's; of many values each bin gets its share."""
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(40_000).selectExpr("CASE WHEN id = 17 THEN -3.0D ELSE 2.0D END AS a", "ln(1.0D + id) AS b", "CAST(id % 3 AS DOUBLE) AS c")
    ready = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    a, b, c = fo.thresholds(ready, 32)
    assert a.tolist() == [-0.5] and c.tolist() == [0.5, 1.5]
    shares = np.diff(np.searchsorted(np.log(1.0 + np.arange(40_000)), [0, *b, 99], "right")) / 40_000
    assert len(b) == 31 and shares == pytest.approx(np.full(32, 1 / 32), abs=0.01)


def test_medians_of_long_columns_are_exact(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    columns = {
        "even": [float(v) for v in range(1000)], "half": [1.0] * 500 + [2.0] * 500, "odd": [None] + [float(v * v) for v in range(999)],
        "none": [None] * 1000, "wild": [nan] * 300 + [inf] * 100 + [-inf] * 100 + [0.25] * 500, "nans": [nan] * 700 + [1.0] * 300, "zero": [-0.0, 0.0] * 500,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(7)
    monkeypatch.setattr(scale, "COUNTED_ROWS", 64)
    want = scale.group_medians(df, [], list(columns)).first().asDict()
    for kept in (3, 1 << 14):
        monkeypatch.setattr(scale, "KEPT_VALUES", kept)
        found = scale.group_medians(df, [], list(columns), rows_in_task=0).first().asDict()
        assert found.keys() == want.keys() and all(v == w or (v is not w and v != v and w != w) for v, w in zip(found.values(), want.values()))
