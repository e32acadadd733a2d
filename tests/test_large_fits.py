"""Fits and importances whose memory and time follow the rows and not the trees or the columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import models as ml

SPEC = ml.FeatureSpec(["a", "b"], ["kind"], "y", forbidden=("y", "id"))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        a, kind = rng.uniform(0, 10), rng.choice(["x", "y", None])
        data.append((i, a if i % 13 else None, rng.choice([0.0, 1.0, None]), kind, None if i % 29 == 0 else 3 * a + (5 if kind == "y" else 0)))
    return spark.createDataFrame(data, "id long, a double, b double, kind string, y double").repartition(3, "id").cache()


@pytest.mark.parametrize("kind", ["tree", "forest", "forest_electricity"])
def test_tasks_of_an_executor_have_room_together(spark, kind):
    learner = ml.estimator(kind, "y")
    # four tasks hold their sums, and hand them on, within a third of 6 GB of heap
    assert 4 * 2 * learner.getMaxMemoryInMB() <= 2048
    assert learner.getCacheNodeIds()


def test_room_and_node_numbers_leave_the_model_as_it_is(rows):
    small = {"numTrees": 3, "maxDepth": 8}
    now = ml.fit("forest_electricity", rows, SPEC, **small)
    earlier = ml.fit("forest_electricity", rows, SPEC, **small, maxMemoryInMB=1024, cacheNodeIds=False)
    assert now.stages[-1].toDebugString.split("\n")[1:] == earlier.stages[-1].toDebugString.split("\n")[1:]


def _one_at_a_time(model, rows, names, seed=ml.SEED, repeats=2):
    """Every column shuffled for itself, every row prepared and predicted again."""
    own = rows.select("id", "y", *names).orderBy("id").toPandas()
    spark = rows.sparkSession

    def mae(table):
        data = [tuple(None if v != v else v for v in r) for r in table.itertuples(index=False)]
        scored = ml.predict(model, spark.createDataFrame(data, "id long, y double, a double, b double, kind string"), SPEC)
        return scored.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]

    out = dict.fromkeys(names, 0.0)
    for r in range(repeats):
        other = rows.select("id", *names).orderBy(F.xxhash64("id", F.lit(seed + r)), "id").toPandas()
        for c in names:
            out[c] += (mae(own.assign(**{c: other[c].values})) - mae(own)) / repeats
    return out


@pytest.mark.parametrize(("kind", "options"), [("tree", {"minInstancesPerNode": 5}), ("linear", {})])
def test_importances_are_those_of_one_column_at_a_time(rows, monkeypatch, kind, options):
    model = ml.fit(kind, rows, SPEC, **options)
    want = _one_at_a_time(model, rows, ["a", "b", "kind"])
    scored, predict = [], ml.predict
    monkeypatch.setattr(ml, "predict", lambda m, df, spec: scored.append(df.columns) or predict(m, df, spec))
    found = {r.feature: r.importance for r in ml.permutation_importance(model, rows, SPEC, "id").collect()}
    assert found == pytest.approx(want, abs=1e-9)
    # vectors are scored, no row is prepared once more for each column
    assert scored and not any({"a", "kind"} & set(columns) for columns in scored)
    few = {r.feature: r.importance for r in ml.permutation_importance(model, rows, SPEC, "id", features=["kind"]).collect()}
    assert few == pytest.approx({"kind": want["kind"]}, abs=1e-9)


def test_importances_need_a_target(rows):
    model = ml.fit("linear", rows, SPEC)
    with pytest.raises(ValueError, match="target"):
        ml.permutation_importance(model, rows.withColumn("y", F.lit(None).cast("double")), SPEC, "id")
