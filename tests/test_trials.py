"""Trials of learners against numpy and plain definitions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import models as ml
from gridloom.operators import trials as tr
from gridloom.session import materialize, scratch_path

SPEC = ml.FeatureSpec(["a", "b"], ["use"], "y", forbidden=("y", "id"))
NUMBERS = ml.FeatureSpec(["a", "b"], [], "y", forbidden=("y", "id"))
SHORT = {"numTrees": 4, "maxDepth": 5}


def _rows(n=600, seed=3):
    """The label is the exponential of a line; the last use occurs in testing only, a few targets are unknown."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = float(rng.integers(0, 40)) / 10, None if i % 13 == 0 else float(rng.integers(0, 9))
        split = "training" if i < 0.6 * n else "validation" if i < 0.8 * n else "testing"
        use = "late" if i > 0.95 * n else ["office", "school", None][i % 3]
        y = None if i % 37 == 5 else math.exp(0.9 * a + 0.2 * (b if b is not None else 4.0)) + (i % 5) * 0.01
        rows.append((i, a, b, use, split, y))
    return rows


SCHEMA = "id long, a double, b double, use string, split string, y double"


@pytest.fixture(scope="module")
def table(spark):
    return materialize(spark.createDataFrame(_rows(), SCHEMA), "trials")


@pytest.fixture(scope="module")
def done(spark, table):
    learners = [tr.Learner("median", "median"), tr.Learner("line", "linear"), tr.Learner("forest", "forest_electricity", True, SHORT),
                tr.Learner("leaves", "leafwise", options={"trees": 5, "leaves": 6})]
    return tr.run_all(learners, table, SPEC)


def _matrix(rows, median, mean, std):
    x = np.array([[r[1], median[1] if r[2] is None else r[2]] for r in rows])
    return (x - mean) / std


@pytest.mark.parametrize("kind, alpha, log", [("linear", 0.0, False), ("ridge", 25.0, False), ("ridge", 25.0, True)])
def test_linear_and_ridge_equal_the_normal_equations(spark, table, kind, alpha, log):
    known = [r for r in _rows() if r[5] is not None]
    train = [r for r in known if r[4] == "training"]
    median = (None, float(np.median([r[2] for r in train if r[2] is not None])))
    raw = np.array([[r[1], median[1] if r[2] is None else r[2]] for r in train])
    mean, std = raw.mean(0), raw.std(0)
    z, y = (raw - mean) / std, np.array([r[5] for r in train])
    label = np.log1p(y) if log else y
    weights = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (label - label.mean()))
    held = [r for r in known if r[4] == "testing"]
    p = _matrix(held, median, mean, std) @ weights + label.mean()
    p = np.maximum(np.expm1(p) if log else p, 0)
    actual = np.array([r[5] for r in held])
    trial = tr.run(tr.Learner("x", kind, log, {"alpha": alpha} if alpha else {}), table, NUMBERS, scratch_path(spark, "model"))
    assert trial.row["testing_mae"] == pytest.approx(np.abs(p - actual).mean(), rel=1e-6)
    assert trial.row["testing_rmse"] == pytest.approx(math.sqrt(((p - actual) ** 2).mean()), rel=1e-6)
    assert trial.row["testing_row_count"] == len(held)
    assert trial.row["training_rows"] == len(train)


def test_stored_models_predict_as_the_fitted_ones(spark, table, done):
    for t in done:
        again = tr.load(spark, t.learner, t.path)
        assert tr._unequal(t.model, again, table, t.spec) == 0
        assert t.row["artifact_bytes"] > 0 and t.row["fit_seconds"] > 0 and t.row["score_seconds"] > 0


def test_a_model_that_differs_is_noticed(table, done):
    assert tr._unequal(done[0].model, done[1].model, table, done[1].spec) > 500


def test_every_held_out_row_with_a_target_is_measured_and_none_is_negative(table, done):
    want = {r["split"]: r["n"] for r in table.where("split <> 'training' AND y IS NOT NULL").groupBy("split").agg(F.count("*").alias("n")).collect()}
    for t in done:
        got = {r["split"]: r["n"] for r in t.predictions.groupBy("split").agg(F.count("*").alias("n")).collect()}
        assert got == want
        assert t.predictions.agg(F.min("prediction")).first()[0] >= 0


def test_a_folder_that_holds_a_model_is_not_overwritten(table, done):
    with pytest.raises(Exception, match="exist"):
        tr.run(done[0].learner, table, SPEC, done[0].path)


def test_choices_follow_their_rules(spark):
    def row(name, mae, rmsle, r2, rmse, test, seconds, size):
        base = {f"{s}_{m}": None for s in tr.PARTS for m in tr.METRICS}
        base |= {"validation_mae": mae, "validation_rmsle": rmsle, "validation_r2": r2, "validation_rmse": rmse, "testing_rmse": test}
        return {"model": name, "learner": name, "target_strategy": "raw", "training_rows": 5, "fit_seconds": 1.0, "score_seconds": seconds, "artifact_bytes": size, **base}

    rows = [row("c", 2.0, 1.0, 0.5, 4.0, 9.0, 0.1, 900), row("b", 2.0, 0.9, 0.4, 4.0, 8.0, 0.3, 100), row("d", 3.0, 0.1, 0.9, 3.5, None, 0.2, 100)]
    table = tr.comparison(spark, [tr.Trial(None, None, "", None, None, r) for r in rows])
    found = {r["rule"]: r["best_model"] for r in tr.choices(table).collect()}
    assert found == {"published": "b", "best_validation": "d", "best_testing": "b", "fastest": "c", "smallest": "b"}
    assert {r["best_model"] for r in tr.choices(table.limit(0)).collect()} == {None}


def test_screening_takes_the_log_of_an_exponential_label_and_then_all_rows(table):
    tried, final = tr.screened([tr.Learner("line", "linear")], table, NUMBERS, ["id"], train_rows=100, validation_rows=40)
    assert [t.row["model"] for t in tried] == ["line_raw", "line_log"]
    assert all(t.row["training_rows"] <= 100 and t.row["validation_row_count"] <= 40 for t in tried)
    assert tried[0].row["testing_mae"] is None
    assert [t.row["model"] for t in final] == ["line_log"]
    assert final[0].row["training_rows"] == table.where("split = 'training' AND y IS NOT NULL").count()


def test_electricity_path_samples_training_rows_only(table):
    learners = [tr.Learner("dummy", "median"), tr.Learner("line", "linear")]
    trials, bands = tr.electricity_trials(table, NUMBERS, ["id"], cap=100, learners=learners)
    known = [r for r in _rows() if r[4] == "training" and r[5] is not None]
    stride = math.ceil(len(known) / 100)
    sample = [r[5] for r in known[::stride]][:100]
    assert {t.row["training_rows"] for t in trials} == {len(sample)}
    middle = float(np.median(sample))
    held = [r[5] for r in _rows() if r[4] == "validation" and r[5] is not None]
    assert trials[0].row["validation_mae"] == pytest.approx(np.abs(np.array(held) - middle).mean())
    rows = bands.collect()
    limits = np.quantile(sample, [0.5, 0.9, 0.99])
    for name in ("dummy_raw", "line_raw"):
        got = {r["band"]: r["row_count"] for r in rows if r["model"] == name and r["split"] == "validation"}
        place = np.searchsorted(limits, held, side="left")
        want = {b: int((place == i).sum()) for i, b in enumerate(["small", "medium", "large", "peak"]) if (place == i).any()}
        assert got == want


def test_electricity_path_fits_all_training_rows(spark):
    """More training rows than the published sample of 250,000; the last tenth, all large, moves every limit."""
    n = 300_000
    y = F.expr(f"CASE WHEN id < {n} AND id >= {n * 9 // 10} THEN 5000.0D ELSE CAST(id % 1000 AS DOUBLE) END")
    split = F.when(F.col("id") < n, "training").when(F.col("id") < n + 500, "validation").otherwise("testing")
    rows = spark.range(n + 1000).select("id", (F.col("id") % 10).cast("double").alias("a"), F.lit(1.0).alias("b"), split.alias("split"), y.alias("y"))
    # rows that share their order columns, or lack one, are fitted once each like all others
    rows = materialize(rows.withColumn("id", F.when(F.col("id") % 5 > 0, F.col("id") % 7)), "all-rows")
    trials, bands = tr.electricity_trials(rows, NUMBERS, ["id"], learners=[tr.Learner("dummy", "median"), tr.Learner("line", "linear")])
    assert {t.row["training_rows"] for t in trials} == {n}
    values = np.where(np.arange(n) >= n * 9 // 10, 5000.0, np.arange(n) % 1000)
    held = np.arange(n, n + 500) % 1000
    assert trials[0].row["validation_mae"] == pytest.approx(np.abs(held - np.median(values)).mean())
    place = np.searchsorted(np.quantile(values, [0.5, 0.9, 0.99]), held, side="left")
    want = {b: int((place == i).sum()) for i, b in enumerate(["small", "medium", "large", "peak"]) if (place == i).any()}
    got = {r["band"]: r["row_count"] for r in bands.where("model = 'dummy_raw' AND split = 'validation'").collect()}
    assert got == want


def test_importances_of_all_models_in_one_table(table, done):
    rows = tr.importances(done, table.where("split = 'validation'"), "id").collect()
    found = {(r["model"], r["feature"]): r for r in rows}
    assert len(found) == len(rows) == 4 * 3
    for model in ("line_raw", "forest_log", "leaves_raw"):
        assert max(("a", "b", "use"), key=lambda c: found[model, c]["permutation_importance"]) == "a"
        assert found[model, "a"]["native_importance"] > 0
    assert all(found["median_raw", c]["native_importance"] is None and found["median_raw", c]["permutation_importance"] == 0 for c in ("a", "b", "use"))


def test_names_must_differ_and_training_must_have_targets(spark, table):
    with pytest.raises(ValueError, match="share a name"):
        tr.run_all([tr.Learner("x", "median"), tr.Learner("x", "linear")], table, SPEC)
    with pytest.raises(ValueError, match="no training row"):
        tr.run(tr.Learner("x", "median"), table.where("split <> 'training'"), SPEC, scratch_path(spark, "model"))
