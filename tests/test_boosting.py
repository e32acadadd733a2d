"""Leaf-wise boosting and ordered target codes against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import boosting, encoding


def table(n=700, seed=0):
    rng = np.random.default_rng(seed)
    a, b, c = rng.random(n) * 10, rng.integers(0, 6, n).astype(float), rng.normal(size=n)
    y = np.where(a > 6, 8.0, a) + 2 * (b == 3) + 0.1 * rng.normal(size=n)
    a[rng.random(n) < 0.1] = np.nan
    return np.column_stack([a, b, c]), np.round(y, 3), rng.random(n) < 0.25


def frame(spark, x, y, held, parts):
    rows = [(*[None if np.isnan(v) else float(v) for v in r], float(t), bool(h), i) for i, (r, t, h) in enumerate(zip(x, y, held))]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, held boolean, id long").repartition(parts)


def plain_boost(codes, y, held, settings, unit):
    """Best-first growth one cut at a time, from the rows themselves."""
    fit = ~held
    whole = lambda v: int(np.rint(v * unit).sum())
    base = whole(y[fit]) / int(fit.sum()) / unit
    score, trees = np.full(len(y), base), []
    for _ in range(settings.trees):
        g = np.rint((score - y) * unit).astype(np.int64)
        leaves, done = {0: np.flatnonzero(fit)}, []

        def best(rows, g=g):
            top = (0.0, None)
            n, s = len(rows), int(g[rows].sum())
            for c in range(codes.shape[1]):
                for missing_left in (True, False):
                    for cut in range(1, 256):
                        code = codes[rows, c]
                        left = np.where(code == 0, missing_left, code <= cut)
                        nl, sl = int(left.sum()), int(g[rows][left].sum())
                        if nl < settings.least_rows or n - nl < settings.least_rows:
                            continue
                        gain = float(sl) ** 2 / (nl + settings.l2) + float(s - sl) ** 2 / (n - nl + settings.l2) - float(s) ** 2 / (n + settings.l2)
                        if gain > top[0]:
                            top = (gain, (c, cut, missing_left, left))
            return top

        found = {0: best(leaves[0])}
        names = 1
        while len(leaves) < settings.leaves:
            node = max(leaves, key=lambda k: (found[k][0], -k))
            if found[node][1] is None:
                break
            c, cut, missing_left, left = found[node][1]
            rows = leaves.pop(node)
            done.append((c, cut, missing_left, len(rows)))
            for part in (rows[left], rows[~left]):
                leaves[names] = part
                found[names] = best(part)
                names += 1
            ends = {k: -settings.rate * int(g[r].sum()) / unit / (len(r) + settings.l2) for k, r in leaves.items()}
        trees.append((sorted(done), sorted(round(v, 9) for v in ends.values())))
        for k, rows in leaves.items():
            score[rows] += ends[k]
    return base, trees


@pytest.mark.parametrize("parts", [1, 5])
def test_trees_equal_the_plain_version(spark, parts):
    x, y, held = table(260)
    settings = boosting.Settings(trees=3, leaves=6, bins=12, rate=0.5, least_rows=7, l2=1.0, refresh=2)
    df = frame(spark, x, y, held, parts)
    model = boosting.fit_booster(df, ["a", "b", "c"], "y", F.col("held"), settings)
    codes = boosting.coded(list(x.T), [np.array(e) for e in model.edges])
    base, trees = plain_boost(codes, y, held, settings, (1 << boosting.UNIT_BITS) / np.abs(y).max())
    assert model.base == base
    for tree, (cuts, ends) in zip(model.trees, trees, strict=True):
        rows = np.flatnonzero(~held)
        sizes = {0: len(rows)}
        at = tree.leaf_of(codes[rows])
        for node in range(len(tree.column) - 1, -1, -1):
            sizes[node] = int((at == node).sum()) if tree.column[node] < 0 else sizes[tree.left[node]] + sizes[tree.right[node]]
        assert sorted((tree.column[i], tree.cut[i], tree.missing_left[i], sizes[i]) for i in range(len(tree.column)) if tree.column[i] >= 0) == cuts
        assert sorted(round(tree.value[i], 9) for i in range(len(tree.column)) if tree.column[i] < 0) == ends


def test_layout_does_not_matter_and_models_reload(spark, tmp_path):
    x, y, held = table()
    settings = boosting.Settings(trees=6, leaves=8, rate=0.3, least_rows=5, refresh=3)
    models = [boosting.fit_booster(frame(spark, x, y, held, p), ["a", "b", "c"], "y", F.col("held"), settings) for p in (1, 7)]
    assert models[0] == models[1]
    models[0].save(spark, str(tmp_path / "model"))
    again = boosting.Booster.load(spark, str(tmp_path / "model"))
    df = frame(spark, x, y, held, 3)
    both = df.select(models[0].scored().alias("p"), again.scored().alias("q"), "y").toPandas()
    assert (both["p"] == both["q"]).all() and (both["p"] - both["y"]).abs().mean() < 0.8
    assert models[0].losses[-1] < models[0].losses[0] / 3
    assert max(models[0].importance(spark).collect(), key=lambda r: r["importance"])["feature"] == "a"


def test_early_stopping_and_odd_tables(spark):
    rng = np.random.default_rng(3)
    x, y, held = rng.random((300, 3)), rng.normal(size=300), np.arange(300) % 3 == 0
    settings = boosting.Settings(trees=30, leaves=12, rate=0.5, least_rows=2, patience=3)
    model = boosting.fit_booster(frame(spark, x, y, held, 2), ["a", "b", "c"], "y", F.col("held"), settings)
    assert len(model.trees) < 10 and len(model.trees) == int(np.argmin(model.losses))
    df = frame(spark, x, y, held, 2)
    assert boosting.fit_booster(df.limit(0), ["a"], "y").trees == []
    flat = boosting.fit_booster(df.withColumn("y", F.lit(3.0)), ["a", "b"], "y", settings=boosting.Settings(trees=3))
    assert flat.trees == [] and flat.base == 3.0
    empty = boosting.fit_booster(df.withColumn("a", F.lit(None).cast("double")), ["a"], "y", settings=boosting.Settings(trees=2))
    assert empty.trees == []
    with pytest.raises(ValueError):
        boosting.Settings(bins=300)


def test_rows_do_not_move(spark):
    """Between reading the blocks and the sums there is one exchange, of histograms."""
    x, y, held = table(100)
    df = frame(spark, x, y, held, 2)
    slim = df.select(F.col("a").alias("c0"), F.col("y").alias("_label"), F.col("held").alias("_held"))
    blocks = slim.mapInArrow(boosting._to_blocks([[1.0, 5.0]]), boosting._BLOCK)
    tree = boosting.Tree()
    tree.add(0.0)
    sums = blocks.mapInArrow(boosting._histograms(1, 0.0, [], tree, [0], 1.0), boosting._SUMS)
    assert sums._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the repartition of the test's rows
    assert sums.count() <= 2 * 2


def plain_codes(rows, seed_order, weight):
    known = [y for _, _, y in rows if y is not None]
    prior = sum(known) / len(known)
    sums, out = {}, {}
    for i, cat, y in sorted(rows, key=lambda r: seed_order[r[0]]):
        n, s = sums.get(cat, (0, 0.0))
        out[i] = (s + prior * weight) / (n + weight)
        if y is not None:
            sums[cat] = (n + 1, s + y)
    return out, prior


def test_ordered_target_codes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, str(rng.choice(["hot", "hot", "hot", "a", "", "b"])) if i % 11 else None, float(rng.integers(0, 50)) if i % 7 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, cat string, y double").repartition(8)
    hashes = {r[0]: (r[1], r[0]) for r in df.select("id", encoding.seeded("id", 7)).collect()}
    want, prior = plain_codes(rows, hashes, 2.0)
    got = {r["id"]: r["code"] for r in encoding.ordered_target_codes(df, "id", "cat", "y", seed=7, weight=2.0).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert encoding.ordered_target_codes(df.limit(0), "id", "cat", "y").count() == 0


def test_hot_category_is_cut_over_tasks(spark):
    df = spark.range(20_000).select("id", F.lit("one").alias("cat"), (F.col("id") % 5).cast("double").alias("y")).repartition(8)
    from gridloom.operators.scale import _range_sorted

    slim = df.select("id", "cat", encoding.seeded("id", 1).alias("h"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in _range_sorted(slim, [F.col("cat"), F.col("h"), F.col("id")]).groupBy("_pid").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) < 20_000 / 2


def test_codes_of_new_rows(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("", None)], "cat string, y double")
    prior = encoding.target_prior(train, "y")
    codes = encoding.target_codes(train, "cat", "y", weight=1.0)
    new = spark.createDataFrame([("a",), (None,), ("",), ("new",)], "cat string")
    got = [r["code"] for r in encoding.apply_target_codes(new.coalesce(1), codes, "cat", prior).orderBy(F.col("cat").asc_nulls_first()).collect()]
    assert got == [(5 + 3) / 2, 3.0, (4 + 3) / 3, 3.0]


def plain_cut(counts, sums, settings):
    """Best cut of one column, by trying all."""
    n, g = int(counts.sum()), int(sums.sum())
    best = (-1.0, 0, True, 0, 0)
    for missing_left in (True, False):
        for cut in range(1, len(counts)):
            n_left, g_left = int(counts[1 : cut + 1].sum()), int(sums[1 : cut + 1].sum())
            if missing_left:
                n_left, g_left = n_left + int(counts[0]), g_left + int(sums[0])
            if min(n_left, n - n_left) < settings.least_rows:
                continue
            gain = float(g_left) ** 2 / (n_left + settings.l2) + float(g - g_left) ** 2 / (n - n_left + settings.l2) - float(g) ** 2 / (n + settings.l2)
            if gain > max(best[0], 0.0):
                best = (gain, cut, missing_left, n_left, g_left)
    return best


@pytest.mark.parametrize("l2", [0.0, 1.5])
def test_best_cut_of_many_columns(l2):
    rng = np.random.default_rng(8)
    settings = boosting.Settings(least_rows=3, l2=l2)
    for trial in range(60):
        n, width = int(rng.integers(1, 40)), int(rng.integers(1, 9))
        x, grad = rng.integers(0, 6, (n, width)), rng.integers(-5, 6, n)
        if trial % 3 == 0:
            x[:, -1] = x[:, 0]  # equal gains
        counts = np.array([np.bincount(c, minlength=256) for c in x.T])
        sums = np.array([np.bincount(c, grad, 256).astype(np.int64) for c in x.T])
        each = [plain_cut(a, b, settings) for a, b in zip(counts, sums)]
        top = max(range(width), key=lambda c: (each[c][0], -c))
        gain, column, *cut = boosting.best_cut(counts, sums, settings)
        assert gain == pytest.approx(each[top][0], abs=1e-9)
        if gain > 0 and sum(abs(e[0] - gain) < 1e-9 for e in each) == 1:
            assert (column, *cut) == (top, *each[top][1:])


def test_histograms_travel_in_packs(spark):
    """A task sends a row per leaf and pack of columns, and only as many bins as the columns have."""
    rng = np.random.default_rng(9)
    width = 2 * boosting.PACK + 3
    rows = [(*map(float, rng.integers(0, 3, width)), float(y), False) for y in rng.normal(size=80)]
    names = [f"c{i}" for i in range(width)]
    slim = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", _label double, _held boolean").repartition(2)
    edges = [[0.0, 1.0]] * width
    blocks = slim.mapInArrow(boosting._to_blocks(edges), boosting._BLOCK)
    tree = boosting.Tree()
    tree.add(0.0)
    sums = blocks.mapInArrow(boosting._histograms(width, 0.0, [], tree, [0], 8.0, [4] * width), boosting._SUMS).collect()
    sent = [r for r in sums if r["node"] == 0]
    assert sorted({r["column"] for r in sent}) == [0, boosting.PACK, 2 * boosting.PACK] and len(sent) <= 2 * 3
    assert {len(r["counts"]) for r in sent} == {8 * 4 * boosting.PACK, 8 * 4 * 3}
    assert sum(np.frombuffer(r["counts"], np.int64).sum() for r in sent) == 80 * width
