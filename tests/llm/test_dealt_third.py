"""Learned rank index, ball trees and the filter audit against plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import ball_tree, filter_audit, rank_index

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, mask int, key string, part string, output string, quality int"


def texts():
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("abcdefé中\U0001f600XYZ#", k=rng.randint(1, 9))) for _ in range(n))
    some = [None, "", " ", "a", "<P>x", "a<S>", "a <M> b", "<", "<P", "S><M<P", "12 34", "ab cd", "x" * 5000, "é" * 300, prose(20_000), "\n".join(["word"] * 200)]
    some += [" ".join(f"w{i}" for i in range(n)) for n in (99, 100, 101)] + ["Q" * 10 + "q" * 90, "Q" * 11 + "q" * 89]
    some += [prose(rng.randint(1, 200)) for _ in range(60)]
    return some + rng.choices(some, k=60)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(i, t, rng.choice(["en", "de", None, ""]), 1, "clash", "clash", "clash", 0) for i, t in enumerate(texts())]
    return out + [out[3], out[3], (None, "a", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def fim(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_fill_in_middle(docs, rows):
    made = rank_index.fill_in_middle(docs)
    got = made.withColumn("back", rank_index.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *fim(r[0], r[1])) for r in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert rank_index.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("error", [1, 8, 126])
def test_rank_index(error):
    rng = np.random.default_rng(1)
    for steps in (rng.integers(1, 9, 20_000), np.ones(5000, int), np.r_[np.ones(900, int), 5_000_000, rng.integers(1, 400, 900)], np.array([3]), np.zeros(0, int)):
        offsets = np.cumsum(steps)
        index = rank_index.RankIndex(offsets, error)
        ranks = np.arange(len(offsets))
        assert (index.offsets(ranks) == offsets).all()
        assert (np.abs(index.predict(ranks) - offsets) <= error + 1).all()
        assert index.residuals.dtype == np.int8
    assert len(rank_index.RankIndex(np.arange(0, 50_000, 5)).starts) == 1


def test_pieces_of_a_slice_agree(spark, docs, rows, monkeypatch):
    """Cut into slices of a few bytes or not, the index gives the same cuts."""
    from gridloom.llm import textnum

    data = [r[1] for r in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(data)], ["doc_id", "text"])
    whole = [r for b in rank_index._transform([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(rank_index, "slices", lambda t: textnum.slices(t, 100))
    assert [r for b in rank_index._transform([batch]) for r in b.to_pylist()] == whole


def failing(rows):
    out = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        w = WORDS.findall(text)
        same = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
        bits = [
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)),
            doc_id is not None and any(i < doc_id for i in same),
        ]
        out.append((doc_id, lang or "", bits))
    return out


def brute_audit(rows, good, toxic):
    bits = failing(rows)
    out, shapley = {}, Counter()
    for part in {b[1] for b in bits}:
        mine = [b for b in bits if b[1] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order, 1):
                i = "ABCDE".index(f)
                gone, stay = [b for b in left if b[2][i]], [b for b in left if not b[2][i]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), k] = (
                    len(stay), len(gone), sum(b[2][i] for b in mine) - len(gone), sum(b[2][i] and sum(b[2]) == 1 for b in mine),
                    sum(b[0] in good for b in gone), sum(b[0] in toxic for b in gone),
                )
                left = stay
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_filter_audit(spark, docs, rows):
    good, toxic = set(range(0, 140, 3)), set(range(0, 140, 7))
    data = [(i, int(i in good), int(i in toxic), "clash", 9) for i in range(140)] + [(3, None, None, "x", 1), (3, 0, 0, "x", 1), (None, 1, 1, None, None)]
    labels = spark.createDataFrame(data, "doc_id long, quality int, toxic int, part string, mask int")
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    assert got == brute_audit(rows, good, toxic)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    none = filter_audit.audit(docs, labels.limit(0)).collect()
    assert len(none) == len(got) and not any(r["good_lost"] or r["toxic_lost"] for r in none)


def test_masks(docs, rows):
    got = Counter((r["doc_id"], r["part"], r["mask"]) for r in filter_audit.failing(docs).collect())
    assert got == Counter((d, p, sum(b << i for i, b in enumerate(bits))) for d, p, bits in failing(rows))


def test_walk_toggles_one_filter_at_a_time():
    rng = np.random.default_rng(2)
    cells = np.arange(32)
    counts = rng.integers(0, 50, (32, 3))
    states = filter_audit.walk(cells, counts)
    for s in range(32):
        assert (states[s] == counts[(cells & s) == 0].sum(axis=0)).all()


EMBEDDINGS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("v", T.StringType()), T.StructField("reach", T.LongType()), T.StructField("shard", T.StringType())])


def vectors(n, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    data = [(i, [round(float(x), 1 if i % 2 else 3) * scale for x in centres[i % 6] + 0.2 * rng.normal(size=8)], "clash", 1, None) for i in range(n)]
    data += [(n + i, list(data[5][1]), None, None, None) for i in range(40)]  # copies, so scores tie
    data += [(1000, None, None, None, None), (1001, [None] + [0.0] * 7, None, None, None), (1002, [float("nan")] * 8, None, None, None), (1003, [float("inf")] * 8, None, None, None)]
    data += [(None, [1.0] * 8, None, None, None), (1100, [0.5, 1.0], None, None, None), (1101, [0.25, -1.0], None, None, None), (1200, [], None, None, None), (1201, [], None, None, None)]
    return data + [data[7], data[7], (100, [0.5] * 8, None, None, None)]


def brute_top(data, k=10):
    known = [(r[0], [int(np.floor(1024 * x)) for x in r[1]]) for r in data if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    asked = {}
    for i, v in known:
        if i % 100 == 0:
            asked[i] = min([(len(w), w) for j, w in known if j == i])[1]
    out = []
    for q, v in asked.items():
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in known if i != q and len(w) == len(v))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return Counter(out)


@pytest.mark.parametrize(("shard", "group", "leaf", "scale"), [(1 << 16, 1 << 13, 64, 1.0), (50, 2, 4, 1.0), (1, 1, 1, 1.0), (60, 3, 4, 3e10)])
def test_ball_tree(spark, monkeypatch, shard, group, leaf, scale):
    monkeypatch.setattr(ball_tree, "SHARD", shard)
    monkeypatch.setattr(ball_tree, "GROUP", group)
    monkeypatch.setattr(ball_tree.build, "__defaults__", (leaf,))
    data = vectors(40 if shard == 1 else 320, scale=scale)
    frame = spark.createDataFrame(data, EMBEDDINGS).repartition(3)
    got = ball_tree.top_k(frame, F.col("vec_id") % 100 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_top(data)
    assert ball_tree.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = frame.where("vec_id IN (5, 100)")
    assert Counter(map(tuple, ball_tree.top_k(few, F.col("vec_id") % 100 == 0).collect())) == brute_top([r for r in data if r[0] in (5, 100)])


def test_bounds_prune_and_the_shared_score_prunes_more():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 900
    data = np.floor(centres[rng.integers(0, 40, 8000)] + 30 * rng.normal(size=(8000, 16)))
    ids, queries = np.arange(8000), data[:50]
    tree = ball_tree.build(data)
    reach = np.full(50, -np.inf)
    scores, found, visits = ball_tree.search(tree, data, ids, queries, ids[:50], reach, 10)
    assert visits < 50 * 128 / 3
    all_scores = queries @ data.T
    all_scores[np.arange(50), np.arange(50)] = -np.inf
    assert (scores == -np.sort(-all_scores, axis=1)[:, :10]).all()
    again = ball_tree.search(tree, data, ids, queries, ids[:50], scores[:, -1], 10)
    assert (again[0] == scores).all() and (again[1] == found).all() and again[2] <= visits
