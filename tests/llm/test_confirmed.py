"""Texts built so that polynomial hashes modulo powers of two agree, and hashes against plain modular sums."""

from __future__ import annotations

import numpy as np

from gridloom.llm import suffix_spans, textnum
from gridloom.llm.chosen_path import near_duplicates, one_of_each
from tests.llm import brute


def pair(n, a="a", b="b"):
    """Two words of ``n`` letters that differ at every place."""
    signs = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[s] for s in signs), "".join((b, a)[s] for s in signs)


def test_span_hash_is_the_plain_sum():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 300).astype(np.uint8)
    p = int(textnum.PRIME)
    spans = textnum.SpanHash(data)
    starts, ends = np.array([0, 5, 17, 299, 4]), np.array([300, 9, 17, 300, 260])
    plain = [[sum((int(data[i]) + 1) * pow(base, int(i - s), p) for i in range(s, e)) % p for s, e in zip(starts, ends)] for base in textnum.BASES]
    want = textnum.mix(np.array(plain[0], np.uint64) | np.array(plain[1], np.uint64) << np.uint64(31))
    assert (spans.of(starts, ends) == want).all()
    assert (spans.rolling(64) == spans.of(np.arange(237), np.arange(64, 301))).all()
    one, two = (np.frombuffer(t.encode(), np.uint8) for t in pair(4096))
    assert textnum.SpanHash(one).of(np.array([0]), np.array([4096])) != textnum.SpanHash(two).of(np.array([0]), np.array([4096]))


def test_large_slices_hash_alike(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, (1 << 24) + 100).astype(np.uint8)
    at, end = np.array([0, 1 << 24]), np.array([90, (1 << 24) + 90])
    got = textnum.SpanHash(data).of(at, end)
    assert got[0] == textnum.SpanHash(data[:90]).of(np.array([0]), np.array([90]))[0]
    assert got[1] == textnum.SpanHash(data[1 << 24 :]).of(np.array([0]), np.array([90]))[0]


def test_built_words_are_not_linked(spark):
    one, two = pair(1024)
    docs = spark.createDataFrame([(1, one), (2, two), (3, one), (4, " ".join([one] * 6)), (5, " ".join([two] * 6))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_built_stretches_stay(spark):
    """A shared anchor in the middle of bytes that differ everywhere."""
    rows = []
    for n in (1024, 512):
        one, two = pair(n, "x", "y")
        rows += [one, two, one[:300] + "Q" * 64 + two[:355], two[:300] + "Q" * 64 + one[:355]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute.removed(list(enumerate(rows)))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_spans.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "x", "y"), (1, "a b c d e f", "x", "y"), (2, "g h i j k l", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark string, n string")
    assert sorted(map(tuple, one_of_each(docs).collect())) == [rows[0], rows[2]]
