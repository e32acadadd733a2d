"""Benchmark items of 1 to 12 words: results of a plain definition, and as many reads of the corpus as without them."""

from __future__ import annotations

import hashlib
import random

import pytest

from gridloom.llm import winnowing
from tests.llm.brute import ALNUM, lower

DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"


def _plain(text, items):
    words, hit, found = ALNUM.findall(lower(text)), set(), set()
    for name, body in items:
        own = ALNUM.findall(lower(body))
        size = min(len(own), 13)
        for i in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[i : i + size]:
                    hit |= set(range(at, at + size))
                    found.add(name)
    listed = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), listed, bool(hit) and 20 * len(hit) >= len(words)


def _compare(spark, docs, items):
    got = winnowing.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == _plain(dict(docs)[r["doc_id"]], items), r["doc_id"]


def _text(draw, words, size):
    return " ".join(draw.choice(words) for _ in range(size))


@pytest.mark.parametrize("seed, letters", [(1, 2), (2, 5), (3, 40)])
def test_items_of_all_lengths_equal_the_plain_definition(spark, seed, letters):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(letters)]
    items = [(f"i{n}", _text(draw, words, n)) for n in [*range(1, 16), 30]]
    docs = [(i, _text(draw, words, draw.randrange(0, 60))) for i in range(25)]
    docs += [(100 + n, f"x {body.upper()}, y") for n, (_, body) in enumerate(items)] + [(200, None), (201, ""), (202, items[0][1])]
    _compare(spark, docs, items)


def test_a_document_shorter_than_the_item_that_begins_like_it_is_not_hit(spark):
    items = [("long", "a b c d e f g h"), ("twelve", "k " * 12), ("null", None), ("none", " - "), ("one", "q")]
    docs = [(1, "a b c d e"), (2, "a b c d e f g"), (3, "a b c d e f g h"), (4, "k " * 11), (5, "k " * 14), (6, "q"), (7, "a b c d e x a b c d e f g h q")]
    _compare(spark, docs, items)


def _scans(spark, tmp_path, monkeypatch, items):
    """Reads of the documents' texts in all plans that a run writes; no scratch table has a column of that name."""
    plans = []
    whole = winnowing.materialize

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, label)

    monkeypatch.setattr(winnowing, "materialize", noted)
    docs = spark.read.parquet(str(tmp_path / "corpus.parquet"))
    assert winnowing.contaminated(docs, spark.createDataFrame(items, ITEMS)).count() == 50
    return sum("FileScan" in line and "text#" in line for p in plans for line in p.splitlines())


def test_short_items_add_no_read_of_the_corpus(spark, tmp_path, monkeypatch):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    spark.createDataFrame([(i, _text(draw, words, 40)) for i in range(50)], DOCS).write.parquet(str(tmp_path / "corpus.parquet"))
    alone = _scans(spark, tmp_path, monkeypatch, [("a", _text(draw, words, 20))])
    mixed = _scans(spark, tmp_path, monkeypatch, [(f"i{n}", _text(draw, words, n)) for n in range(1, 21)])
    assert alone == mixed == 2
