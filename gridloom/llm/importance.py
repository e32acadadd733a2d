"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one of target text (at
most ``TARGETS`` documents labelled good and not toxic, chosen by hash) and one
of the raw corpus, over all documents. The n-grams are words and pairs of words
in lower case, and triples of word shapes (case, digits, kinds of punctuation,
the same word again). A document's importance weight is the ratio of the two
models over its n-grams.

The ratio per n-gram is turned into log odds of being target text by a logistic
fit on the labelled documents of the same bounded sample. Gumbel noise from the
document's own hash is added, and the k documents with the greatest sums are
drawn, which samples without replacement in proportion to the weights; k is the
number of documents whose odds favour the target.

At scale: a task adds its documents to two vectors of ``BUCKETS`` counts and
sends these once, whatever it has read; the models are two short vectors. The
draw sorts three numbers a document over range partitions, so no task holds
more than its share.

Null or empty texts have no n-grams and are judged by the prior alone. Labels
that contradict each other count as bad. A null ``doc_id`` has no label. Without
labels of both kinds there is nothing to tell apart and all documents are kept.
Ties are broken by id and text; repeated rows are drawn as rows of their own. An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.sqltext import text_keys
from gridloom.llm.textnum import LOWER, SpanHash, mix, slices, word_spans
from gridloom.operators.scale import with_position
from gridloom.session import materialize

BUCKETS = 1 << 14
TARGETS = 20_000
DAMPING = 50.0
SEED = 5

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_TOKEN = np.ones(256, bool)
_TOKEN[[9, 10, 11, 12, 13, 32]] = False
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1
_LOWER[128:] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_SEED = np.random.default_rng(1).integers(1, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram."""
    low = LOWER[data]
    hashes = SpanHash(low)
    # words and runs of other marks are tokens, in the order of the text
    a, b, r = word_spans(data, offsets, _WORD)
    c, d, s = word_spans(data, offsets, _TOKEN & ~_WORD)
    start, end, row = np.concatenate([a, c]), np.concatenate([b, d]), np.concatenate([r, s])
    order = np.argsort(start, kind="stable")
    start, end, row, word = start[order], end[order], row[order], (order < len(a))
    if not len(start):
        return row, row
    code = hashes.of(start, end)
    sums = [np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _LOWER, _DIGIT)]
    up, lo, di = (t[end] - t[start] for t in sums)
    size = end - start
    shape = np.where(di > 0, 4, np.where(up == 0, 1, np.where((up == size) & (size > 1), 3, np.where(lo + 1 >= size, 2, 5))))
    # marks: which one, and whether it is repeated
    shape = np.where(word, shape, 8 + low[start].astype(np.int64) * 4 + np.minimum(size, 3))
    last = np.zeros(len(code), np.uint64)
    at = np.flatnonzero(word)
    last[at[1:]] = code[at[:-1]]
    again = word & (last == code)
    shape = (shape + 2048 * again).astype(np.uint64)
    shape *= _SEED[0]
    rows, buckets = [row[word]], [code[word] * _SEED[1]]
    pair = np.flatnonzero(row[1:] == row[:-1])
    rows.append(row[pair])
    buckets.append(mix(code[pair] * _SEED[2] + code[pair + 1]))
    three = np.flatnonzero(row[2:] == row[:-2])
    rows.append(row[three])
    buckets.append(mix(shape[three] * _SEED[3] + shape[three + 1] * _SEED[4] + shape[three + 2]))
    return np.concatenate(rows), (np.concatenate(buckets) >> np.uint64(50)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
        for at, data, offsets in slices(batch.column("text")):
            rows, buckets = features(data, offsets)
            raw += np.bincount(buckets, minlength=BUCKETS)
            own = good[at : at + len(offsets) - 1]
            if own.any() and len(rows):
                target += np.bincount(buckets[own[rows]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    columns = [pa.array(some), pa.array(raw[some]), pa.array(target[some])]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "raw", "target"])


def _score(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, grams = [], []
            for _, data, offsets in slices(batch.column("text")):
                rows, buckets = features(data, offsets)
                grams.append(np.bincount(rows, minlength=len(offsets) - 1))
                weight.append(np.bincount(rows, weights=ratio[buckets], minlength=len(offsets) - 1))
            columns = [np.concatenate(x) if x else np.zeros(0) for x in (grams, weight)]
            out = [batch.column(c) for c in ("doc_id", "one", "two")]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(float))], ["doc_id", "one", "two", "n_grams", "log_weight"]
            )

    return run


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(y) by Newton steps, with a slight pull to zero."""
    middle, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - middle) / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    pull = np.diag([1e-3, 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + pull @ w
        curve = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + pull
        w -= np.clip(np.linalg.solve(curve, gradient), -4, 4)
    return float(w[0] / scale), float(w[1] - w[0] * middle / scale)


def importance(docs: DataFrame, labels: DataFrame, targets: int = TARGETS) -> DataFrame:
    """(doc_id, one, two, n_grams, log_weight, log_odds, key, kept) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    named = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    order = [F.xxhash64("doc_id"), "doc_id"]
    good = named.where("quality = 1 and toxic = 0").orderBy(*order).limit(targets)
    bad = named.where("quality = 0").orderBy(*order).limit(targets)
    # at most 2 x targets rows of two numbers
    picked = materialize(good.unionByName(bad).select("doc_id", F.col("quality").cast("int").alias("quality")), "picked")
    known = F.broadcast(picked.withColumnRenamed("doc_id", "labelled"))
    read = docs.select("doc_id", "text", *text_keys())
    marked = read.join(known, F.col("doc_id") == F.col("labelled"), "left")
    counted = marked.select("text", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("target")).mapInArrow(
        _count, "bucket long, raw long, target long"
    )
    totals = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.full(BUCKETS, 1.0), np.full(BUCKETS, 1.0)
    for r in totals:  # at most BUCKETS rows
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = read.mapInArrow(_score(ratio), f"doc_id {kind}, one long, two long, n_grams long, log_weight double")
    scored = materialize(scored, "scored").withColumn("mean", F.col("log_weight") / (F.col("n_grams") + DAMPING))
    told = scored.join(known, F.col("doc_id") == F.col("labelled")).where("n_grams > 0").select("mean", "quality").limit(4 * targets).toPandas()
    x, y = told["mean"].to_numpy(float), told["quality"].to_numpy() == 1
    slope, base = logistic(x, y) if y.any() and not y.all() else (0.0, 0.0)
    if slope <= 0:
        slope, base = 0.0, 0.0
    odds = scored.withColumn("log_odds", F.col("mean") * slope + base)
    unit = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "one"), F.lit((1 << 52) - 1)) + 1) / float(1 << 52)
    odds = odds.withColumn("key", F.col("log_odds") - F.log(-F.log(unit))).drop("mean")
    k = odds.where("log_odds >= 0").count()
    drawn = with_position(odds, [F.col("key").desc(), F.col("doc_id"), F.col("one"), F.col("two")], "place")
    return drawn.withColumn("kept", F.col("place") < k).drop("place")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_grams, log_weight, log_odds, key, kept) for every row of ``docs``."""
    return importance(docs, labels).drop("one", "two")


def good_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that were drawn."""
    drawn = importance(docs, labels).where("kept").select(F.col("doc_id").alias("_id"), F.col("one").alias("_one"), F.col("two").alias("_two"))
    drawn = materialize(drawn.distinct(), "drawn")
    one, two = text_keys()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_id"]) & (one == drawn["_one"]) & (two == drawn["_two"]), "left_semi")
