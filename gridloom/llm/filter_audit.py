"""How quality filters act together, from a Gray-code walk over all subsets.

Every document gets one mask of the filters it fails. Counts per part and mask
(at most 32 cells a part) hold all that any order of the filters can show. The
walk visits all 32 subsets of the five filters and toggles one filter at each
step: the cells that fail it get their counter of active failures raised or
lowered, and a cell whose counter leaves or reaches zero leaves or joins the
running survivors. The survivors of the 32 states are stored, and a step of an
order is the difference of two states.

Filters, on words between ASCII white space: A under 100 words, B under 80 % of
them distinct, C over 10 % of the code points are A-Z, D holds any of
``#$%&*|``, E equal to the text of a document with a smaller ``doc_id``.

At scale: a text is read once and leaves as some sixty bytes, written once.
Equal texts are found by SHA-256 with a minimum per hash that is combined before
it moves; only hashes that occur under several ids are joined back, and the
adaptive skew join cuts a hot one. A part is 32 cells, whatever it holds.

Null texts count as empty, a null ``lang`` as the empty part. A null ``doc_id``
is never smaller than another, never fails E and has no labels. Repeated rows
count each; those of equal ``doc_id`` don't make each other fail E. Repeated
labels of an id count once, any row that says 1 decides. An empty table gives no rows;
extra columns are ignored. Equal ids need no order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialize

FILTERS = "ABCDE"
STATES = 1 << len(FILTERS)
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
INNER = bytes(range(128, 192))  # UTF-8 bytes that begin no code point


def failures(text: bytes) -> int:
    """Bits of the filters A to D that ``text`` fails."""
    words = text.split()  # bytes split at ASCII white space only
    n, distinct = len(words), len(set(words))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, INNER))
    signs = len(text.translate(None, SIGNS)) < len(text)
    return (n < 100) | (100 * distinct < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | signs << 3


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, keys = [], []
        for value in batch.column("text"):
            text = (value.as_py() or "").encode()
            masks.append(failures(text))
            keys.append(hashlib.sha256(text).digest())
        arrays = [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "mask", "key"])


def failing(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of ``docs`` (doc_id, text, lang); bit i of the mask is filter i of ``FILTERS``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    seen = materialize(slim.mapInArrow(_digests, f"doc_id {kind}, part string, mask int, key binary"), "digests")
    several = seen.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return seen.join(several, "key", "left").select(
        "doc_id", "part", F.col("mask").bitwiseOR(F.when(later, 1 << 4).otherwise(0)).alias("mask")
    )


def walk(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of the filters: one row of sums of ``counts`` per state.

    ``cells`` are masks, ``counts`` one row per cell.
    """
    states = np.zeros((STATES, counts.shape[1]), np.int64)
    active = np.zeros(len(cells), np.int64)
    running = counts.sum(axis=0)
    subset = 0
    states[subset] = running
    for step in range(1, STATES):
        bit = (step & -step).bit_length() - 1  # the filter that the Gray code toggles now
        subset ^= 1 << bit
        hit = (cells >> bit & 1).astype(bool)
        if subset >> bit & 1:
            running = running - counts[hit & (active == 0)].sum(axis=0)
            active[hit] += 1
        else:
            active[hit] -= 1
            running = running + counts[hit & (active == 0)].sum(axis=0)
        states[subset] = running
    return states


def steps(cells: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique, good_lost, toxic_lost, shapley) of all orders."""
    states = walk(cells, counts)
    failed = [int(counts[(cells >> i & 1).astype(bool), 0].sum()) for i in range(len(FILTERS))]
    alone = [int(states[STATES - 1 - (1 << i), 0] - states[STATES - 1, 0]) for i in range(len(FILTERS))]
    rows, shapley = [], [0] * len(FILTERS)
    for order in permutations(range(len(FILTERS))):
        subset = 0
        for k, i in enumerate(order, 1):
            lost = states[subset] - states[subset | 1 << i]
            subset |= 1 << i
            removed = int(lost[0])
            shapley[i] += removed
            rows.append((i, "".join(FILTERS[j] for j in order), k, int(states[subset, 0]), removed, failed[i] - removed, alone[i], int(lost[1]), int(lost[2])))
    return [(*r[1:], shapley[r[0]]) for r in rows]


COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _part(frame: pd.DataFrame) -> pd.DataFrame:
    rows = steps(frame["mask"].to_numpy(np.int64), frame[["n", "good", "toxic"]].to_numpy(np.int64))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")[1:]])
    out.insert(0, "part", frame["part"].iloc[0])
    return out


def cell_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, those labelled good and those labelled toxic."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")
    )
    count = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c[1:])
    return masks.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("_good"), count("_toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with what each step does."""
    return cell_counts(failing(docs), labels).groupBy("part").applyInPandas(_part, COLUMNS)
