"""Bytes covered by a 400-byte string that starts anywhere else, by two-stage suffix sorting.

A suffix array of the whole corpus does not fit a task, so candidates come
first: every window of 400 bytes names one anchor, its least 64-byte gram (the
leftmost among equals). Equal windows have equal anchors at equal offsets, so
only windows whose anchor occurs again can repeat. The windows of one anchor
form a stretch of bytes; equal stretches fold into one row with a count before
anything moves. Where several different stretches share an anchor, their bytes
are sorted as suffixes: only suffixes smaller than their successors directly,
the others by scanning buckets, and windows with a common prefix of 400 bytes
with a neighbour repeat.

An anchor that very many different stretches share (a passage in many
documents) is cut by its windows' offset and by the bytes all windows of such a
class have in common, in finer classes until each fits a task; at the finest a
window is alone with its equals. Nothing is dropped or capped.

Null or empty texts have no bytes. Repeated rows and rows with equal text are
copies of each other: 400 bytes or more of them go entirely. A null ``doc_id``
is kept as it is. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.sqltext import text_keys
from gridloom.llm.textnum import SpanHash, slices
from gridloom.session import materialize

LENGTH, GRAM = 400, 64
IN_TASK = 600
CLASSES = (96, 24, 6, 2, 1)
SORT_BYTES = 1 << 17
PLACE = np.uint64((1 << 31) - 1)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive keys (prefix and suffix minima of blocks)."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, start, offset of the anchor, windows, digest) of every run of windows with one anchor.

    Runs are taken for equal by the digest, 128 bits of SHA-256, and not by the anchors' hashes.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty.astype(np.uint64), empty, empty, empty, []
    grams = SpanHash(data).rolling(GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least((grams & ~PLACE) | place, LENGTH - GRAM + 1) & PLACE).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int32)
    long = np.diff(offsets) >= LENGTH
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid)[: len(anchor)])
    if not len(starts):
        return empty, empty.astype(np.uint64), empty, empty, empty, []
    at = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(starts) > 1)
    # an anchor that both ends one text and starts the next can't be: windows stay inside a text
    first = starts[new]
    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
    at = at[new]
    row = np.searchsorted(offsets, first, "right") - 1
    raw = data.tobytes()
    digests = [hashlib.sha256(raw[a:z]).digest()[:16] for a, z in zip(first.tolist(), (first + count - 1 + LENGTH).tolist())]
    return row, grams[at], first - offsets[row], at - first, count, digests


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["one", "two", "doc_id", "anchor", "start", "off", "windows", "body"]
    for batch in batches:
        for begin, data, offsets in slices(batch.column("text")):
            row, gram, start, off, count, body = stretches(data, offsets)
            take = pa.array(row + begin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("one", "two", "doc_id")]
                + [pa.array(gram.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(body, pa.binary())],
                names,
            )


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least, by two-stage sorting.

    Directly sorted are the suffixes smaller than their successor. The bucket
    of a first byte holds the larger kind first; scanning the buckets in order
    puts the suffix before each entry, if of the larger kind, next into the
    bucket of its own first byte.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    differs = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.zeros(n, bool)
    # within a run of one byte the kind is that of the run's end; the last suffix is larger than the empty one
    bounds = np.append(differs, n - 1)
    kind = np.append(text[differs] < text[differs + 1], False)
    smaller[:] = np.repeat(kind, np.diff(np.append(-1, bounds)))
    raw = text.tobytes()
    direct = sorted(np.flatnonzero(smaller).tolist(), key=lambda i: raw[i : i + depth])
    direct = np.array(direct, np.int64)
    heads = text[direct] if len(direct) else np.zeros(0, np.uint8)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1], np.int64))
    out = []
    for c in range(256):
        larger = []
        queue = waiting[c]
        while queue:
            layer = np.concatenate(queue)
            larger.append(layer)
            before = layer[layer > 0] - 1
            before = before[(text[before] == c) & ~smaller[before]]
            queue = [before] if len(before) else []
        bucket = np.concatenate([*larger, direct[np.searchsorted(heads, c, "left") : np.searchsorted(heads, c, "right")]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~smaller[before]]
        if len(before):
            head = text[before]
            order = np.argsort(head, kind="stable")
            cuts = np.flatnonzero(np.diff(head[order])) + 1
            for part in np.split(before[order], cuts):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def same_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Whether the next ``depth`` bytes (a multiple of 8) at a and b are equal."""
    words = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(text), 8)
    alive = np.arange(len(a))
    for d in range(0, depth, 8):
        equal = (words[a[alive] + d] == words[b[alive] + d]).all(axis=1)
        alive = alive[equal]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def repeated_windows(bodies: list[bytes], windows: list[int]) -> list[np.ndarray]:
    """For each stretch, which of its windows has its 400 bytes in another window as well."""
    text = np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.cumsum([0] + [len(b) for b in bodies])
    is_start = np.zeros(len(text), bool)
    for b, w in zip(begin, windows):
        is_start[b : b + w] = True
    order = suffix_order(text)
    order = order[is_start[order]]
    flag = np.zeros(len(text), bool)
    if len(order) > 1:
        equal = same_prefix(text, order[:-1], order[1:])
        flag[order[:-1][equal]] = True
        flag[order[1:][equal]] = True
    return [flag[b : b + w] for b, w in zip(begin, windows)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, first, last) runs of repeated windows; rows come sorted by group."""

    def flush(rows):
        ids, first, last = [], [], []
        for (_, i, skip, w, _), flags in zip(rows, repeated_windows([r[4] for r in rows], [r[3] for r in rows])):
            for a, b in _runs(flags):
                ids.append(i)
                first.append(skip + a)
                last.append(skip + b)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["id", "first", "last"])

    rows, held = [], 0
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("group", "id", "skip", "windows", "body"))):
            if held >= SORT_BYTES and r[0] != rows[-1][0]:
                yield flush(rows)
                rows, held = [], 0
            rows.append(r)
            held += len(r[4])
    if rows:
        yield flush(rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted stretches of each text."""
    for batch in batches:
        out = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            raw = text.encode()
            for w in wanted:
                out.append((w["anchor"], w["id"], w["off"], w["windows"], raw[w["start"] : w["start"] + w["windows"] - 1 + LENGTH]))
        columns = list(zip(*out)) if out else [()] * 5
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["group", "id", "off", "windows", "body"])


def _finer(rows: DataFrame, width: int) -> DataFrame:
    """Each stretch cut into classes of ``width`` anchor offsets, grouped by the bytes their windows share."""
    # window r has its anchor at off - r
    low = F.floor((F.col("off") - F.col("windows") + 1) / width)
    high = F.floor(F.col("off") / width)
    cut = rows.withColumn("c", F.explode(F.sequence(low, high)))
    a = F.greatest(F.lit(0), F.col("off") - (F.col("c") + 1) * width + 1)
    b = F.least(F.col("windows") - 1, F.col("off") - F.col("c") * width)
    cut = cut.withColumn("a", a.cast("int")).withColumn("b", b.cast("int"))
    core = F.substring("body", F.col("off") - F.col("c") * width + 1, F.lit(LENGTH + 1 - width))
    return cut.select(
        F.xxhash64("group", "c", core).alias("group"),
        "id",
        (F.col("skip") + F.col("a")).cast("int").alias("skip"),
        (F.col("off") - F.col("a")).cast("int").alias("off"),
        (F.col("b") - F.col("a") + 1).cast("int").alias("windows"),
        F.substring("body", F.col("a") + 1, F.col("b") - F.col("a") + LENGTH).alias("body"),
    )


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    for batch in batches:
        out = {n: [] for n in names[1:]}
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = (text or "").encode()
            kept, at, removed, runs, end = [], 0, 0, 0, -1
            for s in sorted((s["start"], s["stop"]) for s in spans or []):
                if s[0] > end:
                    kept.append(raw[at : s[0]])
                    runs += 1
                    removed += s[1] - s[0]
                    at = end = s[1]
                elif s[1] > end:
                    removed += s[1] - end
                    at = end = s[1]
            kept.append(raw[at:])
            rest = b"".join(kept)
            for n, v in zip(names[1:], (len(raw), removed, runs, hashlib.sha256(rest).hexdigest(), rest)):
                out[n].append(v)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(out[n], k) for n, k in zip(names[1:], kinds)], names)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(one, two, spans) of every text with repeated bytes; spans are byte ranges of repeated windows.

    ``one`` and ``two`` are the text's hashes (``sqltext.text_keys``), shared by copies.
    """
    known = docs.select("doc_id", "text", *text_keys())
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = known.where(F.octet_length("text") >= LENGTH).mapInArrow(
        _anchors, f"one long, two long, doc_id {kind}, anchor long, start int, off int, windows int, body binary"
    )
    found = materialize(found, "anchors")
    what = ["anchor", "off", "windows", "body"]
    folded = found.groupBy(*what).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "one", "two", "start")).alias("at"))
    folded = materialize(folded, "folded")
    seen = materialize(folded.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "seen")
    several = materialize(
        folded.join(seen, "anchor").select(
            *what, "n", "at", F.to_binary(F.sha2(F.concat_ws(",", "anchor", "off", "windows", F.hex("body")), 256), F.lit("hex")).alias("id")
        ),
        "several",
    )
    # of copies with one id, any will do
    wanted = several.groupBy("at.doc_id", "at.one", "at.two").agg(
        F.collect_list(F.struct("anchor", "id", "off", "windows", F.col("at.start").alias("start"))).alias("wanted")
    )
    wanted = wanted.withColumnsRenamed({"doc_id": "d", "one": "o", "two": "t"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("one") == F.col("o")) & (F.col("two") == F.col("t"))
    cut = known.join(wanted, same).select("text", "wanted").mapInArrow(_cut, "group long, id binary, off int, windows int, body binary")
    rows = materialize(cut.withColumn("skip", F.lit(0)).dropDuplicates(["id"]), "bodies")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    results = []
    for width in CLASSES:
        sizes = materialize(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        fit = rows.join(sizes.where(F.col("n") <= IN_TASK).select("group"), "group").select("group", "id", "skip", "windows", "body")
        fit = fit.repartition(parts, "group").sortWithinPartitions("group")
        results.append(fit.mapInArrow(_sort, "id binary, first int, last int"))
        many = sizes.where(F.col("n") > IN_TASK).select("group")
        if many.isEmpty():
            break
        finer = materialize(_finer(rows.join(many, "group"), width), "finer")
        # equal stretches repeat in full; one of them goes on
        on = ["group", "off", "windows", "print"]
        marked = finer.withColumn("print", F.sha2("body", 256))
        folds = materialize(marked.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "skip")).alias("keep")), "folds")
        whole = marked.join(folds.where("n > 1").select(*on), on)
        results.append(whole.select("id", F.col("skip").alias("first"), (F.col("skip") + F.col("windows")).cast("int").alias("last")))
        chosen = folds.select("group", F.col("keep.id").alias("id"), F.col("keep.skip").alias("skip"))
        rows = materialize(finer.join(chosen, ["group", "id", "skip"]), "rows")
    partly = results[0]
    for more in results[1:]:
        partly = partly.unionByName(more)
    partly = materialize(partly, "partly").groupBy("id").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    whole = folded.where("n > 1").select(*what, F.array(F.struct(F.lit(0).alias("first"), F.col("windows").alias("last"))).alias("runs"))
    partly = several.where("n = 1").join(partly, "id").select(*what, "runs")
    hits = whole.unionByName(partly)
    spans = found.join(hits, what).select(
        "one",
        "two",
        F.explode(F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("start"), (F.col("start") + r["last"] - 1 + LENGTH).alias("stop")))).alias("s"),
    )
    return spans.groupBy("one", "two").agg(F.collect_set("s").alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    spans = materialize(repeated_spans(docs), "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = docs.select("doc_id", "text", *text_keys()).join(spans, ["one", "two"], "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(
        _finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"
    )
