"""Near duplicates by a chosen-path set similarity join.

Every document is the set of its five-word shingles (words between ASCII white
space, A-Z lower-cased; fewer words: the whole sequence as one shingle). A tree
branches documents by selected minwise tokens: at each level a document follows
the least token under two fresh random orders. Nodes with few members are
compared exhaustively on the full sets; larger ones branch again. Independent
trees are repeated, so a pair at the threshold is missed with probability
(1-0.85)^(2*4) in the first level and below 1e-4 after four.

At scale: documents with equal sets are one vertex from the first grouping on,
a node travels as (node, vertex) pairs of 24 bytes, nodes are counted before any
text moves, and a node of any size is cut until it fits a task. What is still
too large after ``depth`` levels (documents all alike, but not similar enough)
is compared in pairs of blocks, so nothing is lost. A node yields a spanning
forest of its links, not all pairs.

Null or empty texts have an empty set, are linked with nothing and stay. A null
``doc_id`` never becomes a component's name unless the component has no other.
Repeated rows share a component. An empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import star_components
from gridloom.llm.textnum import DARK, LOWER, SpanHash, list_array, mix, slices, word_spans
from gridloom.session import materialize

WIDTH = 5
TREES, BRANCHES, DEPTH, LEAF = 4, 2, 5, 2000
ORDERS = TREES * BRANCHES * DEPTH
VOCABULARY = 1 << 14
_SEED = np.random.default_rng(20)
_WORD = _SEED.integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _SEED.integers(1, 1 << 63, ORDERS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted by row and hash."""
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets, DARK)
    words = SpanHash(data).of(starts, ends)
    n = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    rows, hashes = [], []
    at = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :]) if len(row) >= width else np.zeros(0, np.int64)
    for m in range(width, 0, -1):
        if m < width:
            at = first[n == m]
        total = np.full(len(at), m, np.uint64)
        for j in range(m):
            total = total + words[at + j] * _WORD[j]
        rows.append(row[at])
        hashes.append(mix(total))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in slices(batch.column("text")):
            docs = len(offsets) - 1
            rows, hashes = shingles(data, offsets)
            n = np.bincount(rows, minlength=docs)
            full = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[full]
            least = np.zeros((len(full), ORDERS), np.int32)
            one = two = np.zeros(0, np.uint64)
            if len(full):
                for j in range(ORDERS):
                    # the least token under order j; its place in the order names it
                    mixed = hashes * _ORDER[j]
                    mixed ^= mixed >> np.uint64(32)
                    least[:, j] = (np.minimum.reduceat(mixed * _ORDER[j - 1], begin) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                one = np.add.reduceat(mix(hashes ^ _WORD[9]), begin)
                two = np.add.reduceat(mix(hashes ^ _WORD[10]), begin)
            keys = np.empty((len(full), 2), ">u8")
            keys[:, 0], keys[:, 1] = one, two
            raw = keys.tobytes()
            key: list[bytes | None] = [None] * docs
            for i, d in enumerate(full):
                key[d] = raw[16 * i : 16 * i + 16]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(at, docs),
                    batch.column("mark").slice(at, docs),
                    pa.array(n, pa.int64()),
                    pa.array(key, pa.binary()),
                    list_array(least.ravel(), np.where(n > 0, ORDERS, 0), pa.int32()),
                ],
                ["doc_id", "mark", "n_shingles", "key", "least"],
            )


def _links(members: list[tuple[bytes, str]], share: tuple[int, int]) -> list[tuple[bytes, bytes]]:
    """Spanning forest of the links within one node, from the full sets."""
    m = len(members)
    if m < 2:
        return []
    row, code = [], []
    done = 0
    for at, data, offsets in slices(pa.array([t for _, t in members], pa.large_string())):
        r, h = shingles(data, offsets)
        row.append(r + at)
        code.append(h)
    row, code = np.concatenate(row), np.concatenate(code)
    size = np.bincount(row, minlength=m)
    _, code, times = np.unique(code, return_inverse=True, return_counts=True)
    common = times > 1
    number = np.cumsum(common) - 1
    keep = common[code]
    row, code = row[keep], number[code[keep]]
    shared = np.zeros((m, m), np.int32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    while done < len(code):
        low = code[done]
        end = int(np.searchsorted(code, low + VOCABULARY))
        bits = np.zeros((m, VOCABULARY), bool)
        bits[row[done:end], code[done:end] - low] = True
        packed = np.packbits(bits[:, : -(-int(code[end - 1] - low + 1) // 64) * 64], axis=1).view(np.uint64)
        for i in range(m - 1):
            shared[i, i + 1 :] += np.bitwise_count(packed[i + 1 :] & packed[i]).sum(axis=1, dtype=np.int32)
        done = end
    part, whole = share
    union = size[:, None] + size[None, :] - shared
    a, b = np.nonzero(np.triu(whole * shared.astype(np.int64) >= part * union, 1) & (shared > 0))
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            found.append((members[x][0], members[y][0]))
    return found


def _compare(share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, members = None, []

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            pairs = []
            for n, key, text in zip(*(batch.column(c).to_pylist() for c in ("node", "key", "text"))):
                if n != node:
                    pairs += _links(members, share)
                    node, members = n, []
                members.append((key, text))
            yield out(pairs)
        yield out(_links(members, share))

    return run


def _branches(nodes: DataFrame, level: int, trees: int) -> DataFrame:
    """Children of every (node, key, least) row: one for each selected order of the level."""
    orders = [F.lit((t * DEPTH + level) * BRANCHES + j) for t in range(trees) for j in range(BRANCHES)]
    if level == 0:
        child = [F.xxhash64(F.lit(i // BRANCHES), o, F.get("least", o)) for i, o in enumerate(orders)]
    else:
        child = [F.xxhash64("node", F.lit(j), F.get("least", F.col("tree") * DEPTH * BRANCHES + (level * BRANCHES + j))) for j in range(BRANCHES)]
    tree = [F.lit(i // BRANCHES) for i in range(len(orders))] if level == 0 else [F.col("tree")] * BRANCHES
    each = F.explode(F.array(*[F.struct(n.alias("node"), t.alias("tree")) for n, t in zip(child, tree)])).alias("c")
    return nodes.select("key", each).select("c.node", "c.tree", "key")


def near_duplicates(docs: DataFrame, share: tuple[int, int] = (85, 100), trees: int = TREES) -> DataFrame:
    """(doc_id, n_shingles, component_id, mark, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked when share[1] * shared >= share[0] * union shingles.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, n_shingles long, key binary, least array<int>"
    sketch = materialize(docs.mapInArrow(_sketch, kinds), "sketch")
    classes = materialize(
        sketch.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("least").alias("least")), "classes"
    )
    small, nodes = [], _branches(classes, 0, trees)
    for level in range(DEPTH):
        nodes = materialize(nodes, "nodes")
        sizes = nodes.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.min("tree").alias("tree"), F.bit_xor(F.xxhash64("key")).alias("who")
        )
        sizes = materialize(sizes.where("n > 1"), "sizes")
        # equal members meet in many nodes; one of these is compared
        few = sizes.where(F.col("n") <= LEAF).groupBy("n", "who").agg(F.min("node").alias("node")).select("node", "n")
        many = sizes.where(F.col("n") > LEAF).select("node", "n")
        members = materialize(nodes.join(materialize(few.unionByName(many), "told"), "node"), "members")
        small.append(members.where(F.col("n") <= LEAF).select("node", "key"))
        large = members.where(F.col("n") > LEAF)
        large = None if large.isEmpty() else large
        if large is None:
            break
        if level + 1 < DEPTH:
            nodes = _branches(large.join(classes.select("key", "least"), "key"), level + 1, trees)
    if large is not None:
        blocks = F.ceil(F.col("n") * 2 / LEAF).cast("int")
        own = F.pmod(F.xxhash64("key"), blocks).cast("int")
        paired = large.select("node", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        small.append(paired.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "key"))
    todo = small[0]
    for more in small[1:]:
        todo = todo.unionByName(more)
    todo = materialize(todo, "leaves")
    wanted = classes.join(todo.select("key").distinct(), "key", "left_semi").select("key", "first_id")
    ids = sketch.select("doc_id", "mark", "key").join(wanted, "key").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    ids = ids.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("i")).select("key", "i.doc_id", "i.mark")
    same = docs["doc_id"].eqNullSafe(ids["doc_id"]) & (docs["mark"] == ids["mark"])
    texts = docs.join(ids, same).select("key", "text").dropDuplicates(["key"])
    told = todo.join(texts, "key").select("node", "key", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = told.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_compare(share), "a binary, b binary")
    roots = star_components(materialize(links, "links"))
    named = roots.join(classes.select(F.col("key").alias("vertex"), "first_id"), "vertex")
    names = named.groupBy("root").agg(F.min("first_id").alias("component"))
    named = roots.join(names, "root").select(F.col("vertex").alias("key"), "component")
    by_key = classes.select("key", "first_id").join(named, "key", "left").select("key", F.coalesce("component", "first_id").alias("component"))
    whole = sketch.select("doc_id", "n_shingles", "key", "mark").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), "mark").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def one_of_each(docs: DataFrame, share: tuple[int, int] = (85, 100)) -> DataFrame:
    """Rows of ``docs``, all columns, with one document of each component; of repeated rows one stays."""
    kept = near_duplicates(docs, share).where("kept").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    kept = materialize(kept.withColumnsRenamed({"doc_id": "d", "mark": "m"}), "kept")
    mark = F.xxhash64("text")
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["d"]) & (mark == kept["m"]), "left_semi")
    if kept.where("n > 1").isEmpty():
        return rows
    own = "_mark" + "_" * max(map(len, docs.columns))  # longer than any column, so none is overwritten
    return rows.withColumn(own, mark).dropDuplicates(["doc_id", own]).drop(own)
