"""Random forests of many rows: upper nodes from histograms, lower ones grown where their rows are.

MLlib sends a histogram per task, node and column on every level. That is little
for the few upper nodes and more than all rows for the hundred thousands of lower
ones, so here only nodes of more than ``NODE_ROWS`` rows are cut by histograms. The
rows of every other node are brought together once, and one task grows all that
lies below it. Rows are coded to one byte a column.

Each tree has its own bag (Poisson weights of mean 1), each node its own draw of
columns, both seeded. Rows come dealt in a fixed order; sums above are whole
multiples of a small unit and rows below are put back in their order, so that the same rows
and seed give the same trees on any cluster. The result is MLlib's own model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from gridloom.session import materialize, scratch_path

#: Rows of a bag up to which a node is grown in one task.
NODE_ROWS = 500_000
BLOCK_ROWS = 1 << 15
#: Nodes whose histograms a task holds at a time.
NODES_AT_ONCE = 256
KEY_BITS = 42  # of a number's 64 bits, the lowest: groups of 1/1024 of a power of two for the quantiles


@dataclass(frozen=True)
class Settings:
    """``columns`` are drawn anew for each node; ``bins`` are at most 256."""

    trees: int
    depth: int
    least_rows: int
    least_gain: float
    columns: int
    bins: int
    seed: int
    node_rows: int = NODE_ROWS


def settings_of(learner: RandomForestRegressor, width: int, **more: int) -> Settings:
    share = learner.getFeatureSubsetStrategy()
    columns = width if share == "all" else math.ceil(float(share) * width)
    return Settings(
        learner.getNumTrees(), learner.getMaxDepth(), learner.getMinInstancesPerNode(), learner.getMinInfoGain(), columns, learner.getMaxBins(), learner.getSeed(), **more
    )


def supported(learner: RandomForestRegressor) -> bool:
    """Whether the learner's settings are those that ``fit_forest`` knows."""
    share = learner.getFeatureSubsetStrategy()
    known = share == "all" or ("." in share and share.replace(".", "", 1).isdigit() and 0 < float(share) <= 1)
    plain = learner.getSubsamplingRate() == 1.0 and learner.getBootstrap() and learner.getMinWeightFractionPerNode() == 0.0
    return known and plain and learner.getMaxBins() <= 256 and not learner.isDefined("weightCol")


# ---- thresholds


def _keys(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values, equal for values that differ by less than a thousandth."""
    bits = (values + 0.0).view(np.int64)
    ordered = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return ordered >> KEY_BITS


def _least_of(keys: np.ndarray) -> np.ndarray:
    """The least value of each key."""
    ordered = keys << KEY_BITS
    return np.where(ordered < 0, ordered ^ np.int64(0x7FFFFFFFFFFFFFFF), ordered).view(np.float64)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("features")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_COUNTED = "place int, keys binary, counts binary, few binary"


def _merged(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _few(parts: Sequence[np.ndarray | None], most: int) -> np.ndarray | None:
    """The distinct values, None where there are more than ``most``."""
    if any(p is None for p in parts):
        return None
    values = np.unique(np.concatenate(parts))
    return values if len(values) <= most else None


def _count(most: int) -> Callable:
    """Rows of a task per column and key, and the values themselves where they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[int, tuple] = {}
        few: dict[int, np.ndarray | None] = {}
        for batch in batches:
            x = _matrix(batch)
            for c in range(x.shape[1]):
                v = x[:, c][~np.isnan(x[:, c])]
                part = np.unique(_keys(v), return_counts=True)
                counted[c] = _merged([counted[c], part]) if c in counted else part
                if few.get(c, True) is not None:
                    few[c] = _few([*([few[c]] if c in few else []), v], most)
        rows = [(c, k.astype("<i8").tobytes(), n.astype("<i8").tobytes(), None if few[c] is None else few[c].tobytes()) for c, (k, n) in counted.items()]
        kinds = [pa.int32(), *[pa.binary()] * 3]
        cells = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], [c.split()[0] for c in _COUNTED.split(", ")])

    return run


def _edges_of(bins: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [None if b is None else np.frombuffer(b, kind) for b in table.column(name).to_pylist()]
        few = _few(read("few", "<f8"), bins)
        if few is not None:
            edges = (few[:-1] + few[1:]) / 2
        else:
            keys, counts = _merged(list(zip(read("keys", "<i8"), read("counts", "<i8"))))
            wanted = counts.sum() * np.arange(1, bins) / bins
            ends = np.searchsorted(np.cumsum(counts), wanted, "left")
            # all values of a key lie below the least value of the next one
            edges = np.nextafter(_least_of(keys[np.unique(ends[ends < len(keys) - 1])] + 1), -np.inf)
        row = (table.column("place")[0].as_py(), edges.tolist())
        return pa.Table.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.list_(pa.float64()))], ["place", "edges"])

    return run


def thresholds(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Cuts of each place of ``features``, from all rows: between the values where these are ``bins`` at most,
    else at the quantiles, exact but for values closer to each other than a thousandth."""
    counted = rows.select(vector_to_array("features").alias("features")).mapInArrow(_count(bins), _COUNTED)
    found = counted.groupBy("place").applyInArrow(_edges_of(bins), "place int, edges array<double>").collect()
    return [np.array(r["edges"], float) for r in sorted(found, key=lambda r: r["place"])]


# ---- coded rows

_BLOCK = "block long, codes binary, labels binary, weights binary"


def _to_blocks(edges: list[np.ndarray], trees: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        codes, labels, held = [], [], 0

        def block(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            weights = np.minimum(np.random.default_rng([seed, part, number]).poisson(1.0, (trees, len(y))), 255).astype(np.uint8)
            cells = [(part << 32) + number, np.ascontiguousarray(x).tobytes(), y.astype("<f8").tobytes(), weights.tobytes()]
            kinds = [pa.int64(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], [c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            x = _matrix(batch)
            codes.append(np.stack([np.searchsorted(e, x[:, c], "left").astype(np.uint8) for c, e in enumerate(edges)]))
            labels.append(batch.column("label").to_numpy(zero_copy_only=False).astype(float))
            held += len(x)
            while held >= BLOCK_ROWS:
                every, y = np.concatenate(codes, axis=1), np.concatenate(labels)
                yield block(every[:, :BLOCK_ROWS], y[:BLOCK_ROWS])
                codes, labels, held, number = [every[:, BLOCK_ROWS:]], [y[BLOCK_ROWS:]], held - BLOCK_ROWS, number + 1
        if held:
            yield block(np.concatenate(codes, axis=1), np.concatenate(labels))

    return run


def _opened(batch: pa.RecordBatch, width: int, trees: int) -> Iterator[tuple]:
    """(block, codes by column, labels, weights by tree)."""
    for block, codes, labels, weights in zip(*[batch.column(c).to_pylist() for c in ("block", "codes", "labels", "weights")]):
        y = np.frombuffer(labels, "<f8")
        yield block, np.frombuffer(codes, np.uint8).reshape(width, -1), y, np.frombuffer(weights, np.uint8).reshape(trees, -1)


# ---- cuts


@dataclass
class Top:
    """The upper nodes of a tree by number; a node without children is a leaf (``sums`` known) or grown elsewhere (``sums`` None)."""

    column: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    sums: list[tuple | None] = field(default_factory=list)

    def add(self, depth: int, path: int) -> int:
        for name, v in (("column", -1), ("cut", 0), ("left", -1), ("right", -1), ("depth", depth), ("path", path), ("gain", -1.0), ("sums", None)):
            getattr(self, name).append(v)
        return len(self.column) - 1

    def end_of(self, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The node at which each of ``rows`` stops."""
        column, cut = np.array(self.column), np.array(self.cut)
        following = np.stack([self.right, self.left], axis=1).ravel()
        cells, first = codes.reshape(-1), column * codes.shape[1]
        at = np.zeros(len(rows), np.int64)
        moving = np.arange(len(rows)) if column[0] >= 0 else np.zeros(0, np.int64)
        while len(moving):
            node = at[moving]
            goes_left = cells.take(first[node] + rows[moving]) <= cut[node]
            child = following[2 * node + goes_left]
            at[moving] = child
            moving = moving[column[child] >= 0]
        return at


def _drawn(settings: Settings, width: int, tree: int, path: int) -> np.ndarray:
    """Which columns a node may be cut by."""
    mask = np.zeros(width, bool)
    mask[np.random.default_rng([settings.seed, tree, path]).permutation(width)[: settings.columns]] = True
    return mask


def best_cuts(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, allowed: np.ndarray | None, settings: Settings) -> tuple[np.ndarray, ...]:
    """(gain, column, cut) of each node from its (node, column, bin) sums; column -1 where no cut gains.

    The gain is the fall of the variance. Of equal gains the first column and the lowest cut count.
    """
    nodes, width, bins = counts.shape
    n, s = counts[:, :1].sum(axis=2), sums[:, :1].sum(axis=2)
    n_left, s_left = np.cumsum(counts, axis=2)[:, :, :-1], np.cumsum(sums, axis=2)[:, :, :-1]
    n_right, s_right = n[..., None] - n_left, s[..., None] - s_left
    good = (n_left >= settings.least_rows) & (n_right >= settings.least_rows)
    if allowed is not None:
        good &= allowed[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = np.where(good, s_left * s_left / n_left + s_right * s_right / n_right, -np.inf).reshape(nodes, -1)
    noise = 1e-12 * squares  # what rounding alone makes of equal labels or equal cuts
    at = (strength >= (strength.max(axis=1) - noise)[:, None]).argmax(axis=1)
    gain = (strength[np.arange(nodes), at] - (s * s / n)[:, 0]) / n[:, 0]
    fine = (gain > noise / n[:, 0]) & (gain >= settings.least_gain)
    return np.where(fine, gain, -1.0), np.where(fine, at // (bins - 1), -1), at % (bins - 1)


#: A row of sums: of a task's rows in node ``small`` (``own``), or of the whole of its parent.
_SUMS = "tree int, parent int, own boolean, counts binary, sums binary, squares double"


def _paired(codes: np.ndarray, bins: int) -> np.ndarray:
    """One number for two columns; the last of an odd number of columns is left out."""
    even = codes[: len(codes) // 2 * 2].astype(np.uint16)
    return even[0::2] * np.uint16(bins) + even[1::2]


def _add_up(
    codes: np.ndarray, paired: np.ndarray, rows: np.ndarray | slice, slot: np.ndarray, slots: int, weight: np.ndarray, sums: np.ndarray, bins: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and weighted labels per slot, column and bin; two columns at a time while their table is the smaller one."""
    width = len(codes)
    out = np.empty((2, slots, width, bins))
    two = slots * bins * bins <= len(slot)
    start = slot * (bins * bins)
    for c in range(len(paired) if two else 0):
        cell = start + paired[c, rows]
        for total, values in zip(out, (weight, sums)):
            both = np.bincount(cell, values, slots * bins * bins).reshape(slots, bins, bins)
            total[:, 2 * c], total[:, 2 * c + 1] = both.sum(axis=2), both.sum(axis=1)
    start = slot * bins
    for c in range(2 * len(paired) if two else 0, width):
        cell = start + codes[c, rows]
        for total, values in zip(out, (weight, sums)):
            total[:, c] = np.bincount(cell, values, slots * bins).reshape(slots, bins)
    return out[0], out[1]


@dataclass(frozen=True)
class Pair:
    """Two nodes below ``parent``: the smaller one is added up, the other is what is left; ``asked`` are to be cut."""

    parent: int
    small: int
    big: int
    asked: tuple[int, ...]


def _histograms(width: int, bins: int, tops: list[Top], pairs: list[list[Pair]], unit: float) -> Callable:
    """Sums of a task's rows per tree, smaller node, column and bin, labels in whole units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, codes, y, weights in _opened(batch, width, len(tops)):
                whole, paired = np.rint(y * unit), _paired(codes, bins)
                for tree, (top, nodes) in enumerate(zip(tops, pairs)):
                    if not nodes:
                        continue
                    rows = np.flatnonzero(weights[tree])
                    place = np.full(len(top.column), -1)
                    place[[p.small for p in nodes]] = np.arange(len(nodes))
                    slot = place[top.end_of(codes, rows)]
                    rows, slot = rows[slot >= 0], slot[slot >= 0]
                    weight = weights[tree, rows].astype(float)
                    label = weight * whole[rows]
                    parts = [*_add_up(codes, paired, rows, slot, len(nodes), weight, label, bins), np.bincount(slot, label * whole[rows], len(nodes))]
                    if tree in found:
                        for total, part in zip(found[tree], parts):
                            total += part
                    else:
                        found[tree] = parts
        names, kinds = [c.split()[0] for c in _SUMS.split(", ")], [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.float64()]
        for tree, (counts, sums, squares) in found.items():
            rows = [(tree, p.parent, True, counts[i].tobytes(), sums[i].tobytes(), float(squares[i])) for i, p in enumerate(pairs[tree])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


_CUTS = "tree int, node int, n double, s double, q double, gain double, column int, cut int, n_left double, counts binary, sums binary"


def _cuts(settings: Settings, width: int, bins: int, pairs: list[list[Pair]], paths: list[list[int]]) -> Callable:
    """The best cut of each node that is asked for, and its sums for the nodes below it."""
    known = [{p.parent: p for p in nodes} for nodes in pairs]

    def run(table: pa.Table) -> pa.Table:
        tree, out = table.column("tree")[0].as_py(), []
        pair = known[tree].get(table.column("parent")[0].as_py())
        if pair:
            totals: list[list] = [[], []]
            for own, counts, sums, squares in zip(*[table.column(c).to_pylist() for c in ("own", "counts", "sums", "squares")]):
                totals[own].append((np.frombuffer(counts, "<f8"), np.frombuffer(sums, "<f8"), squares))
            counts, sums, squares = zip(*totals[True])
            small = [sum(counts), sum(sums), math.fsum(squares)]
            for node in pair.asked:
                c, s, q = small if node == pair.small else [whole - part for whole, part in zip(totals[False][0], small)]
                c, s, squares = c.reshape(1, width, bins), s.reshape(1, width, bins), np.array([q])
                allowed = None if settings.columns >= width else _drawn(settings, width, tree, paths[tree][node])[None]
                gain, column, cut = (v[0] for v in best_cuts(c, s, squares, allowed, settings))
                out.append((tree, node, c[0, 0].sum(), s[0, 0].sum(), q, gain, column, cut, c[0, column, : cut + 1].sum(), c.tobytes(), s.tobytes()))
        kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
        cells = zip(*out) if out else [[]] * len(kinds)
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(cells, kinds)], [c.split()[0] for c in _CUTS.split(", ")])

    return run


def _grow_tops(blocks: DataFrame, rows: int, settings: Settings, width: int, bins: int, unit: float) -> list[Top]:
    """All trees as far down as their nodes have more than ``node_rows`` rows; a pass of the rows per level."""
    tops = [Top() for _ in range(settings.trees)]
    for top in tops:
        top.add(0, 1)
    pairs = [[Pair(-1, 0, -1, (0,))] if rows > settings.node_rows else [] for _ in tops]
    above = None
    while any(pairs):
        sums = blocks.mapInArrow(_histograms(width, bins, tops, pairs, unit), _SUMS)
        if above is not None:
            sums = sums.unionByName(above.select("tree", F.col("node").alias("parent"), F.lit(False).alias("own"), "counts", "sums", F.col("q").alias("squares")))
        cuts = sums.groupBy("tree", "parent").applyInArrow(_cuts(settings, width, bins, pairs, [t.path for t in tops]), _CUTS)
        above = materialize(cuts, "forest-sums")
        found = above.drop("counts", "sums").orderBy("tree", "node").collect()
        pairs = [[] for _ in tops]
        for r in found:
            top, node = tops[r["tree"]], r["node"]
            top.sums[node] = (r["n"], r["s"] / unit, r["q"] / unit / unit)
            if r["column"] < 0 or top.depth[node] >= settings.depth:
                continue
            top.column[node], top.cut[node], top.gain[node] = r["column"], r["cut"], r["gain"] / unit / unit
            sizes = {}
            for name, n, bit in (("left", r["n_left"], 0), ("right", r["n"] - r["n_left"], 1)):
                child = top.add(top.depth[node] + 1, 2 * top.path[node] + bit)
                getattr(top, name)[node] = child
                sizes[child] = n
            small, big = sorted(sizes, key=lambda v: (sizes[v], v))
            asked = tuple(v for v in (small, big) if sizes[v] > settings.node_rows)
            if asked:
                pairs[r["tree"]].append(Pair(node, small, big, asked))
    return tops


# ---- lower nodes

_PART = "tree int, node int, block long, codes binary, labels binary, weights binary"


def _dealt(width: int, tops: list[Top]) -> Callable:
    """The rows of each node that is grown elsewhere, a block's together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [c.split()[0] for c in _PART.split(", ")], [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
        for batch in batches:
            for block, codes, y, weights in _opened(batch, width, len(tops)):
                for tree, top in enumerate(tops):
                    rows = np.flatnonzero(weights[tree])
                    end = top.end_of(codes, rows)
                    order = np.argsort(end, kind="stable")
                    starts = np.flatnonzero(np.diff(end[order], prepend=-1))
                    out = []
                    for a, z in zip(starts, [*starts[1:], len(order)]):
                        node, own = int(end[order[a]]), rows[order[a:z]]
                        if top.sums[node] is None:
                            out.append((tree, node, block, codes[:, own].tobytes(), y[own].tobytes(), weights[tree, own].tobytes()))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def grow(codes: np.ndarray, y: np.ndarray, weights: np.ndarray, bins: int, depth: int, tree: int, path: int, settings: Settings) -> list[list]:
    """All nodes below and with one, as columns (column, cut, left, right, n, s, q, gain); children come after their parent.

    Of two children the histogram of the one with fewer rows is added up, the other's is the rest.
    """
    width = len(codes)
    weight = weights.astype(float)
    sums, squares = weight * y, weight * y * y
    table: list[list] = [[-1], [0], [-1], [-1], [weight.sum()], [sums.sum()], [squares.sum()], [-1.0]]

    def open_node(node: int, depth: int) -> bool:
        n, s, q = (table[i][node] for i in (4, 5, 6))
        return depth < settings.depth and n >= 2 * settings.least_rows and q / n - (s / n) ** 2 > 1e-12 * q / n

    paired = _paired(codes, bins)
    every = np.arange(len(y))
    todo = []
    if open_node(0, depth):
        whole = _add_up(codes, paired, slice(None), np.zeros(len(y), np.int64), 1, weight, sums, bins)
        todo.append((depth, np.array([0]), [path], every, np.zeros(len(y), np.int64), *whole))
    while todo:
        depth, nodes, paths, rows, slot, counts, totals = todo.pop()
        if len(nodes) > NODES_AT_ONCE:
            half = len(nodes) // 2
            for part, keep in ((slice(half, None), slot >= half), (slice(None, half), slot < half)):
                # copies, so that the whole's histograms are given back
                todo.append((depth, nodes[part], paths[part], rows[keep], slot[keep] - (part.start or 0), counts[part].copy(), totals[part].copy()))
            continue
        allowed = None if settings.columns >= width else np.stack([_drawn(settings, width, tree, p) for p in paths])
        gain, column, cut = best_cuts(counts, totals, np.array([table[6][v] for v in nodes]), allowed, settings)
        inside = column[slot] >= 0
        rows, slot = rows[inside], slot[inside]
        right = codes[column[slot], rows] > cut[slot]
        child = 2 * slot + right
        own = [np.bincount(child, v[rows], 2 * len(nodes)) for v in (weight, sums, squares)]
        follow, small, big, parents = [], [], [], []
        for i in np.flatnonzero(column >= 0):
            node = int(nodes[i])
            table[0][node], table[1][node], table[7][node] = int(column[i]), int(cut[i]), float(gain[i])
            opened = []
            for bit, name in ((0, 2), (1, 3)):
                at = len(table[0])
                table[name][node] = at
                for values, v in zip(table, (-1, 0, -1, -1, *(float(o[2 * i + bit]) for o in own), -1.0)):
                    values.append(v)
                if open_node(at, depth + 1):
                    opened.append((2 * i + bit, at, 2 * paths[i] + bit))
            if opened:
                less = 2 * i + int(own[0][2 * i + 1] < own[0][2 * i])
                small.append(less)
                big.append(4 * i + 1 - less)
                parents.append(i)
                follow += opened
        if not follow:
            continue
        # histograms of the smaller children, and what they leave of their parents
        place = np.full(2 * len(nodes), -1)
        place[small] = np.arange(len(small))
        mine = place[child]
        of = mine >= 0
        some = _add_up(codes, paired, rows[of], mine[of], len(small), weight[rows[of]], sums[rows[of]], bins)
        where = {v: (0, j) for j, v in enumerate(small)} | {v: (1, j) for j, v in enumerate(big)}
        rest = [(h[parents] - s) for h, s in zip((counts, totals), some)]
        picks = [where[v] for v, _, _ in follow]
        kept = [np.stack([(s, r)[side][j] for side, j in picks]) for s, r in zip(some, rest)]
        place = np.full(2 * len(nodes), -1)
        place[[v for v, _, _ in follow]] = np.arange(len(follow))
        slot = place[child]
        rows, slot = rows[slot >= 0], slot[slot >= 0]
        todo.append((depth + 1, np.array([at for _, at, _ in follow]), [p for _, _, p in follow], rows, slot, *kept))
    return table


_GROWN = (
    "tree int, node int, size int, column array<int>, threshold array<double>, left array<int>, right array<int>, "
    "n array<double>, s array<double>, q array<double>, gain array<double>"
)


def _grown(settings: Settings, edges: list[np.ndarray], bins: int, tops: list[Top]) -> Callable:
    width = len(edges)

    def run(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        table = table.sort_by("block")
        read = lambda name, kind: [np.frombuffer(b, kind) for b in table.column(name).to_pylist()]
        codes = np.concatenate([c.reshape(width, -1) for c in read("codes", np.uint8)], axis=1)
        y, weights = np.concatenate(read("labels", "<f8")), np.concatenate(read("weights", np.uint8))
        column, cut, left, right, n, s, q, gain = grow(codes, y, weights, bins, tops[tree].depth[node], tree, tops[tree].path[node], settings)
        threshold = [float(edges[c][k]) if c >= 0 else 0.0 for c, k in zip(column, cut)]
        row = (tree, node, len(column), column, threshold, left, right, n, s, q, gain)
        whole, real = pa.list_(pa.int32()), pa.list_(pa.float64())
        kinds = [pa.int32()] * 3 + [whole, real, whole, whole, real, real, real, real]
        names = ["tree", "node", "size", "column", "threshold", "left", "right", "n", "s", "q", "gain"]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return run


# ---- the model

_NODE = """named_struct('id', id, 'prediction', s / n, 'impurity', greatest(q / n - s / n * (s / n), 0D), 'impurityStats', array(n, s, q),
  'rawCount', CAST(n AS BIGINT), 'gain', gain, 'leftChild', left, 'rightChild', right, 'split', named_struct('featureIndex', column,
  'leftCategoriesOrThreshold', CASE WHEN column < 0 THEN CAST(array() AS ARRAY<DOUBLE>) ELSE array(threshold) END, 'numCategories', -1)) AS nodeData"""


def _nodes(lower: DataFrame, tops: list[Top], edges: list[np.ndarray]) -> DataFrame:
    """Every node as MLlib stores it: the upper ones keep their number, those below are numbered on."""
    spark = lower.sparkSession
    upper, places = [], []
    after = [len(t.column) for t in tops]
    for r in lower.select("tree", "node", "size").orderBy("tree", "node").collect():
        places.append((r["tree"], r["node"], after[r["tree"]]))
        after[r["tree"]] += r["size"] - 1
    for tree, top in enumerate(tops):
        for node, sums in enumerate(top.sums):
            if sums is not None:
                column = top.column[node]
                upper.append((tree, node, column, float(edges[column][top.cut[node]]) if column >= 0 else 0.0, top.left[node], top.right[node], *map(float, sums), float(top.gain[node])))
    schema = "treeID int, id int, column int, threshold double, left int, right int, n double, s double, q double, gain double"
    offsets = spark.createDataFrame(places, "tree int, node int, first int")
    below = lower.join(F.broadcast(offsets), ["tree", "node"]).select(
        "tree", "node", "first", F.posexplode(F.arrays_zip("column", "threshold", "left", "right", "n", "s", "q", "gain")).alias("pos", "v")
    )
    number = "CASE WHEN v.{0} < 0 THEN -1 ELSE first + v.{0} - 1 END AS {0}"
    below = below.selectExpr(
        "tree AS treeID", "CASE WHEN pos = 0 THEN node ELSE first + pos - 1 END AS id", "v.column", "v.threshold",
        number.format("left"), number.format("right"), "v.n", "v.s", "v.q", "v.gain",
    )
    return spark.createDataFrame(upper, schema).unionByName(below).selectExpr("treeID", _NODE)


def _model(nodes: DataFrame, learner: RandomForestRegressor, width: int) -> RandomForestRegressionModel:
    """A stored model of the learner's settings whose nodes are ``nodes``, loaded."""
    spark = nodes.sparkSession
    frame, path = scratch_path(spark, "forest-frame"), scratch_path(spark, "forest")
    empty = spark.createDataFrame([(Vectors.dense([float(v)] * width), float(v)) for v in (0, 1)], ["features", learner.getLabelCol()])
    learner.fit(empty).save(frame)
    spark.read.text(f"{frame}/metadata").coalesce(1).write.text(f"{path}/metadata")
    spark.read.parquet(f"{frame}/treesMetadata").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes.write.parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)


def fit_forest(plain: DataFrame, dealt: DataFrame, learner: RandomForestRegressor, rows: int, largest: float, **more: int) -> RandomForestRegressionModel:
    """The learner's forest on ``dealt``, rows of ``features`` and the label in a fixed order and number of parts.

    ``plain`` has the same rows in any order, ``largest`` is the largest absolute label, all are finite.
    """
    edges = thresholds(plain, learner.getMaxBins())
    width, bins = len(edges), max(2, *(len(e) + 1 for e in edges))
    settings = settings_of(learner, width, **more)
    # sums of a node stay whole numbers below 2^53: a bag has fewer than four times the rows
    unit = 2.0 ** (51 - max(1, rows).bit_length()) / (largest or 1.0)
    slim = dealt.select(vector_to_array("features").alias("features"), F.col(learner.getLabelCol()).alias("label"))
    # kept as dealt, so that every pass has the same tasks; a lost part is made again from the same rows and seed
    blocks = slim.mapInArrow(_to_blocks(edges, settings.trees, settings.seed), _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tops = _grow_tops(blocks, rows, settings, width, bins, unit)
        below = sum(s is None for t in tops for s in t.sums)
        parts = blocks.mapInArrow(_dealt(width, tops), _PART).repartition(max(1, min(below, 512)), "tree", "node")
        lower = materialize(parts.groupBy("tree", "node").applyInArrow(_grown(settings, edges, bins, tops), _GROWN), "forest-nodes")
    finally:
        blocks.unpersist()
    return _model(_nodes(lower, tops, edges), learner, width)
