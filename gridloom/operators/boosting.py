"""Leaf-wise gradient boosting on histograms.

Rows are coded once into blocks of bytes (one byte a column, bins from
quantiles) and never leave the task that reads their block. For each growth step
a task sums the gradients of its rows per leaf, column and bin; only these
histograms move, one row per task, leaf and ``PACK`` columns, as wide as these
columns have bins. They are added up and the best cut of each pack comes back:
a few numbers.

A tree grows best-first: of all leaves the one whose cut gains most is cut next,
up to ``leaves``. As every row lies in one leaf, histograms of many leaves cost
one pass; the leaves that would be cut on what is known are all worked out in the
same pass, and the tree is taken once the order of cuts needs nothing unknown.

Gradients are whole multiples of a small unit, so that sums are exact: the same
rows and settings give the same trees on any cluster. Squared error; null and
NaN inputs have a bin of their own and go to the side that gains more.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import materialize

CODES = 256
UNIT_BITS, LOSS_BITS = 24, 12
#: Columns whose histograms share a row; adding up a leaf's pack holds one such row, 32 kB at most, of every task.
PACK = 8


@dataclass(frozen=True)
class Settings:
    """``refresh`` is after how many trees the blocks are written again with their scores."""

    trees: int = 100
    leaves: int = 31
    bins: int = 255
    rate: float = 0.1
    least_rows: int = 20
    l2: float = 0.0
    patience: int | None = None
    refresh: int = 16

    def __post_init__(self) -> None:
        if not 2 <= self.bins <= CODES - 1 or self.leaves < 2 or self.least_rows < 1:
            raise ValueError("from 2 to 255 bins, 2 leaves and 1 row in a leaf at least")


@dataclass
class Tree:
    """Nodes by number, 0 the root: an inner node has a column, a bin and two children, a leaf has -1 and a value."""

    column: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, v in (("column", -1), ("cut", 0), ("missing_left", True), ("left", -1), ("right", -1), ("value", value), ("gain", 0.0)):
            getattr(self, name).append(v)
        return len(self.column) - 1

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        """Node where each row of ``codes`` ends."""
        column, cut, missing = np.array(self.column), np.array(self.cut), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(codes), np.int64)
        moving = np.arange(len(codes)) if column[0] >= 0 else np.zeros(0, np.int64)
        while len(moving):
            node = at[moving]
            code = codes[moving, column[node]]
            goes_left = np.where(code == 0, missing[node], code <= cut[node])
            at[moving] = np.where(goes_left, left[node], right[node])
            moving = moving[column[at[moving]] >= 0]
        return at

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(codes)]


@dataclass
class Booster:
    """A fitted model: bounded by its columns, bins, trees and leaves."""

    columns: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)

    def scored(self) -> Column:
        """Prediction of a row, from its columns."""
        edges, trees, base = [np.array(e) for e in self.edges], self.trees, self.base

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            codes = coded([c.to_numpy(float, na_value=np.nan) for c in columns], edges)
            total = np.full(len(codes), base)
            for tree in trees:
                total += tree.scores(codes)
            return pd.Series(total)

        return score(*[F.col(c).cast("double") for c in self.columns])

    def importance(self, spark: SparkSession) -> DataFrame:
        """Sum of the gains of each column's cuts."""
        gains = dict.fromkeys(self.columns, 0.0)
        for tree in self.trees:
            for column, gain in zip(tree.column, tree.gain):
                if column >= 0:
                    gains[self.columns[column]] += gain
        return spark.createDataFrame(list(gains.items()), "feature string, importance double")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("errorifexists").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Booster:
        data = json.loads(spark.read.text(path).first()[0])
        return Booster(**{**data, "trees": [Tree(**t) for t in data["trees"]]})


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = 255, accuracy: int = 10_000) -> list[list[float]]:
    """Upper edges of at most ``bins`` bins per column, from quantiles of a bounded summary of all rows."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = df.agg(*[F.percentile_approx(known(c), shares, accuracy).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(e or [])) for e in found]


def coded(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """One byte per row and column: 0 for missing, else 1 plus the number of edges below the value."""
    out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.uint8)
    for i, (values, e) in enumerate(zip(columns, edges)):
        out[:, i] = np.where(np.isnan(values), 0, np.searchsorted(e, values, "left") + 1)
    return out


_BLOCK = "block long, codes binary, labels binary, held binary, scores binary"


def _to_blocks(edges: list[list[float]]) -> Callable:
    arrays = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(batches):
            values = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in range(batch.num_columns - 2)]
            labels = batch.column("_label").to_numpy(zero_copy_only=False).astype("<f8")
            held = batch.column("_held").to_numpy(zero_copy_only=False).astype(np.uint8)
            cells = [first + i, coded(values, arrays).tobytes(), labels.tobytes(), held.tobytes(), b""]
            kinds = [pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], [c.split()[0] for c in _BLOCK.split(", ")])

    return run


def _opened(batch: pa.RecordBatch, width: int, base: float, trees: list[Tree]) -> Iterator[tuple]:
    """(block, codes, labels, held, scores) of each block, scores with ``trees`` added."""
    for block, codes, labels, held, scores in zip(*[batch.column(c).to_pylist() for c in ("block", "codes", "labels", "held", "scores")]):
        y = np.frombuffer(labels, "<f8")
        x = np.frombuffer(codes, np.uint8).reshape(len(y), width)
        total = np.frombuffer(scores, "<f8").copy() if scores else np.full(len(y), base)
        for tree in trees:
            total += tree.scores(x)
        yield block, x, y, np.frombuffer(held, np.uint8).astype(bool), total


def _with_scores(width: int, base: float, trees: list[Tree]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [total.astype("<f8").tobytes() for *_, total in _opened(batch, width, base, trees)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.binary())], batch.schema.names)

    return run


_SUMS = "node int, column int, counts binary, sums binary"


def _histograms(width: int, base: float, trees: list[Tree], growing: Tree, wanted: list[int], unit: float, sizes: list[int] | None = None) -> Callable:
    """Sums of a task's rows per wanted node, column and bin; node -1 has the loss of the held-out rows.

    ``sizes`` has the codes of each column, ``CODES`` where it is not given; a row names the first column of its pack.
    """
    starts = np.cumsum([0, *(sizes or [CODES] * width)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(growing.column), -1)
        place[wanted] = np.arange(len(wanted))
        offsets, step = starts[:-1], int(starts[-1])
        cells = len(wanted) * step
        counts, sums = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        loss, held_rows = 0, 0
        for batch in batches:
            for _, x, y, held, total in _opened(batch, width, base, trees):
                error = total - y
                scaled = np.rint(error[held] * (unit / (1 << (UNIT_BITS - LOSS_BITS)))).astype(np.int64)
                loss, held_rows = loss + int((scaled * scaled).sum()), held_rows + int(held.sum())
                at = place[growing.leaf_of(x)]
                rows = np.flatnonzero((at >= 0) & ~held)
                cell = (x[rows] + offsets + (at[rows] * step)[:, None]).ravel()
                gradient = np.repeat(np.rint(error[rows] * unit), width)
                counts += np.bincount(cell, minlength=cells)
                sums += np.bincount(cell, gradient, cells).astype(np.int64)  # whole numbers below 2^53
        names = ["node", "column", "counts", "sums"]
        out = [(-1, 0, np.array([held_rows]).tobytes(), np.array([loss]).tobytes())]
        packs = [(c, slice(starts[c], starts[min(c + PACK, width)])) for c in range(0, width, PACK)]
        for node, n, g in zip(wanted, counts.reshape(-1, step), sums.reshape(-1, step)):
            out += [(node, c, n[part].tobytes(), g[part].tobytes()) for c, part in packs]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names)

    return run


_CUTS = "node int, column int, gain double, cut int, missing_left boolean, n_left long, g_left long, n long, g long"


def best_cut(counts: np.ndarray, sums: np.ndarray, settings: Settings) -> tuple:
    """(gain, column, cut, missing_left, n_left, g_left) of the best cut of some columns, gain -1 if there is none.

    ``counts`` and ``sums`` have a row per column. A cut sends bins 1 to ``cut`` to the
    left and bin 0, the missing, to either side. Of equal gains the first column
    counts, then the one with missing on the left and the lower cut.
    """
    n, g = int(counts[0].sum()), int(sums[0].sum())  # every row of the node has one bin in each column
    strength = lambda a, b: np.divide(a.astype(float) ** 2, b + settings.l2, out=np.zeros(a.shape), where=b + settings.l2 > 0)
    whole = strength(np.array([g]), np.array([n]))[0]
    below = np.cumsum(counts[:, 1:], axis=1), np.cumsum(sums[:, 1:], axis=1)
    best, every = (-1.0, 0, 0, True, 0, 0), np.arange(len(counts))
    for missing_left in (True, False):
        n_left, g_left = (v + w[:, :1] if missing_left else v for v, w in zip(below, (counts, sums)))
        gains = strength(g_left, n_left) + strength(g - g_left, n - n_left) - whole
        gains[(n_left < settings.least_rows) | (n - n_left < settings.least_rows)] = -1.0
        at = gains.argmax(axis=1)
        top = gains[every, at]
        c = int(top.argmax())
        if top[c] > max(best[0], 0.0) or (top[c] == best[0] > 0 and c < best[1]):
            best = (float(top[c]), c, int(at[c]) + 1, missing_left, int(n_left[c, at[c]]), int(g_left[c, at[c]]))
    return best


def _cuts(settings: Settings, sizes: list[int]) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist())
        sums = sum(np.frombuffer(b, np.int64) for b in table.column("sums").to_pylist())
        node, first = table.column("node")[0].as_py(), table.column("column")[0].as_py()
        if node < 0:
            row = (node, 0, 0.0, 0, True, 0, 0, int(counts[0]), int(sums[0]))
        else:
            pack = np.array(sizes[first : first + PACK])
            there = np.arange(CODES) < pack[:, None]
            wide = np.zeros((2, len(pack), CODES), np.int64)
            wide[0][there], wide[1][there] = counts, sums
            gain, column, *cut = best_cut(wide[0], wide[1], settings)
            row = (node, first + column, gain, *cut, int(wide[0][0].sum()), int(wide[1][0].sum()))
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.bool_(), *[pa.int64()] * 4]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in _CUTS.split(", ")])

    return run


def grow(measure: Callable[[Tree, list[int]], dict[int, tuple]], settings: Settings, leaf_value: Callable[[int, int], float]) -> Tree:
    """One tree, best-first; ``measure(tree, nodes)`` gives each node's (gain, column, cut, missing_left, n_left, g_left, n, g)."""
    tree = Tree()
    tree.add(0.0)
    known = measure(tree, [0])
    tree.value[0] = leaf_value(known[0][6], known[0][7])
    while True:
        # cut on what is known; leaves whose halves are not known yet are worked out together
        heap, cuts, unknown, budget = [], [], [], settings.leaves - 1
        if known[0][0] > 0:
            heap.append((-known[0][0], 0))
        while heap and budget:
            _, node = heapq.heappop(heap)
            budget -= 1
            cuts.append(node)
            if tree.left[node] < 0:
                unknown.append(node)
                continue
            for child in (tree.left[node], tree.right[node]):
                if known[child][0] > 0:
                    heapq.heappush(heap, (-known[child][0], child))
        if not unknown:
            return _kept(tree, set(cuts))
        fresh = []
        for node in unknown:
            gain, column, cut, missing_left, n_left, g_left, n, g = known[node]
            tree.column[node], tree.cut[node], tree.missing_left[node], tree.gain[node] = column, cut, missing_left, gain
            tree.left[node] = tree.add(leaf_value(n_left, g_left))
            tree.right[node] = tree.add(leaf_value(n - n_left, g - g_left))
            fresh += [tree.left[node], tree.right[node]]
        known |= measure(tree, fresh)


def _kept(tree: Tree, cuts: set[int]) -> Tree:
    """The tree with the nodes of ``cuts`` as its inner nodes, numbered from the root down."""
    out = Tree()
    out.add(tree.value[0])
    todo = [(0, 0)]
    while todo:
        old, new = todo.pop(0)
        if old in cuts:
            out.column[new], out.cut[new], out.missing_left[new], out.gain[new] = tree.column[old], tree.cut[old], tree.missing_left[old], tree.gain[old]
            out.left[new], out.right[new] = out.add(tree.value[tree.left[old]]), out.add(tree.value[tree.right[old]])
            todo += [(tree.left[old], out.left[new]), (tree.right[old], out.right[new])]
    return out


def fit_booster(train: DataFrame, columns: Sequence[str], label: str, held: Column | None = None, settings: Settings = Settings()) -> Booster:
    """Boosted trees for ``label``; rows for which ``held`` is true only measure the loss.

    With ``patience`` the trees after the least held-out loss are dropped once it
    has not fallen for that many. Rows without a finite label are left out. A
    table without rows gives a model that predicts 0.
    """
    columns = list(columns)
    y = F.col(label).cast("double")
    known = train.where(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    flag = F.coalesce(held, F.lit(False)) if held is not None else F.lit(False)
    slim = known.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], y.alias("_label"), flag.alias("_held"))
    edges = bin_edges(slim.where("NOT _held"), [f"c{i}" for i in range(len(columns))], settings.bins)
    size = slim.agg(F.max(F.abs("_label")).alias("m"), F.count_if(~F.col("_held")).alias("n")).first()
    if not size["n"]:
        return Booster(columns, edges, 0.0, [])
    unit = (1 << UNIT_BITS) / (size["m"] or 1.0)
    total = slim.where("NOT _held").agg(F.sum(F.rint(F.col("_label") * unit).cast("decimal(38,0)")).alias("s")).first()["s"]
    base = int(total) / size["n"] / unit
    blocks = materialize(slim.mapInArrow(_to_blocks(edges), _BLOCK), "blocks")
    width, trees, written, losses = len(columns), [], 0, []
    sizes = [len(e) + 2 for e in edges]

    def leaf_value(n: int, g: int) -> float:
        return -settings.rate * g / unit / (n + settings.l2) if n + settings.l2 > 0 else 0.0

    def measure(tree: Tree, nodes: list[int]) -> dict[int, tuple]:
        sums = blocks.mapInArrow(_histograms(width, base, trees[written:], tree, nodes, unit, sizes), _SUMS)
        rows = sums.groupBy("node", "column").applyInArrow(_cuts(settings, sizes), _CUTS).collect()  # a row per leaf and pack
        for r in rows:
            if r["node"] < 0 and nodes == [0]:
                losses.append(r["g"] / max(1, r["n"]))
        best = {}
        for r in sorted((r for r in rows if r["node"] >= 0), key=lambda r: (r["node"], -r["gain"], r["column"])):
            best.setdefault(r["node"], (r["gain"], r["column"], r["cut"], r["missing_left"], r["n_left"], r["g_left"], r["n"], r["g"]))
        return best

    for _ in range(settings.trees):
        tree = grow(measure, settings, leaf_value)
        if settings.patience and held is not None and len(losses) - 1 - int(np.argmin(losses)) >= settings.patience:
            break
        if tree.column[0] < 0:
            break
        trees.append(tree)
        if len(trees) - written >= settings.refresh:
            blocks = materialize(blocks.mapInArrow(_with_scores(width, base, trees[written:]), _BLOCK), "blocks")
            written = len(trees)
    else:
        measure(Tree(*[[v] for v in (-1, 0, True, -1, -1, 0.0, 0.0)]), [0])  # the loss after the last tree
    if settings.patience and held is not None:
        trees = trees[: int(np.argmin(losses))]
    scale = (size["m"] or 1.0) ** 2 / (1 << 2 * LOSS_BITS)
    return Booster(columns, edges, base, trees, [x * scale for x in losses])
