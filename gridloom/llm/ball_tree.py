"""Exact top-k inner products by branch and bound over one ball tree per shard.

Vectors are dealt evenly into shards and queries into groups; a task holds one
shard and one group. It builds a ball tree (halves along the line between two
far points, down to small leaves) whose nodes know centre and radius, so that no
vector q in a node scores more than ``q.centre + |q| * radius``. Levels are
descended while that bound reaches the query's current k-th score; the leaves
left over are visited in the order of their bounds, a few per query at a time,
and every visit raises the k-th score that the next ones must reach.

The k-th score is shared between shards: each query first searches one shard,
and what it finds there is the score to reach in all others. A node with a bound
equal to that score is still searched, as a smaller id may tie, so the result
is exact.

At scale: the work grows with queries times vectors, as any exact search does
that bounds can't cut; memory does not: a task holds at most ``SHARD`` vectors
and ``GROUP`` queries. Vectors move once per group of queries, queries once per
shard. Nothing is broadcast or collected, and shards are dealt by row, so
repeated ids or vectors do not meet in one task.

Scores are whole numbers: components are ``floor(1024 * x)``. Sums below 2^53
are exact in doubles; where a bound says they might not be, Python's whole
numbers are used; a component or score outside a long is held at its end.

Null vectors, those with null or non-finite components and null ids take no
part. Vectors are compared with those of equal length only, empty ones score 0.
Repeated rows are candidates each; those with the query's id are none. An id
that is asked for by several rows is one query, by its least vector. An empty
table gives no rows; extra columns are ignored; ties go to the smaller id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import materialize

SHARD, GROUP, LEAF = 1 << 16, 1 << 13, 64
LEAST_SHARD = 1 << 11
EXACT = 2.0**53
LONG = (1 << 63) - 1


@dataclass
class Tree:
    """Vectors in leaf order, and per level the nodes' bounds: rows, centres and radii."""

    rows: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    edges: np.ndarray


def build(vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    """Ball tree whose nodes at a level split the rows as evenly as can be."""
    n = len(vectors)
    depth = min(max(0, math.ceil(math.log2(n / leaf))), int(math.log2(n)))
    order = np.arange(n)
    edges = np.array([0, n])
    levels = []
    for level in range(depth + 1):
        centres = np.array([vectors[order[a:b]].mean(axis=0) for a, b in zip(edges, edges[1:])])
        radii = np.array([np.sqrt(((vectors[order[a:b]] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(edges, edges[1:], centres)])
        levels.append((centres, radii))
        if level == depth:
            break
        cuts = [0]
        for a, b, c in zip(edges, edges[1:], centres):
            part = order[a:b]
            own = vectors[part]
            one = own[((own - c) ** 2).sum(axis=1).argmax()]
            two = own[((own - one) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            order[a:b] = part[np.argpartition(own @ (two - one), half)]
            cuts += [a + half, b]
        edges = np.array(cuts)
    return Tree(order, levels, edges)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of each row by falling score, then rising id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, reach: np.ndarray, k: int):
    """(scores, ids) of each query's k best in the tree that reach ``reach``, padded with minus infinity; and the leaves visited."""
    m = len(queries)
    norms = np.sqrt((queries**2).sum(axis=1))
    scores = np.full((m, k), -np.inf)
    found = np.full((m, k), np.iinfo(np.int64).max)
    reach = reach.copy()
    alive = np.ones((m, 1), bool)
    for level, (centres, radii) in enumerate(tree.levels):
        if level:
            alive = np.repeat(alive, 2, axis=1)
        nodes = np.flatnonzero(alive.any(axis=0))
        bounds = np.full(alive.shape, -np.inf)
        size = np.sqrt((centres[nodes] ** 2).sum(axis=1)) + radii[nodes]
        # a little more than the bound, against rounding
        bounds[:, nodes] = queries @ centres[nodes].T + norms[:, None] * (radii[nodes] + 1e-9 * size) + 1e-6
        bounds[~alive] = -np.inf
        alive &= bounds >= reach[:, None]
    order = np.argsort(-bounds, axis=1, kind="stable")
    at, step, visits = 0, 1, 0
    while at < order.shape[1]:
        leaves = order[:, at : at + step]
        ahead = np.take_along_axis(bounds, leaves, 1)
        wanted = (ahead >= reach[:, None]) & (ahead > -np.inf)
        if not wanted.any():
            break
        who, which = np.nonzero(wanted)
        which = leaves[who, which]
        by_leaf = np.argsort(which, kind="stable")
        who, which = who[by_leaf], which[by_leaf]
        starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(which)]):
            rows = tree.rows[tree.edges[which[a]] : tree.edges[which[a] + 1]]
            asked = who[a:b]
            got = queries[asked] @ vectors[rows].T
            got[own[asked][:, None] == ids[rows][None, :]] = -np.inf
            visits += len(asked)
            better = (got.max(axis=1) >= reach[asked]) & (got.max(axis=1) > -np.inf)
            asked, got = asked[better], got[better]
            if not len(asked):
                continue
            scores[asked], found[asked] = _best(
                np.hstack([scores[asked], got]), np.hstack([found[asked], np.broadcast_to(ids[rows], got.shape)]), k
            )
            reach[asked] = np.maximum(reach[asked], scores[asked, -1])
        at, step = at + step, min(2 * step, 64)
    return scores, found, visits


def _exact(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """Scores by Python's whole numbers, query by query, for components too large for doubles."""
    whole = np.array([[int(x) for x in v] for v in vectors], object)
    for q, me in zip(queries, own):
        dots = (whole * np.array([int(x) for x in q], object)).sum(axis=1)
        ranked = sorted((-max(-LONG - 1, min(LONG, s)), i) for s, i in zip(dots.tolist(), ids.tolist()) if i != me)[:k]
        yield me, ranked


def _cell(k: int):
    def run(key: tuple, shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(shard) or not len(asked):
            return empty
        vectors, queries = np.stack(shard["v"].to_numpy()), np.stack(asked["v"].to_numpy())
        ids, own = shard["vec_id"].to_numpy(np.int64), asked["vec_id"].to_numpy(np.int64)
        width = vectors.shape[1]
        if not width:
            vectors, queries = np.zeros((len(ids), 1)), np.zeros((len(own), 1))
        if float(np.abs(vectors).max()) * float(np.abs(queries).max()) * max(1, width) >= EXACT:
            rows = [(me, i, -s) for me, ranked in _exact(vectors, ids, queries, own, k) for s, i in ranked]
            return pd.DataFrame(rows, columns=list(empty.columns)).astype("int64")
        reach = asked["reach"].to_numpy(float)
        reach = np.where(np.isnan(reach), -np.inf, reach)
        scores, found, _ = search(build(vectors), vectors, ids, queries, own, reach, k)
        known = (scores > -np.inf) & (scores >= reach[:, None])
        who = np.nonzero(known)[0]
        return pd.DataFrame({"query_id": own[who], "vec_id": found[known], "score": scores[known].astype(np.int64)})

    return run


def whole_numbers(vector: Column) -> Column:
    """Components as whole numbers held in doubles, null where one is missing or not finite."""
    limit = F.lit(float("inf"))
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.when(fit, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("double")))


def _searched(shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    keys = ["width", "shard", "group"]
    return shards.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_cell(k), "query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, chosen: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for every row that ``chosen`` says is a query."""
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector)).alias("v"), F.coalesce(chosen, F.lit(False)).alias("asks"))
    slim = slim.where("vec_id IS NOT NULL AND v IS NOT NULL").select("*", F.size("v").alias("width"))
    rows = materialize(slim.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    n, asks = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards = max(1, math.ceil(n / SHARD), min(spark.sparkContext.defaultParallelism, math.ceil(n / LEAST_SHARD)))
    groups = max(1, math.ceil(asks / GROUP))
    dealt = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "_row"), F.lit(parts)).cast("int")
    held = rows.select("vec_id", "v", "width", dealt(1, shards).alias("shard"))
    asked = rows.where("asks").groupBy("vec_id").agg(F.min_by("v", F.struct("width", "v")).alias("v"), F.min("_row").alias("_row"))
    asked = materialize(asked.select("vec_id", "v", F.size("v").alias("width"), dealt(2, shards).alias("home"), dealt(3, groups).alias("group")), "queries")

    at_home = asked.select("vec_id", "v", "width", F.col("home").alias("shard"), F.lit(0).alias("group"), F.lit(None).cast("double").alias("reach"))
    first = materialize(_searched(held.withColumn("group", F.lit(0)), at_home, k), "home")
    # the k-th score found at home, none for queries with fewer
    reach = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)
    away = asked.join(reach.select(F.col("query_id").alias("vec_id"), F.col("low").cast("double").alias("reach")), "vec_id", "left")
    away = away.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").select("vec_id", "v", "width", "shard", "group", "reach")
    spread = held.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    rest = _searched(spread, away, k) if shards > 1 else first.limit(0)
    return _top(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
