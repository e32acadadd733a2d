"""Connected components by alternating large and small stars.

Links stay in tables: every round is two groupings combined before they move
and two joins on the vertex, written to the shared folder. A vertex with very
many links meets only its minimum, so no neighbour list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """Every (u, v) with the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return pairs.join(least, "u")


def star_components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(vertex, root) for every vertex of ``links`` (a, b); root is the least vertex reachable.

    Loops and repeated links do no harm; no links give no rows. Raises when
    ``rounds`` do not suffice (they grow with the logarithm of the vertices).
    """
    edges = materialize(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        near = _with_least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u != v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
