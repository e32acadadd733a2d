"""Deterministic samples and rank buckets built on exact row positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.scale import lookup_join, with_position
from gridloom.session import materialize


def decile(df: DataFrame, value: str, tiebreak: Sequence[str], name: str = "decile", parts: int = 10) -> DataFrame:
    """Equal-rank buckets 0..parts-1 by first-come rank (not ``ntile``: cut points interpolate)."""
    placed = with_position(df, [F.col(value), *[F.col(c) for c in tiebreak]], "_at")
    last = placed.count() - 1
    if last < 1:
        return placed.withColumn(name, F.lit(0)).drop("_at")
    cut = F.ceil(F.col("_at").cast("double") * parts / F.lit(float(last))) - 1
    return placed.withColumn(name, F.greatest(F.lit(0), cut).cast("int")).drop("_at")


def stride_for(rows: int, cap: int) -> int:
    return max(1, -(-rows // cap))


def _rows_at(df: DataFrame, placed: DataFrame, order: Sequence[str]) -> DataFrame:
    """The full rows of the chosen positions, found by their order columns.

    Only the order columns are sorted and written; the chosen keys are few.
    """
    chosen = materialize(placed.select(*order), "chosen")
    return lookup_join(df, chosen, order, "inner").select(*df.columns)


def systematic_sample(df: DataFrame, cap: int, order: Sequence[str]) -> DataFrame:
    """Every stride-th row of the stated order, at most ``cap`` rows.

    ``order`` names non-null columns that tell all rows apart.
    """
    placed = with_position(df.select(*order), [F.col(c) for c in order], "_at")
    stride = stride_for(placed.count(), cap)
    return _rows_at(df, placed.where((F.col("_at") % stride == 0) & (F.col("_at") < stride * cap)), order)


def even_subset(df: DataFrame, limit: int, order: Sequence[str]) -> DataFrame:
    """``limit`` evenly spaced rows including both ends; all rows when there are no more.

    A position is kept when some k maps to it; solving for k needs no join.
    ``order`` is as for ``systematic_sample``.
    """
    placed = with_position(df.select(*order), [F.col(c) for c in order], "_at")
    rows = placed.count()
    if rows <= limit:
        return df
    if limit == 1:
        return _rows_at(df, placed.where("_at = 0"), order)
    span, steps = rows - 1, limit - 1
    k = F.expr(f"(_at * {steps}L + {span - 1}L) div {span}L")
    kept = placed.withColumn("_k", k).where(f"_k <= {steps} AND (_k * {span}L) div {steps}L = _at")
    return _rows_at(df, kept, order)
