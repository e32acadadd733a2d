"""Building blocks that keep their plan when one key holds most of the rows.

* ``lookup_join``      many-to-one join in one pass, hot keys cut by bytes
* ``with_position``    exact global row position without a single-task window
* ``running_sum``      exact global running sum over a total order
* ``group_quantiles``  exact quantiles per group, also for groups of any size
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import materialize

VALUES_IN_TASK = 5_000_000
# Rows of a batch whose values are counted together, and distinct values of a column that a task keeps to count on.
COUNTED_ROWS, KEPT_VALUES = 1 << 17, 1 << 14


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    limit: int | None = None,
) -> DataFrame:
    """Join ``left`` to a lookup that has at most one row per key.

    One join that reads each side once, without a job while the plan is built.
    Spark broadcasts a lookup whose estimated or, after its own stage, measured
    size is within ``spark.sql.autoBroadcastJoinThreshold``; ``limit=0`` rules
    that out. Beyond it both sides are dealt by the key, and the adaptive skew
    join cuts any partition of the facts above the session's byte threshold
    over several tasks, one that holds a hot key or the null keys included.
    """
    return left.join(right.hint("merge") if limit == 0 else right, list(on), how)


def has_key(
    left: DataFrame, keys: DataFrame, on: Sequence[str], present: bool = True, limit: int | None = None
) -> DataFrame:
    """Rows of ``left`` whose key is (not) in ``keys``; null keys are not in it."""
    return lookup_join(left, keys.select(*on).distinct(), on, "left_semi" if present else "left_anti", limit).select(*left.columns)


def _partition_offsets(ordered: DataFrame, total: Column) -> DataFrame:
    """Sum of ``total`` over all earlier partitions: one row per partition."""
    rows = ordered.groupBy("_pid").agg(total.alias("t")).orderBy("_pid").collect()
    sums = list(accumulate((int(r["t"]) for r in rows), initial=0))
    data = [(int(r["_pid"]), int(s)) for r, s in zip(rows, sums)]
    return ordered.sparkSession.createDataFrame(data, "_pid int, _offset long")


def _range_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Globally sorted rows with their place in the sorted partition, written once.

    Row ids change when a plan runs again, hence the written table.
    """
    marked = df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())
    split = (
        marked.withColumn("_pid", F.shiftright("_row", 33).cast("int"))
        .withColumn("_row", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    return materialize(split, "sorted")


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the 0-based position of every row in a total order.

    ``order`` must decide between any two rows (end it with a unique column).
    """
    ordered = _range_sorted(df, order)
    offsets = _partition_offsets(ordered, F.count(F.lit(1)))
    placed = ordered.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_row") + F.col("_offset"))
    return placed.select(*df.columns, name)


def running_sum(df: DataFrame, order: Sequence[str], measure: str, name: str = "before") -> DataFrame:
    """Add the sum of ``measure`` (whole numbers) over all rows earlier in the order.

    Rows are range-partitioned by the order, so a group is cut over as many
    tasks as it needs; ``order`` must be unique.
    """
    ordered = _range_sorted(df, [F.col(c) for c in order])
    offsets = _partition_offsets(ordered, F.sum(measure))
    inside = Window.partitionBy("_pid").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ordered.withColumn(name, F.sum(measure).over(inside) - F.col(measure))
    placed = summed.join(F.broadcast(offsets), "_pid").withColumn(name, F.col(name) + F.col("_offset"))
    return placed.select(*df.columns, name)


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    if by:
        sizes = df.groupBy(*by).count().agg(F.max("count").alias("n"))
    else:
        sizes = df.agg(F.count(F.lit(1)).alias("n"))
    return int(sizes.first()["n"] or 0)


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    rows_in_task: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per group (nulls ignored).

    While the largest group is within ``rows_in_task`` the built-in exact
    percentile is used (partial aggregates, one shuffle). Otherwise distinct
    values are counted, put in one global order by running counts and the two
    neighbours of each rank are picked, so no group has to fit a task.
    """
    by = list(by)
    limit = VALUES_IN_TASK if rows_in_task is None else rows_in_task
    known = df.where(F.col(value).isNotNull()).select(*by, value)
    if largest_group(known, by) <= limit:
        picks = [F.percentile(value, F.lit(p)).alias(n) for n, p in quantiles.items()]
        return known.groupBy(*by).agg(*picks) if by else known.agg(*picks)
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    counted = known.select(group.alias("_g"), F.col(value).alias("_v")).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    return _counted_quantiles(counted, by, quantiles)


def _counted_quantiles(counted: DataFrame, by: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """Quantiles per group from how often (``_c``) each value (``_v``) occurs in each group (``_g``)."""
    ranked = running_sum(counted, ["_g", "_v"], "_c", "_before")
    spans = ranked.groupBy("_g").agg(F.min("_before").alias("_start"), F.sum("_c").alias("_n"))
    placed = lookup_join(ranked, spans, ["_g"]).withColumn("_first", F.col("_before") - F.col("_start"))
    picks = []
    for name, p in quantiles.items():
        rank = (F.col("_n") - 1) * F.lit(float(p))
        for tag, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            inside = (F.col("_first") <= at) & (at < F.col("_first") + F.col("_c"))
            picks.append(F.max(F.when(inside, F.col("_v"))).alias(f"{name}_{tag}"))
    picked = placed.groupBy("_g").agg(F.max("_n").alias("_n"), *picks)
    out = [F.col("_g")[c].alias(c) for c in by]
    for name, p in quantiles.items():
        rank = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"{name}_lo").cast("double"), F.col(f"{name}_hi").cast("double")
        # the built-in percentile's own formula, so that both ways agree to the last digit
        between = (F.ceil(rank) - rank) * lo + (rank - F.floor(rank)) * hi
        out.append(F.when(lo == hi, lo).otherwise(between).alias(name))
    return picked.select(*out)


def _count_values(names: Sequence[str], bounds: Sequence[tuple[float, float]]) -> Callable:
    """How often each value of each column occurs in a task; a column of many values may name one more than once.

    All values below the column's bounds are taken for one, and so are all above.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        waiting: list[pa.RecordBatch] = []

        def rows(i: int, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            cells = [pa.array([names[i]] * len(values), pa.string()), pa.array(values, pa.float64()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(cells, ["_name", "_v", "_c"])

        def counted() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting)
            for i in range(len(names)):
                # as in Spark's groups: all NaN are one value, and so are both zeros
                values = table.column(i).drop_null().to_numpy() + 0.0
                low, high = bounds[i]
                values[values < low], values[values > high] = -np.inf, np.inf
                values, counts = np.unique(values, return_counts=True)
                if i in kept:
                    values, at = np.unique(np.concatenate([kept[i][0], values]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([kept.pop(i)[1], counts]), len(values)).astype(np.int64)
                if len(values) > KEPT_VALUES:
                    yield rows(i, values, counts)
                else:
                    kept[i] = values, counts

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= COUNTED_ROWS:
                yield from counted()
                waiting = []
        if waiting:
            yield from counted()
        for i, (values, counts) in kept.items():
            yield rows(i, values, counts)

    return run


def group_medians(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], rows_in_task: int | None = None
) -> DataFrame:
    """Median of several columns per group; same size rule as ``group_quantiles``,
    counting the values of all columns, since one task would hold them together."""
    by = list(by)
    limit = VALUES_IN_TASK if rows_in_task is None else rows_in_task
    slim = df.select(*by, *columns)
    if largest_group(slim, by) * len(columns) <= limit:
        picks = [F.median(c).alias(c) for c in columns]
        return slim.groupBy(*by).agg(*picks) if by else slim.agg(*picks)
    if not by:
        # a rough quantile tells between which values the median lies; only those are counted one by one
        numbers = slim.select(*[F.col(c).cast("double").alias(c) for c in columns])
        near = numbers.agg(*[F.percentile_approx(c, F.array(F.lit(0.49), F.lit(0.51)), 1000).alias(c) for c in columns]).first()
        bounds = [tuple(near[c] or (-np.inf, np.inf)) for c in columns]

        def medians(within: Sequence[tuple[float, float]]) -> DataFrame:
            rows = numbers.mapInArrow(_count_values(list(columns), within), "_name string, _v double, _c long")
            counted = materialize(rows.groupBy(F.struct("_name").alias("_g"), "_v").agg(F.sum("_c").alias("_c")), "counted")
            found = _counted_quantiles(counted, ["_name"], {"_median": 0.5})
            return found.agg(*[F.max(F.when(F.col("_name") == c, F.col("_median"))).alias(c) for c in columns])

        row = medians(bounds).first()
        if not all(row[c] is None or low <= row[c] <= high for c, (low, high) in zip(columns, bounds)):
            row = medians([(-np.inf, np.inf)] * len(columns)).first()
        return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"`{c}` double" for c in columns))
    tall = slim.select(
        *by, F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_value")) for c in columns])).alias("_e")
    ).select(*by, "_e._name", "_e._value")
    medians = group_quantiles(tall, [*by, "_name"], "_value", {"_median": 0.5}, limit)
    wide = [F.max(F.when(F.col("_name") == c, F.col("_median"))).alias(c) for c in columns]
    known = medians.groupBy(*by).agg(*wide)
    key = F.struct(*by)
    groups = slim.select(*by).distinct().withColumn("_k", key)
    return lookup_join(groups, known.select(key.alias("_k"), *columns), ["_k"]).select(*by, *columns)
