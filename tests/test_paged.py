"""Pages of a sorted table: the right rows, and a cost that does not depend on the page."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from gridloom.sources import paged


@pytest.fixture
def many_parts(spark):
    """Range partitions stay apart though they are small."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def _table(spark, n):
    """Two thirds of the rows tie in the first column."""
    hot = F.when(F.col("id") % 3 == 0, F.col("id") * 7 % 101).otherwise(F.lit(5))
    return spark.range(0, n, 1, 6).select(hot.alias("score"), "id", F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("a b.c"))


def _order():
    return [F.col("score").desc(), F.col("id")]


def test_pages_are_slices_of_the_order(spark, tmp_path, many_parts):
    path, df = str(tmp_path / "t"), _table(spark, 1003)
    assert paged.write_pages(df, path, _order()) == 1003
    want = [tuple(r) for r in df.orderBy(*_order()).collect()]
    assert len(os.listdir(f"{path}/rows")) > 4 and paged.page_count(spark, path, 8) == 126
    for number, size in ((1, 8), (2, 8), (60, 8), (126, 8), (127, 8), (3, 300), (1, 2000)):
        got = paged.read_page(spark, path, number, size)
        assert got.columns == df.columns
        assert [tuple(r) for r in got.collect()] == want[(number - 1) * size : number * size]
    edges = [tuple(r) for i in range(0, 1003, 59) for r in paged.read_range(spark, path, i, 59, "at").collect()]
    assert edges == [(*r, i) for i, r in enumerate(want)]
    assert paged.read_range(spark, path, 5, 0).count() == 0


def _read(df):
    """Rows that left the scans of an executed plan, and partitions read."""
    df.collect()
    seen, todo, rows, parts = set(), [df._jdf.queryExecution().executedPlan()], 0, 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName().startswith("Scan") and node.id() not in seen:
            seen.add(node.id())
            metrics = node.metrics()
            rows += metrics.apply("numOutputRows").value()
            parts += metrics.apply("numPartitions").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows, parts


def test_a_deep_page_reads_as_much_as_the_first(spark, tmp_path, many_parts):
    path = str(tmp_path / "t")
    n = paged.write_pages(_table(spark, 40_000), path, _order())
    whole = len([p for p in os.listdir(f"{path}/rows") if "=" in p])
    last = paged.page_count(spark, path)
    read = [_read(paged.read_page(spark, path, k)) for k in (1, last // 2, last)]
    assert whole >= 6 and all(1 <= parts <= 2 for _, parts in read)
    assert max(r for r, _ in read) <= 3 * n // whole


def test_empty_table_and_what_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    none = _table(spark, 5).where("id < 0")
    assert paged.write_pages(none, path, _order()) == 0
    got = paged.read_page(spark, path, 1)
    assert got.columns == none.columns and got.count() == 0 and paged.page_count(spark, path) == 0
    for bad in ((0, 8), (1, 0)):
        with pytest.raises(ValueError):
            paged.read_page(spark, path, *bad)
    with pytest.raises(ValueError):
        paged.write_pages(spark.range(1).withColumn(paged.ROW, F.lit(1)), str(tmp_path / "u"), [F.col("id")])
    with pytest.raises(Exception):
        paged.write_pages(_table(spark, 5), path, _order())
