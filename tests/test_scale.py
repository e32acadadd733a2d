"""The skew-safe building blocks give the same rows as the plain ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import scale


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(7)
    data = []
    for i in range(6000):
        key = 1 if i % 3 == 0 else (None if i % 17 == 0 else rng.randrange(400))
        data.append((i, key, rng.choice(["a", "b"]), None if i % 19 == 0 else round(rng.gauss(50, 20), 2)))
    return spark.createDataFrame(data, "id long, k int, g string, v double").repartition(5)


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame([(i, f"name{i}", float(i)) for i in range(0, 400, 2)] + [(1, "hot", 1.0)], "k int, name string, w double")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_without_broadcast(facts, lookup, how):
    plain = facts.join(lookup, ["k"], how)
    assert rows_of(scale.lookup_join(facts, lookup, ["k"], how, limit=0)) == rows_of(plain)
    assert rows_of(scale.lookup_join(facts, lookup, ["k"], how)) == rows_of(plain)


def test_lookup_join_on_two_keys(facts, spark):
    lookup = spark.createDataFrame([(k, g, k * 10) for k in range(0, 400, 3) for g in ("a", "b")] + [(1, "a", 7)], "k int, g string, z int")
    assert rows_of(scale.lookup_join(facts, lookup, ["k", "g"], limit=0)) == rows_of(facts.join(lookup, ["k", "g"], "left").select("k", "g", "id", "v", "z"))


@pytest.mark.parametrize("limit", [None, 0])
def test_has_key(facts, lookup, limit):
    assert rows_of(scale.has_key(facts, lookup, ["k"], True, limit)) == rows_of(facts.join(lookup, ["k"], "left_semi").select(*facts.columns))
    assert rows_of(scale.has_key(facts, lookup, ["k"], False, limit)) == rows_of(facts.join(lookup, ["k"], "left_anti").select(*facts.columns))


@pytest.mark.parametrize("limit", [None, 0])
def test_joins_read_the_facts_once(facts, lookup, tmp_path, limit):
    """Two chained joins and a key test plan one scan of each input, whether the lookup is broadcast or not."""
    spark = facts.sparkSession
    for name, df in (("facts", facts), ("lookup", lookup)):
        df.write.parquet(f"{tmp_path}/{name}")
    table, names = spark.read.parquet(f"{tmp_path}/facts"), spark.read.parquet(f"{tmp_path}/lookup")
    one = scale.lookup_join(table, names, ["k"], limit=limit)
    two = scale.lookup_join(one, names.withColumnsRenamed({"name": "n2", "w": "w2"}), ["k"], limit=limit)
    plan = scale.has_key(two, names, ["k"], limit=limit)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 4
    assert plan.count("SortMergeJoin") == (3 if limit == 0 else 0)


def test_a_hot_key_is_cut_over_tasks(spark):
    """One key with most of the rows: its partition is read by several tasks."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 200_000, 1, 16).select(F.when(F.col("id") % 10 == 0, F.col("id") % 97).otherwise(7).alias("k"), F.rand(3).alias("v"))
        names = spark.range(97).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        joined = scale.lookup_join(rows, names, ["k"], limit=0)
        largest = joined.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        assert joined.count() == 200_000 and largest < 100_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_position(facts):
    got = {r["id"]: r["position"] for r in scale.with_position(facts, [F.col("v"), F.col("id")]).collect()}
    local = sorted(facts.collect(), key=lambda r: (r["v"] is not None, r["v"] or 0, r["id"]))
    assert got == {r["id"]: i for i, r in enumerate(local)}


def test_running_sum(facts):
    df = facts.select("id", (F.col("id") % 7).alias("m"))
    got = {r["id"]: r["before"] for r in scale.running_sum(df, ["id"], "m").collect()}
    total = 0
    for i in range(6000):
        assert got[i] == total
        total += i % 7


@pytest.mark.parametrize("by", [[], ["g"], ["k"], ["g", "k"]])
def test_quantiles_of_groups_too_large_for_a_task(facts, by):
    points = {"p0": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "p100": 1.0}
    small = scale.group_quantiles(facts, by, "v", points)
    large = scale.group_quantiles(facts, by, "v", points, rows_in_task=0)

    def rounded(df):
        return rows_of(df.select(*by, *[F.round(c, 6).alias(c) for c in points]))

    assert rounded(small) == rounded(large)
    assert rows_of(small.select(*by, *points)) == rows_of(large.select(*by, *points))


@pytest.mark.parametrize("by", [[], ["g"], ["k"]])
def test_medians_of_groups_too_large_for_a_task(facts, by):
    df = facts.withColumn("u", F.when(F.col("k") != 1, F.col("v") * 2))

    def rounded(d):
        return rows_of(d.select(*by, F.round("v", 6).alias("v"), F.round("u", 6).alias("u")))

    assert rounded(scale.group_medians(df, by, ["v", "u"])) == rounded(scale.group_medians(df, by, ["v", "u"], rows_in_task=0))


@pytest.mark.parametrize("n", [5, 1500])
def test_latest_rows_of_a_key(facts, n):
    from gridloom.operators.windows import latest_per_key

    got = {(r["k"], r["place"]): r["id"] for r in latest_per_key(facts, "k", "id", n).collect()}
    groups = {}
    for r in facts.collect():
        groups.setdefault(r["k"], []).append(r["id"])
    want = {(k, i + 1): x for k, ids in groups.items() for i, x in enumerate(sorted(ids)[-n:])}
    assert got == want
