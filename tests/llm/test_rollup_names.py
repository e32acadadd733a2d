"""Batch names survive compaction, and no sum is hidden."""

from __future__ import annotations

from gridloom.llm import token_rollup as tr


def rows(spark, *data):
    return spark.createDataFrame([("s", "en", "v", *d) for d in data], tr.SCHEMA)


def seen(spark, store):
    return sorted(tuple(r)[3:] for r in tr.totals(spark, store).collect())


def test_names_survive_compaction(spark, tmp_path):
    one, two, three = (str(tmp_path / n) for n in ("one", "two", "three"))
    assert tr.commit(one, "load", rows(spark, (2, 10, 50))) and tr.commit(one, "more", rows(spark, (1, 5, 7)))
    tr.compact(spark, one, two)
    assert seen(spark, two) == [(3, 15, 57)]
    assert not tr.commit(two, "load", rows(spark, (2, 10, 50))) and seen(spark, two) == [(3, 15, 57)]
    assert tr.commit(two, "late", rows(spark, (-1, -5, -7)))
    tr.compact(spark, two, three)
    assert not any(tr.commit(three, n, rows(spark, (9, 9, 9))) for n in ("load", "more", "late", "compacted"))
    assert seen(spark, three) == [(2, 10, 50)] and tr.carried(spark, three) == {"load", "more", "late"}


def test_broken_compaction_is_done_again(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    tr.commit(one, "load", rows(spark, (2, 10, 50)))
    spark.createDataFrame([("load",)], "value string").write.text(f"{two}/carried")  # the names, but no commit
    assert tr.carried(spark, two) == set()
    tr.compact(spark, one, two)
    assert seen(spark, two) == [(2, 10, 50)]


def test_tokens_without_documents_show(spark, tmp_path):
    store, other, empty = str(tmp_path / "store"), str(tmp_path / "other"), str(tmp_path / "empty")
    tr.commit(store, "a", rows(spark, (1, 10, 0)))
    tr.commit(store, "b", rows(spark, (-1, -4, 0)))
    assert seen(spark, store) == [(0, 6, 0)]
    tr.compact(spark, store, other)
    tr.commit(other, "c", rows(spark, (0, -6, 0)))
    assert seen(spark, other) == []
    tr.compact(spark, empty, str(tmp_path / "new"))
    assert seen(spark, str(tmp_path / "new")) == []
