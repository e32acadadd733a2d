"""A feature set described from its expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.operators import dictionary as dc

RAW = "a double, b double, name string, `odd name` int, y double"


def _described(spark, rows):
    raw = spark.createDataFrame(rows, RAW)
    engineered = {"ratio": F.col("a") / F.col("b"), "upper": F.upper("name"), "leak": F.col("y") > F.col("a"), "one": F.lit(1)}
    features = raw.select("*", *[e.alias(n) for n, e in engineered.items()])
    return dc.described(features, raw, engineered, {"a": "median", "b": "kept", "y": "required"}, "y", ["odd name"]).collect()


def test_sources_types_and_figures(spark):
    rows = _described(spark, [(1.0, 2.0, "x", 1, 5.0), (float("nan"), 0.5, None, None, 0.0), (3.0, None, "z", 7, 1.0)])
    assert [r["feature"] for r in rows] == ["a", "b", "name", "odd name", "y", "ratio", "upper", "leak", "one"]
    found = {r["feature"]: r for r in rows}
    assert {n: r["sources"] for n, r in found.items() if r["origin"] == "engineered"} == {"ratio": "a,b", "upper": "name", "leak": "a,y", "one": ""}
    assert (found["a"]["minimum"], found["a"]["maximum"], found["a"]["missing"]) == (1.0, 3.0, 1)
    assert (found["ratio"]["minimum"], found["ratio"]["missing"], found["ratio"]["missing_handling"]) == (0.5, 2, "median; kept")
    assert (found["upper"]["minimum"], found["upper"]["missing"], found["upper"]["data_type"]) == (None, 1, "string")
    assert (found["leak"]["minimum"], found["leak"]["maximum"]) == (0.0, 1.0)
    assert [n for n, r in found.items() if not r["sent_to_model"]] == ["odd name", "y", "leak"]
    assert [n for n, r in found.items() if r["reads_target"]] == ["leak"]
    assert found["ratio"]["formula"] == "/(a, b)" and found["a"]["formula"] == "a"


def test_an_empty_table_has_no_range(spark):
    rows = _described(spark, [])
    assert len(rows) == 9
    assert all(r["minimum"] is None and r["missing"] == 0 for r in rows)


def test_an_expression_over_unknown_columns_is_an_error(spark):
    raw = spark.createDataFrame([], RAW)
    with pytest.raises(ValueError, match="lacks"):
        dc.sources(raw, F.col("nowhere") + 1)
