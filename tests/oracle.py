"""Compare a Spark query with its SQL oracle: names, kinds, rows and values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def kind(arrow_type) -> str:
    import pyarrow.types as t

    if t.is_boolean(arrow_type):
        return "bool"
    if t.is_integer(arrow_type):
        return "int"
    if t.is_floating(arrow_type):
        return "float"
    if t.is_decimal(arrow_type):
        return "decimal"
    if t.is_timestamp(arrow_type):
        return "timestamp" if arrow_type.tz is None else "timestamp_tz"
    if t.is_date(arrow_type):
        return "date"
    if t.is_string(arrow_type) or t.is_large_string(arrow_type):
        return "string"
    return str(arrow_type)


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return "0" if v == 0 else repr(v)
    return str(v)


def table_rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(cell(v) for v in row) for row in zip(*columns))


def compare(spark_df, con, sql: str) -> str | None:
    left = spark_df.toArrow()
    right = con.cursor().sql(sql).to_arrow_table()
    a = {f.name: kind(f.type) for f in left.schema}
    b = {f.name: kind(f.type) for f in right.schema}
    if a != b:
        return f"schema {sorted(set(a.items()) ^ set(b.items()))}"
    if left.num_rows != right.num_rows:
        return f"rows {left.num_rows} for {right.num_rows}"
    x, y = table_rows(left), table_rows(right)
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    if bad:
        return f"{len(bad)} of {len(x)} rows differ, first {sorted(left.column_names)}: {bad[0]}"
    return None
