"""Command line: compare all (or the named) queries with their oracles."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from gridloom.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        started = time.perf_counter()
        try:
            df = fn(spark, sf)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                problem = None if df.count() >= 0 else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1200]}"
        mark = "ok  " if problem is None else "FAIL"
        failed += problem is not None
        print(f"{mark} {name} {time.perf_counter() - started:.2f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
