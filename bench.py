"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Every query is run in full (plan, all jobs and every output row) into Spark's
``noop`` sink. ``BENCH_QUERIES`` (comma separated) picks others.
"""

from __future__ import annotations

import json
import os
import time

from gridloom.plans import catalog
from gridloom.session import local_session

HEADLINE = [
    "usage_by_site",
    "join_weather",
    "null_profile",
    "numeric_stats",
    "describe_percentiles",
    "median_by_use",
    "hourly_profile",
    "duplicate_keys",
    "histogram",
    "box_summary",
    "spearman_matrix",
    "interpolate_linear",
    "ffill_causal",
    "features_v1",
    "features_electricity",
    "mad_anomalies",
    "detect_and_store",
    "peak_outlook",
    "latest_per_meter",
    "insert_if_absent",
    "row_position",
    "systematic_sample",
    "target_decile",
    "regression_metrics",
    "subgroup_metrics",
    "model_comparison",
    "impute_scale",
    "validate_requests",
    "weather_json_normalize",
    "train_linear",
    "train_decision_tree",
    "train_random_forest",
    "score_batch",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "gridloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    picked = os.environ.get("BENCH_QUERIES")
    names = picked.split(",") if picked else HEADLINE
    catalog.QUERIES["usage_by_site"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
