"""Robust per-meter outliers and their idempotent storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.joins import insert_if_absent
from gridloom.operators.scale import group_medians, has_key, lookup_join
from gridloom.session import materialize

# Scale of the median deviation and the bounds of the settings.
MAD_SCALE = 1.4826
THRESHOLD_RANGE = (0, 10)
HISTORY_RANGE = (3, 20000)


def check_settings(threshold: float, limit: int | None = None) -> None:
    if not THRESHOLD_RANGE[0] < threshold <= THRESHOLD_RANGE[1]:
        raise ValueError("the threshold must lie above 0 and not above 10")
    if limit is not None and not HISTORY_RANGE[0] <= limit <= HISTORY_RANGE[1]:
        raise ValueError("the history limit must lie from 3 to 20000")


def mad_anomalies(
    df: DataFrame, key: str, ts: str, value: str, threshold: float = 3.5, rows_in_task: int | None = None
) -> DataFrame:
    """Readings whose scaled distance from their meter's median reaches the threshold.

    A meter with no spread reports nothing. Medians are exact for meters of
    any size (see ``group_medians``) and meet the readings through a lookup
    join, so a meter with most of the rows is not sent to one task. The two
    per-meter tables are written once, not computed again by the joins.
    """
    check_settings(threshold)
    known = df.where(F.col(value).isNotNull())
    medians = group_medians(known, [key], [value], rows_in_task)
    centers = materialize(medians.select(key, F.col(value).cast("double").alias("expected_kwh")), "centers")
    centered = lookup_join(known, centers, [key]).withColumn("_gap", F.abs(F.col(value) - F.col("expected_kwh")))
    spreads = group_medians(centered, [key], ["_gap"], rows_in_task)
    scales = materialize(spreads.select(key, (F.col("_gap") * MAD_SCALE).alias("_scale")).where("_scale > 0"), "scales")
    scored = lookup_join(centered, scales, [key], "inner").withColumn("score", F.col("_gap") / F.col("_scale"))
    center, actual = F.col("expected_kwh"), F.col(value)
    deviation = F.when(center == 0, 0.0).otherwise((actual - center) / F.abs(F.nullif(center, F.lit(0.0))) * 100)
    return scored.where(F.col("score") >= threshold).select(
        key,
        ts,
        F.when(actual > center, "spike").otherwise("drop").alias("anomaly_type"),
        F.when(F.col("score") >= threshold * 1.5, "high").otherwise("medium").alias("severity"),
        actual.cast("double").alias("actual_kwh"),
        "expected_kwh",
        deviation.alias("deviation_pct"),
        "score",
        F.concat(F.lit("Robust deviation score: "), F.format_string("%.2f", "score"), F.lit(".")).alias("description"),
    )


def detect_and_store(
    history: DataFrame, stored: DataFrame, key: str, ts: str, value: str, threshold: float = 3.5
) -> tuple[DataFrame, DataFrame]:
    """(stored rows after the run, counts of records examined, detected and added)."""
    found = materialize(mad_anomalies(history, key, ts, value, threshold).drop("score"), "found")
    after = insert_if_absent(stored, found, [key, ts], [F.col("actual_kwh")])
    examined = history.agg(F.count(F.lit(1)).alias("n")).select(F.lit("examined").alias("measure"), "n")
    detected = found.agg(F.count(F.lit(1)).alias("n")).select(F.lit("detected").alias("measure"), "n")
    fresh = has_key(found.select(key, ts).distinct(), stored, [key, ts], present=False)
    added = fresh.agg(F.count(F.lit(1)).alias("n")).select(F.lit("added").alias("measure"), "n")
    return after, examined.unionByName(detected).unionByName(added)
