"""A feature set described from its own expressions and data.

Nothing is written by hand twice: sources and formula come from the column
expressions that build the set, types and figures from the built table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sources(raw: DataFrame, expression: Column) -> list[str]:
    """Columns of ``raw`` without which the expression can't be resolved; no job runs."""

    def resolves(columns: Sequence[str]) -> bool:
        try:
            raw.select(*columns).select(expression).schema  # noqa: B018
        except AnalysisException:
            return False
        return True

    # failed resolutions are the answer here, not errors to be logged
    log = PySparkLogger.getLogger("DataFrameQueryContextLogger")
    before, log.disabled = log.disabled, True
    try:
        if not resolves([f"`{x}`" for x in raw.columns]):
            raise ValueError("the expression needs columns that the raw table lacks")
        return [c for c in raw.columns if not resolves([f"`{x}`" for x in raw.columns if x != c])]
    finally:
        log.disabled = before


def formula(expression: Column) -> str:
    """The expression as Spark prints it."""
    return str(expression)[len("Column<'") : -len("'>")]


def described(
    features: DataFrame,
    raw: DataFrame,
    expressions: Mapping[str, Column],
    handling: Mapping[str, str],
    target: str,
    not_sent: Sequence[str] = (),
) -> DataFrame:
    """One row per column of ``features``, in their order.

    ``expressions`` build the engineered columns from ``raw``; all others are raw
    columns themselves. ``handling`` says what is done about missing values of a raw
    column (default: none); an engineered column has that of its sources. The
    target and ``not_sent`` are not sent to a model, nor is a column that reads the
    target. Minimum, maximum and missing rows come from one pass over the table;
    an empty table has no minimum and 0 missing rows. NaN counts as missing.
    """
    rows = []
    for place, f in enumerate(features.schema):
        own = f.name not in expressions
        read = [f.name] if own else sources(raw, expressions[f.name])
        ways = list(dict.fromkeys(handling.get(c, "none") for c in read))
        sent = target not in read and f.name not in not_sent
        rows.append((place, f.name, "raw" if own else "engineered", ",".join(sorted(read)), f.name if own else formula(expressions[f.name]),
                     f.dataType.simpleString(), "; ".join(ways), sent, target in read and f.name != target))
    schema = "place int, feature string, origin string, sources string, formula string, data_type string, missing_handling string, sent_to_model boolean, reads_target boolean"
    figures = []
    for f in features.schema:
        number = isinstance(f.dataType, (T.NumericType, T.BooleanType))
        value = F.col(f.name).cast("double") if number else F.lit(None).cast("double")
        known = F.when(~F.isnan(value), value)
        unknown = known.isNull() if number else F.col(f.name).isNull()
        figures.append(F.struct(F.min(known).alias("minimum"), F.max(known).alias("maximum"), F.count_if(unknown).alias("missing")))
    found = features.agg(F.array(*figures).alias("found")).select(F.posexplode("found").alias("place", "f"))
    # one row per column of the set on both sides
    table = features.sparkSession.createDataFrame(rows, schema).join(found, "place")
    return table.orderBy("place").select("feature", "origin", "sources", "formula", "data_type", "f.minimum", "f.maximum", "f.missing", "missing_handling", "sent_to_model", "reads_target")
