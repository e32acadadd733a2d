"""Number helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole to four places (half to even), 0 for an empty whole."""
    share = part.cast("double") * 100 / F.nullif(whole, F.lit(0)).cast("double")
    return F.coalesce(F.bround(share, 4), F.lit(0.0))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value; null stays null (greatest/least alone would skip it)."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(value.isNotNull(), out)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    number = value.cast("double")
    return ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))


def to_log(value: Column) -> Column:
    return F.log1p(value)


def from_log(value: Column) -> Column:
    """Inverse of ``to_log`` with the exponent held in -20..30."""
    return F.expm1(clip(value, -20, 30))
