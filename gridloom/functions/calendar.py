"""Calendar and cyclical features of a timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def calendar(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts).cast("short"),
        "quarter": F.quarter(ts).cast("byte"),
        "month": F.month(ts).cast("byte"),
        "week_of_year": F.weekofyear(ts).cast("byte"),
        "day": F.dayofmonth(ts).cast("byte"),
        "day_of_year": F.dayofyear(ts).cast("short"),
        "weekday": weekday(ts).cast("byte"),
        "hour": F.hour(ts).cast("byte"),
        "is_weekend": (weekday(ts) >= 5).cast("byte"),
    }


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .otherwise("autumn")
    )


def cycle(position: Column, length: int) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle, computed in double, kept as float."""
    angle = position.cast("double") * 2 * F.pi() / length
    return F.sin(angle).cast("float"), F.cos(angle).cast("float")


def cyclical(ts: Column, weekday_name: str = "weekday") -> dict[str, Column]:
    hour_sin, hour_cos = cycle(F.hour(ts), 24)
    day_sin, day_cos = cycle(weekday(ts), 7)
    month_sin, month_cos = cycle(F.month(ts) - 1, 12)
    return {
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        f"{weekday_name}_sin": day_sin,
        f"{weekday_name}_cos": day_cos,
        "month_sin": month_sin,
        "month_cos": month_cos,
    }
