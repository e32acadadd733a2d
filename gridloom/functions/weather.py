"""Weather features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.numeric import clip

# Magnus constants and the balance and hot-day temperatures.
MAGNUS_A = 17.625
MAGNUS_B = 243.04
BALANCE_C = 18
HOT_C = 30


def humidity(temperature: Column, dew: Column) -> Column:
    """Relative humidity in percent from the Magnus formula, held in 0..100."""

    def pressure(t: Column) -> Column:
        return F.lit(MAGNUS_A) * t / (F.lit(MAGNUS_B) + t)

    return clip(100 * F.exp(pressure(dew) - pressure(temperature)), 0, 100)


def direction_parts(direction: Column) -> tuple[Column, Column]:
    angle = F.radians(direction)
    return F.sin(angle).cast("float"), F.cos(angle).cast("float")


def wind_parts(speed: Column, direction: Column) -> tuple[Column, Column]:
    """East-west and north-south components of the wind."""
    angle = F.radians(direction)
    return (speed * F.cos(angle)).cast("float"), (speed * F.sin(angle)).cast("float")


def heating_degrees(temperature: Column) -> Column:
    return clip(BALANCE_C - temperature, 0).cast("float")


def cooling_degrees(temperature: Column) -> Column:
    return clip(temperature - BALANCE_C, 0).cast("float")


def flag(test: Column) -> Column:
    """A test that is false, not null, when its input is missing."""
    return F.coalesce(test, F.lit(False))


def is_freezing(temperature: Column) -> Column:
    return flag(temperature <= 0)


def is_hot(temperature: Column) -> Column:
    return flag(temperature >= HOT_C)


def is_precipitating(depth: Column) -> Column:
    return flag(depth > 0)
