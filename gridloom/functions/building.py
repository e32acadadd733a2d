"""Building features: the plain set and the strict set that rejects bad inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.numeric import clip


def age_in_2016(year_built: Column) -> Column:
    return F.bround(clip(2016 - year_built, 0)).cast("short")


def log_area(area: Column) -> Column:
    return F.log1p(area).cast("float")


def area_per_floor(area: Column, floors: Column) -> Column:
    return (area / clip(floors, 1)).cast("float")


def strict_age(ts: Column, year_built: Column) -> Column:
    year = F.year(ts)
    return F.when(year_built.between(F.lit(1800), year), year - year_built).cast("float")


def valid_area(area: Column) -> Column:
    return F.when(area > 0, area)


def strict_log_area(area: Column) -> Column:
    return F.log1p(valid_area(area)).cast("float")


def strict_area_per_floor(area: Column, floors: Column) -> Column:
    return (valid_area(area) / F.when(floors > 0, floors)).cast("float")
