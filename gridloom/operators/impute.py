"""Two imputation policies: bidirectional interpolation and causal carry.

Both work on the site-hour lookup, which has one row per key, not on the
facts. A site's series is cut into calendar months; each task sees one month
of one site, and a small summary per month carries values across the cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.joins import fill_from, first_row
from gridloom.operators.scale import group_medians, lookup_join
from gridloom.session import materialize


def month_of(ts: str) -> Column:
    return F.date_trunc("month", F.col(ts)).cast("timestamp_ntz")


def fit_static(buildings: DataFrame, by: str, columns: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """Medians per building use and over all buildings, before any filling."""
    return group_medians(buildings, [by], columns), group_medians(buildings, [], columns).first().asDict()


def impute_static(buildings: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Fill nulls by the use median, else the global one, rounded half to even."""
    medians, overall = fit_static(buildings, by, columns)
    renamed = medians.select(by, *[F.col(c).alias(f"{c}__use") for c in columns])
    joined = lookup_join(buildings, renamed, [by])
    filled = {
        c: F.coalesce(F.col(c), F.bround(F.coalesce(F.col(f"{c}__use"), F.lit(overall[c])))).alias(c) for c in columns
    }
    return joined.select(*[filled.get(c, F.col(c)) for c in buildings.columns])


def fit_weather(
    weather: DataFrame, site: str, ts: str, columns: Sequence[str], cutoff: str, order: Sequence | None = None
) -> tuple[DataFrame, dict[str, float]]:
    """Site and global medians over the training period's unique site-hours."""
    training = weather.where(F.col(ts) <= F.lit(cutoff).cast("timestamp_ntz"))
    unique = first_row(training, [site, ts], list(order or [F.lit(1)])) if order else training
    overall = group_medians(unique, [], columns).first().asDict()
    if unique.isEmpty():
        raise ValueError("no weather record lies in the training period")
    per_site = group_medians(unique, [site], columns)
    fitted = per_site.select(site, *[F.coalesce(F.col(c), F.lit(overall[c])).alias(c) for c in columns])
    return materialize(fitted, "site-medians"), overall


def _known(rank: Column, c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.struct(rank.alias("r"), F.col(c).cast("double").alias("v")))


def interpolate(spine: DataFrame, site: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """Linear interpolation by row position within a site, ends held constant.

    ``spine`` has one row per (site, ts). A column a site never reports falls
    back to the global median of the interpolated values.
    """
    chunk = "_month"
    cut = spine.withColumn(chunk, month_of(ts))
    ahead = Window.partitionBy(site, chunk).orderBy(ts)
    back = Window.partitionBy(site, chunk).orderBy(F.col(ts).desc())
    ranked = cut.withColumn("_r", F.row_number().over(ahead).cast("long"))
    ranked = ranked.withColumns({f"_k_{c}": _known(F.col("_r"), c) for c in columns})
    marked = ranked.select(
        "*",
        *[F.last(f"_k_{c}", ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_p_{c}") for c in columns],
        *[F.last(f"_k_{c}", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_n_{c}") for c in columns],
    )
    summary = ranked.groupBy(site, chunk).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.min(f"_k_{c}").alias(f"_first_{c}") for c in columns],
        *[F.max(f"_k_{c}").alias(f"_last_{c}") for c in columns],
    )
    months = known_months = materialize(summary, "months")
    seq = Window.partitionBy(site).orderBy(chunk)
    before, after = seq.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(site).orderBy(F.col(chunk).desc()).rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))

    def absolute(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct((F.col(c)["r"] + F.col("_base")).alias("r"), F.col(c)["v"].alias("v")))

    carried = months.select(
        site,
        chunk,
        "_base",
        *[F.last(absolute(f"_last_{c}"), ignorenulls=True).over(before).alias(f"_cp_{c}") for c in columns],
        *[F.last(absolute(f"_first_{c}"), ignorenulls=True).over(after).alias(f"_cn_{c}") for c in columns],
    )
    joined = lookup_join(marked, carried, [site, chunk])
    here = F.col("_r") + F.col("_base")

    def value(c: str) -> Column:
        p = F.coalesce(absolute(f"_p_{c}"), F.col(f"_cp_{c}"))
        n = F.coalesce(absolute(f"_n_{c}"), F.col(f"_cn_{c}"))
        slope = (n["v"] - p["v"]) / (n["r"] - p["r"])
        return (
            F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
            .when(p.isNull(), n["v"])
            .when(n.isNull(), p["v"])
            .otherwise(p["v"] + slope * (here - p["r"]))
        )

    done = joined.select(*[value(c).alias(c) if c in columns else F.col(c) for c in spine.columns])
    silent = known_months.groupBy(site).agg(*[(F.count(f"_first_{c}") == 0).alias(c) for c in columns])
    gaps = silent.agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in columns]).first().asDict()
    missing = [c for c, gap in gaps.items() if gap]
    if not missing:
        return done
    overall = group_medians(done, [], missing).first().asDict()
    return done.select(*[F.coalesce(F.col(c), F.lit(overall[c])).alias(c) if c in missing else F.col(c) for c in done.columns])


def ffill_causal(
    spine: DataFrame,
    site: str,
    ts: str,
    columns: Sequence[str],
    site_medians: DataFrame,
    overall: dict[str, float],
) -> DataFrame:
    """Missing flags, then the site's latest earlier value, else training medians.

    Never looks forward. ``spine`` has one row per (site, ts).
    """
    chunk = "_month"
    cut = spine.withColumn(chunk, month_of(ts))
    past = Window.partitionBy(site, chunk).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.select(
        "*",
        *[F.col(c).isNull().cast("byte").alias(f"{c}_missing") for c in columns],
        *[F.last(c, ignorenulls=True).over(past).alias(f"_p_{c}") for c in columns],
    )
    last_of = {c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_l_{c}") for c in columns}
    months = materialize(cut.groupBy(site, chunk).agg(*last_of.values()), "months")
    before = Window.partitionBy(site).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = months.select(
        site, chunk, *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in columns]
    )
    joined = lookup_join(filled, carried, [site, chunk])
    joined = lookup_join(joined, site_medians.select(site, *[F.col(c).alias(f"_m_{c}") for c in columns]), [site])

    def value(c: str) -> Column:
        return F.coalesce(F.col(f"_p_{c}"), F.col(f"_c_{c}"), F.col(f"_m_{c}"), F.lit(overall[c])).alias(c)

    kept = [value(c) if c in columns else F.col(c) for c in spine.columns]
    return joined.select(*kept, *[f"{c}_missing" for c in columns])


def weather_spine(facts: DataFrame, site: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """Unique site-hours present in the facts with their known values.

    All facts of a site-hour carry the same weather row (``conflicts`` tests
    that), so the maximum is that value and needs no order. Written once: several steps read it, and none should scan the facts again.
    """
    known = facts.where(F.col(site).isNotNull())
    return materialize(known.groupBy(site, ts).agg(*[F.max(c).alias(c) for c in columns]), "spine")


def static_lookup(facts: DataFrame, building: str, use: str, columns: Sequence[str]) -> DataFrame:
    """One row per building with its use and static columns, written once."""
    return materialize(facts.groupBy(building).agg(*[F.max(c).alias(c) for c in [use, *columns]]), "buildings")


def impute_bidirectional(
    facts: DataFrame, building: str, site: str, ts: str, use: str, static: Sequence[str], weather: Sequence[str]
) -> DataFrame:
    """Fill building and weather nulls of the facts from the imputed lookups."""
    fixed = materialize(impute_static(static_lookup(facts, building, use, static), use, static), "static")
    series = materialize(interpolate(weather_spine(facts, site, ts, weather), site, ts, weather), "weather")
    return fill_from(fill_from(facts, fixed, [building], static), series, [site, ts], weather)
