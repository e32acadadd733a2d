"""Imputation, feature, window and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import building as bf
from gridloom.functions import text as tx
from gridloom.functions import weather as wf
from gridloom.functions.calendar import calendar, cyclical, season
from gridloom.functions.numeric import from_log, pct, to_log
from gridloom.operators import dictionary as dc
from gridloom.operators import features as ft
from gridloom.operators import impute as im
from gridloom.operators import profile as pf
from gridloom.operators import quality as qa
from gridloom.operators import sampling as sm
from gridloom.operators import scale
from gridloom.plans import bindings as b
from gridloom.plans.registry import query
from gridloom.session import materialize

W = b.WEATHER


def floats(df, digits=4):
    """Float and double columns as rounded doubles, for comparison."""
    kinds = dict(df.dtypes)
    return df.select(
        *[F.round(F.col(c).cast("double"), digits).alias(c) if kinds[c] in ("float", "double") else F.col(c) for c in df.columns]
    )


def r4(e, name=None):
    return f"round(CAST(CAST({e} AS FLOAT) AS DOUBLE), 4)" + (f" AS {name}" if name else "")


def fit_electric_weather(spark, sf):
    facts = b.electric(spark, sf)
    spine = im.weather_spine(facts, "site_id", "ts_hour", W)
    site, overall = im.fit_weather(spine, "site_id", "ts_hour", W, b.TRAIN_END)
    return facts, spine, site, overall


def treated(spark, sf):
    facts, spine, site, overall = fit_electric_weather(spark, sf)
    return ft.treat_weather(facts, spine, "site_id", "ts_hour", site, overall)


@query(
    "static_medians",
    "SELECT building_id, primary_use, year_built, floor_count FROM static_filled",
)
def static_medians(spark, sf):
    lookup = im.static_lookup(b.enriched(spark, sf), "building_id", "primary_use", b.STATIC)
    return im.impute_static(lookup, "primary_use", b.STATIC)


@query(
    "train_weather_medians",
    "SELECT site_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in W) + " FROM e_site",
)
def train_weather_medians(spark, sf):
    return floats(fit_electric_weather(spark, sf)[2], 6)


@query(
    "interpolate_linear",
    "SELECT site_id, ts_hour, " + ", ".join(f"round({c}, 6) AS {c}" for c in W) + " FROM interpolated",
)
def interpolate_linear(spark, sf):
    spine = im.weather_spine(b.enriched(spark, sf), "site_id", "ts_hour", W)
    return floats(im.interpolate(spine, "site_id", "ts_hour", W), 6)


@query(
    "ffill_causal",
    "SELECT site_id, ts_hour, " + ", ".join(f"round({c}, 6) AS {c}, {c}_missing" for c in W) + " FROM e_filled",
)
def ffill_causal(spark, sf):
    _, spine, site, overall = fit_electric_weather(spark, sf)
    return floats(im.ffill_causal(spine, "site_id", "ts_hour", W, site, overall), 6)


@query(
    "fill_from_lookup",
    "SELECT event_id, year_built, floor_count, " + ", ".join(f"round({c}, 6) AS {c}" for c in W) + " FROM clean",
)
def fill_from_lookup(spark, sf):
    return floats(b.clean(spark, sf).select("event_id", *b.STATIC, *W), 6)


@query(
    "columns_unchanged",
    """SELECT 'feature building' AS step, CAST(0 AS BIGINT) AS differing_rows
    UNION ALL SELECT 'a changed reading', CAST(2 * count(meter_reading) AS BIGINT) FROM readings WHERE event_id % 7 = 0""",
)
def columns_unchanged(spark, sf):
    """Rows that differ on any of the 16 carried columns: none after feature building, two per reading changed on purpose."""
    before = materialize(b.clean(spark, sf).select("event_id", *b.MERGED), "carried")
    after = ft.features_v1(before, keep=["event_id"])
    reading = F.col("meter_reading") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    steps = {"feature building": after, "a changed reading": after.withColumn("meter_reading", reading)}
    counts = [
        qa.unchanged(before, df, ["event_id", *b.MERGED]).agg(F.lit(n).alias("step"), F.count(F.lit(1)).alias("differing_rows"))
        for n, df in steps.items()
    ]
    return counts[0].unionByName(counts[1])


_CAL = """CAST(year({t}) AS INTEGER) AS year, quarter({t}) AS quarter, month({t}) AS month, weekofyear({t}) AS week_of_year,
  day({t}) AS day, dayofyear({t}) AS day_of_year, isodow({t}) - 1 AS weekday, hour({t}) AS hour,
  CAST(isodow({t}) >= 6 AS INTEGER) AS is_weekend"""
_SEASON = """CASE WHEN month({t}) IN (12, 1, 2) THEN 'winter' WHEN month({t}) IN (3, 4, 5) THEN 'spring'
  WHEN month({t}) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"""


def _cyc(t, day):
    return ", ".join(
        [
            r4(f"sin(hour({t}) * 2 * pi() / 24)", "hour_sin"),
            r4(f"cos(hour({t}) * 2 * pi() / 24)", "hour_cos"),
            r4(f"sin((isodow({t}) - 1) * 2 * pi() / 7)", f"{day}_sin"),
            r4(f"cos((isodow({t}) - 1) * 2 * pi() / 7)", f"{day}_cos"),
            r4(f"sin((month({t}) - 1) * 2 * pi() / 12)", "month_sin"),
            r4(f"cos((month({t}) - 1) * 2 * pi() / 12)", "month_cos"),
        ]
    )


@query("calendar_features", f"SELECT o_orderkey, {_CAL.format(t='o_orderdate')} FROM orders")
def calendar_features(spark, sf):
    cols = calendar(F.col("o_orderdate"))
    return b.table(spark, sf, "orders").select("o_orderkey", *[e.alias(n) for n, e in cols.items()])


@query("season", f"SELECT o_orderkey, {_SEASON.format(t='o_orderdate')} AS season FROM orders")
def season_query(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", season(F.month("o_orderdate")).alias("season"))


@query("cyclical_features", f"SELECT event_id, {_cyc('ts', 'weekday')} FROM events")
def cyclical_features(spark, sf):
    cols = cyclical(F.col("ts"))
    return floats(b.table(spark, sf, "events").select("event_id", *[e.alias(n) for n, e in cols.items()]))


_AGE = "CAST(round_even(greatest(2016 - year_built, 0), 0) AS INTEGER)"
_AGE_N = f"CASE WHEN year_built IS NOT NULL THEN {_AGE} END"
_FLOOR = "CASE WHEN floor_count IS NOT NULL THEN square_feet / greatest(floor_count, 1) END"


@query(
    "building_features_v1",
    f"""SELECT building_id, {_AGE_N} AS building_age_2016, {r4('ln(1 + square_feet)', 'log_square_feet')},
    {r4(_FLOOR, 'square_feet_per_floor')} FROM buildings""",
)
def building_features_v1(spark, sf):
    return floats(
        b.buildings(spark, sf).select(
            "building_id",
            bf.age_in_2016(F.col("year_built")).alias("building_age_2016"),
            bf.log_area(F.col("square_feet")).alias("log_square_feet"),
            bf.area_per_floor(F.col("square_feet"), F.col("floor_count")).alias("square_feet_per_floor"),
        )
    )


_STRICT = {
    "building_age": "CASE WHEN year_built BETWEEN 1800 AND year({t}) THEN year({t}) - year_built END",
    "log_square_feet": "CASE WHEN square_feet > 0 THEN ln(1 + square_feet) END",
    "area_per_floor": "CASE WHEN square_feet > 0 AND floor_count > 0 THEN square_feet / floor_count END",
}


@query(
    "building_features_strict",
    "SELECT event_id, " + ", ".join(r4(e.format(t="timestamp"), n) for n, e in _STRICT.items()) + " FROM enriched",
)
def building_features_strict(spark, sf):
    return floats(
        b.enriched(spark, sf).select(
            "event_id",
            bf.strict_age(F.col("timestamp"), F.col("year_built")).alias("building_age"),
            bf.strict_log_area(F.col("square_feet")).alias("log_square_feet"),
            bf.strict_area_per_floor(F.col("square_feet"), F.col("floor_count")).alias("area_per_floor"),
        )
    )


_HUM = """CASE WHEN air_temperature IS NOT NULL AND dew_temperature IS NOT NULL THEN least(greatest(100 * exp(17.625 * dew_temperature
  / (243.04 + dew_temperature) - 17.625 * air_temperature / (243.04 + air_temperature)), 0), 100) END"""


@query("humidity_magnus", f"SELECT site_id, ts_hour, {r4(_HUM, 'humidity')} FROM weather")
def humidity_magnus(spark, sf):
    e = wf.humidity(F.col("air_temperature"), F.col("dew_temperature")).cast("float")
    return floats(b.weather(spark, sf).select("site_id", "ts_hour", e.alias("humidity")))


@query(
    "wind_features",
    f"""SELECT site_id, ts_hour, {r4('sin(radians(wind_direction))', 'direction_sin')},
    {r4('cos(radians(wind_direction))', 'direction_cos')}, {r4('wind_speed * cos(radians(wind_direction))', 'wind_x')},
    {r4('wind_speed * sin(radians(wind_direction))', 'wind_y')} FROM weather""",
)
def wind_features(spark, sf):
    sin, cos = wf.direction_parts(F.col("wind_direction"))
    x, y = wf.wind_parts(F.col("wind_speed"), F.col("wind_direction"))
    return floats(
        b.weather(spark, sf).select(
            "site_id", "ts_hour", sin.alias("direction_sin"), cos.alias("direction_cos"), x.alias("wind_x"), y.alias("wind_y")
        )
    )


_HEAT = "CASE WHEN air_temperature IS NOT NULL THEN greatest(18 - air_temperature, 0) END"
_COOL = "CASE WHEN air_temperature IS NOT NULL THEN greatest(air_temperature - 18, 0) END"


@query(
    "degree_features",
    f"""SELECT site_id, ts_hour, {r4(_HEAT, 'heating')}, {r4(_COOL, 'cooling')},
    coalesce(air_temperature <= 0, false) AS is_freezing, coalesce(air_temperature >= 30, false) AS is_hot,
    coalesce(precip_depth_1_hr > 0, false) AS is_precipitating,
    {r4('air_temperature - dew_temperature', 'temperature_difference')} FROM weather""",
)
def degree_features(spark, sf):
    t = F.col("air_temperature")
    return floats(
        b.weather(spark, sf).select(
            "site_id",
            "ts_hour",
            wf.heating_degrees(t).alias("heating"),
            wf.cooling_degrees(t).alias("cooling"),
            wf.is_freezing(t).alias("is_freezing"),
            wf.is_hot(t).alias("is_hot"),
            wf.is_precipitating(F.col("precip_depth_1_hr")).alias("is_precipitating"),
            (t - F.col("dew_temperature")).cast("float").alias("temperature_difference"),
        )
    )


_LOG = "CAST(ln(1 + square_feet) AS FLOAT)"
_INTER = {
    "log_square_feet_x_air_temperature": f"CAST({_LOG} AS DOUBLE) * air_temperature",
    "building_age_x_air_temperature": f"CAST({_AGE_N} AS DOUBLE) * air_temperature",
    "heating_degree_x_log_square_feet": f"CAST({_HEAT} AS FLOAT) * {_LOG}",
    "cooling_degree_x_log_square_feet": f"CAST({_COOL} AS FLOAT) * {_LOG}",
}


@query(
    "interaction_features",
    "SELECT event_id, "
    + ", ".join(r4(e, n) for n, e in _INTER.items())
    + ", "
    + r4("air_temperature * CASE WHEN square_feet > 0 THEN square_feet END", "temperature_x_square_feet")
    + ", "
    + r4("hour(timestamp) * air_temperature", "hour_x_temperature")
    + " FROM enriched",
)
def interaction_features(spark, sf):
    v1, el = ft.features_v1_columns(), ft.electricity_columns()
    df = b.enriched(spark, sf).select(
        "event_id",
        *[v1[n].alias(n) for n in _INTER],
        *[el[n].alias(n) for n in ("temperature_x_square_feet", "hour_x_temperature")],
    )
    return floats(df)


@query(
    "missing_indicators",
    "SELECT site_id, ts_hour, " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in W) + " FROM weather",
)
def missing_indicators(spark, sf):
    return ft.missing_flags(b.weather(spark, sf), W).select("site_id", "ts_hour", *[f"{c}_missing" for c in W])


_V1 = f"""hour(timestamp) AS hour, isodow(timestamp) - 1 AS day_of_week, day(timestamp) AS day_of_month,
  dayofyear(timestamp) AS day_of_year, weekofyear(timestamp) AS week_of_year, month(timestamp) AS month,
  quarter(timestamp) AS quarter, isodow(timestamp) >= 6 AS is_weekend, {_cyc('timestamp', 'day_of_week')},
  {_AGE_N} AS building_age_2016, {r4('ln(1 + square_feet)', 'log_square_feet')}, {r4(_FLOOR, 'square_feet_per_floor')},
  {r4('air_temperature - dew_temperature', 'temperature_difference')}, {r4(_HUM, 'relative_humidity')},
  {r4('sin(radians(wind_direction))', 'wind_direction_sin')}, {r4('cos(radians(wind_direction))', 'wind_direction_cos')},
  coalesce(precip_depth_1_hr > 0, false) AS is_precipitating, coalesce(air_temperature <= 0, false) AS is_freezing,
  coalesce(air_temperature >= 30, false) AS is_hot, {r4(_HEAT, 'heating_degree_proxy')}, {r4(_COOL, 'cooling_degree_proxy')}"""


_V1_SQL = (
    "SELECT event_id, "
    + ", ".join(f"round({c}, 4) AS {c}" if c in W else c for c in b.MERGED)
    + f", {_V1}, "
    + ", ".join(r4(e, n) for n, e in _INTER.items())
    + " FROM clean"
)


@query("features_v1", _V1_SQL)
def features_v1(spark, sf):
    return floats(ft.features_v1(b.clean(spark, sf), keep=["event_id"]))


@query("drop_forbidden_predictors", f"SELECT * EXCLUDE ({', '.join(ft.FORBIDDEN_PREDICTORS)}) FROM ({_V1_SQL})")
def drop_forbidden_predictors(spark, sf):
    """The first feature set without identifiers, time, meter and target."""
    features = ft.features_v1(b.clean(spark, sf), keep=["event_id"])
    return floats(features.select(*ft.assert_predictors(ft.predictors(features))))


_EL = f"""{_CAL.format(t='timestamp')}, {_SEASON.format(t='timestamp')} AS season, {_cyc('timestamp', 'weekday')},
  {', '.join(r4(e.format(t='timestamp'), n) for n, e in _STRICT.items())},
  {r4('air_temperature - dew_temperature', 'temperature_difference')}, {r4(_HUM, 'relative_humidity_proxy')},
  {r4('wind_speed * cos(radians(wind_direction))', 'wind_x')}, {r4('wind_speed * sin(radians(wind_direction))', 'wind_y')},
  {r4('air_temperature * CASE WHEN square_feet > 0 THEN square_feet END', 'temperature_x_square_feet')},
  {r4('hour(timestamp) * air_temperature', 'hour_x_temperature')}, {r4(_COOL, 'cooling_demand_proxy')},
  {r4(_HEAT, 'heating_demand_proxy')}"""


@query(
    "features_electricity",
    "SELECT event_id, " + ", ".join(c for c in ft.ELECTRICITY_RAW) + ", " + ", ".join(f"{c}_missing" for c in W) + f", {_EL} FROM treated",
)
def features_electricity(spark, sf):
    return floats(ft.electricity_features(treated(spark, sf), keep=["event_id"]))


def _ranges_sql(more=lambda n: ""):
    """Range of every engineered column over the feature rows ``f``."""

    def number(n):
        return f"CAST({n} AS INTEGER)" if n.startswith("is_") else n

    return f"WITH f AS MATERIALIZED ({_V1_SQL}) " + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, CAST(min({number(n)}) AS DOUBLE) AS minimum, CAST(max({number(n)}) AS DOUBLE) AS maximum{more(n)} FROM f"
        for n in ft.V1_FEATURES
    )


@query("feature_ranges", _ranges_sql())
def feature_ranges(spark, sf):
    return floats(pf.feature_ranges(ft.features_v1(b.clean(spark, sf)), ft.V1_FEATURES))


_WHOLE = dict.fromkeys(["hour", "day_of_week", "day_of_month", "week_of_year", "month", "quarter"], "tinyint")
_WHOLE |= {"day_of_year": "smallint", "building_age_2016": "smallint"}


def _described(n):
    flag = n.startswith("is_")
    kind = "boolean" if flag else _WHOLE.get(n, "float")
    return f", '{kind}' AS data_type, '{'flag' if flag else 'number'}' AS kind, CAST(count(*) FILTER (WHERE {n} IS NULL) AS BIGINT) AS missing"


@query("feature_dictionary", _ranges_sql(_described))
def feature_dictionary(spark, sf):
    return floats(ft.feature_dictionary(materialize(ft.features_v1(b.clean(spark, sf)), "features")))


_CARRIED = "flag, earlier value of the site, training medians"
_T, _D, _U, _Y = "timestamp", "dew_temperature", "square_feet", "year_built"
_A = "air_temperature"
# What each engineered column of the electricity set reads, stated apart from its expressions.
_READS = {
    **dict.fromkeys(["year", "quarter", "month", "week_of_year", "day", "day_of_year", "weekday", "hour", "is_weekend", "season"], _T),
    **dict.fromkeys([f"{c}_{f}" for c in ("hour", "weekday", "month") for f in ("sin", "cos")], _T),
    "building_age": f"{_T},{_Y}",
    "log_square_feet": _U,
    "area_per_floor": f"floor_count,{_U}",
    "temperature_difference": f"{_A},{_D}",
    "relative_humidity_proxy": f"{_A},{_D}",
    "wind_x": "wind_direction,wind_speed",
    "wind_y": "wind_direction,wind_speed",
    "temperature_x_square_feet": f"{_A},{_U}",
    "hour_x_temperature": f"{_A},{_T}",
    "cooling_demand_proxy": _A,
    "heating_demand_proxy": _A,
}


def _dictionary_sql():
    flags = [f"{c}_missing" for c in W]
    kept = [c for c in ft.ELECTRICITY_RAW]
    rows = []
    for n in [*kept, *flags, *_READS]:
        read = _READS.get(n, n.removesuffix("_missing")).split(",")
        ways = [("required" if c in ("timestamp", "meter_reading") else _CARRIED if c in W else "kept") for c in sorted(read, key=kept.index)]
        sent = n not in ("building_id", "site_id", "timestamp", "meter_reading")
        rows.append(
            f"""SELECT '{n}' AS feature, '{'raw' if n in kept else 'engineered'}' AS origin, '{','.join(sorted(read))}' AS sources,
            '{'; '.join(dict.fromkeys(ways))}' AS missing_handling, {str(sent).lower()} AS sent_to_model, false AS reads_target,
            CAST(count(*) FILTER (WHERE {n} IS NULL) AS BIGINT) AS missing FROM f"""
        )
    body = "SELECT event_id, " + ", ".join(ft.ELECTRICITY_RAW) + ", " + ", ".join(flags) + f", {_EL} FROM treated"
    return f"WITH f AS MATERIALIZED ({body}) " + " UNION ALL ".join(rows)


@query("electricity_dictionary", _dictionary_sql())
def electricity_dictionary(spark, sf):
    """Origin, sources, missing values and use of all columns of the electricity set; formula and range are the operator's."""
    rows = treated(spark, sf)
    features = materialize(ft.electricity_features(rows), "electricity")
    expressions = ft.electricity_columns() | {f"{c}_missing": F.col(c).isNull().cast("byte") for c in W}
    handling = dict.fromkeys(["timestamp", "meter_reading"], "required") | dict.fromkeys(W, _CARRIED)
    handling |= {c: "kept" for c in ft.ELECTRICITY_RAW if c not in handling}
    table = dc.described(features, rows.select(*ft.ELECTRICITY_RAW), expressions, handling, "meter_reading", ft.FORBIDDEN_PREDICTORS)
    return table.select("feature", "origin", "sources", "missing_handling", "sent_to_model", "reads_target", "missing")


@query(
    "leakage_check",
    """SELECT 'first feature set' AS features, CAST(0 AS BIGINT) AS differing_rows
    UNION ALL SELECT 'with a column of the target', CAST(2 * count(*) FILTER (WHERE (meter_reading > 10) <> (meter_reading * -3 + 17 > 10)) AS BIGINT)
    FROM readings""",
)
def leakage_check(spark, sf):
    """Feature rows that follow the target: none of the first set, and those a leaking column changes."""
    rows = materialize(b.clean(spark, sf), "clean")

    def plain(df):
        return ft.features_v1(df, keep=["event_id"])

    def leaking(df):
        return plain(df).withColumn("leak", F.col("meter_reading") > 10)

    counts = [
        qa.leakage_check(rows, build, "meter_reading").agg(F.lit(n).alias("features"), F.count(F.lit(1)).alias("differing_rows"))
        for n, build in {"first feature set": plain, "with a column of the target": leaking}.items()
    ]
    return counts[0].unionByName(counts[1])


@query(
    "log_target",
    """SELECT o_orderkey, round(ln(1 + y), 6) AS log_y, round(greatest(exp(least(greatest(p / 100000, -20), 30)) - 1, 0), 4) AS back,
    p < 0 AS negative FROM scored""",
)
def log_target(spark, sf):
    df = b.scored(spark, sf)
    back = F.greatest(from_log(F.col("p") / 100000), F.lit(0.0))
    return df.select(
        "o_orderkey", F.round(to_log(F.col("y")), 6).alias("log_y"), F.round(back, 4).alias("back"), (F.col("p") < 0).alias("negative")
    )


@query(
    "string_normalize",
    """SELECT c_custkey, lower(trim('  ' || c_name || '@Example.COM ')) AS email,
    nullif(trim(CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_name END), '') AS username,
    split_part(lower(trim('  ' || c_name || '@Example.COM ')), '@', 1) AS local_part,
    trim(' ' || c_mktsegment || ' ') AS category FROM customer""",
)
def string_normalize(spark, sf):
    email = tx.normalize_email(F.concat(F.lit("  "), F.col("c_name"), F.lit("@Example.COM ")))
    return b.table(spark, sf, "customer").select(
        "c_custkey",
        email.alias("email"),
        tx.blank_to_null(F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.col("c_name"))).alias("username"),
        tx.local_part(email).alias("local_part"),
        F.trim(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("category"),
    )


_MAIL = "CASE c_custkey % 4 WHEN 0 THEN c_name || '@a.b' WHEN 1 THEN c_name || '@ab' WHEN 2 THEN 'x@' || c_name || '.z and more' ELSE c_name END"


@query("email_pattern", rf"SELECT c_custkey, regexp_matches({_MAIL}, '^[^@]+@[^@]+\.[^@]+') AS email_like FROM customer")
def email_pattern(spark, sf):
    n, k = F.col("c_name"), F.col("c_custkey") % 4
    text = (
        F.when(k == 0, F.concat(n, F.lit("@a.b")))
        .when(k == 1, F.concat(n, F.lit("@ab")))
        .when(k == 2, F.concat(F.lit("x@"), n, F.lit(".z and more")))
        .otherwise(n)
    )
    return b.table(spark, sf, "customer").select("c_custkey", tx.email_like(text).alias("email_like"))


@query(
    "redact_url_secret",
    r"SELECT page_id, regexp_replace(url, '([?&;])(page)=[^&;#\s]*', '\1\2=[REDACTED]', 'gi') AS url FROM pages",
)
def redact_url_secret(spark, sf):
    return b.table(spark, sf, "pages", "page_id", "url").select("page_id", tx.redact_parameter(F.col("url"), "page").alias("url"))


@query(
    "meter_label",
    """SELECT event_id, CASE meter WHEN 0 THEN 'Electricity' WHEN 1 THEN 'Chilled water' WHEN 2 THEN 'Steam'
    WHEN 3 THEN 'Hot water' END AS label FROM readings""",
)
def meter_label(spark, sf):
    return b.readings(spark, sf).select("event_id", tx.meter_label(F.col("meter")).alias("label"))


@query(
    "percent_of",
    """SELECT o_custkey, coalesce(round_even(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') /
    nullif(count(*) FILTER (WHERE o_orderpriority <> '5-LOW'), 0), 4), 0) AS share FROM orders GROUP BY 1""",
)
def percent_of(spark, sf):
    done, some = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderpriority") != "5-LOW")
    return b.table(spark, sf, "orders").groupBy("o_custkey").agg(pct(done, some).alias("share"))


@query(
    "row_position",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders",
)
def row_position(spark, sf):
    df = b.table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    return scale.with_position(df, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "position")


@query(
    "target_decile",
    """SELECT o_orderkey, CAST(greatest(0, ceil((r - 1) * 10.0 / (n - 1)) - 1) AS INTEGER) AS decile FROM (
    SELECT o_orderkey, row_number() OVER (ORDER BY y, o_orderkey) AS r, count(*) OVER () AS n FROM scored)""",
)
def target_decile(spark, sf):
    return sm.decile(b.scored(spark, sf).select("o_orderkey", "y"), "y", ["o_orderkey"]).select("o_orderkey", "decile")


@query(
    "systematic_sample",
    """SELECT o_orderkey, y FROM (SELECT o_orderkey, y, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
    greatest(1, CAST(ceil(count(*) OVER () / 700.0) AS BIGINT)) AS stride FROM scored) WHERE pos % stride = 0 AND pos < stride * 700""",
)
def systematic_sample(spark, sf):
    df = b.scored(spark, sf).select("o_orderkey", "o_orderdate", "y")
    return sm.systematic_sample(df, 700, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "y")


@query(
    "even_subset",
    """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM scored),
    k AS (SELECT unnest(range(500)) AS k)
    SELECT o_orderkey FROM p WHERE n <= 500 OR pos IN (SELECT k * ((SELECT max(n) FROM p) - 1) // 499 FROM k)""",
)
def even_subset(spark, sf):
    df = b.scored(spark, sf).select("o_orderkey", "o_orderdate")
    return sm.even_subset(df, 500, ["o_orderdate", "o_orderkey"]).select("o_orderkey")
