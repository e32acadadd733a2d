"""Request, payload and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import metrics as mt
from gridloom.operators import models as ml
from gridloom.operators import validation as vd
from gridloom.plans import bindings as b
from gridloom.plans import q_models as qm
from gridloom.plans.q_features import floats
from gridloom.plans.registry import query
from gridloom.sources.weather_payload import normalize_weather


def requests(spark, sf):
    """Requests made from the enriched readings; some break a rule, by event id."""
    e = F.col("event_id")
    df = b.enriched(spark, sf)
    fields = {
        "building_id": F.when(e % 23 == 0, -F.col("building_id") - 1).otherwise(F.col("building_id")).cast("double"),
        "meter": F.col("meter").cast("double"),
        "site_id": F.col("site_id").cast("double"),
        "square_feet": F.when(e % 29 == 0, -1.0).otherwise(F.col("square_feet").cast("double")),
        "year_built": F.when(e % 31 == 0, 1700.0).otherwise(F.coalesce("year_built", F.lit(1990.0))),
        "floor_count": F.when(e % 37 == 0, 0.0).otherwise(F.coalesce("floor_count", F.lit(1.0))),
        **{c: F.coalesce(c, F.lit(5.0)) for c in b.WEATHER if c != "wind_direction"},
        "wind_direction": F.when(e % 41 == 0, 361.0).otherwise(F.coalesce("wind_direction", F.lit(0.0))),
        "primary_use": F.when(e % 43 == 0, "  ").when(e % 47 == 0, "Casino").otherwise(F.coalesce("primary_use", F.lit("Other"))),
        "timestamp": F.concat(
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.when(e % 53 == 0, "Z").otherwise("")
        ),
        "meter_reading": F.when(e % 59 == 0, 1.0),
        "note": F.when(e % 61 == 0, "x"),
    }
    return df.select("event_id", F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()])).alias("body"))


_E = "event_id"
_REQ = {
    "missing:site_id": "site_id IS NULL",
    "missing:square_feet": f"square_feet IS NULL AND {_E} % 29 <> 0",
    "target_supplied": f"{_E} % 59 = 0",
    "unexpected_field": f"{_E} % 61 = 0",
    "negative:building_id": f"{_E} % 23 = 0",
    "meter_code": "meter = 4",
    "negative:square_feet": f"{_E} % 29 = 0",
    "year_built_range": f"{_E} % 31 = 0 OR coalesce(year_built, 1990) > 2016",
    "floor_count_range": f"{_E} % 37 = 0",
    "wind_direction_range": f"{_E} % 41 = 0",
    "primary_use_blank": f"{_E} % 43 = 0",
    "timestamp_zone": f"{_E} % 53 = 0",
}
_REQ_SQL = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _REQ.items())


@query(
    "validate_requests",
    f"SELECT event_id, array_to_string(list_sort(list_filter([{_REQ_SQL}], lambda x: x IS NOT NULL)), ',') AS errors FROM enriched",
)
def validate_requests(spark, sf):
    checked = vd.validate_requests(requests(spark, sf), "body")
    return checked.select("event_id", F.array_join(F.array_sort("errors"), ",").alias("errors"))


@query(
    "input_drift_warnings",
    f"""WITH p AS ({qm._PROFILE_SQL.replace("array_to_string(list_sort(list(DISTINCT primary_use) FILTER (WHERE primary_use IS NOT NULL)), ',')",
                                         "list(DISTINCT primary_use)")})
    SELECT event_id, array_to_string(list_filter([CASE WHEN NOT list_contains(categories, primary_use) THEN 'unknown_primary_use' END,
    CASE WHEN building_id < building_min OR building_id > building_max THEN 'unseen_building_id' END,
    CASE WHEN site_id < site_min OR site_id > site_max THEN 'unseen_site_id' END,
    CASE WHEN timestamp < timestamp_min OR timestamp > timestamp_max THEN 'outside_training_period' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM (SELECT event_id, building_id * CASE WHEN event_id % 19 = 0 THEN 1000000 ELSE 1 END AS building_id, site_id + event_id % 3 AS site_id,
    CASE WHEN event_id % 47 = 0 THEN 'Casino' ELSE primary_use END AS primary_use, timestamp FROM enriched) e LEFT JOIN p ON true""",
)
def input_drift_warnings(spark, sf):
    profile = mt.training_profile(qm.training_rows(spark, sf), "building_id", "site_id", "timestamp", "primary_use").first().asDict()
    e = F.col("event_id")
    df = b.enriched(spark, sf).select(
        "event_id",
        (F.col("building_id") * F.when(e % 19 == 0, 1000000).otherwise(1)).alias("building_id"),
        (F.col("site_id") + e % 3).alias("site_id"),
        F.when(e % 47 == 0, "Casino").otherwise(F.col("primary_use")).alias("primary_use"),
        "timestamp",
    )
    return vd.warn_inputs(df, profile).select("event_id", F.array_join("warnings", ",").alias("warnings"))


_ORDERED = ["square_feet", "air_temperature", "dew_temperature", "wind_speed", "primary_use"]


@query(
    "validate_feature_rows",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN meter <> 0 THEN 'meter_code' END,
    CASE WHEN event_id % 17 = 0 THEN 'input_timestamp' END,
    CASE WHEN event_id % 19 = 0 THEN 'feature_set' END,
    CASE WHEN event_id % 19 <> 0 AND event_id % 13 = 0 THEN 'feature_order' END,
    CASE WHEN event_id % 23 = 0 THEN 'not_numeric:air_temperature' END,
    CASE WHEN event_id % 29 = 0 OR primary_use IS NULL THEN 'category:primary_use' END], lambda x: x IS NOT NULL), ',') AS errors,
    CASE WHEN event_id % 29 = 0 OR primary_use = 'MACHINERY' THEN 'unknown:primary_use' ELSE '' END AS warnings FROM enriched""",
)
def validate_feature_rows(spark, sf):
    """Feature requests as text, because field order, kinds and absence are what is checked."""
    e = F.col("event_id")

    def number(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("null"))

    temp = F.when(e % 23 == 0, "true").otherwise(number("air_temperature"))
    use = F.when(e % 29 == 0, '" "').otherwise(F.coalesce(F.concat(F.lit('"'), "primary_use", F.lit('"')), F.lit("null")))
    area = F.concat(F.lit('"square_feet":'), number("square_feet"))
    air = F.concat(F.lit('"air_temperature":'), temp)
    first = F.when(e % 13 == 0, F.concat(air, F.lit(","), area)).otherwise(F.concat(area, F.lit(","), air))
    extra = F.when(e % 19 == 0, ',"extra":1').otherwise("")
    stamp = F.when(e % 17 == 0, "soon").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    body = F.concat(
        F.lit('{"meter":'), F.col("meter").cast("string"),
        F.lit(',"input_timestamp":"'), stamp,
        F.lit('","features":{'), first,
        F.lit(',"dew_temperature":'), number("dew_temperature"),
        F.lit(',"wind_speed":'), number("wind_speed"),
        F.lit(',"primary_use":'), use, extra, F.lit("}}"),
    )
    df = b.enriched(spark, sf).select("event_id", body.alias("body"))
    known = {"primary_use": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]}
    checked = vd.validate_features(df, "body", _ORDERED, known)
    return checked.select("event_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def _payloads(spark, sf, mode):
    """One provider payload per site-hour; some keys are absent or null."""
    k = F.hour("ts_hour") + F.col("site_id")
    rain = "1h" if mode == "current" else "3h"
    body = F.concat(
        F.lit('{"dt":'),
        F.unix_seconds(F.col("ts_hour").cast("timestamp")).cast("string"),
        F.lit(',"main":{"temp":'),
        F.coalesce(F.col("air_temperature").cast("string"), F.lit("null")),
        F.when(k % 4 == 0, ',"sea_level":1020.5').when(k % 4 == 1, ',"sea_level":null').otherwise(""),
        F.lit(',"pressure":'),
        F.coalesce(F.col("sea_level_pressure").cast("string"), F.lit("null")),
        F.lit(',"dew_point":'),
        F.coalesce(F.col("dew_temperature").cast("string"), F.lit("null")),
        F.lit('}'),
        F.when(k % 3 == 0, F.lit(',"clouds":{"all":50}')).otherwise(""),
        F.when(k % 5 == 0, F.lit(f',"rain":{{"{rain}":25.4}}')).otherwise(""),
        F.lit(',"wind":{"deg":'),
        F.coalesce(F.col("wind_direction").cast("string"), F.lit("null")),
        F.lit(',"speed":'),
        F.col("wind_speed").cast("string"),
        F.lit("}}"),
    )
    if mode == "forecast":
        body = F.concat(F.lit('{"list":['), body, F.lit(',{"dt":1}]}'))
    return b.weather(spark, sf).select("site_id", "ts_hour", body.alias("body"))


def _payload_sql(mode, depth):
    return f"""SELECT site_id, ts_hour, air_temperature, CASE WHEN k % 3 = 0 THEN 4.5 END AS cloud_coverage, dew_temperature,
    CASE WHEN k % 5 = 0 THEN {depth} END AS precip_depth_1_hr,
    CASE WHEN k % 4 = 0 THEN 1020.5 WHEN k % 4 = 1 THEN NULL ELSE sea_level_pressure END AS sea_level_pressure,
    wind_direction, wind_speed, ts_hour AS observation_at, '{mode}' AS mode, true AS payload_ok
    FROM (SELECT * REPLACE (CAST(cloud_coverage AS DOUBLE) AS cloud_coverage), hour(ts_hour) + site_id AS k FROM weather)"""


@query("weather_json_normalize", _payload_sql("current", "1.0").replace("THEN 4.5", "THEN 4.5::DOUBLE").replace("THEN 1.0", "THEN 1.0::DOUBLE").replace("1020.5", "1020.5::DOUBLE"))
def weather_json_normalize(spark, sf):
    return floats(normalize_weather(_payloads(spark, sf, "current"), "body", "current").drop("body"), 6)


@query(
    "weather_json_forecast",
    _payload_sql("forecast", "round(1.0 / 3, 6)").replace("THEN 4.5", "THEN 4.5::DOUBLE").replace("THEN round(1.0 / 3, 6)", "THEN 0.333333::DOUBLE").replace("1020.5", "1020.5::DOUBLE"),
)
def weather_json_forecast(spark, sf):
    return floats(normalize_weather(_payloads(spark, sf, "forecast"), "body", "forecast").drop("body"), 6)


_PROFILE_LIST = qm._PROFILE_SQL.replace(
    "array_to_string(list_sort(list(DISTINCT primary_use) FILTER (WHERE primary_use IS NOT NULL)), ',')", "list(DISTINCT primary_use)"
)


@query(
    "score_batch",
    f"""WITH p AS ({_PROFILE_LIST}),
    r AS (SELECT event_id, array_to_string(list_sort(list_filter([{_REQ_SQL}], lambda x: x IS NOT NULL)), ',') AS errors, building_id, site_id,
    CASE WHEN event_id % 47 = 0 THEN 'Casino' ELSE coalesce(primary_use, 'Other') END AS primary_use, date_trunc('second', timestamp) AS t FROM enriched)
    SELECT event_id, errors = '' AS accepted, errors, CASE WHEN errors = '' THEN array_to_string(list_sort(list_filter([
    CASE WHEN NOT list_contains(categories, primary_use) THEN 'unknown_primary_use' END,
    CASE WHEN building_id < building_min OR building_id > building_max THEN 'unseen_building_id' END,
    CASE WHEN site_id < site_min OR site_id > site_max THEN 'unseen_site_id' END,
    CASE WHEN t < timestamp_min OR t > timestamp_max THEN 'outside_training_period' END], lambda x: x IS NOT NULL)), ',') END AS warnings,
    CASE WHEN errors = '' THEN 'tree-1' END AS model_version, CASE WHEN errors = '' THEN t END AS input_timestamp,
    CASE WHEN errors = '' THEN true END AS predicted FROM r LEFT JOIN p ON true""",
)
def score_batch(spark, sf):
    """Accepted and quarantined requests with all but the predicted value, which is checked to be a number from 0 on."""
    rows, spec, model = qm.fitted(spark, sf, "tree")
    profile = mt.training_profile(rows.where("split = 'training'"), "building_id", "site_id", "timestamp", "primary_use").first().asDict()
    good, bad = ml.score_batch(requests(spark, sf), "body", model, spec, profile, "tree-1")
    # whether a value was held at 0 is the model's affair
    warned = F.array_except("warnings", F.array(F.lit("clipped_to_zero")))
    good = good.select(
        "event_id", F.lit(True).alias("accepted"), F.lit("").alias("errors"), F.array_join(F.array_sort(warned), ",").alias("warnings"),
        "model_version", "input_timestamp", (F.col("predicted_meter_reading") >= 0).alias("predicted"),
    )
    bad = bad.select("event_id", F.lit(False).alias("accepted"), F.array_join(F.array_sort("errors"), ",").alias("errors"))
    return good.unionByName(bad, allowMissingColumns=True)
