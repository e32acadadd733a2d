"""Request checks: valid rows go on, the others are kept with their errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import strip

# The request fields and the limits they must keep.
INTEGER_FIELDS = ["building_id", "meter", "site_id"]
NUMERIC_FIELDS = [
    "square_feet",
    "year_built",
    "floor_count",
    "air_temperature",
    "cloud_coverage",
    "dew_temperature",
    "precip_depth_1_hr",
    "sea_level_pressure",
    "wind_direction",
    "wind_speed",
]
REQUEST_FIELDS = [*INTEGER_FIELDS, *NUMERIC_FIELDS, "primary_use", "timestamp"]
TARGET = "meter_reading"
YEAR_BUILT_RANGE = (1800, 2016)
REQUEST_YEAR_RANGE = (1900, 2100)

_TIME = r"[T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?"
#: A whole date or date-time without a zone; one followed by an offset, Z or a zone's name.
NAIVE_PATTERN = rf"^\s*\d{{4}}-\d{{2}}-\d{{2}}({_TIME})?\s*$"
ZONED_PATTERN = rf"^\s*\d{{4}}-\d{{2}}-\d{{2}}{_TIME}\s*[A-Za-z+-]"
#: What a number may look like as text; a cast alone would also take a suffix such as 5d.
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def _no(test: Column) -> Column:
    """True unless the test is known to hold."""
    return ~F.coalesce(test, F.lit(False))


def _collect(checks: Sequence[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(failed, F.lit(code)) for failed, code in checks]))


def validate_requests(df: DataFrame, json_column: str) -> DataFrame:
    """Parse JSON requests and list every broken rule in ``errors``.

    Each request is parsed once, into its keys and value texts. Only the
    category needs its JSON kind, since it must be text. Parsed fields are
    added as columns.
    """
    numbers_of = INTEGER_FIELDS + NUMERIC_FIELDS
    parsed = df.withColumn("_m", F.from_json(F.col(json_column), "map<string,string>"))
    parsed = parsed.withColumn("_keys", F.coalesce(F.map_keys("_m"), F.array().cast("array<string>")))

    def text(name: str) -> Column:
        return F.try_element_at(F.col("_m"), F.lit(name))

    def has(name: str) -> Column:
        return F.array_contains("_keys", name)

    use = F.try_variant_get(F.try_parse_json(F.col(json_column)), "$.primary_use", "variant")
    zoned = text("timestamp").rlike(ZONED_PATTERN)
    naive = F.when(text("timestamp").rlike(NAIVE_PATTERN), F.trim(text("timestamp")))
    staged = parsed.withColumns(
        {
            **{f"_n_{c}": F.when(text(c).rlike(NUMBER_PATTERN), text(c)).try_cast("double") for c in numbers_of},
            "_use": F.when(F.schema_of_variant(use) == "STRING", strip(text("primary_use"))),
            "_zoned": F.coalesce(zoned, F.lit(False)),
            "_time": naive.try_cast("timestamp_ntz"),
        }
    )

    def n(name: str) -> Column:
        return F.col(f"_n_{name}")

    def listed(names: Sequence[str]) -> Column:
        return F.array(*[F.struct(F.lit(c).alias("f"), n(c).alias("v")) for c in names])

    def broken(names: Sequence[str], code: str, test) -> Column:
        found = F.filter(listed(names), lambda x: F.coalesce(test(x["f"], x["v"]), F.lit(False)))
        return F.transform(found, lambda x: F.concat(F.lit(f"{code}:"), x["f"]))

    def known(names: Sequence[str]) -> Column:
        return F.array(*[F.lit(c) for c in names])

    infinite = F.lit(float("inf"))
    missing = F.transform(F.array_except(known(REQUEST_FIELDS), F.col("_keys")), lambda c: F.concat(F.lit("missing:"), c))
    extra = F.size(F.array_except(F.col("_keys"), known([*REQUEST_FIELDS, TARGET]))) > 0
    single = [
        (F.col("_m").isNull(), "not_an_object"),
        (has(TARGET), "target_supplied"),
        (extra, "unexpected_field"),
        (n("building_id") < 0, "negative:building_id"),
        (n("site_id") < 0, "negative:site_id"),
        (~F.isnan(n("meter")) & ~n("meter").isin(0.0, 1.0, 2.0, 3.0), "meter_code"),
        (n("square_feet") < 0, "negative:square_feet"),
        (~n("year_built").between(*YEAR_BUILT_RANGE), "year_built_range"),
        (n("floor_count") <= 0, "floor_count_range"),
        (~n("wind_direction").between(0, 360), "wind_direction_range"),
        (has("primary_use") & _no(F.length("_use") > 0), "primary_use_blank"),
        (has("timestamp") & F.col("_zoned"), "timestamp_zone"),
        (has("timestamp") & ~F.col("_zoned") & F.col("_time").isNull(), "timestamp_invalid"),
        (~F.col("_zoned") & ~F.year("_time").between(*REQUEST_YEAR_RANGE), "timestamp_year"),
    ]
    errors = F.concat(
        missing,
        broken(numbers_of, "not_numeric", lambda f, v: v.isNull() & F.array_contains(F.col("_keys"), f)),
        broken(numbers_of, "not_finite", lambda f, v: F.isnan(v) | (F.abs(v) == infinite)),
        broken(INTEGER_FIELDS, "not_integer", lambda f, v: ~F.isnan(v) & (F.abs(v) < infinite) & (v != F.floor(v))),
        _collect(single),
    )
    return staged.select(
        *df.columns,
        *[F.expr(f"try_cast(_n_{c} AS BIGINT)").alias(c) for c in INTEGER_FIELDS],
        *[n(c).alias(c) for c in NUMERIC_FIELDS],
        F.col("_use").alias("primary_use"),
        F.when(~F.col("_zoned"), F.col("_time")).alias("timestamp"),
        errors.alias("errors"),
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows with their errors)."""
    good = F.size("errors") == 0
    return df.where(good).drop("errors"), df.where(~good)


def warn_inputs(df: DataFrame, profile: dict) -> DataFrame:
    """Add ``warnings`` for inputs outside what the training data covered.

    ``profile`` is the one-row training profile as a dictionary.
    """
    checks = [
        (~F.col("primary_use").isin(*profile["categories"]), "unknown_primary_use"),
        (~F.col("building_id").between(profile["building_min"], profile["building_max"]), "unseen_building_id"),
        (~F.col("site_id").between(profile["site_min"], profile["site_max"]), "unseen_site_id"),
        (
            ~F.col("timestamp").between(
                F.lit(str(profile["timestamp_min"])).cast("timestamp_ntz"),
                F.lit(str(profile["timestamp_max"])).cast("timestamp_ntz"),
            ),
            "outside_training_period",
        ),
    ]
    return df.withColumn("warnings", _collect(checks))


def validate_features(
    df: DataFrame,
    json_column: str,
    ordered: Sequence[str],
    categorical: dict[str, Sequence[str]],
) -> DataFrame:
    """Check prepared feature requests ``{meter?, input_timestamp, features: {...}}``.

    The features must be exactly the ordered columns; numbers may be null but
    not boolean, text or infinite, categories must be non-blank text (unknown
    ones only warn) and a meter, if given, must be electricity's number.
    """
    v = F.col("_v")

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("ABSENT"))

    def text(path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    def real(path: str) -> Column:
        return F.try_variant_get(v, path, "double")

    def unusable(path: str) -> Column:
        return ~kind(path).rlike(number) | F.coalesce(F.abs(real(path)) == float("inf"), F.lit(False))

    names = F.json_object_keys(F.get_json_object(F.col(json_column), "$.features"))
    staged = df.withColumn("_v", F.try_parse_json(F.col(json_column)))
    staged = staged.withColumn("_names", F.coalesce(names, F.array().cast("array<string>")))
    wanted = F.array(*[F.lit(c) for c in ordered])
    same_set = F.array_sort("_names") == F.array_sort(wanted)
    number = r"^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
    stamp = F.expr("try_cast(try_variant_get(_v, '$.input_timestamp', 'string') AS TIMESTAMP_NTZ)")
    checks = [
        (v.isNull(), "not_an_object"),
        ((kind("$.meter") != "ABSENT") & _no(kind("$.meter").rlike(number) & (real("$.meter") == 0)), "meter_code"),
        (stamp.isNull(), "input_timestamp"),
        (~same_set, "feature_set"),
        (same_set & (F.col("_names") != wanted), "feature_order"),
    ]
    numeric = [c for c in ordered if c not in categorical]
    checks += [(F.array_contains("_names", c) & unusable(f"$.features.{c}"), f"not_numeric:{c}") for c in numeric]
    for c in categorical:
        good = (kind(f"$.features.{c}") == "STRING") & (F.length(strip(text(f"$.features.{c}"))) > 0)
        checks.append((F.array_contains("_names", c) & _no(good), f"category:{c}"))
    warnings = [(~text(f"$.features.{c}").isin(*known), f"unknown:{c}") for c, known in categorical.items()]
    return staged.withColumn("errors", _collect(checks)).withColumn("warnings", _collect(warnings)).drop("_v", "_names")
