"""Text normalization, patterns and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Meter codes and the address pattern (a prefix match).
METER_LABELS = {0: "Electricity", 1: "Chilled water", 2: "Steam", 3: "Hot water"}
EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+"


def meter_label(code: Column) -> Column:
    label = F.when(code == 0, METER_LABELS[0])
    for value, name in list(METER_LABELS.items())[1:]:
        label = label.when(code == value, name)
    return label


def strip(text: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def normalize_email(text: Column) -> Column:
    return F.lower(strip(text))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def local_part(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def email_like(text: Column) -> Column:
    return text.rlike(EMAIL_PATTERN)


def redact_parameter(text: Column, *parameters: str) -> Column:
    """Hide the values of query parameters, whatever separates them, up to the next separator, fragment or space."""
    names = "|".join(re.escape(p) for p in parameters)
    return F.regexp_replace(text, rf"(?i)([?&;])({names})=[^&;#\s]*", "$1$2=[REDACTED]")
