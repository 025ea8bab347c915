"""Text, list, enum and number coercions for machine-written records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
INTEGER_TEXT = r"^[+-]?[0-9]{1,18}$"
FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def stripped(value: Column) -> Column:
    """Remove all whitespace at both ends, newlines included."""
    return F.regexp_replace(value, EDGE_SPACE, "")


def as_text(value: Column, limit: int | None = None) -> Column:
    text = stripped(F.coalesce(value.cast("string"), F.lit("")))
    return F.substring(text, 1, limit) if limit else text


def clean_list(values: Column) -> Column:
    """Strip each entry, drop the empty ones, keep the first of each spelling."""
    cleaned = F.filter(F.transform(values, lambda v: as_text(v, 200)), lambda v: v != "")
    lowered = F.transform(cleaned, F.lower)
    kept = F.filter(cleaned, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)
    return F.coalesce(kept, F.array().cast("array<string>"))


def split_list(value: Column) -> Column:
    """A list given as one string, separated by commas or semicolons."""
    return clean_list(F.split(value, "[;,]"))


def as_enum(value: Column, allowed: Sequence[str], fallback: str) -> Column:
    text = F.translate(F.lower(as_text(value)), "- ", "__")
    return F.when(text.isin(*allowed), text).otherwise(F.lit(fallback))


def int_or(text: Column, default: int) -> Column:
    """Integer text, else the default. '3.7' and 'high' are not integer text."""
    trimmed = stripped(text)
    return F.coalesce(
        F.when(trimmed.rlike(INTEGER_TEXT), trimmed.try_cast("long")), F.lit(default).cast("long")
    )


def float_or(text: Column, default: float) -> Column:
    trimmed = F.lower(stripped(text))
    special = trimmed.rlike(r"^[+-]?(nan|inf|infinity)$")
    return F.coalesce(
        F.when(trimmed.rlike(FLOAT_TEXT) | special, trimmed.try_cast("double")), F.lit(float(default))
    )


def clamp_legibility(value: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(1), value)).cast("long")


def clamp_confidence(value: Column) -> Column:
    """Percentages become fractions; the result lies in 0..1 and NaN counts as 0."""
    fraction = F.when(value > 1.0, value / 100.0).otherwise(value)
    return F.when(F.isnan(value) | value.isNull(), 0.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction))
    )


def truthy(text: Column) -> Column:
    lowered = F.lower(stripped(text))
    return F.coalesce(~lowered.isin("", "0", "no", "false", "null", "[]", "{}", "0.0"), F.lit(False))


def nonempty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def join_reasons(*reasons: Column) -> Column:
    """Ordered list of the reasons that are present (null means absent)."""
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())
