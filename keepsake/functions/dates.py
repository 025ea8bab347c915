"""Partial dates: text of year, month or day precision that is never cast to a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.schemas import MONTHS


def year_of(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]{4}"), F.substring(value, 1, 4)).otherwise("")


def decade_of(value: Column) -> Column:
    return F.when(
        value.rlike("^[0-9]{4}"),
        F.concat(((F.substring(value, 1, 4).try_cast("int") / 10).cast("int") * 10).cast("string"), F.lit("s")),
    ).otherwise("")


def date_key(value: Column) -> Column:
    """Sort text for chronological order; undated rows come last."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("9999"))


def display_date(value: Column, precision: Column) -> Column:
    """The date at no finer precision than is known. Impossible months or days fall back."""
    parts = F.split(value, "-", -1)
    year = F.get(parts, F.lit(0))
    month_text, day_text = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    month_no = F.when(month_text.rlike("^[0-9]{1,2}$"), month_text.try_cast("int"))
    month = F.when(
        month_no.between(1, 12), F.get(F.array(*[F.lit(m) for m in MONTHS]), month_no - 1)
    )
    day = F.when(day_text.rlike("^[0-9]{1,2}$"), day_text.try_cast("int"))
    decade = F.when(
        year.rlike("^[0-9]+$"),
        F.concat((F.floor(year.try_cast("long") / 10) * 10).cast("string"), F.lit("s")),
    ).otherwise(year)
    month_year = F.concat_ws(" ", month, year)
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "")
        .when(precision == "decade", decade)
        .when((precision == "year") | (F.size(parts) == 1) | month.isNull(), year)
        .when((precision == "month") | (F.size(parts) == 2) | day.isNull() | (day < 1), month_year)
        .otherwise(F.concat_ws(" ", day.cast("string"), month, year))
    )


def date_label(display: Column, source: Column) -> Column:
    """Reader's label: a deduced date is never shown as if it were printed."""
    return (
        F.when(display == "", "Date unknown")
        .when(source == "printed", display)
        .otherwise(F.concat(F.lit("about "), display))
    )


def review_date_label(value: Column, source: Column) -> Column:
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "no date")
        .when(source == "printed", value)
        .otherwise(F.concat(F.lit("~"), value))
    )


def capture_time(*tags: Column) -> Column:
    """First tag that parses in one of the three camera formats."""
    formats = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd")
    return F.coalesce(*[F.try_to_timestamp(F.trim(t), F.lit(f)) for t in tags for f in formats])
