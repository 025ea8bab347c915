"""Scoring and excerpts for text search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points per term found in each part of a record.
TITLE_POINTS, NAME_POINTS, BODY_POINTS, DATE_POINTS = 10, 6, 2, 4


def terms_of(query: str) -> list[str]:
    return query.lower().split()


def term_points(term: str, in_title: Column, in_names: Column, in_body: Column, date: Column) -> Column:
    """Points of one term, by where it was found. The date is matched as written."""
    def points(found: Column, value: int) -> Column:
        return F.when(found, value).otherwise(0)

    return (points(in_title, TITLE_POINTS) + points(in_names, NAME_POINTS)
            + points(in_body, BODY_POINTS) + points(date.contains(F.lit(term)), DATE_POINTS))


def snippet(text: Column, query: str) -> Column:
    """Excerpt around the first term, with every occurrence of it marked."""
    terms: Sequence[str] = terms_of(query)
    term = terms[0] if terms else ""
    at = F.locate(term, F.lower(text)) - 1 if term else F.lit(0)
    start = F.greatest(F.lit(0), at - 70)
    raw = F.substring(text, start + 1, at + 130 - start)
    marked = F.regexp_replace(raw, f"(?iu)({re.escape(term)})", "<mark>$1</mark>") if term else raw
    plain = F.concat(F.substring(text, 1, 180), F.when(F.length(text) > 180, "…").otherwise(""))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "")
        .when(at < 0, plain)
        .otherwise(F.concat(F.when(start > 0, "…").otherwise(""), marked, F.lit("…")))
    )
