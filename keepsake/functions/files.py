"""File names, suffixes and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions.text import stripped
from keepsake.schemas import MEDIA_TYPES, PHOTO_SUFFIXES


def base_name(path: Column) -> Column:
    """Last part of a path; backslashes count as separators."""
    slashed = F.regexp_replace(F.translate(path, "\\", "/"), "/+$", "")
    return stripped(F.element_at(F.split(slashed, "/"), -1))


def suffix(name: Column) -> Column:
    """Lower-case extension with its dot, '' where there is none."""
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^./])\.[^./]+$", "")


def safe_name(path: Column, allowed: Sequence[str] = PHOTO_SUFFIXES) -> Column:
    """A plain file name that cannot leave its folder, or null where it is refused."""
    name = base_name(path)
    return F.when((name != "") & ~name.startswith(".") & suffix(name).isin(*allowed), name)


def media_type(name: Column) -> Column:
    ending = suffix(name)
    kind = F.lit("application/octet-stream")
    for known, value in MEDIA_TYPES.items():
        kind = F.when(ending == known, value).otherwise(kind)
    return kind


def excluded(path: Column, patterns: Sequence[str]) -> Column:
    """Does any part of the path match one of the shell-style patterns?"""
    alternatives = []
    for pattern in dict.fromkeys(patterns):
        regex = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() else "\\" + c) for c in pattern)
        alternatives.append(regex)
    return path.rlike(f"(^|/)({'|'.join(alternatives)})(/|$)") if alternatives else F.lit(False)
