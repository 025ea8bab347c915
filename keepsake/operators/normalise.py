"""From a loosely typed reply to a clean record, its warnings and its review decision."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake import schemas as S
from keepsake.functions.replies import Field, confidence, legibility, with_fields
from keepsake.functions.text import as_enum, as_text, join_reasons, nonempty


def normalise(df: DataFrame, data: str = "data", names: Mapping[str, str] | None = None) -> DataFrame:
    """Add the clean record fields to each row with a variant reply.

    ``names`` maps a record field to the key used in the replies where the two differ.
    """
    keys = dict(names or {})

    def field(name: str) -> Field:
        return Field.kept(keys.get(name, name))

    enums = {
        "item_type": (S.ITEM_TYPES, "other"), "presentation": (S.PRESENTATIONS, "image"),
        "date_precision": (S.DATE_PRECISIONS, "unknown"), "date_source": (S.DATE_SOURCES, "unknown"),
        "orientation_hint": (S.ORIENTATIONS, "upright"),
    }
    clean: dict[str, Column] = {n: as_enum(field(n).text, *spec) for n, spec in enums.items()}
    clean |= {n: as_text(field(n).text, limit) for n, limit in S.TEXT_LIMITS.items()}
    clean["full_text"] = as_text(field("full_text").text)
    clean["date_value"] = as_text(field("date_value").text, 40)
    clean |= {n: field(n).as_list() for n in S.ENTITY_KINDS}
    clean["legibility"] = legibility(field("legibility"))
    clean["confidence"] = confidence(field("confidence"))
    clean["needs_human_review"] = field("needs_human_review").as_flag()
    kept = [c for c in df.columns if c not in clean]
    read = with_fields(df, data, *[list(dict.fromkeys(keys.get(n, n) for n in some)) for some in (clean, ("legibility", "confidence"), S.ENTITY_KINDS)])
    out = read.select(*kept, *[c.alias(n) for n, c in clean.items()])
    return empty_date_rule(out)


def empty_date_rule(df: DataFrame) -> DataFrame:
    """A date without a value claims neither a source nor a precision."""
    def guarded(name: str) -> Column:
        return F.when(F.col("date_value") == "", "unknown").otherwise(F.col(name))

    return df.withColumns({"date_source": guarded("date_source"), "date_precision": guarded("date_precision")})


def warnings() -> Column:
    """Cross-field warnings of a clean record, in fixed order."""
    c, say = F.col, S.WARNINGS
    no_text = c("full_text") == ""
    image = c("presentation") == "image"
    return join_reasons(
        F.when(c("legibility") <= 2, say["legibility"]),
        F.when(c("confidence") < 0.6, F.format_string(say["confidence"], c("confidence"))),
        F.when(c("date_source") == "inferred", say["inferred"]),
        F.when(c("orientation_hint") != "upright", F.format_string(say["orientation"], c("orientation_hint"))),
        F.when(~image & no_text, say["untranscribed"]),
        F.when((c("date_source") == "printed") & no_text, say["unprinted"]),
        F.when(image & no_text & (c("visual_description") == ""), say["unfindable"]),
        F.when(c("title") == "", say["untitled"]),
    )


def decide_review(df: DataFrame) -> DataFrame:
    """The model's own reason first, then the warnings; any of them asks for review."""
    out = df.withColumn("warnings", warnings())
    reasons = F.concat_ws("; ", nonempty(F.col("review_reason")), F.col("warnings"))
    return out.withColumns({
        "needs_human_review": F.col("needs_human_review") | (F.size("warnings") > 0),
        "review_reason": F.nullif(F.substring(reasons, 1, 600), F.lit("")),
    })
