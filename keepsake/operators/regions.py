"""Regions a model marked on a photo: parsing, sibling links and notes for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.geometry import grid_to_pixels
from keepsake.functions.replies import Field, with_fields
from keepsake.functions.text import clamp_confidence, join_reasons, nonempty
from keepsake.schemas import ITEM_TYPES, MEDIA, NOTES

# Length limits of the descriptive fields.
LIMITS = {"headline": 200, "date_hint": 80, "shape_note": 200, "part_reason": 300, "related_reason": 300}


def explode_regions(replies: DataFrame, photo: str, data: str) -> DataFrame:
    """One row per region of a reply, keeping its original position in the list."""
    regions = F.try_variant_get(F.col(data), "$.items", "array<variant>")
    return replies.select(photo, *[c for c in replies.columns if c not in (photo, data)],
                          F.posexplode(regions).alias("pos", "region"))


def parse_regions(rows: DataFrame, region: str = "region") -> DataFrame:
    """Typed region fields; ``box`` is null where the region cannot be placed.

    Expects width and height in pixels next to each region.
    """
    field = Field.kept

    def listed(name: str, allowed: tuple[str, ...]) -> Column:
        value = F.coalesce(field(name).text, F.lit("other"))
        return F.when(value.isin(*allowed), value).otherwise("other")

    # Corners given as text count when they are numbers; a missing or extra corner voids the box.
    sides = {f"__side{i}": F.when(F.col("__four"), F.try_variant_get(F.col(region), f"$.box[{i}]", "double")) for i in range(4)}
    typed = ("panels", "part_of", "duplicate_of", "link_confidence", "confidence")
    given = rows.columns
    rows = with_fields(rows, region, ("kind", "medium", *LIMITS, "clipped_by_frame", *typed), typed).withColumn("__four", F.try_variant_get(F.col(region), "$.box[4]", "variant").isNull()).withColumns(sides)
    box = grid_to_pixels(*[F.col(n) for n in sides], F.col("width"), F.col("height"))
    related = F.transform(
        F.coalesce(F.try_variant_get(F.col(region), "$.related_to", "array<double>"),
                   F.array().cast("array<double>")), lambda v: v.try_cast("int"))
    parsed = {"box": box, "kind": listed("kind", ITEM_TYPES), "medium": listed("medium", MEDIA)}
    parsed |= {n: F.substring(F.coalesce(field(n).text, F.lit("")), 1, size) for n, size in LIMITS.items()}
    parsed |= {
        "panels": F.greatest(F.lit(1), field("panels").as_int(1)),
        "clipped_by_frame": field("clipped_by_frame").as_flag(),
        "part_of": field("part_of").as_int(-1), "duplicate_of": field("duplicate_of").as_int(-1),
        "related_to": F.array_sort(F.array_distinct(F.filter(related, lambda v: v >= 0))),
        "link_confidence": clamp_confidence(field("link_confidence").as_float(0.5)),
        "confidence": clamp_confidence(field("confidence").as_float(0.5)),
    }
    return rows.select(*[c for c in given if c != region], *[v.alias(k) for k, v in parsed.items()])


def dropped_per_photo(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("photo").agg(
        F.count_if(F.col("box").isNotNull()).alias("regions"), F.count_if(F.col("box").isNull()).alias("dropped"))


def sibling_links(parsed: DataFrame) -> DataFrame:
    """Valid links (photo, pos, link, target): both ends usable, different, by original position.

    An item that both continues another and copies one keeps only the continuation.
    """
    usable = parsed.where("box is not null")
    claims = F.array_append(F.array_append(
        F.transform("related_to", lambda t: F.struct(F.lit("related_to").alias("link"), t.cast("long").alias("target"))),
        F.struct(F.lit("part_of").alias("link"), F.col("part_of").alias("target"))),
        F.struct(F.lit("duplicate_of").alias("link"), F.col("duplicate_of").alias("target")))
    wide = usable.select("photo", F.col("pos").cast("long").alias("pos"), F.inline(claims)).where(
        "target >= 0 and target != pos")
    there = usable.select("photo", F.col("pos").cast("long").alias("target"))
    valid = wide.join(there, ["photo", "target"], "left_semi")
    merged = valid.where("link = 'part_of'").select("photo", "pos")
    copies = valid.where("link = 'duplicate_of'").join(merged, ["photo", "pos"], "left_anti")
    return valid.where("link != 'duplicate_of'").unionByName(copies).select("photo", "pos", "link", "target")


def link_note(threshold: float) -> Column:
    """Why an asserted relationship needs a look; expects the three link columns after validation."""
    c = F.col
    part, copy, linked = c("part_of") >= 0, c("duplicate_of") >= 0, F.size("related_to") > 0
    claim = F.when(part, NOTES["part_of"]).when(copy, NOTES["duplicate_of"]).otherwise(NOTES["related_to"])
    detail = F.coalesce(nonempty(c("part_reason")), nonempty(c("related_reason")))
    text = F.concat(F.format_string(NOTES["link"], claim, F.rint(c("link_confidence") * 100)),
                    F.coalesce(F.concat(F.lit(": "), detail), F.lit("")))
    return F.when((part | copy | linked) & (c("link_confidence") < threshold), text)


def item_notes(flag_below: float = 0.80) -> dict[str, Column]:
    """Notes, flag and reason of a detected item.

    Expects method, clipped_by_frame, collides, confidence, photo_flagged, photo_note and the links.
    """
    c = F.col
    notes = join_reasons(
        F.when(c("method") == "vision_raw", NOTES["unmatched"]),
        F.when(c("clipped_by_frame"), NOTES["clipped"]),
        F.when(c("collides"), NOTES["collision"]),
        link_note(flag_below),
    )
    flagged = (c("confidence") < flag_below) | c("photo_flagged") | (F.size(notes) > 0)
    low = F.format_string(NOTES["confidence"], c("confidence"), F.lit(float(flag_below)))
    reason = F.coalesce(nonempty(F.array_join(notes, "; ")), c("photo_note"), low)
    return {"notes": notes, "flagged": flagged, "reason": F.when(flagged, reason)}
