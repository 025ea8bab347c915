"""Append-only versions: the live one, new ones, corrections by people, and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.operators.scale import first_by, with_neighbours
from keepsake.schemas import EDITABLE_FIELDS


def current(versions: DataFrame, item: str = "item_id", version: str = "id") -> DataFrame:
    """Newest version of each item that is not superseded."""
    return first_by(versions.where(~F.col("superseded")), [item], [F.col(version).desc()])


def append(versions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Supersede the live versions of the items in ``fresh`` and add its rows (one per item)."""
    touched = fresh.select("item_id").distinct().withColumn("__touched", F.lit(True))
    kept = versions.join(touched, "item_id", "left").withColumn(
        "superseded", F.col("superseded") | F.coalesce("__touched", F.lit(False))).drop("__touched")
    return kept.unionByName(fresh.withColumn("superseded", F.lit(False)), allowMissingColumns=True)


def mark_read(items: DataFrame, fresh: DataFrame) -> DataFrame:
    """Items just read become 'analyzed' and take the flag and reason of the new version."""
    read = fresh.select(F.col("item_id").alias("id"), F.col("needs_human_review").alias("__flag"),
                        F.col("review_reason").alias("__reason"), F.lit(True).alias("__read"))
    joined = items.join(read, "id", "left")
    was_read = F.coalesce("__read", F.lit(False))
    changes = {
        "status": F.when(was_read, "analyzed").otherwise(F.col("status")),
        "needs_human_review": F.when(was_read, F.col("__flag")).otherwise(F.col("needs_human_review")),
        "review_reason": F.when(was_read, F.col("__reason")).otherwise(F.col("review_reason")),
    }
    return joined.select(*[changes.get(c, F.col(c)).alias(c) for c in items.columns])


def split_edits(edits: DataFrame, fields: str = "fields") -> DataFrame:
    """Mark each edit (a map of field to value) that names a field people may not change."""
    unknown = F.array_except(F.map_keys(fields), F.array(*[F.lit(f) for f in EDITABLE_FIELDS]))
    return edits.withColumn("unknown_fields", F.array_sort(unknown)).withColumn(
        "accepted", (F.size("unknown_fields") == 0) & (F.size(fields) > 0))


def changed_only(edits: DataFrame, live: DataFrame, fields: Sequence[str] = EDITABLE_FIELDS) -> DataFrame:
    """Keep of each edit just the values that differ from the live record; drop empty edits."""
    now = F.create_map(*[x for f in fields for x in (F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("")))])
    joined = edits.join(live.select("item_id", now.alias("__now")), "item_id")
    kept = F.map_filter("fields", lambda k, v: ~F.coalesce(
        F.try_element_at(F.col("__now"), k), F.lit("")).eqNullSafe(v))
    return joined.select(*edits.columns, kept.alias("__kept")).drop("fields").withColumnRenamed(
        "__kept", "fields").where(F.size("fields") > 0)


def revise(live: DataFrame, edits: DataFrame, fields: Sequence[str] = EDITABLE_FIELDS) -> DataFrame:
    """The human versions that edits produce: the edit over the live record, model kept."""
    joined = live.join(edits.select("item_id", "fields", F.col("version_id").alias("__id")), "item_id")
    merged = {f: F.coalesce(F.try_element_at("fields", F.lit(f)), F.col(f)).alias(f)
              for f in fields if f in live.columns}
    fixed = {"id": F.col("__id").alias("id"), "provider": F.lit("human").alias("provider"),
             "superseded": F.lit(False).alias("superseded"),
             "needs_human_review": F.lit(False).alias("needs_human_review"),
             "review_reason": F.lit(None).cast("string").alias("review_reason")}
    return joined.select(*[fixed.get(c, merged.get(c, F.col(c))) for c in live.columns])


def history(versions: DataFrame, fields: Sequence[str], buckets: Sequence[Column],
            item: str = "item_id", version: str = "id") -> DataFrame:
    """Each version with the names of the fields that differ from the one before it."""
    packed = F.struct(*fields)
    seen = with_neighbours(versions, [item], [version], buckets, packed, before="__before")
    changed = F.filter(F.array(*[
        F.when(F.col("__before").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"__before.{f}")), f) for f in fields
    ]), lambda f: f.isNotNull())
    return seen.withColumn("changed_fields", changed).drop("__before")
