"""Review workflow as snapshot transforms: new table = f(old table, changes)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.geometry import rotated, valid_quad
from keepsake.operators.scale import first_by, numbered, with_neighbours
from keepsake.schemas import DECIDED

# A new crop and a turn are both followed at once by a new rendering.
STATUS_AFTER = {"approve": "approved", "reject": "rejected", "recrop": "rectified", "rotate": "rectified"}


#: An item's own key. Its id is a label made from the first part of the photo's hash, which two photos may share.
KEY = ("photo_sha256", "seq")


def key_of(*frames: DataFrame) -> list[str]:
    """The columns by which items of these frames are told apart: photo and number where all have them, else the id."""
    return list(KEY) if all(set(KEY) <= set(f.columns) for f in frames) else ["id"]


def update_by_id(items: DataFrame, changes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Set columns on the items named in ``changes``, once each, by photo and number or by id; its columns are seen as ``new.x``."""
    key = key_of(items, changes)
    hit = F.col(f"new.{key[0]}").isNotNull()
    same = reduce(Column.__and__, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key])
    joined = items.alias("old").join(changes.alias("new"), same, "left")
    return joined.select(*[
        F.when(hit, values[c]).otherwise(F.col(f"old.{c}")).alias(c) if c in values else F.col(f"old.{c}")
        for c in items.columns
    ])


def undecided(status: Column) -> Column:
    return ~status.isin(*DECIDED)


def in_view(view: str) -> Column:
    """Review views: all, pending (undecided) or flagged (undecided and flagged)."""
    open_ = undecided(F.col("status"))
    return {"all": F.lit(True), "pending": open_, "flagged": open_ & F.col("needs_human_review")}[view]


def visible_photos(photos: DataFrame, items: DataFrame, view: str) -> DataFrame:
    shown = items.where(in_view(view)).select(F.col("photo_sha256").alias("sha256"))
    return photos.join(shown, "sha256", "left_semi")


def pending_work(items: DataFrame, live: DataFrame, force: bool = False, limit: int | None = None,
                 ids: DataFrame | None = None) -> DataFrame:
    """Items to read next, by id. Naming ids implies force and does not leave out rejected ones."""
    ready = items.where("master_path is not null")
    if ids is not None:
        chosen = ready.join(ids.select("id"), "id", "left_semi")
    else:
        chosen = ready.where("status != 'rejected'")
        if not force:
            chosen = chosen.join(live.select(F.col("item_id").alias("id")), "id", "left_anti")
    ordered = chosen.orderBy("id")
    return ordered.limit(limit) if limit else ordered


def photos_to_segment(photos: DataFrame, force: bool = False, only: DataFrame | None = None) -> DataFrame:
    if only is not None:
        return photos.join(only.select("sha256"), "sha256", "left_semi")
    return photos if force else photos.where("status = 'ingested'")


def items_to_rectify(items: DataFrame, force: bool = False) -> DataFrame:
    wanted = ("detected", "rectified", "analyzed", "approved") if force else ("detected",)
    return items.where(F.col("status").isin(*wanted))


def photo_order() -> list[Column]:
    return [F.coalesce("captured_at", "ingested_at"), F.col("sha256")]


def decide(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approve or reject (id, decision) in bulk; a decision clears the flag."""
    valid = decisions.where(F.col("decision").isin(*DECIDED))
    return update_by_id(items, valid, {"status": F.col("new.decision"), "needs_human_review": F.lit(False)})


def decision_log(decisions: DataFrame, items: DataFrame) -> DataFrame:
    key = key_of(decisions, items)
    valid = decisions.where(F.col("decision").isin(*DECIDED)).select(*key, "decision")
    known = valid.join(items.select(*dict.fromkeys([*key, "id"])), key)
    return known.select(F.col("id").alias("item_id"),
                        F.when(F.col("decision") == "approved", "approve").otherwise("reject").alias("action"))


def recrop(items: DataFrame, crops: DataFrame) -> DataFrame:
    """New corners (id, quad); approval is lost and the detected quad stays as it was."""
    usable = crops.where(valid_quad(F.col("quad")))
    return update_by_id(items, usable, {"quad": F.col("new.quad"), "status": F.lit("detected")})


def rotate(items: DataFrame, turns: DataFrame) -> DataFrame:
    """Turn (id, degrees) by multiples of 90; the item is rendered again."""
    usable = turns.where(F.pmod(F.col("degrees"), F.lit(90)) == 0)
    total = rotated(F.col("old.rotation_applied"), F.col("new.degrees")).cast("long")
    return update_by_id(items, usable, {"rotation_applied": total, "status": F.lit("rectified")})


def set_pointer(items: DataFrame, edits: DataFrame, column: str) -> DataFrame:
    """Set or clear a pointer. Targets that are unknown or the item itself are refused.

    ``edits`` name the item and its target by (photo_sha256, seq, target_photo, target_seq), of which the last two are null to clear, or by (id, target).
    """
    if set(KEY) <= set(edits.columns):
        known = items.select(F.col("photo_sha256").alias("target_photo"), F.col("seq").alias("target_seq"), F.col("id").alias("__id"))
        own = (F.col("target_photo") == F.col("photo_sha256")) & (F.col("target_seq") == F.col("seq"))
        joined = edits.join(known, ["target_photo", "target_seq"], "left")
        return update_by_id(items, joined.where(F.col("target_photo").isNull() | (F.col("__id").isNotNull() & ~own)), {column: F.col("new.__id")})
    known = items.select(F.col("id").alias("target"), F.lit(True).alias("__known"))
    checked = edits.join(known, "target", "left").where(
        F.col("target").isNull() | (F.col("__known") & (F.col("target") != F.col("id"))))
    return update_by_id(items, checked, {column: F.col("new.target")})


def cascade_delete(gone: DataFrame, photos: DataFrame, items: DataFrame,
                   children: dict[str, tuple[DataFrame, list[str | tuple[str, str]]]]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Remove photos and everything below them; each child names the columns that hold its items' keys: (photo, number), or an id where it has no other."""
    named = gone.select(F.col("sha256").alias("photo_sha256")).distinct()
    kept_photos = photos.join(gone.select("sha256"), "sha256", "left_anti")
    lost, kept_items = items.join(named, "photo_sha256", "left_semi").select(*KEY, "id"), items.join(named, "photo_sha256", "left_anti")
    kept = {}
    for name, (table, columns) in children.items():
        for column in columns:
            names, key = ([column], ["id"]) if isinstance(column, str) else (list(column), list(KEY))
            table = table.join(lost.select(*[F.col(k).alias(n) for k, n in zip(key, names)]), names, "left_anti")
        kept[name] = table
    return kept_photos, kept_items, kept


def replace_for_photos(items: DataFrame, fresh: DataFrame, photos: DataFrame) -> DataFrame:
    """Detection again: all items of the named photos give way to the fresh ones."""
    named = photos.select(F.col("sha256").alias("photo_sha256"))
    return items.join(named, "photo_sha256", "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert(old: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Last write per key wins; on a tie in time the change beats the old row."""
    both = old.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return first_by(both, keys, [F.col(at).desc(), F.col("__new").desc()]).drop("__new")


def fold_actions(log: DataFrame) -> DataFrame:
    """Final state per item of an ordered action log (item_id, at, seq, action, degrees).

    Everything here combines map-side, so the length of one item's log does not matter.
    """
    known = F.create_map(*[F.lit(x) for pair in STATUS_AFTER.items() for x in pair])
    status = F.try_element_at(known, F.col("action"))
    when = F.when(status.isNotNull(), F.struct("at", "seq", status.alias("status")))
    cleared = F.col("action").isin("approve", "reject")
    return log.groupBy("item_id").agg(
        F.max(when).getField("status").alias("status"),
        F.pmod(F.coalesce(F.sum(F.when(F.col("action") == "rotate", F.col("degrees"))), F.lit(0)),
               F.lit(360)).cast("long").alias("rotation"),
        F.coalesce(F.bool_or(cleared), F.lit(False)).alias("flag_cleared"),
        F.coalesce(F.bool_or(F.col("action") == "delete"), F.lit(False)).alias("deleted"),
        F.count(F.lit(1)).alias("n_actions"),
    )


def reset(photos: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (photos.withColumns({"status": F.lit("ingested"), "segment_note": F.lit(None).cast("string")}),
            items.where(F.lit(False)))


def status_counts(photos: DataFrame, items: DataFrame, versions: DataFrame) -> DataFrame:
    """Long table (what, status, n): photos and items by status, flagged items, live versions."""
    def by_status(df: DataFrame, what: str) -> DataFrame:
        return df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "status", "n")

    flagged = items.agg(F.count_if(undecided(F.col("status")) & F.col("needs_human_review")).alias("n"))
    live = versions.agg(F.count_if(~F.col("superseded")).alias("n"))
    rest = [df.select(F.lit(w).alias("what"), F.lit("").alias("status"), "n")
            for df, w in ((flagged, "flagged"), (live, "live versions"))]
    return by_status(photos, "photos").unionByName(by_status(items, "items")).unionByName(
        rest[0]).unionByName(rest[1])


def progress(items: DataFrame, view: str) -> DataFrame:
    open_ = undecided(F.col("status"))
    return items.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(open_).alias("undecided"),
        F.count_if(open_ & F.col("needs_human_review")).alias("flagged"),
        F.count_if(in_view(view)).alias("shown"))


def next_in_queue(items: DataFrame, buckets: Sequence[Column], order: str = "id") -> DataFrame:
    """After each visible item: the one that follows, else the one before."""
    near = with_neighbours(items, [], [order], buckets, F.col(order), "__prev", "__next")
    return near.withColumn("next_id", F.coalesce("__next", "__prev")).drop("__prev", "__next")


def with_item_ids(fresh: DataFrame, existing: DataFrame, order: list[Column],
                  buckets: Sequence[Column]) -> DataFrame:
    """Continue each photo's sequence and derive ``<first 12 of hash>-<nn>`` ids."""
    last = existing.groupBy("photo_sha256").agg(F.max("seq").alias("__last"))
    placed = numbered(fresh, ["photo_sha256"], order, buckets, "__rn").join(last, "photo_sha256", "left")
    seq = (F.col("__rn") + F.coalesce("__last", F.lit(-1))).cast("long")
    return placed.withColumn("seq", seq).withColumn(
        "id", F.format_string("%s-%02d", F.substring("photo_sha256", 1, 12), F.col("seq"))).drop("__rn", "__last")


def item_payloads(items: DataFrame, live: DataFrame, names: DataFrame, counts: DataFrame) -> DataFrame:
    """Items with their live version, their entities and the number of their links.

    ``names`` holds (item_id, entities), ``counts`` (item_id, n_related); the links themselves stay rows of their own, see ``link_pages``.
    """
    fields = [c for c in live.columns if c != "item_id"]
    version = live.select(F.col("item_id").alias("id"), F.struct(*fields).alias("analysis"))
    joined = items.join(version, "id", "left").join(names.withColumnRenamed("item_id", "id"), "id", "left").join(
        counts.withColumnRenamed("item_id", "id"), "id", "left")
    return joined.withColumn("n_related", F.coalesce("n_related", F.lit(0)))


def link_pages(links: DataFrame, buckets: Sequence[Column], page_size: int = 500) -> DataFrame:
    """Each item's links nested in pages, by the other item's id."""
    placed = numbered(links, ["item_id"], [F.col("related_item_id")], buckets, "__rn").withColumn(
        "page", F.floor((F.col("__rn") - 1) / page_size))
    one = F.struct("related_item_id", "reason", "source")
    return placed.groupBy("item_id", "page").agg(F.array_sort(F.collect_list(one)).alias("related"))


def photo_pages(photos: DataFrame, items: DataFrame, buckets: Sequence[Column], page_size: int = 200) -> DataFrame:
    """Photos with their items nested, in pages of bounded size. Photos without items keep one page."""
    placed = numbered(items, ["photo_sha256"], [F.col("seq")], buckets, "__rn").withColumn(
        "page", F.floor((F.col("__rn") - 1) / page_size))
    body = F.struct("seq", *[c for c in items.columns if c not in ("seq", "photo_sha256")])
    nested = placed.groupBy("photo_sha256", "page").agg(F.array_sort(F.collect_list(body)).alias("items"))
    return photos.join(nested.withColumnRenamed("photo_sha256", "sha256"), "sha256", "left").withColumn(
        "page", F.coalesce("page", F.lit(0)))
