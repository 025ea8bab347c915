"""Symmetric links between items, and lookups by pointer or by nearest size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.operators.scale import first_by
from keepsake.schemas import HINTS

PAIR = ["item_id", "related_item_id"]


def _once(links: DataFrame) -> DataFrame:
    """Links but self links, the smaller end first."""
    low, high = F.least(*PAIR), F.greatest(*PAIR)
    return links.where("item_id != related_item_id").withColumns({"item_id": low, "related_item_id": high})


def _both_ways(links: DataFrame) -> DataFrame:
    turned = [F.struct(F.col(a).alias(PAIR[0]), F.col(b).alias(PAIR[1])) for a, b in (PAIR, PAIR[::-1])]
    rest = [c for c in links.columns if c not in PAIR]
    return links.select(*rest, F.inline(F.array(*turned))).select(*links.columns)


def symmetric(links: DataFrame) -> DataFrame:
    """Both directions of every link, no self links, one row per pair.

    A person's row wins over a model's; otherwise the later one stands. Both directions have the same
    rows to choose from, so a pair is settled once and turned after that.
    """
    return _both_ways(first_by(_once(links), PAIR, [(F.col("source") == "human").desc(), F.col("at").desc(), F.col("reason")]))


def neighbours(links: DataFrame) -> DataFrame:
    """The pairs of ``symmetric`` without their columns."""
    return _both_ways(_once(links.select(*PAIR)).distinct())


def counted(links: DataFrame) -> DataFrame:
    """(item_id, n_related): with how many others each item is linked, either way."""
    return neighbours(links).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_related"))


def between(links: DataFrame, items: DataFrame) -> DataFrame:
    """Links whose two ends are both among ``items`` (one column of ids)."""
    known = items.select(F.col(items.columns[0]).alias("__id")).distinct()
    for end in PAIR:
        links = links.join(known, F.col(end) == F.col("__id"), "left_semi")
    return links


def unlink(links: DataFrame, cut_pairs: DataFrame) -> DataFrame:
    both = cut_pairs.select(*PAIR).unionByName(cut_pairs.select(
        F.col("related_item_id").alias("item_id"), F.col("item_id").alias("related_item_id")))
    return links.join(both, PAIR, "left_anti")


def pointer_label(items: DataFrame, pointer: str, out: str) -> DataFrame:
    """Name of the item a pointer leads to: its headline, else its id. Null without a pointer."""
    names = items.select(F.col("id").alias("__id"), F.nullif(F.col("headline"), F.lit("")).alias("__head"))
    points = items.where(F.col(pointer).isNotNull())
    named = points.join(names, F.col(pointer) == F.col("__id"), "left").withColumn(
        out, F.coalesce("__head", pointer)).drop("__id", "__head")
    return named.unionByName(items.where(F.col(pointer).isNull()).withColumn(out, F.lit(None).cast("string")))


def at_least_size(size: Column, wanted: Column) -> Column:
    """Aggregate: the smallest size that reaches the wanted one, else the largest there is."""
    return F.coalesce(F.min(F.when(size >= wanted, size)), F.max(size))


def nearest_size(size: Column, wanted: Column) -> Column:
    """Aggregate: the size nearest to the wanted one, the larger of two equally near."""
    return F.min(F.struct(F.abs(size - wanted).alias("d"), (-size).alias("neg"), size.alias("size"))).getField("size")


def preferred_size(size: Column, preference: tuple[int, ...] = (800, 1600, 320)) -> Column:
    """Aggregate: the first size of the list that exists, else null (use the master)."""
    return F.coalesce(*[F.max(F.when(size == s, size)) for s in preference])


def photo_context(items: DataFrame, photos: DataFrame) -> DataFrame:
    """Capture day and number of neighbours on the photo, per item."""
    sizes = items.groupBy("photo_sha256").agg((F.count(F.lit(1)) - 1).alias("neighbours"))
    facts = photos.select(F.col("sha256").alias("photo_sha256"), "captured_at", "original_name").join(
        sizes, "photo_sha256")
    return items.join(facts, "photo_sha256", "left")


def context_text() -> Column:
    """Hints given with an item: when it was digitised and how many lay beside it."""
    day, n = F.date_format("captured_at", "yyyy-MM-dd"), F.col("neighbours")
    beside = (F.coalesce(F.col("original_name"), F.lit("")) != "") & (n > 0)
    return F.concat_ws(
        "\n", F.lit(HINTS["task"]),
        F.when(day.isNotNull(), F.format_string(HINTS["captured"], day)),
        F.when(beside, F.format_string(HINTS["neighbours"], n, F.when(n != 1, "s").otherwise(""))),
    )
