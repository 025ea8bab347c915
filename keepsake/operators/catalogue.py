"""The published catalogue: selection, folding, cross links, timeline and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.dates import date_key, decade_of, display_date, year_of
from keepsake.functions.search import snippet, term_points, terms_of
from keepsake.functions.text import nonempty, stripped
from keepsake.operators.scale import numbered, resolve_roots, side_by_side
from keepsake.schemas import UNPUBLISHABLE
from keepsake.session import cut

PAGES_PER_PART = 64


def publishable(items: DataFrame, live: DataFrame, approved_only: bool = False) -> DataFrame:
    """Items with a live version that may be shown. ``live`` is keyed by item_id."""
    allowed = F.col("status") == "approved" if approved_only else ~F.col("status").isin(*UNPUBLISHABLE)
    return items.where(allowed).join(live.withColumnRenamed("item_id", "id"), "id")


def chronological() -> list[Column]:
    return [date_key(F.col("date_value")), F.col("id")]


def with_dates(records: DataFrame) -> DataFrame:
    value, precision = F.col("date_value"), F.col("date_precision")
    return records.withColumns({"decade": decade_of(value), "year": year_of(value),
                                "date_display": display_date(value, precision)})


@dataclass(frozen=True)
class Folded:
    """Surviving entries, the pages below them, and their text.

    ``parts`` holds the text of an entry and its pages, up to ``PAGES_PER_PART``
    texts to a row, so that an entry with very many pages never becomes one
    oversized value. Nearly all entries have a single part.
    """

    entries: DataFrame
    pages: DataFrame
    parts: DataFrame


def present_target(records: DataFrame, pointer: str, flag: str) -> DataFrame:
    """Flag rows whose pointer names another record that is present.

    Rows without a pointer look up themselves, which spreads them evenly.
    """
    ids = records.select(F.col("id").alias("__there"))
    joined = records.join(ids, F.coalesce(F.col(pointer), F.col("id")) == F.col("__there"), "left")
    points = F.col(pointer).isNotNull() & (F.col(pointer) != F.col("id"))
    return joined.withColumn(flag, points & F.col("__there").isNotNull()).drop("__there")


def flatten_pointers(records: DataFrame, pointer: str) -> DataFrame:
    """Replace a pointer by the root of its chain; cycles keep their smallest id as root."""
    roots = resolve_roots(records.select("id", pointer), "id", pointer, "__root")
    known = records.select(F.col("id").alias(pointer)).distinct().withColumn("__known", F.lit(True))
    joined = records.join(roots, "id").join(known, pointer, "left")
    moved = F.when(F.col("__root") != F.col("id"), F.col("__root")).when(
        F.col("__known").isNull(), F.col(pointer))
    return joined.select(*[moved.alias(c) if c == pointer else F.col(c) for c in records.columns])


def drop_duplicates(records: DataFrame) -> DataFrame:
    """Copies go when their original is present; without it the copy is kept."""
    return present_target(records, "duplicate_of", "__copy").where(~F.col("__copy")).drop("__copy")


def roles(records: DataFrame, buckets: Sequence[Column], chains: bool = True) -> DataFrame:
    """What becomes of each record: (id, parent_id, page_no), dropped duplicates left out.

    An entry has no parent and page 0. Only ids, pointers and dates are moved about here, and what
    was found out is written down, so that texts are read just once for each use of it.
    """
    bones = records.select("id", "duplicate_of", "part_of", "date_value")
    bones = cut(flatten_pointers(bones, "duplicate_of") if chains else bones)
    kept = drop_duplicates(bones)
    if chains:
        kept = flatten_pointers(cut(kept), "part_of")
    marked = cut(present_target(kept, "part_of", "is_page"))
    entries = marked.where(~F.col("is_page")).select(
        "id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("page_no"))
    children = marked.where("is_page").withColumn("parent_id", F.col("part_of"))
    pages = numbered(children, ["parent_id"], chronological(), buckets, "page_no")
    return entries.unionByName(pages.select("id", "parent_id", "page_no"))


def fold(records: DataFrame, buckets: Sequence[Column], chains: bool = True) -> Folded:
    """Duplicates drop first, then pages fold into present parents; orphans stay entries.

    ``buckets`` follow (date, id) order and cut up parents with very many
    pages. Set ``chains`` to False only where pointers are known to be one step long.
    """
    placed = records.join(roles(records, buckets, chains), "id")
    own = F.col("parent_id").isNull()
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    bodies = F.filter(F.transform(ordered, lambda s: s.text), lambda t: t != "")
    parts = (
        placed.select(F.coalesce("parent_id", "id").alias("id"), "page_no", "text",
                      F.floor(F.col("page_no") / PAGES_PER_PART).alias("part"))
        .groupBy("id", "part").agg(stripped(F.array_join(bodies, "\n\n")).alias("body"),
                                   F.count_if(F.col("page_no") > 0).alias("pages_in_part"))
    )
    return Folded(placed.where(own).drop("parent_id", "page_no"), placed.where(~own), parts)


def related(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose two ends are both entries and differ, with the target's card."""
    card = entries.select(F.col("id").alias("related_item_id"), "title", "type", "date_display")
    return (
        links.where("item_id != related_item_id")
        .join(entries.select(F.col("id").alias("item_id")), "item_id", "left_semi")
        .join(card, "related_item_id")
        .select("item_id", "related_item_id", "title", "type", "date_display",
                F.coalesce("reason", F.lit("")).alias("reason"))
    )


def ordered_related(edges: DataFrame) -> DataFrame:
    """Number each item's links by display text and then title, as shown to readers."""
    order = [F.col("date_display"), F.col("title"), F.col("related_item_id")]
    buckets = [F.col("date_display"), F.substring("title", 1, 3), F.col("title"), F.substring("related_item_id", 1, 7)]
    return numbered(edges, ["item_id"], order, buckets, "position")


def timeline(records: DataFrame) -> DataFrame:
    """Counts per decade and year, with a total row per decade (year null)."""
    def named(c: str) -> Column:
        return F.coalesce(nonempty(F.col(c)), F.lit("Undated"))

    return (
        records.select(named("decade").alias("decade"), named("year").alias("year"))
        .rollup("decade", "year").agg(F.count(F.lit(1)).alias("n")).where("decade is not null")
    )


def timeline_order() -> list[Column]:
    return [(F.col("decade") == "Undated").cast("int"), F.col("decade"),
            F.col("year").isNull().desc(), (F.col("year") == "Undated").cast("int"), F.col("year")]


def catalogue_counts(records: DataFrame, links: DataFrame) -> DataFrame:
    """Entries, dated entries and distinct entities of each kind, in one row."""
    totals = records.agg(F.count(F.lit(1)).alias("items"),
                         F.count_if(F.col("date_value") != "").alias("dated"))
    shown = links.join(records.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    by_kind = shown.select("kind", "slug").distinct().agg(*[
        F.count_if(F.col("kind") == k).alias(n)
        for k, n in (("person", "people"), ("place", "places"),
                     ("organization", "organizations"), ("topic", "topics"))])
    return side_by_side(totals, by_kind)


def facets(records: DataFrame, column: str = "type") -> DataFrame:
    return records.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def unidentified(records: DataFrame, links: DataFrame) -> DataFrame:
    """Photographs that name nobody."""
    named = links.where("kind = 'person'").select(F.col("item_id").alias("id"))
    return records.where("type = 'photograph'").join(named, "id", "left_anti")


def markdown(lists: Sequence[str] = ("people", "organizations", "places", "topics")) -> Column:
    """Readable article of a record whose value is in its words; null for the others."""
    c, nl = F.col, "\n"

    def line(prefix: str, column: str) -> Column:
        return F.when(c(column) != "", F.concat(F.lit(prefix), c(column)))

    front = F.concat_ws(
        nl, F.lit("---"), F.concat(F.lit('title: "'), c("title"), F.lit('"')),
        line("date: ", "date_value"),
        F.when(c("date_value") != "", F.concat(F.lit("date_source: "), c("date_source"))),
        F.concat(F.lit("item_type: "), c("item_type")),
        *[F.when(F.size(n) > 0, F.concat(F.lit(f"{n}: ["), F.array_join(n, ", "), F.lit("]"))) for n in lists],
        F.lit("---"))
    rule = F.repeat(F.lit("="), F.greatest(F.lit(3), F.length("title")))
    body = F.concat_ws(
        nl, c("title"), rule, F.lit(""),
        F.when(c("summary") != "", F.concat(F.lit("*"), c("summary"), F.lit("*\n"))),
        F.when(c("visual_description") != "", F.concat(F.lit("> "), c("visual_description"), F.lit(nl))),
        F.regexp_replace("full_text", r"(?U)\s+$", ""), F.lit(""),
        F.when(c("club_context") != "", F.concat(F.lit("---\n\n"), c("club_context"), F.lit(nl))))
    worth = c("presentation").isin("text", "both") & (c("full_text") != "")
    return F.when(worth, F.concat(front, F.lit("\n\n"), body))


def media_manifest(entries: DataFrame, pages: DataFrame, derivatives: DataFrame) -> DataFrame:
    """One row per image file to publish: the entries' own scans and those of their pages."""
    wanted = entries.select(F.col("id").alias("item_id")).unionByName(pages.select(F.col("id").alias("item_id")))
    return derivatives.join(wanted, "item_id", "left_semi")


def build_summary(before: DataFrame, entries: DataFrame, media: DataFrame, links: DataFrame) -> DataFrame:
    """Items, unapproved (counted before folding), media files and bytes, entities, decades."""
    shown = links.join(entries.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return side_by_side(
        entries.agg(F.count(F.lit(1)).alias("items"),
                    F.count_distinct(F.coalesce(nonempty(F.col("decade")), F.lit("Undated"))).alias("decades")),
        before.agg(F.count_if(F.col("status") != "approved").alias("unapproved")),
        media.agg(F.count(F.lit(1)).alias("media_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("media_bytes")),
        shown.select("kind", "slug").distinct().agg(F.count(F.lit(1)).alias("entities")),
    )


def term_flags(texts: DataFrame, query: str, roots: DataFrame | None = None) -> DataFrame:
    """(id, t0, t1, ...): whether any of an id's ``texts`` (id, text) holds each term of the query.

    A text is looked through where it is read and only Booleans leave, also on the way to the ``roots`` (id, root) of the ids.
    """
    terms = terms_of(query)
    flags = texts.select("id", *[F.lower("text").contains(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)])
    if roots is not None:
        flags = flags.join(roots.select("id", "root"), "id").drop("id").withColumnRenamed("root", "id")
    return flags.groupBy("id").agg(*[F.bool_or(f"t{i}").alias(f"t{i}") for i in range(len(terms))]) if terms else flags.distinct()


def search(entries: DataFrame, titles: DataFrame, names: DataFrame, bodies: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """(id, date_value, score) of the best entries for a query, every term of which must occur somewhere in the entry.

    ``entries`` carries id and date_value; ``titles``, ``names`` and ``bodies`` are the ``term_flags`` of what belongs to them. Each place scores a term once.
    """
    terms = terms_of(query)
    if not terms:
        return entries.select("id", "date_value", F.lit(0).alias("score")).limit(0)
    found = entries.select("id", "date_value")
    for place, flags in (("title", titles), ("name", names), ("body", bodies)):
        found = found.join(flags.withColumnsRenamed({f"t{i}": f"{place}{i}" for i in range(len(terms))}), "id", "left")
    hits = [term_points(t, F.col(f"title{i}"), F.col(f"name{i}"), F.col(f"body{i}"), F.col("date_value")) for i, t in enumerate(terms)]
    alive, total = reduce(Column.__and__, [h > 0 for h in hits]), reduce(Column.__add__, hits)
    scored = found.where(alive).select("id", "date_value", total.alias("score"))
    return scored.orderBy(F.col("score").desc(), *chronological()).limit(limit)


def with_snippet(results: DataFrame, text: str, query: str) -> DataFrame:
    return results.withColumn("snippet", snippet(F.col(text), query))


def nested_catalogue(entries: DataFrame, names: DataFrame, bodies: DataFrame) -> DataFrame:
    """One nested row per entry and text part, ready to be written as JSON lines by decade."""
    return (
        entries.join(bodies, "id").join(names.withColumnRenamed("item_id", "id"), "id", "left")
        .withColumn("decade", F.coalesce(nonempty(F.col("decade")), F.lit("Undated")))
    )
