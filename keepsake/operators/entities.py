"""People, organisations, places and topics: one entity per (kind, slug).

Links carry (kind, slug) themselves, so no lookup is needed to follow them; the
display name is joined on where it is shown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.slug import slugify
from keepsake.functions.text import stripped
from keepsake.operators.scale import numbered
from keepsake.schemas import ENTITY_KINDS

LINK = ["item_id", "kind", "slug"]


def mentions_of(records: DataFrame, item: str, arrival: str) -> DataFrame:
    """One row per name in the four lists of a record: item_id, kind, name, arrival, pos."""
    def named(column: str, kind: str) -> Column:
        return F.transform(F.col(column), lambda n, i: F.struct(
            F.lit(kind).alias("kind"), n.alias("name"), i.cast("long").alias("pos")))

    kinds = F.array(*[named(c, k) for c, k in ENTITY_KINDS.items()])
    return records.select(F.col(item).alias("item_id"), F.col(arrival).alias("arrival"),
                          F.inline(F.flatten(kinds)))


def with_slug(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("slug", slugify(F.col("name"))).where("slug != ''")


def entities(mentions: DataFrame) -> DataFrame:
    """One row per (kind, slug), under the first spelling to arrive."""
    spelling = F.struct("arrival", "item_id", "pos", stripped(F.col("name")).alias("name"))
    return mentions.groupBy("kind", "slug").agg(F.min(spelling).getField("name").alias("name"))


def model_links(mentions: DataFrame) -> DataFrame:
    return mentions.select(*LINK).distinct().withColumn("source", F.lit("model"))


def relink(links: DataFrame, reread: DataFrame, fresh: DataFrame) -> DataFrame:
    """Links after some items were read again.

    The model's rows of those items are replaced; a person's rows always stay, and
    win over a model row for the same entity.
    """
    human = links.where("source = 'human'")
    untouched = links.where("source = 'model'").join(reread.select("item_id"), "item_id", "left_anti")
    model = untouched.unionByName(fresh)
    return human.unionByName(model.join(human.select(*LINK), LINK, "left_anti"))


def entity_index(links: DataFrame, names: DataFrame) -> DataFrame:
    """How many items mention each entity, with its name."""
    counted = links.groupBy("kind", "slug").agg(F.count(F.lit(1)).alias("n_items"))
    return counted.join(names, ["kind", "slug"])


def index_order() -> list[Column]:
    return [F.col("n_items").desc(), F.lower("name"), F.col("slug")]


def index_pages(links: DataFrame, buckets: Sequence[Column], page_size: int = 500) -> DataFrame:
    """The inverted index in pages: (kind, slug, page, item ids), bounded and complete."""
    placed = numbered(links, ["kind", "slug"], [F.col("item_id")], buckets, "__rn")
    return (
        placed.withColumn("page", F.floor((F.col("__rn") - 1) / page_size))
        .groupBy("kind", "slug", "page").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    )


def item_names(links: DataFrame, names: DataFrame) -> DataFrame:
    """Names per item, ordered by kind and then name."""
    pair = F.struct("kind", "name", "slug")
    return (
        links.join(names, ["kind", "slug"]).groupBy("item_id")
        .agg(F.array_sort(F.collect_list(pair)).alias("entities"))
    )
