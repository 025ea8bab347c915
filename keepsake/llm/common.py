"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.session import cut

WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under names of the operator: what else the table holds can't clash."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_rows(df: DataFrame, make: Callable[[dict], Iterator[list[dict]]], schema: str) -> DataFrame:
    """``mapInArrow`` for ``make(iterator of column lists) -> iterator of row lists``."""
    arrow = _arrow_schema(schema)

    def run(batches):
        columns = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches)
        for rows in make(columns):
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): the smallest node that it reaches.

    Each round points every node to the smallest of its neighbours, follows that pointer once
    more and replaces the links by links between what remains. The links left shrink by
    half at least, so the rounds are few; all tables are written to the shared folder.
    """
    edges = cut(links.where("a <> b").select("a", "b").distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        near = cut(near)
        jump = near.select(F.col("a").alias("p"), F.col("p").alias("up"))
        to = cut(near.join(jump, "p").select("a", F.col("up").alias("p")))
        rounds.append(to)
        left, right = to.select("a", F.col("p").alias("pa")), to.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = cut(edges.join(left, "a").join(right, "b").where("pa <> pb")
                    .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("a").alias("p"), F.col("p").alias("up"))
        out = out.join(step, "p", "left").select("a", F.coalesce("up", "p").alias("p"))
    return cut(out.select(F.col("a").alias("node"), F.col("p").alias("root")))
