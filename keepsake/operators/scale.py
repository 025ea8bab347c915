"""Ordering and graph helpers that hold when one key owns a large share of the rows.

A plain window sends a whole key to one task. Keys of moderate size are served
that way; a key with more than ``HOT_ROWS`` rows is cut into buckets that
follow the wanted order, each bucket is windowed alone, and one small aggregate
per bucket carries counts or edge rows across. Results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.session import cut

HOT_ROWS = 1_000_000


def _by_size(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of moderate keys, rows of hot keys); None for a side that is known to be empty."""
    if not keys:
        return None, df
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    largest = sizes.agg(F.max("__n")).first()[0]
    if largest is None or largest <= hot_rows:
        return df, None
    hot = cut(sizes.where(F.col("__n") > hot_rows).select(*keys))
    is_hot = _same(df, hot, keys)
    return df.join(hot, is_hot, "left_anti"), df.join(hot, is_hot, "left_semi")


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equal in all of the names, where null equals null."""
    return reduce(Column.__and__, [left[n].eqNullSafe(right[n]) for n in names])


def _meet(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join by names, where null meets null; the names come once."""
    other = right.withColumnsRenamed({n: f"{n}__right" for n in names})
    on = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"{n}__right")) for n in names])
    return left.join(other, on).drop(*[f"{n}__right" for n in names])


def _tagged(df: DataFrame, buckets: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"__b{i}" for i in range(len(buckets))]
    return df.withColumns(dict(zip(names, buckets))), names


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], buckets: Sequence[Column],
             out: str = "rn", hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based row number within the keys. Nulls are a key or bucket of their own, which comes first.

    ``buckets`` go from coarse to fine, for instance a day and then ``id div 100000``. Along
    ``order`` they must never decrease, compared one after the other. Each level should
    have a moderate number of values within the level above, and the finest should bound the rows it
    holds. The input is read more than once (sizes, then rows), so cut it first where it is costly to make.
    """
    columns = [c for c in df.columns if c != out]
    moderate, hot = _by_size(df, keys, hot_rows)
    done = []
    if moderate is not None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        done.append(moderate.withColumn(out, F.row_number().over(whole).cast("long")).select(*columns, out))
    if hot is not None:
        done.append(_numbered_by_bucket(hot, keys, order, buckets, out).select(*columns, out))
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])


def _numbered_by_bucket(df: DataFrame, keys: Sequence[str], order: Sequence[Column], buckets: Sequence[Column],
                        out: str) -> DataFrame:
    tagged, names = _tagged(df, buckets)
    sizes = tagged.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n"))
    starts, total = sizes.select(*keys, *names, "__n"), F.lit(0)
    for level, name in enumerate(names):
        above = [*keys, *names[:level]]
        before = Window.partitionBy(*above).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(f"__s{level}")
        if level == len(names) - 1:
            starts = starts.select("*", start)
        else:
            upper = sizes.groupBy(*above, name).agg(F.sum("__n").alias("__n"))
            starts = _meet(starts, upper.select(*above, name, start), [*above, name])
        total = total + F.col(f"__s{level}")
    starts = starts.select(*keys, *names, total.alias("__start"))
    local = tagged.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order)))
    return _meet(local, starts, [*keys, *names]).withColumn(out, (F.col("__rn") + F.col("__start")).cast("long"))


def _edges(ends: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per bucket, the last value of the bucket before it and the first of the one after it."""
    above, name = [*keys, *names[:-1]], names[-1]
    inside = Window.partitionBy(*above).orderBy(name)
    near = ends.select(*above, name, F.lag("__last").over(inside).alias("__before"),
                       F.lead("__first").over(inside).alias("__after"))
    if len(names) == 1:
        return near
    upper = ends.groupBy(*above).agg(F.min_by("__first", name).alias("__first"), F.max_by("__last", name).alias("__last"))
    outer = _edges(upper, keys, names[:-1]).withColumnsRenamed({"__before": "__b", "__after": "__a"})
    return _meet(near, outer, above).select(
        *above, name, F.coalesce("__before", "__b").alias("__before"), F.coalesce("__after", "__a").alias("__after"))


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: Sequence[Column],
                    value: Column, before: str | None = None, after: str | None = None,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """The value of the previous and next row within the keys, by ascending order columns.

    ``buckets`` and ``hot_rows`` as in ``numbered``.
    """
    moderate, hot = _by_size(df, keys, hot_rows)
    near = []
    if moderate is not None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        pack = F.struct(value.alias("v"))
        near.append(moderate.select("*", F.lag(pack).over(whole).alias("__near_b"), F.lead(pack).over(whole).alias("__near_a")))
    if hot is not None:
        near.append(_neighbours_by_bucket(hot, keys, order, buckets, value))
    both = near[0] if len(near) == 1 else near[0].unionByName(near[1])
    added = [F.col(c).getField("v").alias(n) for c, n in (("__near_b", before), ("__near_a", after)) if n]
    return both.select(*df.columns, *added)


def _neighbours_by_bucket(df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: Sequence[Column],
                          value: Column) -> DataFrame:
    tagged, names = _tagged(df, buckets)
    tagged = tagged.withColumn("__v", F.struct(value.alias("v")))
    rank = F.struct(*order)
    ends = tagged.groupBy(*keys, *names).agg(
        F.min_by("__v", rank).alias("__first"), F.max_by("__v", rank).alias("__last"))
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    both = tagged.withColumn("__lag", F.lag("__v").over(inside)).withColumn("__lead", F.lead("__v").over(inside))
    near = _meet(both, _edges(ends, keys, names), [*keys, *names])
    return near.select(*df.columns, F.coalesce("__lag", "__before").alias("__near_b"),
                       F.coalesce("__lead", "__after").alias("__near_a"))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order. Each map task already keeps one row per key."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rn = 1").drop("__rn")


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """First n rows per key; the limit is applied before the shuffle as well as after it."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col(rank) <= n)


def resolve_roots(pointers: DataFrame, node: str, parent: str, root: str = "root") -> DataFrame:
    """Follow pointers to the last node, by doubling: log2(longest chain) rounds of joins.

    ``pointers`` holds each node once; a parent that is null, missing from the
    nodes, or the node itself ends the chain. All nodes caught in (or leading
    to) a cycle get the cycle's smallest node.
    """
    nodes = pointers.select(F.col(node).alias("n"), F.col(parent).alias("p"))
    known = nodes.select(F.col("n").alias("p"), F.lit(True).alias("known"))
    start = nodes.join(known, "p", "left").select(
        "n", F.when(F.col("known") & (F.col("p") != F.col("n")), F.col("p")).alias("p"))
    # Open rows: node, where it points so far, smallest node met on the way.
    finished = [cut(start.where("p is null").select("n", F.col("n").alias("root")))]
    open_rows = cut(start.where("p is not null").select("n", "p", F.least("n", "p").alias("low")))
    left = open_rows.count()
    span, bound = 1, None
    while left:
        # A pointer always leads to an open row or to one that was finished in the last round.
        last = finished[-1].select(F.col("n").alias("p"), "root")
        state = open_rows.join(last, "p", "left")
        ahead = state.select(F.col("n").alias("p"), F.col("p").alias("p2"), F.col("low").alias("low2"), F.col("root").alias("root2"))
        hopped = state.where("root is null").join(ahead, "p").select(
            "n", F.col("p2").alias("p"), F.least("low", "low2").alias("low"), F.col("root2").alias("root"))
        moved = cut(state.where("root is not null").select("n", "p", "low", "root").unionByName(hopped))
        finished.append(moved.where("root is not null").select("n", "root"))
        open_rows = moved.where("root is null").drop("root")
        span *= 2
        now = open_rows.count()
        if now == left and bound is None:
            bound = now  # only cycles and what leads to them remain
        if bound is not None and span > 2 * bound:
            cycle = open_rows.select(F.col("p").alias("c")).distinct()
            tops = open_rows.join(cycle, F.col("n") == F.col("c"), "left_semi").select(
                F.col("n").alias("p"), F.col("low").alias("root"))
            finished.append(open_rows.join(tops, "p").select("n", "root"))
            break
        left = now
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.select(F.col("n").alias(node), F.col("root").alias(root))


def medians(df: DataFrame, keys: Sequence[str], value: Column, out: str, hot_rows: int = 100_000, parts: int = 1024) -> DataFrame:
    """The exact median of a number per key (or of all rows): keys and ``out``. Nulls and NaN don't count.

    Keys of moderate size are put in order. For a key with more than ``hot_rows`` rows the one or two middle places are selected: the range of values is cut into ``parts``, the
    rows in each are counted, and the part that holds the place is the next range, until few enough rows or one value are left.
    """
    named = list(keys) or ["__all"]
    rows = df.select(*(keys or [F.lit(0).alias("__all")]), value.cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    moderate, hot = _by_size(rows, named, hot_rows)
    found = [] if moderate is None else [_middle_of(moderate, named)]
    if hot is not None:
        found.append(_selected(cut(hot), named, hot_rows, parts))
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both.select(*keys, F.col("__median").alias(out))


def _middle_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mean of the one or two middle rows of each key."""
    whole = Window.partitionBy(*keys)
    placed = rows.withColumns({"__i": F.row_number().over(whole.orderBy("__v")), "__n": F.count(F.lit(1)).over(whole)})
    middle = placed.where((F.col("__i") == F.floor((F.col("__n") + 1) / 2)) | (F.col("__i") == F.floor((F.col("__n") + 2) / 2)))
    return middle.groupBy(*keys).agg(F.avg("__v").alias("__median"))


def _selected(rows: DataFrame, keys: Sequence[str], hot_rows: int, parts: int) -> DataFrame:
    """Medians of hot keys: the values at the middle places, each narrowed down by counts."""
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    places = F.array_distinct(F.array(F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)))
    open_ = cut(ends.select(*keys, F.explode(places).alias("__place"), F.lit(0).cast("long").alias("__below"), "__n", "__lo", "__hi"))
    done = []
    while True:
        small = (F.col("__n") <= hot_rows) | (F.col("__lo") == F.col("__hi"))
        done.append(open_.where(small))
        left = open_.where(~small)
        if left.isEmpty():
            break
        share = (F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
        counts = (_meet(rows, left, keys).where("__v between __lo and __hi")
                  .withColumn("__part", F.least(F.floor(share * parts), F.lit(parts - 1)))
                  .groupBy(*keys, "__place", "__below", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")))
        before = Window.partitionBy(*keys, "__place").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__below", F.col("__below") + F.coalesce(F.sum("__n").over(before), F.lit(0)))
        open_ = cut(counts.where("__below <= __place and __place < __below + __n").drop("__part"))
    known = done[0]
    for some in done[1:]:
        known = known.unionByName(some)
    single = known.where("__lo = __hi").select(*keys, F.col("__lo").alias("__v"))
    inside = _meet(rows, known.where("__lo < __hi").drop("__n"), keys).where("__v between __lo and __hi")
    placed = inside.withColumn("__i", F.row_number().over(Window.partitionBy(*keys, "__place").orderBy("__v")))
    ranked = placed.where(F.col("__i") == F.col("__place") - F.col("__below") + 1).select(*keys, "__v")
    return single.unionByName(ranked).groupBy(*keys).agg(F.avg("__v").alias("__median"))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row with the columns of several one-row frames."""
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
