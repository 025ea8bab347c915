"""Copies of documents that bring each source's words to a target, by entropy balancing.

Of all rates between 0 and 2 whose expected words meet each source's target, those nearest to one copy of everything (in
relative entropy) are 2 / (1 + exp(-tilt * size)), with one tilt for each source. The tilts maximise a concave dual, whose
gradient is target minus expected words; Newton steps find them, each a distributed sum over the table of
(source, size, number of documents), kept inside the bracket that earlier gradients leave. Documents of a source and size share a
rate, so rounding takes place between such classes, largest first: each class gets the whole number of copies nearest to
its rate and to what the classes before it left over, and deals them out evenly by a hash of the id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import WORD, fresh, pick
from keepsake.session import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
STEPS = 60
CLOSE = 1e-10
BUCKET = 50_000


def words(text: str) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _places(sources: DataFrame) -> DataFrame:
    """Adds ``place``, from 0, by code point, null last: numbers within ranges of the sorted rows, then of the ranges."""
    ranged = cut(sources.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranged.join(starts, "range").withColumn("place", F.col("start") + F.col("at") - F.col("first")).drop("range", "at", "first", "start")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): a share of all words by weight, none above ``most`` times its source; excess is shared again."""
    placed = _places(sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    placed = cut(placed.withColumn("weight", weight))
    wanted = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while wanted > 0:
        over = F.col("source_size") * most <= F.col("weight") * level
        held = placed.agg(F.sum(F.when(over, F.col("source_size") * most)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("n")).first()
        if held.n == full or not held.open:
            break
        full, level = held.n, (wanted - (held.held or 0.0)) / held.open
    return placed.select("source", "source_size", F.least(F.col("source_size") * most, F.col("weight") * level).alias("target"))


def _rate(tilt: Column, size: Column, most: float) -> Column:
    return F.when(tilt == math.inf, most).otherwise(most / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -tilt * size)))))


def tilts(classes: DataFrame, wanted: DataFrame, most: float = MOST, steps: int = STEPS) -> DataFrame:
    """(source, tilt): the dual's solution for classes (source, size, n) and (source, source_size, target).

    The tilt of a source whose target is ``most`` times its words is infinite; of one without words it is 0.
    """
    unit = wanted.select("source", "target", "source_size").withColumn("mean", F.lit(1.0))
    sums = classes.groupBy("source").agg((F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")) / F.greatest(F.sum(F.col("size") * F.col("n")), F.lit(1))).alias("scale"))
    same = F.col("s.source").eqNullSafe(F.col("w.source"))
    state = cut(unit.alias("w").join(sums.alias("s"), same, "left").select(
        F.col("w.source").alias("source"), "target", "scale",
        F.when(F.col("target") >= F.col("source_size") * most, math.inf).otherwise(0.0).alias("tilt"),
        F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), F.lit(False).alias("done")))
    tilt = F.col("tilt") / F.col("scale")
    for _ in range(steps):
        rate = _rate(tilt, F.col("size"), most)
        got = classes.alias("s").join(state.where("tilt < double('Infinity')").alias("w"), same).groupBy(F.col("s.source").alias("source")).agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("scale") * rate * (1 - rate / most)).alias("slope"))
        joined = state.alias("w").join(got.alias("s"), same, "left").select("w.*", "got", "slope")
        error = F.col("target") - F.col("got")
        done = F.col("got").isNull() | (F.abs(error) <= CLOSE * F.greatest(F.col("target"), F.lit(1.0)))
        low, high = F.when(error > 0, F.col("tilt")).otherwise(F.col("low")), F.when(error < 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") + F.when(F.col("slope") > 0, error / F.col("slope")).otherwise(F.signum(error))
        halfway = F.when(F.col("high") == math.inf, F.greatest(F.col("low") * 2, F.col("low") + 1)).when(
            F.col("low") == -math.inf, F.least(F.col("high") * 2, F.col("high") - 1)).otherwise((F.col("low") + F.col("high")) / 2)
        moved = joined.withColumns({"done": done, "low": low, "high": high}).withColumn(
            "next", F.when((newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("tilt")) <= 4 * F.greatest(F.abs("tilt"), F.lit(1.0))), newton).otherwise(halfway))
        state = cut(moved.select("source", "target", "scale", F.when(F.col("done"), F.col("tilt")).otherwise(F.col("next")).alias("tilt"), "low", "high", "done"))
        if state.where("not done").isEmpty():
            break
    return state.select("source", "scale", "tilt")


def _rounded(groups: Iterator[pd.DataFrame], most: float) -> Iterator[pd.DataFrame]:
    for g in groups:
        g = g.sort_values("size", ascending=False, kind="stable")
        left, copies = 0.0, []
        for size, n, rate in zip(g["size"].tolist(), g["n"].tolist(), g["rate"].tolist()):
            exact = n * rate + (left / size if size else 0.0)
            k = int(min(max(math.floor(exact + 0.5), 0), most * n))
            left = (exact - k) * size if size else left
            copies.append(k)
        yield pd.DataFrame({"source": g["source"], "size": g["size"], "copies_of_class": copies})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) of every row.

    Null texts have size 0; a null source is a source like any other, last in order. Rows without words take no copies beyond their rate of 1 and count no words; repeated
    rows are rows of their own. Ties of the hash within a class are between rows of the same id, source and size, so either choice gives the same result.
    """
    sized = cut(pick(docs, doc_id=id_col, source=F.col(source_col).cast("string"), size=words(text_col)))
    classes = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = cut(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    wanted = cut(targets(sources, weights, share, most))
    solved = tilts(classes, wanted, most)
    rated = classes.alias("c").join(solved.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select(
        "c.source", "size", "n", _rate(F.col("tilt") / F.col("scale"), F.col("size"), most).alias("rate"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        return next(_rounded(iter([g]), most))

    # A source's classes differ in size, so there are no more of them than its longest text has words.
    whole = rated.groupBy("source").applyInPandas(one, "source string, size long, copies_of_class long")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))
    known = rated.alias("a").join(whole.alias("b"), same).select("a.*", "copies_of_class")
    known = cut(known.alias("a").join(wanted.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "source_size", "target"))
    return _dealt(sized, known)


def _dealt(sized: DataFrame, known: DataFrame) -> DataFrame:
    """Each class's copies over its rows: everyone the same number, and one more for the first in the order of a hash.

    Large classes are ordered in buckets of the hash, so none is sorted in one task.
    """
    mark = F.xxhash64(F.col("a.doc_id"), F.lit("copies"))
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))
    rows = sized.alias("a").join(known.alias("b"), same).select(
        "a.doc_id", "a.source", "a.size", "source_size", "target", "rate", "n", "copies_of_class", mark.alias("mark"))
    parts = F.ceil(F.col("n") / BUCKET)
    rows = rows.withColumn("bucket", F.floor(((F.col("mark") / F.lit(2.0 ** 64)) + 0.5) * parts))
    key = [F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("size")]
    rows = rows.withColumns({"k0": key[0], "k1": key[1]})
    sizes = rows.groupBy("k0", "k1", "size", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    before = Window.partitionBy("k0", "k1", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("k0", "k1", "size", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start"))
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("k0", "k1", "size", "bucket").orderBy("mark", "doc_id"))).join(
        starts, ["k0", "k1", "size", "bucket"])
    each = F.floor(F.col("copies_of_class") / F.col("n"))
    more = F.col("start") + F.col("at") <= F.col("copies_of_class") - each * F.col("n")
    return placed.select("doc_id", "source", "size", "source_size", "target", "rate", (each + more.cast("int")).cast("long").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of ``docs`` and ``copies``, for the rows that the mix takes at least once (under another name where there is such a column).

    Rows that share id, source and size are alike to the mix; of those the copies are summed and each takes the rounded-up mean, at most two.
    """
    chosen = mix(docs, id_col, text_col, source_col).groupBy("doc_id", "source", "size").agg(F.ceil(F.avg("copies")).cast("long").alias("copies"))
    name = fresh(docs, "copies")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("r"), F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("s"), words(text_col).alias("z"))
    hit = rows.join(chosen, rows.i.eqNullSafe(chosen.doc_id) & rows.s.eqNullSafe(chosen.source) & (rows.z == chosen["size"]))
    return hit.where(F.col("copies") > 0).select("r.*", F.col("copies").alias(name))
