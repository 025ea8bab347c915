"""Content-addressed intake: what is new, what is a copy, what cannot be read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.files import safe_name, stem, suffix
from keepsake.operators.scale import numbered
from keepsake.schemas import LOW_RESOLUTION_MP
from keepsake.session import cut


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def megapixels(width: Column, height: Column) -> Column:
    return F.coalesce(width, F.lit(0)).cast("double") * F.coalesce(height, F.lit(0)) / 1_000_000


def is_low_resolution(width: Column, height: Column) -> Column:
    size = megapixels(width, height)
    return (size > 0) & (size < LOW_RESOLUTION_MP)


def intake(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Outcome of each candidate (path, hash, readable): ingested, duplicate or unreadable.

    Hashes in the ledger are skipped; of several new copies the first path wins. The winner
    is found by an aggregate that combines map-side, so a content that fills a large share
    of the inbox costs no more than any other.
    """
    first = (
        candidates.where(F.col("hash").isNotNull() & F.col("readable"))
        .groupBy("hash").agg(F.min("path").alias("__first"))
    )
    known = ledger.select("hash").distinct().withColumn("__known", F.lit(True))
    fate = first.join(known, "hash", "full_outer")
    outcome = (
        F.when(F.col("hash").isNull(), "unreadable")
        .when(F.col("__known"), "duplicate")
        .when(~F.col("readable"), "unreadable")
        .when(F.col("path") == F.col("__first"), "ingested")
        .otherwise("duplicate")
    )
    return candidates.join(fate, "hash", "left").select(*candidates.columns, outcome.alias("outcome"))


def new_ledger_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'ingested'")


def intake_report(outcomes: DataFrame) -> DataFrame:
    """One row of counts; expects width and height for the resolution warning."""
    def count(condition: Column) -> Column:
        return F.count_if(condition)

    is_new = F.col("outcome") == "ingested"
    return outcomes.agg(
        count(is_new).alias("ingested"),
        count(F.col("outcome") == "duplicate").alias("duplicate"),
        count(F.col("outcome") == "unreadable").alias("unreadable"),
        count(is_new & is_low_resolution(F.col("width"), F.col("height"))).alias("low_resolution"),
        F.count(F.lit(1)).alias("total_seen"),
    )


def backlog(inbox: DataFrame, ledger: DataFrame, folder: str, content: str) -> DataFrame:
    """Per folder: files present, and files waiting, whose content the ledger doesn't have.

    Two copies of one new file count as two.
    """
    hashed = inbox.select(folder, content_hash(F.col(content)).alias("hash"))
    known = ledger.select("hash").distinct().withColumn("__known", F.lit(True))
    return hashed.join(known, "hash", "left").groupBy(folder).agg(
        F.count(F.lit(1)).alias("present"), F.count_if(F.col("__known").isNull()).alias("waiting"))


def landing_names(uploads: DataFrame, raw: str, arrival: str, buckets: Sequence[Column]) -> DataFrame:
    """Safe names for uploads (unique ``arrival``); a later file of one name lands as ``stem-n.ext``, with the next number that is free.

    Refused names come back with a null landing name. A numbered name that somebody also uploaded as such is taken, so no two
    files ever land under one name. The r-th free number from 2 on is r + 1 and the taken ones before it: with the j-th taken number t put in line at t - j, it is one more than
    the place of r in that line.
    """
    named = cut(uploads.withColumn("safe", safe_name(F.col(raw))))
    placed = numbered(named.where("safe is not null"), ["safe"], [F.col(arrival)], buckets, "__copy")
    placed = cut(placed)
    later = placed.where("__copy > 1").withColumns({"__key": F.col("__copy") - 1, "__kind": F.lit(1)})
    parts = [F.regexp_extract("safe", r"^(.*)-([1-9][0-9]{0,17})(\.[^.]+)$", i) for i in (1, 2, 3)]
    taken = placed.where("__copy = 1").select(F.concat(parts[0], parts[2]).alias("safe"), F.try_to_number(parts[1], F.lit("9" * 18)).cast("long").alias("__number"))
    taken = cut(taken.where("__number > 1").join(later.select("safe").distinct(), "safe", "left_semi"))
    numbers = numbered(taken, ["safe"], [F.col("__number")], [F.floor(F.col("__number") / 10**8), F.floor(F.col("__number") / 10**5)], "__j")
    line = cut(later.unionByName(numbers.select("safe", (F.col("__number") - F.col("__j")).alias("__key"), F.lit(0).alias("__kind")), allowMissingColumns=True))
    free = numbered(line, ["safe"], [F.col("__key"), F.col("__kind")], [F.floor(F.col("__key") / 10**8), F.floor(F.col("__key") / 10**5)], "__place")
    ending = F.regexp_extract("safe", r"(\.[^.]+)$", 1)
    label = F.concat(stem(F.col("safe")), F.lit("-"), F.col("__place") + 1, ending)
    landed = placed.where("__copy = 1").withColumn("landing_name", F.col("safe")).select(*uploads.columns, "landing_name")
    again = free.where("__kind = 1").withColumn("landing_name", label).select(*uploads.columns, "landing_name")
    refused = named.where("safe is null").withColumn("landing_name", F.lit(None).cast("string")).select(*uploads.columns, "landing_name")
    return landed.unionByName(again).unionByName(refused)


def exact_duplicates(items: DataFrame, key: str, hashed: str, out: str = "duplicate_of") -> DataFrame:
    """Point every later copy of a content at its smallest id; rows without a content stay, as copies of nothing."""
    first = items.groupBy(hashed).agg(F.min(key).alias("__first"))
    return items.join(first, hashed, "left").select(
        *items.columns, F.when(F.col("__first") != F.col(key), F.col("__first")).alias(out))


def stored_name(hashed: Column, name: Column) -> Column:
    return F.concat(hashed, suffix(name))
