"""Published snapshots: what changed, what is stale, what a run would cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions.files import excluded
from keepsake.operators.scale import side_by_side
from keepsake.schemas import ALWAYS_EXCLUDED

# Token estimates per item.
IMAGE_TOKENS, SYSTEM_TOKENS, OUTPUT_TOKENS = 2200, 1600, 900


def exclusions(configured: Sequence[str] = ()) -> list[str]:
    """The mandatory patterns, then the configured ones, each once."""
    return list(dict.fromkeys([*ALWAYS_EXCLUDED, *configured]))


def diff(local: DataFrame, remote: DataFrame, delete: bool = False, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, change): new, changed, unchanged, deleted or kept.

    Files only the target has are kept unless ``delete`` is set; excluded paths take no part at all.
    """
    patterns = exclusions(exclude)
    mine = local.where(~excluded(F.col("path"), patterns)).alias("l")
    theirs = remote.where(~excluded(F.col("path"), patterns)).alias("r")
    same = (F.col("l.size") == F.col("r.size")) & (F.col("l.hash") == F.col("r.hash"))
    change = (
        F.when(F.col("r.path").isNull(), "new")
        .when(F.col("l.path").isNull(), "deleted" if delete else "kept")
        .when(same, "unchanged").otherwise("changed")
    )
    return mine.join(theirs, F.col("l.path") == F.col("r.path"), "full_outer").select(
        F.coalesce("l.path", "r.path").alias("path"), change.alias("change"))


def stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def staleness(data: DataFrame, updated: str, builds: DataFrame, built: str) -> DataFrame:
    """Is the data newer than the last build? False where either is missing."""
    newest = data.agg(F.max(updated).alias("data_at"))
    last = builds.agg(F.max(built).alias("built_at"))
    return side_by_side(newest, last).withColumn(
        "stale", F.coalesce(F.col("data_at") > F.col("built_at"), F.lit(False)))


def parse_transfer_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """(path, change) of an itemised transfer log; folders and headers are left out."""
    text = F.regexp_replace(line, r"\s+$", "")
    gone = text.startswith("*deleting")
    item = (F.length(text) > 12) & F.substring(text, 1, 1).isin("<", ">", "c", "h", ".", "*")
    name = F.regexp_extract(text, r"^\S+\s+(.*)$", 1)
    return (
        lines.select(name.alias("path"), F.when(gone, "deleted").when(item, "changed").alias("change"))
        .where((F.col("change") == "deleted") | ((F.col("change") == "changed") & (F.col("path") != "")
                                                  & ~F.col("path").endswith("/")))
    )


def cost(jobs: DataFrame, prices: DataFrame, batch: bool = True) -> DataFrame:
    """Estimated spend per model. ``prices``: model, input_rate and output_rate per million tokens.

    The shared prefix is written once at 125% and read at 10%; a batch run costs half.
    """
    n = F.col("items")
    tokens_in = F.greatest(n - 1, F.lit(0)) * SYSTEM_TOKENS * 0.1 + SYSTEM_TOKENS * 1.25 + n * IMAGE_TOKENS
    usd = (tokens_in / 1_000_000 * F.col("input_rate") + n * OUTPUT_TOKENS / 1_000_000 * F.col("output_rate"))
    usd = usd * (0.5 if batch else 1.0)
    return (
        jobs.groupBy("model").agg(F.count(F.lit(1)).alias("items")).join(prices, "model")
        .select("model", "items", F.round(usd, 2).alias("usd"), F.round(usd / n, 4).alias("usd_per_item"))
    )
