"""Clean a corpus in stages; each works on what the one before kept, written as Parquet in the shared folder.

All columns of ``documents`` pass through, whatever their names; null texts count as empty, null ids as ids of their own, and an empty table
stays empty. Each stage's docstring says what becomes of repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepsake.llm import decontaminate, mixing, secret_scan, simhash
from keepsake.llm import toxicity as toxic
from keepsake.session import BATCH, fresh_path
from keepsake.sources.tables import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; repeated rows are judged alike."""
    spark.conf.set(*BATCH)
    return toxic.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, a repeated row once."""
    spark.conf.set(*BATCH)
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    spark.conf.set(*BATCH)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by their kinds in brackets."""
    return secret_scan.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies."""
    return mixing.mixed(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("secrets", secrets), ("mixture", mixture)]
ORACLE_SQL = None  # kernels, edit distances and Newton steps have no SQL; tests/llm compares near copies, leaks, secrets and the mix with brute force, toxicity on held-out rows


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
