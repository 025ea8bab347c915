"""Photo folders, camera tags and transfer logs as DataFrames; catalogue sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.dates import capture_time
from keepsake.functions.files import base_name, suffix
from keepsake.operators.ledger import content_hash
from keepsake.schemas import KEPT_TAGS, PHOTO_SUFFIXES


def is_photo(path: Column) -> Column:
    name = base_name(path)
    return suffix(name).isin(*PHOTO_SUFFIXES) & ~name.startswith(".")


def find_photos(spark: SparkSession, folder: str) -> DataFrame:
    """Photos below a folder: path, length and content, the last read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(is_photo(F.col("path"))).select("path", F.col("length").alias("bytes"), "content")


def hashed_photos(photos: DataFrame) -> DataFrame:
    return photos.select("path", "bytes", content_hash(F.col("content")).alias("hash"))


def kept_tags(tags: Column) -> Column:
    """The tags worth keeping; everything else, location included, is dropped."""
    return F.map_filter(tags, lambda k, v: k.isin(*KEPT_TAGS))


def captured_at(tags: Column) -> Column:
    return capture_time(*[F.try_element_at(tags, F.lit(k))
                          for k in ("DateTimeOriginal", "DateTimeDigitized", "DateTime")])


def read_transfer_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_catalogue(nested: DataFrame, path: str) -> None:
    """JSON lines, one folder per decade, written by the executors."""
    nested.write.mode("overwrite").partitionBy("decade").json(path)


def write_articles(articles: DataFrame, path: str) -> None:
    """Markdown texts (item_id, markdown) as JSON lines, so that line breaks survive."""
    articles.where("markdown is not null").write.mode("overwrite").json(path)
