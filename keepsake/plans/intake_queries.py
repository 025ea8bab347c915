"""Sources, hashing, ledger, names, tags (category A) and exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions.files import media_type, safe_name
from keepsake.operators import ledger as L
from keepsake.plans.bindings import PHOTOS, RECORDS, Views, by_range
from keepsake.plans.registry import query
from keepsake.sources.files import captured_at, is_photo, kept_tags

CANDIDATES = """
candidates AS (SELECT source || '/' || printf('%019d', doc_id) || '.txt' AS path, sha256(text) AS hash,
 n_chars >= 50 AS readable, n_chars AS width, 1000 + doc_id AS height FROM documents),
ledger AS (SELECT DISTINCT sha256(text) AS hash FROM documents JOIN labels USING (doc_id)),
outcomes AS (SELECT *, CASE WHEN hash IN (SELECT hash FROM ledger) THEN 'duplicate' WHEN NOT readable THEN 'unreadable'
 WHEN path = min(path) OVER (PARTITION BY hash, readable) THEN 'ingested' ELSE 'duplicate' END AS outcome FROM candidates)"""
UPLOADS = r"""
uploads AS (SELECT p_partkey AS arrival, CASE p_type WHEN 'ECONOMY' THEN '../in/' || p_name || '.jpg'
 WHEN 'SMALL' THEN 'C:\shots\' || p_name || '.PNG' WHEN 'STANDARD' THEN p_name || '.sh'
 WHEN 'PROMO' THEN '.' || p_name || '.jpg' ELSE p_name || '.heic' END AS raw FROM part),
named AS (SELECT *, regexp_replace(replace(raw, '\', '/'), '^.*/', '') AS base FROM uploads),
safe AS (SELECT arrival, raw, CASE WHEN base NOT LIKE '.%' AND regexp_matches(lower(base),
 '\.(heic|heif|jpg|jpeg|png|tif|tiff|webp)$') THEN base END AS safe FROM named)"""


def candidates(v: Views) -> DataFrame:
    return v.t("documents").select(
        F.concat("source", F.lit("/"), F.format_string("%019d", "doc_id"), F.lit(".txt")).alias("path"),
        L.content_hash(F.col("text")).alias("hash"), (F.col("n_chars") >= 50).alias("readable"),
        F.col("n_chars").alias("width"), (F.col("doc_id") + 1000).alias("height"))


def known(v: Views) -> DataFrame:
    labelled = v.t("documents").join(v.t("labels"), "doc_id", "left_semi")
    return labelled.select(L.content_hash(F.col("text")).alias("hash"))


def uploads(v: Views) -> DataFrame:
    name = F.col("p_name")
    raw = (F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("../in/"), name, F.lit(".jpg")))
           .when(F.col("p_type") == "SMALL", F.concat(F.lit("C:\\shots\\"), name, F.lit(".PNG")))
           .when(F.col("p_type") == "STANDARD", F.concat(name, F.lit(".sh")))
           .when(F.col("p_type") == "PROMO", F.concat(F.lit("."), name, F.lit(".jpg")))
           .otherwise(F.concat(name, F.lit(".heic"))))
    return v.t("part").select(F.col("p_partkey").alias("arrival"), raw.alias("raw"))


@query("photo_files", f"WITH {UPLOADS} SELECT arrival, raw FROM safe WHERE safe IS NOT NULL")
def photo_files(v: Views) -> DataFrame:
    return uploads(v).where(is_photo(F.col("raw")))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(v: Views) -> DataFrame:
    return v.t("documents").select("doc_id", L.content_hash(F.col("text")).alias("hash"))


@query("ledger_intake", f"WITH {CANDIDATES} SELECT path, hash, outcome FROM outcomes")
def ledger_intake(v: Views) -> DataFrame:
    return L.intake(candidates(v), known(v)).select("path", "hash", "outcome")


@query("intake_report", f"""WITH {CANDIDATES} SELECT count(*) FILTER (outcome = 'ingested') AS ingested,
 count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'unreadable') AS unreadable,
 count(*) FILTER (outcome = 'ingested' AND width * height > 0 AND width * height < 4000000) AS low_resolution,
 count(*) AS total_seen FROM outcomes""")
def intake_report(v: Views) -> DataFrame:
    return L.intake_report(L.intake(candidates(v), known(v)))


@query("low_resolution", f"""WITH {PHOTOS} SELECT original_name, round(width * height / 1000000.0, 1) AS megapixels
 FROM photos WHERE width * height < 4000000""")
def low_resolution(v: Views) -> DataFrame:
    size = L.megapixels(F.col("width"), F.col("height"))
    return v.photos.where(L.is_low_resolution(F.col("width"), F.col("height"))).select(
        "original_name", F.round(size, 1).alias("megapixels"))


@query("inbox_backlog", """WITH ledger AS (SELECT DISTINCT sha256(text) AS hash FROM documents JOIN labels USING (doc_id)),
 f AS (SELECT source || '/' || lang AS folder, sha256(text) AS hash FROM documents)
 SELECT folder, count(*) AS present, count(*) FILTER (hash NOT IN (SELECT hash FROM ledger)) AS waiting
 FROM f GROUP BY folder""")
def inbox_backlog(v: Views) -> DataFrame:
    inbox = v.t("documents").select(F.concat_ws("/", "source", "lang").alias("folder"), "text")
    return L.backlog(inbox, known(v), "folder", "text")


@query("inbox_backlog_by_language", """WITH ledger AS (SELECT DISTINCT sha256(text) AS hash FROM documents JOIN labels USING (doc_id)),
 f AS (SELECT lang AS folder, sha256(text) AS hash FROM documents)
 SELECT folder, count(*) AS present, count(*) FILTER (hash NOT IN (SELECT hash FROM ledger)) AS waiting
 FROM f GROUP BY folder""")
def inbox_backlog_by_language(v: Views) -> DataFrame:
    inbox = v.t("documents").select(F.col("lang").alias("folder"), "text")
    return L.backlog(inbox, known(v), "folder", "text")


@query("landing_names", f"""WITH {UPLOADS}, n AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY arrival) AS k FROM safe),
 t AS (SELECT DISTINCT regexp_replace(safe, '-[0-9]+(\\.[^.]+)$', '\\1') AS base, CAST(regexp_extract(safe, '-([1-9][0-9]*)\\.[^.]+$', 1) AS BIGINT) AS taken
  FROM safe WHERE regexp_matches(safe, '-[1-9][0-9]*\\.[^.]+$')),
 s AS (SELECT base, taken - row_number() OVER (PARTITION BY base ORDER BY taken) AS place FROM t WHERE taken > 1)
 SELECT arrival, raw, CASE WHEN safe IS NULL THEN NULL WHEN k = 1 THEN safe
  ELSE regexp_replace(safe, '\\.[^.]+$', '') || '-' || (k + (SELECT count(*) FROM s WHERE base = safe AND place <= k - 1))
   || regexp_extract(safe, '(\\.[^.]+)$', 1) END AS landing_name FROM n""")
def landing_names(v: Views) -> DataFrame:
    return L.landing_names(uploads(v), "raw", "arrival", by_range("arrival"))


@query("media_types", f"""WITH {UPLOADS} SELECT arrival, CASE lower(regexp_extract(raw, '[^./](\\.[^./]+)$', 1))
 WHEN '.jpg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.heic' THEN 'image/heic'
 ELSE 'application/octet-stream' END AS media_type FROM named""")
def media_types(v: Views) -> DataFrame:
    return uploads(v).select("arrival", media_type(F.col("raw")).alias("media_type"))


@query("capture_metadata", """SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS captured_at,
 CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'DateTime,DateTimeOriginal,Model' WHEN o_orderpriority = '5-LOW'
  THEN 'DateTimeDigitized,DateTimeOriginal,Model' ELSE 'DateTimeDigitized,DateTimeOriginal,Model' END AS kept FROM orders""")
def capture_metadata(v: Views) -> DataFrame:
    c = F.col
    at = c("o_orderdate")
    first = (F.when(c("o_orderpriority") == "1-URGENT", F.date_format(at, "yyyy:MM:dd HH:mm:ss"))
             .when(c("o_orderpriority") == "2-HIGH", F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise("0000"))
    second = F.when(c("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(at, "yyyy:MM:dd")).otherwise("never")
    third = F.when(c("o_orderpriority") == "3-MEDIUM", "DateTime").otherwise("DateTimeDigitized")
    tags = F.create_map(
        F.lit("DateTimeOriginal"), first, third,
        F.when(c("o_orderpriority") == "3-MEDIUM", F.date_format(at, "yyyy:MM:dd HH:mm:ss")).otherwise(second),
        F.lit("Model"), F.lit("camera"), F.lit("GPSInfo"), c("o_custkey").cast("string"))
    kept = kept_tags(tags)
    return v.t("orders").select("o_orderkey", captured_at(kept).alias("captured_at"),
                                F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"))


@query("exact_duplicates", f"""WITH {RECORDS} SELECT id, NULLIF(min(id) OVER (PARTITION BY hash), id) AS duplicate_of
 FROM records""")
def exact_duplicates(v: Views) -> DataFrame:
    return L.exact_duplicates(v.hashed, "id", "hash").select("id", "duplicate_of")


@query("stored_names", f"""WITH {UPLOADS} SELECT arrival, sha256(raw) || lower(regexp_extract(safe, '(\\.[^.]+)$', 1)) AS stored
 FROM safe WHERE safe IS NOT NULL""")
def stored_names(v: Views) -> DataFrame:
    named = uploads(v).withColumn("safe", safe_name(F.col("raw"))).where("safe is not null")
    return named.select("arrival", L.stored_name(F.sha2("raw", 256), F.col("safe")).alias("stored"))
