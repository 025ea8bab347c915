"""The given tables seen as archive tables: DataFrame views, and the same views as SQL.

Nothing is sampled or cut: each view derives from whole tables and whole texts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.text import stripped
from keepsake.operators.catalogue import with_dates
from keepsake.operators.entities import with_slug
from keepsake.operators.ledger import content_hash, exact_duplicates
from keepsake.session import cut
from keepsake.sources.tables import spread, table

#: Statuses of items that have been read.
READ = ("approved", "analyzed", "rejected")
NAME_WORD = r"\p{Lu}\p{Ll}{3,}"


def padded(number: Column) -> Column:
    """A number as text of 19 digits, as long as numbers get: ids never merge, and are in the order of the numbers."""
    return F.lpad(number.cast("string"), 19, "0")


def by_digits(column: str) -> list[Column]:
    """Buckets of padded numbers: groups of a million ids, then of a thousand."""
    return [F.substring(column, 1, 13), F.substring(column, 14, 3)]


def by_hex(column: str) -> list[Column]:
    """Buckets of hash-like ids: their first and second three hex digits."""
    return [F.substring(column, 1, 3), F.substring(column, 4, 3)]


def by_range(column: str, width: int = 100_000) -> list[Column]:
    """Buckets of whole numbers: ranges of a thousand widths, then of one width."""
    return [F.floor(F.col(column) / (1000 * width)), F.floor(F.col(column) / width)]


def first_line(text: str) -> Column:
    return stripped(F.split_part(text, F.lit("\n"), F.lit(1)))


def title_of(text: str) -> Column:
    """The first line, as long as titles may be."""
    return F.substring(first_line(text), 1, 300)


def pick(column: Column, options: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for key, value in options.items():
        out = F.when(column == key, value).otherwise(out)
    return out


class Views:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def t(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = table(self.spark, self.folder, name)
        return self._tables[name]

    # ---- texts ---------------------------------------------------------

    @cached_property
    def records(self) -> DataFrame:
        """documents with labels and, by number, the date and status of an order."""
        d, lab = spread(self.t("documents")), self.t("labels")
        orders = self.t("orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate", "o_orderpriority",
                                         "o_orderstatus")
        c = F.col
        known = c("o_orderdate").isNotNull() & (c("o_orderstatus") != "P")
        precision = pick(c("o_orderpriority"), {"1-URGENT": "day", "2-HIGH": "month", "3-MEDIUM": "year",
                                                "4-NOT SPECIFIED": "decade"}, "unknown")
        value = (F.when(~known | known.isNull() | (precision == "unknown"), "")
                 .when(precision == "day", F.date_format("o_orderdate", "yyyy-MM-dd"))
                 .when(precision == "month", F.date_format("o_orderdate", "yyyy-MM"))
                 .otherwise(F.date_format("o_orderdate", "yyyy")))
        rows = d.join(lab, "doc_id", "left").join(orders, "doc_id", "left").select(
            padded(c("doc_id")).alias("id"), "doc_id", "text", "lang", "source", "n_chars",
            pick(c("lang"), {"en": "newspaper_clipping", "fr": "photograph", "de": "letter"}, "document").alias("type"),
            title_of("text").alias("title"),
            F.when(c("toxic") == 1, "rejected").when(c("quality") == 1, "approved")
            .when(c("n_chars") < 100, "rectified").otherwise("analyzed").alias("status"),
            F.coalesce((c("quality") == 0) | (c("toxic") == 1), F.lit(False)).alias("flagged"),
            F.when(c("n_chars") < 200, "image").when(c("n_chars") < 2000, "both").otherwise("text").alias("presentation"),
            value.alias("date_value"), F.when(value == "", "unknown").otherwise(precision).alias("date_precision"),
            F.when(value == "", "unknown").when(c("o_orderstatus") == "F", "printed").otherwise("inferred")
            .alias("date_source"),
            "quality", "toxic",
        )
        return with_dates(rows)

    @cached_property
    def hashed(self) -> DataFrame:
        """(id, hash, head, lang): the little of each text that finding copies needs, written down; ``head`` is the hash of the whole first line."""
        rows = spread(self.t("documents")).select(
            padded(F.col("doc_id")).alias("id"), content_hash(F.col("text")).alias("hash"),
            content_hash(first_line("text")).alias("head"), "lang")
        return cut(rows)

    @cached_property
    def pointers(self) -> DataFrame:
        """duplicate_of (first copy of the text) and part_of (first text with the same first line and language, nulls alike)."""
        rows = exact_duplicates(self.hashed, "id", "hash")
        heads = self.hashed.groupBy(F.col("head").alias("__h"), F.col("lang").alias("__l")).agg(F.min("id").alias("__head"))
        return rows.join(heads, F.col("head").eqNullSafe(F.col("__h")) & F.col("lang").eqNullSafe(F.col("__l"))).select("id", "duplicate_of", F.when(
            F.col("__head") != F.col("id"), F.col("__head")).alias("part_of"))

    @cached_property
    def pointed(self) -> DataFrame:
        return self.records.join(self.pointers, "id")

    @cached_property
    def published(self) -> DataFrame:
        return self.pointed.where(~F.col("status").isin("rejected", "detected", "rectified"))

    @cached_property
    def mentions(self) -> DataFrame:
        d = self.t("documents")
        words = spread(d).select(padded(F.col("doc_id")).alias("item_id"), F.col("doc_id").alias("arrival"),
                         F.posexplode(F.regexp_extract_all("text", F.lit(NAME_WORD), F.lit(0))).alias("pos", "name"))
        people = words.select("item_id", "arrival", F.lit("person").alias("kind"), "name", F.col("pos").cast("long"))

        def single(kind: str, name: Column, rows: DataFrame) -> DataFrame:
            return rows.select(padded(F.col("doc_id")).alias("item_id"), F.col("doc_id").alias("arrival"),
                               F.lit(kind).alias("kind"), name.alias("name"), F.lit(0).cast("long").alias("pos"))

        lab = self.t("labels")
        topic = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
        return people.unionByName(single("organization", F.col("source"), d)).unionByName(
            single("place", F.col("lang"), d)).unionByName(
            single("topic", topic, lab.join(d.select("doc_id"), "doc_id", "left_semi")))

    @cached_property
    def slugged(self) -> DataFrame:
        # Written down: links and names both come from it, and the texts are gone through once.
        return cut(with_slug(self.mentions))

    # ---- photos, items and boxes ----------------------------------------

    @cached_property
    def photos(self) -> DataFrame:
        c = F.col
        return self.t("orders").select(
            F.sha2(c("o_orderkey").cast("string"), 256).alias("sha256"), "o_orderkey",
            F.concat(F.lit("IMG_"), c("o_orderkey").cast("string"), F.lit(".jpg")).alias("original_name"),
            (1000 + c("o_custkey") % 3000).alias("width"), (800 + c("o_custkey") % 2000).alias("height"),
            F.when(c("o_orderpriority") != "5-LOW", c("o_orderdate")).alias("captured_at"),
            F.date_add(c("o_orderdate"), 30).cast("timestamp_ntz").alias("ingested_at"),
            pick(c("o_orderstatus"), {"P": "ingested", "O": "segmented"}, "rectified").alias("status"),
            F.when(c("o_totalprice") > 400000, "single item filling the frame").alias("segment_note"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """lineitem, one row per (order, line). The one-letter flags are compared as numbers, which hashes."""
        numbers = [F.min(f"l_{n}").alias(n) for n in ("partkey", "suppkey", "quantity", "discount", "tax")]
        flags = [F.char(F.min(F.ascii(f"l_{n}"))).alias(n) for n in ("returnflag", "linestatus")]
        return self.t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*numbers, *flags)

    @cached_property
    def items(self) -> DataFrame:
        c = F.col
        sha = F.sha2(c("l_orderkey").cast("string"), 256)
        seq = (c("l_linenumber") - 1).cast("long")
        status = pick(F.concat("returnflag", "linestatus"), {
            "AF": "approved", "AO": "analyzed", "NF": "rectified", "NO": "detected", "RF": "rejected"}, "analyzed")
        first = self.lines.where("l_linenumber = 1").select("l_orderkey", F.lit(True).alias("has_first"))
        names = self.t("part").select(F.col("p_partkey").alias("partkey"), "p_name")
        item_id = F.format_string("%s-%02d", F.substring(sha, 1, 12), seq)
        rows = self.lines.join(first, "l_orderkey", "left").join(names, "partkey", "left")
        parent = F.when((seq > 0) & (c("tax") == 0) & c("has_first"), F.concat(F.substring(sha, 1, 12), F.lit("-00")))
        return rows.select(
            item_id.alias("id"), sha.alias("photo_sha256"), seq.alias("seq"), "l_orderkey",
            status.alias("status"), (c("discount") >= 0.08).alias("needs_human_review"),
            F.when(status != "detected", F.concat(F.lit("masters/"), item_id, F.lit(".jpg"))).alias("master_path"),
            (90 * (c("partkey") % 4)).cast("long").alias("rotation_applied"),
            parent.alias("part_of_item_id"),
            F.when(c("quantity") >= 10, F.coalesce("p_name", F.lit(""))).otherwise("").alias("headline"),
            (F.round(c("discount") * 100) - 5).cast("long").alias("skew"),
        )

    @cached_property
    def live_items(self) -> DataFrame:
        """Items that have been read, as a set of live versions."""
        return self.items.where(F.col("status").isin(*READ)).select(
            F.col("id").alias("item_id"))

    @cached_property
    def boxes(self) -> DataFrame:
        c = F.col
        x0, y0 = (c("partkey") % 300).cast("long"), (c("suppkey") * 37 % 300).cast("long")
        w, h = (20 + c("quantity") * 4).cast("long"), (40 + F.round(c("discount") * 100) * 20).cast("long")
        placed = self.lines.select(
            c("l_orderkey").alias("photo"), c("l_linenumber").cast("long").alias("seq"), x0.alias("x0"),
            y0.alias("y0"), F.least(x0 + w, F.lit(599)).alias("x1"), F.least(y0 + h, F.lit(599)).alias("y1"),
            pick(c("returnflag"), {"A": "edge", "N": "background"}, "threshold").alias("method"),
            (c("quantity") / 50).alias("confidence"), F.round(c("tax") * 100).cast("long").alias("shift"))
        return placed.withColumn(
            "area_frac", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double") / 360000)

    def predicted_of(self, boxes: DataFrame) -> DataFrame:
        c = F.col
        return boxes.where("method != 'threshold'").select(
            "photo", "seq", (c("x0") + c("shift") * 3).alias("x0"), (c("y0") + c("shift")).alias("y0"),
            (c("x1") + c("shift") * 3).alias("x1"), (c("y1") + c("shift")).alias("y1"))

    # ---- versions, actions, pages, manifests -----------------------------

    @cached_property
    def versions(self) -> DataFrame:
        c = F.col
        return self.t("events").select(
            padded(c("user_id")).alias("item_id"), c("event_id").alias("id"),
            (c("event_type") == "error").alias("superseded"), F.lit("model").alias("provider"),
            pick(c("event_type"), {"click": "one", "view": "two"}, "three").alias("model"),
            c("event_type").alias("item_type"), c("props").alias("title"),
            F.when(c("value") < 5, "").otherwise(c("value").cast("string")).alias("summary"),
            F.lit(False).alias("needs_human_review"), F.lit(None).cast("string").alias("review_reason"))

    @cached_property
    def actions(self) -> DataFrame:
        c = F.col
        return actions_of(self.t("events"))

    @cached_property
    def turns(self) -> DataFrame:
        """conversations as records: later turns are pages of the first."""
        c = F.col

        def turn_id(turn: Column) -> Column:
            return F.format_string("%019d-%019d", c("conv_id"), turn)

        return self.t("conversations").select(
            turn_id(c("turn")).alias("id"), "conv_id", "turn", "text", "role",
            F.lit(None).cast("string").alias("duplicate_of"),
            F.when(c("turn") > 0, turn_id(F.lit(0).cast("long"))).alias("part_of"),
            F.when(c("turn") > 0, turn_id(c("turn") - 1)).alias("after"),
            F.lit("").alias("date_value"))

    @cached_property
    def local_files(self) -> DataFrame:
        p = self.t("pages")
        return p.select(page_path(F.col("page_id")).alias("path"), F.length("html").cast("long").alias("size"),
                        F.sha2(F.col("html").cast("binary"), 256).alias("hash"))

    @cached_property
    def remote_files(self) -> DataFrame:
        """An older snapshot: without the French pages, without ad comments, and with notes nobody here made."""
        p = self.t("pages").where(~F.col("html").contains('lang="fr"')).withColumn(
            "html", F.regexp_replace("html", "<!-- ad [0-9]+ -->", ""))
        old = p.select(page_path(F.col("page_id")).alias("path"), F.length("html").cast("long").alias("size"),
                       F.sha2(F.col("html").cast("binary"), 256).alias("hash"))
        notes = self.t("benchmark").select(
            F.concat(F.lit("notes/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"),
            F.length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
        return old.unionByName(notes)

    @cached_property
    def derivatives(self) -> DataFrame:
        """Image sizes per record: 320 always, 800 and 1600 for longer ones."""
        c = F.col
        edges = F.filter(F.array(F.lit(320), F.when(c("n_chars") >= 200, 800), F.when(c("n_chars") >= 2000, 1600)),
                         lambda s: s.isNotNull())
        return self.t("documents").select(
            padded(c("doc_id")).alias("item_id"), c("n_chars"), F.explode(edges.cast("array<long>")).alias("long_edge")
        ).select("item_id", "long_edge", F.concat(F.lit("media/"), "item_id", F.lit("-"), c("long_edge").cast("string"),
                                                  F.lit(".webp")).alias("path"),
                 (c("n_chars") + c("long_edge")).alias("bytes"))

    @cached_property
    def replies(self) -> DataFrame:
        return replies_of(self.records)


def actions_of(events: DataFrame) -> DataFrame:
    c = F.col
    action = pick(c("event_type"), {"signup": "approve", "purchase": "reject", "error": "recrop", "click": "rotate"},
                  "edit")
    return events.select(padded(c("user_id")).alias("item_id"), c("ts").alias("at"), c("event_id").alias("seq"),
                         action.alias("action"), (90 * (c("event_id") % 4)).cast("long").alias("degrees"))


def page_path(number: Column) -> Column:
    return F.concat(F.lit("pages/"), number.cast("string"), F.lit(".html"))


def replies_of(records: DataFrame) -> DataFrame:
    """Machine replies with the usual near misses, built from each record: (item_id, reply)."""
    c = F.col
    body = F.to_json(F.struct(
        pick(c("lang"), {"en": "Newspaper-Clipping", "fr": " photograph ", "de": "papyrus scroll"}, "Letter").alias("item_type"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), c("text").alias("full_text"),
        c("date_value"), c("date_precision"),
        F.upper("date_source").alias("date_source"),
        F.concat("source", F.lit("; "), "lang", F.lit(","), F.upper("source")).alias("people"),
        F.array("source", F.upper("source"), F.lit("")).alias("places"),
        c("presentation"), (c("n_chars") % 8).alias("legibility"), (c("n_chars") % 150).alias("confidence"),
        F.when(c("flagged"), "check the wording").otherwise("").alias("review_reason"),
        c("flagged").alias("needs_human_review"),
        F.when(c("quality") == 0, "rotate-180").otherwise("upright").alias("orientation_hint"),
    ))
    wrapped = (F.when(c("presentation") == "text", body)
               .when(c("presentation") == "both", F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
               .otherwise(F.concat(F.lit("The record is "), body, F.lit(" as asked."))))
    return records.select(c("id").alias("item_id"), wrapped.alias("reply"))


# ---- the same views as SQL --------------------------------------------------

FIRST_LINE = r"regexp_replace(split_part(d.text, chr(10), 1), '^\s+|\s+$', '', 'g')"
ORDER_PRECISION = """CASE o.o_orderpriority WHEN '1-URGENT' THEN 'day' WHEN '2-HIGH' THEN 'month'
 WHEN '3-MEDIUM' THEN 'year' WHEN '4-NOT SPECIFIED' THEN 'decade' ELSE 'unknown' END"""
RECORDS = f"""
records0 AS (
 SELECT printf('%019d', d.doc_id) AS id, d.doc_id, d.text, d.lang, d.source, d.n_chars,
  CASE d.lang WHEN 'en' THEN 'newspaper_clipping' WHEN 'fr' THEN 'photograph' WHEN 'de' THEN 'letter'
   ELSE 'document' END AS type,
  left({FIRST_LINE}, 300) AS title, sha256({FIRST_LINE}) AS head,
  CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'approved' WHEN d.n_chars < 100 THEN 'rectified'
   ELSE 'analyzed' END AS status,
  COALESCE(l.quality = 0 OR l.toxic = 1, FALSE) AS flagged,
  CASE WHEN d.n_chars < 200 THEN 'image' WHEN d.n_chars < 2000 THEN 'both' ELSE 'text' END AS presentation,
  CASE WHEN o.o_orderdate IS NULL OR o.o_orderstatus = 'P' THEN ''
   ELSE CASE {ORDER_PRECISION} WHEN 'unknown' THEN '' WHEN 'day' THEN strftime(o.o_orderdate, '%Y-%m-%d')
    WHEN 'month' THEN strftime(o.o_orderdate, '%Y-%m') ELSE strftime(o.o_orderdate, '%Y') END END AS date_value,
  {ORDER_PRECISION} AS raw_precision, o.o_orderstatus, l.quality, l.toxic
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN orders o ON o.o_orderkey = d.doc_id),
records AS (
 SELECT * EXCLUDE (raw_precision, o_orderstatus),
  CASE WHEN date_value = '' THEN 'unknown' ELSE raw_precision END AS date_precision,
  CASE WHEN date_value = '' THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'printed' ELSE 'inferred' END AS date_source,
  CASE WHEN date_value = '' THEN '' ELSE left(date_value, 3) || '0s' END AS decade,
  left(date_value, 4) AS year, sha256(text) AS hash,
  CASE WHEN date_value = '' THEN ''
   WHEN raw_precision = 'day' THEN CAST(CAST(substr(date_value, 9, 2) AS INT) AS VARCHAR) || ' '
     || strftime(CAST(date_value AS DATE), '%B') || ' ' || left(date_value, 4)
   WHEN raw_precision = 'month' THEN strftime(CAST(date_value || '-01' AS DATE), '%B') || ' ' || left(date_value, 4)
   WHEN raw_precision = 'decade' THEN left(date_value, 3) || '0s'
   ELSE left(date_value, 4) END AS date_display
 FROM records0)"""
POINTED = RECORDS + """,
pointed AS (
 SELECT *, NULLIF(min(id) OVER (PARTITION BY hash), id) AS duplicate_of,
  NULLIF(min(id) OVER (PARTITION BY head, lang), id) AS part_of FROM records),
published AS (SELECT * FROM pointed WHERE status NOT IN ('rejected', 'detected', 'rectified'))"""
FOLDED = POINTED + """,
kept AS (SELECT * FROM published p WHERE duplicate_of IS NULL
 OR NOT EXISTS (SELECT 1 FROM published q WHERE q.id = p.duplicate_of)),
fpages AS (SELECT k.*, k.part_of AS parent_id, row_number() OVER (PARTITION BY k.part_of
   ORDER BY COALESCE(NULLIF(k.date_value, ''), '9999'), k.id) AS page_no
  FROM kept k WHERE EXISTS (SELECT 1 FROM kept q WHERE q.id = k.part_of)),
entries AS (SELECT * FROM kept k WHERE part_of IS NULL OR NOT EXISTS (SELECT 1 FROM kept q WHERE q.id = k.part_of)),
ftexts AS (SELECT id, 0 AS page_no, text FROM entries UNION ALL SELECT parent_id, page_no, text FROM fpages),
fparts AS (SELECT id, page_no // 64 AS part, count(*) FILTER (page_no > 0) AS pages_in_part,
  regexp_replace(COALESCE(string_agg(text, chr(10) || chr(10) ORDER BY page_no) FILTER (text <> ''), ''),
   '^\\s+|\\s+$', '', 'g') AS body
  FROM ftexts GROUP BY ALL)"""
SLUG_MACRO = r"""trim(regexp_replace(lower(regexp_replace(strip_accents({0}), '[^\x00-\x7F]|[''`]', '', 'g')),
 '[^a-z0-9]+', '-', 'g'), '-')"""
MENTIONS = r"""
words AS (SELECT doc_id, regexp_extract_all(text, '\p{Lu}\p{Ll}{3,}') AS ws FROM documents),
mentions0 AS (
 SELECT doc_id, 'person' AS kind, unnest(ws) AS name, generate_subscripts(ws, 1) - 1 AS pos FROM words
 UNION ALL SELECT doc_id, 'organization', source, 0 FROM documents
 UNION ALL SELECT doc_id, 'place', lang, 0 FROM documents
 UNION ALL SELECT doc_id, 'topic', CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END, 0
  FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)),
mentions AS (SELECT printf('%019d', doc_id) AS item_id, doc_id, kind, name, pos, """ + SLUG_MACRO.format("name") + r""" AS slug
 FROM mentions0),
links AS (SELECT DISTINCT item_id, kind, slug FROM mentions WHERE slug <> ''),
ents AS (SELECT kind, slug, arg_min(name, (doc_id, pos)) AS name FROM mentions WHERE slug <> '' GROUP BY ALL)"""
PHOTOS = """
photos AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS sha256, o_orderkey,
 'IMG_' || o_orderkey || '.jpg' AS original_name, 1000 + o_custkey % 3000 AS width, 800 + o_custkey % 2000 AS height,
 CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS captured_at, o_orderdate + INTERVAL 30 DAY AS ingested_at,
 CASE o_orderstatus WHEN 'P' THEN 'ingested' WHEN 'O' THEN 'segmented' ELSE 'rectified' END AS status,
 CASE WHEN o_totalprice > 400000 THEN 'single item filling the frame' END AS segment_note FROM orders)"""
LINES = """
lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS partkey, min(l_suppkey) AS suppkey,
 min(l_quantity) AS quantity, min(l_discount) AS discount, min(l_tax) AS tax, min(l_returnflag) AS returnflag,
 min(l_linestatus) AS linestatus FROM lineitem GROUP BY ALL)"""
ITEMS = LINES + """,
items0 AS (SELECT sha256(CAST(l_orderkey AS VARCHAR)) AS photo_sha256, l_linenumber - 1 AS seq, *,
 CASE returnflag || linestatus WHEN 'AF' THEN 'approved' WHEN 'AO' THEN 'analyzed' WHEN 'NF' THEN 'rectified'
  WHEN 'NO' THEN 'detected' WHEN 'RF' THEN 'rejected' ELSE 'analyzed' END AS status FROM lines),
items AS (SELECT left(photo_sha256, 12) || '-' || printf('%02d', seq) AS id, photo_sha256, CAST(seq AS BIGINT) AS seq,
 l_orderkey, status, discount >= 0.08 AS needs_human_review,
 CASE WHEN status <> 'detected' THEN 'masters/' || left(photo_sha256, 12) || '-' || printf('%02d', seq) || '.jpg' END
  AS master_path, 90 * (partkey % 4) AS rotation_applied,
 CASE WHEN seq > 0 AND tax = 0 AND EXISTS (SELECT 1 FROM lines f WHERE f.l_orderkey = i.l_orderkey
  AND f.l_linenumber = 1) THEN left(photo_sha256, 12) || '-00' END AS part_of_item_id,
 CASE WHEN quantity >= 10 THEN COALESCE((SELECT p_name FROM part WHERE p_partkey = i.partkey), '') ELSE '' END AS headline,
 CAST(round(discount * 100) - 5 AS BIGINT) AS skew FROM items0 i),
live AS (SELECT id AS item_id FROM items WHERE status IN ('approved', 'analyzed', 'rejected'))"""
BOXES = LINES + """,
boxes0 AS (SELECT l_orderkey AS photo, CAST(l_linenumber AS BIGINT) AS seq, partkey % 300 AS x0, suppkey * 37 % 300 AS y0,
 CAST(20 + quantity * 4 AS BIGINT) AS w, CAST(40 + round(discount * 100) * 20 AS BIGINT) AS h,
 CASE returnflag WHEN 'A' THEN 'edge' WHEN 'N' THEN 'background' ELSE 'threshold' END AS method,
 quantity / 50 AS confidence, CAST(round(tax * 100) AS BIGINT) AS shift FROM lines),
boxes AS (SELECT photo, seq, x0, y0, least(x0 + w, 599) AS x1, least(y0 + h, 599) AS y1, method, confidence, shift,
 CAST((least(x0 + w, 599) - x0) * (least(y0 + h, 599) - y0) AS DOUBLE) / 360000 AS area_frac FROM boxes0),
predicted AS (SELECT photo, seq, x0 + shift * 3 AS x0, y0 + shift AS y0, x1 + shift * 3 AS x1, y1 + shift AS y1
 FROM boxes WHERE method <> 'threshold')"""
VERSIONS = """
versions AS (SELECT printf('%019d', user_id) AS item_id, event_id AS id, event_type = 'error' AS superseded,
 'model' AS provider, CASE event_type WHEN 'click' THEN 'one' WHEN 'view' THEN 'two' ELSE 'three' END AS model,
 event_type AS item_type, props AS title, CASE WHEN value < 5 THEN '' ELSE CAST(value AS VARCHAR) END AS summary,
 FALSE AS needs_human_review, CAST(NULL AS VARCHAR) AS review_reason FROM events)"""
ACTIONS = """
actions AS (SELECT printf('%019d', user_id) AS item_id, ts AS "at", event_id AS seq,
 CASE event_type WHEN 'signup' THEN 'approve' WHEN 'purchase' THEN 'reject' WHEN 'error' THEN 'recrop'
  WHEN 'click' THEN 'rotate' ELSE 'edit' END AS action, 90 * (event_id % 4) AS degrees FROM events)"""
FILES = """
local_files AS (SELECT 'pages/' || page_id || '.html' AS path, length(html) AS size, sha256(html) AS hash FROM pages),
remote_files AS (SELECT 'pages/' || page_id || '.html' AS path, length(h) AS size, sha256(h) AS hash
  FROM (SELECT page_id, regexp_replace(html, '<!-- ad [0-9]+ -->', '', 'g') AS h FROM pages
   WHERE NOT contains(html, 'lang="fr"'))
 UNION ALL SELECT 'notes/' || item_id || '.txt', length(text), sha256(text) FROM benchmark)"""
DERIVATIVES = """
derivatives AS (SELECT printf('%019d', doc_id) AS item_id, CAST(e AS BIGINT) AS long_edge,
 'media/' || printf('%019d', doc_id) || '-' || e || '.webp' AS path, n_chars + e AS bytes
 FROM documents, (VALUES (320, 0), (800, 200), (1600, 2000)) AS s(e, least_chars) WHERE n_chars >= least_chars)"""
TURNS = """
turns AS (SELECT printf('%019d-%019d', conv_id, turn) AS id, conv_id, turn, text, role,
 CASE WHEN turn > 0 THEN printf('%019d-%019d', conv_id, 0) END AS part_of,
 CASE WHEN turn > 0 THEN printf('%019d-%019d', conv_id, turn - 1) END AS after FROM conversations)"""
