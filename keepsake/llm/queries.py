"""The registered queries of this package, each over its whole table, and their SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import (decontaminate, html_text, language, mixing, packing, periods, phrases, secret_scan, simhash, substrings, token_counts, topk,
                          toxicity)
from keepsake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return wrap


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@_query(rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM starts),
least AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (k) WHERE f < doc_id),
one AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its words counted and those removed that windows of 50 words find in an earlier document."""
    out = substrings.without_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@_query()
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id that links of two bits reach."""
    return simhash.near_copies(table(spark, folder, "documents"))


@_query()
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Each document and benchmark item that it holds, with the edits between them."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query()
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    out = mixing.mix(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


@_query()
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the language of most of its letters."""
    return language.predicted(table(spark, folder, "documents"))


@_query()
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens, before and after its repeated lines are edited out."""
    out = token_counts.counted(table(spark, folder, "documents"))
    return out.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded_again")


@_query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""")
def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors of highest inner product for each query."""
    return topk.nearest(table(spark, folder, "embeddings"))


def _secrets_sql() -> str:
    """Matches and the texts between them, lined up and summed to places; pieces of one text are numbered from 1."""
    parts = []
    for rank, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, i, len(gaps[i]) AS gap, len(whole[i]) AS size, len(kept[i]) AS kept, {r.least} AS least
FROM (SELECT doc_id, gaps, whole, kept, unnest(range(1, len(whole) + 1)) AS i FROM (
    SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS whole,
           regexp_extract_all(text, '{pattern}', {r.group}) AS kept
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE regexp_matches(text, '{pattern}')))""")
    return f"""
WITH m AS MATERIALIZED ({" UNION ALL ".join(parts)}),
p AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM m),
s AS (SELECT doc_id, rank, kind, CAST(stop - size AS BIGINT) AS a, CAST(stop AS BIGINT) AS z FROM p WHERE kept >= least),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS x, count(*) FILTER (rank = 1) AS y, count(*) FILTER (rank = 2) AS h,
        string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
        string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(x, 0) AS BIGINT) AS n_assign, CAST(coalesce(y, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)"""


@_query(_secrets_sql())
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its secrets: those of the base rules counted and hashed, and all listed."""
    out = secret_scan.scan(table(spark, folder, "documents"))
    base = F.filter("found", lambda s: s["rank"] < len(secret_scan.BASE))
    number = (lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}"))
    return out.select("doc_id", *[number(r.kind) for r in secret_scan.BASE],
                      F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.col("found")).alias("spans"))


@_query()
def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's main text and its length."""
    out = html_text.main_text(table(spark, folder, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query()
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score for toxicity."""
    return toxicity.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query(r"""
WITH p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(lower_az, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n
                   FROM s, (VALUES (1), (2), (3)) AS t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1 AND n >= 10),
inside AS (SELECT lang, array_to_string(w[j:j + 1], ' ') AS phrase, max(a) AS longer FROM c, (VALUES (1), (2)) AS t(j) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM kept, (VALUES (1), (2)) AS t(j) WHERE j < k),
scored AS (SELECT cuts.*, l.n AS l, r.n AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
           FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst JOIN total USING (lang) QUALIFY rank <= 2000""")
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 strongest collocations of each language."""
    return phrases.collocations(table(spark, folder, "documents"))


@_query()
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 ids, along a Hilbert curve."""
    out = packing.packed(table(spark, folder, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query()
def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's runs, the longest of them, and its words without the repetitions; a tenth of the documents end in a run."""
    out = periods.periodic(periods.with_tails(table(spark, folder, "documents")))
    best = periods.longest(F.col("runs"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(periods.listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
