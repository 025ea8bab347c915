"""The published catalogue (B, C, D, F, I3 and the A sinks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.dates import date_label
from keepsake.functions.search import snippet
from keepsake.operators import catalogue as C
from keepsake.operators import entities as E
from keepsake.operators import links as K
from keepsake.operators import versions as V
from keepsake.operators.scale import numbered, resolve_roots
from keepsake.plans.bindings import DERIVATIVES, FOLDED, MENTIONS, RECORDS, TURNS, VERSIONS, Views, by_digits, padded, title_of
from keepsake.plans.entity_queries import LINKS, number_links, with_ids
from keepsake.plans.registry import query
from keepsake.session import cut

SEARCH = "license released"
PRESENT = """,
shown AS (SELECT * FROM links WHERE item_id IN (SELECT id FROM entries))"""


def date_buckets() -> list[Column]:
    """Follow (date, id) order, down to a thousand ids."""
    return [C.date_key(F.col("date_value")), *by_digits("id")]


def folded(v: Views) -> C.Folded:
    # Both pointers lead to the first of a group, so no chain is longer than one step.
    return C.fold(v.published, date_buckets(), chains=False)


def entry_links(v: Views) -> DataFrame:
    return E.model_links(v.slugged)


@query("catalogue", f"""WITH {FOLDED}, {MENTIONS}, n AS (SELECT item_id, count(*) AS n_entities FROM links GROUP BY ALL),
 b AS (SELECT id, sum(pages_in_part) AS n_pages, sum(length(body)) AS n_chars_folded FROM fparts GROUP BY ALL)
 SELECT e.id, title, type, date_value, CASE WHEN date_display = '' THEN 'Date unknown' WHEN date_source = 'printed'
  THEN date_display ELSE 'about ' || date_display END AS date_label, CAST(n_pages AS BIGINT) AS n_pages,
  CAST(n_chars_folded AS BIGINT) AS n_chars_folded, COALESCE(n_entities, 0) AS n_entities
 FROM entries e JOIN b USING (id) LEFT JOIN n ON n.item_id = e.id""")
def catalogue(v: Views) -> DataFrame:
    """Flagship: entries after folding, with date label, pages, text length and entity count."""
    f = folded(v)
    sizes = f.parts.groupBy("id").agg(F.sum("pages_in_part").alias("n_pages"),
                                      F.sum(F.length("body")).alias("n_chars_folded"))
    counted = entry_links(v).groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("n_entities"))
    return f.entries.join(sizes, "id").join(counted, "id", "left").select(
        "id", "title", "type", "date_value",
        date_label(F.col("date_display"), F.col("date_source")).alias("date_label"), "n_pages", "n_chars_folded",
        F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


PUBLISHED = VERSIONS + """,
live AS (SELECT v.item_id, v.title AS reading, v.model FROM versions v WHERE NOT superseded AND id = (SELECT max(id) FROM versions w
 WHERE w.item_id = v.item_id AND NOT w.superseded)),""" + FOLDED.replace("FROM pointed WHERE ", "FROM pointed WHERE id IN (SELECT item_id FROM live) AND ")


@query("published_catalogue", f"""WITH {PUBLISHED}, {LINKS}, {MENTIONS},
 n AS (SELECT item_id, count(*) AS n_entities FROM links GROUP BY ALL),
 b AS (SELECT id, CAST(sum(pages_in_part) AS BIGINT) AS n_pages FROM fparts GROUP BY ALL),
 r AS (SELECT s.item_id, count(*) AS n_related FROM sym s JOIN entries e ON e.id = s.item_id JOIN entries t ON t.id = s.related_item_id GROUP BY ALL)
 SELECT e.id, reading, model, type, CASE WHEN e.decade = '' THEN 'Undated' ELSE e.decade END AS decade, n_pages, COALESCE(n_related, 0) AS n_related,
 COALESCE(n_entities, 0) AS n_entities, count(*) OVER (PARTITION BY e.decade) AS in_decade
 FROM entries e JOIN live l ON l.item_id = e.id JOIN b ON b.id = e.id LEFT JOIN r ON r.item_id = e.id LEFT JOIN n ON n.item_id = e.id""")
def published_catalogue(v: Views) -> DataFrame:
    """The whole build: current versions, what may be shown, folding, links with both ends, entities and decades, one row per entry."""
    live = cut(V.current(v.versions).select("item_id", F.col("title").alias("reading"), "model"))
    shown = C.publishable(v.pointed, live)
    f = C.fold(shown, date_buckets(), chains=False)
    entries = cut(f.entries.drop("text"))
    links = C.related(entries, with_ids(K.neighbours(number_links(v)).withColumn("reason", F.lit("")))).groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("n_related"))
    names = entry_links(v).groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("n_entities"))
    decades = C.timeline(entries).where("year is null").select("decade", F.col("n").alias("in_decade"))
    pages = f.parts.groupBy("id").agg(F.sum("pages_in_part").alias("n_pages"))
    decade = F.coalesce(F.nullif("decade", F.lit("")), F.lit("Undated"))
    return (entries.withColumn("decade", decade).join(decades, "decade").join(pages, "id").join(links, "id", "left").join(names, "id", "left")
            .select("id", "reading", "model", "type", "decade", "n_pages", F.coalesce("n_related", F.lit(0)).alias("n_related"),
                    F.coalesce("n_entities", F.lit(0)).alias("n_entities"), "in_decade"))


@query("publishable_items", f"WITH {RECORDS} SELECT id, title, status FROM records WHERE status NOT IN ('rejected', 'detected', 'rectified')")
def publishable_items(v: Views) -> DataFrame:
    live = v.records.where("status != 'detected'").select(F.col("id").alias("item_id"), "title")
    return C.publishable(v.records.select("id", "status"), live).select("id", "title", "status")


@query("approved_items", f"WITH {RECORDS} SELECT id, title FROM records WHERE status = 'approved'")
def approved_items(v: Views) -> DataFrame:
    live = v.records.select(F.col("id").alias("item_id"), "title")
    return C.publishable(v.records.select("id", "status"), live, approved_only=True).select("id", "title")


@query("chronological_positions", f"""WITH {RECORDS} SELECT id, row_number() OVER (ORDER BY COALESCE(NULLIF(date_value, ''), '9999'), id)
 AS position FROM records""")
def chronological_positions(v: Views) -> DataFrame:
    rows = v.records.select("id", "date_value")
    return numbered(rows, [], C.chronological(), date_buckets(), "position").select("id", "position")


@query("folded_entries", f"WITH {FOLDED} SELECT id, title FROM entries")
def folded_entries(v: Views) -> DataFrame:
    return folded(v).entries.select("id", "title")


@query("folded_pages", f"WITH {FOLDED} SELECT parent_id, page_no, id FROM fpages")
def folded_pages(v: Views) -> DataFrame:
    return folded(v).pages.select("parent_id", "page_no", "id")


@query("folded_texts", f"WITH {FOLDED} SELECT id, part, pages_in_part, body FROM fparts")
def folded_texts(v: Views) -> DataFrame:
    return folded(v).parts


@query("duplicates_dropped", f"WITH {FOLDED} SELECT id FROM published WHERE id NOT IN (SELECT id FROM kept)")
def duplicates_dropped(v: Views) -> DataFrame:
    return C.present_target(v.published, "duplicate_of", "__copy").where("__copy").select("id")


@query("conversation_entries", f"""WITH {TURNS}, p AS (SELECT * FROM turns t WHERE EXISTS (SELECT 1 FROM turns q WHERE q.id = t.part_of)),
 texts AS (SELECT id, 0 AS page_no, text FROM turns t WHERE id NOT IN (SELECT id FROM p)
  UNION ALL SELECT part_of, row_number() OVER (PARTITION BY part_of ORDER BY id), text FROM p)
 SELECT id, page_no // 64 AS part, count(*) FILTER (page_no > 0) AS pages_in_part,
  regexp_replace(COALESCE(string_agg(text, chr(10) || chr(10) ORDER BY page_no) FILTER (text <> ''), ''), '^\\s+|\\s+$', '', 'g') AS body
 FROM texts GROUP BY ALL""")
def conversation_entries(v: Views) -> DataFrame:
    return C.fold(v.turns, [F.substring("id", 1, 19), F.substring("id", 21, 13), F.substring("id", 34, 3)], chains=False).parts


@query("chain_roots", """WITH RECURSIVE t AS (SELECT conv_id, turn FROM conversations),
 r AS (SELECT conv_id, turn, turn AS root FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1)
  UNION ALL SELECT t.conv_id, t.turn, r.root FROM t JOIN r ON t.conv_id = r.conv_id AND t.turn = r.turn + 1)
 SELECT printf('%019d-%019d', conv_id, turn) AS id, printf('%019d-%019d', conv_id, root) AS root FROM r""")
def chain_roots(v: Views) -> DataFrame:
    """Each turn points at the one before it; the chain ends where a turn is missing."""
    return resolve_roots(v.turns.select("id", "after"), "id", "after")


@query("related_entries", f"""WITH {FOLDED}, {LINKS} SELECT s.item_id, s.related_item_id, t.title, t.type, t.date_display, s.reason,
 row_number() OVER (PARTITION BY s.item_id ORDER BY t.date_display, t.title, t.id) AS position
 FROM sym s JOIN entries e ON e.id = s.item_id JOIN entries t ON t.id = s.related_item_id""")
def related_entries(v: Views) -> DataFrame:
    # Cards and, as numbering reads its input twice, joined edges are written first; of links only those between entries are settled.
    cards = cut(folded(v).entries.select("id", "doc_id", "title", "type", "date_display"))
    links = K.symmetric(K.between(number_links(v), cards.select("doc_id")))
    return C.ordered_related(cut(C.related(cards, with_ids(links))))


@query("timeline", f"""WITH {FOLDED}, d AS (SELECT COALESCE(NULLIF(decade, ''), 'Undated') AS decade, COALESCE(NULLIF(year, ''), 'Undated') AS year
 FROM entries) SELECT decade, year, count(*) AS n FROM d GROUP BY GROUPING SETS ((decade, year), (decade))""")
def timeline(v: Views) -> DataFrame:
    return C.timeline(folded(v).entries).orderBy(*C.timeline_order())


@query("timeline_items", f"""WITH {FOLDED} SELECT COALESCE(NULLIF(decade, ''), 'Undated') AS decade, id,
 row_number() OVER (PARTITION BY COALESCE(NULLIF(decade, ''), 'Undated') ORDER BY COALESCE(NULLIF(date_value, ''), '9999'), id) AS position
 FROM entries""")
def timeline_items(v: Views) -> DataFrame:
    rows = cut(folded(v).entries.select(
        "id", "date_value", F.coalesce(F.nullif("decade", F.lit("")), F.lit("Undated")).alias("decade")))
    return numbered(rows, ["decade"], C.chronological(), date_buckets(), "position").select("decade", "id", "position")


@query("catalogue_counts", f"""WITH {FOLDED}, {MENTIONS} {PRESENT}, k AS (SELECT DISTINCT kind, slug FROM shown)
 SELECT (SELECT count(*) FROM entries) AS items, (SELECT count(*) FROM entries WHERE date_value <> '') AS dated,
 (SELECT count(*) FROM k WHERE kind = 'person') AS people, (SELECT count(*) FROM k WHERE kind = 'place') AS places,
 (SELECT count(*) FROM k WHERE kind = 'organization') AS organizations, (SELECT count(*) FROM k WHERE kind = 'topic') AS topics""")
def catalogue_counts(v: Views) -> DataFrame:
    return C.catalogue_counts(folded(v).entries, entry_links(v))


@query("build_summary", f"""WITH {FOLDED}, {MENTIONS} {PRESENT}, {DERIVATIVES},
 m AS (SELECT * FROM derivatives WHERE item_id IN (SELECT id FROM entries UNION ALL SELECT id FROM fpages))
 SELECT (SELECT count(*) FROM entries) AS items, (SELECT count(DISTINCT COALESCE(NULLIF(decade, ''), 'Undated')) FROM entries) AS decades,
 (SELECT count(*) FROM published WHERE status <> 'approved') AS unapproved, (SELECT count(*) FROM m) AS media_files,
 (SELECT CAST(sum(bytes) AS BIGINT) FROM m) AS media_bytes,
 (SELECT count(*) FROM (SELECT DISTINCT kind, slug FROM shown)) AS entities""")
def build_summary(v: Views) -> DataFrame:
    f = folded(v)
    media = C.media_manifest(f.entries, f.pages, v.derivatives)
    return C.build_summary(v.published, f.entries, media, entry_links(v))


@query("media_manifest", f"""WITH {FOLDED}, {DERIVATIVES} SELECT item_id, path, bytes FROM derivatives
 WHERE item_id IN (SELECT id FROM entries UNION ALL SELECT id FROM fpages)""")
def media_manifest(v: Views) -> DataFrame:
    f = folded(v)
    return C.media_manifest(f.entries, f.pages, v.derivatives).select("item_id", "path", "bytes")


@query("nested_catalogue", f"""WITH {FOLDED}, {MENTIONS}, n AS (SELECT item_id, string_agg(kind || ':' || name, '|' ORDER BY kind, name, slug)
  AS names FROM links JOIN ents USING (kind, slug) GROUP BY ALL)
 SELECT COALESCE(NULLIF(decade, ''), 'Undated') AS decade, e.id, title, part, body, n.names
 FROM entries e JOIN fparts USING (id) LEFT JOIN n ON n.item_id = e.id""")
def nested_catalogue(v: Views) -> DataFrame:
    f = folded(v)
    names = E.item_names(entry_links(v), E.entities(v.slugged))
    return C.nested_catalogue(f.entries, names, f.parts).select(
        "decade", "id", "title", "part", "body", F.array_join(F.transform(
            "entities", lambda e: F.concat(e.kind, F.lit(":"), e["name"])), "|").alias("names"))


@query("type_facets", f"WITH {FOLDED} SELECT type, count(*) AS n FROM entries GROUP BY type")
def type_facets(v: Views) -> DataFrame:
    return C.facets(folded(v).entries)


@query("gallery_of_letters", f"WITH {FOLDED} SELECT id, title FROM entries WHERE type = 'letter'")
def gallery_of_letters(v: Views) -> DataFrame:
    return folded(v).entries.where("type = 'letter'").select("id", "title")


@query("first_photographs", f"""WITH {FOLDED} SELECT id, title FROM entries WHERE type = 'photograph'
 ORDER BY COALESCE(NULLIF(date_value, ''), '9999'), id LIMIT 8""")
def first_photographs(v: Views) -> DataFrame:
    """The eight photographs that the front page shows."""
    return folded(v).entries.where("type = 'photograph'").orderBy(*C.chronological()).limit(8).select("id", "title")


@query("unidentified_photographs", f"""WITH {FOLDED}, {MENTIONS} SELECT id FROM entries WHERE type = 'photograph'
 AND id NOT IN (SELECT item_id FROM links WHERE kind = 'person')""")
def unidentified_photographs(v: Views) -> DataFrame:
    return C.unidentified(folded(v).entries, entry_links(v)).select("id")


@query("markdown_articles", f"""WITH {RECORDS}, r AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS ft FROM records)
 SELECT id AS item_id, '---' || chr(10) || 'title: "' || title || '"' || chr(10)
 || CASE WHEN date_value <> '' THEN 'date: ' || date_value || chr(10) || 'date_source: ' || date_source || chr(10) ELSE '' END
 || 'item_type: ' || type || chr(10) || 'people: [' || source || ', ' || lang || ']' || chr(10) || '---' || chr(10) || chr(10)
 || title || chr(10) || repeat('=', greatest(3, length(title))) || chr(10) || chr(10)
 || CASE WHEN flagged THEN '*to check*' || chr(10) || chr(10) ELSE '' END || ft || chr(10) AS markdown
 FROM r WHERE presentation IN ('text', 'both') AND ft <> ''""")
def markdown_articles(v: Views) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = v.records.select(
        F.col("id").alias("item_id"), "title", "date_value", "date_source", F.col("type").alias("item_type"),
        "presentation", C.stripped(F.col("text")).alias("full_text"),
        F.when(F.col("flagged"), "to check").otherwise("").alias("summary"), F.lit("").alias("visual_description"),
        F.lit("").alias("club_context"), F.array("source", "lang").alias("people"), none.alias("organizations"),
        none.alias("places"), none.alias("topics"))
    return rows.select("item_id", C.markdown().alias("markdown")).where("markdown is not null")


# ---- search --------------------------------------------------------------------

TERMS = SEARCH.split()


def _points(term: str) -> str:
    return (f"(CASE WHEN contains(lower(title), '{term}') THEN 10 ELSE 0 END + CASE WHEN contains(lower(names), '{term}') THEN 6 ELSE 0 END"
            f" + CASE WHEN contains(lower(body), '{term}') THEN 2 ELSE 0 END + CASE WHEN contains(date_value, '{term}') THEN 4 ELSE 0 END)")


SEARCHED = FOLDED + "," + MENTIONS + """,
n AS (SELECT item_id, string_agg(name, ' ') AS names FROM links JOIN ents USING (kind, slug) GROUP BY ALL),
b AS (SELECT id, string_agg(body, ' ') AS body FROM fparts GROUP BY ALL),
docs AS (SELECT e.id, title, COALESCE(names, '') AS names, title || ' ' || body AS body, date_value FROM entries e JOIN b USING (id)
 LEFT JOIN n ON n.item_id = e.id)""" + f""",
hits AS (SELECT id, title, {' + '.join(_points(t) for t in TERMS)} AS score FROM docs WHERE {' AND '.join(_points(t) + ' > 0' for t in TERMS)})"""


def searched(v: Views, text: str, limit: int = 100) -> DataFrame:
    roles = cut(C.roles(v.published, date_buckets(), chains=False))
    own = roles.where("parent_id is null").select("id", F.col("id").alias("root"))
    titles = v.t("documents").select(padded(F.col("doc_id")).alias("id"), title_of("text").alias("text"))
    bodies = v.t("documents").select(padded(F.col("doc_id")).alias("id"), "text")
    # A name is looked at once for all who bear it.
    known = C.term_flags(E.entities(v.slugged).select(F.struct("kind", "slug").alias("id"), F.col("name").alias("text")), text).select("id.*", "*").drop("id")
    flags = [c for c in known.columns if c not in ("kind", "slug")]
    names = (entry_links(v).join(known, ["kind", "slug"]).groupBy(F.col("item_id").alias("id"))
             .agg(*[F.bool_or(c).alias(c) for c in flags])) if flags else known.select(F.lit("").alias("id"))
    dates = v.published.select("id", "date_value").join(own.select("id"), "id", "left_semi")
    found = C.search(dates, C.term_flags(titles, text, own), names,
                     C.term_flags(bodies, text, roles.select("id", F.coalesce("parent_id", "id").alias("root"))), text, limit)
    # Titles are fetched for what is shown only.
    shown = titles.join(found, "id").select("id", F.col("text").alias("title"), "date_value", "score")
    return shown.orderBy(F.col("score").desc(), *C.chronological())


@query("search_top_100", f"""WITH {SEARCHED} SELECT h.id, h.title, score FROM hits h JOIN entries e USING (id)
 ORDER BY score DESC, COALESCE(NULLIF(e.date_value, ''), '9999'), h.id LIMIT 100""")
def search_top_100(v: Views) -> DataFrame:
    return searched(v, SEARCH).select("id", "title", "score")


@query("search_by_year", f"""WITH {FOLDED}, s AS (SELECT id, title, date_value, CASE WHEN contains(lower(title), '1998') THEN 10 ELSE 0 END
  + CASE WHEN contains(date_value, '1998') THEN 4 ELSE 0 END + CASE WHEN contains(lower(title || ' ' || body), '1998') THEN 2 ELSE 0 END AS score
  FROM entries JOIN (SELECT id, string_agg(body, ' ') AS body FROM fparts GROUP BY ALL) USING (id))
 SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, COALESCE(NULLIF(date_value, ''), '9999'), id LIMIT 100""")
def search_by_year(v: Views) -> DataFrame:
    return searched(v, "1998").select("id", "score")


@query("snippets", f"""WITH {RECORDS}, t AS (SELECT id, text, strpos(lower(text), 'license') - 1 AS pos FROM records)
 SELECT id, CASE WHEN text = '' THEN '' WHEN pos < 0 THEN left(text, 180) || CASE WHEN length(text) > 180 THEN '…' ELSE '' END
  ELSE CASE WHEN pos > 70 THEN '…' ELSE '' END || regexp_replace(substr(text, greatest(0, pos - 70) + 1, pos + 130 - greatest(0, pos - 70)),
   '(license)', '<mark>\\1</mark>', 'gi') || '…' END AS snippet FROM t""")
def snippets(v: Views) -> DataFrame:
    return v.records.select("id", snippet(F.col("text"), SEARCH).alias("snippet"))


# ---- image sizes -----------------------------------------------------------------


@query("image_sizes", f"""WITH {DERIVATIVES} SELECT item_id, string_agg(CAST(long_edge AS VARCHAR), ',' ORDER BY long_edge) AS sizes,
 COALESCE(min(long_edge) FILTER (long_edge >= 800), max(long_edge)) AS card,
 arg_min(long_edge, (abs(long_edge - 1200), -long_edge)) AS sent,
 CASE WHEN bool_or(long_edge = 800) THEN 800 WHEN bool_or(long_edge = 1600) THEN 1600 WHEN bool_or(long_edge = 320) THEN 320 END AS grid
 FROM derivatives GROUP BY ALL""")
def image_sizes(v: Views) -> DataFrame:
    size = F.col("long_edge")
    return v.derivatives.groupBy("item_id").agg(
        F.array_join(F.array_sort(F.collect_list("long_edge")), ",").alias("sizes"),
        K.at_least_size(size, F.lit(800)).alias("card"), K.nearest_size(size, F.lit(1200)).alias("sent"),
        K.preferred_size(size).alias("grid"))


@query("part_sizes", """SELECT p_brand, COALESCE(min(p_size) FILTER (p_size >= 20), max(p_size)) AS at_least_20,
 arg_min(p_size, (abs(p_size - 24), -p_size)) AS nearest_24 FROM part GROUP BY ALL""")
def part_sizes(v: Views) -> DataFrame:
    size = F.col("p_size")
    return v.t("part").groupBy("p_brand").agg(K.at_least_size(size, F.lit(20)).alias("at_least_20"),
                                              K.nearest_size(size, F.lit(24)).alias("nearest_24"))
