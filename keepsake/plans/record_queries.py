"""Replies to records, dates, versions and history (categories H text, E, J1, J2, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import dates as D
from keepsake.functions.replies import extract_json
from keepsake.functions.slug import slugify
from keepsake.operators import inference as I
from keepsake.operators import versions as V
from keepsake.operators import workflow as W
from keepsake.operators.normalise import decide_review, normalise
from keepsake.plans.bindings import RECORDS, SLUG_MACRO, VERSIONS, Views, by_range, padded, title_of
from keepsake.plans.registry import query
from keepsake.session import cut
from keepsake.sources.tables import spread

CLEAN = RECORDS + r""",
clean AS (SELECT *, CASE lang WHEN 'en' THEN 'newspaper_clipping' WHEN 'fr' THEN 'photograph' WHEN 'de' THEN 'other'
  ELSE 'letter' END AS item_type, regexp_replace(text, '^\s+|\s+$', '', 'g') AS full_text,
 source || '|' || lang AS people, source AS places, CAST(greatest(1, least(5, n_chars % 8)) AS BIGINT) AS legibility,
 CASE WHEN n_chars % 150 > 1 THEN least(1.0, CAST(n_chars % 150 AS DOUBLE) / 100) ELSE CAST(n_chars % 150 AS DOUBLE) END AS confidence,
 CASE WHEN quality = 0 THEN 'rotate_180' ELSE 'upright' END AS orientation_hint,
 CASE WHEN flagged THEN 'check the wording' ELSE '' END AS model_reason FROM records),
warned AS (SELECT *, list_filter([
  CASE WHEN legibility <= 2 THEN 'low legibility' END,
  CASE WHEN confidence < 0.6 THEN 'low model confidence (' || printf('%.2f', confidence) || ')' END,
  CASE WHEN date_source = 'inferred' THEN 'date inferred rather than printed' END,
  CASE WHEN orientation_hint <> 'upright' THEN 'may need rotating (' || orientation_hint || ')' END,
  CASE WHEN presentation <> 'image' AND full_text = '' THEN 'marked as text but no transcription returned' END,
  CASE WHEN date_source = 'printed' AND full_text = '' THEN 'date claimed as printed but nothing was transcribed' END,
  CASE WHEN presentation = 'image' AND full_text = '' THEN 'nothing describing the picture, so it cannot be found' END,
  CASE WHEN title = '' THEN 'no title' END], lambda x: x IS NOT NULL) AS warnings FROM clean),
reviewed AS (SELECT *, flagged OR len(warnings) > 0 AS needs_human_review, NULLIF(left(array_to_string(list_filter(
  list_concat([NULLIF(model_reason, '')], warnings), lambda x: x IS NOT NULL), '; '), 600), '') AS review_reason FROM warned)"""


def records_from_replies(v: Views) -> DataFrame:
    return normalise(extract_json(v.replies, "reply"))


@query("json_extraction", f"""WITH {RECORDS} SELECT id AS item_id, split_part(text, chr(10), 1) AS title, CASE presentation WHEN 'text' THEN 'whole'
 WHEN 'both' THEN 'fenced' ELSE 'span' END AS tier FROM records""")
def json_extraction(v: Views) -> DataFrame:
    return extract_json(v.replies, "reply").select(
        "item_id", F.try_variant_get("data", "$.title", "string").alias("title"), "tier")


@query("event_payloads", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 CASE event_type WHEN 'click' THEN 'fenced' WHEN 'view' THEN 'span' ELSE 'whole' END AS tier FROM events""")
def event_payloads(v: Views) -> DataFrame:
    p = F.col("props")
    text = (F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), p, F.lit("\n```")))
            .when(F.col("event_type") == "view", F.concat(F.lit('So {"a": "}" '), F.lit(', "p": '), p, F.lit("} it is")))
            .otherwise(p))
    rows = v.t("events").select("event_id", text.alias("reply"), (F.col("event_type") == "view").alias("deep"))
    got = extract_json(rows, "reply")
    k = F.coalesce(F.try_variant_get("data", "$.k", "bigint"), F.try_variant_get("data", "$.p.k", "bigint"))
    return got.select("event_id", k.alias("k"), "tier")


@query("normalised_records", f"""WITH {CLEAN} SELECT id AS item_id, item_type, title, full_text, date_value, date_precision,
 date_source, people, places, presentation, legibility, confidence, orientation_hint, flagged AS needs_human_review,
 model_reason AS review_reason FROM clean""")
def normalised_records(v: Views) -> DataFrame:
    clean = records_from_replies(v)
    return clean.select("item_id", "item_type", "title", "full_text", "date_value", "date_precision", "date_source",
                        F.array_join("people", "|").alias("people"), F.array_join("places", "|").alias("places"),
                        "presentation", "legibility", "confidence", "orientation_hint", "needs_human_review",
                        "review_reason")


@query("review_decisions", f"""WITH {CLEAN} SELECT id AS item_id, needs_human_review, review_reason,
 array_to_string(warnings, '|') AS warnings FROM reviewed""")
def review_decisions(v: Views) -> DataFrame:
    return decide_review(records_from_replies(v)).select(
        "item_id", "needs_human_review", "review_reason", F.array_join("warnings", "|").alias("warnings"))


@query("title_slugs", f"WITH {RECORDS}, s AS (SELECT id, title, {SLUG_MACRO.format('title')} AS slug FROM records) "
       r"SELECT id, CASE WHEN slug <> '' THEN slug ELSE regexp_replace(lower(title), '\s+', '-', 'g') END AS slug FROM s")
def title_slugs(v: Views) -> DataFrame:
    return spread(v.t("documents")).select(padded(F.col("doc_id")).alias("id"), title_of("text").alias("title")).select(
        "id", slugify(F.col("title")).alias("slug"))


@query("date_labels", f"""WITH {RECORDS} SELECT id, decade, year, date_display,
 CASE WHEN date_display = '' THEN 'Date unknown' WHEN date_source = 'printed' THEN date_display
  ELSE 'about ' || date_display END AS label,
 CASE WHEN date_value = '' THEN 'no date' WHEN date_source = 'printed' THEN date_value ELSE '~' || date_value END AS review_label
 FROM records""")
def date_labels(v: Views) -> DataFrame:
    return v.records.select("id", "decade", "year", "date_display",
                            D.date_label(F.col("date_display"), F.col("date_source")).alias("label"),
                            D.review_date_label(F.col("date_value"), F.col("date_source")).alias("review_label"))


# ---- versions ----------------------------------------------------------------

CURRENT = VERSIONS + """,
live AS (SELECT * FROM versions v WHERE NOT superseded AND id = (SELECT max(id) FROM versions w
 WHERE w.item_id = v.item_id AND NOT w.superseded))"""
EDITS = """
edits AS (SELECT printf('%019d', user_id) AS item_id, max(event_id) + 1000000000 AS version_id,
 arg_max(props, event_id) AS title, arg_max(event_type, event_id) AS item_type FROM events
 WHERE event_type IN ('error', 'signup') GROUP BY user_id)"""


def edits(v: Views) -> DataFrame:
    """Each user's last error or signup, as a correction of title and type."""
    e = v.t("events").where(F.col("event_type").isin("error", "signup"))
    last = e.groupBy("user_id").agg(F.max(F.struct("event_id", "props", "event_type")).alias("e"))
    return last.select(F.format_string("%019d", "user_id").alias("item_id"),
                       (F.col("e.event_id") + 1000000000).alias("version_id"),
                       F.create_map(F.lit("title"), F.col("e.props"), F.lit("item_type"), F.col("e.event_type")).alias("fields"))


@query("current_versions", f"WITH {CURRENT} SELECT item_id, id, model, item_type, title, summary FROM live")
def current_versions(v: Views) -> DataFrame:
    return V.current(v.versions).select("item_id", "id", "model", "item_type", "title", "summary")


@query("append_versions", f"""WITH {VERSIONS}, {EDITS}, f AS (SELECT item_id, version_id AS id, item_type, title FROM edits)
 SELECT item_id, id, superseded OR item_id IN (SELECT item_id FROM f) AS superseded, item_type, title FROM versions
 UNION ALL SELECT item_id, id, FALSE, item_type, title FROM f""")
def append_versions(v: Views) -> DataFrame:
    fresh = edits(v).select("item_id", F.col("version_id").alias("id"),
                            F.try_element_at("fields", F.lit("item_type")).alias("item_type"),
                            F.try_element_at("fields", F.lit("title")).alias("title"))
    old = v.versions.select("item_id", "id", "superseded", "item_type", "title")
    return V.append(old, fresh)


@query("human_revisions", f"""WITH {CURRENT}, {EDITS} SELECT l.item_id, e.version_id AS id, 'human' AS provider, l.model,
 e.item_type, e.title, l.summary, FALSE AS superseded FROM live l JOIN edits e USING (item_id)
 WHERE e.title <> l.title OR e.item_type <> l.item_type""")
def human_revisions(v: Views) -> DataFrame:
    live = V.current(v.versions)
    wanted = V.changed_only(edits(v), live, ["title", "item_type"])
    return V.revise(live, wanted, ["title", "item_type"]).select(
        "item_id", "id", "provider", "model", "item_type", "title", "summary", "superseded")


@query("editable_guard", """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'confidence' WHEN 'error' THEN 'confidence,legibility'
 ELSE '' END AS unknown, event_type NOT IN ('purchase', 'error') AS accepted FROM events""")
def editable_guard(v: Views) -> DataFrame:
    value = F.col("value").cast("string")
    fields = (F.when(F.col("event_type") == "purchase", F.create_map(F.lit("title"), F.col("props"), F.lit("confidence"), value))
              .when(F.col("event_type") == "error", F.create_map(F.lit("legibility"), value, F.lit("confidence"), value))
              .otherwise(F.create_map(F.lit("title"), F.col("props"), F.lit("date_value"), value)))
    got = V.split_edits(v.t("events").select("event_id", fields.alias("fields")))
    return got.select("event_id", F.array_join("unknown_fields", ",").alias("unknown"), "accepted")


@query("version_history", f"""WITH {VERSIONS}, h AS (SELECT *, lag(id) OVER w AS before, lag(model) OVER w AS m,
  lag(item_type) OVER w AS t, lag(title) OVER w AS ti FROM versions WINDOW w AS (PARTITION BY item_id ORDER BY id))
 SELECT item_id, id, CASE WHEN before IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN model <> m THEN 'model' END,
  CASE WHEN item_type <> t THEN 'item_type' END, CASE WHEN title <> ti THEN 'title' END], lambda x: x IS NOT NULL), ',') END AS changed
 FROM h""")
def version_history(v: Views) -> DataFrame:
    got = V.history(v.versions, ["model", "item_type", "title"], by_range("id"))
    return got.select("item_id", "id", F.array_join("changed_fields", ",").alias("changed"))


# ---- inference -----------------------------------------------------------------


def local_reader():
    """A deterministic stand-in for a model: the reply is a summary of the text, a token is a word."""

    def answer(item_id: str, context: str) -> I.Reply:
        words = context.split()
        if not words:
            raise ValueError("nothing to read")
        if len(words) < 20:
            raise LookupError("too little to read")
        return I.Reply(f"{len(words)} words, first {words[0]}", len(words), 4, "local", "first-word")

    return answer


READ = r"""
jobs AS (SELECT printf('%019d', doc_id) AS item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws,
 lang FROM documents),
res AS (SELECT item_id, lang, len(ws) >= 20 AS ok, CASE WHEN len(ws) >= 20 THEN len(ws) || ' words, first ' || ws[1] END AS reply,
 CASE WHEN len(ws) = 0 THEN 'ValueError: nothing to read' WHEN len(ws) < 20 THEN 'LookupError: too little to read' END AS error
 FROM jobs)"""


def jobs(v: Views) -> DataFrame:
    return v.t("documents").select(F.format_string("%019d", "doc_id").alias("item_id"), F.col("text").alias("context"))


@query("batch_inference", f"""WITH {READ} SELECT item_id, ok, reply, error, CASE WHEN ok THEN 'local' END AS provider, CASE WHEN ok THEN 'first-word' END AS model,
 CASE WHEN ok THEN CAST(len(ws) AS BIGINT) END AS input_tokens, CASE WHEN ok THEN CAST(4 AS BIGINT) END AS output_tokens
 FROM res JOIN jobs USING (item_id)""")
def batch_inference(v: Views) -> DataFrame:
    return I.run_jobs(jobs(v), local_reader).select("item_id", "ok", "reply", "error", "provider", "model", "usage.input_tokens", "usage.output_tokens")


@query("reconciled_results", f"""WITH {READ} SELECT item_id, CASE WHEN lang = 'de' THEN FALSE ELSE ok END AS ok,
 CASE WHEN lang = 'de' THEN NULL ELSE reply END AS reply,
 CASE WHEN lang = 'de' THEN 'missing from batch results' ELSE error END AS error FROM res""")
def reconciled_results(v: Views) -> DataFrame:
    """Results that came back for all but the German texts."""
    returned = v.t("documents").where("lang != 'de'").select(
        F.format_string("%019d", "doc_id").alias("item_id"), F.col("text").alias("context"))
    return I.reconcile(jobs(v), I.run_jobs(returned, local_reader)).select("item_id", "ok", "reply", "error")


@query("item_errors", f"""WITH {READ} SELECT r.item_id, CASE WHEN n_chars < 100 THEN 'no image' ELSE error END AS error
 FROM res r JOIN documents d ON r.item_id = printf('%019d', d.doc_id) WHERE n_chars < 100 OR NOT ok""")
def item_errors(v: Views) -> DataFrame:
    """Why each item of a run failed."""
    d = v.t("documents").select(padded(F.col("doc_id")).alias("item_id"), (F.col("n_chars") >= 100).alias("has_image"))
    with_image = jobs(v).join(d.where("has_image").select("item_id"), "item_id", "left_semi")
    return I.failures(d.join(I.run_jobs(with_image, local_reader), "item_id", "left"))


def stored_replies():
    """A stand-in for a model that gives back the reply it is handed."""

    def answer(item_id: str, context: str) -> I.Reply:
        if not context:
            raise LookupError("no reply")
        return I.Reply(context, len(context), len(context), "local", "stored")

    return answer


@query("analysed_items", f"""WITH {CLEAN},
 read AS (SELECT * FROM reviewed WHERE status <> 'rejected' AND status <> 'approved' AND n_chars >= 100 AND n_chars % 11 <> 0)
 SELECT i.id, CASE WHEN r.id IS NOT NULL THEN 'analyzed' ELSE i.status END AS status,
 CASE WHEN r.id IS NOT NULL THEN r.needs_human_review ELSE i.flagged END AS needs_human_review, r.review_reason, r.item_type, r.title,
 CASE WHEN r.id IS NOT NULL THEN 'stored' END AS model FROM records i LEFT JOIN read r USING (id)""")
def analysed_items(v: Views) -> DataFrame:
    """The whole loop: choose what is still to be read, ask, match by id, repair, review, append a version, mark as read.

    Approved records have been read before; one reply in eleven fails.
    """
    records = cut(v.records.select("id", "status", "n_chars", F.col("flagged").alias("needs_human_review"), F.lit(None).cast("string").alias("review_reason"),
                                   F.when(F.col("n_chars") >= 100, F.concat(F.lit("masters/"), "id")).alias("master_path")))
    earlier = records.where("status = 'approved'").select(F.col("id").alias("item_id"), F.lit(0).cast("long").alias("id"), F.lit(False).alias("superseded"))
    work = W.pending_work(records, V.current(earlier).select("item_id")).select(F.col("id").alias("item_id"), "n_chars")
    asked = v.replies.join(work, "item_id").select("item_id", F.when(F.col("n_chars") % 11 != 0, F.col("reply")).otherwise("").alias("context"))
    results = I.reconcile(asked, cut(I.run_jobs(asked, stored_replies)))
    clean = decide_review(normalise(extract_json(results.where("ok"), "reply")))
    fresh = cut(clean.select("item_id", F.lit(1).cast("long").alias("id"), "item_type", "title", "needs_human_review", "review_reason", "provider", "model"))
    live = V.current(V.append(earlier, fresh)).select(F.col("item_id").alias("id"), "item_type", "title", "model")
    return V.mark_read(records, fresh).join(live, "id", "left").select("id", "status", "needs_human_review", "review_reason", "item_type", "title", "model")


@query("run_summary", f"""WITH {READ}, o AS (SELECT r.ok, d.n_chars >= 100 AS has_image, d.n_chars % 8 <= 2 AS flagged
 FROM res r JOIN documents d ON r.item_id = printf('%019d', d.doc_id))
 SELECT count(*) FILTER (has_image) AS attempted, count(*) FILTER (has_image AND ok) AS succeeded,
 count(*) FILTER (NOT (has_image AND ok)) AS failed, count(*) FILTER (has_image AND ok AND flagged) AS flagged FROM o""")
def run_summary(v: Views) -> DataFrame:
    d = v.t("documents").select(F.format_string("%019d", "doc_id").alias("item_id"), "n_chars")
    with_image = v.t("documents").where("n_chars >= 100").select(
        F.format_string("%019d", "doc_id").alias("item_id"), F.col("text").alias("context"))
    # Written once, so that the function is not run again by a second reader of its rows.
    results = cut(I.run_jobs(with_image, local_reader))
    rows = d.join(results, "item_id", "left").select(
        (F.col("n_chars") >= 100).alias("has_image"), "ok", (F.col("n_chars") % 8 <= 2).alias("flagged"))
    return I.run_summary(rows)
