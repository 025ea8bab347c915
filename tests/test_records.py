"""Replies, clean records, versions, entities, workflow."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from keepsake.functions.replies import extract_json
from keepsake.operators import entities as E
from keepsake.operators import inference as I
from keepsake.operators import versions as V
from keepsake.operators import workflow as W
from keepsake.operators.normalise import decide_review, normalise

GOOD = {"item_type": "newspaper_clipping", "title": "A new wing opens", "summary": "s", "full_text": "words",
        "date_value": "1962-07-14", "date_precision": "day", "date_source": "printed", "date_note": "",
        "people": ["Ada Lowe", "Ben Marsh"], "organizations": ["Garden Club", "Hospital"], "places": ["Town"],
        "topics": ["polio", "youth", "fundraising"], "presentation": "both", "legibility": 4, "condition_notes": "",
        "alt_text": "a clipping", "visual_description": "", "club_context": "", "orientation_hint": "upright",
        "confidence": 0.93, "needs_human_review": False, "review_reason": ""}


def clean(spark, *changes):
    rows = [(i, json.dumps({**GOOD, **c} if c is not None else {})) for i, c in enumerate(changes)]
    df = spark.createDataFrame(rows, "n int, reply string")
    return decide_review(normalise(extract_json(df, "reply"))).orderBy("n").collect()


def test_a_good_reply_passes_through(spark):
    r = clean(spark, {})[0]
    assert r.item_type == "newspaper_clipping" and r.people == ["Ada Lowe", "Ben Marsh"]
    assert r.confidence == 0.93 and r.warnings == [] and not r.needs_human_review and r.review_reason is None


def test_near_misses_are_repaired(spark):
    rows = clean(spark, {"people": "Ada Lowe, Ben Marsh"}, {"topics": ["Polio", "polio", "POLIO "]},
                 {"confidence": 85}, {"confidence": -1}, {"confidence": 2000}, {"legibility": 0}, {"legibility": 9},
                 {"legibility": "high"}, {"legibility": None}, {"legibility": 3.7}, {"legibility": "3.7"},
                 {"item_type": "papyrus_scroll"}, None, {"date_value": ""}, {"needs_human_review": "false"},
                 {"people": 7}, {"legibility": True}, {"title": None})
    assert rows[0].people == ["Ada Lowe", "Ben Marsh"]
    assert rows[1].topics == ["Polio"]
    assert [r.confidence for r in rows[2:5]] == [0.85, 0.0, 1.0]
    assert [r.legibility for r in rows[5:11]] == [1, 5, 3, 3, 3, 3]
    assert rows[11].item_type == "other"
    empty = rows[12]
    assert (empty.item_type, empty.people, empty.date_source, empty.legibility, empty.confidence) == ("other", [], "unknown", 3, 0.5)
    assert (rows[13].date_source, rows[13].date_precision) == ("unknown", "unknown")
    assert not rows[14].needs_human_review
    assert rows[15].people == [] and rows[16].legibility == 1 and rows[17].title == ""


def test_limits(spark):
    r = clean(spark, {"title": "t" * 400, "date_note": "n" * 2000, "full_text": "f" * 5000})[0]
    assert (len(r.title), len(r.date_note), len(r.full_text)) == (300, 1000, 5000)


@pytest.mark.parametrize("change,fragment", [
    ({"legibility": 1}, "low legibility"), ({"confidence": 0.2}, "low model confidence (0.20)"),
    ({"date_source": "inferred"}, "date inferred"), ({"orientation_hint": "rotate_90_cw"}, "may need rotating (rotate_90_cw)"),
    ({"title": ""}, "no title"), ({"presentation": "text", "full_text": ""}, "no transcription"),
    ({"presentation": "image", "full_text": ""}, "printed but nothing was transcribed"),
    ({"presentation": "image", "full_text": "", "date_value": ""}, "cannot be found"),
])
def test_warnings(spark, change, fragment):
    assert any(fragment in w for w in clean(spark, change)[0].warnings)


def test_review_reason_order_and_cut(spark):
    r = clean(spark, {"title": "", "legibility": 1, "review_reason": "look"}, {"review_reason": "x" * 700, "title": ""})
    assert r[0].review_reason == "look; low legibility; no title" and r[0].needs_human_review
    assert r[1].review_reason == "x" * 600


def test_json_is_found_in_any_wrapping(spark):
    inner = '{"a": "br}ace {", "b": {"c": 1}}'
    texts = [inner, f"```json\n{inner}\n```", f"```\n{inner}```", f"Sure! {inner} Bye }}", f"{{bad}} {inner}", "", None, "5 apples " + inner, '{"a": "\\"}"} x']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, reply string")
    rows = extract_json(df, "reply").select("n", "tier", F.try_variant_get("data", "$.a", "string").alias("a")).orderBy("n").collect()
    assert [r.tier for r in rows] == ["whole", "fenced", "fenced", "span", "none", "none", "none", "span", "span"]  # text after the object: not a whole reply
    assert [r.a for r in rows][:4] == ["br}ace {"] * 4 and rows[8].a == '"}'


# ---- entities ----------------------------------------------------------------------


def test_four_replies_of_eight_names(spark):
    rows = [(f"i{n}", n, GOOD["people"], GOOD["organizations"], GOOD["places"], GOOD["topics"]) for n in range(4)]
    df = spark.createDataFrame(rows, "id string, n int, people array<string>, organizations array<string>, places array<string>, topics array<string>")
    m = E.with_slug(E.mentions_of(df, "id", "n"))
    assert E.model_links(m).count() == 32 and E.entities(m).count() == 8


def test_first_spelling_wins_and_links_are_single(spark):
    m = E.with_slug(spark.createDataFrame(
        [("b", 2, "person", "OBRIEN", 0), ("a", 1, "person", "O'Brien", 3), ("a", 1, "person", "o'brien", 4), ("a", 1, "person", "--", 5)],
        "item_id string, arrival int, kind string, name string, pos long"))
    assert [tuple(r) for r in E.entities(m).select("kind", "slug", "name").orderBy("slug").collect()] == [
        ("person", "--", "--"), ("person", "obrien", "O'Brien")]
    assert E.model_links(m).where("slug = 'obrien'").count() == 2


def test_human_links_survive_a_new_reading(spark):
    old = spark.createDataFrame([("a", "person", "x", "human"), ("a", "person", "y", "model"), ("b", "person", "y", "model")],
                                "item_id string, kind string, slug string, source string")
    fresh = spark.createDataFrame([("a", "person", "x", "model"), ("a", "person", "z", "model")], old.schema)
    got = E.relink(old, spark.createDataFrame([("a",)], "item_id string"), fresh)
    assert sorted(map(tuple, got.collect())) == [("a", "person", "x", "human"), ("a", "person", "z", "model"), ("b", "person", "y", "model")]


# ---- versions ------------------------------------------------------------------------

VERSION = "item_id string, id long, superseded boolean, provider string, model string, title string, visual_description string, needs_human_review boolean, review_reason string"


def version(item, number, superseded=False, title="t"):
    return (item, number, superseded, "model", "m1", title, "v", True, "why")


def test_newest_live_version(spark):
    df = spark.createDataFrame([version("a", 1), version("a", 3), version("a", 5, True), version("b", 2, True)], VERSION)
    assert [(r.item_id, r.id) for r in V.current(df).collect()] == [("a", 3)]


def test_appending_keeps_history(spark):
    old = spark.createDataFrame([version("a", 1), version("b", 2)], VERSION)
    both = V.append(old, spark.createDataFrame([version("a", 7)], VERSION))
    assert sorted((r.item_id, r.id, r.superseded) for r in both.collect()) == [("a", 1, True), ("a", 7, False), ("b", 2, False)]
    again = V.append(both, spark.createDataFrame([version("a", 9)], VERSION))
    assert again.count() == 4 and again.where("not superseded").count() == 2


def test_a_correction_is_a_new_version_that_keeps_the_model(spark):
    live = spark.createDataFrame([version("a", 1), version("b", 2)], VERSION)
    edits = spark.createDataFrame([("a", 10, {"title": "better", "visual_description": "seen"}), ("b", 11, {"title": "t"})],
                                  "item_id string, version_id long, fields map<string,string>")
    changed = V.changed_only(edits, live, ["title", "visual_description"])
    rows = V.revise(live, changed, ["title", "visual_description"]).collect()
    assert [(r.item_id, r.id, r.provider, r.model, r.title, r.visual_description, r.needs_human_review) for r in rows] == [
        ("a", 10, "human", "m1", "better", "seen", False)]


def test_edits_of_fixed_fields_are_refused(spark):
    df = spark.createDataFrame([({"title": "x"},), ({"confidence": "1", "title": "x"},), ({},)], "fields map<string,string>")
    assert [(r.unknown_fields, r.accepted) for r in V.split_edits(df).collect()] == [([], True), (["confidence"], False), ([], False)]


# ---- workflow --------------------------------------------------------------------------

ITEM = "id string, photo_sha256 string, seq long, status string, needs_human_review boolean, review_reason string, rotation_applied long, master_path string, part_of_item_id string"


def items(spark):
    rows = [("a", "p", 0, "analyzed", True, "r", 270, "m", None), ("b", "p", 1, "approved", False, None, None, "m", None),
            ("c", "q", 0, "rejected", True, None, 0, "m", "a"), ("d", "q", 1, "rectified", True, None, 0, "m", None),
            ("e", "q", 2, "detected", False, None, 0, None, None)]
    return spark.createDataFrame(rows, ITEM)


def test_decisions_clear_flags_and_unknown_ones_do_nothing(spark):
    d = spark.createDataFrame([("a", "approved"), ("d", "maybe"), ("zz", "rejected")], "id string, decision string")
    got = {r.id: (r.status, r.needs_human_review) for r in W.decide(items(spark), d).collect()}
    assert got["a"] == ("approved", False) and got["d"] == ("rectified", True) and len(got) == 5
    assert [tuple(r) for r in W.decision_log(d, items(spark)).collect()] == [("a", "approve")]


def test_turning_drops_approval(spark):
    t = spark.createDataFrame([("a", 180), ("b", -90), ("d", 45)], "id string, degrees int")
    got = {r.id: (r.status, r.rotation_applied) for r in W.rotate(items(spark), t).collect()}
    assert got["a"] == ("rectified", 90) and got["b"] == ("rectified", 270) and got["d"] == ("rectified", 0)


def test_pointers(spark):
    e = spark.createDataFrame([("a", "b"), ("c", None), ("d", "d"), ("b", "nowhere")], "id string, target string")
    got = {r.id: r.part_of_item_id for r in W.set_pointer(items(spark), e, "part_of_item_id").collect()}
    assert got == {"a": "b", "b": None, "c": None, "d": None, "e": None}


def test_photos_that_share_twelve_digits_keep_their_items_apart(spark):
    one, two = "0123456789ab" + "c" * 52, "0123456789ab" + "d" * 52
    rows = [("0123456789ab-00", p, 0, "analyzed", True, None, 0, "m", None) for p in (one, two)] + [("0123456789ab-01", two, 1, "analyzed", True, None, 0, "m", None)]
    both = spark.createDataFrame(rows, ITEM)
    key = "photo_sha256 string, seq long, "
    got = W.decide(both, spark.createDataFrame([(one, 0, "approved")], key + "decision string"))
    assert sorted((r.photo_sha256[12], r.seq, r.status) for r in got.collect()) == [("c", 0, "approved"), ("d", 0, "analyzed"), ("d", 1, "analyzed")]
    assert W.decision_log(spark.createDataFrame([(one, 0, "approved"), ("gone", 0, "approved")], key + "decision string"), both).count() == 1
    edits = spark.createDataFrame([(two, 1, two, 0), (one, 0, one, 1), (two, 0, two, 0)], key + "target_photo string, target_seq long")
    assert sorted((r.photo_sha256[12], r.seq, r.part_of_item_id) for r in W.set_pointer(both, edits, "part_of_item_id").collect()) == [
        ("c", 0, None), ("d", 0, None), ("d", 1, "0123456789ab-00")]
    gone = spark.createDataFrame([(one,)], "sha256 string")
    versions = both.select(*W.KEY)
    photos, items_left, rest = W.cascade_delete(gone, spark.createDataFrame([(one,), (two,)], "sha256 string"), both, {"versions": (versions, [W.KEY])})
    assert photos.count() == 1 and items_left.count() == 2 and {r.photo_sha256 for r in rest["versions"].collect()} == {two}


def test_work_queues(spark):
    live = spark.createDataFrame([("a",), ("b",)], "item_id string")
    def ids(df):
        return [r.id for r in df.collect()]
    assert ids(W.pending_work(items(spark), live)) == ["d"]
    assert ids(W.pending_work(items(spark), live, force=True)) == ["a", "b", "d"]
    assert ids(W.pending_work(items(spark), live, force=True, limit=2)) == ["a", "b"]
    assert ids(W.pending_work(items(spark), live, ids=spark.createDataFrame([("c",), ("e",)], "id string"))) == ["c"]
    assert ids(W.pending_work(items(spark), live, ids=spark.createDataFrame([], "id string"))) == []


def test_sequences_go_on_from_the_last(spark):
    fresh = spark.createDataFrame([("p" * 20, 5), ("p" * 20, 4), ("q" * 20, 1)], "photo_sha256 string, x int")
    old = spark.createDataFrame([("p" * 20, 7)], "photo_sha256 string, seq long")
    got = W.with_item_ids(fresh, old, [F.col("x")], [F.floor(F.col("x") / 2)]).orderBy("id").collect()
    assert [(r.id, r.x) for r in got] == [("p" * 12 + "-08", 4), ("p" * 12 + "-09", 5), ("q" * 12 + "-00", 1)]


def test_deleting_a_photo_takes_everything_below_it(spark):
    photos = spark.createDataFrame([("p",), ("q",)], "sha256 string")
    links = spark.createDataFrame([("a", "c"), ("c", "d")], "x string, y string")
    gone = spark.createDataFrame([("p",)], "sha256 string")
    kept_photos, kept_items, rest = W.cascade_delete(gone, photos, items(spark), {"links": (links, ["x", "y"])})
    assert kept_photos.count() == 1 and kept_items.count() == 3
    assert [tuple(sorted(r)) for r in rest["links"].collect()] == [("c", "d")]


def test_folding_actions_does_not_depend_on_order(spark):
    log = [("a", 1, 1, "approve", 0), ("a", 3, 3, "rotate", 270), ("a", 2, 2, "rotate", 180), ("a", 4, 4, "edit", 0),
           ("b", 1, 5, "recrop", 0), ("b", 2, 6, "delete", 0), ("c", 1, 7, "edit", 0)]
    schema = "item_id string, at int, seq int, action string, degrees int"
    want = {("a", "rectified", 90, True, False, 4), ("b", "rectified", 0, False, True, 2), ("c", None, 0, False, False, 1)}
    for rows in (log, log[::-1]):
        assert set(map(tuple, W.fold_actions(spark.createDataFrame(rows, schema)).collect())) == want


def test_last_write_wins(spark):
    old = spark.createDataFrame([("k", 5, "old"), ("m", 1, "keep")], "id string, at int, v string")
    new = spark.createDataFrame([("k", 5, "tie"), ("n", 2, "add")], old.schema)
    assert {r.id: r.v for r in W.upsert(old, new, ["id"], "at").collect()} == {"k": "tie", "m": "keep", "n": "add"}


def test_photo_pages_hold_every_item_once(spark):
    many = spark.createDataFrame([("p", i, f"i{i}") for i in range(25)], "photo_sha256 string, seq long, id string")
    photos = spark.createDataFrame([("p",), ("empty",)], "sha256 string")
    got = W.photo_pages(photos, many, [F.floor(F.col("seq") / 4)], page_size=10).orderBy("sha256", "page").collect()
    assert [(r.sha256, r.page, len(r.items or [])) for r in got] == [("empty", 0, 0), ("p", 0, 10), ("p", 1, 10), ("p", 2, 5)]
    assert [i.seq for r in got[1:] for i in r.items] == list(range(25))


# ---- inference ----------------------------------------------------------------------------


def jobs(spark, n=20):
    return spark.createDataFrame([(f"j{i:02d}", "bad" if i % 5 == 0 else "good") for i in range(n)], "item_id string, context string")


def connector(failure):
    """A connection whose calls fail with the given error on bad input."""

    def connect():
        def answer(item_id, context):
            if context == "bad":
                raise failure("no " + item_id)
            return item_id.upper()

        return answer

    return connect


def test_one_failure_is_one_row(spark):
    rows = I.run_jobs(jobs(spark), connector(ValueError), partitions=4).collect()
    assert len(rows) == 20 and sum(not r.ok for r in rows) == 4
    assert all(r.reply == r.item_id.upper() if r.ok else r.error == f"ValueError: no {r.item_id}" for r in rows)


def test_calls_overlap_and_carry_who_answered(spark):
    """Slow calls in one partition: as many run together as are let in flight, whatever the order in which they end."""
    def connect():
        lock, running, most = threading.Lock(), [0], [0]

        def answer(item_id, context):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.4 if item_id == "j00" else 0.05)
            with lock:
                running[0] -= 1
            return I.Reply(str(most[0]), 3, 1, "local", "slow")

        return answer

    rows = I.run_jobs(jobs(spark).coalesce(1), connect, in_flight=5).collect()
    assert len(rows) == 20 and rows[0].item_id != "j00" and max(int(r.reply) for r in rows) == 5
    assert {(r.usage.input_tokens, r.usage.output_tokens, r.provider, r.model) for r in rows} == {(3, 1, "local", "slow")}
    assert max(int(r.reply) for r in I.run_jobs(jobs(spark).coalesce(1), connect, in_flight=1).collect()) == 1


def test_failures_name_their_items(spark):
    rows = spark.createDataFrame([("a", True, True, None), ("b", True, False, "E: x"), ("c", False, None, None), ("d", True, None, None)],
                                 "item_id string, has_image boolean, ok boolean, error string")
    assert sorted(map(tuple, I.failures(rows).collect())) == [("b", "E: x"), ("c", "no image"), ("d", "missing from batch results")]


def test_a_general_failure_stops_the_run(spark):
    with pytest.raises(Exception, match="ProviderError: no j"):
        I.run_jobs(jobs(spark), connector(I.ProviderError)).collect()


def test_results_are_matched_by_id(spark):
    some = I.run_jobs(jobs(spark), connector(ValueError)).where("item_id != 'j03'").orderBy(F.col("item_id").desc())
    got = {r.item_id: r for r in I.reconcile(jobs(spark), some).collect()}
    assert len(got) == 20 and got["j03"].error == "missing from batch results" and not got["j03"].ok
    assert got["j04"].reply == "J04"


def test_replies_with_trailing_text_repeated_keys_and_bare_numbers(spark):
    replies = {
        '{"draft":1} and then\n```json\n{"final":2}\n```': ('{"final":2}', "fenced"),
        '{"a":1,"a":2}': ('{"a":2}', "whole"),
        '{"c": NaN, "d": -Infinity}': ('{"c":"NaN","d":"-Infinity"}', "whole"),
        '{"s":"say: NaN, ok"}': ('{"s":"say: NaN, ok"}', "whole"),
        '{"a":1}]': ('{"a":1}', "span"),
        '{"a":1}}': ('{"a":1}', "span"),
        '{"a":1},{"b":2}': ('{"a":1}', "span"),
    }
    df = spark.createDataFrame([(r,) for r in replies], "reply string")
    rows = extract_json(df, "reply").select("reply", F.col("data").cast("string").alias("d"), "tier").collect()
    assert {r.reply: (r.d, r.tier) for r in rows} == replies
