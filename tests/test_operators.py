"""Ordering and graph helpers, boxes, folding, similarity, ledger, manifests: goldens and brute force."""

import random
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.operators import boxes as B
from keepsake.operators import catalogue as C
from keepsake.operators import ledger as L
from keepsake.operators import links as K
from keepsake.operators import manifest as M
from keepsake.operators import regions as R
from keepsake.operators import scale as S
from keepsake.operators.similarity import top_related
from keepsake.schemas import KIND_WEIGHTS

# ---- scale ------------------------------------------------------------------


def test_null_keys_and_buckets_count_alike_at_every_size(spark):
    rows = spark.createDataFrame([(None, 1, None), (None, 2, 5), (None, 3, 7), ("a", 4, None)], "k string, i int, b int")
    for hot_rows in (0, 100):
        out = S.numbered(rows, ["k"], [F.col("b"), F.col("i")], [F.col("b")], hot_rows=hot_rows).collect()
        assert {(r.k, r.i): r.rn for r in out} == {(None, 1): 1, (None, 2): 2, (None, 3): 3, ("a", 4): 1}
        out = S.with_neighbours(rows, ["k"], ["b", "i"], [F.col("b")], F.col("i"), "p", "n", hot_rows=hot_rows).collect()
        assert {r.i: (r.p, r.n) for r in out} == {1: (None, 2), 2: (1, 3), 3: (2, None), 4: (None, None)}


def skewed(spark, n=600):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(50), i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, v int, i long").repartition(5)


@pytest.mark.parametrize("keys,hot", [(["k"], 0), (["k"], 100), (["k"], 10**6), ([], 0)])
def test_numbering_equals_the_plain_window(spark, keys, hot):
    df = skewed(spark)
    buckets = [F.floor(F.col("v") / 10), F.col("v"), F.floor(F.col("i") / 100)]
    got = S.numbered(df, keys, [F.col("v"), F.col("i")], buckets, "rn", hot)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("v", "i")).cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("keys,hot", [(["k"], 0), (["k"], 100), (["k"], 10**6), ([], 0)])
def test_neighbours_equal_the_plain_window(spark, keys, hot):
    df = skewed(spark)
    w = Window.partitionBy(*keys).orderBy("v", "i")
    got = S.with_neighbours(df, keys, ["v", "i"], [F.floor(F.col("v") / 10), F.floor(F.col("v") / 2)], F.col("i"), "p", "n", hot)
    want = df.withColumn("p", F.lag("i").over(w)).withColumn("n", F.lead("i").over(w))
    def order(t):
        return t[2]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(map(tuple, want.collect()), key=order)


def roots_by_hand(pointers):
    out = {}
    for start in pointers:
        path, at = [start], start
        while True:
            step = pointers.get(at)
            if step is None or step not in pointers or step == at:
                out[start] = at
                break
            if step in path:
                out[start] = min(path[path.index(step):])
                break
            path.append(step)
            at = step
    return out


def test_roots_of_chains_and_cycles(spark):
    rng = random.Random(7)
    cases = [
        {"a": None, "b": "a", "c": "b", "d": "c", "e": "d", "f": "zz", "g": "g"},
        {"a": "b", "b": "a", "c": "a", "d": "c"},
        {"m": "n", "n": "o", "o": "m", "a": "m", "b": "a", "x": None, "y": "x"},
        {f"n{i:03d}": f"n{i - 1:03d}" if i else None for i in range(70)},
        {f"n{i:03d}": f"n{rng.randrange(60):03d}" for i in range(60)},
    ]
    for pointers in cases:
        df = spark.createDataFrame(list(pointers.items()), "id string, up string")
        assert {r.id: r.root for r in S.resolve_roots(df, "id", "up").collect()} == roots_by_hand(pointers)


# ---- boxes ------------------------------------------------------------------

BOX = "photo string, seq long, x0 double, y0 double, x1 double, y1 double, area_frac double, method string, confidence double"


def box(seq, x0, y0, x1, y1, area=None, photo="p", method="edge"):
    return (photo, seq, float(x0), float(y0), float(x1), float(y1), area if area else (x1 - x0) * (y1 - y0) / 1e6, method, 0.9)


def kept(spark, *rows):
    return sorted(r.seq for r in B.drop_swallowers(spark.createDataFrame(list(rows), BOX)).collect())


def test_swallowers(spark):
    assert kept(spark, box(0, 0, 0, 100, 100, .40), box(1, 0, 0, 40, 100, .10), box(2, 60, 0, 100, 100, .10)) == [1, 2]
    assert kept(spark, box(0, 10, 10, 90, 90, .10), box(1, 0, 0, 100, 100, .30)) == [0, 1]
    assert kept(spark, box(0, 0, 0, 100, 100, .30), box(1, 10, 10, 90, 90, .25)) == [0, 1]


def test_collisions(spark):
    df = spark.createDataFrame([box(0, 0, 0, 100, 100), box(1, 10, 10, 60, 60), box(2, 500, 500, 600, 600)], BOX)
    assert [r.seq for r in B.collisions(df).collect()] == [1]


def overlap(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    return w * h if w > 0 and h > 0 else 0.0


def area(a):
    return (a[4] - a[2]) * (a[5] - a[3])


def ratio(a, b):
    return overlap(a, b) / (area(a) + area(b) - overlap(a, b))


def grouped_by_hand(rows, threshold=0.35):
    """Largest first; join the first group with an overlapping member, else start one."""
    out = []
    for photo in {r[0] for r in rows}:
        groups = []
        for r in sorted((r for r in rows if r[0] == photo), key=lambda r: (-r[6], r[1])):
            home = next((g for g in groups if any(ratio(r, m) > threshold for m in g)), None)
            groups.append([r]) if home is None else home.append(r)
        for g in groups:
            methods = {m[7] for m in g}
            out.append((photo, g[0][1], "merged" if len(methods) > 1 else g[0][7], len(g)))
    return sorted(out)


def crowded(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = rng.randrange(700), rng.randrange(700), rng.randrange(40, 400), rng.randrange(40, 400)
        rows.append(box(i, x, y, x + w, y + h, photo="hot" if i % 3 else f"p{i % 5}", method=rng.choice(["edge", "background"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_grouping_equals_the_greedy_pass(spark, seed):
    rows = crowded(seed)
    got = B.merge_groups(spark.createDataFrame(rows, BOX)).select("photo", "seq", "method", "members").collect()
    assert sorted(map(tuple, got)) == grouped_by_hand(rows)


def test_pairs_equal_all_pairs(spark):
    rows = crowded(3)
    df = spark.createDataFrame(rows, BOX)
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and overlap(a, b) > 0}
    got = B.overlapping_pairs(df, df).select("photo", "a_seq", "b_seq").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    inside = {(a[0], a[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and overlap(a, b) / area(a) >= 0.7}
    assert sorted((r.photo, r.seq) for r in B.collisions(df).collect()) == sorted(inside)


@pytest.mark.parametrize("crowd", [5, 40])
def test_crowded_cells_are_cut_and_nothing_changes(spark, crowd, monkeypatch):
    rows = crowded(4) + [box(200 + i, *(lambda x, y: (x, y, x + 3, y + 2))(i % 17, i % 13), photo="hot") for i in range(120)]
    df = spark.createDataFrame(rows, BOX)
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and overlap(a, b) > 0}
    got = B.overlapping_pairs(df, df, crowd=crowd).select("photo", "a_seq", "b_seq").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    inside = sorted((a[0], a[1]) for a in rows if any(a[0] == b[0] and a[1] != b[1] and overlap(a, b) / area(a) >= 0.7 for b in rows))
    assert sorted((r.photo, r.seq) for r in B.collisions(df, crowd=crowd).collect()) == inside
    whole = sorted(r.seq for r in B.drop_swallowers(df).where("photo = 'hot'").collect())
    monkeypatch.setattr(B, "CROWD", crowd)
    assert sorted(r.seq for r in B.drop_swallowers(df).where("photo = 'hot'").collect()) == whole


def test_a_hundred_thousand_boxes_in_one_corner(spark):
    df = spark.range(100_000).select(F.lit("p").alias("photo"), F.col("id").alias("seq"), (F.col("id") % 250).cast("double").alias("x0"),
                                     F.floor(F.col("id") / 400).cast("double").alias("y0")).withColumns({"x1": F.col("x0") + 0.9, "y1": F.col("y0") + 0.9})
    leaves = B._leaves([df], B.CELL, 2000)[0]
    assert leaves.groupBy("size", "cx", "cy").count().agg(F.max("count")).first()[0] <= 2000
    pairs = B.overlapping_pairs(df, df, crowd=2000).where("a_seq != b_seq")
    per_place = df.groupBy("x0", "y0").count()
    assert pairs.count() == per_place.agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0]


@pytest.mark.parametrize("hot_rows", [1, 20, 10**6])
def test_medians_equal_the_sorted_middle(spark, hot_rows):
    rng = random.Random(7)
    rows = [("most", rng.choice([0.0, 1.0, rng.gauss(0, 1e-9), rng.gauss(5, 100)])) for _ in range(700)]
    rows += [("half", float(i % 2)) for i in range(80)] + [("one", 3.0), ("same", 2.5), ("same", 2.5), ("none", None), (None, 4.0), (None, 6.0), ("odd", float("nan")), ("odd", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {}
    for k in {k for k, _ in rows}:
        some = [v for x, v in rows if x == k and v is not None and v == v]
        if some:
            want[k] = statistics.median(some)
    got = {r.k: r.m for r in S.medians(df, ["k"], F.col("v"), "m", hot_rows, parts=8).collect()}
    assert got == pytest.approx(want)
    every = S.medians(df, [], F.col("v"), "m", hot_rows, parts=8)
    assert every.first().m == pytest.approx(statistics.median(v for _, v in rows if v is not None and v == v))
    assert S.medians(df.where("false"), [], F.col("v"), "m", hot_rows).count() == 0
    assert "percentile" not in every._jdf.queryExecution().toString().lower() and "median(" not in every._jdf.queryExecution().toString().lower()


def test_best_match_and_evaluation(spark):
    truth = spark.createDataFrame([("p", 0, 0., 0., 10., 10.), ("p", 1, 50., 50., 60., 60.), ("q", 0, 0., 0., 9., 9.)],
                                  "photo string, seq long, x0 double, y0 double, x1 double, y1 double")
    guess = spark.createDataFrame([("p", 7, 0., 0., 10., 9.), ("p", 8, 0., 0., 5., 5.), ("q", 0, 100., 0., 109., 9.)], truth.schema)
    got = {(r.photo, r.seq): (r.predicted_seq, r.iou) for r in B.best_matches(truth, guess).collect()}
    assert got == {("p", 0): (7, 0.9), ("p", 1): (None, 0.0), ("q", 0): (None, 0.0)}
    summary = B.evaluation(B.best_matches(truth, guess)).first()
    assert (summary["items"], summary.found, summary.photos, summary.complete_photos, summary.median_iou) == (3, 1, 2, 0, 0.0)


def test_reading_order_keeps_a_tilted_row_together(spark):
    df = spark.createDataFrame([box(0, 300, 10, 400, 110), box(1, 0, 0, 100, 100), box(2, 0, 300, 100, 400), box(3, 150, 30, 250, 130)], BOX)
    assert [r.seq for r in B.reading_order(df).orderBy("position").collect()] == [1, 3, 0, 2]


def test_photos_without_boxes_become_one_item(spark):
    photos = spark.createDataFrame([("p", 100, 50), ("bare", 30, 20)], "photo string, width int, height int")
    got = {(r.photo, r.method, r.x1, r.y1, r.flagged) for r in B.at_least_one(photos, spark.createDataFrame([box(0, 0, 0, 9, 9)], BOX)).collect()}
    assert got == {("p", "edge", 9.0, 9.0, False), ("bare", "whole_frame", 29.0, 19.0, True)}


# ---- regions -------------------------------------------------------------------


def regions(spark, *entries):
    import json

    reply = json.dumps({"items": list(entries)})
    df = spark.createDataFrame([("p", 1000, 1000, reply)], "photo string, width int, height int, reply string")
    rows = R.explode_regions(df.select("photo", "width", "height", F.parse_json("reply").alias("data")), "photo", "data")
    return R.parse_regions(rows)


def entry(edge, **more):
    return {"box": [edge, edge, edge + 100, edge + 100], **more}


def links_of(df):
    return sorted((r.pos, r.link, r.target) for r in R.sibling_links(df).collect())


def test_region_fields(spark):
    rows = regions(spark, entry(0, confidence=90, kind="sculpture", panels="two"), "not an object", {"box": None},
                   {"box": [1, 2, 3]}, {"box": ["a", 0, 1, 1]}, {"box": "big"}, {"box": [0, 0, 100, 100, 5]}, entry(200, medium="newsprint", panels=-4)).orderBy("pos").collect()
    assert [r.box is not None for r in rows] == [True, False, False, False, False, False, False, True]
    assert rows[0].confidence == 0.9 and rows[0].kind == "other" and rows[0].panels == 1
    assert rows[7].medium == "newsprint" and rows[7].panels == 1


@pytest.mark.parametrize("bad", [5, -3, 0])
def test_links_that_lead_nowhere_are_dropped(spark, bad):
    assert links_of(regions(spark, entry(0, part_of=bad, duplicate_of=bad), entry(200))) == []


def test_links(spark):
    assert links_of(regions(spark, entry(0, part_of=1), entry(200))) == [(0, "part_of", 1)]
    assert links_of(regions(spark, entry(0), entry(200, related_to=[0, 0, 1, 7, -3]))) == [(1, "related_to", 0)]
    assert links_of(regions(spark, entry(0), entry(200, part_of=0, duplicate_of=0))) == [(1, "part_of", 0)]
    # A region that cannot be placed keeps its position, so later links still mean the same sibling.
    shifted = regions(spark, {"box": [100, 1200, 500, 1210]}, entry(0), entry(200, part_of=1), entry(400, part_of=0))
    assert links_of(shifted) == [(2, "part_of", 1)]
    assert tuple(R.dropped_per_photo(shifted).first()) == ("p", 3, 1)


@pytest.mark.parametrize("change,fragment", [
    ({"part_of": 0, "link_confidence": .25}, "belongs with another item but is only 25% sure"),
    ({"duplicate_of": 0, "link_confidence": .4}, "duplicate"), ({"related_to": [0], "link_confidence": .5}, "linked to another item"),
    ({"part_of": 0, "link_confidence": .95}, None), ({"link_confidence": .1}, None)])
def test_uncertain_links(spark, change, fragment):
    base = {"part_of": -1, "duplicate_of": -1, "related_to": [], "link_confidence": .5, "part_reason": "", "related_reason": ""} | change
    df = spark.createDataFrame([tuple(base.values())], "part_of int, duplicate_of int, related_to array<int>, link_confidence double, part_reason string, related_reason string")
    note = df.select(R.link_note(0.80)).first()[0]
    assert (note is None) if fragment is None else fragment in note


# ---- folding -----------------------------------------------------------------------


def fold(spark, *rows):
    full = [(i, p or None, d or None, t, "") for i, p, d, t in rows]
    df = spark.createDataFrame(full, "id string, part_of string, duplicate_of string, text string, date_value string")
    f = C.fold(df, [F.lit(0)])
    texts = {r.id: r.body for r in f.parts.collect()}
    pages = {}
    for r in f.pages.orderBy("parent_id", "page_no").collect():
        pages.setdefault(r.parent_id, []).append(r.id)
    assert sorted(texts) == sorted(r.id for r in f.entries.collect())
    return texts, pages


def test_a_continuation_becomes_a_page(spark):
    assert fold(spark, ("a", "", "", "A long letter that"), ("b", "a", "", "ends overleaf.")) == (
        {"a": "A long letter that\n\nends overleaf."}, {"a": ["b"]})


def test_orphans_self_pointers_and_order(spark):
    assert fold(spark, ("b", "missing", "", "orphan")) == ({"b": "orphan"}, {})
    assert fold(spark, ("a", "a", "", "x")) == ({"a": "x"}, {})
    assert fold(spark, ("a", "", "", ""), ("c", "a", "", "3"), ("b", "a", "", "2")) == ({"a": "2\n\n3"}, {"a": ["b", "c"]})


def test_copies(spark):
    assert fold(spark, ("p2", "", "", "x"), ("p2-again", "", "p2", "x"))[0] == {"p2": "x"}
    assert fold(spark, ("copy", "", "gone", "x"))[0] == {"copy": "x"}
    assert fold(spark, ("p2", "", "", "x"), ("p2-again", "", "p2", "x"), ("strip", "p2-again", "", "the rest")) == (
        {"p2": "x", "strip": "the rest"}, {})


def test_chains_reach_the_root_and_cycles_keep_one(spark):
    assert fold(spark, ("a", "", "", "1"), ("b", "a", "", "2"), ("c", "b", "", "3")) == ({"a": "1\n\n2\n\n3"}, {"a": ["b", "c"]})
    assert fold(spark, ("a", "b", "", "1"), ("b", "a", "", "2")) == ({"a": "1\n\n2"}, {"a": ["b"]})
    assert fold(spark, ("a", "", "b", "1"), ("b", "", "a", "1"))[0] == {"a": "1"}


def test_very_many_pages_come_in_parts(spark):
    rows = [("root", "", "", "r")] + [(f"s{i:03d}", "root", "", str(i)) for i in range(200)]
    full = [(i, p or None, None, t, "") for i, p, _, t in rows]
    f = C.fold(spark.createDataFrame(full, "id string, part_of string, duplicate_of string, text string, date_value string"),
               [F.substring("id", 2, 2)], chains=False)
    parts = f.parts.orderBy("part").collect()
    assert len(parts) == 200 // C.PAGES_PER_PART + 1 and sum(r.pages_in_part for r in parts) == 200
    assert "\n\n".join(r.body for r in parts) == "\n\n".join(["r", *map(str, range(200))])


def test_links_need_both_ends(spark):
    entries = spark.createDataFrame([("story", "S", "t", ""), ("leaflet", "L", "t", "")], "id string, title string, type string, date_display string")
    links = spark.createDataFrame([("story", "leaflet", "kept together"), ("leaflet", "story", None), ("story", "gone", "x"), ("story", "story", "x")],
                                  "item_id string, related_item_id string, reason string")
    got = C.ordered_related(C.related(entries, links)).collect()
    assert sorted((r.item_id, r.related_item_id, r.reason, r.position) for r in got) == [("leaflet", "story", "", 1), ("story", "leaflet", "kept together", 1)]


def test_links_are_stored_both_ways_and_people_win(spark):
    links = spark.createDataFrame([("a", "b", "m", "model", 5), ("b", "a", "h", "human", 1), ("c", "c", "x", "model", 1)],
                                  "item_id string, related_item_id string, reason string, source string, at long")
    got = K.symmetric(links)
    assert sorted((r.item_id, r.related_item_id, r.reason) for r in got.collect()) == [("a", "b", "h"), ("b", "a", "h")]
    assert K.unlink(got, spark.createDataFrame([("a", "b")], "item_id string, related_item_id string")).count() == 0


def test_undated_entries_are_kept_and_last(spark):
    df = spark.createDataFrame([("1960s", "1962"), ("1950s", "1955"), ("", ""), ("1960s", "1961")], "decade string, year string")
    rows = [tuple(r) for r in C.timeline(df).orderBy(*C.timeline_order()).collect()]
    assert rows == [("1950s", None, 1), ("1950s", "1955", 1), ("1960s", None, 2), ("1960s", "1961", 1), ("1960s", "1962", 1),
                    ("Undated", None, 1), ("Undated", "Undated", 1)]


# ---- similarity -----------------------------------------------------------------------


@pytest.mark.parametrize("rare_upto,hot_share", [(1, 40), (1, 8), (2, 5), (3, 1), (1, 1), (1000, 16)])
def test_top_related_equals_scoring_every_pair(spark, rare_upto, hot_share):
    rng = random.Random(11)
    links, names = set(), {}
    for item in range(40):
        links.add((f"i{item:02d}", "place", "hot" if item % 3 else "cold"))
        for _ in range(rng.randrange(5)):
            kind = rng.choice(list(KIND_WEIGHTS))
            links.add((f"i{item:02d}", kind, f"{kind[0]}{int(rng.paretovariate(0.7)) % 12}"))
    rows = sorted((i, k, s, "N" + s[::-1]) for i, k, s in links)
    dates = {f"i{n:02d}": rng.choice(["1950", "1962", "9999"]) for n in range(40)}
    kinds = list(KIND_WEIGHTS)
    want = []
    for me in dates:
        scores, first = Counter(), {}
        for i, k, s, name in rows:
            if i != me:
                continue
            for j, k2, s2, _ in rows:
                if j != me and (k2, s2) == (k, s):
                    scores[j] += KIND_WEIGHTS[k]
                    first[j] = min(first.get(j, ("9", "")), (str(kinds.index(k)), name))
        best = sorted(scores, key=lambda j: (-scores[j], first[j], dates[j], j))[:6]
        want += [(me, j, scores[j], n + 1) for n, j in enumerate(best)]
    df = spark.createDataFrame(rows, "item_id string, kind string, slug string, name string")
    day = spark.createDataFrame(list(dates.items()), "item_id string, date_key string")
    assert sorted(map(tuple, top_related(df, day, 6, rare_upto, hot_share).collect())) == sorted(want)
    seeds = spark.createDataFrame([("i01",), ("i07",), ("gone",)], "item_id string")
    assert sorted(map(tuple, top_related(df, day, 6, rare_upto, hot_share, seeds).collect())) == sorted(w for w in want if w[0] in ("i01", "i07"))


def test_related_items_end_their_lists_early(spark):
    """Many share common names, few need them: the rare ones of an item outweigh what is left of its list."""
    rows = [(f"i{n:03d}", "person", f"pair{n // 8}_{m}", f"P{n // 8}{m}") for n in range(400) for m in range(6)]
    rows += [(f"i{n:03d}", "topic", f"t{n % 4}", f"T{n % 4}") for n in range(400)]
    df = spark.createDataFrame(rows, "item_id string, kind string, slug string, name string")
    day = df.select("item_id", F.lit("1950").alias("date_key")).distinct()
    got = top_related(df, day, 6, 16, 1).collect()
    assert len(got) == 2400 and all(int(r.item_id[1:]) // 8 == int(r.other[1:]) // 8 for r in got)


# ---- search ----------------------------------------------------------------------------


def test_every_term_must_hit_somewhere(spark):
    entries = spark.createDataFrame([("a", "Polio drive", "", "1962"), ("b", "Other", "Harold", ""), ("c", "polio", "", "")],
                                    "id string, title string, names string, date_value string")
    bodies = spark.createDataFrame([("a", "of 1962"), ("a2", "nurses"), ("b", "polio"), ("c", "x"), ("gone", "polio")], "id string, text string")
    roots = spark.createDataFrame([("a", "a"), ("a2", "a"), ("b", "b"), ("c", "c")], "id string, root string")

    def run(q):
        titles, names = (C.term_flags(entries.select("id", F.col(c).alias("text")), q) for c in ("title", "names"))
        found = C.search(entries, titles, names, C.term_flags(bodies, q, roots), q) if q.strip() else C.search(entries, entries, entries, entries, q)
        return [(r.id, r.score) for r in found.collect()]
    assert run("polio") == [("a", 10), ("c", 10), ("b", 2)]
    assert run("polio nurses") == [("a", 12)] and run("POLIO harold") == [("b", 8)]
    assert run("1962") == [("a", 6)] and run("  ") == [] and run("polio polio")[0] == ("a", 20)


def test_no_text_is_shuffled_for_a_search(spark):
    from keepsake.plans import QUERIES

    df = QUERIES["search_top_100"](spark, "/root/testdata/sf0.001")
    nodes = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").split("\n\n")
    read = {a for n in nodes if ") Scan parquet" in n for a in re.findall(r"\btext#\d+", n)}
    moved = [n for n in nodes if re.match(r"\s*\(\d+\) (Broadcast)?Exchange", n)]
    assert read and moved and not any(a + e in n for n in moved for a in read for e in ",]")


# ---- ledger and manifests ------------------------------------------------------------------


def test_intake_is_idempotent(spark):
    df = spark.createDataFrame([("b.jpg", "h1", True), ("a.jpg", "h1", True), ("c.jpg", "h2", True), ("d.jpg", None, True), ("e.jpg", "h3", False)],
                               "path string, hash string, readable boolean")
    none = df.select("hash").limit(0)
    got = {r.path: r.outcome for r in L.intake(df, none).collect()}
    assert got == {"a.jpg": "ingested", "b.jpg": "duplicate", "c.jpg": "ingested", "d.jpg": "unreadable", "e.jpg": "unreadable"}
    again = L.intake(df, L.new_ledger_rows(L.intake(df, none)).select("hash"))
    assert again.where("outcome = 'ingested'").count() == 0


def test_backlog(spark):
    inbox = spark.createDataFrame([("f", "old"), ("f", "new"), ("f", "new"), ("g", "x"), ("g", "y"), ("g", "z"), ("g", "w")], "folder string, content string")
    ledger = spark.createDataFrame([("old",)], "c string").select(L.content_hash(F.col("c")).alias("hash"))
    got = {r.folder: (r.present, r.waiting) for r in L.backlog(inbox, ledger, "folder", "content").collect()}
    assert got == {"f": (3, 2), "g": (4, 4)}


def test_rows_without_content_are_no_copies(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", None)], "id string, hash string")
    assert {r.id: r.duplicate_of for r in L.exact_duplicates(rows, "id", "hash").collect()} == {"a": None, "b": "a", "c": None, "d": None}


def test_long_ids_stay_apart(spark):
    from keepsake.plans.bindings import padded

    numbers = [7, 9_999_999_999, 10_000_000_000, 12_345_678_901, 12_345_678_902, (1 << 63) - 1]
    made = [r.id for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(padded(F.col("n")).alias("id")).collect()]
    assert [int(i) for i in made] == numbers and sorted(made) == made


def test_landing_names_take_the_next_free_number(spark):
    df = spark.createDataFrame([(1, "a.jpg"), (2, "x/a.jpg"), (3, "a-2.jpg"), (4, "a.jpg"), (5, "bad.txt"), (6, "a-2.jpg"), (7, "a-4.jpg"), (8, "a.jpg"), (9, "a-02.jpg")],
                               "at long, raw string")
    got = {r.at: r.landing_name for r in L.landing_names(df, "raw", "at", [F.col("at")]).collect()}
    assert got == {1: "a.jpg", 3: "a-2.jpg", 2: "a-3.jpg", 7: "a-4.jpg", 4: "a-5.jpg", 8: "a-6.jpg", 6: "a-2-2.jpg", 9: "a-02.jpg", 5: None}
    one = spark.createDataFrame([(1, "a.jpg"), (2, "a-2.jpg"), (3, "a.jpg")], df.schema)
    assert {r.at: r.landing_name for r in L.landing_names(one, "raw", "at", [F.col("at")]).collect()} == {1: "a.jpg", 2: "a-2.jpg", 3: "a-3.jpg"}


def test_landing_names_never_clash(spark):
    rng = random.Random(3)
    raw = [rng.choice(["a", "b", "a-2", "a-3", "a-2-2", "b-1", "a-10"]) + ".jpg" for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(raw)), "at long, raw string")
    got = {r.at: r.landing_name for r in L.landing_names(df, "raw", "at", [F.col("at")]).collect()}
    assert len(set(got.values())) == 120
    for name in set(raw):
        stem = name[:-4]
        mine = [i for i, r in enumerate(raw) if r == name]
        free = (n for n in range(2, 999) if f"{stem}-{n}.jpg" not in raw)
        assert [got[i] for i in mine] == [name, *(f"{stem}-{next(free)}.jpg" for _ in mine[1:])]


FILE = "path string, size long, hash string"


def test_snapshot_diff(spark):
    local = spark.createDataFrame([("index.html", 1, "a"), ("new.css", 1, "b"), ("same.js", 2, "c"), (".git/config", 1, "z")], FILE)
    remote = spark.createDataFrame([("index.html", 1, "old"), ("same.js", 2, "c"), ("robots.txt", 1, "r"), ("Thumbs.db", 1, "t")], FILE)
    def run(**kw):
        return {r.path: r.change for r in M.diff(local, remote, **kw).collect()}
    assert run() == {"index.html": "changed", "new.css": "new", "same.js": "unchanged", "robots.txt": "kept"}
    assert run(delete=True)["robots.txt"] == "deleted"
    assert "robots.txt" not in run(delete=True, exclude=["*.txt"])
    assert set(r.change for r in M.diff(local, local).collect()) == {"unchanged"}


def test_transfer_log(spark):
    lines = [">f+++++++++ index.html", ">f.st...... assets/app.js", "cd+++++++++ media/", "*deleting   robots.txt", "", "sending list"]
    got = M.parse_transfer_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((r.path, r.change) for r in got) == [("assets/app.js", "changed"), ("index.html", "changed"), ("robots.txt", "deleted")]


def test_staleness_needs_both_sides(spark):
    data = spark.createDataFrame([(5,)], "u int")
    build = spark.createDataFrame([(3,)], "b int")
    assert M.staleness(data, "u", build, "b").first().stale
    assert not M.staleness(data, "u", build.limit(0), "b").first().stale
    assert M.exclusions(["x", ".git", "x"])[-1] == "x" and len(M.exclusions(["x", ".git", "x"])) == 7


def test_cost(spark):
    prices = spark.createDataFrame([("big", 5.0, 25.0)], "model string, input_rate double, output_rate double")
    def usd(n, batch):
        jobs = spark.createDataFrame([("big",)] * n + [("free",)], "model string")
        return [r.usd for r in M.cost(jobs, prices, batch).collect()]
    assert usd(500, True) == [pytest.approx(8.6, abs=0.1)] and usd(500, False)[0] == pytest.approx(2 * usd(500, True)[0], abs=0.02)
