"""Scores of seeds: all of them, not the best few."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keepsake.operators import links as K
from keepsake.operators import similarity
from keepsake.operators.similarity import related_to
from keepsake.plans import QUERIES, catalogue_queries, workflow_queries
from keepsake.session import cut


def test_every_item_that_shares_an_entity_with_a_seed_is_scored(spark):
    rows = [("s", "person", "p"), ("s", "topic", "t"), ("n", "place", "x")] + [(f"i{n:02d}", "topic", "t") for n in range(50)] + [("i07", "person", "p")]
    links = spark.createDataFrame(rows, "item_id string, kind string, slug string")
    seeds = spark.createDataFrame([("s",), ("s",), ("gone",)], "item_id string")
    got = {(r.seed, r.other): r.score for r in related_to(links, seeds).collect()}
    assert got == {("s", f"i{n:02d}"): 6 if n == 7 else 1 for n in range(50)}


def test_scores_of_seeds_are_added_up_where_blocks_meet(spark, monkeypatch):
    """All scores of all seeds over several blocks of seeds, whose written tables hold no more rows than the links."""
    written = []
    monkeypatch.setattr(similarity, "cut", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(similarity, "ROWS", 50, raising=False)
    rng, kinds = np.random.default_rng(5), ["person", "organization", "place", "topic"]
    has = rng.random((120, 30)) < 0.3
    has[:, 0] = True
    rows = [(f"i{i:03d}", kinds[e % 4], f"n{e:02d}") for i, e in np.argwhere(has).tolist()]
    links = spark.createDataFrame(rows + [(None, "person", "n00")], "item_id string, kind string, slug string")
    seeds = spark.createDataFrame([(f"i{i:03d}",) for i in range(0, 120, 3)] + [("i003",), (None,)], "item_id string")
    found = related_to(links, seeds, block=40)
    worth = np.array([(5, 3, 2, 1)[e % 4] for e in range(30)])
    want = {(f"i{i:03d}", f"i{j:03d}"): int(worth[has[i] & has[j]].sum()) for i in range(0, 120, 3) for j in range(120) if j != i}
    got = [((r.seed, r.other), r.score) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert max(df.count() for df in written) <= len(rows)


def test_scores_of_seeds_are_no_aggregate_of_pairs(spark):
    links = spark.createDataFrame([("s", "topic", "t"), ("i", "topic", "t")], "item_id string, kind string, slug string")
    found = related_to(links, links.where("item_id = 's'").select("item_id"))
    text = spark.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert not re.search(r"Aggregate\(keys=\[seed#\d+, other#", text)
    assert [tuple(r) for r in found.collect()] == [("s", "i", 1)]


def test_common_names_give_no_row_for_each_pair(spark, monkeypatch):
    """Each item has half of the names, so that nearly all pairs share some; no table holds more than the links or the best of each block."""
    written = []
    monkeypatch.setattr(similarity, "cut", lambda df: written.append(cut(df)) or written[-1])
    rng = np.random.default_rng(4)
    has = rng.random((700, 40)) < 0.5
    rows = [(f"i{i:03d}", "person", f"n{e:02d}", f"N{e:02d}") for i, e in np.argwhere(has).tolist()]
    links = spark.createDataFrame(rows, "item_id string, kind string, slug string, name string")
    dates = links.select("item_id", F.lit("1950").alias("date_key")).distinct()
    got = {(r.item_id, r["rank"]): (r.other, r.score) for r in similarity.top_related(links, dates, 3).collect()}
    shared = has.astype(int) @ has.T.astype(int)
    want = {}
    for i in range(700):
        first = [int(np.argmax(has[i] & has[j])) for j in range(700)]
        best = sorted((j for j in range(700) if j != i and shared[i, j]), key=lambda j: (-shared[i, j], first[j], j))[:3]
        want |= {(f"i{i:03d}", n + 1): (f"i{j:03d}", 5 * shared[i, j]) for n, j in enumerate(best)}
    assert got == want
    assert max(df.count() for df in written) <= len(rows)


@pytest.mark.parametrize("block", [300, 10**6])
def test_bounds_lose_nothing(spark, block):
    """Over many blocks and over one: scores, ties by the first shared name, then by date and id; copies, items without a date, links that come twice."""
    rng, kinds = np.random.default_rng(6), ["person", "organization", "place", "topic"]
    has = rng.random((260, 60)) < 0.9 / np.arange(1, 61) ** 0.7
    has[200:230] = has[7]
    rows = [(f"i{i:03d}", kinds[e % 4], f"n{e:02d}", f"N{e:02d}") for i, e in np.argwhere(has).tolist()]
    rows += [r for r in rows if r[0] in ("i003", "i004", "i005") and r[2] < "n09"] if block < 1000 else []
    links = spark.createDataFrame(rows, "item_id string, kind string, slug string, name string")
    dates = {f"i{i:03d}": f"19{i % 7}0" if i % 10 else None for i in range(260)}
    found = similarity.top_related(links, spark.createDataFrame(list(dates.items()), "item_id string, date_key string"), 4, block)
    mine, names = {}, {}
    for item, kind, slug, name in rows:
        mine.setdefault(item, {}).setdefault((kind, slug), []).append(name)
        names[kind, slug] = f"{kinds.index(kind)}{name}"
    want = []
    for i, own in mine.items():
        shared = {j: [x for x in own if x in theirs] for j, theirs in mine.items() if j != i and dates[j]}
        score = {j: sum((5, 3, 2, 1)[kinds.index(x[0])] * len(own[x]) * len(mine[j][x]) for x in some) for j, some in shared.items() if some}
        best = sorted(score, key=lambda j: (-score[j], min(names[x] for x in shared[j]), dates[j], j))[:4]
        want += [(i, j, score[j], n) for n, j in enumerate(best, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_common_entities_are_not_followed(monkeypatch):
    """Where rare names give enough good ones, the links of what everyone has are not gone through for each item."""
    m, followed = 20_000, []

    class Counted:
        def __getattr__(self, name):
            if name != "concatenate":
                return getattr(np, name)
            return lambda arrays, *a, **b: followed.append(sum(map(len, arrays := list(arrays)))) or np.concatenate(arrays, *a, **b)

    # Everyone has 0 (a topic); two names (persons) are shared by ten each, in two ways.
    eids = [[0, 1 + i // 10, 10_000 + i % 2_000] for i in range(m)]
    items = pa.array(np.arange(m))
    theirs = pa.table({"place": items, "owner": items, "eids": pa.array(eids)})
    mine = pa.table({"no": items[:200], "least": pa.array(np.zeros(200, dtype=np.int64)), "eids": pa.array(eids[:200]),
                     "pos": pa.array([[3, 1, 2]] * 200, pa.list_(pa.int32())), "w": pa.array([[1, 5, 5]] * 200, pa.list_(pa.int32()))})
    monkeypatch.setattr(similarity, "np", Counted())
    got = similarity.best_of_block(mine, theirs, 3)
    assert got.num_rows == 600 and set(got.column("score").to_pylist()) == {6}
    assert got.slice(0, 3).column("place").to_pylist() == [1, 2, 3] and sum(followed) < 100 * 200


def test_pairs_are_settled_once_and_turned(spark):
    rows = [(1, 2, "b", "model", 5), (2, 1, "a", "human", 3), (1, 2, "c", "human", 3), (2, 3, "d", "model", 1), (3, 2, "e", "model", 9), (4, 4, "f", "human", 1), (None, 1, "g", "human", 1), (5, 9, "h", "model", 2)]
    links = spark.createDataFrame(rows, "item_id long, related_item_id long, reason string, source string, at long")
    got = K.symmetric(links)
    want = [(1, 2, "a", "human", 3), (2, 1, "a", "human", 3), (2, 3, "e", "model", 9), (3, 2, "e", "model", 9), (5, 9, "h", "model", 2), (9, 5, "h", "model", 2)]
    assert got.columns == links.columns and sorted(map(tuple, got.collect())) == want
    assert "Union" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, K.neighbours(links).collect())) == [r[:2] for r in want]
    assert sorted(map(tuple, K.counted(links).collect())) == [(1, 1), (2, 2), (3, 1), (5, 1), (9, 1)]
    known = spark.createDataFrame([(1,), (2,), (2,), (5,), (None,)], "n long")
    assert sorted(map(tuple, K.between(links, known).collect())) == sorted(rows[:3])


@pytest.mark.parametrize("name", ["item_payloads", "related_entries"])
def test_links_are_settled_by_number(spark, monkeypatch, name):
    """Pairs are dealt out as numbers, not as ids of 19 digits."""
    plans = []
    for module in (catalogue_queries, workflow_queries):
        monkeypatch.setattr(module, "cut", lambda df: plans.append(df) or cut(df))
    plans.append(QUERIES[name](spark, "/root/testdata/sf0.001"))
    texts = [spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted") for df in plans]
    dealt = [line for t in texts for line in t.splitlines() if "hashpartitioning(" in line and "related_item_id" in line and "item_id#" in line.replace("related_item_id#", "")]
    assert dealt and all(re.search(r"hashpartitioning\(item_id#\d+L, related_item_id#\d+L", line) for line in dealt)
