"""Near copies of the pipeline against the Jaccard of all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from keepsake.llm import jaccard, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} - {()}


def kept(rows):
    """The smallest id of each group that pairs at 0.8 or more join; texts without words are one group."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) and a | b:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(least.values())


def words(r, n):
    return [f"w{r.randrange(10 ** 6)}" for _ in range(n)]


def edited(r, base, edits):
    """With so many words replaced, at even distances."""
    out = list(base)
    for k in range(edits):
        out[(2 * k + 1) * len(out) // (2 * edits)] = f"x{r.randrange(10 ** 6)}"
    return out


def planted(edits, share):
    """60 texts of 96 to 700 words, each with a copy changed at that rate of shingles."""
    r, rows = random.Random(edits), []
    for k in range(60):
        base = words(r, 96 + 10 * k)
        copy = edited(r, base, max(1, round(len(base) * share / 5)))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    return rows


def ids(spark, rows):
    return sorted(r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_pairs_just_above_are_found(spark):
    rows = planted(1, 0.09)
    near = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert 0.8 <= min(near) < max(near) < 0.87
    assert ids(spark, rows) == kept(rows) == list(range(0, 120, 2))


def test_pairs_just_below_stay(spark):
    rows = planted(2, 0.15)
    near = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert 0.6 < min(near) < max(near) < 0.8
    assert ids(spark, rows) == kept(rows) == list(range(120))


def test_families_around_the_threshold(spark):
    r = random.Random(3)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "a b c d e f g h"), (5, "a b c d e f g h i"), (6, "a b c d e f g")]
    footer = words(r, 40)
    for n in (30, 120, 300):
        base = words(r, n)
        for _ in range(60):
            rows.append((len(rows), " ".join(edited(r, base, r.randrange(1, 1 + n // 20)) + footer * r.randrange(2))))
    assert ids(spark, rows) == kept(rows)


def test_meetings_of_groups():
    """All pairs of different groups that share a shingle at places where they can be near, but those that parities tell apart."""
    r = np.random.default_rng(1)
    rows = np.column_stack([np.full(80, 5), r.permutation(80), np.zeros(80, dtype=np.int64), r.integers(40, 60, 80), r.integers(0, 12, 80), r.integers(0, 6, 80),
                            *np.zeros((jaccard.PARITIES, 80), dtype=np.int64)])
    rows[:, 6] = r.choice([0, (1 << 30) - 1], 80)
    got = sorted((a, b, n) for pairs in jaccard._group(rows) for a, _, b, _, n in pairs.tolist())
    want = sorted((x[1], y[1], max(x[3], y[3])) for x in rows.tolist() for y in rows.tolist() if x[1] < y[1] and x[5] != y[5]
                  and 9 * min(x[3] - x[4], y[3] - y[4], (x[3] + y[3] - 30 * (x[6] != y[6])) // 2) >= 4 * (x[3] + y[3]))
    assert got == want


def test_sketches_never_say_too_much():
    r = np.random.default_rng(2)
    for _ in range(300):
        pool = np.unique(r.integers(0, 1 << 63, r.integers(4, 900), dtype=np.uint64))
        a, b = (np.unique(r.choice(pool, r.integers(1, len(pool) + 1))) for _ in range(2))
        far = len(np.setxor1d(a, b))
        assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(b)) <= far
        assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(a)) == 0
        assert np.bitwise_count((jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64)).sum() <= far


def test_runs_come_out_as_they_went_in():
    nodes = np.array([[7, -8, 40], [5, 6, 50], [1, 2, 60]])
    entries = np.array([(3, 2, 0), (9, 0, 1), (1 << 63, 2, 5)], dtype=jaccard._IN_RUN)
    got = jaccard._unpacked(jaccard._packed(entries, nodes))
    assert got.tolist() == [(3, 1, 2, 60, 0), (9, 7, -8, 40, 1), (1 << 63, 1, 2, 60, 5)]


def test_repeated_rows_and_other_columns(spark):
    base = " ".join(words(random.Random(9), 200))
    rows = [(5, base, "b"), (5, base, "b"), (5, base, "a"), (7, base + " end", "c"), (None, base, "d"), (None, "alone here", "e"), (None, "alone here", "e"), (9, None, "f"), (3, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").withColumn("n", F.lit(1)).withColumn("root", F.lit("x"))
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id) == [(3, ""), (5, base)]
    assert [r.text for r in got.collect() if r.doc_id is None] == ["alone here"]
    assert simhash.keep_first(docs.where("false")).count() == 0


def test_copies_go_through_the_covering_code(spark, monkeypatch):
    """SimHash gives a pair for each text but one of a group near each other, and these are what is checked first."""
    given = []
    plain = jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda docs, size, likely: given.append(sorted(map(tuple, likely.collect()))) or plain(docs, size, likely))
    r = random.Random(5)
    base, other = words(r, 600), words(r, 600)
    rows = [(n, " ".join(base[:590 + n])) for n in range(8)] + [(8, " ".join(other)), (9, "one two")]
    assert ids(spark, rows) == kept(rows) == [0, 8, 9]
    sets = [jaccard.shingles(t, 5) for _, t in rows[:9]]
    prints = [simhash.majority(g) for g in sets]
    nodes = [jaccard.node_of(g) for g in sets]
    near = {tuple(sorted((nodes[i], nodes[j]))) for i in range(9) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}
    pairs = {(p[:2], p[2:]) for p in given[0]}
    assert pairs and pairs <= near

    def groups(links):
        root = {n: n for n in nodes}
        for a, b in links:
            old, new = root[a], root[b]
            root = {n: new if x == old else x for n, x in root.items()}
        return sorted(sorted(n for n in nodes if root[n] == x) for x in set(root.values()))
    assert groups(pairs) == groups(near)
