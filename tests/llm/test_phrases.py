"""Collocations against plain counting, with tries that spill all the time."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import phrases


def texts():
    r = random.Random(5)
    words = ["the", "Of", "New", "YORK", "city", "straße", "İt", "a\x1cb", "x y"] + [f"w{i}" for i in range(30)]
    out = []
    for i in range(150):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "!?"]) for _ in range(r.randint(0, 120)))
        out.append((r.choice([i, 7, None]), t, r.choice(["en", "en", "en", None, "und", "de"])))
    out += [(1, None, "en"), (2, "", "fr"), (3, " . , ", "fr"), (4, "new york " * 3000, "en"), (5, "new york " * 3000, "en")]
    return out


def plain(rows, least=10, top=2000):
    out = []
    for lang in {x or "und" for _, _, x in rows}:
        f = Counter()
        for _, text, x in rows:
            if (x or "und") == lang:
                low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
                for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                    w = re.findall("[^\x20\x09]+", piece)
                    f.update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        some = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in some.items():
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * c >= 50 * a for q, c in some.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("held,burst,block", [(800_000, 4096, 1 << 18), (40, 3, 50)])
def test_equal_to_plain_counting(spark, monkeypatch, held, burst, block):
    rows = texts()
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit("x")).withColumn("phrase", F.lit(1)).repartition(5)
    pinned = {"HELD": held, "BURST": burst, "BLOCK": block, "CHARS": 2000}
    counter, trie = phrases.Counter(7), phrases.Trie()
    for name, value in pinned.items():
        monkeypatch.setattr(phrases, name, value)
    got = sorted(tuple(r) for r in phrases.collocations(made).collect())
    assert got == plain(rows)
    assert sorted(tuple(r) for r in phrases.collocations(made, top=3).collect()) == plain(rows, top=3)
    # The same in this process, where the small settings hold in any case.
    words = [w for _, t, x in rows if x == "en" for w in [*phrases.pieces(t or ""), b"."]]
    total = Counter()
    for batch in [*counter.add("en", words), *counter.spilled(0)]:
        for run in batch.column(2).to_pylist():
            table = phrases._unpacked(phrases.zstandard.ZstdDecompressor().decompress(run))
            total.update(dict(zip(table["phrase"].to_pylist(), table["n"].to_pylist())))
    pieces = b" ".join(words).split(b" .")
    want = Counter(b" ".join(w[i:i + k]) for p in pieces for w in [p.replace(b". ", b"").split()] for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert total == Counter({k: n for k, n in want.items() if k != b"."})
    assert trie.size == 0


def test_a_trie_keeps_counts_when_it_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 4)
    r = np.random.default_rng(3)
    trie, want, got = phrases.Trie(), Counter(), Counter()
    for _ in range(30):
        paths, n = np.unique(r.integers(1, 6, 40) << 42 | r.integers(0, 90, 40) << 21, return_counts=True)
        trie.add(paths, n)
        want.update(dict(zip(paths.tolist(), n.tolist())))
        if trie.size > 100:
            out, counts = trie.spill(20)
            assert trie.size <= 20 and (np.diff(out) > 0).all()
            got.update(dict(zip(out.tolist(), counts.tolist())))
    got.update(dict(zip(*(x.tolist() for x in trie.spill(0)))))
    assert got == want and trie.size == 0


def test_nothing_to_count(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "", "en")], empty.schema)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = spark.sql("select cast(4000000007 as bigint) a, cast(5000000029 as bigint) l, cast(4000000007 as bigint) r")
    score = rows.selectExpr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) s").first().s
    assert score == 1_000_000 * 4000000007**2 // (5000000029 * 4000000007)
