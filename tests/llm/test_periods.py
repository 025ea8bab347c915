"""Runs against their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from keepsake.llm import periods, queries
from keepsake.sources.tables import table

SMALL = "/root/testdata/sf0.001"


def lyndon(word):
    """The longest prefix of each suffix that is smaller than all its own suffixes."""
    return [max(k for k in range(1, len(word) - i + 1) if all(word[i:i + k] < word[j:i + k] for j in range(i + 1, i + k))) for i in range(len(word))]


def plain_runs(word, least=12):
    found = []
    for q in range(1, len(word) // 2 + 1):
        i = 0
        while i + q < len(word):
            j = i
            while j + q < len(word) and word[j] == word[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, 2 * q) and not any(all(word[t] == word[t + d] for t in range(i, i + n - d)) for d in range(1, q)):
                found.append((i, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_of(seed):
    r = random.Random(seed)
    out = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randint(0, 40))]
    for _ in range(r.randint(0, 3)):
        root = out[-r.randint(1, 9):] or [0]
        out += (root * 9)[:r.randint(1, 40)] + [r.randrange(9) for _ in range(r.randint(0, 4))]
    return out


def test_lyndon_arrays():
    for seed in range(400):
        word = words_of(seed)[:60]
        if word:
            assert periods.lyndon_lengths(np.array(word)).tolist() == lyndon(word)
            assert periods.lyndon_lengths(-np.array(word)).tolist() == lyndon([-w for w in word])


def test_extensions():
    r = random.Random(1)
    for seed in range(100):
        word = np.array(words_of(seed) or [0])
        extend = periods.Extensions(word)
        for _ in range(20):
            i, j = sorted((r.randint(0, len(word)), r.randint(0, len(word))))
            if i < j:
                after = next((k for k in range(len(word) - j) if word[i + k] != word[j + k]), len(word) - j)
                before = next((k for k in range(i) if word[i - 1 - k] != word[j - 1 - k]), i)
                assert extend.after(np.array([i]), np.array([j])) == after and extend.before(np.array([i]), np.array([j])) == before


def test_runs_with_and_without_the_sieve():
    for seed in range(1500):
        word = words_of(seed)
        least = (2, 5, 12)[seed % 3]
        want = plain_runs(word, least)
        assert [tuple(x) for x in periods.runs(np.array(word, dtype=np.int64), least).tolist()] == want
        assert [tuple(x) for x in periods.of_words([b"%d" % w for w in word], least)[0].tolist()] == want


def collapsed(words, runs):
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_rows_of_all_kinds(spark):
    texts = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "ha " * 30), (4, "a\x1cb é " * 9), (5, " ".join(f"w{i}" for i in range(60_000)) + " x y z" * 20_000)]
    texts += [(10 + s, " ".join(map(str, words_of(s)))) for s in range(50)]
    made = spark.createDataFrame(texts, "doc_id long, text string").withColumn("runs", F.lit("x")).withColumn("h", F.lit(1))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic(made).collect()]
    want = []
    for i, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        runs = plain_runs(w) if i != 5 else [(60_000, 60_000, 3)]
        want.append((i, len(w), runs, collapsed(w, runs)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periods.periodic(made.where("false")).count() == 0
    assert periods.with_tails(made.where("false")).count() == 0


def test_the_query(spark):
    want = []
    for r in table(spark, SMALL, "documents").collect():
        w = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        sha = (lambda s: hashlib.sha256(s.encode()).hexdigest())
        want.append((r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(collapsed(w, runs))))
    got = queries.op13_runs(spark, SMALL)
    assert got.columns[:2] == ["doc_id", "n_runs"] and dict(got.dtypes)["exponent_milli"] == "bigint"
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_tails_of_null_and_empty_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = [(ids[0], None), (ids[1], ""), (ids[2], "  "), (ids[3], "a"), (None, "a b c")]
    got = periods.with_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str)[:4] == sorted(rows[:4], key=str) and len(got) == 5
