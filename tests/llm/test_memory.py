"""What a task holds at once stays small, whatever the number of words or meetings."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from keepsake.llm import jaccard, toxicity
from keepsake.session import BATCH


def held(work):
    """MB that Python and numpy hold at most meanwhile, and the result."""
    tracemalloc.start()
    try:
        out = work()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_kernel_rows_are_made_in_little_memory():
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzäé", k=r.randrange(1, 14))) for _ in range(5000)] + ["", "aaaa", "x" * 3000]
    landmarks = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(5, 14))) for _ in range(200)]
    mb, got = held(lambda: toxicity.gram(words, landmarks))
    assert mb < 100  # dense vectors of the words take 500 and more
    who, what, weight = toxicity.subsequences(landmarks)
    known = np.unique(what)
    for k in (0, 7, 4999, 5000, 5001, 5002):
        left = np.zeros(len(known))
        _, mine, value = toxicity.subsequences([words[k]])
        at = np.searchsorted(known, mine)
        hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == mine)
        np.add.at(left, at[hit], value[hit])
        right = np.zeros((len(landmarks), len(known)))
        np.add.at(right, (who, np.searchsorted(known, what)), weight)
        lengths = np.maximum(toxicity.norms([words[k]])[0], 1e-12) * np.maximum(toxicity.norms(landmarks), 1e-12)
        assert np.allclose(got[k], right @ left / lengths)
    assert toxicity.gram([], landmarks).shape == (0, 200) and toxicity.gram(["ab", "abc"], ["a"]).tolist() == [[0], [0]]


def test_units_are_scored_in_little_memory():
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    landmarks, words = (["".join(r.choices(letters, k=r.randrange(low, 14))) for _ in range(n)] for low, n in ((5, 100), (1, 40_000)))
    model = toxicity._multiplied(landmarks, np.ones(len(landmarks)), -0.1)
    mb, got = held(lambda: model.decide(words))
    assert mb < 25  # 20,000 words at once take 50
    some = list(range(0, len(words), 4001))
    raw = toxicity.gram([words[k] for k in some], landmarks).sum(axis=1)
    assert np.allclose(got[some], raw - 0.1)


def test_heads_meet_in_little_memory():
    r = np.random.default_rng(3)
    n, texts = 600_000, 20_000
    e = np.zeros(n, dtype=jaccard._ENTRY)
    e["gram"], e["d0"], e["n"] = r.integers(0, n // 2, n), r.integers(0, texts, n), 100
    e["gram"][:300] = 5  # one that very many texts have
    mb, got = held(lambda: pa.Table.from_batches(jaccard._answer([e[k::6].copy() for k in range(6)])))
    assert mb < 100  # a whole partition at once takes 200 and more
    of = {}
    for g, d in zip(e["gram"].tolist(), e["d0"].tolist()):
        of.setdefault(g, set()).add(d)
    of, met, stars, times = {g: sorted(x) for g, x in of.items() if len(x) > 1}, set(), {}, {}
    for g, x in of.items():
        met.update((g, d) for d in x)
        for pair in [(x[0], d) for d in x[1:]] + [(x[i], x[i + k]) for k in jaccard.LAGS for i in range(len(x) - k)]:
            stars[pair] = stars.get(pair, 0) + 1
    heads = got.filter(pc.is_valid(got["gram"]))
    assert sorted(zip(heads["gram"].to_pylist(), heads["a0"].to_pylist())) == sorted(met)
    pairs = got.filter(pc.is_null(got["gram"]))
    for a, b, k in zip(*(pairs[c].to_pylist() for c in ("a0", "b0", "n"))):
        times[a, b] = times.get((a, b), 0) + k
    assert times == stars
    assert list(jaccard._answer([e[:0]])) == []


def test_the_pipeline_hands_small_batches_to_python(spark):
    before = spark.conf.get(BATCH[0])
    try:
        docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), 2000), F.col("id").cast("string")).alias("text"))
        labels = docs.select("doc_id", F.lit(0).alias("toxic"))
        assert toxicity_stage(spark, docs, labels) <= 5 << 20  # 20 MB in one batch without
    finally:
        spark.conf.set(BATCH[0], before)


def toxicity_stage(spark, docs, labels):
    """Bytes of the largest batch that a Python worker gets of rows as of that stage."""
    import tempfile

    import corpus_pipeline

    folder = tempfile.mkdtemp(prefix="keepsake-")
    labels.write.parquet(f"{folder}/labels.parquet")
    corpus_pipeline.toxicity(spark, docs.limit(20), folder)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    return docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
