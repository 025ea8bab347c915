"""Packing against the tokenizer itself, and the curve against its definition."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keepsake.llm import packing, queries
from keepsake.sources.tables import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.TOKENIZER)


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_on_the_grid(n, bits):
    grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1).T
    place = packing.hilbert(grid, bits)
    assert sorted(place.tolist()) == list(range(1 << n * bits))
    walk = grid[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(pieces, texts, tokenizer, length):
    """Every id in one piece, sequences without gaps, and padded lengths only."""
    want = [(i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in texts]
    by_sequence = {}
    rows = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    got, open_rows = [], {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        held = open_rows.setdefault((r.doc_id, r.doc_tokens), [])
        if r.start == 0:
            held.append([])
        mine = held[-1]
        assert len(mine) == r.start
        mine += np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(mine) == r.start + r.length
        if len(mine) == r.doc_tokens:
            got.append((r.doc_id, tuple(mine)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for spans in by_sequence.values():
        assert [s for s, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist()
        total = sum(n for _, n in spans)
        assert total == length or (total < length and total & (total - 1) == 0)


def test_rows_of_all_kinds(spark, tokenizer):
    r = random.Random(2)
    odd = ["it's <|endoftext|> ok", "é ́x", "A\x1cB\x85C D E", "ΣΑΣ Σ", "日本語 テキスト", "don'T'll 123 ,.;", "x" * 5000, "ﬁ Å", "a" + "̣́" * 3]
    texts = [(1, None), (2, ""), (3, "one"), (3, "one"), (3, "other"), (None, "one two"), (4, " \n\t ")]
    texts += [(10 + i, t) for i, t in enumerate(odd)] + [(100 + i, " ".join(r.choice(odd + ["cat", "sat", "dog"]) for _ in range(r.randint(1, 60)))) for i in range(40)]
    made = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("key", F.lit(1))
    first = packing.packed(made.repartition(3), length=256).collect()
    check(first, texts, tokenizer, 256)
    again = packing.packed(made.repartition(7), length=256).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert packing.packed(made.where("false")).count() == 0


def test_the_query(spark, tokenizer):
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    texts = dict(docs)
    rows = queries.op12_packing(spark, SMALL).collect()
    covered = {}
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    assert covered == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in docs}


def test_copies_stand_together(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = [" ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(200)) for r in map(random.Random, range(60))]
    docs = [(i, base[i % 60] + (" more" if i >= 60 else "")) for i in range(120)]
    rows = packing.packed(spark.createDataFrame(docs, "doc_id long, text string"), length=1 << 20).collect()
    where = {r.doc_id: (r.sequence_id, r.offset) for r in rows}
    place = {d: k for k, d in enumerate(sorted(where, key=where.get))}
    apart = sorted(abs(place[i] - place[i + 60]) for i in range(60))
    assert apart[30] <= 2  # any two of 120 would be 40 apart


def test_many_words_are_forgotten_and_learnt_again(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 5)
    monkeypatch.setattr(packing, "PARTS", 3)
    coder = packing.Encoder(packing.TOKENIZER)
    for t in ["a b c", "d e f", "a b c d e f g h", "h a"]:
        assert np.frombuffer(coder.encode(t)[0], coder.width).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_words_of_all_letters(tokenizer):
    """Each letter for itself and in words, with marks, digits, capitals and contractions around."""
    r, coder = random.Random(4), packing.Encoder(packing.TOKENIZER)
    letters = [chr(c) for c in [*range(0x21, 0x250), *range(0x300, 0x310), *range(0x391, 0x3CA), 0x1E9E, 0x2028, 0xFB01, 0x4E2D, 0x1F600, 0xAC00] if chr(c).strip()]
    texts = letters + ["".join(r.choice(letters[:94] if r.random() < 0.5 else letters) for _ in range(r.randint(1, 9))) for _ in range(20_000)]
    texts += [a + b + c for a in ("don", "DON", "é", "1", "") for b in ("'s", "'T", "'re", "'VE", "'m", "'ll", "'d", "''", "<|endoftext|>") for c in ("", "x", "'s", "2")]
    for t in texts:
        assert np.frombuffer(coder.encode(t)[0], coder.width).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
