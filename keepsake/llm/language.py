"""The languages of mixed texts: scripts narrow the candidates of each word, Viterbi labels spans.

A word's score for a language is the sum over its letter groups (one to four letters, word edges included) of the log of how often the language's
texts have the group. The ranges of code points its letters fall in ("scripts") leave only languages whose texts use that
script. The Viterbi path over all words of a text pays a penalty for each switch of language, so single odd words don't
break a span. A text's language is that of most of its letters. Counts are
taken over a sample of learning texts, ``SAMPLE`` by hash of the id (all if there are fewer); groups are hashed into a table of
``BUCKETS`` for each language, which bounds the model by the number of languages.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import pick, remainder

BUCKETS = 1 << 15
SWITCH = 12.0
SIZES = (1, 2, 3, 4)
_CACHE = 1 << 19
SAMPLE = 20_000
_GAP = 4
#: First code points of the ranges that count as scripts; letters below the first are Latin.
_RANGES = np.array([0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00, 0x0D80, 0x0E00,
                    0x0E80, 0x0F00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0])
#: Latin with additions is Latin.
_SAME = {24: 0}
_SCRIPTS = len(_RANGES) + 1


def plain(token: str) -> str:
    """The letters of a word in lower case."""
    token = token.lower()
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


def groups(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket) of every letter group of the words, and the script of each word (that of its first letter)."""
    joined = "".join("^" + w + "$" + "\0" * _GAP for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words])
    owner = np.repeat(np.arange(len(words)), lengths + 2 + _GAP)
    who, what = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    alive = np.ones(len(codes), dtype=bool)
    for k in range(max(SIZES)):
        moved = np.zeros_like(codes)
        moved[:len(codes) - k] = codes[k:]
        alive &= moved > 0
        h = (h ^ moved) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if k + 1 in SIZES:
            at = np.nonzero(alive)[0]
            who.append(owner[at])
            what.append(((h[at] + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    starts = np.cumsum(lengths + 2 + _GAP) - (lengths + 2 + _GAP) + 1
    script = np.searchsorted(_RANGES, codes[starts].astype(np.int64), "right")
    for a, b in _SAME.items():
        script[script == a] = b
    return np.concatenate(who), np.concatenate(what), script


class Model:
    """Log probabilities (language, bucket), and which scripts each language uses."""

    def __init__(self, names: list[str], logs: np.ndarray, uses: np.ndarray) -> None:
        self.names, self.logs, self.uses = names, logs, uses

    def scores(self, words: list[str]) -> np.ndarray:
        who, what, script = groups(words)
        out = np.stack([np.bincount(who, row[what], minlength=len(words)) for row in self.logs], axis=1)
        allowed = self.uses[:, script].T
        out[allowed.any(axis=1)[:, None] & ~allowed] -= 1000.0
        return out - out.max(axis=1, keepdims=True)


def train(docs: DataFrame) -> Model | None:
    """A model from all rows of ``docs`` (text, lang) whose language isn't null; None if there are none."""
    schema = pa.schema([("lang", pa.string()), ("what", pa.int32()), ("n", pa.int64())])

    def count(batches):
        words: dict[str, Counter] = {}
        held = 0

        def out():
            for lang, found in words.items():
                listed = list(found)
                totals = np.zeros(BUCKETS + _SCRIPTS, dtype=np.int64)
                for at in range(0, len(listed), 50_000):
                    part = listed[at:at + 50_000]
                    n = np.array([found[w] for w in part])
                    who, what, script = groups(part)
                    totals[:BUCKETS] += np.bincount(what, n[who], minlength=BUCKETS).astype(np.int64)
                    totals[BUCKETS:] += np.bincount(script, n, minlength=_SCRIPTS).astype(np.int64)
                some = np.nonzero(totals)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(totals[some])], schema=schema)

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words.setdefault(lang, Counter())
                before = len(own)
                for token, n in Counter(text.split()).items():
                    if w := plain(token):
                        own[w] += n
                held += len(own) - before
                if held > _CACHE:
                    yield from out()
                    words, held = {}, 0
        yield from out()

    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, what int, n long").groupBy("lang", "what").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique().tolist())
    if not names:
        return None
    table = np.zeros((len(names), BUCKETS + _SCRIPTS))
    place = {n: i for i, n in enumerate(names)}
    table[[place[x] for x in counts["lang"]], counts["what"].to_numpy()] = counts["n"].to_numpy()
    seen, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    logs = np.log((seen + 0.5) / (seen.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    return Model(names, logs, scripts > 0.001 * scripts.sum(axis=1, keepdims=True))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best labels of many texts at once; ``scores`` (word, language) of all their words after each other.

    All texts take a step together, longest first, so the work in Python grows with the longest text only.
    """
    n, k = scores.shape
    labels = np.zeros(n, dtype=np.int16)
    lengths = np.asarray(lengths)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    if not n or k < 2:
        return labels
    back = np.zeros((n, k), dtype=np.int16)
    active = int((sizes > 0).sum())
    best = scores[starts[:active]].copy()
    last = best.copy()
    counts = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # texts with more than t words
    stay = np.arange(k, dtype=np.int16)
    for t in range(1, sizes[0]):
        m = counts[t]
        best = best[:m]
        top = best.argmax(axis=1)
        jump = best[np.arange(m), top] - switch
        keep = best >= jump[:, None]
        at = starts[:m] + t
        back[at] = np.where(keep, stay, top[:, None])
        best = np.where(keep, best, jump[:, None]) + scores[at]
        last[:m] = best
    now = last.argmax(axis=1)
    for t in range(sizes[0] - 1, -1, -1):
        m = counts[t]
        at = starts[:m] + t
        labels[at] = now[:m]
        if t:
            now[:m] = back[at, now[:m]]
    return labels


class Labeller:
    """Labels the words of texts, with the scores of words met before."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.names)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)

    def _learn(self, tokens: list[str]) -> None:
        new = sorted(set(tokens).difference(self.known))
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            words = [plain(t) for t in part]
            rows = np.zeros((len(part), len(self.model.names)), dtype=np.float32)
            some = [i for i, w in enumerate(words) if w]
            if some:
                rows[some] = self.model.scores([words[i] for i in some])
            self.known.update(zip(part, range(len(self.rows), len(self.rows) + len(part))))
            self.rows = np.concatenate([self.rows, rows])
            self.letters = np.concatenate([self.letters, np.array([len(w) for w in words], dtype=np.int64)])

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str, int]]]:
        """Per text its spans: (first word, end, language, letters); words without a letter stand between spans or in one."""
        if len(self.known) > _CACHE:
            self._clear()
        split = [t.split() if t else [] for t in texts]
        tokens = [t for own in split for t in own]
        self._learn(tokens)
        index = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        sizes = np.array([len(own) for own in split])
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        worded = self.letters[index] > 0
        index, doc, place = index[worded], doc[worded], place[worded]
        out: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
        if len(index):
            labels = viterbi(self.rows[index], np.bincount(doc, minlength=len(texts)), SWITCH)
            first = np.nonzero(np.r_[True, (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])])[0]
            last = np.r_[first[1:], len(index)] - 1
            letters = np.add.reduceat(self.letters[index], first)
            for d, a, z, name, n in zip(doc[first].tolist(), place[first].tolist(), place[last].tolist(), labels[first].tolist(), letters.tolist()):
                out[d].append((a, z + 1, self.model.names[name], n))
        return out


def _batches(texts: list[str | None], most: int = 6_000_000):
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, spans: array of (at, to, lang, letters)) of ``docs`` (row, text); no spans without a model, a text or a letter."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32()), ("lang", pa.string()), ("letters", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("spans", kind)])

    def run(batches):
        labeller = Labeller(model) if model else None
        for batch in batches:
            at = 0
            for part in _batches(batch.column(1).to_pylist()):
                found = labeller.spans(part) if labeller else [[] for _ in part]
                listed = [[dict(zip(("at", "to", "lang", "letters"), s)) for s in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(listed, kind)], schema=schema)
                at += len(part)

    return docs.select("row", "text").mapInArrow(run, "row long, spans array<struct<at: int, to: int, lang: string, letters: long>>")


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans) of every row.

    Learns from the folds other than 0 of crc32(id) modulo 5 (a null id counts as the empty text, which is in fold 0). ``und`` with score 0 where the text is null or has no letter, or
    nothing could be learnt; else the language with most letters (ties: first by name) and its share of all letters. Repeated rows are predicted alike.
    """
    rows = pick(docs, row=F.col(id_col).cast("long"), text=text_col, lang=lang_col)
    held: Column = remainder(F.col("row"), 5) == 0
    learn = rows.where(~held & F.col("lang").isNotNull())
    share = int((1 << 30) * min(1.0, sample / max(learn.count(), 1)))
    model = train(learn.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share))
    spans = label(rows, model)
    totals = F.transform(F.array_distinct(F.transform("spans", lambda s: s["lang"])), lambda g: F.struct(
        F.aggregate(F.filter("spans", lambda s: s["lang"] == g), F.lit(0).cast("long"), lambda a, s: a + s["letters"]).alias("n"), g.alias("lang")))
    best = F.try_element_at(F.array_sort(totals, lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["lang"] < b["lang"], -1).otherwise(1)), F.lit(1))
    every = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["letters"])
    return spans.select(F.col("row").alias("doc_id"), held.alias("held_out"), F.coalesce(best["lang"], F.lit("und")).alias("lang_pred"),
                        F.coalesce(best["n"] / F.nullif(every, F.lit(0)), F.lit(0.0)).alias("score"), F.size("spans").alias("n_spans"))
