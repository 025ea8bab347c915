"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

A text is scored by its worst units, and by how many it has to choose among. Units are its words in lower case without what isn't a letter ("i.d.i.o.t"), and runs
of single letters joined ("i d i o t"). The kernel of two units counts their common subsequences of three letters, each weighted by
``DECAY`` to the power of the letters it spans in either, up to ``SPAN``; so units that differ by gaps and inserted
letters stay similar. Labels are given for texts, so the units that make a text toxic are found first: those that cover the toxic training
texts and hardly occur in others. They and copies with a letter put in or left out are the positive examples, units of
texts that aren't toxic the negative ones, the most similar among them. The machine's weights over
landmarks are multiplied out into weights of subsequences, which score any unit exactly as the kernel expansion would.
The twelve worst decisions of a text, set against its number of units (a long text has many chances to hold a harmless word that looks
like an insult), become a probability by a logistic fit. That fit sees each half of the training texts through a machine trained on the other half.

Training takes a bounded sample of labelled rows, ``SAMPLE`` by hash of the id (all if there are fewer), and the machine is of bounded size: of the units that tell toxic texts
by the rates below, the ``CANDIDATES`` in most toxic texts are looked at and ``POSITIVE`` learnt; of the others, the ``NEGATIVE`` most similar to those and as many chosen by
hash; ``LANDMARKS`` in all. Without toxic texts, or without others, nothing can be told apart and no text is toxic. Scoring takes every text whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from keepsake.llm.common import pick, remainder
from keepsake.session import cut

DECAY = 0.6
SPAN = 6
SAMPLE = 20_000
CANDIDATES = 1000
POSITIVE = 200
NEGATIVE = 1000
LANDMARKS = 300
THRESHOLD = 0.3
EVIDENCE = 7
#: Letters of words whose subsequences are made at once, numbers held at once to add up a kernel's rows, and bytes of text whose units are held.
LETTERS, PIECE, CHARS = 1 << 15, 1 << 21, 1 << 21
_CACHE = 1 << 17
_SINGLES = re.compile(r"(?<!\S)\S(?:[ \t]\S(?!\S))+")


def _letters(token: str) -> str:
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


def units(text: str | None) -> set[str]:
    """The distinct units of a text."""
    text = text.lower() if text else ""
    out = {_letters(t) for t in set(text.split())}
    out.update(_letters(m) for m in _SINGLES.findall(text))
    out.discard("")
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, three letters packed into one number, weight) of all subsequences within the span; unweighted repeats stay apart."""
    gap = "\0" * (SPAN - 1)
    codes = np.frombuffer((gap.join(words) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), [len(w) + SPAN - 1 for w in words])
    who, what, weight = [], [], []
    for j in range(2, SPAN):
        last, mine = codes[j:], (codes[:-j] > 0) & (codes[j:] > 0) & (owner[:-j] == owner[j:])
        at = np.nonzero(mine)[0]
        for i in range(1, j):
            who.append(owner[at])
            what.append(codes[at] << 42 | codes[at + i] << 21 | last[at])
            weight.append(np.full(len(at), DECAY ** (j + 1)))
    return np.concatenate(who), np.concatenate(what), np.concatenate(weight)


def runs(words: list[str]) -> Iterator[slice]:
    """Slices of the words in order, of ``LETTERS`` letters or little more each; a longer word is alone in its slice."""
    part = np.cumsum([len(w) + SPAN for w in words], dtype=np.int64) // LETTERS
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() if len(words) else []
    yield from map(slice, cuts, [*cuts[1:], len(words)])


def _lengths(who: np.ndarray, what: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((what, who))
    who, what, weight = who[order], what[order], weight[order]
    first = np.r_[True, (who[1:] != who[:-1]) | (what[1:] != what[:-1])] if len(who) else np.zeros(0, dtype=bool)
    sums = np.add.reduceat(weight, np.nonzero(first)[0]) if first.any() else weight
    return np.sqrt(np.bincount(who[first], sums ** 2, minlength=n))


def norms(words: list[str]) -> np.ndarray:
    """The length of each word's vector of subsequences."""
    return np.concatenate([np.zeros(0), *(_lengths(*subsequences(part), len(part)) for part in (words[s] for s in runs(words)))])


class Kernel:
    """The normalised kernel with each of the landmarks. Vectors of words stay sparse: only the subsequences that a landmark has are kept."""

    def __init__(self, landmarks: list[str]) -> None:
        who, what, weight = subsequences(landmarks)
        self.known, place = np.unique(what, return_inverse=True)
        size = len(landmarks)
        self.columns = np.bincount(place * size + who, weight, minlength=len(self.known) * size).astype(float).reshape(len(self.known), size)
        self.columns /= np.maximum(_lengths(who, what, weight, size), 1e-12)

    def pieces(self, words: list[str]) -> Iterator[np.ndarray]:
        """The rows of the words in order, a few at a time; 0 for words too short to have a subsequence."""
        for part in (words[s] for s in runs(words)):
            who, what, weight = subsequences(part)
            lengths = np.maximum(_lengths(who, what, weight, len(part)), 1e-12)
            at = np.searchsorted(self.known, what)
            hit = at < len(self.known)
            hit[hit] = self.known[at[hit]] == what[hit]
            key, place = np.unique(who[hit] * max(len(self.known), 1) + at[hit], return_inverse=True)
            value, (row, at) = np.bincount(place, weight[hit], minlength=len(key)), np.divmod(key, max(len(self.known), 1))
            ends = np.searchsorted(row, np.arange(len(part)), side="right")
            turn = ends * max(self.columns.shape[1], 1) // PIECE
            cuts = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(part)]):
                mine = slice(ends[a - 1] if a else 0, ends[b - 1])
                out = np.zeros((b - a, self.columns.shape[1]))
                if mine.start < mine.stop:
                    terms = self.columns[at[mine]]
                    terms *= value[mine, None]
                    starts = np.flatnonzero(np.r_[True, row[mine][1:] != row[mine][:-1]])
                    out[row[mine][starts] - a] = np.add.reduceat(terms, starts, axis=0)
                yield out / lengths[a:b, None]


def gram(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised kernel of each word with each landmark; 0 for words too short to have a subsequence."""
    return np.concatenate([np.zeros((0, len(landmarks))), *Kernel(landmarks).pieces(words)])


@dataclass
class Model:
    """Weights of subsequences over a small alphabet, the bias, and the logistic weights of a text's evidence, the constant last."""

    letters: str
    weights: np.ndarray
    bias: float
    logistic: np.ndarray

    def decide(self, words: list[str]) -> np.ndarray:
        if not words or not len(self.weights):
            return np.full(len(words), self.bias)
        size = len(self.letters) + 1
        table = np.zeros(0x110000, dtype=np.int32)
        for i, c in enumerate(self.letters):
            table[ord(c)] = i + 1
        out = np.full(len(words), self.bias)
        for some in runs(words):
            part, start = words[some], some.start
            gap = "\0" * (SPAN - 1)
            codes = np.frombuffer((gap.join(part) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            owner = np.repeat(np.arange(len(part)), [len(w) + SPAN - 1 for w in part])
            small = table[codes].astype(np.int64)
            raw = np.zeros(len(part))
            for j in range(2, SPAN):
                at = np.nonzero((small[:-j] > 0) & (small[j:] > 0) & (owner[:-j] == owner[j:]))[0]
                for i in range(1, j):
                    raw += np.bincount(owner[at], self.weights[(small[at] * size + small[at + i]) * size + small[at + j]] * DECAY ** (j + 1), minlength=len(part))
            positive = np.nonzero(raw > 0)[0]  # the others can't be above the bias
            if len(positive):
                out[start + positive] += raw[positive] / np.maximum(norms([part[k] for k in positive]), 1e-12)
        return out

    def probabilities(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.logistic, -50, 50)))


class Scorer:
    """Evidence and probability of texts, with the decisions of units met before."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def evidence(self, bags: list[set[str] | list[str]]) -> np.ndarray:
        """One row per text: its three worst decisions, the means of the next three and six, the worst times the logarithm of
        the number of units, and 1. Decisions run from 0 (surely harmless) to 1; 0 where there are fewer units."""
        if len(self.known) > _CACHE:
            self.known = {}
        known = self.known
        new = list({u for bag in bags for u in bag if u not in known})
        known.update(zip(new, self.model.decide(new).tolist()))
        out = np.zeros((len(bags), EVIDENCE))
        for row, bag in zip(out, bags):
            worst = np.zeros(12)
            top = heapq.nlargest(12, [known[u] for u in bag])
            worst[:len(top)] = (np.clip(top, -1, 1) + 1) / 2
            row[:] = (*worst[:3], worst[3:6].mean(), worst[6:].mean(), worst[0] * np.log1p(len(bag)), 1)
        return out

    def probabilities(self, bags: list[set[str] | list[str]]) -> list[float]:
        return self.model.probabilities(self.evidence(bags)).tolist()


def _by_length(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices of ``CHARS`` bytes of that column, or of one row that has more."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // CHARS
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() if len(part) else []
        for a, b in zip(cuts, [*cuts[1:], len(part)]):
            yield batch.slice(a, b - a)


def _bags(rows: DataFrame) -> DataFrame:
    """(row, toxic, units, mark); ``mark`` is the same for most near copies: the three smallest hashes of pairs of words, or the text's if it has no pair."""
    schema = pa.schema([("row", pa.int64()), ("toxic", pa.int32()), ("units", pa.list_(pa.string())), ("mark", pa.string())])

    def run(batches):
        for batch in _by_length(batches, 2):
            plain = batch.column(2).to_pylist()
            texts = [sorted(units(t)) for t in plain]
            marks = [",".join(heapq.nsmallest(3, {xxhash.xxh64_hexdigest(f"{a} {b}") for a, b in pairwise((t or "").split())})) or xxhash.xxh64_hexdigest(t or "")
                     for t in plain]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, schema.types[2]), pa.array(marks, pa.string())], schema=schema)

    return rows.select("row", "toxic", "text").mapInArrow(run, "row long, toxic int, units array<string>, mark string")


def _variants(word: str) -> set[str]:
    """The word with one letter left out, or one put in."""
    return {word[:i] + word[i + 1:] for i in range(len(word))} | {word[:i] + "x" + word[i:] for i in range(1, len(word))} | {word}


def _witnesses(bags: DataFrame, counts: DataFrame, toxic: int, clean: int) -> list[str]:
    """Units that tell toxic texts: greedily those in most toxic texts not yet explained, and all that are about as frequent."""
    rate = (F.col("bad") / toxic) > 20 * (F.col("good") + 0.5) / max(clean, 1)
    least = 2 if toxic >= 8 else 1
    top = counts.where(rate & (F.col("bad") >= least)).orderBy(F.desc("bad"), "good", "unit").limit(CANDIDATES).collect()
    if not top:
        return []
    held = bags.where("toxic = 1").select("row", F.explode("units").alias("unit")).where(F.col("unit").isin([r.unit for r in top]))
    cover: dict[str, set] = {}
    for r in held.distinct().toLocalIterator():
        cover.setdefault(r.unit, set()).add(r.row)
    size = {r.unit: (r.bad, -r.good) for r in top}
    open_rows, found = set().union(*cover.values()), []
    while open_rows and len(found) < POSITIVE:
        best = max(cover, key=lambda u: (len(cover[u] & open_rows), size[u], u))
        if len(cover[best] & open_rows) < max(least, 0.01 * toxic):
            break
        found.append(best)
        open_rows -= cover[best]
    usual = 0.5 * float(np.median([size[u][0] for u in found])) if found else 0
    found += [r.unit for r in top if r.unit not in found and r.bad >= max(usual, least)]
    return found[:POSITIVE]


def _svm(z: np.ndarray, y: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias by squared hinge loss with both classes weighing alike, by Newton steps."""
    x = np.column_stack([z, np.ones(len(z))])
    c = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * cost * 100
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        open_ = y * (x @ w) < 1
        a = x[open_] * c[open_, None]
        new = np.linalg.solve(ridge + a.T @ x[open_], a.T @ y[open_])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit with a weak prior to ``Scorer.evidence``: no decision may speak for a text and no length against it,
    so weights of the wrong sign are left out."""
    sign = np.r_[np.ones(EVIDENCE - 2), -1, 0]
    used = np.ones(EVIDENCE, dtype=bool)
    while True:
        w = np.zeros(EVIDENCE)
        w[used] = _newton(x[:, used], y)
        if not (w * sign < 0).any():
            return w
        used &= w * sign >= 0


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    prior = np.r_[np.full(len(w) - 1, 0.1), 0.001]
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(prior), x.T @ (p - y) + prior * w)
        step *= min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """A model from ``docs`` (row, text) where ``learn`` holds and ``labels`` (row, toxic), of which nulls are left out.

    Without toxic or other texts to learn from, or units that tell them apart, the model gives every text a score of almost 0: labels of other texts are no evidence.
    """
    known = labels.where("toxic is not null and row is not null").groupBy("row").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = cut(docs.where(learn).select("row").join(known, "row"))
    n = ids.count()
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1)))
    bags = cut(_bags(docs.where(learn & share).join(ids.where(share).distinct(), "row")))
    # Copies of one toxic text would make all of its words look toxic: they count once.
    apart = cut(bags.groupBy("toxic", "mark").agg(F.min(F.struct("row", "units")).alias("one")).select("one.row", "toxic", "one.units"))
    half = F.pmod(F.xxhash64("row", F.lit("half")), F.lit(2))
    model = _machine(apart)
    halves = [_machine(apart.where(half != side)) for side in (0, 1)]
    if model is None:
        return Model("", np.zeros(0), 0.0, np.r_[np.zeros(EVIDENCE - 1), -30.0])
    # Too few texts for halves: the fit sees the texts through the machine trained on them.
    views = [(apart, model)] if None in halves else [(apart.where(half == side), m) for side, m in enumerate(halves)]
    seen = pd.concat([_evidence(rows, m).toPandas() for rows, m in views]).sort_values("row")
    model.logistic = _logistic(np.stack(seen["evidence"].to_numpy()), seen["toxic"].to_numpy().astype(float))
    return model


def _evidence(bags: DataFrame, model: Model) -> DataFrame:
    """(row, toxic, evidence) of ``bags`` (row, toxic, units)."""
    schema = pa.schema([("row", pa.int64()), ("toxic", pa.int32()), ("evidence", pa.list_(pa.float64()))])

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            found = scorer.evidence(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(found), schema.types[2])], schema=schema)

    return bags.select("row", "toxic", "units").mapInArrow(run, "row long, toxic int, evidence array<double>")


def _totals(apart: DataFrame) -> Row:
    return apart.agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")).first()


def _machine(apart: DataFrame) -> Model | None:
    """The support vector machine of ``apart`` (row, toxic, units); None without toxic or other texts or units that tell them apart."""
    totals = _totals(apart)
    bad, good = totals.bad, totals.good
    if not bad or not good:
        return None
    counts = cut(apart.select("toxic", F.explode("units").alias("unit")).groupBy("unit").agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")))
    positive = _witnesses(apart, counts, bad, good)
    if not positive:
        return None

    def similar(batches):
        kernel = Kernel(positive)
        for batch in batches:
            near = [k.max(axis=1) for k in kernel.pieces(batch.column(0).to_pylist())]
            if near:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(near))], names=["unit", "near"])

    others = counts.where(~F.col("unit").isin(positive) & (F.col("good") / good >= F.col("bad") / bad)).select("unit")
    near = cut(others.mapInArrow(similar, "unit string, near double"))
    hard = [r.unit for r in near.orderBy(F.desc("near"), "unit").limit(NEGATIVE).collect()]
    easy = [r.unit for r in near.orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVE).collect()]
    negative = sorted(set(hard) | set(easy))
    augmented = sorted({v for p in positive for v in _variants(p)} - set(negative))
    landmarks = positive + [w for w in hard if w not in positive][:LANDMARKS - len(positive)]
    k = gram(landmarks, landmarks)
    values, vectors = np.linalg.eigh(k)
    keep = values > 1e-8
    root = vectors[:, keep] / np.sqrt(values[keep])
    words = augmented + negative
    w, bias = _svm(gram(words, landmarks) @ root, np.r_[np.ones(len(augmented)), -np.ones(len(negative))])
    return _multiplied(landmarks, root @ w, bias)


def _multiplied(landmarks: list[str], alpha: np.ndarray, bias: float) -> Model:
    letters = "".join(sorted(set("".join(landmarks))))
    size = len(letters) + 1
    place = {c: i + 1 for i, c in enumerate(letters)}
    who, what, weight = subsequences(landmarks)
    value = weight * (alpha / np.maximum(norms(landmarks), 1e-12))[who]
    a, b, c = (np.array([place[chr(x)] for x in ((what >> s) & 0x1FFFFF).tolist()], dtype=np.int64) for s in (42, 21, 0))
    return Model(letters, np.bincount((a * size + b) * size + c, value, minlength=size ** 3), bias, np.zeros(EVIDENCE))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score) of ``docs`` (row, text); texts without a unit get the score of no evidence."""
    schema = pa.schema([("row", pa.int64()), ("score", pa.float64())])

    def run(batches):
        scorer = Scorer(model)
        for batch in _by_length(batches, 1):
            rows, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                made = scorer.probabilities([units(t) for t in texts[at:at + 500]])
                yield pa.RecordBatch.from_arrays([rows.slice(at, 500), pa.array(made, pa.float64())], schema=schema)

    return docs.select("row", "text").mapInArrow(run, "row long, score double")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null id counts as the empty text when folds are dealt.

    Labels are learnt from rows of the folds 0, 1 and 3 of crc32(id) modulo 4; only the text is used to score. Null and empty texts get a low score,
    repeated rows the same score. Labels without a document, and nulls in labels, change nothing. An empty table gives no rows; if nothing can be learnt no text is
    toxic; a very long text is scored whole. Other columns of the tables don't matter, whatever their names.
    """
    rows = pick(docs, row=F.col(id_col).cast("long"), text=text_col)
    fold = remainder(F.col("row"), 4)
    model = train(rows, pick(labels, row=F.col("doc_id").cast("long"), toxic="toxic"), (fold != 2) & F.col("row").isNotNull())
    out = score(rows, model)
    return out.select(F.col("row").alias("doc_id"), (remainder(F.col("row"), 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold.

    Rows with null and empty texts stay, as do all if nothing can be learnt; repeated rows stay or go together, whatever their ids; columns keep their names and places.
    """
    rows = pick(docs, row=F.col(id_col).cast("long"), text=text_col)
    fold = remainder(F.col("row"), 4)
    model = train(rows, pick(labels, row=F.col("doc_id").cast("long"), toxic="toxic"), (fold != 2) & F.col("row").isNotNull())
    place = docs.columns.index(next(c for c in docs.columns if c.lower() == text_col.lower()))

    def run(batches):
        scorer = Scorer(model)
        for batch in _by_length(batches, place):
            texts = batch.column(place).to_pylist()
            kept = [p < THRESHOLD for at in range(0, len(texts), 500) for p in scorer.probabilities([units(t) for t in texts[at:at + 500]])]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
