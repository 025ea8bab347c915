"""Runs: stretches of words that repeat with a period, found from the Lyndon words that begin at each place.

Each run of period p holds a Lyndon word of length p (its root) that is the longest one to begin at some place, under an order of the words or under the
opposite one. The first phase of Baier's suffix sorter groups the places of a text by that longest Lyndon word, so the two Lyndon arrays
come from it directly, no suffix array is made. Each root is then extended to both sides as far as words one period apart agree (longest
common extensions), and is a run if it comes to two periods. A sieve leaves out what can't be in a run of twelve words: such a run is covered by
sequences of six words that occur twice in the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import WORD, pick
from keepsake.llm.hashing import mixed
from keepsake.sources.tables import spread

LEAST = 12


def lyndon_lengths(codes: np.ndarray) -> np.ndarray:
    """For each place the length of the longest Lyndon word that begins there, by Baier's grouping.

    Groups are kept in order and worked from the highest down. All places of a group begin with the same Lyndon word u. The nearest place before one of
    them that is in a lower group has a word w that ends there: it becomes w u, or w u u ... if several of the group lead
    to it, and goes to a new group just above its old one.
    """
    _, first = np.unique(codes, return_inverse=True)
    n, k = len(codes), int(first.max()) + 1 if len(codes) else 0
    group = [-1] + first.tolist()  # places are numbered from 1; 0 stands before the text and is never done
    members: list[list[int]] = [[] for _ in range(k)]
    for i in range(1, n + 1):
        members[group[i]].append(i)
    below, above, size = list(range(-1, k - 1)), [*range(1, k), -1], [1] * k
    back = list(range(n + 1))  # itself, or for places of groups that are done a place before it
    at = k - 1
    while at >= 0:
        done = [i for i in members[at] if group[i] == at]
        members[at] = []
        for i in done:
            back[i] = i - 1
        led: dict[int, int] = {}
        for i in done:
            j = back[i]
            while back[j] != j:
                back[j] = j = back[back[j]]
            back[i] = j
            if j:
                led[j] = led.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in led.items():
            moved.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moved, reverse=True):
            new, over = len(size), above[old]
            members.append(moved[times, old])
            size.append(size[old] + times * size[at])
            below.append(old)
            above.append(over)
            above[old] = new
            if over >= 0:
                below[over] = new
            for j in moved[times, old]:
                group[j] = new
        at = below[at]
    return np.array([size[g] for g in group[1:]], dtype=np.int64)


class Extensions:
    """How far words agree from two places on, or before them, by ranks of all stretches of 1, 2, 4, ... words."""

    def __init__(self, codes: np.ndarray) -> None:
        self.ranks, width = [np.unique(codes, return_inverse=True)[1].astype(np.int64)], 1
        while 2 * width <= len(codes):
            last = self.ranks[-1]
            if int(last.max()) == len(last) - 1:
                break  # no longer stretch occurs twice
            pairs = last[:len(last) - width] * len(codes) + last[width:]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
            width *= 2

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words from i and from j > i on that agree."""
        got = np.zeros(len(i), dtype=np.int64)
        for level in reversed(range(len(self.ranks))):
            ranks = self.ranks[level]
            can = np.flatnonzero(j + got < len(ranks))
            got[can[ranks[i[can] + got[can]] == ranks[j[can] + got[can]]]] += 1 << level
        return got

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words before i and before j > i that agree."""
        got = np.zeros(len(i), dtype=np.int64)
        for level in reversed(range(len(self.ranks))):
            ranks, width = self.ranks[level], 1 << level
            can = np.flatnonzero(i - got - width >= 0)
            got[can[ranks[i[can] - got[can] - width] == ranks[j[can] - got[can] - width]]] += width
        return got


def runs(codes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of each run of at least two periods and ``least`` words, in order."""
    n = len(codes)
    found = [np.zeros((0, 3), dtype=np.int64)]
    if n < 2:
        return found[0]
    extend = Extensions(codes)
    for order in (codes, -codes):
        period = lyndon_lengths(order)
        i = np.arange(n)
        start = i - extend.before(i, i + period)
        end = i + period + extend.after(i, i + period)
        ok = end - start >= np.maximum(least, 2 * period)
        found.append(np.column_stack([start, end - start, period])[ok])
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def sieved(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches outside of which no word is in a run, each run being in one of them.

    A run of n words and period p has n - p >= least / 2 places that agree with those one period on, so each of its words is in a sequence of half of ``least``
    words that occurs twice.
    """
    half = -(-least // 2)
    n = len(codes)
    if n < least:
        return []
    hashes = np.zeros(n - half + 1, dtype=np.uint64)
    marks = mixed(codes.astype(np.uint64))
    for t in range(half):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + marks[t:n - half + 1 + t]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return []
    twice = order[np.r_[same, False] | np.r_[False, same]]
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + half, -1)
    inside = np.diff(np.r_[0, (np.cumsum(edge[:n]) > 0).astype(np.int8), 0])
    starts, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= least]


def of_words(words: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a text, and for each word whether it stays: words in a run after its first period go."""
    keep = np.ones(len(words), dtype=bool)
    found = [np.zeros((0, 3), dtype=np.int64)]
    if len(words) >= least:
        ids: dict[bytes, int] = {}
        codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
        for a, b in sieved(codes, least) if len(ids) < len(words) else ():
            mine = runs(codes[a:b], least)
            found.append(mine + np.array([a, 0, 0]))
    every = np.concatenate(found)
    if len(every):
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(gone, every[:, 0] + every[:, 2], 1)
        np.add.at(gone, every[:, 0] + every[:, 1], -1)
        keep = np.cumsum(gone[:-1]) == 0
    return every, keep


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs in order, and its words without the repetitions.

    ``runs`` is an array of (start, length, period) in words, numbered from 0: all stretches of ``least`` words and two periods that no word beside them
    continues. ``collapsed`` joins the words that stay by one space. Null and empty texts have no words and no runs; each row, repeated or not,
    is worked for itself; an empty table gives no rows; other columns don't matter, whatever their names. A text is held whole, with some
    200 bytes for each of its words that the sieve leaves.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def run(batches):
        for batch in batches:
            sizes, ends, rows, texts = [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().split()
                every, keep = of_words(words, least)
                sizes.append(len(words))
                rows.append(every)
                ends.append(ends[-1] + len(every))
                texts.append(b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]))
            flat = np.concatenate(rows) if rows else np.zeros((0, 3), dtype=np.int64)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(_RUN))
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), made, pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)

    rows = spread(pick(docs, doc_id=F.col(id_col).cast("long"), text=text_col))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): in a tenth of the rows, by hash of the id, the text ends in a repetition of some of its words.

    With h = crc32 of the id, g = h div 10 and n words, each word i >= a of a row with h mod 10 = 0 becomes word a + (i - a) mod p, where a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8). A null id counts as the empty text; texts without words stay.
    """
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = pick(docs, doc_id=id_col, text=text_col, h=h)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n = F.size("words").cast("long")
    chosen = (rows.where((F.col("h") % 10 == 0) & F.col("text").isNotNull()).select("doc_id", F.floor(F.col("h") / 10).alias("g"), "text", words.alias("words"))
              .withColumn("a", F.col("g") % F.nullif(n, F.lit(0))).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))))
    chosen = chosen.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.concat_ws(" ", F.transform(
        F.sequence(F.lit(0).cast("long"), F.size("words").cast("long") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(
            F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))).alias("text"))
    return rows.where((F.col("h") % 10 != 0) | F.col("text").isNull()).select("doc_id", "text").unionByName(chosen)


def listed(found: Column) -> Column:
    """Every run as a line ``start,length,period``."""
    return F.concat_ws("", F.transform(found, lambda r: F.concat_ws("", F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))


def longest(found: Column) -> Column:
    """The run of most words, of those the one that starts first, of those the one of the smallest period; null if there is none."""
    best = F.array_min(F.transform(found, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))
