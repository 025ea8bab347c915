"""Collocations: phrases of two or three words that occur together far more often than their parts suggest.

Phrases are counted in a HAT-trie: below each first word hangs a hash container of the words that follow it, which bursts into ``FAN``
containers by the second word when it outgrows ``BURST``. Only the longest path (up to three words, up to the end of a piece) is stored at each
place of a text, a phrase's count being the sum below its node. When a task holds ``HELD`` paths, its largest subtrees are spilled whole: the counts of
their nodes, sorted and packed into one run for each prefix partition. A phrase belongs to the partition of its first two words, of which each prefix has up to
a 64th, told apart by the third word, so that a prefix that everyone uses has no task of its own. A partition's runs are
merged there and only phrases that reach the least count leave it; all else works on those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import pick
from keepsake.llm.hashing import mixed
from keepsake.operators.scale import top_by
from keepsake.session import cut

BURST, FAN = 4096, 64
#: Paths and different words that a task holds, and places of texts that are counted at a time.
HELD, WORDS, BLOCK = 800_000, 1 << 18, 1 << 18
#: Characters of text for each prefix partition; a prefix is spread over one in so many of them.
CHARS, SPREAD = 1 << 20, 64
_BITS = 21
_ID = (1 << _BITS) - 1
_STOP = b"."
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _STOP * 9)


def pieces(text: str) -> list[bytes]:
    """The words of a text, lower-cased from A to Z, with a full stop wherever a piece ends."""
    return text.encode().translate(_FOLD).replace(_STOP, b" . ").split()


class Trie:
    """Counts of paths of three word ids (zero: the piece has ended), packed into whole numbers."""

    def __init__(self) -> None:
        self.nodes: dict[int, dict[int, int] | list[dict[int, int]]] = {}
        self.size = 0

    def add(self, paths: np.ndarray, counts: np.ndarray) -> None:
        """Add paths, each once and in order."""
        first = paths >> 2 * _BITS
        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]).tolist() if len(paths) else []
        words, rests, numbers = first.tolist(), (paths & (1 << 2 * _BITS) - 1).tolist(), counts.tolist()
        for a, b in zip(starts, starts[1:] + [len(words)]):
            node = self.nodes.setdefault(words[a], {})
            if isinstance(node, list):
                for k in range(a, b):
                    box, rest = node[rests[k] >> _BITS & FAN - 1], rests[k]
                    self.size += rest not in box
                    box[rest] = box.get(rest, 0) + numbers[k]
                continue
            before = len(node)
            for k in range(a, b):
                node[rests[k]] = node.get(rests[k], 0) + numbers[k]
            self.size += len(node) - before
            if len(node) > BURST:
                self.nodes[words[a]] = boxes = [{} for _ in range(FAN)]
                for rest, n in node.items():
                    boxes[rest >> _BITS & FAN - 1][rest] = n

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out the largest subtrees until ``keep`` paths are left: their paths in order, and the counts."""
        words = np.fromiter(self.nodes, dtype=np.int64, count=len(self.nodes))
        sizes = np.fromiter((len(x) if isinstance(x, dict) else sum(map(len, x)) for x in self.nodes.values()), dtype=np.int64, count=len(words))
        order = np.argsort(-sizes, kind="stable")
        gone = order[:int(np.searchsorted(np.cumsum(sizes[order]), self.size - keep)) + 1]
        boxes, total = [], int(sizes[gone].sum())
        for w in words[gone].tolist():
            node = self.nodes.pop(w)
            boxes.extend([node] if isinstance(node, dict) else [dict(chain.from_iterable(x.items() for x in node))])
        self.size -= total
        paths = np.repeat(words[gone], sizes[gone]) << 2 * _BITS | np.fromiter(chain.from_iterable(boxes), dtype=np.int64, count=total)
        counts = np.fromiter(chain.from_iterable(x.values() for x in boxes), dtype=np.int64, count=total)
        order = np.argsort(paths)
        return paths[order], counts[order]


def node_counts(paths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of one, two and three words on the paths, as packed ids, and how often each occurs."""
    out, sums = [], []
    for depth in (2, 1, 0):
        node = paths >> depth * _BITS
        full = (node & _ID) > 0
        node, n = node[full], counts[full]
        if len(node):
            at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            out.append(node[at] << depth * _BITS)
            sums.append(np.add.reduceat(n, at))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(out) if out else none, np.concatenate(sums) if sums else none


class Counter:
    """A task's words and one trie for each language."""

    def __init__(self, partitions: int) -> None:
        self.partitions, self.spread = partitions, -(-partitions // SPREAD)
        self.pack = zstandard.ZstdCompressor(level=1)
        self.forget()

    def forget(self) -> None:
        self.ids: dict[bytes, int] = {_STOP: 0}
        self.tries: dict[str, Trie] = {}

    @property
    def size(self) -> int:
        return sum(t.size for t in self.tries.values())

    def add(self, lang: str, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Count the phrases of a run of words that ends with a piece; gives out what has to be spilled."""
        for a in range(0, len(words), BLOCK):
            part = words[a:a + BLOCK + 2]
            known = self.ids
            for w in set(part).difference(known):
                known[w] = len(known)
            ids = np.fromiter(map(known.__getitem__, part), dtype=np.int64, count=len(part))
            w1 = ids[:BLOCK]
            w2, w3 = np.r_[ids[1:], 0][:len(w1)], np.r_[ids[2:], 0, 0][:len(w1)]
            w3 = np.where(w2 > 0, w3, 0)
            paths, counts = np.unique((w1 << 2 * _BITS | w2 << _BITS | w3)[w1 > 0], return_counts=True)
            self.tries.setdefault(lang, Trie()).add(paths, counts)
            if len(known) > WORDS:
                yield from self.spilled(0)
                self.forget()
            elif self.size > HELD:
                yield from self.spilled(HELD // 2)

    def spilled(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Runs of the largest subtrees, one for each prefix partition that they meet: (partition, lang, run)."""
        words = pa.array(list(self.ids), pa.binary())
        marks = np.fromiter(map(xxhash.xxh64_intdigest, self.ids), dtype=np.uint64, count=len(self.ids))
        marks[0] = 0
        rank = np.empty(len(marks), dtype=np.int64)
        rank[np.argsort(marks, kind="stable")] = np.arange(len(marks))  # an order of words that all tasks share
        share = keep / max(1, self.size)
        for lang, trie in self.tries.items():
            if not trie.size:
                continue
            phrases, counts = node_counts(*trie.spill(int(share * trie.size)))
            w1, w2, w3 = phrases >> 2 * _BITS, phrases >> _BITS & _ID, phrases & _ID
            prefix = mixed(marks[w1] + mixed(marks[w2] ^ np.uint64(7)))
            where = ((prefix % np.uint64(self.partitions) + mixed(marks[w3]) % np.uint64(self.spread)) % np.uint64(self.partitions)).astype(np.int64)
            order = np.lexsort((rank[w1] << 2 * _BITS | rank[w2] << _BITS | rank[w3], where))
            where, counts = where[order], counts[order]
            text = _joined(words, w1[order], w2[order], w3[order])
            at = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            runs = [self.pack.compress(_packed(text[a:b], counts[a:b])) for a, b in zip(at.tolist(), at[1:].tolist() + [len(where)])]
            yield pa.RecordBatch.from_arrays([pa.array(where[at]), pa.array([lang] * len(at), pa.string()), pa.array(runs, pa.binary())], names=["part", "lang", "run"])


def _joined(words: pa.Array, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> pa.Array:
    """The phrases' words with a space between them."""
    second = pc.if_else(pa.array(w2 > 0), words.take(pa.array(w2)), pa.scalar(None, pa.binary()))
    third = pc.if_else(pa.array(w3 > 0), words.take(pa.array(w3)), pa.scalar(None, pa.binary()))
    return pc.binary_join_element_wise(words.take(pa.array(w1)), second, third, pa.scalar(b" ", pa.binary()), null_handling="skip")


def _packed(text: pa.Array, counts: np.ndarray) -> bytes:
    ends = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset:text.offset + len(text) + 1]
    data = memoryview(text.buffers()[2])[ends[0]:ends[-1]]
    return b"".join([np.uint64(len(text)).tobytes(), counts.astype(np.int64).tobytes(), (ends - ends[0]).astype(np.int32).tobytes(), data])


def _unpacked(run: bytes) -> pa.Table:
    n = int(np.frombuffer(run, dtype=np.uint64, count=1)[0])
    counts, ends = np.frombuffer(run, dtype=np.int64, count=n, offset=8), pa.py_buffer(run[8 * n + 8:12 * n + 12])
    return pa.table({"phrase": pa.BinaryArray.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(run[12 * n + 12:])]), "n": counts})


def counted(docs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of one to three words that occur ``least`` times in the texts of a language; the phrase '' counts all words.

    The rows of '' are parts, one for each partition, to be summed.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    partitions = 1 + chars // CHARS

    def count(batches):
        counter, held, size = Counter(partitions), {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = pieces(text)
                mine = held.setdefault(lang, [])
                mine += words
                mine.append(_STOP)
                size += len(words) + 1
                if size >= 2 * BLOCK:
                    most = max(held, key=lambda x: len(held[x]))
                    size -= len(held[most])
                    yield from counter.add(most, held.pop(most))
        for lang, mine in held.items():
            yield from counter.add(lang, mine)
        yield from counter.spilled(0)

    def merge(batches):
        unpack, key, parts = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            for at, lang, run in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != (at, lang) and parts:
                    yield merged(key[1], parts)
                    parts = []
                key = at, lang
                parts.append(_unpacked(unpack.decompress(run)))
        if parts:
            yield merged(key[1], parts)

    def merged(lang, parts):
        sums = pa.concat_tables(parts).group_by("phrase").aggregate([("n", "sum")])
        phrase, n = sums["phrase"], sums["n_sum"]
        single = pc.equal(pc.count_substring(phrase, " "), 0)
        words = pc.sum(n.filter(single)).as_py() or 0
        keep = pc.greater_equal(n, least)
        phrase = pa.concat_arrays([pa.array([b""], pa.binary()), *phrase.filter(keep).chunks]).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), phrase, pa.concat_arrays([pa.array([words]), *n.filter(keep).chunks])], names=["lang", "phrase", "n"])

    runs = docs.select("lang", "text").mapInArrow(count, "part long, lang string, run binary")
    return runs.repartition("part").sortWithinPartitions("part", "lang").mapInArrow(merge, "lang string, phrase string, n long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, within: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language.

    Words are runs of anything but spaces and tabs, A to Z lower-cased, and phrases lie between ``.,;:!?`` and line ends. Everything is counted per language; a null
    language is ``und`` (as is one of that name) and a null text is empty. A phrase counts if it occurs ``least`` times; the score floor(10^6 a a / (l r)) is that of its worst cut, the
    leftmost of equals, in whole numbers of 38 digits. Phrases inside a longer one that has ``within`` per cent of their occurrences are dropped.
    The ``top`` first by score, occurrences and bytes of the phrase are given. Repeated rows count each; empty tables and texts without words give no rows; other columns of the
    table don't matter, whatever their names.
    """
    texts = pick(docs, lang=F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), text=F.coalesce(F.col(text_col), F.lit("")))
    counts = cut(counted(texts, least))
    known = counts.where("phrase <> ''").withColumn("k", F.size(F.split("phrase", " ")))
    phrases = known.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), "k")
    inside = (phrases.where("k = 3").select("lang", "a", F.substring_index("phrase", " ", 2).alias("p"), F.substring_index("phrase", " ", -2).alias("q"))
              .select("lang", F.explode(F.array("p", "q")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    phrases = phrases.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < within * F.col("a"), F.lit(True)))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("first"), F.expr("substring_index(phrase, ' ', cut - k)").alias("rest"))
    part = known.select("lang", "phrase", "n")
    left, right = part.withColumnsRenamed({"phrase": "first", "n": "l"}), part.withColumnsRenamed({"phrase": "rest", "n": "r"})
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
              .withColumn("score", F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))"
                                          " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    best = top_by(worst.select("lang", "phrase", "a", "w.l", "w.r", "w.score"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    words = counts.where("phrase = ''").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
