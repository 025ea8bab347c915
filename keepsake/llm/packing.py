"""Sequences of equal length for training, of documents that lie next to each other on a space-filling curve.

A document's vector has a one in the slot (by hash) of each pair of ids that follow each other in it. It is projected to ``DIMENSIONS`` dimensions; on a grid of
``2^BITS`` steps in each, its place on the Hilbert curve is the document's key. Documents are range-sorted by key, so that those that share
phrases stand near each other, and packed in that order: their ids form one stream, cut where a sequence is full. What is left at its end
goes to sequences whose lengths are powers of two, so nothing at all is padded.
Only keys and lengths are sorted. The start of a document in the stream is its place in its range plus the ranges before, so no task sees more than its range.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from functools import cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keepsake.llm.common import pick
from keepsake.llm.hashing import mixed
from keepsake.session import cut
from keepsake.sources.tables import spread

DIMENSIONS, BITS = 4, 15
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Words and pre-tokens that a worker remembers with their ids, slots of a hashed vector, and bytes of ids given out at a time.
WORDS, PARTS, SLOTS, CHUNK = 400_000, 1_100_000, 1 << 16, 1 << 23
#: The tokenizer's pre-tokens (a fixed value) and the letters that stand for bytes in its vocabulary, by its rule: printable ones for themselves, the others from 256 on.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {**{b: chr(b) for b in _PRINTED}, **{b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(_PRINTED)))}}
#: Words of these letters only are the same after the tokenizer's normalisation, but for case.
_PLAIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u017f]+")


class Encoder(dict):
    """Words (as bytes) with their ids (as bytes), and the points of texts.

    The tokenizer's pre-tokens never hold white space and it normalises what lies between white space for itself, so the ids of a text are those of its words. Those
    of a word of plain letters are those of its pre-tokens, which its model gives at once; other words go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.parts = self.tokenizer.model, {}
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = f"u{array(self.code).itemsize}"
        marks = mixed(np.arange(1, SLOTS + 1, dtype=np.uint64))
        self.table = marks.view(np.uint16).reshape(SLOTS, 4)[:, :DIMENSIONS] / 32768 - 1

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        stem = text.rstrip(".,;:!?")
        if stem.isalpha() and _PLAIN.fullmatch(stem):  # what most words are
            ids = self.part(stem.lower()) + (self.part(text[len(stem):]) if len(stem) < len(text) else b"")
        elif _PLAIN.fullmatch(text) and "<|" not in text:
            ids = b"".join(map(self.part, PATTERN.findall(text.lower())))
        else:
            ids = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= WORDS:
            self.clear()
        self[word] = ids
        return ids

    def part(self, token: str) -> bytes:
        """The ids of a pre-token of plain letters in lower case."""
        ids = self.parts.get(token)
        if ids is None:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            letters = token if token.isascii() else "".join(map(_LETTERS.__getitem__, token.encode()))
            ids = self.parts[token] = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids

    def encode(self, text: str) -> tuple[bytes, np.ndarray]:
        """The ids of a text, and the point of the unit cube that its different pairs of ids give, each pair being a slot by hash."""
        ids = b"".join(map(self.__getitem__, text.encode().split()))
        numbers = np.frombuffer(ids, dtype=self.width).astype(np.uint32)
        pairs = ((numbers[:-1] * np.uint32(0x9E3779B1) + numbers[1:]) * np.uint32(0x85EBCA77) >> np.uint32(16)).astype(np.uint16)
        different = np.sort(pairs)
        different = different[np.r_[True, different[1:] != different[:-1]]] if len(pairs) else different
        at = self.table[different].sum(axis=0) / max(1.0, len(different) / 3) ** 0.5
        return ids, 1 / (1 + np.exp(-1.7 * at))


@cache
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The places on the Hilbert curve of points (rows) of a grid of 2^bits steps in each dimension.

    From the highest bit down, each dimension's bit says how the rest of the curve is turned there: where it is set the lower bits of
    the first dimension are flipped, elsewhere they are swapped with that dimension's. The bits of the turned points, as Gray code, give the place.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for bit in reversed(range(1, bits)):
        low = (1 << bit) - 1
        for k in range(n):
            flip = (x[k] >> bit & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for bit in reversed(range(1, bits)):
        turn = np.where(x[n - 1] >> bit & 1, turn ^ ((1 << bit) - 1), turn)
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for k in range(n):
            place = place << 1 | (x[k] >> bit & 1)
    return place


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(row, doc_id, ids, n, mark, key) of each row (doc_id, text): its ids with the closing one as bytes, their number, a hash of them and the place on the curve."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("mark", pa.int64()), ("key", pa.int64())])

    def run(batches):
        coder = encoder(tokenizer)
        end = np.array([end_id], dtype=coder.width).tobytes()
        for batch in batches:
            rows, ids, points, size = [], [], [], 0

            def made():
                keys = hilbert(np.minimum(np.array(points) * (1 << BITS), (1 << BITS) - 1))
                marks = np.fromiter(map(xxhash.xxh64_intdigest, ids), dtype=np.uint64, count=len(ids)).view(np.int64)
                n = [len(x) // len(end) for x in ids]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([rows, ids, n, marks, keys], schema.types)], schema=schema)

            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine, at = coder.encode(text or "")
                rows.append(row)
                ids.append(mine + end)
                points.append(at)
                size += len(mine)
                if size > CHUNK:
                    yield made()
                    rows, ids, points, size = [], [], [], 0
            if rows:
                yield made()

    out = spread(docs).mapInArrow(run, "doc_id long, ids binary, n long, mark long, key long")
    return cut(out.withColumn("row", F.monotonically_increasing_id()))


def starts(rows: DataFrame) -> tuple[DataFrame, int]:
    """(row, start): where each of the rows (row, key, doc_id, mark, n) begins if they are laid end to end in that order; and the length of all."""
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("inside", pa.int64()), ("n", pa.int64())])

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.asarray(batch.column(1))
            ends = at + np.cumsum(n)
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, dtype=np.int32)), batch.column(0), pa.array(ends - n), batch.column(1)], schema=schema)
                at = int(ends[-1])

    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n").mapInArrow(run, "part int, row long, inside long, n long")
    placed = cut(placed)
    sizes = placed.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    firsts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return placed.join(firsts, "part").select("row", (F.col("first") + F.col("inside")).alias("start")), total


def last_lengths(rest: int) -> list[int]:
    """Powers of two, falling, that add up to ``rest``."""
    return [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def packed(docs: DataFrame, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of each piece of a document.

    ``ids`` are the piece's, as unsigned 32-bit numbers in little-endian order. Sequences are numbered along the curve; all hold ``length`` ids but at most log2(length) at
    the end. Null and empty texts have the closing id alone; each row, repeated or not, is packed for itself, those of one key by id, then by hash of their
    ids; a null id comes first and stays null. An empty table gives no pieces; other columns don't matter, whatever their names. Reruns agree, however the rows are
    dealt out. ``tokenizer`` must be at the same path on all executors; a text is held whole.
    """
    rows = encoded(pick(docs, doc_id=F.col(id_col).cast("long"), text=text_col), tokenizer, end_id)
    placed, total = starts(rows.select("row", "key", "doc_id", "mark", "n"))
    full = total // length
    ends = np.cumsum([full * length, *last_lengths(total % length)]).tolist()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        for batch in batches:
            made, size = [], 0
            for row, ids, n, at in zip(*(batch.column(i).to_pylist() for i in range(4))):
                numbers = np.frombuffer(ids, dtype=f"u{len(ids) // n}").astype("<u4")
                edges = [at, *range((at // length + 1) * length, min(at + n, full * length), length), *(e for e in ends if at < e < at + n), at + n]
                for a, b in pairwise(edges):
                    k = bisect_right(ends, a)  # 0: in a full sequence
                    sequence, offset = divmod(a, length) if not k else (full + k - 1, a - ends[k - 1])
                    made.append((row, a - at, b - a, numbers[a - at:b - at].tobytes(), n, sequence, offset))
                size += 4 * n
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)

    return rows.join(placed, "row").select("doc_id", "ids", "n", "start").mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
