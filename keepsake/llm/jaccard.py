"""All links between texts that share at least four fifths of their shingles (Jaccard), found and checked exactly.

Two sets of n and m shingles with Jaccard 0.8 share at least 4 n / 5 of the first. So in any common order of all shingles the
first n - ceil(4 n / 5) + 1 of one (its *head*) and of the other hold a common one: texts are compared where their heads meet, and
nothing else can be a link. The order puts shingles that are frequent in a sample last; the sample changes the cost, never the result.
Heads travel as runs sorted by shingle, packed for one partition of the shingles each. At each meeting point a text meets the first one there and a few
neighbours; those that it meets most often are tried first, together with the pairs that SimHash finds (see ``simhash.candidates``). These pairs are checked, and texts joined by them need no further comparison with each other. The same goes on with pairs that meet and are not yet joined, the likeliest of
each text first, as long as that pays; all that are left are checked after that.
A check first compares small sketches, which bound from below in how many shingles two sets differ, then the texts themselves. Sets are never stored: each scan
makes them again from the texts, which are smaller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import components
from keepsake.llm.hashing import mixed, powers, words
from keepsake.operators.scale import top_by
from keepsake.session import cut

#: Texts in the sample that orders the shingles, texts of it with a shingle that make it frequent, and how many such are told apart.
SAMPLE, FREQUENT, TOLD = 5_000, 4, 200_000
#: Places before a text at each meeting point that may be tried besides the first, how many texts that meet it most often are, and pairs held before they are given out.
LAGS, FIRST, CHUNK = (1, 2, 4), 6, 100_000
#: A round of trials is followed by another as long as one in so many of its pairs is a link.
WORTH = 20
#: Head shingles that a task holds and that a partition of them is meant for, in units of characters of text, of which a shingle's head takes some thirty.
HELD, CHARS = 1 << 19, 1 << 24
#: Entries of the heads of one partition that are met at once, and rows given out at once.
MET = 1 << 17
#: Numbers of 64 parities that go along with each meeting.
PARITIES = 8
#: Bits of the map that keeps texts in no pair out of joins.
MAP = 1 << 22


def near(n: np.ndarray, m: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether sets of n and m with so many in common have Jaccard 0.8 or more, in whole numbers."""
    return 9 * common >= 4 * (n + m)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The hashes, in order, of the different runs of ``size`` words, A to Z lower-cased; of the whole sequence where it is shorter."""
    h = words(text.encode("utf-8", "surrogatepass").lower())[2] if text else np.zeros(0, dtype=np.uint64)
    if not len(h):
        return h
    width = min(size, len(h))
    out = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for k, power in enumerate(powers(0x9E3779B97F4A7C15, width)):
        out += h[k:k + len(out)] * power
    return np.unique(mixed(out + np.uint64(width)))


def node_of(grams: np.ndarray) -> tuple[int, int]:
    """The name of a set: two numbers from its 128-bit digest."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), dtype=np.int64).tolist())


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in each of so many parts, two or more for each shingle."""
    parts = 1 << max(8, int(2 * len(grams) - 1).bit_length())
    return np.packbits((np.bincount((grams & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many shingles two sets differ at least, by their sketches: in one for each part where the parities do."""
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def parities(grams: np.ndarray) -> np.ndarray:
    """The sketch of ``PARITIES`` numbers that travels with each meeting: as ``sketch``, with 64 parts for each."""
    return np.packbits((np.bincount((grams & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1).astype(np.uint8)).view(np.int64)


def _nodes(docs: DataFrame, size: int) -> DataFrame:
    """(a0, a1, s0, s1, ...) of each node with four shingles or more, once: its parities."""
    names = ["a0", "a1", *(f"s{i}" for i in range(PARITIES))]
    schema = pa.schema([(x, pa.int64()) for x in names])

    def run(batches):
        for batch in batches:
            sets = [g for g in (shingles(t.as_py(), size) for t in batch.column(0)) if len(g) > 3]
            if sets:
                rows = np.column_stack([np.array([node_of(g) for g in sets]), np.array([parities(g) for g in sets])])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T.copy()], schema=schema)

    made = docs.select("text").mapInArrow(run, ", ".join(f"{x} long" for x in names))
    return cut(made.groupBy("a0", "a1").agg(*[F.min(x).alias(x) for x in names[2:]]))


def named(docs: DataFrame, size: int, fingerprint: Callable[[np.ndarray], int]) -> DataFrame:
    """``docs`` (row, mark, text) as (row, mark, d0, d1, print): the node of each text and its set's fingerprint, null for three shingles or fewer."""
    schema = pa.schema([(x, pa.int64()) for x in ("row", "mark", "d0", "d1", "print")])

    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(2)]
            nodes = np.array([node_of(g) for g in sets], dtype=np.int64).reshape(-1, 2)
            prints = np.array([fingerprint(g) if len(g) > 3 else 0 for g in sets], dtype=np.uint64).view(np.int64)
            few = np.array([len(g) <= 3 for g in sets], dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes[:, 0].copy()), pa.array(nodes[:, 1].copy()), pa.array(prints, mask=few)], schema=schema)

    return docs.select("row", "mark", "text").mapInArrow(run, "row long, mark long, d0 long, d1 long, print long")


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in the sample, in order, and their counts."""
    of = max(1, docs.count() // SAMPLE)

    def run(batches):
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), size).view(np.int64))], names=["gram"])

    some = docs.where(F.pmod(F.xxhash64("mark"), F.lit(of)) == 0).dropDuplicates(["mark"]).select("text").mapInArrow(run, "gram long")
    rows = some.groupBy("gram").count().where(f"count >= {FREQUENT}").orderBy(F.desc("count"), "gram").limit(TOLD).toPandas()
    gram, count = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(gram)
    return gram[order], count[order]


def _can(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Whether sets can be near if this is the first in the order that they share."""
    return near(n, m, np.minimum(n - at, m - bt))


#: A head shingle with its node, the size of the set, the place in its order and the node's number in the run.
_ENTRY = np.dtype([("gram", "<u8"), ("d0", "<i8"), ("d1", "<i8"), ("n", "<i4"), ("at", "<i4")])
_IN_RUN = np.dtype([("gram", "<u8"), ("node", "<u4"), ("at", "<u4")])


def _packed(entries: np.ndarray, nodes: np.ndarray) -> bytes:
    """A run: its nodes once, then the columns of its entries."""
    used, place = np.unique(entries["node"], return_inverse=True)
    head = np.array([len(used), len(entries)], dtype=np.int64).tobytes()
    return b"".join([head, nodes[used].tobytes(), entries["gram"].tobytes(), place.astype(np.uint32).tobytes(), entries["at"].tobytes()])


def _unpacked(run: bytes) -> np.ndarray:
    k, n = np.frombuffer(run, dtype=np.int64, count=2).tolist()
    nodes = np.frombuffer(run, dtype=np.int64, count=3 * k, offset=16).reshape(k, 3)
    at = 16 + 24 * k
    out = np.empty(n, dtype=_ENTRY)
    out["gram"] = np.frombuffer(run, dtype=np.uint64, count=n, offset=at)
    mine = nodes[np.frombuffer(run, dtype=np.uint32, count=n, offset=at + 8 * n)]
    out["d0"], out["d1"], out["n"] = mine.T
    out["at"] = np.frombuffer(run, dtype=np.uint32, count=n, offset=at + 12 * n)
    return out


def _heads(docs: DataFrame, size: int, frequent, partitions: int) -> DataFrame:
    """(part, run): the heads of all texts, once for each node that a task meets."""

    def run(batches):
        known, counts = frequent.value
        pack, seen, nodes, entries, held = zstandard.ZstdCompressor(level=1), set(), [], [], 0

        def runs():
            every = np.empty(held, dtype=_IN_RUN)
            lengths = [len(g) for g in entries]
            every["gram"] = np.concatenate(entries)
            every["node"] = np.repeat(np.arange(len(entries), dtype=np.uint32), lengths)
            every["at"] = np.concatenate([np.arange(n, dtype=np.uint32) for n in lengths])
            part = (mixed(every["gram"]) % np.uint64(partitions)).astype(np.int64)
            order = np.lexsort((every["gram"], part))
            every, part = every[order], part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
            table = np.array(nodes, dtype=np.int64)
            made = [pack.compress(_packed(every[a:b], table)) for a, b in zip(cuts, cuts[1:] + [held])]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(made, pa.binary())], names=["part", "run"])

        for batch in batches:
            for text in batch.column(0):
                g = shingles(text.as_py(), size)
                if len(g) < 4 or (node := node_of(g)) in seen:
                    continue
                if len(seen) > CHUNK:
                    seen.clear()
                seen.add(node)
                n, head = len(g), len(g) - (4 * len(g) + 4) // 5 + 1
                if len(known):
                    k = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    g = g[np.argsort(np.where(known[k] == g, counts[k], 0), kind="stable")]
                nodes.append((*node, n))
                entries.append(g[:head])
                held += head
                if held > HELD:
                    yield runs()
                    nodes, entries, held = [], [], 0
        if held:
            yield runs()

    return docs.select("text").mapInArrow(run, "part long, run binary")


_NODES = ["a0", "a1", "b0", "b1"]
_MET = "gram long, a0 long, a1 long, n int, at int, b0 long, b1 long"


_MET_ROWS, _STARS = (pa.schema([(x, pa.int64() if x not in ("n", "at") else pa.int32()) for x in names]) for names in (("gram", "a0", "a1", "n", "at"), (*_NODES, "n")))
_BOTH = pa.unify_schemas([_MET_ROWS, _STARS])


def _rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    given = dict(zip(schema.names, columns))
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(columns[0]), f.type) for f in _BOTH], schema=_BOTH)


def _answer(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_met`` for the runs of one partition, which are used up; ``MET`` entries at a time, those of one shingle together."""
    e = np.concatenate(parts)
    parts.clear()
    order = np.lexsort((e["d1"], e["d0"], e["gram"]))
    gram = e["gram"][order]
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, dtype=np.int64)
    cuts = starts[np.r_[True, starts[1:] // MET != starts[:-1] // MET]].tolist() if len(starts) else []
    del gram, starts
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield from _meeting(e[order[a:b]])


def _meeting(e: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of ``_met`` for entries in order, with all of each shingle."""
    same = e["gram"][1:] == e["gram"][:-1]
    e = e[np.r_[True, ~(same & (e["d0"][1:] == e["d0"][:-1]) & (e["d1"][1:] == e["d1"][:-1]))]]
    same = e["gram"][1:] == e["gram"][:-1]
    e = e[np.r_[same, False] | np.r_[False, same]]
    if not len(e):
        return
    for a in range(0, len(e), MET):
        yield _rows(_MET_ROWS, [e[a:a + MET][c] if c != "gram" else e["gram"][a:a + MET].view(np.int64) for c in ("gram", "d0", "d1", "n", "at")])
    index = np.arange(len(e))
    first = np.maximum.accumulate(np.where(np.r_[True, e["gram"][1:] != e["gram"][:-1]], index, 0))
    pairs = []
    for other, mine in ((first, index), *((index[:-k], index[k:]) for k in LAGS)):
        x, y = e[other], e[mine]
        hit = (x["gram"] == y["gram"]) & (other != mine) & _can(x["n"].astype(np.int64), x["at"], y["n"].astype(np.int64), y["at"])
        pairs.append(np.column_stack([x["d0"][hit], x["d1"][hit], y["d0"][hit], y["d1"][hit]]))
    pairs, times = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
    for a in range(0, len(pairs), MET):
        yield _rows(_STARS, [*pairs[a:a + MET].T.copy(), times[a:a + MET]])


def _met(heads: DataFrame) -> DataFrame:
    """Rows (gram, a0, a1, n, at) of the shingles in the heads of two sets at least, and rows (a0, a1, b0, b1, n) of pairs to try first, that meet n times there; n adds up."""

    def run(batches):
        unpack, now, parts = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now and parts:
                    yield from _answer(parts)
                    parts = []
                now = part
                parts.append(_unpacked(unpack.decompress(packed.as_py())))
        if parts:
            yield from _answer(parts)

    return cut(heads.repartition("part").sortWithinPartitions("part").mapInArrow(run, _MET))


def _group(rows: np.ndarray) -> Iterator[np.ndarray]:
    """The pairs (a0, a1, b0, b1, larger size) of different groups so far that can be near, among rows (gram, d0, d1, n, at, root, parities) of one shingle."""
    roots, sizes = np.unique(rows[:, 5], return_counts=True)
    if len(roots) < 2:
        return
    most = rows[:, 5] == roots[sizes.argmax()]
    rows = np.concatenate([rows[~most], rows[most]])  # those of the largest group need no turn of their own
    for i in range(int((~most).sum())):
        rest = rows[i + 1:]
        rest = rest[(rest[:, 5] != rows[i, 5]) & _can(rows[i, 3], rows[i, 4], rest[:, 3], rest[:, 4])]
        far = np.bitwise_count(rest[:, 6:].view(np.uint64) ^ rows[i, 6:].view(np.uint64)).sum(axis=1, dtype=np.int64)
        hit = rest[near(rest[:, 3], rows[i, 3], (rest[:, 3] + rows[i, 3] - far) // 2)]
        if len(hit):
            swap = (hit[:, 1] < rows[i, 1]) | (hit[:, 1] == rows[i, 1]) & (hit[:, 2] < rows[i, 2])
            mine = np.tile(rows[i, 1:3], (len(hit), 1))
            one, two = np.where(swap[:, None], hit[:, 1:3], mine), np.where(swap[:, None], mine, hit[:, 1:3])
            yield np.column_stack([one, two, np.maximum(hit[:, 3], rows[i, 3])])


def _meetings(met: DataFrame) -> DataFrame:
    """(a0, a1, b0, b1, share): all pairs of different groups so far that meet and can be near, of rows (gram, a0, a1, n, at, root, parities), and how often they meet for their size."""
    names = [*_NODES, "n"]
    schema = pa.schema([(x, pa.int64()) for x in (*names, "times")])
    width = 6 + PARITIES

    def made(pairs: list[np.ndarray]) -> pa.RecordBatch:
        every, times = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*every.T.copy(), times)], schema=schema)

    def run(batches):
        held: list[np.ndarray] = []
        pairs, n = [], 0

        def groups():
            for batch in batches:
                rows = np.column_stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(width)])
                if not len(rows):
                    continue
                if held and held[-1][0, 0] == rows[0, 0] and rows[0, 0] == rows[-1, 0]:
                    held.append(rows)
                    continue
                rows = np.concatenate([*held, rows])
                starts = np.nonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])[0]
                sizes = np.diff(np.r_[starts, len(rows)])
                for k in np.nonzero(sizes[:-1] > 1)[0]:
                    yield rows[starts[k]:starts[k] + sizes[k]]
                held[:] = [rows[starts[-1]:]]
            if held:
                yield np.concatenate(held)

        for group in groups():
            for some in _group(group):
                pairs.append(some)
                n += len(some)
                if n > CHUNK:
                    yield made(pairs)
                    pairs, n = [], 0
        if pairs:
            yield made(pairs)

    found = met.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, ", ".join(f"{x} long" for x in (*names, "times")))
    return found.groupBy(*names).agg(F.sum("times").alias("times")).select(*_NODES, (F.col("times") / F.col("n")).alias("share"))


def _of_nodes(docs: DataFrame, size: int, pairs: DataFrame, value) -> DataFrame:
    """(d0, d1, n, value) of the nodes of ``pairs``, once each: the size of the set and ``value(text, set)``.

    Most texts of other nodes are left out by a map of fixed size, so that nothing of them is shuffled.
    """
    nodes = pairs.select(F.col("a0").alias("d0")).union(pairs.select("b0"))
    places = nodes.select(F.pmod("d0", F.lit(MAP)).cast("int").alias("place")).distinct().toPandas()["place"].to_numpy(np.int64)
    bits = np.zeros(MAP, dtype=bool)
    bits[places] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    schema = pa.schema([("d0", pa.int64()), ("d1", pa.int64()), ("n", pa.int64()), ("value", pa.binary())])

    def run(batches):
        known = np.unpackbits(sent.value).view(bool)
        for batch in batches:
            out = []
            for text in batch.column(0):
                text = text.as_py()
                grams = shingles(text, size)
                if len(grams) > 3:
                    d0, d1 = node_of(grams)
                    if known[d0 % MAP]:
                        out.append((d0, d1, len(grams), value(text, grams)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    made = docs.select("text").mapInArrow(run, "d0 long, d1 long, n long, value binary")
    return made.groupBy("d0", "d1").agg(F.first("n").alias("n"), F.first("value").alias("value"))


def _checked(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs whose whole sets are near: by sketches, then, of those that are left, by the texts."""

    def where(pairs: DataFrame, nodes: DataFrame, check) -> DataFrame:
        def run(batches):
            for batch in batches:
                ok = [bool(check(*x)) for x in zip(*(batch.column(i).to_pylist() for i in range(4, 8)))]
                mine = batch.select(_NODES).filter(pa.array(ok, pa.bool_()))
                if mine.num_rows:
                    yield mine

        left, right = (nodes.select(*[F.col(c).alias(f"{x}{c[1:]}" if c[0] == "d" else f"{x}_{c}") for c in ("d0", "d1", "n", "value")]) for x in "ab")
        found = pairs.join(left, ["a0", "a1"]).join(right, ["b0", "b1"]).select(*_NODES, "a_n", "b_n", "a_value", "b_value")
        return cut(found.mapInArrow(run, ", ".join(f"{x} long" for x in _NODES)))

    def by_sketch(n, m, x, y):
        return near(n, m, (n + m - apart(x, y)) // 2)

    def by_text(n, m, x, y):
        unpack = zstandard.ZstdDecompressor()
        a, b = (shingles(unpack.decompress(t).decode("utf-8", "surrogatepass"), size) for t in (x, y))
        return near(n, m, len(np.intersect1d(a, b, assume_unique=True)))

    def text_of(text, _):
        return zstandard.ZstdCompressor(level=3).compress(text.encode("utf-8", "surrogatepass"))

    left = where(pairs, _of_nodes(docs, size, pairs, lambda _, grams: sketch(grams)), by_sketch)
    return where(left, _of_nodes(docs, size, left, text_of), by_text)


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.struct(F.col("a0").alias("d0"), F.col("a1").alias("d1")).alias("a"), F.struct(F.col("b0").alias("d0"), F.col("b1").alias("d1")).alias("b"))


def links(docs: DataFrame, size: int, likely: DataFrame) -> DataFrame:
    """Links (a, b) between nodes, structs (d0, d1), whose groups are those of all pairs with Jaccard 0.8 or more among the texts of ``docs`` (mark, text).

    The pairs ``likely`` (a0, a1, b0, b1) to be near are checked first, together with those that meet most often. Each link is such a pair. ``mark`` is a hash of the text. Sets of three or fewer shingles have no link; equal sets are one node.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, size))
    partitions = 1 + (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // CHARS
    met = _met(_heads(docs, size, frequent, partitions))
    stars = met.where("gram is null").groupBy(*_NODES).agg(F.sum("n").alias("n"))
    first = top_by(stars, ["b0", "b1"], [F.desc("n"), F.asc("a0"), F.asc("a1")], FIRST, "rank").select(*_NODES)
    found = _checked(cut(first.union(likely.select(*_NODES)).distinct()), docs, size)
    own: Column = F.xxhash64("a0", "a1")
    heads, nodes = met.where("gram is not null").select("gram", "a0", "a1", "n", "at"), _nodes(docs, size)
    while True:
        roots = components(_links(found)).select(F.col("node.d0").alias("a0"), F.col("node.d1").alias("a1"), F.xxhash64("root.d0", "root.d1").alias("root"))
        known = nodes.join(roots, ["a0", "a1"], "left").withColumn("root", F.coalesce("root", own))
        grouped = heads.join(known, ["a0", "a1"]).select("gram", "a0", "a1", "n", "at", "root", *[f"s{i}" for i in range(PARITIES)])
        pairs = cut(_meetings(grouped))
        tried = cut(_likeliest(pairs))
        near_ = _checked(tried, docs, size)
        found = found.union(near_)
        if near_.count() * WORTH <= tried.count():
            return _links(found.union(_checked(cut(pairs.select(*_NODES).join(tried, _NODES, "left_anti")), docs, size)))


def _likeliest(pairs: DataFrame) -> DataFrame:
    """The ``FIRST`` pairs of each node that meet most often for their size."""
    sides = pairs.select(F.struct("a0", "a1").alias("me"), *_NODES, "share").union(pairs.select(F.struct("b0", "b1").alias("me"), *_NODES, "share"))
    return top_by(sides, ["me"], [F.desc("share"), *map(F.asc, _NODES)], FIRST, "rank").select(*_NODES).distinct()
