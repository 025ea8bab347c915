"""Exact top k by inner product, by the threshold algorithm over lists sorted by each component.

Vectors are cut into blocks as Spark partitions them. A block has, for each component, the list of its different vectors in order. All queries
read the lists together, from both ends, in steps that double; every vector met is scored whole, one matrix product for all queries. The best that a
vector not met yet can score is the query times the components last read, at the end that each sign prefers (the threshold). A query leaves when
that is less than its k-th score so far, so ties are all seen. Its k-th score is known from the start, among the queries themselves, which are
vectors too; blocks read by one task pass it on, and each task's k best meet at the end.
Queries lie in a table of packs; one round's packs, of bounded size, are sent to the tasks at a time, and the round's finds written before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import pick
from keepsake.session import cut, fresh_path

K = 5
BLOCK_ROWS = 8192
#: Bytes of queries sent at a time, queries scored at a time, and queries that give the first k-th scores.
QUERY_BYTES, TOGETHER, FIRST_SCORES = 4_000_000, 256, 1024
FIRST = 16

Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # number of the query, id, score


def whole_numbers(vector: str) -> Column:
    """floor(256 * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def sound(vector: str) -> Column:
    """Not null, not empty, and all components finite numbers."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _scoring(x: np.ndarray, y: np.ndarray) -> type:
    """The numbers in which all products of rows of x and y are exact: floats if every sum is below 2^53, whole numbers below 2^63."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * x.shape[1]
    if most >= 1 << 63:
        raise OverflowError("vectors too large: an inner product may not fit in 64 bits")
    return np.float64 if most < 1 << 53 else np.int64


def first_k(found: Found, k: int) -> Found:
    """The k best of each query, ties to the smaller id."""
    query, ids, score = found
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    keep = place < k
    return query[keep], ids[keep], score[keep]


class Queries:
    """Queries of one length, with the k-th score known of each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.best: Found = (np.zeros(0, dtype=np.int64),) * 3
        self.least = np.full(len(ids), np.iinfo(np.int64).min)
        some = slice(0, FIRST_SCORES)
        if len(ids[some]) > k:
            kind = _scoring(vectors, vectors)
            scores = (vectors.astype(kind) @ vectors[some].astype(kind).T).astype(np.int64)
            scores[np.arange(min(len(ids), FIRST_SCORES)), np.arange(min(len(ids), FIRST_SCORES))] = np.iinfo(np.int64).min
            self.least = np.partition(scores, len(ids[some]) - k, axis=1)[:, len(ids[some]) - k]

    def read(self, block: "Block") -> None:
        """Take in what a block holds."""
        found = [self.best, *(block.best(self, a, min(a + TOGETHER, len(self.ids))) for a in range(0, len(self.ids), TOGETHER))]
        self.best = query, _, score = first_k(tuple(map(np.concatenate, zip(*found))), self.k)
        last = np.flatnonzero(np.r_[query[1:] != query[:-1], True]) if len(query) else np.zeros(0, dtype=np.int64)
        full = last[np.bincount(query, minlength=len(self.ids))[query[last]] == self.k]
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])


class Block:
    """The different vectors of a block, the least ids of each, and the lists of each component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.vectors, kind = np.unique(vectors[order], axis=0, return_inverse=True)
        kind = kind.ravel()
        group = np.argsort(kind, kind="stable")  # by vector, then by id
        start = np.searchsorted(kind[group], np.arange(len(self.vectors)))
        # Of equal vectors, k and the query's own are enough.
        keep = np.arange(len(ids)) - start[kind[group]] <= k
        self.ids, self.start = ids[order][group][keep], np.r_[0, np.cumsum(np.bincount(kind[group][keep], minlength=len(self.vectors)))]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")

    def best(self, queries: Queries, a: int, b: int) -> Found:
        """Finds of the queries from a to b that can be among their k best."""
        n, k, every = len(self.vectors), queries.k, np.arange(self.vectors.shape[1])
        kind = _scoring(self.vectors, queries.vectors)
        x, q = self.vectors.astype(kind), queries.vectors[a:b].astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        live, seen = np.arange(b - a), np.zeros(n, dtype=bool)
        top = np.full((b - a, k + 1), np.iinfo(np.int64).min)  # k and the query's own
        found, at, step = [], 0, FIRST
        while at < n and len(live):
            end = min(n, at + step)
            met = np.unique(np.concatenate([self.lists[at:end].ravel(), self.lists[n - end:n - at].ravel()]))
            met = met[~seen[met]]
            seen[met] = True
            scores = (q[live] @ x[met].T).astype(np.int64)
            both = np.concatenate([top[live], scores], axis=1)
            top[live] = np.partition(both, both.shape[1] - k - 1, axis=1)[:, -k - 1:]
            least = np.maximum(top[live].min(axis=1), queries.least[a:b][live])
            who, what = np.nonzero(scores >= least[:, None])
            found.append((live[who], met[what], scores[who, what]))
            at, step = end, step * 2
            if at < n:
                threshold = up[live] @ x[self.lists[n - at], every] + down[live] @ x[self.lists[at - 1], every]
                live = live[threshold >= least]
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 3
        who, what, score = map(np.concatenate, zip(*found))
        least = np.maximum(top.min(axis=1), queries.least[a:b])
        still = score >= least[who]
        who, what, score = who[still] + a, what[still], score[still]
        many = self.start[what + 1] - self.start[what]
        place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        who, score, ids = np.repeat(who, many), np.repeat(score, many), self.ids[np.repeat(self.start[what], many) + place]
        other = ids != queries.ids[who]
        return who[other], ids[other], score[other]


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a batch (id, v) for each length of vector."""
    ids, lists = np.asarray(batch.column(0)), batch.column(1)
    lengths, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
    ends = np.cumsum(lengths)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield ids[rows], flat[(ends[rows] - n)[:, None] + np.arange(n)]


def _blocks(batches, k: int) -> Iterator[Block]:
    """Blocks of vectors of equal length, each of about ``BLOCK_ROWS``."""
    held: dict[int, list] = {}
    for batch in batches:
        for ids, vectors in _vectors(batch):
            for a in range(0, len(ids), BLOCK_ROWS):
                rows = held.setdefault(vectors.shape[1], [])
                rows.append((ids[a:a + BLOCK_ROWS], vectors[a:a + BLOCK_ROWS]))
                if sum(len(i) for i, _ in rows) >= BLOCK_ROWS:
                    yield Block(*map(np.concatenate, zip(*held.pop(vectors.shape[1]))), k)
    for rows in held.values():
        yield Block(*map(np.concatenate, zip(*rows)), k)


def _scan(batches, packs: list[tuple[bytes, bytes, int]], k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    by_length: dict[int, list] = {}
    for ids, vectors, n in packs:
        by_length.setdefault(n, []).append((np.frombuffer(ids, dtype=np.int64), np.frombuffer(vectors, dtype=np.int64).reshape(-1, n)))
    asked = {n: Queries(*map(np.concatenate, zip(*parts)), k) for n, parts in by_length.items()}
    for block in _blocks(batches, k):
        if block.vectors.shape[1] in asked:
            asked[block.vectors.shape[1]].read(block)
    for queries in asked.values():
        query, ids, score = queries.best
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(queries.ids[query]), pa.array(ids), pa.array(score)], schema=schema)


def _packs(queries: DataFrame) -> DataFrame:
    """(pack, ids, vectors, n, size): the queries (id, v) of each task as bytes, in packs of bounded size and one length of vector."""

    def run(batches):
        for batch in batches:
            for ids, vectors in _vectors(batch):
                rows = max(1, QUERY_BYTES // (8 * vectors.shape[1]))
                for a in range(0, len(ids), rows):
                    part = vectors[a:a + rows].astype(np.int64)
                    yield pa.RecordBatch.from_pylist([{"ids": ids[a:a + rows].tobytes(), "vectors": part.tobytes(), "n": part.shape[1], "size": part.nbytes}])

    made = queries.mapInArrow(run, "ids binary, vectors binary, n long, size long")
    return cut(made.withColumn("pack", F.monotonically_increasing_id()))


def _rounds(packs: DataFrame) -> Iterator[list[int]]:
    """Numbers of packs that are sent together."""
    mine, held = [], 0
    for pack, size in sorted(tuple(r) for r in packs.select("pack", "size").collect()):
        if mine and held + size > QUERY_BYTES:
            yield mine
            mine, held = [], 0
        mine.append(pack)
        held += size
    if mine:
        yield mine


def nearest(vectors: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest score for each id divisible by ``every``, ties to the smaller id.

    Vectors that are null, empty or hold a null or a number that isn't finite take no part, nor do rows with a null id. Vectors of another length than the query's aren't compared.
    Rows that repeat an id are candidates each for itself, except for the query of that id; they ask once, with the smallest of their vectors.
    An empty table has no rows. Vectors so large that a product of two of them may not fit in 64 bits raise an error. Other columns don't matter, whatever their names.
    """
    rows = pick(vectors, id=F.col(id_col).cast("long"), v=vector_col).where(sound("v") & F.col("id").isNotNull()).select("id", whole_numbers("v").alias("v"))
    spark, paths = vectors.sparkSession, []
    packs = _packs(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    for numbers in _rounds(packs):
        sent = spark.sparkContext.broadcast([(bytes(r.ids), bytes(r.vectors), r.n) for r in packs.where(F.col("pack").isin(numbers)).collect()])
        paths.append(fresh_path(spark, "found"))
        rows.mapInArrow(lambda b, s=sent: _scan(b, s.value, k), "query_id long, vec_id long, score long").write.parquet(paths[-1])
        sent.destroy()
    shape = "query_id long, vec_id long, score long"
    found = spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
