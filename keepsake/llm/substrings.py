"""Removal of long word sequences that an earlier document holds, through suffix automata of reference shards.

The reference is the corpus itself, so its automata can't be broadcast whole: they grow with it. They are cut into
shards that only the matching parts of documents visit. Every window of ``length`` words is led to a shard by its *anchor*, the run of
``GRAM`` words in it with the smallest hash: equal windows have equal anchors. A document's consecutive windows with one
anchor form a *context*. Contexts that are equal are counted once, with the smallest document that has them, before
anything is shuffled. Where an anchor has several contexts, its shard builds the suffix automaton of them all, earliest
documents first, streams the contexts through it for their matching statistics, and gives for each window the earliest document that holds it.
An anchor with more than ``CROWD`` contexts is cut into smaller shards, one for each window, so no shard is larger than that.
Words are compared by a 64-bit hash and contexts by two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import _arrow_schema, pick
from keepsake.llm.hashing import digests, mixed, powers, words
from keepsake.session import cut

LENGTH = 50
GRAM = 8
CROWD = 512


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def contexts(h: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each context, in order.

    ``h`` are the word hashes of one or more documents after each other, ``ends`` where each of them ends.
    """
    none = np.zeros(0, dtype=np.int64)
    width, windows = length - gram + 1, len(h) - length + 1
    if windows < 1:
        return none.astype(np.uint64), none, none
    grams = np.zeros(len(h) - gram + 1, dtype=np.uint64)
    for i, power in enumerate(powers(0x9E3779B97F4A7C15, gram)):
        grams += h[i:i + len(grams)] * power
    # The low six bits tell the place (a window holds less than 64 runs), the others decide.
    low = np.uint64(63)
    least = (mixed(grams) & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:windows], least[width - step:width - step + windows])
    at = np.arange(windows, dtype=np.int64)
    where = at + (((least & low).astype(np.int64) - at) & 63)
    doc = np.searchsorted(ends, at, "right")
    inside = ends[doc] - at >= length
    new = np.r_[True, (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])]
    first = np.nonzero(new & inside)[0]
    stop = np.minimum(np.r_[np.nonzero(new)[0], windows][np.searchsorted(np.nonzero(new)[0], first, "right")], ends[doc[first]] - length + 1)
    return least[first] & ~low, first, stop - first


class Automaton:
    """Suffix automaton of word sequences, each state with the first document that reached it. Add in ascending order of documents."""

    def __init__(self) -> None:
        self.next, self.link, self.long, self.doc = [{}], [-1], [0], [None]

    def add(self, words: list[int], doc: int) -> None:
        nxt, link, long, first = self.next, self.link, self.long, self.doc
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                if long[q] == long[last] + 1:
                    last = q
                else:
                    last = self._clone(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            long.append(long[last] + 1)
            first.append(doc)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if long[q] == long[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link = self.next, self.link
        made = len(nxt)
        nxt.append(dict(nxt[q]))
        self.long.append(self.long[p] + 1)
        self.doc.append(self.doc[q])
        link.append(link[q])
        link[q] = made
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = made
            p = link[p]
        return made

    def earliest(self, words: list[int], length: int) -> list[int | None]:
        """Per window of ``length`` words of a sequence, the first document that holds it (None: no document)."""
        nxt, link, long, first = self.next, self.link, self.long, self.doc
        out, state, matched = [], 0, 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = long[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            if i >= length - 1:
                if matched < length:
                    out.append(None)
                    continue
                while long[link[state]] >= length:  # the state of just the last ``length`` words
                    state = link[state]
                matched = min(matched, long[state])
                out.append(first[state])
        return out


def _runs(values: list) -> list[dict]:
    out: list[dict] = []
    for i, v in enumerate(values):
        if out and out[-1]["first"] == v:
            out[-1]["n"] += 1
        else:
            out.append({"at": i, "n": 1, "first": v})
    return out


_RUNS = "array<struct<at: int, n: int, first: long>>"
_CONTEXT = "row long, mark long, anchor long, h1 long, h2 long, at int, n int"


def _scan(batches, length: int, gram: int):
    schema = pa.schema([(n, pa.int64()) for n in ("row", "mark", "anchor", "h1", "h2")] + [("at", pa.int32()), ("n", pa.int32())])

    def found(rows: list[tuple[int, int]], texts: list[bytes]):
        starts, _, h = words(b"\n".join(texts))
        edges = np.cumsum([len(t) + 1 for t in texts])
        ends = np.searchsorted(starts, edges, "left")
        anchor, at, n = contexts(h, ends, length, gram)
        doc = np.searchsorted(ends, at, "right")
        h1, h2 = digests(h, at, at + n + length - 1) if len(at) else (anchor, anchor)
        own = at - np.r_[0, ends][doc]
        columns = *np.array(rows, dtype=np.int64)[doc].T.copy(), anchor.view(np.int64), h1.view(np.int64), h2.view(np.int64), own.astype(np.int32), n.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    for batch in batches:
        rows, texts, size = [], [], 0
        for row, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows.append((row, mark))
            texts.append(_bytes(text))
            size += len(texts[-1]) + 1
            if size > 1_000_000:
                yield found(rows, texts)
                rows, texts, size = [], [], 0
        if rows:
            yield found(rows, texts)


def _fetch(batches, length: int, arrow: pa.Schema):
    """The words of the contexts wanted: (anchor, h1, h2, first, words)."""
    for batch in batches:
        for row, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
            h = words(_bytes(text))[2]
            made = []
            for x in wanted:
                part = h[x["at"]:x["at"] + x["n"] + length - 1]
                h1, h2 = digests(part, np.zeros(1, dtype=np.int64), np.array([len(part)]))
                if (int(h1.view(np.int64)[0]), int(h2.view(np.int64)[0])) == (x["h1"], x["h2"]):  # ids may repeat with other texts
                    made.append((x["anchor"], x["h1"], x["h2"], row, part.view(np.int64)))
            for k in range(0, len(made), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[k:k + 20_000]), arrow.types)], schema=arrow)


def _shards(batches, length: int, arrow: pa.Schema):
    """One automaton for each anchor; rows come sorted by anchor and first document."""
    def answer(rows):
        automaton = Automaton()
        for _, _, _, first, words in rows:
            automaton.add(words, first)
        return [{"anchor": a, "h1": x, "h2": y, "runs": _runs(automaton.earliest(words, length))} for a, x, y, _, words in rows]

    held: list[tuple] = []
    for batch in batches:
        out = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if held and held[0][0] != row[0]:
                out += answer(held)
                held = []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
    if held:
        yield pa.RecordBatch.from_pylist(answer(held), schema=arrow)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, mark, spans): the word spans [at, to) of each document covered by windows that start in a document with a smaller id.

    ``docs`` has (row long, mark long, text string); ``mark`` tells the texts of rows with the same id apart. Rows without such a span are left out; null texts and
    null ids take no part. Rows that share an id are never earlier than each other.
    """
    docs = docs.where("row is not null")
    found = cut(docs.select("row", "mark", "text").mapInArrow(lambda b: _scan(b, length, gram), _CONTEXT))
    key = ["anchor", "h1", "h2"]
    kinds = cut(found.groupBy(*key).agg(F.min("row").alias("first"), F.max("row").alias("last"), F.max("n").alias("n"),
                                        F.min_by("at", F.struct("row", "at")).alias("at")))
    shared = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("first").alias("a"), F.max("last").alias("z"))
                 .where("a < z").select("anchor", "kinds"))
    known = cut(kinds.join(shared, "anchor"))
    plain = known.where("kinds = 1").select(*key, F.array(F.struct(F.lit(0).alias("at"), F.col("n"), F.col("first"))).alias("runs"))
    wanted = known.where("kinds > 1").groupBy(F.col("first").alias("row")).agg(
        F.collect_list(F.struct(*key, "at", "n", "kinds")).alias("wanted"))
    shape = "anchor long, h1 long, h2 long, first long, words array<long>"
    arrow = _arrow_schema(shape)
    texts = cut(docs.join(wanted, "row").select("row", "text", "wanted").mapInArrow(lambda b: _fetch(b, length, arrow), shape).dropDuplicates(key)
                .join(shared, "anchor"))
    answer = f"anchor long, h1 long, h2 long, runs {_RUNS}"
    answers = _arrow_schema(answer)
    small = (texts.where(F.col("kinds") <= CROWD).select(*key, "first", "words").repartition("anchor").sortWithinPartitions("anchor", "first")
             .mapInArrow(lambda b: _shards(b, length, answers), answer))
    large = texts.where(F.col("kinds") > CROWD).join(known.select(*key, "last"), key).select(
        *key, "first", "last", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - length),
                                                lambda i: F.md5(F.slice("words", i + 1, length).cast("string").cast("binary")))).alias("at", "window"))
    # A window that one document alone holds repeats nothing, and need not meet itself again.
    earliest = large.groupBy("window").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first < last").drop("last")
    large = (large.drop("first", "last").join(earliest, "window").groupBy(*key)
             .agg(F.collect_list(F.struct("at", F.lit(1).alias("n"), "first")).alias("runs")))
    runs = cut(plain.unionByName(small).unionByName(large))
    hit = found.select("row", "mark", *key, F.col("at").alias("start")).join(runs, key)
    spans = hit.select("row", "mark", F.transform(F.filter("runs", lambda x: x["first"] < F.col("row")), lambda x: F.struct(
        (F.col("start") + x["at"]).alias("at"), (F.col("start") + x["at"] + x["n"] + length - 1).alias("to"))).alias("spans")).where(F.size("spans") > 0)
    return spans.groupBy("row", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each row after the spans that earlier documents hold are removed.

    Null and empty texts have no words and give an empty text; rows with a null id are kept whole. Rows with the same id are never earlier than each other, be
    their texts equal or not, and each loses only what its own windows cover. An empty table gives no rows; other columns don't matter, whatever their names.
    """
    rows = pick(docs, row=F.col(id_col).cast("long"), mark=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), text=text_col)
    marked = rows.join(repeated_spans(rows, length), ["row", "mark"], "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for row, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held = _bytes(text).split()
                n = len(held)
                kept, at = [], 0
                for s in sorted((s for s in spans or () if s["to"] <= n), key=lambda s: s["at"]):
                    kept += held[at:s["at"]]
                    at = max(at, s["to"])
                kept += held[at:]
                out.append((row, n, n - len(kept), b" ".join(kept).decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return marked.select("row", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
