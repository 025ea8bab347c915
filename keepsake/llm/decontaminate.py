"""Documents that hold a benchmark item, word for word or with a few edits.

An item may differ from the passage in one edit (a character put in, left out or replaced) for every ``PER_EDIT`` of its characters. An item with
a budget of k edits is split into k + 1 pieces: k edits leave at least one of them whole, so a passage has an exact hit of some piece
at about its place in the item. One pass of an Aho-Corasick automaton finds all hits of all pieces; the places that they
point at are verified by Myers' bit-parallel edit distance. Items come in blocks of bounded size, each sent to all
tasks for one pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import fresh, pick
from keepsake.session import cut

PER_EDIT = 14
BLOCK_CHARS = 4_000_000
#: Punctuation that counts as white space.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»‘’“”„…–—¿¡·"


def plain(text: str | None) -> str:
    """Lower-case words without punctuation, with one space before, between and after them; empty for none."""
    text = text.lower() if text else ""
    for mark in _MARKS:
        if mark in text:
            text = text.replace(mark, " ")
    words = text.split()
    return f" {' '.join(words)} " if words else ""


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(place, piece) of the edits + 1 pieces of an item."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distance_within(item: str, text: str, most: int) -> int | None:
    """The least edits that turn the item into some part of the text, by Myers' bit vectors; None if over ``most``."""
    m = len(item)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        rise = down | (full & ~(xh | up))
        fall = up & xh
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        rise = (rise << 1) & full
        up = ((fall << 1) & full) | (full & ~(xv | rise))
        down = rise & xv
    return best if best <= most else None


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        text = plain(row["text"])
        if not text:
            continue
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((row["item"], text))
        size += len(text)
    if block:
        yield block


def _search(batches, block: list[tuple[int, str]], per_edit: int):
    schema = pa.schema([("row", pa.int64()), ("item", pa.int64()), ("edits", pa.int32())])
    budget = [len(t) // per_edit for _, t in block]
    places: dict[str, list[tuple[int, int]]] = {}
    for k, (_, text) in enumerate(block):
        for at, piece in pieces(text, budget[k]):
            places.setdefault(piece, []).append((k, at))
    automaton = ahocorasick.Automaton()
    for piece, where in places.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    for batch in batches:
        out = []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = plain(text)
            spans: dict[int, list[tuple[int, int]]] = {}
            for end, (n, where) in automaton.iter(text):
                for k, at in where:
                    start = end + 1 - n - at
                    spans.setdefault(k, []).append((start - budget[k], start + len(block[k][1]) + budget[k]))
            for k, found in spans.items():
                best, (a, b) = None, found[0]
                for c, d in [*found[1:], (math.inf, 0)]:  # hits come in the order of the text; spans that meet are one
                    if c <= b:
                        a, b = min(a, c), max(b, d)
                        continue
                    edits = distance_within(block[k][1], text[max(0, a):b], budget[k])
                    best = edits if best is None or edits is not None and edits < best else best
                    a, b = c, d
                if best is not None:
                    out.append((row, block[k][0], best))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text: str = "text", per_edit: int = PER_EDIT) -> DataFrame:
    """(doc_id, item_id, edits): each document and item that it holds, with the least number of edits.

    Texts are compared in lower case as words without punctuation. Null and empty texts and items hold and match nothing; an item of
    less than ``per_edit`` characters must be there as it is. Rows that repeat an id and a hit give it once, with the fewest edits.
    """
    rows = pick(docs, row=F.col(id_col).cast("long"), text=text_col)
    wanted = pick(items, item=F.col(item_col).cast("long"), text=item_text).where("text is not null")
    found = None
    for block in _blocks(wanted, BLOCK_CHARS):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        part = rows.mapInArrow(lambda b, s=sent: _search(b, s.value, per_edit), "row long, item long, edits int")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.select("row", F.lit(0).cast("long").alias("item"), F.lit(0).alias("edits")).where("false")
    return found.groupBy(F.col("row").alias("doc_id"), F.col("item").alias("item_id")).agg(F.min("edits").alias("edits"))


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item; null ids and repeated rows are judged like any other."""
    mark, key = F.xxhash64(F.col(id_col), F.col(text_col)), fresh(docs, "leaking")
    found = cut(leaks(pick(docs, doc_id=mark, text=text_col), items).select(F.col("doc_id").alias(key)).distinct())
    return docs.join(found, mark == F.col(key), "left_anti")
