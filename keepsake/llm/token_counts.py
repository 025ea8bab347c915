"""Token counts that follow edits, by segment trees over the pre-tokens of each document.

A text is split into pre-tokens, which are encoded apart from each other, so its count is the sum of theirs. The leaves of a document's tree are
runs of ``LEAF`` pre-tokens; inner nodes hold the sums of characters and tokens below. An edit is re-encoded from the last
pre-token boundary that no character of it can have moved (the pattern looks ahead at most ``AHEAD`` characters and never back) to the first
boundary after it that is a boundary of the old text as well, from where all is as before. The leaves touched are rewritten and the sums
above them updated, so an edit costs its own length and the height of the tree.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import pick

LEAF = 64
#: How many times its usual size a leaf may reach.
WIDEST = 4
AHEAD = 4
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that the vocabulary was made with (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE = 1 << 19

Edit = tuple[int, int, str]


class Counter:
    """Pre-tokens of a text and the number of tokens of each."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> None:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> np.ndarray:
        new = set(pieces).difference(self.known)
        if new and len(self.known) > _CACHE:
            self.known, new = {}, set(pieces)
        one = self.encoding.encode_ordinary
        self.known.update((p, len(one(p))) for p in new)
        return np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))


class Tree:
    """Characters and tokens of the pre-tokens of a text, with sums over a binary tree of leaves."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        cuts = range(0, max(len(chars), 1), LEAF)
        self.leaves = [(chars[a:a + LEAF], tokens[a:a + LEAF]) for a in cuts]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        if len(chars):
            both = np.column_stack([chars, tokens])
            self.sums[self.size:self.size + len(self.leaves)] = np.add.reduceat(both, np.arange(0, len(chars), LEAF), axis=0)
        width = self.size
        while width > 1:
            self.sums[width // 2:width] = self.sums[width:2 * width:2] + self.sums[width + 1:2 * width:2]
            width //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if char >= start + self.sums[k, 0] and k + 1 - self.size < len(self.leaves) << 1 and self.sums[k + 1, 0]:
                start += int(self.sums[k, 0])
                k += 1
        return min(k - self.size, len(self.leaves) - 1), start

    def replace(self, start: int, end: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Put other pre-tokens in the place of those between two boundaries."""
        first, at = self.leaf_at(start)
        own, counts = self.leaves[first]
        edges = at + np.cumsum(own) if len(own) else np.zeros(0, dtype=np.int64)
        before = int(np.searchsorted(edges, start, "right"))
        if end > start:
            last, to = self.leaf_at(end - 1)
        else:
            last, to = first, at
        own2, counts2 = self.leaves[last]
        after = int(np.searchsorted(to + np.cumsum(own2), end, "right")) if len(own2) else 0
        none = np.zeros(0, dtype=np.int64)
        new = (np.concatenate([own[:before], chars, own2[after:]]), np.concatenate([counts[:before], tokens, counts2[after:]]))
        for k in range(first, last + 1):
            self.leaves[k] = new if k == first else (none, none)
            n = self.size + k
            self.sums[n] = self.leaves[k][0].sum(), self.leaves[k][1].sum()
        lo, hi = (self.size + first) // 2, (self.size + last) // 2
        while lo:
            for n in range(lo, hi + 1):
                self.sums[n] = self.sums[2 * n] + self.sums[2 * n + 1]
            lo, hi = lo // 2, hi // 2
        if len(new[0]) > WIDEST * LEAF:  # a long insertion: deal all out again, so that leaves stay small and the tree as high as it should be
            self.__init__(*(np.concatenate(c) for c in zip(*self.leaves)))


def built(text: str, counter: Counter) -> Tree:
    pieces = counter.pattern.findall(text)
    return Tree(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)), counter.counts(pieces))


def edited(text: str, edits: list[Edit], tree: Tree, counter: Counter) -> tuple[str, int]:
    """The text after the edits (at, end, new text), and how many pre-tokens were encoded again; the tree is brought up to date.

    Edits are in order and don't overlap; places are those of the text before all of them.
    """
    parts, at, again = [], 0, 0
    for a, b, new in edits:
        parts += [text[at:a], new]
        at = b
    parts.append(text[at:])
    after = "".join(parts)
    moved = sum(len(new) - (b - a) for a, b, new in edits)
    k = len(edits)
    while k:  # from the back, so that places before stay right
        k -= 1
        # Edits whose surroundings meet are taken together.
        a, b = edits[k][0], edits[k][1]
        grown = len(edits[k][2]) - (b - a)
        while k and edits[k - 1][1] + 4 * AHEAD >= a:
            k -= 1
            a = edits[k][0]
            grown += len(edits[k][2]) - (edits[k][1] - edits[k][0])
        shift = moved - grown  # of what stands before
        start = _boundary(tree, max(0, a - AHEAD))
        pieces, place = [], start + shift
        stop = b + moved
        ends = _edges_from(tree, b)
        nxt = next(ends, None)
        while place < len(after):
            while nxt is not None and nxt + moved < place:
                nxt = next(ends, None)
            if place >= stop and (nxt is not None and nxt + moved == place):
                break
            m = counter.pattern.match(after, place)
            pieces.append(m[0])
            place = m.end()
        tree.replace(start, place - moved if place < len(after) else int(tree.sums[1, 0]), np.array([len(p) for p in pieces], dtype=np.int64), counter.counts(pieces))
        again += len(pieces)
        moved = shift
        # The tree now has the new lengths from here on; what is left stands before ``start``.
    return after, again


def _boundary(tree: Tree, char: int) -> int:
    """The last boundary at or before a character."""
    leaf, start = tree.leaf_at(char)
    edges = start + np.r_[0, np.cumsum(tree.leaves[leaf][0])]
    return int(edges[np.searchsorted(edges, char, "right") - 1])


def _edges_from(tree: Tree, char: int):
    """The boundaries from a character on."""
    leaf, start = tree.leaf_at(char)
    if start >= char:
        yield start
    for k in range(leaf, len(tree.leaves)):
        for n in tree.leaves[k][0].tolist():
            start += n
            if start >= char:
                yield start


def repeated_lines(text: str) -> list[Edit]:
    """Edits that remove each line, with its line end, that stood earlier in the text; blank lines stay."""
    seen, out, at = set(), [], 0
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if bare and bare in seen:
            out.append((at, at + len(line), ""))
        seen.add(bare)
        at += len(line)
    return out


def counted(docs: DataFrame, edits: Callable[[str], list[Edit]] = repeated_lines, id_col: str = "doc_id", text_col: str = "text",
            vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_encoded_again, text_after) of every row.

    Null texts count as empty and have no tokens; repeated rows are counted each; an empty table gives no rows; a text is held whole, with its tree; other columns
    don't matter, whatever their names. ``vocabulary`` must be at the same path on all executors.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded_again")] + [("text_after", pa.string())])

    def run(batches):
        counter = Counter(vocabulary, pattern)
        for batch in batches:
            out, size = [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                tree = built(text, counter)
                before, todo = tree.tokens, edits(text)
                after, again = edited(text, todo, tree, counter) if todo else (text, 0)
                out.append((row, before, len(todo), tree.tokens, again, after))
                size += len(after)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    rows = pick(docs, doc_id=F.col(id_col).cast("long"), text=text_col)
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_encoded_again long, text_after string")
