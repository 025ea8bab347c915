"""Near-duplicates by SimHash, found through the points of a covering code.

A product of perfect codes covers all 64-bit words: two Golay codes of 23 bits (radius 3), a Hamming code of
15 (radius 1) and a repetition code of 3 (radius 1), radius 8 together. A word's *home* is the code word
("anchor") that the four decoders give. Two fingerprints at distance t or less have a word between them at no more than
ceil(t / 2) from either; so each fingerprint goes to the homes of all words that near, which are the anchors that
covering radius and threshold can make two such fingerprints share, and no others. Fingerprints are compared
with those of the same anchor only. An anchor gives at most one link less than it has fingerprints
(a tree over each of its groups), never all pairs. Anchors with more than ``CROWD`` fingerprints are
compared by the words between instead of pair by pair: fingerprints that share such a word are linked.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm import jaccard
from keepsake.llm.common import components, pick
from keepsake.session import cut

BITS = 64
CROWD = 4096
SEED = 42
#: Bits of each perfect code, its radius, and the parity check of each bit.
_GOLAY = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_ONE = np.uint64(1)


def _golay_checks() -> list[int]:
    out, x = [], 1
    for _ in range(23):
        out.append(x)
        x <<= 1
        if x >> 11:
            x ^= _GOLAY
    return out


class Cover:
    """The code: decodes 64-bit words to their anchors."""

    def __init__(self) -> None:
        self.blocks, at = [], 0
        for checks, radius in ((_golay_checks(), 3), (_golay_checks(), 3), (list(range(1, 16)), 1), ([1, 2, 3], 1)):
            self.blocks.append((at, len(checks), *self._tables(checks, radius)))
            at += len(checks)

    @staticmethod
    def _tables(checks: list[int], radius: int):
        """Syndromes of the low 12 bits and of the rest, and the error of each syndrome."""
        low, high = checks[:12], checks[12:]
        halves = []
        for part in (low, high):
            s = np.zeros(1 << len(part), dtype=np.int64)
            for i, c in enumerate(part):
                s[1 << i:2 << i] = s[:1 << i] ^ c
            halves.append(s)
        errors = np.zeros(max(checks).bit_length() and 1 << max(checks).bit_length(), dtype=np.uint64)
        for weight in range(1, radius + 1):
            for bits in combinations(range(len(checks)), weight):
                syndrome = 0
                for b in bits:
                    syndrome ^= checks[b]
                errors[syndrome] = sum(1 << b for b in bits)
        return halves[0], halves[1], errors

    def home(self, words: np.ndarray) -> np.ndarray:
        out = words.copy()
        for at, n, low, high, errors in self.blocks:
            block = (words >> np.uint64(at)) & np.uint64((1 << n) - 1)
            syndrome = low[(block & np.uint64(len(low) - 1)).astype(np.int64)] ^ high[(block >> np.uint64(12)).astype(np.int64)]
            out ^= errors[syndrome] << np.uint64(at)
        return out


def near_masks(reach: int) -> np.ndarray:
    """All words of at most ``reach`` set bits."""
    return np.array([sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(BITS), n)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit set where it is set in more than half of the 64-bit hashes; 0 for none."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at:at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; of the whole sequence where it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = (b" ".join(words),) if len(words) <= size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)


def word_hashes(text: str | None, seed: int) -> np.ndarray:
    """XXH64 of each different word."""
    words = set(text.encode("utf-8", "surrogatepass").lower().split()) if text else ()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64)


def fingerprints(docs: DataFrame, sizes: dict[str, int], seeds: dict[str, int] | None = None) -> DataFrame:
    """The rows of ``docs`` (row, mark, text) as (row, mark, one long per entry): over ``sizes`` words each, or over different words with a seed."""
    seeds = seeds or {}
    schema = pa.schema([("row", pa.int64()), ("mark", pa.int64())] + [(n, pa.int64()) for n in (*sizes, *seeds)])

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            made = [[majority(shingle_hashes(t, k)) for t in texts] for k in sizes.values()] + [[majority(word_hashes(t, k)) for t in texts] for k in seeds.values()]
            columns = [pa.array(np.array(m, dtype=np.uint64).view(np.int64)) for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=schema)

    return docs.select("row", "mark", "text").mapInArrow(run, "row long, mark long, " + ", ".join(f"{n} long" for n in (*sizes, *seeds)))


def _trees(prints: np.ndarray, proofs: np.ndarray, within: int, proof_within: int) -> list[tuple[int, int]]:
    """Index pairs that link the groups of fingerprints near each other: a tree for each group."""
    found, left = [], np.arange(len(prints))
    while len(left) > 1:
        seed, left = left[0], left[1:]
        stack = [seed]
        while stack and len(left):
            at = stack.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= within
            if proof_within < BITS:
                near &= np.bitwise_count(proofs[left] ^ proofs[at]) <= proof_within
            if near.any():
                hit = left[near]
                found.extend((int(at), int(x)) for x in hit)
                stack.extend(hit.tolist())
                left = left[~near]
    return found


def _crowd(anchor: int, prints: np.ndarray, proofs: np.ndarray, within: int, proof_within: int, masks: np.ndarray, cover: Cover) -> list[tuple[int, int]]:
    """As ``_trees`` for an anchor with very many fingerprints: those that share a word between them are compared."""
    found = []
    for part in range(16):  # the words between in parts, to bound memory
        words, owners = [], []
        for mask in masks:
            z = prints ^ mask
            mine = ((z * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)) == part
            z, own = z[mine], np.nonzero(mine)[0]
            here = cover.home(z) == np.uint64(anchor)
            words.append(z[here])
            owners.append(own[here])
        z, own = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(z, kind="stable")
        z, own = z[order], own[order]
        starts = np.nonzero(np.r_[True, z[1:] != z[:-1]])[0] if len(z) else []
        for a, b in zip(starts, [*starts[1:], len(z)]):
            if b - a > 1:
                group = np.unique(own[a:b])
                found.extend((int(group[i]), int(group[j])) for i, j in _trees(prints[group], proofs[group], within, proof_within))
    return found


def links(nodes: DataFrame, within: int, proof_within: int = BITS) -> DataFrame:
    """Links (a, b) that join all of the distinct ``nodes`` (print, proof) near each other.

    Near: at most ``within`` bits between the prints and ``proof_within`` between the proofs. A node is named
    by the 32 hex digits of both. Only trees of links are returned, whose groups are those of all links.
    """
    reach = (within + 1) // 2
    masks = near_masks(reach)
    schema = pa.schema([("anchor", pa.int64()), ("print", pa.int64()), ("proof", pa.int64())])

    def replicate(batches):
        cover = Cover()
        step = max(1, 400_000 // len(masks))
        for batch in batches:
            prints = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            proofs = np.asarray(batch.column(1)).astype(np.int64)
            for at in range(0, len(prints), step):
                own = prints[at:at + step]
                homes = np.sort(cover.home((own[:, None] ^ masks[None, :]).ravel()).reshape(len(own), -1), axis=1)
                new = np.ones(homes.shape, dtype=bool)
                new[:, 1:] = homes[:, 1:] != homes[:, :-1]
                row = np.nonzero(new)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(homes[new].view(np.int64)), pa.array(own[row].view(np.int64)), pa.array(proofs[at:at + step][row])], schema=schema)

    out = pa.schema([("a", pa.string()), ("b", pa.string())])

    def compare(batches):
        cover = Cover()
        held: list[np.ndarray] = []

        def group(rows: np.ndarray) -> list[tuple[int, int]]:
            prints, proofs = rows[:, 1].view(np.uint64), rows[:, 2].view(np.uint64)
            if len(rows) <= CROWD:
                return _trees(prints, proofs, within, proof_within)
            return _crowd(int(rows[:1, 0].view(np.uint64)[0]), prints, proofs, within, proof_within, masks, cover)

        def named(rows: np.ndarray, pairs):
            name = [f"{p:016x}{q:016x}" for p, q in rows[:, 1:].view(np.uint64).tolist()]
            return [(min(name[i], name[j]), max(name[i], name[j])) for i, j in pairs]

        def batchwise(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], schema=out)

        for batch in batches:
            rows = np.column_stack([np.asarray(batch.column(i)) for i in range(3)])
            if held and len(rows) and held[-1][0, 0] == rows[0, 0] and rows[0, 0] == rows[-1, 0]:
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows]) if held else rows
            starts = np.nonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])[0]
            found = []
            sizes = np.diff(np.r_[starts, len(rows)])
            for k in np.nonzero(sizes[:-1] > 1)[0]:
                part = rows[starts[k]:starts[k] + sizes[k]]
                found.extend(named(part, group(part)))
            held = [rows[starts[-1]:]] if len(starts) else []
            if found:
                yield batchwise(found)
        if held:
            rows = np.concatenate(held)
            if len(rows) > 1 and (found := named(rows, group(rows))):
                yield batchwise(found)

    spread = nodes.select("print", "proof").mapInArrow(replicate, "anchor long, print long, proof long")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a string, b string").distinct()


def _hex(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, within: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: fingerprints link at ``within`` bits or fewer, a component is named by its smallest id.

    Null and empty texts have fingerprint zero and link like any other; rows with the same id or text are kept as they are; a null id
    stays null, and ``component_id`` is null only for a component of null ids.
    """
    rows = pick(docs, row=F.col(id_col).cast("long"), mark=F.lit(0).cast("long"), text=text_col)
    made = cut(fingerprints(rows, {"print": shingle}))
    nodes = cut(made.groupBy("print").agg(F.min("row").alias("first")).withColumn("proof", F.lit(0).cast("long")))
    roots = components(links(nodes, within))
    named = cut(nodes.withColumn("node", F.concat(_hex("print"), _hex("proof"))).join(roots, "node", "left")
                .select("print", F.coalesce("root", "node").alias("root"), "first"))
    labels = named.join(named.groupBy("root").agg(F.min("first").alias("least")), "root").select("print", "least")
    return made.join(labels, "print").select(
        F.col("row").alias("doc_id"), _hex("print").alias("fingerprint"), F.col("least").alias("component_id"))


def candidates(nodes: DataFrame, within: int) -> DataFrame:
    """Pairs (a0, a1, b0, b1) of the distinct ``nodes`` (d0, d1, print) whose fingerprints are within ``within`` bits: enough to join each group of them, found at the anchors."""
    firsts = cut(nodes.groupBy("print").agg(F.min(F.struct("d0", "d1")).alias("first")))
    by_name = firsts.select(F.concat(_hex("print"), F.lit("0" * 16)).alias("name"), "first")
    near = links(firsts.select("print", F.lit(0).cast("long").alias("proof")), within)
    across = near.join(by_name.select(F.col("name").alias("a"), F.col("first").alias("x")), "a").join(by_name.select(F.col("name").alias("b"), F.col("first").alias("y")), "b")
    alike = nodes.join(firsts, "print").select(F.col("first").alias("x"), F.struct("d0", "d1").alias("y")).where("x <> y")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return across.select("x", "y").union(alike).select(low["d0"].alias("a0"), low["d1"].alias("a1"), high["d0"].alias("b0"), high["d1"].alias("b1")).distinct()


def keep_first(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", within: int = 2) -> DataFrame:
    """All columns of one row of each group of near copies: that of the smallest id, null ids last.

    Copies are rows whose sets of ``shingle`` words have Jaccard 0.8 or more, all such pairs; groups are what they join. Pairs whose SimHash fingerprints over these sets
    differ in ``within`` bits or fewer are found by the covering code and checked first; those further apart, as many at 0.8 are, come from a join on shingles (see ``jaccard``).
    Of rows with the same id the one with the smallest hash stays; a repeated row stays once, that with the smallest hash of all columns. Empty and null texts are one
    group; an empty table stays empty; very long texts are taken whole. Extra columns are returned untouched, whatever their names.
    """
    ids, marks = F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = pick(docs, row=ids, mark=marks, text=text_col)
    made = cut(jaccard.named(texts, shingle, majority))
    likely = candidates(made.where("print is not null").select("d0", "d1", "print").distinct(), within)
    roots = components(jaccard.links(texts, shingle, likely)).select(F.col("node.d0").alias("d0"), F.col("node.d1").alias("d1"), "root")
    groups = made.join(roots, ["d0", "d1"], "left").select("row", "mark", F.coalesce("root", F.struct("d0", "d1")).alias("root"))
    key = F.struct(F.col("row").isNull().alias("k0"), F.coalesce("row", F.lit(0)).alias("k1"), F.col("mark").alias("k2"))
    keep = groups.groupBy("root").agg(F.min(key).alias("k")).select("k.*")
    many = made.groupBy(F.col("row").isNull().alias("k0"), F.coalesce("row", F.lit(0)).alias("k1"), F.col("mark").alias("k2")).count().where("count > 1").drop("count")
    keep = cut(keep.join(many.withColumn("again", F.lit(True)), ["k0", "k1", "k2"], "left").withColumn("again", F.col("again").isNotNull()))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("r"), ids.isNull().alias("k0"),
                       F.coalesce(ids, F.lit(0)).alias("k1"), marks.alias("k2"))
    single = rows.join(keep.where("not again").drop("again"), ["k0", "k1", "k2"], "left_semi").select("r.*")
    order = Window.partitionBy("k0", "k1", "k2").orderBy(F.xxhash64("r"))
    repeated = rows.join(keep.where("again").drop("again"), ["k0", "k1", "k2"], "left_semi")
    return single.unionByName(repeated.withColumn("n", F.row_number().over(order)).where("n = 1").select("r.*"))
