"""Secrets in texts, found through an inverted index of trigrams; DataFrame functions only.

Each rule's regular expression is read into a Boolean query over trigrams that any match must hold. The index has, for
the trigrams that some rule asks for, a posting of each text that holds it (in lower case). Intersecting and
uniting postings leaves the candidates of each rule, and only these are verified with the expression itself. Rules whose
expression has no trigram that every match holds scan all texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _parser  # type: ignore[attr-defined]

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import pick
from keepsake.session import cut


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters of the group below; shorter matches are dropped
    group: int = 0


#: The base rules, in the order that ties are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs are taken whole, so this is every run of 16 and more
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE
_SETS, _CLASS = 64, 8


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All of these must hold: of each list, one set whose trigrams are all in the text in lower case. Empty: no trigram is mandatory."""
    query: list[list[frozenset[str]]] = []

    def flush(runs: set[str]) -> None:
        if min(map(len, runs)) >= 3:
            sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in runs}
            query.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))

    def exact(part) -> set[str] | None:
        """All strings that a part can match, or None if it can't be listed."""
        runs = {""}
        for op, value in part:
            name = str(op)
            if name == "LITERAL":
                one: set[str] | None = {chr(value).lower()}
            elif name == "IN":
                chars = [chr(v) for o, v in value if str(o) == "LITERAL"]
                one = {c.lower() for c in chars} if len(chars) == len(value) <= _CLASS else None
            elif name == "BRANCH":
                found = [exact(b) for b in value[1]]
                one = None if None in found else set().union(*found)
            elif name == "SUBPATTERN":
                one = exact(value[-1])
            elif name == "MAX_REPEAT" and value[0] in (0, 1) and value[1] == 1:
                one = exact(value[2])
                one = one if one is None or value[0] else one | {""}
            elif name == "MAX_REPEAT" and value[0] == value[1] <= 8:
                one = exact(value[2])
                one = None if one is None or len(one) > 1 else {next(iter(one)) * value[0]}
            else:
                one = None
            if one is None or len(runs) * len(one) > _SETS:
                return None
            runs = {a + b for a, b in product(runs, one)}
        return runs

    runs = {""}
    for part in _parser.parse(pattern):
        one = exact([part])
        if one is None or len(runs) * len(one) > _SETS:
            flush(runs)
            runs = {""} if one is None else one
        else:
            runs = {a + b for a, b in product(runs, one)}
    flush(runs)
    return query


class Index:
    """The trigrams that a set of rules asks for, each a bit of one of the masks."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.queries = {r.kind: trigram_query(r.pattern) for r in rules}
        self.trigrams = sorted({t for q in self.queries.values() for one in q for s in one for t in s})
        self.place = {t: (i // 62, 1 << (i % 62)) for i, t in enumerate(self.trigrams)}
        self.masks = len(self.trigrams) // 62 + 1

    def postings(self, rows: DataFrame) -> DataFrame:
        """(trigram, key) of each text (key, text); the trigram by its number."""
        lower = rows.select("key", F.lower("text").alias("lower"))
        held = F.filter(F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(i)) for i, t in enumerate(self.trigrams)]), lambda x: x.isNotNull())
        return lower.select(F.explode(held).alias("trigram"), "key")

    def candidates(self, postings: DataFrame) -> DataFrame:
        """(key, one Boolean per rule that has a query): the texts whose postings satisfy the query of at least one rule."""
        bit = F.expr("shiftleft(1L, trigram % 62)")
        united = postings.groupBy("key").agg(
            *[F.bit_or(F.when(F.floor(F.col("trigram") / 62) == m, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{m}") for m in range(self.masks)])
        hits = {k: self._holds(q) for k, q in self.queries.items() if q}
        some = reduce(lambda a, b: a | b, hits.values(), F.lit(False))
        return united.where(some).select("key", *[h.alias(k) for k, h in hits.items()])

    def _holds(self, query: list[list[frozenset[str]]]) -> Column:
        def all_of(s: frozenset[str]) -> Column:
            need = [0] * self.masks
            for t in s:
                m, b = self.place[t]
                need[m] |= b
            return reduce(lambda a, b: a & b, [F.col(f"m{i}").bitwiseAND(F.lit(n)) == n for i, n in enumerate(need) if n], F.lit(True))

        return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(all_of, one)) for one in query])


_BLOCK = 256


def _steps(gaps: Column, sizes: Column) -> Column:
    """For each match the characters since the match before it (g), and those with its own (s)."""
    return F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, n: F.struct(g.alias("g"), (g + n).alias("s")))


def _total(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x["s"])


def _sums(steps: Column) -> Column:
    """The lengths of each block of steps."""
    blocks = F.sequence(F.lit(0), ((F.size(steps) - 1) / _BLOCK).cast("int"))
    return F.transform(blocks, lambda b: _total(F.slice(steps, b * _BLOCK + 1, _BLOCK)))


def _starts(steps: Column, sums: Column) -> Column:
    """Where each match starts: the lengths of the blocks before its own, and of the steps before it there."""
    bases = F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, 1, b), F.lit(0), lambda a, x: a + x))
    return F.transform(steps, lambda x, i: F.element_at(bases, (i / _BLOCK).cast("int") + 1)
                       + _total(F.slice(steps, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)) + x["g"])


def _spans(rank: int, rule: Rule, x: Column, starts: Column) -> Column:
    """(at, rank, kind, to) of the matches that are long enough."""
    ends = F.zip_with(x["sizes"], x["kept"] if rule.group else x["sizes"], lambda n, k: F.struct(n.alias("n"), k.alias("k")))
    whole = F.zip_with(starts, ends, lambda at, m: F.struct(
        at.alias("at"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (at + m["n"]).alias("to"), m["k"].alias("k")))
    return F.transform(F.filter(whole, lambda s: s["k"] >= rule.least), lambda s: s.dropFields("k"))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds to ``docs`` (key, text) the column ``found``: array of (at, rank, kind, to), sorted; code points, end exclusive.

    Null texts count as empty and have no spans. ``key`` must be equal only for equal texts, so repeated rows may share one.
    """
    index = Index(rules)
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    found = cut(index.candidates(cut(index.postings(rows.select("key", "text")))))
    asked = [r for r in rules if index.queries[r.kind]]
    marked = rows.join(found.withColumnsRenamed({r.kind: f"c_{r.kind}" for r in asked}), "key", "left")
    verify = {r.kind: F.coalesce(F.col(f"c_{r.kind}"), F.lit(False)) if r in asked else F.lit(True) for r in rules}
    matches = {}
    for r in rules:
        pattern = F.lit(r.pattern)
        kept = F.regexp_extract_all("text", pattern, F.lit(r.group)) if r.group else F.lit(None).cast("array<string>")
        matches[f"x_{r.kind}"] = F.when(verify[r.kind] & F.col("text").rlike(r.pattern), F.struct(
            F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length).alias("sizes"),
            F.transform(F.split("text", r.pattern, -1), F.length).alias("gaps"),
            F.transform(kept, F.length).alias("kept")))
    stepped = marked.withColumns(matches).withColumns(
        {f"y_{r.kind}": F.when(F.col(f"x_{r.kind}").isNotNull(), _steps(F.col(f"x_{r.kind}")["gaps"], F.col(f"x_{r.kind}")["sizes"])) for r in rules})
    summed = stepped.withColumns({f"z_{r.kind}": F.when(F.col(f"y_{r.kind}").isNotNull(), _sums(F.col(f"y_{r.kind}"))) for r in rules})
    spans = {r.kind: F.when(F.col(f"y_{r.kind}").isNotNull(), _spans(
        rank, r, F.col(f"x_{r.kind}"), _starts(F.col(f"y_{r.kind}"), F.col(f"z_{r.kind}")))) for rank, r in enumerate(rules)}
    none = F.array().cast("array<struct<at: int, rank: int, kind: string, to: int>>")
    every = F.array_sort(F.concat(*[F.coalesce(s, none) for s in spans.values()]))
    return summed.select(*docs.columns, every.alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["at"], s["to"])), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) of every row."""
    rows = pick(docs, doc_id=id_col, key=F.xxhash64(id_col, text_col), text=text_col)
    return find(rows, rules).select("doc_id", "found")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, each span (those that overlap as one) replaced by the kind of its first in brackets.

    Rows without a span keep their text, nulls included.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("r"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    found = find(rows, rules)
    start = F.struct(F.array().cast("array<struct<at: int, to: int, kind: string>>").alias("done"),
                     F.lit(None).cast("struct<at: int, to: int, kind: string>").alias("last"))

    def step(state: Column, s: Column) -> Column:
        last = state["last"]
        new = F.struct(s["at"].alias("at"), s["to"].alias("to"), s["kind"].alias("kind"))
        grown = F.struct(last["at"].alias("at"), F.greatest(last["to"], s["to"]).alias("to"), last["kind"].alias("kind"))
        return (F.when(last.isNull(), F.struct(state["done"].alias("done"), new.alias("last")))
                .when(s["at"] < last["to"], F.struct(state["done"].alias("done"), grown.alias("last")))
                .otherwise(F.struct(F.concat(state["done"], F.array(last)).alias("done"), new.alias("last"))))

    merged = F.aggregate("found", start, step, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))
    cutting = found.withColumn("merged", F.when(F.size("found") > 0, merged))
    parts = F.transform("merged", lambda s, i: F.concat(
        F.substring(F.col("text"), F.when(i == 0, F.lit(1)).otherwise(F.try_element_at("merged", F.greatest(i, F.lit(1)))["to"] + 1),
                    s["at"] - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("merged", F.greatest(i, F.lit(1)))["to"])),
        F.lit("["), s["kind"], F.lit("]")))
    rest = F.substring(F.col("text"), F.element_at("merged", -1)["to"] + 1, F.length("text"))
    clean = F.when(F.col("merged").isNull(), F.col(f"r.{text_col}")).otherwise(F.concat(F.array_join(parts, ""), rest))
    name = next(c for c in docs.columns if c.lower() == text_col.lower())
    return cutting.select(*[clean.alias(name) if c == name else F.col("r").getField(c).alias(c) for c in docs.columns])
