"""The main text of web pages, by a tree-structured graphical model over the elements of each page.

Every element is content or not. Its own potential comes from tokens that describe it (tag, parent, words of class, id and role, length of text, share
of links), the potential of an edge from how often a child has the label of its parent. Messages go up from the leaves and down from the root
(sum-product), which gives each element's marginal; text of elements that are rather content than not is kept.

The potentials are counted over all labelled pages. A page labels itself where it has an ``article`` or ``main`` element: what is inside is
content, but for elements whose tag or class names another part (``PARTS``); what is outside is not. Other pages are not learnt from.
The names in ``PARTS`` and ``BODIES`` also enter as ``PRIOR`` counts, for parts that no labelled page has.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import pick

PRIOR = 50
#: Slots of the fixed table that names of neither list below share by hash, so that each of them counts however many there are.
SLOTS = 1 << 16
#: The most that one token says, by its kind: generic tags, parents, lengths and shares of links less than names and other tags, generic parents least.
_CLIP = {"n": 4.0, "t": 4.0, "p": 1.5, "a": 1.5, "l": 1.0}
_GENERIC = frozenset("t:div t:section t:table t:tbody t:tr t:td t:th t:ul t:ol t:li t:dl t:dt t:dd t:p t:h1 t:h2 t:h3 t:h4 t:h5 t:h6 t:a t:span t:blockquote t:pre t:figure".split())
#: Names of parts that aren't the article, and of those that are.
PARTS = frozenset("""ad ads advert advertisement advertising aside banner breadcrumb breadcrumbs button comment comments consent cookie cookies dialog disclaimer footer
form header menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related reply replies respond share sharing sidebar
signup social sponsor sponsored subscribe toc toolbar widget""".split())
BODIES = frozenset("article content entry main post story text".split())
_NEVER = frozenset("script style noscript template svg canvas iframe object head title select option textarea button form nav".split())
_RAW = frozenset("script style noscript template iframe textarea title svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: An opening tag ends open elements of these kinds, up to the ones that hold them.
_ENDS = {"li": ("li", {"ul", "ol"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}),
         "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
#: A quote opens a string only after an equals sign, and only if another one ends it.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""", re.S)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|["']?([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_KNOWN = PARTS | BODIES | _NEVER | _RAW | _VOID | _INLINE | {t[2:] for t in _GENERIC} | {"#page", "html", "body", "article", "main"}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: list[str]
    chars: int = 0
    linked: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)  # element and text, "" for a break between blocks


def parse(source: str | None) -> Page:
    """Elements (each after its parent) and texts of a page. Inline elements without class, id and role belong to the element around them."""
    page = Page([Node("#page", -1, [])])
    stack: list[tuple[str, int]] = [("#page", 0)]
    places: dict[str, list[int]] = {}  # of each tag in the stack
    links, at = 0, 0
    source = source or ""

    def text(a: int, b: int) -> None:
        if a < b:
            piece = source[a:b]
            node = stack[-1][1]
            page.texts.append((node, html.unescape(piece) if "&" in piece else piece))
            n = len(piece.strip())
            page.nodes[node].chars += n
            page.nodes[node].linked += n * (links > 0)

    def close(k: int) -> None:
        nonlocal links
        for tag, _ in stack[k:]:
            places[tag].pop()
            links -= tag == "a"
            if tag not in _INLINE:
                page.texts.append((0, ""))
        del stack[k:]

    def last(tags, within=()) -> int:
        """Where the innermost of these tags stands, 0 if nowhere or if one of ``within`` stands further in."""
        k, inner = (max((places[t][-1] for t in names if places.get(t)), default=0) for names in (tags, within))
        return k if k > inner else 0

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    while True:
        m = _TAG.search(source, at)
        if not m:
            break
        text(at, m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if k := last((tag,)):
                close(k)
            continue
        if tag not in _INLINE:
            page.texts.append((0, ""))
            if k := last(("p",), ("table", "button")):
                if tag not in _VOID:
                    close(k)
            if tag in _ENDS:
                kinds, within = _ENDS[tag]
                if k := last(kinds.split(), within):
                    close(k)
        if tag in _VOID or m[3].endswith("/") and tag not in _RAW:
            continue
        names = [w for n in _NAME.findall(m[3]) for w in _WORD.findall("".join(n).lower())] if "=" in m[3] else []
        if tag in _RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in _INLINE and not names:
            push(tag, stack[-1][1])
        else:
            page.nodes.append(Node(tag, stack[-1][1], names))
            push(tag, len(page.nodes) - 1)
        links += tag == "a"
    tail = source[at:]
    text(at, at + (tail.rfind("<") if re.search(r"<[a-zA-Z/!][^>]*\Z", tail) else len(tail)))
    return page


def _slot(name: str) -> str:
    """The name itself if it is known, else the number of its slot."""
    return name if name in _KNOWN else str(zlib.crc32(name.encode()) % SLOTS)


def tokens(page: Page, k: int) -> list[str]:
    """What describes an element."""
    n = page.nodes[k]
    around = page.nodes[n.parent] if n.parent >= 0 else n
    out = [f"t:{_slot(n.tag)}", f"p:{_slot(around.tag)}", f"l:{int(math.log2(n.chars + 1))}", f"a:{round(4 * n.linked / n.chars) if n.chars else -1}"]
    return out + [f"n:{t}" for t in {_slot(w) for w in n.names}]


def labels(page: Page) -> list[int] | None:
    """1 for content elements; None where the page doesn't label itself."""
    if not any(n.tag in ("article", "main") for n in page.nodes):
        return None
    out: list[int] = []
    for n in page.nodes:
        above = out[n.parent] if n.parent >= 0 else 0
        out.append(0 if is_part(n) else 1 if n.tag in ("article", "main") else above)
    return out


@dataclass
class Model:
    """Log odds of tokens, and of a content child under a content parent and under another, for parents that are named a part of the page and others."""

    odds: dict[str, float]
    under: tuple[tuple[float, float], tuple[float, float]]


def is_part(n: Node) -> bool:
    return n.tag in PARTS or n.tag in _NEVER or any(w in PARTS for w in n.names)


def _count(batches):
    found: Counter = Counter()
    for batch in batches:
        for source in batch.column(0).to_pylist():
            page = parse(source)
            own = labels(page)
            if own is None:
                continue
            for k, n in enumerate(page.nodes):
                found[f"y{own[k]}"] += 1
                if n.parent >= 0:
                    found[f"e{is_part(page.nodes[n.parent]):d}{own[n.parent]}{own[k]}"] += 1
                for t in tokens(page, k):
                    found[f"{own[k]}{t}"] += 1
        if len(found) > 200_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["what", "n"])
            found.clear()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["what", "n"])


def train(pages: DataFrame) -> Model:
    """Potentials from all pages (html) that label themselves: every token of theirs counts, in a table of bounded size."""
    counted = pages.select("html").mapInArrow(_count, "what string, n long").groupBy("what").agg(F.sum("n").alias("n"))
    seen = {r.what: r.n for r in counted.collect()}
    for kind, names in (("0", PARTS | _NEVER), ("1", BODIES)):
        for w in names:
            for what in (f"{kind}n:{w}", f"{kind}t:{w}"):
                seen[what] = seen.get(what, 0) + PRIOR
    for what, n in (("y0", 2 * PRIOR), ("y1", 2 * PRIOR), *((f"e{part}{a}{c}", PRIOR if a == c else 1) for part in "01" for a in "01" for c in "01")):
        seen[what] = seen.get(what, 0) + n
    odds = {}
    for what in {w[1:] for w in seen if w[0] in "01"}:
        one, zero = seen.get("1" + what, 0) + 0.5, seen.get("0" + what, 0) + 0.5
        most = 0.3 if what[0] == "p" and f"t{what[1:]}" in _GENERIC else 1.0 if what in _GENERIC else _CLIP[what[0]]
        odds[what] = max(-most, min(most, math.log(one / (seen["y1"] + 1)) - math.log(zero / (seen["y0"] + 1))))
    # Under an element that isn't named a part, content must be able to begin even if no labelled page has it there.
    floor = (-2.5, -9.0)
    under = tuple((math.log(seen[f"e{k}11"] / seen[f"e{k}10"]), max(floor[k], math.log(seen[f"e{k}01"] / seen[f"e{k}00"]))) for k in (0, 1))
    return Model(odds, under)


def _log1p(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def marginals(page: Page, model: Model) -> list[float]:
    """Log odds of content for each element, by messages up and down the tree."""
    nodes = page.nodes
    own = [sum(model.odds.get(t, 0.0) for t in tokens(page, k)) for k in range(len(nodes))]
    under = [model.under[is_part(n)] for n in nodes]
    up = [0.0] * len(nodes)
    belief = own[:]
    belief[0] -= 3.0
    for k in range(len(nodes) - 1, 0, -1):
        in1, in0 = under[nodes[k].parent]
        up[k] = (_log1p(belief[k] + in1) - _log1p(in1)) - (_log1p(belief[k] + in0) - _log1p(in0))
        belief[nodes[k].parent] += up[k]
    out = belief[:]
    for k in range(1, len(nodes)):
        in1, in0 = under[nodes[k].parent]
        rest = out[nodes[k].parent] - up[k]  # the parent's odds without what this child said
        one = _either(rest + in1 - _log1p(in1), in0 - _log1p(in0))
        zero = _either(rest - _log1p(in1), -_log1p(in0))
        out[k] = belief[k] + one - zero
    return out


def _either(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def extract(source: str | None, model: Model) -> str:
    """The text of the content elements; white space inside a block is one space, and so is each break between blocks."""
    page = parse(source)
    odds = marginals(page, model)
    blocks, held = [], []
    for node, piece in page.texts:
        if not piece:
            if held:
                blocks.append("".join(held))
                held = []
        elif odds[node] > 0:
            held.append(piece)
    blocks.append("".join(held))
    return " ".join(" ".join(" ".join(b.split()) for b in blocks).split())


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row; null and empty pages and pages without content have an empty text, repeated rows equal ones.

    An empty table gives no rows; other columns of the table don't matter, whatever their names. A page is held whole, whatever its length and however deep its
    elements lie. Broken markup is read as browsers do, as far as told here: what is left open ends with the element around it or with the page, a quote that
    nothing ends is part of a name.
    """
    rows = pick(pages, page_id=F.col(id_col).cast("long"), url=F.col(url_col).cast("string"), html=html_col)
    model = train(rows)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            texts = [extract(s, model) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)

    return rows.mapInArrow(run, "page_id long, url string, text string")
