"""Entity keys, computed inside the JVM.

Compatibility decomposition followed by dropping everything outside ASCII works
one code point at a time (reordering only moves combining marks, and those are
dropped). So the whole mapping can be worked out by rule when the plan is
built: single replacements go to one ``translate``, the few code points that
expand to several characters to a map that is only consulted when one occurs.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions.text import stripped


@functools.lru_cache(maxsize=1)
def ascii_folding() -> tuple[str, str, dict[str, str]]:
    """(code points with one ASCII letter, those letters, expansions of several)."""
    source, target, wide = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        plain = unicodedata.normalize("NFKD", char)
        if plain == char:
            continue
        plain = plain.encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif plain:
            wide[char] = plain
    return "".join(source), "".join(target), wide


def _char_class(chars) -> str:
    """Regex class of the code points, runs of neighbours written as ranges."""
    points = sorted(map(ord, chars))
    runs = []
    for point in points:
        if runs and point == runs[-1][1] + 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def ascii_fold(text: Column) -> Column:
    source, target, wide = ascii_folding()
    table = F.str_to_map(
        F.lit("\u0001".join(f"{c}\u0002{a}" for c, a in wide.items())), F.lit("\u0001"), F.lit("\u0002"))
    expanded = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    # The first test is cheap and settles nearly all Latin text; both must hold.
    maybe = r"[\xbc-\xbe\x{132}-\x{10ffff}]"
    widened = F.when(text.rlike(maybe) & text.rlike(_char_class(wide)), expanded).otherwise(text)
    folded = F.regexp_replace(F.translate(widened, source, target), r"[^\x00-\x7f]", "")
    return F.when(text.rlike(r"[^\x00-\x7f]"), folded).otherwise(text)


def slugify(name: Column) -> Column:
    """Case, accents and punctuation removed; names with nothing left keep their own letters."""
    plain = F.translate(ascii_fold(name), "'`", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    own = F.regexp_replace(F.lower(stripped(name)), r"(?U)\s+", "-")
    # Most names are a plain word, which only changes case.
    return F.when(name.rlike(r"\A[A-Za-z0-9]+\z"), F.lower(name)).when(slug != "", slug).otherwise(own)
