"""Reading JSON out of free-form replies, and typed access to its loosely typed fields."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.text import (
    clamp_confidence, clamp_legibility, clean_list, float_or, int_or, split_list, stripped, truthy,
)

FENCE = r"(?s)```(?:json)?\s*(.*?)```"
BARE_NUMBER = r"([:,\[]\s*)(NaN|-?Infinity)(?=\s*[,}\]])"


def extract_json(df: DataFrame, reply: str, out: str = "data", tier: str = "tier") -> DataFrame:
    """Parse whole replies, then fenced blocks, then the first object in the text.

    The parser reads one value and lets any text follow it. So a whole reply or block counts only if it is still one value inside
    brackets and inside an object; from the first brace on, the parser finds the end of the object itself. Of a repeated key
    the last one counts, which a setting of the session allows. NaN and Infinity, which JSON doesn't have, are read as text of that name where nothing else parses.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    def alone(value: str, out: str) -> Callable[[DataFrame], DataFrame]:
        """Column ``out``: the text in the column ``value`` where it is one value."""
        def add(rows: DataFrame) -> DataFrame:
            listed, text = F.col("__listed"), F.col(value)
            boxed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
            single = listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull() & boxed.isNotNull()
            return rows.withColumn("__listed", F.when(text.startswith("{"), F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))).withColumn(
                out, F.when(single, F.try_variant_get(listed, "$[0]", "variant"))).drop("__listed")

        return add

    def either(rows: DataFrame, value: str, out: str, read: Callable[[str, str], Callable[[DataFrame], DataFrame]]) -> DataFrame:
        """As ``read``, and once more with NaN and Infinity as text where that gives nothing. Each step is a column of its own, so that it is done once."""
        plain = F.regexp_replace(value, BARE_NUMBER, '$1"$2"')
        rows = rows.transform(read(value, out)).withColumn("__plain", F.when(F.col(out).isNull() & F.col(value).startswith("{"), plain))
        rows = rows.withColumn("__plain", F.when(F.col("__plain") != F.col(value), F.col("__plain"))).transform(read("__plain", "__again"))
        return rows.withColumn(out, F.coalesce(out, "__again")).drop("__plain", "__again")

    def first(value: str, out: str) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: rows.withColumn(out, F.when(F.col(value).startswith("{"), F.try_parse_json(value)))

    rows = df.withColumn("__text", stripped(F.coalesce(F.col(reply), F.lit(""))))
    rows = either(rows, "__text", "__whole", alone)
    rows = rows.withColumn("__inner", F.when(F.col("__whole").isNull(), F.regexp_extract("__text", FENCE, 1)))
    rows = either(rows.withColumn("__inner", stripped(F.col("__inner"))), "__inner", "__fenced", alone)
    brace = F.locate("{", F.col("__text"))
    rows = rows.withColumn("__rest", F.when(F.coalesce("__whole", "__fenced").isNull() & (brace > 0), F.substr("__text", brace)))
    tried = either(rows, "__rest", "__span", first)
    return tried.select(
        *df.columns,
        F.coalesce("__whole", "__fenced", "__span").alias(out),
        F.when(F.col("__whole").isNotNull(), "whole").when(F.col("__fenced").isNotNull(), "fenced")
        .when(F.col("__span").isNotNull(), "span").otherwise("none").alias(tier),
    )


def with_fields(df: DataFrame, data: str, names: Sequence[str], typed: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """Read fields of a variant into columns of their own, all at once and each once however often it is used; see ``Field.kept``.

    All ``names`` are read as text; those in ``typed`` and ``lists`` also as numbers and as lists where they didn't come in as text.
    """
    def all_as(some: Sequence[str], of: str) -> Column:
        return F.try_variant_get(F.col(data), "$", f"struct<{', '.join(f'`{n}`: {of}' for n in some)}>")

    def unless_text(name: str, of: str) -> Column:
        return F.when(F.col(f"`__{name}_kind`") != "STRING", F.try_variant_get(F.col(f"__any.`{name}`"), "$", of))

    every = [*typed, *lists]
    rows = df.withColumns({"__text": all_as(names, "string"), "__any": all_as(every, "variant")})
    rows = rows.withColumns({f"__{n}_kind": F.schema_of_variant(F.col(f"__any.`{n}`")) for n in every})
    return rows.withColumns({f"__{n}_number": unless_text(n, "double") for n in typed} | {f"__{n}_strings": unless_text(n, "array<string>") for n in lists})


class Field:
    """One field of a variant reply, with the type it arrived in."""

    def __init__(self, data: Column, name: str) -> None:
        path = f"$.{name}"
        self.text = F.try_variant_get(data, path, "string")
        self.strings = F.try_variant_get(data, path, "array<string>")
        self.kind = F.schema_of_variant(F.try_variant_get(data, path, "variant"))
        self.number = F.try_variant_get(data, path, "double")

    @classmethod
    def kept(cls, name: str) -> "Field":
        """A field that ``with_fields`` has read."""
        made = cls.__new__(cls)
        made.text = F.col(f"__text.`{name}`")
        made.strings, made.kind, made.number = (F.col(f"`__{name}_{part}`") for part in ("strings", "kind", "number"))
        return made

    def is_text(self) -> Column:
        return self.kind == "STRING"

    def as_list(self) -> Column:
        return F.when(self.is_text(), split_list(self.text)).otherwise(clean_list(self.strings))

    def as_int(self, default: int) -> Column:
        """Numbers are cut to whole ones; text must be integer text."""
        whole = F.when(self.is_text(), int_or(self.text, default)).when(
            self.kind == "BOOLEAN", F.when(self.text == "true", 1).otherwise(0)
        ).otherwise(F.when(self.number.isNotNull() & (F.abs(self.number) < 1e18),
                           self.number.try_cast("long")))
        return F.coalesce(whole, F.lit(default)).cast("long")

    def as_float(self, default: float) -> Column:
        return F.coalesce(
            F.when(self.is_text(), float_or(self.text, default)).otherwise(self.number), F.lit(float(default))
        )

    def as_flag(self) -> Column:
        return truthy(self.text)


def legibility(field: Field) -> Column:
    return clamp_legibility(field.as_int(3))


def confidence(field: Field) -> Column:
    return clamp_confidence(field.as_float(0.5))
