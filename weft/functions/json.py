"""Strict JSON out of model responses, on VARIANT columns. try_parse_json alone takes text behind a value for nothing."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

FENCE = r"(?s)```(?:json|JSON)?\s*(.*?)```"
#: A word that closes a text under test; texts that hold it are tested by two parses.
CLOSE = "\u0091weft\u0092"
SPACES = " \t\n\r"


def may_be_json(x: Column) -> Column:
    """False for texts whose ends show that they are no JSON: a parse that fails costs many times one that does not."""
    starts = lambda *cs: reduce(or_, [F.startswith(x, F.lit(c)) for c in cs])
    ends = lambda *cs: reduce(or_, [F.endswith(x, F.lit(c)) for c in (*cs, *SPACES)])
    return F.when(starts("["), ends("]")).when(starts("{"), ends("}")).when(starts("t", "f", "n"), ends("e", "l")).otherwise(starts('"', *"-0123456789", *SPACES))


def strict(t: Column) -> Column:
    """The value if t is one JSON text and nothing else: the first of two items, of which the second is the closing word, or, where the text
    holds that word, one item as an array, and one field as an object."""

    def one(x: Column) -> Column:
        items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), x, F.lit(f',"{CLOSE}"]'))), "$", "array<variant>")
        item = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))), "$", "array<variant>")
        field = F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}")))
        two = let(items, lambda p: F.when((F.size(p) == 2) & (F.try_variant_get(F.get(p, F.lit(1)), "$", "string") == CLOSE), F.get(p, F.lit(0))))
        both = let(item, lambda p: F.when((F.size(p) == 1) & field.isNotNull(), F.get(p, F.lit(0))))
        return F.when(may_be_json(x), F.when(F.contains(x, F.lit(CLOSE)), both).otherwise(two))

    return let(t, one)


def kind(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, ARRAY<...>, OBJECT<...>, VOID."""
    return F.schema_of_variant(v)


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_number(v: Column) -> Column:
    return F.coalesce(kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.lit(False))


def text_of(v: Column) -> Column:
    """The string; null if it is none."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def text_at(v: Column, path: str) -> Column:
    """The string at path; null if there is none or it is no string."""
    return F.when(kind(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def array_at(v: Column, path: str) -> Column:
    """The array at path as variants; empty if there is none."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def texts_at(v: Column, path: str) -> Column:
    """The strings of the array at path, stripped, without blank ones."""
    strings = F.filter(array_at(v, path), lambda x: kind(x) == "STRING")
    return F.filter(F.transform(strings, lambda x: strip(F.try_variant_get(x, "$", "string"))), lambda x: x != "")


def cleaned(response: Column, to_bracket: bool = False) -> Column:
    """P5: without think blocks, unless nothing is left; to_bracket: nor what stands before the first bracket or brace."""

    def thoughtless(raw: Column) -> Column:
        return let(strip(F.when(F.contains(raw, F.lit("<think>")), F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")).otherwise(raw)), lambda t: F.when(t == "", strip(raw)).otherwise(t))

    def bracketed(t: Column) -> Column:
        a, b = F.locate("[", t), F.locate("{", t)
        first = F.when(a == 0, b).when(b == 0, a).otherwise(F.least(a, b))
        return F.when((first > 0) & ~F.contains(t, F.lit("```")), F.substring(t, first, F.length(t))).otherwise(t)

    t = let(F.coalesce(response, F.lit("")), thoughtless)
    return let(t, bracketed) if to_bracket else t


def last_of(t: Column, ch: str) -> Column:
    """The place of the last ch, 0 if there is none."""
    back = F.locate(ch, F.reverse(t))
    return F.when(back == 0, 0).otherwise(F.length(t) - back + 1)


def _between(t: Column, a: Column, z: Column) -> Column:
    return F.when((a > 0) & (z > a), F.substring(t, a, z - a + 1)).otherwise("")


def fenced(x: Column) -> Column:
    """What stands in the first fence, or nothing."""
    return F.when(F.contains(x, F.lit("```")), strip(F.regexp_extract(x, FENCE, 1))).otherwise("")


def array_in(t: Column, items: str | None = None) -> Column:
    """The array in a response: fenced, whole, the tightest [{...}], first to last bracket, or repaired after its last brace. With `items`
    it is an array of that type, in which items of another type are null."""

    def tries(x: Column) -> Column:
        first = F.locate("[", x)
        texts = [
            fenced(x),
            x,
            F.regexp_extract(x, r"(?s)\[\s*\{.*?\}\s*\]", 0),
            _between(x, first, last_of(x, "]")),
            F.when((first > 0) & (last_of(x, "}") > first), F.concat(_between(x, first, last_of(x, "}")), F.lit("]"))).otherwise(""),
        ]
        v = _first(texts, strict)
        return F.try_variant_get(v, "$", f"array<{items}>") if items else let(v, lambda v: F.when(is_array(v), v))

    return let(t, tries)


def object_in(t: Column) -> Column:
    """The object in a response: fenced, whole, or first to last brace."""

    def tries(x: Column) -> Column:
        texts = [fenced(x), x, _between(x, F.locate("{", x), last_of(x, "}"))]
        return _first(texts, lambda c: let(strict(c), lambda v: F.when(is_object(v), v)))

    return let(t, tries)


def _first(texts: list[Column], read) -> Column:
    """The first text that can be read; those behind it are neither cut out nor parsed."""

    def or_else(rest: Column | None):
        return lambda v: v if rest is None else F.coalesce(v, rest)

    out = None
    for t in reversed(texts):
        out = let(read(t), or_else(out))
    return out
