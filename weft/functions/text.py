"""String expressions shared by the operators. All are built-in column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip takes off: Unicode white space and the four separators.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A character that strip would keep.
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    # a trim looks at the ends alone, where a pattern would be tried at every character
    return F.trim(col(c), F.lit(BLANKS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value written once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def characters(c: Column | str) -> Column:
    """The text's characters as an array."""
    return F.filter(F.split(col(c), ""), lambda x: x != "")


def no_blanks(xs: Column) -> Column:
    """The array's items, stripped, without blank ones."""
    return F.filter(F.transform(xs, strip), lambda x: x != "")


def strip_images(c: Column | str) -> Column:
    """Inline base64 images without an alternative text become a placeholder."""
    return F.regexp_replace(col(c), r"!\[\]\(data:image/[^)]+\)", "[图片]")


def plain_name(c: Column | str) -> Column:
    """A name without a trailing annotation in full-width, then in ASCII parentheses. The two patterns are fixed values."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), "（[^）]*）$", ""), r"\([^)]*\)$", ""))


#: Particles that mark a clause and not a name.
CLAUSE_MARKS = ("的", "了", "过", "着", "地", "得")


def is_phrase(c: Column | str) -> Column:
    """A descriptive phrase: over ten characters without a Latin letter, or with a clause particle."""
    n = strip(c)
    return ((F.length(n) > 10) & ~n.rlike("[A-Za-z]")) | n.rlike("[" + "".join(CLAUSE_MARKS) + "]")


def bigrams(c: Column | str) -> Column:
    """Distinct character pairs of the lower-cased text without white space."""
    t = F.regexp_replace(F.lower(col(c)), r"(?U)\s+", "")
    return F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))))


def bigram_jaccard(a: Column | str, b: Column | str) -> Column:
    """0 on empty texts; with a text of one character, equality."""
    x, y = (F.regexp_replace(F.lower(col(c)), r"(?U)\s+", "") for c in (a, b))
    p, q = bigrams(a), bigrams(b)
    return F.when((x == "") | (y == ""), 0.0).when((F.length(x) < 2) | (F.length(y) < 2), (x == y).cast("double")).otherwise(F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q)))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def xml_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attr(c: Column) -> Column:
    """Quoted and escaped; single quotes around a value with a double quote and without a single one."""
    e = F.replace(F.replace(F.replace(xml_text(c), F.lit("\n"), F.lit("&#10;")), F.lit("\r"), F.lit("&#13;")), F.lit("\t"), F.lit("&#9;"))
    q = F.contains(e, F.lit('"'))
    return F.when(~q, F.concat(F.lit('"'), e, F.lit('"'))).when(~F.contains(e, F.lit("'")), F.concat(F.lit("'"), e, F.lit("'"))).otherwise(F.concat(F.lit('"'), F.replace(e, F.lit('"'), F.lit("&quot;")), F.lit('"')))


def truncated(c: Column, most: int) -> Column:
    """At most `most` characters, the last one an ellipsis if anything was cut."""
    return F.lit("") if most <= 0 else F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)
