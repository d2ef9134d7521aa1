"""Documents to heading-aware sections. Every document is split inside its own row; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_BLANK, let, no_blanks, strip, strip_images

#: A heading line, and where a sentence ends.
HEADING = r"(?dmU)^(#{1,6})\s+(.+)$"
SENTENCE = r"(?U)(?<=[。！？.!?])\s*"
_NONE = "array<string>"


def empty() -> Column:
    return F.array().cast(_NONE)


def by_chars(text: Column, most: int) -> Column:
    """Windows of `most` characters that overlap by a tenth, at most 100."""
    step = most - min(100, most // 10)
    n = F.length(text)
    k = F.ceil((n - most) / step).cast("int")
    return F.when(n == 0, empty()).when(n <= most, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), k), lambda i: F.substring(text, i * step + 1, F.lit(most))))


#: Items that a fold takes at a time: results are put together once a block, so that no long array is copied a step.
BLOCK = 128


def blocks(items: Column) -> Column:
    """The array cut into blocks."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.slice(F.array(items), 1, 0))


def fold_blocks(items: Column, carried: Column, none: Column, step) -> Column:
    """(done, now) after a fold over the array: step(done, now, item) gives a struct of both, where done begins empty in each block. The
    blocks' done are put together at the end, so the work is in proportion to the items."""
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))

    def block(s: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, state(none, s["now"]), lambda t, x: step(t["done"], t["now"], x))
        return let(inner, lambda r: state(F.concat(s["done"], F.array(r["done"])), r["now"]))

    cut = let(items, blocks)  # else the items would be made anew for each block
    return F.aggregate(cut, state(F.slice(F.array(none), 1, 0), carried), block, lambda s: state(F.flatten(s["done"]), s["now"]))


def _fold(items: Column, step) -> Column:
    """Fold to an array of chunks: step(done, now, item) gives (done, now); a last `now` is a chunk."""
    return let(fold_blocks(items, F.lit(""), empty(), step), lambda s: _flushed(s["done"], s["now"]))


def _pair(done: Column, now: Column) -> Column:
    return F.struct(done.alias("done"), now.alias("now"))


def _flushed(done: Column, now: Column) -> Column:
    return F.when(now != "", F.concat(done, F.array(now))).otherwise(done)


def by_sentences(text: Column, most: int) -> Column:
    """Sentences packed without separator; one that is too long goes to windows."""

    def step(done: Column, now: Column, s: Column) -> Column:
        return (
            F.when(F.length(s) > most, _pair(F.concat(_flushed(done, now), by_chars(s, most)), F.lit("")))
            .when(F.length(now) + F.length(s) > most, _pair(_flushed(done, now), s))
            .otherwise(_pair(done, F.concat(now, s)))
        )

    return let(no_blanks(F.split(text, SENTENCE)), lambda ss: F.when(F.size(ss) == 0, by_chars(text, most)).otherwise(_fold(ss, step)))


def merge_small(chunks: Column, most: int) -> Column:
    """Neighbours joined by a blank line while they fit."""

    def step(done: Column, now: Column, s: Column) -> Column:
        fits = F.length(now) + F.length(s) + 2 <= most
        return F.when(now == "", _pair(done, s)).when(fits, _pair(done, F.concat(now, F.lit("\n\n"), s))).otherwise(_pair(F.concat(done, F.array(now)), s))

    return _fold(chunks, step)


def _pieces(paragraphs: Column, most: int) -> Column:
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(by_sentences(p, most))))


def _paragraphs(text: Column, body) -> Column:
    """body(paragraphs, lines), with each made once."""
    both = F.struct(no_blanks(F.split(text, "\n\n")).alias("strong"), no_blanks(F.split(text, "\n")).alias("weak"))
    return let(both, lambda b: body(b["strong"], b["weak"]))


def ensure_size(text: Column, most: int) -> Column:
    """C4: unchanged if it fits, else paragraphs, else lines, long ones by sentences, small ones merged."""
    parts = _paragraphs(text, lambda strong, weak: F.when((F.size(strong) <= 1) & (F.size(weak) > F.size(strong)), weak).otherwise(strong))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(let(parts, lambda ps: merge_small(_pieces(ps, most), most)))


def split_plain(text: Column, most: int) -> Column:
    """Without headings: a section for each paragraph, or lines merged to max(most // 3, 300), or by size."""

    def cut(strong: Column, weak: Column) -> Column:
        lines = F.when(F.size(weak) > 1, merge_small(_pieces(weak, most), max(most // 3, 300))).otherwise(ensure_size(text, most))
        return F.when(F.size(strong) > 1, _pieces(strong, most)).otherwise(lines)

    return _paragraphs(text, cut)


#: Marks that split_sections puts around headings; where a text has them itself they are escaped meanwhile.
_MARKS = (("\u0004", "\u0004d"), ("\u0001", "\u0004a"), ("\u0002", "\u0004b"), ("\u0003", "\u0004c"))


def _escaped(text: Column) -> Column:
    for mark, other in _MARKS:
        text = F.replace(text, F.lit(mark), F.lit(other))
    return text


def _plain(text: Column) -> Column:
    for mark, other in reversed(_MARKS):
        text = F.replace(text, F.lit(other), F.lit(mark))
    return text


def split_sections(docs: DataFrame, most: int = 1500, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, idx, chunk_id, level, heading_chain, content). A blank document has no sections."""
    def parts(t: Column) -> Column:
        return F.split(F.regexp_replace(_escaped(t), HEADING, "\u0001$1\u0002$2\u0003"), "\u0001")

    def part(p: Column) -> Column:
        head = F.contains(p, F.lit("\u0002"))
        return F.struct(
            F.when(head, F.length(F.substring_index(p, "\u0002", 1))).otherwise(0).alias("level"),
            F.when(head, _plain(strip(F.substring_index(F.substring_index(p, "\u0003", 1), "\u0002", -1)))).otherwise("").alias("title"),
            _plain(strip(F.when(head, F.substring_index(p, "\u0003", -1)).otherwise(p))).alias("body"),
        )

    # The stack of headings before each part
    open_ = "array<struct<level:int,title:string>>"
    done = "array<struct<level:int,chain:array<string>,body:string>>"

    def push(out: Column, stack: Column, p: Column) -> Column:
        stack = F.when(p["level"] == 0, F.array().cast(open_)).otherwise(F.concat(F.filter(stack, lambda h: h["level"] < p["level"]), F.array(F.struct(p["level"].alias("level"), p["title"].alias("title"))).cast(open_)))
        return let(stack, lambda st: _pair(F.concat(out, F.array(F.struct(p["level"].alias("level"), F.transform(st, lambda h: h["title"]).alias("chain"), p["body"].alias("body"))).cast(done)), st))

    section = "array<struct<level:int,heading_chain:array<string>,content:string>>"

    def headed(ps: Column) -> Column:
        chained = fold_blocks(F.transform(ps, part), F.array().cast(open_), F.array().cast(done), push)["done"]
        return F.flatten(F.transform(F.filter(chained, lambda x: x["body"] != ""), lambda x: F.transform(ensure_size(x["body"], most), lambda c: F.struct(x["level"].alias("level"), x["chain"].alias("heading_chain"), c.alias("content")))))

    def plain(t: Column) -> Column:
        return F.transform(split_plain(t, most), lambda c: F.struct(F.lit(0).alias("level"), empty().alias("heading_chain"), c.alias("content")))

    # the text and its parts are made once and then only referred to
    split = lambda t: let(parts(t), lambda ps: F.when(F.size(ps) > 1, headed(ps)).otherwise(plain(t)))
    out = let(strip_images(F.coalesce(content, F.lit(""))), lambda t: F.when(~t.rlike(NOT_BLANK), F.array().cast(section)).otherwise(split(t)))
    # an inner explode would be planned behind a filter that makes the array again
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(out).alias("idx", "s")).where("idx is not null")
    return rows.select("doc_id", "idx", F.concat(F.col("doc_id").cast("string"), F.lit("::sec_"), F.col("idx").cast("string")).alias("chunk_id"), "s.level", "s.heading_chain", "s.content")


def first_sections(sections: DataFrame, n: int) -> DataFrame:
    """The first n sections of each document."""
    return sections.where(F.col("idx") < n)
