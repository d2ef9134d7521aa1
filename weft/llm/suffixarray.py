"""Suffix-array deduplication: which bytes lie in a string of `length` bytes that also starts earlier.

Candidates. Each start belongs to a trigger: the 24-byte gram with the least hash inside its `length` bytes
(leftmost on ties). Equal strings have equal triggers at equal places. Consecutive starts with one trigger
form a phrase, on average about forty starts. Phrases are dealt by trigger, with the hash of their bytes:

1. Of equal phrases the first in (id, start) order stays; the starts of all others are covered.
2. If different phrases share a trigger, each is cut into pieces of at most GAP neighbouring starts, aligned
   to the trigger. All strings of a piece contain one core of length - GAP + 1 bytes, so equal strings
   have equal cores: pieces are dealt by (trigger, place, core), and of equal pieces again only the first stays.
3. Different pieces with one core are written as symbols, the bytes left of the core, one symbol for the
   core, the bytes right of it, and a suffix array is built over them: GAP symbols are one string of
   `length` bytes. Suffixes that agree in GAP symbols stand together; all but the first are covered.

The suffix array is constructed by linear grouping: groups of suffixes are processed in descending order,
previous-smaller pointers split the groups below, until each holds the suffixes of one Lyndon prefix; a second
pass emits the order inside the groups. No recursion, no renaming.

Skew. Equal phrases are merged inside each map task before they are dealt. A trigger with more than CROWD
phrases, or a millionth of all, is dealt by trigger and phrase hash. A core with more than HOT pieces is cut down to single strings, dealt by string.

Nulls, ties and repeats: a null text is empty; a null id sorts first; rows that repeat an id count as
documents of their own, in the order of their texts; an empty table gives an empty result; texts shorter
than `length` bytes keep all bytes; other columns pass through, whatever their names. Hashes are 64 bits within a trigger of
64 bits, over spans of a few hundred bytes, too short for the strings on which such polynomials are known to fail.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import drop, partitions, stage, table

GRAM, GAP, HOT, CROWD, CHUNK = 24, 16, 20_000, 20_000, 4 << 20
BASE, BASE2, MIX = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9
U = np.uint64


def lyndon_suffix_array(s: list[int]) -> list[int]:
    """The suffix array of s, whose last symbol is its only least one."""
    n = len(s)
    sa = sorted(range(n), key=s.__getitem__)
    at = [0] * n  # place in sa
    group = [0] * n  # of a suffix: where its group starts in sa
    size = [0] * n  # by group start
    begin = [0] * n  # by group end: its start
    start, last = 0, None
    for i, p in enumerate(sa):
        at[p] = i
        if s[p] != last:
            if i:
                size[start], begin[i - 1] = i - start, start
            start, last = i, s[p]
        group[p] = start
    size[start], begin[n - 1] = n - start, start
    prev = [-1] * n
    end = n - 1
    while end >= 0:
        g = begin[end]
        # previous-smaller pointers; members in text order, so that a neighbour of the same group is done
        if g == end:
            p = sa[g]
            q = p - 1
            while q >= 0 and group[q] >= g:
                q = prev[q]
            prev[p] = q
            if q >= 0:
                h = group[q]
                e = h + size[h] - 1
                if e > h:
                    i = at[q]
                    r = sa[e]
                    sa[i], at[r], sa[e], at[q] = r, i, q, e
                    group[q] = e
                    size[e] = 1
                    begin[e] = e
                    size[h] = e - h
                    begin[e - 1] = h
        else:
            times: dict[int, int] = {}
            for p in sorted(sa[g : end + 1]):
                q = p - 1
                while q >= 0 and group[q] >= g:
                    q = prev[q]
                prev[p] = q
                if q >= 0:
                    times[q] = times.get(q, 0) + 1
            by: dict[int, list[int]] = {}
            for q, k in times.items():
                by.setdefault(k, []).append(q)
            for k in sorted(by, reverse=True):  # the more often reached, the larger
                moved: dict[int, int] = {}
                for q in by[k]:
                    h = group[q]
                    m = moved.get(h, 0)
                    e = h + size[h] - 1 - m
                    i = at[q]
                    r = sa[e]
                    sa[i], at[r], sa[e], at[q] = r, i, q, e
                    moved[h] = m + 1
                for h, m in moved.items():
                    left = size[h] - m
                    if left:
                        new = h + left
                        size[h], size[new] = left, m
                        begin[new - 1], begin[new + m - 1] = h, new
                        for q in sa[new : new + m]:
                            group[q] = new
        end = g - 1
    out, fill, placed = [0] * n, list(range(n)), [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[fill[g]] = j
            fill[g] += 1
            placed[j] = True
            j = prev[j]
    return out


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(U(1), np.full(max(0, n - 1), U(base))), dtype=np.uint64)[:n]


class Spans:
    """Hashes of byte ranges of a buffer, the same for the same bytes anywhere."""

    def __init__(self, buf: np.ndarray):
        with np.errstate(over="ignore"):
            self.sum = np.append(U(0), np.cumsum((buf.astype(np.uint64) + U(1)) * powers(BASE2, len(buf)), dtype=np.uint64))
            self.back = powers(pow(BASE2, -1, 1 << 64), len(buf) + 1)

    def of(self, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sum[e] - self.sum[a]) * self.back[a]
            h = (h ^ (h >> U(31)) ^ (e - a).astype(np.uint64)) * U(MIX)
            return (h ^ (h >> U(29))).view(np.int64)


def phrases(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, trigger place, trigger) of each phrase of the texts buf[starts:ends]; places are in buf, of under 2^24 bytes."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none
    with np.errstate(over="ignore"):
        b = (buf.astype(np.uint64) + U(1)) * U(0xD6E8FEB86659FD93)
        p = [U(pow(BASE, n, 1 << 64)) for n in (1, 2, 4, 8)]
        h8 = b
        for n, k in zip((1, 2, 4), p, strict=False):
            h8 = h8[:-n] * k + h8[n:]
        h = h8[:-16] * U(pow(BASE, 16, 1 << 64)) + h8[8:-8] * p[3] + h8[16:]
        h = (h ^ (h >> U(29))) * U(MIX)
        h ^= h >> U(32)
    width = length - GRAM + 1
    least = (h & U(0xFFFFFFFFFF << 24)) | np.arange(len(h), dtype=np.uint64)
    w = 1
    while w * 2 <= width:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if w < width:
        least = np.minimum(least[: len(least) - (width - w)], least[width - w :])
    place = (least & U((1 << 24) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(place)]
    ok = np.flatnonzero(np.arange(len(place)) + length <= ends[text])
    if not len(ok):
        return none, none, none, none, none
    text, place = text[ok], place[ok]
    new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (place[1:] != place[:-1])))
    last = np.append(new[1:], len(ok)) - 1
    return text[new], ok[new], ok[last], place[new], h[place[new]].view(np.int64)


#: Rows of candidates. kind 0: starts a to e of a document are covered; kind 1: they are a phrase.
#: at holds a, e - a and p - a (the trigger's place) in one number, a * 2^16 + (e - a) * 2^8 + (p - a): a phrase has at most 77 starts.
PHRASE = pa.schema([("kind", pa.int8()), ("t", pa.int64()), ("c", pa.int64()), ("id", pa.int64()), ("copy", pa.int32()), ("at", pa.int64()), ("many", pa.bool_())])
PHRASE_DDL = "kind byte, t long, c long, id long, copy int, at long, many boolean"


def chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, list]]:
    """Buffers of a few MB with their texts (id, copy, offset, size); a long text is cut so that each start is in one buffer."""
    bufs, at, size = [], [], 0
    for batch in batches:
        for i, k, t in zip(batch.column("id").to_pylist(), batch.column("copy").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = (t or "").encode()
            for lo in range(0, max(1, len(raw) - length + 1), CHUNK):
                part = raw[lo : lo + CHUNK + length - 1]
                bufs.append(part)
                at.append((i, k, lo, len(part)))
                size += len(part)
                if size >= CHUNK:
                    yield np.frombuffer(b"".join(bufs), np.uint8), at
                    bufs, at, size = [], [], 0
    if at:
        yield np.frombuffer(b"".join(bufs), np.uint8), at


def firsts(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A sorting by keys, then order; and which of the sorted rows are the first of their keys."""
    o = np.lexsort([*reversed(order), *reversed(keys)])
    new = np.ones(len(o), bool)
    if len(o):
        new[1:] = np.logical_or.reduce([k[o][1:] != k[o][:-1] for k in keys])
    return o, new


def find_phrases(docs: DataFrame, length: int) -> DataFrame:
    """kind 0 and 1 rows from docs(id, copy, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            t, c, i, k, at = (np.concatenate(x) for x in zip(*held, strict=True))
            o, new = firsts([t, c], [i, k, at])
            ts, new_t = t[o], np.append(True, t[o][1:] != t[o][:-1])
            often = np.bincount(np.cumsum(new_t) - 1)[np.cumsum(new_t) - 1] >= 8
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((new.astype(np.int8), ts, c[o], i[o], k[o].astype(np.int32), at[o], often), PHRASE, strict=True)], schema=PHRASE)

        for buf, at in chunks(batches, length):
            sizes = np.array([x[3] for x in at], np.int64)
            ends = np.cumsum(sizes)
            text, a, e, p, t = phrases(buf, ends - sizes, ends, length)
            if len(text):
                move = (np.array([x[2] for x in at], np.int64) - (ends - sizes))[text]
                c = Spans(buf).of(a, e + length)
                held.append((t, c, np.array([x[0] for x in at], np.int64)[text], np.array([x[1] for x in at], np.int64)[text], ((a + move) << 16) | ((e - a) << 8) | (p - a)))
                n += len(text)
                if n > 1_500_000:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return docs.select("id", "copy", "text").mapInArrow(run, PHRASE_DDL)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by keys, of about `most` rows; a larger group makes a larger table."""
    rest: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        rest.append(batch)
        n += batch.num_rows
        if n >= most:
            got = pa.Table.from_batches(rest)
            ks = [got.column(k).to_numpy() for k in keys]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in ks])) + 1
            if len(new):
                cut = int(new[-1])
                yield got.slice(0, cut)
                rest, n = got.slice(cut).combine_chunks().to_batches(), got.num_rows - cut
    if n:
        yield pa.Table.from_batches(rest)


COVER_DDL = "id long, copy int, a long, e long"


def merge_phrases(found: DataFrame) -> DataFrame:
    """Step 1: kind 0 rows, covered; kind 2 rows, first phrases whose trigger has others."""
    rows = found.where("kind = 1").drop("kind")
    # triggers with more than CROWD phrases, or a millionth of all, are dealt by phrase; a million triggers at most, so they are broadcast
    least = max(CROWD, rows.count() // 1_000_000)
    hot = stage(rows.where("many").groupBy("t").count().where(F.col("count") > least).select("t", F.lit(True).alias("hot")), "hot")
    rows = rows.join(F.broadcast(hot), "t", "left").select("t", "c", "id", "copy", "at", F.when(F.col("hot"), F.col("c")).otherwise(0).alias("s"))
    dealt = rows.repartition(partitions(found.sparkSession), "t", "s").sortWithinPartitions("t", "c", "id", "copy", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["t"], 50_000):
            t, c, s = (g.column(x).to_numpy() for x in ("t", "c", "s"))
            new_t = np.append(True, t[1:] != t[:-1])
            new = new_t | np.append(True, c[1:] != c[:-1])
            of = np.cumsum(new_t) - 1
            shared = (np.bincount(of, new)[of] > 1) | (s != 0)
            kind = np.where(~new, 0, np.where(shared, 2, 1)).astype(np.int8)
            keep = kind != 1
            yield pa.RecordBatch.from_arrays([pa.array(kind[keep]), *(g.column(x).filter(pa.array(keep)).combine_chunks() for x in ("t", "id", "copy", "at"))], names=["kind", "t", "id", "copy", "at"])

    return dealt.mapInArrow(run, "kind byte, t long, id long, copy int, at long")


PIECE_DDL = "t long, place int, core long, c long, id long, copy int, a long, left binary, right binary"


def cut_pieces(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Step 2: the pieces of wanted phrases. A piece: its first start a, the bytes left and right of its core."""
    lists = wanted.groupBy("id", "copy").agg(F.collect_list(F.struct("t", "at")).alias("ps"))
    rows = docs.join(lists, ["id", "copy"]).select("id", "copy", "text", "ps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b0 in range(0, batch.num_rows, 64):
                part = batch.slice(b0, 64)
                out: list[tuple] = []
                for i, k, text, ps in zip(part.column("id").to_pylist(), part.column("copy").to_pylist(), part.column("text").to_pylist(), part.column("ps"), strict=True):
                    raw = text.encode()
                    buf = np.frombuffer(raw, np.uint8)
                    t, at = (ps.values.field(x).to_numpy() for x in ("t", "at"))
                    a = at >> 16
                    e, p = a + (at >> 8 & 255), a + (at & 255)
                    first, last = (p - e) // GAP, (p - a) // GAP  # places of the trigger in its strings
                    n = last - first + 1
                    of = np.repeat(np.arange(len(t)), n)
                    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
                    high, low = p[of] - place * GAP, p[of] - place * GAP - GAP + 1  # starts of a whole piece
                    lo, hi = np.maximum(a[of], low), np.minimum(e[of], high)
                    spans = Spans(buf)
                    core_end = low + length
                    left = [raw[x:y] for x, y in zip(lo.tolist(), high.tolist(), strict=True)]
                    right = [raw[x:y] for x, y in zip(core_end.tolist(), (hi + length).tolist(), strict=True)]
                    out.append((t[of], place, spans.of(high, core_end), spans.of(lo, hi + length), np.full(len(of), i), np.full(len(of), k), lo, left, right))
                if out:
                    cols = list(zip(*out, strict=True))
                    arrays = [pa.array(np.concatenate(x), ty) for x, ty in zip(cols[:7], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([v for vs in x for v in vs], pa.binary()) for x in cols[7:])], names=[x.split()[0] for x in PIECE_DDL.split(", ")])

    return rows.mapInArrow(run, PIECE_DDL)


def match_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """Step 3: covered starts among pieces."""
    key = ["t", "place", "core"]
    n = partitions(pieces.sparkSession)
    crowded = stage(pieces.groupBy(*key).count().where(F.col("count") > HOT).select(*key), "crowded")
    hot = None if crowded.isEmpty() else pieces.join(crowded, key, "left_semi")
    cold = pieces if hot is None else pieces.join(crowded, key, "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, [*key, "one"], 20_000):
            ks = [g.column(x).to_numpy() for x in (*key, "one")]
            c, i, k, a = (g.column(x).to_numpy() for x in ("c", "id", "copy", "a"))
            new_key = np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in ks]))
            new = new_key | np.append(True, c[1:] != c[:-1])
            of = np.cumsum(new_key) - 1
            # equal pieces: all starts of all but the first are covered
            starts = np.array(pc.add(pc.binary_length(g.column("left")), pc.binary_length(g.column("right")))) - GAP + 1
            yield pa.RecordBatch.from_arrays([pa.array(i[~new]), pa.array(k[~new]), pa.array(a[~new]), pa.array((a + starts)[~new])], names=["id", "copy", "a", "e"])
            several = g.filter(pa.array(new & (np.bincount(of, new)[of] > 1)))
            rest = several.to_batches()
            for part in sorted_groups(iter(rest), [*key, "one"], 3000):
                yield covered(part)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.select(*key, "one", "c", "id", "copy", "a", "left", "right").repartition(n, *key, "one").sortWithinPartitions(*key, "one", "c", "id", "copy", "a").mapInArrow(run, COVER_DDL)

    out = dealt(cold.withColumn("one", F.lit(0).cast("long")))
    if hot is None:
        return out
    # a crowded core: equal pieces merge before they are dealt, then single strings are dealt by themselves
    extent = F.octet_length("left") + F.octet_length("right") - (GAP - 1)
    first = stage(hot.groupBy(*key, "c").agg(F.min(F.struct("id", "copy", "a", "left", "right")).alias("x")), "crowded")
    same = hot.join(first.select(*key, "c", F.col("x.id").alias("oi"), F.col("x.copy").alias("ok"), F.col("x.a").alias("oa")), [*key, "c"]).where("not (id = oi and copy = ok and a = oa)").select("id", "copy", "a", (F.col("a") + extent).alias("e"))
    single = first.select(*key, "c", "x.*").withColumn("k", F.explode(F.sequence(F.lit(0), extent)))
    single = single.select(*key, (F.col("a") + F.col("k")).alias("a"), "id", "copy", F.expr("substring(left, k + 1, octet_length(left))").alias("left"), F.expr(f"substring(right, 1, {GAP - 1} - greatest(octet_length(left) - k, 0))").alias("right"))
    single = single.withColumn("one", F.xxhash64("left", "right")).withColumn("c", F.col("one"))
    return out.unionByName(same).unionByName(dealt(single))


def covered(g: pa.Table) -> pa.RecordBatch:
    """Starts that are not the first of their string, from whole groups of pieces, by one suffix array over all of them."""
    ks = [g.column(x).to_numpy() for x in ("t", "place", "core", "one")]
    of = np.cumsum(np.append(False, np.logical_or.reduce([k[1:] != k[:-1] for k in ks]))).tolist()
    symbols: list[int] = []
    first: list[int] = []
    for x, left, right in zip(of, g.column("left").to_pylist(), g.column("right").to_pylist(), strict=True):
        first.append(len(symbols))
        symbols += [b + 2 for b in left]
        symbols.append(258 + x)
        symbols += [b + 2 for b in right]
        symbols.append(1)
    n = len(symbols)
    symbols.append(0)
    sa = np.array(lyndon_suffix_array(symbols), np.int64)
    begin = np.array(first, np.int64)
    size = np.diff(np.append(begin, n)) - 1
    starts = size - GAP + 1
    row = np.repeat(np.arange(len(begin)), size + 1)
    row = np.append(row, -1)
    off = np.arange(n + 1) - np.append(begin[row[:-1]], n)
    ok = sa[(row[sa] >= 0) & (off[sa] < starts[row[sa]])]
    s = np.array(symbols, np.int64)
    strings = s[ok[:, None] + np.arange(GAP)] if len(ok) else np.zeros((0, GAP), np.int64)
    new = np.append(True, (strings[1:] != strings[:-1]).any(1))[: len(ok)]
    cls = np.cumsum(new) - 1
    i, k, a = g.column("id").to_numpy()[row[ok]], g.column("copy").to_numpy()[row[ok]], g.column("a").to_numpy()[row[ok]] + off[ok]
    o = np.lexsort([a, k, i, cls])
    rest = o[np.append(False, cls[o][1:] == cls[o][:-1])[: len(o)]]
    return pa.RecordBatch.from_arrays([pa.array(i[rest], pa.int64()), pa.array(k[rest], pa.int32()), pa.array(a[rest], pa.int64()), pa.array(a[rest], pa.int64())], names=["id", "copy", "a", "e"])


def identified(docs: DataFrame) -> DataFrame:
    """id (never null), copy, which numbers rows of one id in the order of their texts, text (never null), and docs' own columns as g0, g1 and so on."""
    at = docs.columns.index
    d = docs.toDF(*[f"g{i}" for i in range(len(docs.columns))])
    d = d.withColumns({"id": F.coalesce(F.col(f"g{at('doc_id')}").cast("long"), F.lit(-(1 << 63))), "text": F.coalesce(F.col(f"g{at('text')}"), F.lit(""))})
    if d.groupBy("id").count().where("count > 1").isEmpty():
        return d.withColumn("copy", F.lit(0))
    return d.withColumn("copy", F.row_number().over(W.partitionBy("id").orderBy("text")) - 1)


def dedup(docs: DataFrame, length: int = 100, kept_text: bool = False) -> DataFrame:
    """docs' doc_id with n_bytes, n_removed, n_spans, kept_sha256; with kept_text, all columns of docs, whatever their names, and text
    replaced by what is left.

    A kept text that removal cuts inside a character loses that character's remaining bytes; its digest is of all remaining bytes.
    """
    given, schema = docs.columns, docs.schema
    docs = identified(docs)
    own = [f"g{i}" for i in range(len(given))] if kept_text else [f"g{given.index('doc_id')}"]
    keys = docs.select("id", "copy", "text")
    found = stage(find_phrases(keys, length), "phrases")
    merged = stage(merge_phrases(found).unionByName(found.where("kind = 0").select("kind", "t", "id", "copy", "at")), "shared")
    drop(found)
    pieces = stage(cut_pieces(keys, merged.where("kind = 2"), length), "pieces")
    matched = stage(match_pieces(pieces, length), "matched")
    drop(pieces)
    a = F.shiftright("at", 16)
    covers = merged.where("kind = 0").select("id", "copy", a.alias("a"), (a + F.shiftright("at", 8).bitwiseAND(F.lit(255))).alias("e")).unionByName(matched)
    lists = covers.groupBy("id", "copy").agg(F.collect_list(F.struct("a", "e")).alias("cs"))
    rows = docs.join(lists, ["id", "copy"], "left").select(*own, "text", "cs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for text, cs in zip(batch.column("text").to_pylist(), batch.column("cs"), strict=True):
                raw = text.encode()
                if not cs.is_valid or not len(cs.values):
                    done.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), text))
                    continue
                a, e = cs.values.field("a").to_numpy(), cs.values.field("e").to_numpy() + length
                o = np.argsort(a, kind="stable")
                a, e = a[o], np.maximum.accumulate(e[o])
                new = np.append(True, a[1:] > e[:-1])
                lo, hi = a[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]
                left = b"".join(raw[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True))
                done.append((len(raw), int((hi - lo).sum()), len(lo), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            n, removed, spans, sha, left = zip(*done, strict=True) if done else ((),) * 5
            if kept_text:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()) if f == "text" else batch.column(g) for f, g in zip(given, own, strict=True)], names=given)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(own[0]), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, schema if kept_text else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
