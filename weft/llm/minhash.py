"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set holds its distinct five-word shingles (64-bit hashes); its signature has 64 coordinates of 64 bits,
each the least of a hash function of its own over the set. Documents are posted under each (coordinate, value); as the
functions differ, the value alone is the key.

* Equal sets are one class; a class is its smallest id. Values that only one class has are never met again.
* Prefix: two signatures that agree in at least MATCH of 64 coordinates agree in one of the 64 - MATCH + 1
  rarest of each, so only those are posted. At a likeness of 0.75, 48 coordinates agree on average;
  fewer than MATCH = 32 do for about 6 pairs in a million.
* Hubs: each posting list joins its members to its smallest one, long lists also to two more that a hash picks, the same
  in all lists of a group. Pairs come out once, with the lists that they share counted, and skip the rest of the merge: the
  coordinates beyond the prefix are counted from the two signatures. Pairs that reach MATCH are confirmed on the full
  sets, and links join components.
* The rest: lists that still hold several components are put together by the component that has most of their members.
  Of such a group, the members outside that component meet all others, block against block in one task each: collisions
  are counted, pairs that reach MATCH are confirmed on the full sets, and a block yields a link only where it joins two
  components, so it returns fewer rows than it has members. No list is cut short.

So within a component not every link is listed, but no link between components is lost. Joins on lists and
hubs are sort-merge joins between plain exchanges, which adaptive execution splits where one key is hot.

Nulls, ties and repeats: without words, or with a null text, a set is empty and linked with nothing; with fewer than
five words the whole sequence is the one shingle; rows that share an id and have words are one vertex; a null id is linked
with nothing, its component is null and it is kept; an empty table gives an empty result. Other columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop, stage, table

K, MATCH, SHINGLE, THRESHOLD = 64, 32, 5, 75
#: Members from which a list gets three hubs; shingles in a block of the rest (a signature counts as K).
LONG, BLOCK = 8, 1 << 16
U = np.uint64
_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_C = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * U(2) + U(1)


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_words = _Words()


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the sorted distinct hashes of the shingles of text i are values[offsets[i] : offsets[i + 1]].

    bytes.lower and bytes.split know just A-Z and the six ASCII white spaces.
    """
    words = [(t or b"").lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
    at, made = 0, []
    with np.errstate(over="ignore"):
        s = np.zeros(0, np.uint64)
        if len(h) >= SHINGLE:
            s = h[: len(h) - SHINGLE + 1] * _C[0]
            for i in range(1, SHINGLE):
                s = s + h[i : len(h) - SHINGLE + 1 + i] * _C[i]
            s = mixed(s)
        for m in n.tolist():
            if m >= SHINGLE:
                x = np.sort(s[at : at + m - SHINGLE + 1])
                made.append(x[np.append(True, x[1:] != x[:-1])])
            elif m:  # the length takes part, so that it differs from any shingle of five
                made.append(mixed(np.array([(h[at : at + m] * _C[:m]).sum(dtype=np.uint64) + U(m)], np.uint64)))
            else:
                made.append(s[:0])
            at += m
    return np.concatenate([s[:0], *made]), np.append(0, np.cumsum(np.fromiter(map(len, made), np.int64, len(made))))


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of K coordinates for each set; an empty set has the largest value everywhere."""
    out = np.full((len(offsets) - 1, K), 0xFFFFFFFFFFFFFFFF, np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(some):  # as many sets as stay in the processor's cache
            hi = max(lo + 1, int(np.searchsorted(offsets[some], offsets[some[lo]] + 16384)))
            rows = some[lo:hi]
            starts, end = offsets[rows], offsets[rows[-1] + 1]
            s = values[starts[0] : end]
            for k in range(K):
                out[rows, k] = np.minimum.reduceat(s * _A[k] + _B[k], starts - starts[0])
            lo = hi
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def to_list(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, K, dtype=np.int32), pa.array(rows.reshape(-1).view(np.int64)))


def from_list(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(U).reshape(-1, K)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sh, sig) of docs(doc_id, text): size and digest of the set, and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, at = shingles(batch.column("text").cast(pa.binary()).to_pylist())
            sh = [xxhash.xxh3_128_digest(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(sh, pa.binary()), to_list(signatures(values, at))], names=["doc_id", "n", "sh", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, sh binary, sig array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, n, sig, items): the full set of each class in wanted(rep, sh, sig), as sorted 64-bit hashes."""
    found = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.hint("merge"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, at = shingles(batch.column("text").cast(pa.binary()).to_pylist())
            items = [values[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            # an id may have rows of other sets
            own = [xxhash.xxh3_128_digest(x) == sh for x, sh in zip(items, batch.column("sh").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(np.diff(at)), batch.column("sig"), pa.array(items, pa.binary())], names=["rep", "n", "sig", "items"]).filter(pa.array(own, pa.bool_()))

    return found.mapInArrow(run, "rep long, n long, sig array<long>, items binary")


def confirmed(pairs: DataFrame, sets: DataFrame, match: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least `match` coordinates and whose full sets reach the threshold (in hundredths)."""
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("items").alias("tb")).hint("merge"), "b").join(sets.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("items").alias("ta")).hint("merge"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = (from_list(batch.column("sa")) == from_list(batch.column("sb"))).sum(1) >= match
            for i in np.flatnonzero(keep).tolist():
                x, y = (np.frombuffer(batch.column(t)[i].as_buffer(), U) for t in ("ta", "tb"))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * shared >= threshold * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "sa", "sb", "ta", "tb").mapInArrow(run, "a long, b long")


def joining_links(c: np.ndarray, new: np.ndarray, old: np.ndarray, rep: np.ndarray, sig: np.ndarray, items: list[np.ndarray], match: int, threshold: int) -> list[tuple[int, int]]:
    """Links between places `new` and places `old` that join components c, as pairs of rep."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while x in top:
            x = top[x]
        return x

    size, out = np.fromiter(map(len, items), np.int64, len(items)), []
    for i in new.tolist():
        other = old[(c[old] != c[i]) & (100 * np.minimum(size[old], size[i]) >= threshold * np.maximum(size[old], size[i]))]
        if len(other):
            other = other[(sig[other] == sig[i]).sum(1) >= match]
        if not len(other):
            continue
        # count in the merged sets of all others
        every, x = np.concatenate([items[j] for j in other]), items[i]
        hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
        shared = np.add.reduceat(hit, np.append(0, np.cumsum(size[other])[:-1]), dtype=np.int64)
        for j in other[100 * shared >= threshold * (size[other] + size[i] - shared)].tolist():
            a, b = find(int(c[i])), find(int(c[j]))
            if a != b:
                top[max(a, b)] = min(a, b)
                out.append((int(rep[i]), int(rep[j])))
    return out


def rest_links(lists: DataFrame, comps: DataFrame, sets: DataFrame, match: int, threshold: int) -> DataFrame:
    """Links (a, b) that join components, out of the lists that still hold several. comps(rep, c) names the vertices with links."""
    placed = stage(lists.select("key", "rep", "n").join(comps.hint("merge"), "rep", "left").select("key", "rep", "n", F.coalesce("c", "rep").alias("c")), "placed")
    several = placed.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", -F.col("c"))).alias("g"), F.count("*").alias("k")).where("k > 1")
    groups = stage(placed.join(stage(several.select("key", "g"), "several").hint("merge"), "key").select("g", "rep", "n", "c").distinct().withColumn("out", F.col("c") != F.col("g")), "groups")
    drop(placed)
    # blocks 0 to few - 1 hold the members outside, few to few + main - 1 those of the component itself; cell (i, j) has i < few and i <= j
    weight = lambda members: F.ceil(F.sum(F.when(members, F.col("n") + K).otherwise(0)) / BLOCK).cast("int")
    blocks = groups.groupBy("g").agg(weight(F.col("out")).alias("few"), weight(~F.col("out")).alias("main"))
    own = F.col("block")
    above = F.transform(F.sequence(own, F.col("few") + F.col("main") - 1), lambda j: F.struct(own.alias("i"), j.alias("j")))
    below = F.transform(F.sequence(F.lit(0), F.least(own, F.col("few") - 1)), lambda i: F.struct(i.alias("i"), own.alias("j")))
    grid = F.when(F.col("out"), F.array_union(above, below)).otherwise(below)
    dealt = groups.join(stage(blocks, "blocks").hint("merge"), "g").withColumn("block", F.when(F.col("out"), F.pmod(F.xxhash64("rep"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("rep"), F.col("main"))).cast("int"))
    met = dealt.join(sets.select("rep", "sig", "items").hint("merge"), "rep").select("g", "rep", "c", "block", F.explode(grid).alias("p"), "sig", "items").select("g", "p.i", "p.j", "rep", "c", "block", "sig", "items")

    def merge(rows: list[tuple]) -> list[tuple[int, int]]:
        i, j = rows[0][1:3]
        rep, c, block = np.array([r[3:6] for r in rows], np.int64).T
        return joining_links(c, np.flatnonzero(block == i), np.flatnonzero(block == j), rep, np.array([r[6] for r in rows]), [np.frombuffer(r[7], U) for r in rows], match, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in slices(batches):
            out = []
            plain = (batch.column(x).to_pylist() for x in ("g", "i", "j", "rep", "c", "block"))
            for row in zip(*plain, from_list(batch.column("sig")), batch.column("items").to_pylist(), strict=True):
                if rows and rows[0][:3] != row[:3]:
                    out += merge(rows)
                    rows = []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if rows:
            out = merge(rows)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return met.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, match: int = MATCH) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    wide = stage(signed(docs), "signed")
    classes = stage(wide.where("n > 0 and doc_id is not null").groupBy("sh").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    rows = stage(wide.drop("sig"), "rows")
    drop(wide)
    some = rows.where("n > 0 and doc_id is not null")

    posts = classes.select("rep", "sh", "n", F.explode("sig").alias("key"))
    often = posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    held = posts.join(often.hint("merge"), "key").groupBy("sh").agg(F.first("rep").alias("rep"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "key"))).alias("posts"))
    # values of its own come first in a class's order by rarity, so of its m shared ones m - match + 1 are in the prefix
    held = held.where(F.size("posts") >= match).select("sh", "rep", "n", F.explode(F.slice("posts", F.lit(1), F.size("posts") - match + 1)).alias("p"))
    lists = stage(held.select("sh", "rep", "n", F.col("p.key").alias("key")), "lists")
    sets = stage(full_sets(docs, lists.select("rep", "sh").distinct().join(classes.select("sh", "sig").hint("merge"), "sh")), "sets")
    named = stage(classes.select("sh", "rep"), "named")
    drop(classes)

    picked = lambda turn: F.min_by(F.struct("rep", "n"), F.struct(F.xxhash64("rep", F.lit(turn)), "rep"))
    hubs = lists.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("rep", "n")).alias("x"), picked(1).alias("y"), picked(2).alias("z")).where("m > 1")
    hubs = stage(hubs.select("key", F.when(F.col("m") >= LONG, F.array("x", "y", "z")).otherwise(F.array("x")).alias("hubs")), "hubs")
    alike = lambda x, y: 100 * F.least(x, y) >= threshold * F.greatest(x, y)
    pairs = lists.join(hubs.hint("merge"), "key").select("rep", "n", F.explode("hubs").alias("h")).where(F.col("h.rep") != F.col("rep")).where(alike(F.col("n"), F.col("h.n")))
    pairs = stage(pairs.groupBy(F.col("h.rep").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("collisions")), "pairs")

    # an id with several sets joins their classes
    h = F.xxhash64("sh")
    twice = some.groupBy("doc_id").agg(F.min(h).alias("x"), F.max(h).alias("y")).where("x <> y").select("doc_id")
    reps = some.select("doc_id", "sh").join(twice, "doc_id").join(named, "sh")
    several = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("rs")).select("a", F.explode("rs").alias("b"))

    links = stage(confirmed(pairs.select("a", "b"), sets, match, threshold).unionByName(several), "links")
    comps = components(links)
    more = stage(rest_links(lists, comps.toDF("rep", "c"), sets, match, threshold), "links")
    comps = components(links.unionByName(more))
    for done in (lists, sets, hubs, pairs):
        drop(done)
    of = stage(named.join(comps.toDF("rep", "c").hint("merge"), "rep", "left").select("sh", F.coalesce("c", "rep").alias("c")), "components")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "sh").join(of.hint("merge"), "sh", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
