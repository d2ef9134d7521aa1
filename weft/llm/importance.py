"""Target-distribution importance resampling: documents drawn by the likeness of their n-grams to those of a target.

* Words are runs of letters, digits and characters beyond ASCII, of the text with A-Z in lower case. Whatever stands between them is
  collapsed to one space; a regular expression with look-arounds at the word ends then scans that text with overlapped=True, so that each
  match is the span of an n-gram, and its bytes are counted under their crc32.
* One scan of the texts writes each document's buckets; counts, weights and draws are made from these. The counts cover all documents
  and all target texts; `buckets` of them exist, whatever the input.
* A document's weight is the floored mean of its buckets' gains, log ratios in thousandths. Gumbel noise out of the id's hash is added
  and the highest scores are drawn, which is sampling without replacement in proportion to exp(weight / 1000).

Nulls, ties and empty input: a null or empty text has no features, weight 0, and is never drawn unless least_words is 0. A null id hashes
as the empty text and comes behind all others of its score. Rows that repeat an id are documents of their own with the same noise.
Texts of any length are scanned match by match. Empty tables give empty results; without a target all of it is smoothing. Of
other columns `sampled` passes all through, whatever their names; `scored` reads none.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, fresh, numbered, stage, table

#: Each byte in lower case, or a space where it is no part of a word: ASCII but for letters and digits.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SPACES = regex.compile(rb"  +")
#: Words whose bucket a worker remembers.
REMEMBERED = 1 << 20


def collapsed(text: str | None) -> bytes:
    """The words, one space between them."""
    return _SPACES.sub(b" ", (text or "").encode("utf-8", "surrogatepass").translate(LOWER)).strip(b" ")


def pattern(n: int) -> regex.Pattern:
    """Runs of n words, from one word end to another."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def spans(words: bytes, n: int) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of n words in a collapsed text."""
    return (m.span() for m in pattern(n).finditer(words, overlapped=True))


def buckets_of(words: bytes, patterns: list[regex.Pattern], buckets: int, known: dict[bytes, int]) -> np.ndarray:
    """The bucket of each n-gram of a collapsed text, repeats counted."""
    out = []
    for p in patterns:
        for m in p.finditer(words, overlapped=True):
            gram = m.group()
            b = known.get(gram)
            if b is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                b = known[gram] = zlib.crc32(gram) % buckets
            out.append(b)
    return np.array(out, "<u4")


def hashed(docs: DataFrame, n: int, buckets: int, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep columns, n_words, n_features, places): one scan of the texts. places: the features' buckets, sorted, as little-endian words."""
    small = "<u2" if buckets <= 1 << 16 else "<u4"
    at = docs.select(*keep, text)
    where = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, known = [pattern(i) for i in range(1, n + 1)], {}
        for batch in batches:
            n_words, n_features, places = [], [], []
            for t in batch.column(where).to_pylist():
                words = collapsed(t)
                found = buckets_of(words, patterns, buckets, known)
                n_words.append(words.count(b" ") + 1 if words else 0)
                n_features.append(len(found))
                places.append(np.sort(found.astype(small)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:where], pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(places, pa.binary())], names=[*keep, "n_words", "n_features", "places"])

    fields = ", ".join([*[f"`{c}` {at.schema[c].dataType.simpleString()}" for c in keep], "n_words long, n_features long, places binary"])
    return at.mapInArrow(run, fields)


def totals(places: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows by bucket: each task adds up its own, then they meet by bucket; `buckets` numbers come to the driver."""
    small = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                own += np.bincount(np.frombuffer(p, small), minlength=buckets)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at])], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in places.select("places").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket floor(1000 * ln of the ratio of the smoothed shares in target and source)."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1.0) * float(s_all + k) / ((float(s) + 1.0) * float(t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(places: DataFrame, gain: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """(keep columns, n_words, n_features, weight) from hashed rows."""
    small = "<u2" if len(gain) <= 1 << 16 else "<u4"
    shared = places.sparkSession.sparkContext.broadcast(gain)
    cols = [*keep, "n_words", "n_features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            sums = [(int(g[p].sum()), len(p)) for p in (np.frombuffer(b, small) for b in batch.column(len(cols)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array([s // n if n else 0 for s, n in sums], pa.int64())], names=[*cols, "weight"])

    fields = ", ".join([*[f"`{c}` {places.schema[c].dataType.simpleString()}" for c in cols], "weight long"])
    return places.select(*cols, "places").mapInArrow(run, fields)


def noise(doc_id: str, seed: int):
    """floor(1000 * Gumbel noise), out of the first 8 hex digits of sha256 over "seed:id"."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep columns, n_features, weight, score, rank) for each of docs(doc_id, text), against target(text). rank counts the drawn from 1: the
    floor of `percent` hundredths of the documents with `least_words` words, by falling score, then rising id; others have none. `keep` has doc_id."""
    own = stage(hashed(docs, n, buckets, keep=keep), "places")
    gain = gains(totals(own, buckets), totals(hashed(target, n, buckets), buckets))
    cols = [*keep, "n_features", "weight", "score"]
    out = stage(weighed(own, gain, keep).withColumn("score", F.col("weight") + noise("doc_id", seed)).select("n_words", *cols), "scores")
    drop(own)
    able = out.where(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    ranked = numbered(able.select(*cols, F.isnull("doc_id").alias("_last"), (-F.col("score")).alias("_down")), [], ["_down", "_last", *keep])
    return ranked.select(*cols, F.when(F.col("rank") < most, F.col("rank") + 1).alias("rank")).unionByName(out.where(F.col("n_words") < least_words).select(*cols, F.lit(None).cast("long").alias("rank")))


def sampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs(doc_id, text, any other columns) that are drawn; rows are told apart by a number of their own."""
    row = fresh(docs, "_row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    drawn = scored(rows, target, keep=("doc_id", row), **options).where("rank is not null")
    return rows.join(drawn.select(row), row, "left_semi").select(*docs.columns)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
