"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: character 1- to 3-grams of the lower-cased text, hashed to 2^15 places; what is no
  letter counts as a space. A weight is (1 + log count) * idf, the vector has length 1.
* Document frequencies come from all documents that may be learned from.
* Weights come from a bounded sample, at most `per_language` documents of each language, taken by
  id hash: follow-the-regularised-leader with elastic-net penalties (l1 keeps them sparse), on the driver.
* A fifth of the sample is not learned from; on it one temperature is fitted by likelihood.

Nulls and ties: a text that is null or has no letter is `und` with score 0.0; so is every text if nothing
can be learned. Rows with a null language teach nothing. Equal logits go to the smaller language name.
Rows that repeat an id are predicted each for itself; an empty table gives an empty result. Other columns pass through; such as bear
the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fold, least_hashes, table

SIZE = 1 << 15
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point: is it a letter?"""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(places, counts), or None without a letter. Whole texts, in pieces that overlap by two characters."""
    if not text:
        return None
    total, seen, is_letter = np.zeros(SIZE, np.int64), False, letters()
    step = 1 << 20
    for at in range(0, len(text), step):
        piece = text[max(0, at - 2) : at + step].lower()
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = is_letter[c]
        seen = seen or bool(ok.any())
        c = np.where(ok, c, np.uint32(32))
        with np.errstate(over="ignore"):
            two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77) + np.uint32(1)
            three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F) + np.uint32(2)
            h = np.concatenate([c, two, three]) * np.uint32(0x9E3779B1)
        total += np.bincount(h >> np.uint32(17), minlength=SIZE)
    if not seen:
        return None
    at = np.flatnonzero(total)
    return at, total[at]


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf.astype(np.float32), weights.astype(np.float32), bias, temperature

    def vector(self, f: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, n = f
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, f: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, x = self.vector(f)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        f = features(text) if self.langs else None
        if f is None:
            return "und", 0.0
        z = self.logits(f) / self.temperature
        p = np.exp(z - z.max())
        i = int(np.argmax(p))
        return self.langs[i], float(p[i] / p.sum())


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> Model:
    """FTRL-proximal over rows (language, places, counts), in the given order; every fifth row calibrates."""
    langs = sorted({r[0] for r in rows})
    k = len(langs)
    model = Model(langs, idf, np.zeros((SIZE, k)), np.zeros(k))
    if k == 0:
        return model
    of = {x: i for i, x in enumerate(langs)}
    held = rows[4::5] if len(rows) >= 20 else rows
    learn = [r for i, r in enumerate(rows) if i % 5 != 4] if len(rows) >= 20 else rows
    # the last place is the bias
    z, n = np.zeros((SIZE + 1, k)), np.zeros((SIZE + 1, k))
    data = [(np.append(at, SIZE), np.append(x, 1.0), of[lang]) for lang, *f in learn for at, x in [model.vector(tuple(f))]]

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    for epoch in range(epochs):
        for j in np.random.default_rng(epoch).permutation(len(data)):
            at, x, y = data[j]
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            new = nn + g * g
            z[at] = zz + g - (np.sqrt(new) - np.sqrt(nn)) / alpha * w
            n[at] = new
    w = weights(z, n)
    model.weights, model.bias = w[:SIZE].astype(np.float32), w[SIZE]
    logits = np.array([model.logits((at, c)) for _, at, c in held])
    right = np.array([of[r[0]] for r in held])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), right]))

    model.temperature = float(min(np.geomspace(0.05, 20, 200), key=loss))
    return model


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with a letter, and by place in how many of them it occurs. Each task adds up its own, at most 2^15 numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(SIZE, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                f = features(t)
                if f is not None:
                    n += 1
                    df[f[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["place", "n"])

    got = docs.select("text").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(SIZE, np.int64)
    for r in got:
        if r["place"] >= 0:
            df[r["place"]] = r["n"]
    return next((r["n"] for r in got if r["place"] < 0), 0), df


def train(docs: DataFrame, may_learn: Column | None = None, per_language: int = 600, **options) -> Model:
    """A model from docs(doc_id, text, lang). per_language bounds the sample; counts cover all rows that may be learned from."""
    docs = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() if may_learn is None else F.col("lang").isNotNull() & may_learn)
    n, df = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    ids = least_hashes(docs.select("doc_id", "lang"), "lang", "doc_id", per_language).select("doc_id").distinct()

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([None if f is None else f[0].astype("<i4").tobytes() for f in fs], pa.binary()), pa.array([None if f is None else f[1].astype("<i4").tobytes() for f in fs], pa.binary())], names=["doc_id", "lang", "at", "n"])

    # the ids are at most per_language for each language; rows that repeat an id and a language count once, by their least text
    chosen = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sample = chosen.mapInArrow(featured, "doc_id long, lang string, at binary, n binary").where("at is not null")
    rows = sorted(sample.withColumn("h", F.xxhash64("doc_id")).collect(), key=lambda r: (r["h"], r["doc_id"], r["lang"], bytes(r["at"]), bytes(r["n"])))
    return fit([(r["lang"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in rows], idf, **options)


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score, under `names`; columns of docs that bear these are replaced. The model is of fixed
    size: 2^15 places for each language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text)
    kept = [f for f in docs.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.predict(t) for t in batch.column(where).to_pylist()]
            cols = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*[f.name for f in kept], *names])

    fields = [StructField(f.name, f.dataType) for f in kept]
    return docs.mapInArrow(run, StructType([*fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, fold("doc_id", 5) != 0)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
