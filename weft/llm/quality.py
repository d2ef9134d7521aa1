"""Quality by naive-Bayes support vectors: n-gram indicators, scaled by class log-count ratios, in a linear hinge-loss model.

* Indicators: which character 1- to 3-grams a text has, case kept, and which runs of 1 to 6 words have which pattern of repeats (is a
  word equal to the one before it, to the one but one before it?). All are hashed to 2^17 places.
* Log-count ratios come from all labelled documents that may be learned from: how many of each label have the place, smoothed by one.
* A document is its indicators times these ratios, at length 1. The hinge-loss weights are fitted by dual coordinate descent on at most
  `per_class` documents of each label, taken by id hash; the rest of the model grows with nothing but the label counts.
* A fifth of the sample is set aside; a logistic curve through its margins, weighed by the labels' shares in all rows, makes the score.

Nulls, ties and empty input: null and empty texts have no indicator, so their score is that of the bias alone. Labels other than 0 and 1 and
null ids teach nothing; an id with several labels has the largest. Rows that repeat an id are scored each for itself, and count each. If a
label is missing the score is the other's share, and 0.5 without any. Texts of any length are read in pieces. Empty tables give empty
results. Other columns pass through; such as bear the name of the score are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, least_hashes, stage, table

BITS = 17
SIZE = 1 << BITS
PIECE = 1 << 20
LONGEST = 6
_WORD = re.compile(r"\S+")
_SPREAD = np.uint32(0x9E3779B1)


def repeats(words: list[str]) -> Iterator[np.ndarray]:
    """Codes of the patterns of repeats in runs of up to LONGEST words, for a lag of one and of two words."""
    for lag in (1, 2):
        same = np.array([a == b for a, b in zip(words, words[lag:])], np.uint32)
        code = same
        for n in range(2, LONGEST + 1):
            if len(same) < n:
                break
            code = code[:-1] * np.uint32(2) + same[n - 1 :]
            yield code + np.uint32(1000 * n + 100_000 * lag)


def indicators(text: str | None) -> np.ndarray:
    """The places that the text's n-grams have, ascending."""
    here = np.zeros(SIZE, bool)
    text = text or ""
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[max(0, at - 2) : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77) + np.uint32(1)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F) + np.uint32(2)
        for code in (c, two, three):
            here[(code * _SPREAD) >> np.uint32(32 - BITS)] = True
    found, last = _WORD.finditer(text), []
    while words := [m.group() for m in islice(found, 1 << 16)]:
        for code in repeats(last + words):
            here[(code * _SPREAD) >> np.uint32(32 - BITS)] = True
        last = (last + words)[-LONGEST - 1 :]
    return np.flatnonzero(here).astype(np.int32)


class Model:
    """Ratios and weights by place, a bias, and the curve (slope, shift) from a margin to a score."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, bias: float, curve: tuple[float, float]):
        self.ratios, self.weights, self.bias, self.curve = ratios.astype(np.float32), weights.astype(np.float32), bias, curve

    def margin(self, at: np.ndarray) -> float:
        at, x = scaled(at, self.ratios)
        return float(self.weights[at] @ x) + self.bias

    def score(self, text: str | None) -> float:
        slope, shift = self.curve
        return float(1 / (1 + np.exp(-np.clip(slope * self.margin(indicators(text)) + shift, -60, 60))))


def scaled(at: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): the ratios of the indicators, at length 1."""
    x = ratios[at]
    return at, x / max(1e-12, float(np.sqrt(x @ x)))


def log_count_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    p, q = good + 1.0, bad + 1.0
    return np.log((p / p.sum()) / (q / q.sum()))


def hinge(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 1.0, epochs: int = 30, least: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, bias): min ½(|w|² + b²) + cost * sum of max(0, 1 - y(w·x + b)), by dual coordinate descent: one dual variable a row,
    kept in [0, cost], each set to its best in turn; ends when no variable's projected gradient exceeds `least`."""
    w, b, dual = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    norm = np.array([x @ x + 1.0 for _, x in rows])
    for epoch in range(epochs):
        worst = 0.0
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = rows[i]
            slope = y[i] * (w[at] @ x + b) - 1.0
            new = min(max(dual[i] - slope / norm[i], 0.0), cost)
            worst = max(worst, abs(new - dual[i]) * norm[i])
            step = (new - dual[i]) * y[i]
            if step:
                w[at] += step * x
                b += step
                dual[i] = new
        if worst < least:
            break
    return w, b


def sigmoid_curve(margin: np.ndarray, y: np.ndarray, shares: tuple[float, float]) -> tuple[float, float]:
    """(slope, shift) of the likeliest logistic curve; each label weighs as its share of all rows, and targets stop short of 0 and 1, so
    that labels which the margin parts wholly still give a finite slope."""
    n = [max(1, int((y == v).sum())) for v in (-1, 1)]
    goal = np.where(y > 0, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(y > 0, shares[1] / n[1], shares[0] / n[0]) * len(y)
    a, v = np.column_stack([margin, np.ones(len(y))]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -60, 60)))
        step = np.linalg.solve((a.T * (weight * p * (1 - p))) @ a + 1e-6 * np.eye(2), a.T @ (weight * (goal - p)))
        v = v + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, bad, good) of batches (text, y): documents that have the place, by label; place -1 counts documents."""
    own = np.zeros((SIZE + 1, 2), np.int64)
    for batch in batches:
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own[indicators(t), y] += 1
            own[SIZE, y] += 1
    at = np.flatnonzero(own.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(np.where(at == SIZE, -1, at), pa.int32()), pa.array(own[at, 0]), pa.array(own[at, 1])], names=["place", "bad", "good"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", may_learn: Column | None = None, per_class: int = 2000, cost: float = 1.0) -> Model:
    """From docs(doc_id, text) and labels(doc_id, `label`). per_class bounds the rows that the support vectors are fitted on, which come
    to the driver as places; the ratios count every labelled document that may be learned from."""
    may = F.lit(True) if may_learn is None else may_learn
    y = F.col(label).cast("int")
    marks = stage(labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull() & may).groupBy("doc_id").agg(F.max(y).alias("y")), "marks")
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & may)
    count = np.zeros((SIZE + 1, 2), np.int64)
    # a merge join at every size: where labels are few Spark would broadcast them, and the disk needed would jump with the input
    for r in rows.join(marks.hint("merge"), "doc_id").select("text", "y").mapInArrow(counted, "place int, bad long, good long").groupBy("place").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect():
        count[r["place"]] = r["bad"], r["good"]  # place -1 is the last
    n = count[SIZE]
    if not n.all():
        share = float(n[1] / n.sum()) if n.sum() else 0.5
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, (0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))))
    ratios = log_count_ratios(count[:SIZE, 1], count[:SIZE, 0]).astype(np.float32)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([indicators(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], names=["h", "y", "at"])

    # the sample's ids are at most per_class for each of two labels; of rows that repeat an id the least text stands for all
    ids = least_hashes(marks, "y", "doc_id", per_class)
    chosen = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = sorted(chosen.select(F.xxhash64("doc_id").alias("h"), "y", "text").mapInArrow(placed, "h long, y int, at binary").collect(), key=lambda r: (r["h"], r["y"], bytes(r["at"])))
    x = [scaled(np.frombuffer(r["at"], np.int32), ratios) for r in sample]
    sign = np.array([1.0 if r["y"] else -1.0 for r in sample])
    held = np.arange(len(x)) % 5 == 4
    if len(set(sign[held])) < 2 or len(set(sign[~held])) < 2:
        held[:] = False
    w, b = hinge([v for v, h in zip(x, held, strict=True) if not h], sign[~held], cost)
    use = held if held.any() else ~held
    margin = np.array([w[at] @ v + b for (at, v), u in zip(x, use, strict=True) if u])
    return Model(ratios, w, b, sigmoid_curve(margin, sign[use], (n[0] / n.sum(), n[1] / n.sum())))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score, 0 to 1, under `name`. The model is of fixed size: 2^17 places."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text)
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name != name]
    names = [*[docs.columns[i] for i in kept], name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array([m.score(t) for t in batch.column(where).to_pylist()], pa.float64())], names=names)

    return docs.mapInArrow(run, StructType([*[StructField(docs.columns[i], docs.schema.fields[i].dataType) for i in kept], StructField(name, DoubleType())]))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 4) != 2)
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
