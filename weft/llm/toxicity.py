"""Toxicity by class-conditional Kneser-Ney models over characters.

Two models, of toxic and of ordinary text, give a character its probability after up to five
characters of its own word. The highest order has counts of each class; below it both share
one chain of Kneser-Ney continuation counts, so an expression rare in one class is smoothed by what both know.
A text's log-likelihood ratio is divided by its length: over the whole text, and over the eight neighbouring words
that stand out most. A logistic curve, fitted on labelled documents, makes a score of the two.

Counts cover every labelled document that may be learned from, and every n-gram of them. They stay a table: Spark's
aggregations and joins make the ratios out of it, and a text meets them in slices of at most `entries`, one pass over the
texts a slice. The slices change nothing in the result; a pass that is not the last writes the texts and their word sums.
The curve is fitted on at most `per_class` documents of each label, by a second model that counts all the others; the
model that scores counts these too.

Nulls and ties: a null text is the empty text and gets the score of a ratio of zero; rows without a label,
or with one that is not 0 or 1, teach nothing; if labels of an id disagree, 1 counts. Without both labels every score
is 0.0. Rows that repeat an id are scored each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window as W

from .common import drop, fold, least_hashes, stage, table

ORDER, BITS, WINDOW = 6, 6, 8
CONTEXT = 1 << 40
#: Ratios that one pass holds in memory, at up to 48 bytes each; how many there are in all has no bound.
ENTRIES = 1 << 22
PLAIN_CURVE = np.array([0.0, 10.0, 1.0])
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """By code point one of 64 classes: 0 white space, 1-26 a to z, 27 digits, 28 apostrophes, 29 other marks, 30-63 other letters by remainder."""
    global _classes
    if _classes is None:
        def of(i: int) -> int:
            c = chr(i)
            if c.isspace():
                return 0
            if "a" <= c <= "z":
                return 1 + i - 97
            if c.isalpha():
                return 30 + i % 34
            return 27 if c.isdigit() else 28 if c in "'’" else 29

        _classes = np.fromiter((of(i) for i in range(0x110000)), np.uint8, 0x110000)
    return _classes


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of six classes, six bits each, for every character; what precedes the word's space is 0. Word starts; text ends, each behind a closing space."""
    low = [t.lower() for t in texts]
    c = classes()[np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in low])
    at = np.arange(len(c))
    space = c == 0
    # a space ends its word: its own context is the word, so word ends are modelled too
    since = at - np.maximum.accumulate(np.where(np.append(True, space[:-1]), at, 0))
    code = c.copy()
    for k in range(1, ORDER):
        code[k:] += np.where(since[k:] >= k, c[:-k], 0) << BITS * k
    return code, np.flatnonzero(since == 0), ends


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's n-grams by kind, from columns text and kind, 0 to 3; merged whenever four million have come together."""
    kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in range(4)}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not parts:
            return []
        codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return [(codes, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64))]

    for batch in batches:
        text, kind = batch.column("text").to_pylist(), batch.column("kind").to_pylist()
        for k in kept:
            own = [t or "" for t, v in zip(text, kind, strict=True) if v == k]
            for lo in range(0, len(own), 200):
                code = ngrams(own[lo : lo + 200])[0]
                kept[k] += [tuple(np.unique(code, return_counts=True))]
                if sum(len(p[0]) for p in kept[k]) > 4_000_000:
                    kept[k] = merged(kept[k])
    for k in kept:
        for codes, n in merged(kept[k]):
            for lo in range(0, len(codes), 1 << 16):
                part, many = codes[lo : lo + (1 << 16)], n[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), k, np.int32)), pa.array(many)], names=["code", "kind", "n"])


def discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def ratios(sums: DataFrame) -> DataFrame:
    """(model, ctx, key, value) from (model, code, ordinary, toxic): log P(toxic model) - log P(ordinary model) of each known
    n-gram, and, as key ctx | CONTEXT, of a known context's other characters. Nothing is collected but the discounts.
    """

    def discounts(df: DataFrame, *names: str) -> Column:
        seen = df.groupBy("model").agg(*[F.count_if(F.col(n) == i).alias(f"{n}{i}") for n in names for i in (1, 2)]).collect()
        return F.create_map(*[x for r in seen for x in (F.lit(r["model"]), F.struct(*[F.lit(float(discount(r[f"{n}1"], r[f"{n}2"]))).alias(n) for n in names]))])[F.col("model")]

    def low(c: str, k: int) -> Column:
        return F.col(c).bitwiseAND(F.lit((1 << BITS * k) - 1))

    # a context has at most 64 rows
    same = W.partitionBy("model", "ctx")
    levels, now, many = [], sums, F.col("ordinary") + F.col("toxic")
    for k in range(ORDER - 1, 0, -1):
        # a shorter n-gram counts its left neighbours; where its word starts there is none, and occurrences count
        first = F.shiftright("code", BITS * (k - 1)) == 0
        now = stage(now.select("model", low("code", k).alias("short"), F.when(first, many).otherwise(1).alias("n")).groupBy("model", F.col("short").alias("code")).agg(F.sum("n").alias("many")), "level")
        many = F.col("many")
        levels.append(now)
    # P of each n-gram's character by the orders below, both classes together
    shared = None
    for k, level in enumerate(reversed(levels), 1):
        rows = level.select("model", "code", "many", F.shiftright("code", BITS).alias("ctx"), discounts(level, "many")["many"].alias("d"))
        rows = rows.select("*", F.sum("many").over(same).alias("total"), F.count("*").over(same).alias("rest"))
        below = F.lit(1 / 64)
        if shared is not None:
            rows, below = rows.withColumn("short", low("code", k - 1)).join(shared.hint("merge"), ["model", "short"]), F.col("p")
        shared = rows.select("model", F.col("code").alias("short"), ((F.col("many") - F.col("d")) / F.col("total") + F.col("d") * F.col("rest") / F.col("total") * below).alias("p"))
    rows = sums.select("*", F.shiftright("code", BITS).alias("ctx"), low("code", ORDER - 1).alias("short"), discounts(sums, "ordinary", "toxic").alias("d"))
    p, left = {}, {}
    for y in ("ordinary", "toxic"):
        own, d = F.col(y), F.col(f"d.{y}")
        rows = rows.withColumn(f"total_{y}", F.sum(y).over(same)).withColumn(f"kinds_{y}", F.count_if(own > 0).over(same))
        total = F.col(f"total_{y}")
        left[y] = F.when(total > 0, d * F.col(f"kinds_{y}") / total).otherwise(1.0)
        p[y] = F.when(total > 0, F.greatest(own - d, F.lit(0.0)) / total).otherwise(0.0) + left[y] * F.col("p")
    rows = rows.withColumn("nth", F.row_number().over(same.orderBy("code"))).join(shared.hint("merge"), ["model", "short"])
    ratio = lambda x: (F.log(x["toxic"]) - F.log(x["ordinary"])).cast("float")
    own, other = F.struct(F.col("code").alias("key"), ratio(p).alias("value")), F.struct(F.col("ctx").bitwiseOR(F.lit(CONTEXT)).alias("key"), ratio(left).alias("value"))
    out = stage(rows.select("model", "ctx", F.explode(F.when(F.col("nth") == 1, F.array(own, other)).otherwise(F.array(own))).alias("e")).select("model", "ctx", "e.key", "e.value"), "ratios")
    for level in levels:
        drop(level)
    return out


class Lookup:
    """Values of a slice of the ratios: an open-addressed table."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self._table(key, value)

    def _table(self, key: np.ndarray, value: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(key)) * 2))))
        self.shift = np.uint64(64 - bits)
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        left, self.longest = np.arange(len(key)), 0
        home = self._home(key)
        while len(left):
            slot = (home[left] + self.longest) & (len(self.key) - 1)
            free = self.key[slot] == -1
            _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            one = one[free[one]]
            self.key[slot[one]], self.value[slot[one]] = key[left[one]], value[left[one]]
            left = np.delete(left, one)
            self.longest += 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, found = np.zeros(len(key), np.float32), np.zeros(len(key), bool)
        slot, left = self._home(key), np.arange(len(key))
        for _ in range(self.longest):
            got = self.key[slot]
            hit = got == key[left]
            out[left[hit]], found[left[hit]] = self.value[slot[hit]], True
            go = ~hit & (got != -1)
            if not go.any():
                break
            left, slot = left[go], (slot[go] + 1) & (len(self.key) - 1)
        return out, found

    def sums(self, code: np.ndarray, words: np.ndarray) -> np.ndarray:
        """By word the sum of its characters' ratios; a character whose context is in no row of this slice adds 0."""
        ratio, found = self._find(code)
        miss = np.flatnonzero(~found)
        ratio[miss] = self._find((code[miss] >> BITS) | CONTEXT)[0]
        return np.add.reduceat(ratio, words, dtype=np.float64)


def features(sums: np.ndarray, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """By text: the mean log-ratio of its characters, and the largest over eight neighbouring words."""
    run = np.append(0.0, np.cumsum(sums))
    starts = np.append(0, ends[:-1])
    first, last = np.searchsorted(words, starts), np.searchsorted(words, ends)
    out = np.zeros((len(ends), 2))
    out[:, 0] = (run[last] - run[first]) / np.maximum(1, ends - starts)
    # a window of eight words, cut where its text ends
    stop = np.minimum(np.arange(len(words)) + WINDOW, np.repeat(last, last - first))
    peak = (run[stop] - run[:-1]) / np.maximum(np.append(words, ends[-1])[stop] - words, 32)
    out[:, 1] = np.maximum.reduceat(peak, first)
    return out


class Model:
    """A staged table of ratios (ctx, key, value), its number of slices, and the curve."""

    def __init__(self, table: DataFrame, entries: int):
        self.table, self.slices, self.curve = table, max(1, -(-table.count() // entries)), np.zeros(3)

    def slice(self, i: int):
        """A broadcast of the rows whose context falls into slice i; an n-gram is where its context is."""
        got = self.table.where(F.pmod(F.xxhash64("ctx"), F.lit(self.slices)) == i).select("key", "value").toArrow()
        return self.table.sparkSession.sparkContext.broadcast(Lookup(got["key"].to_numpy(), got["value"].to_numpy()))

    def measured(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with whole and peak, the two features of their text."""
        sums = "_word_sums"
        for i in range(self.slices):
            shared, more = self.slice(i), i > 0
            final = i == self.slices - 1
            fields = [f for f in docs.schema.fields if f.name != sums]
            new = ["whole", "peak"] if final else [sums]

            def run(batches: Iterator[pa.RecordBatch], shared=shared, more=more, final=final, names=[f.name for f in fields], new=new) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    texts, lo = [t or "" for t in batch.column(text).to_pylist()], 0
                    while lo < len(texts):
                        hi, size = lo, 0
                        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 1_000_000):
                            size += len(texts[hi])
                            hi += 1
                        code, words, ends = ngrams(texts[lo:hi])
                        part, got = batch.slice(lo, hi - lo), shared.value.sums(code, words)
                        if more:
                            got = got + part.column(sums).flatten().to_numpy()
                        if final:
                            f = features(got, words, ends)
                            cols = [pa.array(f[:, 0]), pa.array(f[:, 1])]
                        else:
                            cols = [pa.ListArray.from_arrays(pa.array(np.append(0, np.searchsorted(words, ends)), pa.int32()), pa.array(got))]
                        yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *cols], names=[*names, *new])
                        lo = hi

            types = [StructField(n, DoubleType() if final else ArrayType(DoubleType())) for n in new]
            out = docs.mapInArrow(run, StructType([*fields, *types]))
            if not final:
                out = stage(out, "words")
                shared.destroy()
                if more:
                    drop(docs)
            docs = out
        return docs


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method; both labels weigh the same in sum."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    b = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b))
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def curve(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Weights of 1, whole and peak, fitted where both labels are there."""
    if len(set(y.tolist())) < 2:
        return PLAIN_CURVE
    order = np.lexsort((x[:, 1], x[:, 0], y))
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    b = logistic((x[order] - mean) / sd, y[order], ridge=0.5)
    return np.append(b[0] - (b[1:] * mean / sd).sum(), b[1:] / sd)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, per_class: int = 3000, entries: int = ENTRIES) -> Model | None:
    """From docs(doc_id, text) and labels(doc_id, toxic). None if one of the labels is missing."""
    may = F.lit(True) if may_learn is None else may_learn
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(may)
    # at most per_class ids of each label, and of small tables an eighth, are for the curve; they are broadcast
    ids = stage(least_hashes(marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0), "toxic", "doc_id", per_class), "curve")
    rows = docs.select("doc_id", "text").where(may).join(marks.hint("merge"), "doc_id").join(F.broadcast(ids.select("doc_id", F.lit(2).alias("held"))), "doc_id", "left")
    kinds = ("ordinary", "toxic", "held_ordinary", "held_toxic")
    sums = rows.select("text", (F.col("toxic") + F.coalesce("held", F.lit(0))).alias("kind")).mapInArrow(counted, "code long, kind int, n long").groupBy("code").agg(*[F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(k) for i, k in enumerate(kinds)])
    sums = stage(sums, "ngrams")
    # model 1 counts all; model 0, which the curve is fitted on, all but the documents that it is fitted with
    each = [F.struct(F.lit(0).alias("model"), "ordinary", "toxic"), F.struct(F.lit(1).alias("model"), (F.col("ordinary") + F.col("held_ordinary")).alias("ordinary"), (F.col("toxic") + F.col("held_toxic")).alias("toxic"))]
    both = sums.select("code", F.explode(F.array(*each)).alias("m")).select("m.model", "code", "m.ordinary", "m.toxic").where("ordinary + toxic > 0")
    seen = {r["model"]: r["o"] > 0 and r["t"] > 0 for r in both.groupBy("model").agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t")).collect()}
    if not seen.get(1):
        drop(sums)
        return None
    table = ratios(both)
    drop(sums)
    model = Model(table.where("model = 1"), entries)
    if not seen.get(0):
        model.curve = PLAIN_CURVE
        return model
    sample = Model(table.where("model = 0"), entries).measured(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("toxic", "text")).select("toxic", "whole", "peak").toArrow()
    model.curve = curve(sample["toxic"].to_numpy(), np.column_stack([sample["whole"].to_numpy(), sample["peak"].to_numpy()]))
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with toxicity, 0 to 1."""
    if model is None:
        return docs.withColumn("toxicity", F.lit(0.0))
    a, b, d = (F.lit(float(v)) for v in model.curve)
    kept = docs.drop("toxicity")
    # columns of docs may have the names of the features
    names = [f"_{i}" for i in range(len(kept.columns))]
    out = model.measured(kept.toDF(*names), names[kept.columns.index(text)])
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), a + F.col("whole") * b + F.col("peak") * d))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept.columns, strict=True)], (1 / (1 + F.exp(-z))).alias("toxicity"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), fold("doc_id", 3) != 1)
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))
