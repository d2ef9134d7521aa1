"""Approximate nearest neighbours by a hash-prefix forest.

Every vector has one long hash string a tree: bit i is the side of a random hyperplane. A tree is the sorted
array of its strings, cut into cells of neighbours. A query descends to its longest prefix in every tree and ascends in all trees
at once, a bit at a time, until the prefixes together hold enough candidates: a prefix is a range of the sorted strings, found in a cell
by binary search. Candidates are then ranked by the true inner product, in double precision.

How many are enough is fitted: on a bounded sample of queries (`sample`), whose true neighbours are found by
brute force over all rows, it is the least count at which the ascent meets `recall` of them, at least `least`.
Vectors without structure need a large part of the rows; that is a property of the data, and the recall holds.

Vectors are scaled for the hashes only: with M the largest norm, x becomes (x / M, sqrt(1 - |x|^2 / M^2)), a query
(q / |q|, 0), so that the largest inner product is the least angle.

Equal vectors are one class, and only its k + 1 smallest ids can be among anyone's k nearest; the others stay out of
the trees as candidates and, as queries, share the class's answer. A cell of many rows or queries is compared in blocks, so
no task holds one whole.

Nulls and ties: vectors that are null, zero, of another width than most, or that hold null or non-finite components take no part,
neither as query nor as candidate; equal products go to the smaller id; a null id takes no part; an empty table gives
an empty result; rows that repeat an id count once for each different vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stage, table

TREES, BLOCK, QUERIES = 24, 8192, 1024
#: Bits of a string: enough that a deepest prefix of evenly hashed rows holds one row, between these.
LEAST_BITS, MOST_BITS = 16, 40


def planes(width: int, depth: int, trees: int = TREES, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees, depth, width + 1))


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & good & F.exists("v", lambda x: x != 0))
    width = v.groupBy(F.size("v").alias("w")).count().orderBy(F.col("count").desc(), "w").first()
    return v.where(F.size("v") == (width["w"] if width else 0))


def hashed(classes: DataFrame, planes_: np.ndarray, largest: float) -> DataFrame:
    """(c, tree, h) of classes(c, v): the string of each tree as a number, first bit highest; for queries the added component is 0."""
    trees, depth, _ = planes_.shape
    shared = classes.sparkSession.sparkContext.broadcast(planes_)

    def run(batches):
        p = shared.value.reshape(trees * depth, -1)
        for batch in batches:
            n = batch.num_rows
            x = batch.column("v").flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, p.shape[1] - 1))
            norm = np.sqrt((x * x).sum(1))
            for added, name in ((np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2)), "row"), (np.zeros(n), "query")):
                scale = norm if name == "query" else np.full(n, largest)
                z = np.column_stack([x / np.maximum(scale, 1e-300)[:, None], added]) @ p.T > 0
                h = z.reshape(n, trees, depth) @ (1 << np.arange(depth - 1, -1, -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("c").to_numpy(), trees)), pa.array(np.tile(np.arange(trees), n), pa.int32()), pa.array(h.reshape(-1).astype(np.int64)), pa.array([name] * (n * trees))], names=["c", "tree", "h", "role"])

    return classes.select("c", "v").mapInArrow(run, "c long, tree int, h long, role string")


def prefix(h: Column, level: Column | int, depth: int) -> Column:
    """The first `level` bits of a string of `depth`."""
    return F.shiftright(h, depth - level) if isinstance(level, int) else F.call_function("shiftright", h, (F.lit(depth) - level).cast("int"))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, recall: float = 0.96, least: int = 256, sample: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which `queries`, a condition on id, holds."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors, vec_id, vector).dropDuplicates(["id", "v"]), "vectors")
    width = rows.select(F.size("v").alias("w")).limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], result)
    d = width[0]["w"]
    largest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] ** 0.5
    # classes of equal vectors, each with its k + 1 smallest ids
    order = W.partitionBy("v").orderBy("id")
    small = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    classes = stage(small.groupBy("v").agg(F.min("id").alias("c"), F.sort_array(F.collect_list("id")).alias("ids")).select("c", "v", "ids"), "classes")
    asked = stage(rows.where(queries).join(classes.select("c", "v"), "v").select(F.col("id").alias("query_id"), "c"), "asked")
    ask = asked.select("c").distinct()
    depth = max(LEAST_BITS, min(MOST_BITS, classes.count().bit_length()))
    strings = stage(hashed(classes, planes(d, depth), largest), "strings")
    data, probe = strings.where("role = 'row'").drop("role"), strings.where("role = 'query'").drop("role").join(ask, "c", "left_semi")
    # sizes of all prefixes of all trees, out of the counts of the whole strings; the root has TREES
    whole = data.groupBy("tree", "h").agg(F.count("*").alias("n"))
    sizes = whole.select("tree", "h", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).groupBy("tree", "level", prefix(F.col("h"), F.col("level"), depth).alias("p")).agg(F.sum("n").alias("n"))
    sizes = stage(sizes, "sizes")
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    climb = probe.select("c", "tree", "h", levels).select("c", "tree", "level", prefix(F.col("h"), F.col("level"), depth).alias("p")).join(sizes, ["tree", "level", "p"], "left").groupBy("c", "level").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    climb = stage(climb, "climb")

    enough = max(least, fitted(classes, ask, data, probe, climb, k, recall, sample, depth))
    stop = climb.where(F.col("n") >= enough).groupBy("c").agg(F.max("level").alias("level"))
    stop = ask.join(stop, "c", "left").select("c", F.coalesce("level", F.lit(0)).alias("level"))
    # a prefix is a range of a tree's sorted strings; the root is the same in all trees, so one stands for it
    wide = (F.lit(depth) - F.col("level")).cast("int")
    low = F.call_function("shiftleft", F.call_function("shiftright", F.col("h"), wide), wide)
    asks = probe.join(stop, "c").where("level > 0 or tree = 0").select("c", "tree", low.alias("lo"), (low + F.call_function("shiftleft", F.lit(1).cast("long"), wide) - 1).alias("hi"))
    # trees lie in cells of some 4096 neighbouring strings; a query goes to the cells that its range meets, a row to its own cell, once a tree
    cells = max(0, min(depth, classes.count().bit_length() - 12))
    cell = lambda h: F.shiftright(h, depth - cells)
    asks = stage(asks.select("c", "tree", "lo", "hi", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell")), "asks")
    rows_in = data.withColumn("cell", cell("h"))
    shape = rows_in.groupBy("tree", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(asks.groupBy("tree", "cell").agg(F.ceil(F.count("*") / QUERIES).alias("parts")), ["tree", "cell"])
    shape = stage(shape, "shape")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    row_side = rows_in.join(shape, ["tree", "cell"]).select("c", "tree", "cell", F.pmod(F.xxhash64("c"), F.col("blocks")).alias("b"), upto("parts").alias("q"), F.col("h").alias("lo"), F.lit(-1).cast("long").alias("hi"))
    ask_side = asks.join(shape, ["tree", "cell"]).select("c", "tree", "cell", upto("blocks").alias("b"), F.pmod(F.xxhash64("c"), F.col("parts")).alias("q"), "lo", "hi")
    both = row_side.unionByName(ask_side).join(classes.select("c", "v"), "c")

    def rank(t: pa.Table) -> pa.Table:
        c, lo, hi = (t.column(n).to_numpy() for n in ("c", "lo", "hi"))
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(c), -1)
        q, x = np.flatnonzero(hi >= 0), np.flatnonzero(hi < 0)
        # the cell's sorted strings; each range is found by binary search
        x = x[np.lexsort([c[x], lo[x]])]
        ends = np.column_stack([np.searchsorted(lo[x], lo[q], "left"), np.searchsorted(lo[x], hi[q], "right")])
        ranges, which = np.unique(ends, axis=0, return_inverse=True) if len(q) else (ends, np.zeros(0, int))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, (a, b) in enumerate(ranges):
            m = min(b - a, k + 21)  # rounding in a block may swap near-equal products; true products are taken below
            if m > 0:
                mine, near = q[which.reshape(-1) == i], x[a:b][np.argsort(c[x[a:b]])]
                s = v[mine] @ v[near].T
                top = np.sort(np.argpartition(-s, m - 1, axis=1)[:, :m], axis=1)
                out.append((np.repeat(c[mine], m), c[near][top].reshape(-1), np.take_along_axis(s, top, 1).reshape(-1)))
        return pa.table(dict(zip("qcs", map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = both.withColumnRenamed("q", "part").groupBy("tree", "cell", "b", "part").applyInArrow(rank, "q long, c long, s double")
    found = stage(found.groupBy("q", "c").agg(F.max("s").alias("s")), "found")
    best = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("s").desc(), "c"))).where(F.col("r") <= k + 21)
    # products on the original vectors, added up in order
    exact = best.join(classes.toDF("c", "v", "ids"), "c").join(classes.select(F.col("c").alias("q"), F.col("v").alias("w")), "q")
    exact = exact.select("q", "ids", F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score"))
    ranked = exact.select("q", F.explode("ids").alias("vec_id"), "score").withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("xs"))
    out = asked.join(lists.withColumnRenamed("q", "c"), "c").select("query_id", F.posexplode(F.slice(F.filter("xs", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def fitted(classes: DataFrame, ask: DataFrame, data: DataFrame, probe: DataFrame, climb: DataFrame, k: int, recall: float, sample: int, depth: int) -> int:
    """How many candidates, trees added up, the ascent needs to meet `recall` of the true neighbours of at most `sample` queries."""
    picked = ask.orderBy(F.xxhash64("c"), "c").limit(sample).join(classes.select("c", "v"), "c").collect()
    if not picked:
        return 0
    ids, q = np.array([r["c"] for r in picked]), np.array([r["v"] for r in picked])
    shared = classes.sparkSession.sparkContext.broadcast((ids, q))

    def scan(batches):
        ids, q = shared.value
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            c = batch.column("c").to_numpy()
            s = q @ batch.column("v").flatten().to_numpy().reshape(len(c), -1).T
            for i in range(len(ids)):
                s_, c_ = np.append(best[i][0], s[i][c != ids[i]]), np.append(best[i][1], c[c != ids[i]])
                o = np.lexsort([c_, -s_])[:k]
                best[i] = (s_[o], c_[o])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(b[0]) for b in best]), pa.int64()), pa.array(np.concatenate([b[1] for b in best]), pa.int64()), pa.array(np.concatenate([b[0] for b in best]))], names=["q", "c", "s"])

    near = classes.select("c", "v").mapInArrow(scan, "q long, c long, s double")
    near = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("s").desc(), "c"))).where(F.col("r") <= k).select("q", "c")
    # the level at which each true neighbour is met: its longest common prefix over the trees
    meets = near.join(data.select("c", "tree", F.col("h").alias("hx")), "c").join(probe.select(F.col("c").alias("q"), "tree", "h"), ["q", "tree"])
    x = F.col("h").bitwiseXOR(F.col("hx"))
    lcp = F.when(x == 0, F.lit(depth)).otherwise(F.lit(depth - 1) - F.floor(F.log2(x.cast("double"))).cast("int"))
    needs = meets.groupBy("q", "c").agg(F.max(lcp).alias("level")).join(climb.select(F.col("c").alias("q"), "level", "n"), ["q", "level"])
    counts = sorted(r["n"] for r in needs.select("n").collect())  # at most sample * k
    return counts[min(len(counts) - 1, int(np.ceil(recall * len(counts))) - 1)] if counts else 0


def op6_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
