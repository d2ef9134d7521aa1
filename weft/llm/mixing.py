"""Mixing sources to target weights, by hash-threshold histograms. DataFrame functions only.

Every document gets a 60-bit hash of its id. Sizes are summed by source and the
hash's leading 12 bits; a running sum over the at most 4096 buckets of a source
finds the bucket in which the budget ends, and only that bucket is refined by the
next 12 bits, until the threshold is exact. A filter on the hash then takes the
documents, without a sort. Thresholds nest: a larger budget takes a superset.

A source whose target exceeds its size takes every document once and the
documents under the threshold twice.

Nulls, ties and empty input: a null text has size 0; a null source is a source of
its own, weighed last; rows with one id share a hash and are taken or left
together; a null id hashes as the empty text; an empty table gives an empty result; other columns pass
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, fresh, stage, table

BITS, LEVELS = 12, 5


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: str) -> Column:
    """The first 60 bits of md5 over the id's decimal text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, at most cap times its size.

    Excess over a cap goes to the other sources by weight until none is above: the
    limit is min(cap, level * weight) with one level for all, found from running
    sums over the sources in the order in which they fill.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.select("source", "source_size", F.element_at(kinds, ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")).alias("w"), (F.col("source_size") * cap).alias("most"))
    fill = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    all_rows = W.partitionBy()
    s = s.select("*", (F.sum("most").over(fill) - F.col("most")).alias("full"), (F.sum("w").over(all_rows) - F.sum("w").over(fill) + F.col("w")).alias("open_w"), (F.sum("source_size").over(all_rows) * share).alias("total"))
    # the level that would fill the open sources evenly; the first source that stays below its cap fixes it
    s = s.select("*", F.when((F.col("total") - F.col("full")) / F.col("open_w") < F.col("most") / F.col("w"), (F.col("total") - F.col("full")) / F.col("open_w")).alias("level"))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("full"))).over(all_rows))
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("w"))).alias("target"))


def thresholds(docs: DataFrame, budget: DataFrame) -> DataFrame:
    """(k, bound) from docs(k, size, h) and budget(k, budget): rows with h <= bound sum to the budget within one hash's rows."""
    left = budget.select("k", F.col("budget").cast("double").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = docs.join(left, "k").where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = inside.groupBy("k", "prefix", "rest", F.shiftright("h", shift).alias("b")).agg(F.sum("size").cast("double").alias("n"))
        upto = W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
        hist = hist.select("*", F.sum("n").over(upto).alias("cum"))
        # the bucket in which the budget ends: the first whose running sum reaches it, else the last
        over = F.col("cum") >= F.col("rest")
        pick = hist.groupBy("k").agg(F.min_by(F.struct("b", "n", "cum", "rest"), F.struct((~over).cast("int"), F.when(over, F.col("b")).otherwise(-F.col("b")))).alias("x"))
        left = stage(pick.select("k", (F.col("x.rest") - F.col("x.cum") + F.col("x.n")).alias("rest"), F.col("x.b").alias("prefix"), F.col("x.n").alias("n")), "bounds")
        last = left
        left = left.select("k", "rest", "prefix")
    # the last bucket is one hash value: its rows stay if that comes nearer to the budget
    return last.select("k", F.when(F.col("rest") >= F.col("n") / 2, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("bound"))


def plan(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(k, source_size, target, base, bound) for each source of sized(source, size, h): a document is taken base + (h <= bound) times."""
    goal = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    more = F.col("target") > F.col("source_size")
    budget = goal.select(source_key().alias("k"), F.col("source_size").cast("long").alias("source_size"), "target", F.when(more, F.col("target") - F.col("source_size")).otherwise(F.col("target")).alias("budget"), more.cast("int").alias("base"))
    return budget.join(thresholds(sized.select(source_key().alias("k"), "size", "h"), budget.select("k", "budget")), "k").drop("budget")


def source_key() -> Column:
    return F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken): how often the mix takes each document, 0 to 2."""
    sized = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), id_hash(doc_id).alias("h")), "sizes")
    times = F.col("base") + (F.col("h") <= F.col("bound")).cast("int")
    return sized.select("*", source_key().alias("k")).join(plan(sized, **options), "k").select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).cast("long").alias("taken"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with each row as often as the mix takes it; its columns may have any names."""
    sized = stage(docs.select(F.col(source).alias("source"), n_words(text).alias("size"), id_hash(doc_id).alias("h")), "sizes")
    k, base, bound, n = (fresh(docs, x) for x in ("_k", "_base", "_bound", "_n"))
    chosen = plan(sized, **options).select("k", "base", "bound").toDF(k, base, bound)
    rows = docs.select("*", F.struct(F.col(source).isNull().alias("n"), F.coalesce(F.col(source), F.lit("")).alias("s")).alias(k)).join(chosen, k)
    times = F.col(base) + (id_hash(doc_id) <= F.col(bound)).cast("int")
    return rows.select(*docs.columns, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))).alias(n)).drop(n)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
