"""Profiles and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import Stages


def predicate_profile(triples: DataFrame) -> DataFrame:
    """(predicate, n, self_loops, share)."""
    g = triples.groupBy("predicate").agg(F.count("*").alias("n"), F.count_if(F.col("subject") == F.col("object")).alias("self_loops"))
    # the window is over one row a predicate
    return g.select("predicate", "n", "self_loops", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))


def extraction_profile(sections: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(kind, name, n): the numbers of sections, entities and triples, of self-loops, and of each predicate's triples. The triples are
    read once: their counts are sums over the few rows of predicates."""
    by = predicate_profile(triples)
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
    counted = by.agg(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(k).alias("name"), F.coalesce(F.sum(c), F.lit(0)).alias("n")) for k, c in (("triples", "n"), ("self_loops", "self_loops"))]).alias("xs")).select(F.explode("xs").alias("x")).select("x.*")
    return one(sections, "sections").unionByName(one(entities, "entities")).unionByName(counted).unionByName(by.select(F.lit("predicate").alias("kind"), F.col("predicate").alias("name"), "n"))


def reduction(start: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], first: str = "raw") -> tuple[DataFrame, DataFrame]:
    """((pos, stage, n), result): how many rows each step left, and what the last one gave. Rows are counted by observations while
    the steps' results are written: each is made once, and nothing is read to be counted."""
    spark, own = start.sparkSession, Stages()
    seen = [(first, Observation())]
    df = start.observe(seen[0][1], F.count(F.lit(1)).alias("n"))
    for name, step in steps:
        seen.append((name, Observation()))
        df = own.keep(step(df).observe(seen[-1][1], F.count(F.lit(1)).alias("n")))
    if not steps:
        df = own.keep(df)
    own.kept.remove(df)
    own.gone(*own.kept)
    return spark.createDataFrame([(i, name, o.get["n"]) for i, (name, o) in enumerate(seen)], "pos int, stage string, n long"), df


def qa_scores(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, expected, found, ratio, hops_reached) of pairs(question_id, expected_entities, expected_hops) and evidence(question_id, hop, name)."""
    want = pairs.select("question_id", F.explode(F.array_distinct("expected_entities")).alias("name"))
    hit = want.join(evidence.select("question_id", "name").distinct().withColumn("hit", F.lit(1)), ["question_id", "name"], "left").groupBy("question_id").agg(F.count("*").alias("expected"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    hops = evidence.groupBy("question_id").agg(F.max("hop").alias("h"))
    return pairs.join(hit, "question_id", "left").join(hops, "question_id", "left").select("question_id", "expected", "found", (F.col("found") / F.col("expected")).alias("ratio"), (F.coalesce("h", F.lit(0)) >= F.col("expected_hops")).alias("hops_reached"))
