"""A training corpus from documents: five stages, each of an operator in weft.llm, on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import langid, minhash, mixing, pieces, suffixarray
from weft.llm.common import bounded, fresh, stage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; `und` and predictions under 0.5 go. All columns stay as they are."""
    bounded(spark)
    names = fresh(docs, "lang_pred"), fresh(docs, "score")
    told = langid.predict(docs, langid.train(docs), names=names)
    return told.where((F.col(names[0]) != "und") & (F.col(names[1]) >= 0.5)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; null ids and texts without words stay. If ids repeat, each row counts as a
    document of its own, and of a group the first row of the smallest id stays."""
    ids = docs.select("doc_id").where("doc_id is not null")
    if ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = minhash.near_duplicates(docs)
        kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id")
        return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
    row = fresh(docs, "row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    some = numbered.where("doc_id is not null")
    found = minhash.near_duplicates(some.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias("c"))
    first = found.join(some.select(row, "doc_id"), row).groupBy("c").agg(F.min_by(row, F.struct("doc_id", row)).alias(row))
    return numbered.join(first.select(row), row, "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that an earlier place has; n_chars follows."""
    return suffixarray.dedup(docs, kept_text=True).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often, up to twice, as its source's target asks for."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """piece_ids and n_pieces of each document, and whether they give back its text, round_trip; columns of these names are replaced."""
    bounded(spark)
    names = fresh(docs, "ids"), fresh(docs, "back")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), names=names)
    new = {"piece_ids": F.col(names[0]), "n_pieces": F.size(names[0]).cast("long"), "round_trip": F.col(names[1]) == F.coalesce("text", F.lit(""))}
    return out.select(*[c for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("encode", encode)]

#: Language models, component search and the piece search have no SQL form; tests/llm/test_contracts.py holds run() against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
