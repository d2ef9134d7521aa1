"""Training samples, token windows and label masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "You turn text into graph facts."


def chatml(system: Column, user: Column, assistant: Column) -> Column:
    turn = lambda role, c: F.concat(F.lit(f"<|im_start|>{role}\n"), c, F.lit("<|im_end|>\n"))
    return F.concat(turn("system", system), turn("user", user), turn("assistant", assistant))


def annotation_samples(annotations: DataFrame, entities: bool = True, triples: bool = True) -> DataFrame:
    """(chunk_id, task_type, text) of annotations(chunk_id, text, trace, entities, triples): an entity sample if there are entities, a triple sample if there are both."""
    think = F.when(F.coalesce("trace", F.lit("")) != "", F.concat(F.lit("<think>"), "trace", F.lit("</think>\n"))).otherwise("")
    out = []
    if entities:
        out.append(annotations.where(F.size("entities") > 0).select("chunk_id", F.lit("entities").alias("task_type"), chatml(F.lit(SYSTEM), F.concat(F.lit("List the entities.\n"), "text"), F.concat(think, F.to_json("entities"))).alias("text")))
    if triples:
        out.append(annotations.where((F.size("entities") > 0) & (F.size("triples") > 0)).select("chunk_id", F.lit("triples").alias("task_type"), chatml(F.lit(SYSTEM), F.concat(F.lit("List the relations.\nEntities: "), F.to_json("entities"), F.lit("\n"), "text"), F.concat(think, F.to_json("triples"))).alias("text")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def conversation_samples(turns: DataFrame) -> DataFrame:
    """(conv_id, text): the turns of turns(conv_id, turn, role, text) in order."""
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("x")))), lambda x: x["x"]), "").alias("text"))


def qa_samples(pairs: DataFrame) -> DataFrame:
    """pairs(question, answer, context)."""
    q = F.when(F.coalesce("context", F.lit("")) != "", F.concat("question", F.lit("\n\n"), "context")).otherwise(F.col("question"))
    return pairs.withColumn("text", chatml(F.lit(SYSTEM), q, F.col("answer")))


def corpus_rows(docs: DataFrame, doc_id: str = "doc_id", content: str = "text") -> DataFrame:
    """D3: documents that are not blank."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")


def token_windows(rows: DataFrame, length: int = 2048, overlap: int = 512, tokens: str = "tokens") -> DataFrame:
    """Rows with window and its tokens, every length - overlap tokens; one wholly inside the overlap is still one."""
    step = length - overlap if length > overlap else length
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda s: F.slice(tokens, s + 1, F.lit(length)))
    return rows.select(*[c for c in rows.columns if c != tokens], F.posexplode(cut).alias("window", tokens))


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """struct(input_ids, attention_mask, labels) of fixed length."""
    kept = F.slice(ids, 1, length)
    more = F.lit(length) - F.size(kept)
    full = F.concat(kept, F.array_repeat(F.lit(pad), more))
    return F.struct(full.alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), more)).alias("attention_mask"), full.alias("labels"))


def masked_labels(ids: Column, attention: Column, marker: Sequence[int]) -> Column:
    """-100 before the end of the first marker and where attention is 0; without a marker everywhere."""
    m = F.array(*map(F.lit, marker))
    places = F.when(F.size(ids) >= len(marker), F.sequence(F.lit(1), F.size(ids) - len(marker) + 1)).otherwise(F.array().cast("array<int>"))
    first = F.get(F.filter(places, lambda i: F.slice(ids, i, F.lit(len(marker))) == m), F.lit(0))
    start = F.coalesce(first + len(marker) - 1, F.lit(1 << 30))
    return F.transform(F.arrays_zip(ids.alias("i"), attention.alias("a")), lambda x, k: F.when((k >= start) & (x["a"] == 1), x["i"]).otherwise(-100))
