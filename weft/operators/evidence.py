"""Chains, citations, prompt contexts and answers. edges(question_id, hop, ord, source, type, target, confidence, source_chunk_id, source_text);
chain_nodes(question_id, hop, ord, name, label, properties); steps(question_id, hop, reasoning, relation_used, nodes_explored)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import contains_any, no_blanks, strip, truncated, xml_attr, xml_text

#: Fixed values, also in the code below: the layout of the XML, the default step texts (通过…探索, 第…跳), the name of an unknown relation, and how a description joins its properties.
#: Words that hedge, and the markers before the reasoning in an answer.
HEDGES = ["可能", "不确定", "无法确定"]
MARKERS = ("推理过程:", "分析:")


def append_hop(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A1: (steps, frontier): for each hop the explored targets in order and the first edge's type; the last hop's targets."""
    steps = edges.groupBy("question_id", "hop").agg(F.min_by("type", "ord").alias("relation_used"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("t"))
    steps = steps.select("question_id", F.dense_rank().over(W.partitionBy("question_id").orderBy("hop")).alias("hop"), F.lit("").alias("reasoning"), "relation_used", F.array_distinct("t").alias("nodes_explored"))
    last = steps.groupBy("question_id").agg(F.max_by("nodes_explored", "hop").alias("n"))
    return steps, last.select("question_id", F.explode("n").alias("name"))


def begins(keys: pa.Array) -> np.ndarray:
    """The places where a run of equal keys begins."""
    if pa.types.is_nested(keys.type):
        listed = keys.to_pylist()
        return np.array([i for i, k in enumerate(listed) if not i or k != listed[i - 1]], dtype="int64")
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.append(0, np.flatnonzero(codes[1:] != codes[:-1]) + 1)


def in_order(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The product of each run, first to last: the runs' first values, then their second ones, and so on. The tails of long runs are multiplied one by one."""
    n = np.diff(np.append(starts, len(values)))
    out, live = values[starts], np.arange(len(starts))
    for i in range(1, min(int(n.max()), 64)):
        live = live[n[live] > i]
        out[live] *= values[starts[live] + i]
    for j in np.flatnonzero(n > 64):
        product = float(out[j])
        for x in values[starts[j] + 64 : starts[j] + n[j]].tolist():
            product *= x
        out[j] = product
    return out


def chain_totals(edges: DataFrame) -> DataFrame:
    """A2: (question_id, n_edges, confidence), the product in the chain's order. Each question's edges come sorted to one task, which
    multiplies them as they pass and holds none; a null confidence counts as 1."""
    rows = edges.select("question_id", "hop", "ord", F.coalesce("confidence", F.lit(1.0)).alias("confidence")).repartition("question_id").sortWithinPartitions("question_id", "hop", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch's questions are multiplied at once; its last one stays open, as the next batch may go on with it
        rest = None
        give = lambda keys, n, product: pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(product, pa.float64())], names=["question_id", "n_edges", "confidence"])
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = batch.column(0), np.array(batch.column(1), dtype="float64")
            starts = begins(keys)
            n = np.diff(np.append(starts, len(values)))
            if rest is not None:
                if keys[0].as_py() == rest[0][0].as_py():
                    n[0] += rest[1]
                    values[0] = rest[2] * values[0]
                else:
                    yield give(rest[0], [rest[1]], [rest[2]])
            product = in_order(values, starts)
            yield give(keys.take(pa.array(starts[:-1])), n[:-1], product[:-1])
            rest = keys.slice(int(starts[-1]), 1), int(n[-1]), float(product[-1])
        if rest is not None:
            yield give(rest[0], [rest[1]], [rest[2]])

    kind = edges.schema["question_id"].dataType.simpleString()
    return rows.select("question_id", "confidence").mapInArrow(run, f"question_id {kind}, n_edges long, confidence double")


def chains(edges: DataFrame, questions: DataFrame | None = None, chain_nodes: DataFrame | None = None) -> DataFrame:
    """A2, A3: (question_id, n_edges, confidence, path, description), products in order. The path is the first edge's source and every target.
    With `questions`, those without edges have a row too: confidence 1.0, and the names of their chain_nodes, in order, as the path."""
    g = edges.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("hop", "ord", "source", "type", "target", F.coalesce("confidence", F.lit(1.0)).alias("confidence")))).alias("es"))
    first = F.get("es", F.lit(0))["source"]
    out = g.select(
        "question_id",
        F.size("es").alias("n_edges"),
        F.aggregate("es", F.lit(1.0), lambda a, x: a * x["confidence"]).alias("confidence"),
        F.concat(F.array(first), F.transform("es", lambda x: x["target"])).alias("path"),
        F.concat(first, F.array_join(F.transform("es", lambda x: F.concat(F.lit(" --"), x["type"], F.lit("--> "), x["target"])), "")).alias("description"),
    )
    if questions is None:
        return out
    out = questions.select("question_id").distinct().join(out, "question_id", "left")
    if chain_nodes is None:
        names = F.array().cast("array<string>")
    else:
        n = chain_nodes.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("hop", "ord", "name"))), lambda x: x["name"]).alias("names"))
        out, names = out.join(n, "question_id", "left"), F.coalesce("names", F.array().cast("array<string>"))
    return out.select("question_id", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("path", names).alias("path"), F.coalesce("description", F.array_join(names, " -- ")).alias("description"))


def chain_json(edges: DataFrame, chain_nodes: DataFrame) -> DataFrame:
    """A4: (question_id, chain) as JSON."""
    e = edges.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("hop", "ord", "source", "type", "target", "confidence", "source_chunk_id"))).alias("edges"))
    n = chain_nodes.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("hop", "ord", "name", "label"))).alias("nodes"))
    return e.join(n, "question_id", "full_outer").select("question_id", F.to_json(F.struct("nodes", "edges")).alias("chain"))


def chain_xml(edges: DataFrame, chain_nodes: DataFrame, steps: DataFrame, heads: DataFrame) -> DataFrame:
    """A5: (question_id, xml) of heads(question_id, start, end, confidence). Two decimals, halves up."""
    two = lambda c: F.format_string("%.2f", c)
    line = F.concat(F.lit("      <edge source="), xml_attr(F.col("source")), F.lit(" relation="), xml_attr(F.col("type")), F.lit(" target="), xml_attr(F.col("target")), F.lit(' confidence="'), two(F.col("confidence")), F.lit('"'), F.when(F.coalesce("source_chunk_id", F.lit("")) != "", F.concat(F.lit(" chunk_id="), xml_attr(F.col("source_chunk_id")))).otherwise(""))
    line = F.when(F.coalesce("source_text", F.lit("")) != "", F.concat(line, F.lit(">\n        <source_text>"), xml_text(F.col("source_text")), F.lit("</source_text>\n      </edge>"))).otherwise(F.concat(line, F.lit(" />")))
    joined = lambda xs: F.array_join(F.transform(F.sort_array(xs), lambda x: x["x"]), "\n")
    hop = edges.groupBy("question_id", "hop").agg(joined(F.collect_list(F.struct("ord", line.alias("x")))).alias("t"))
    hop = hop.select("question_id", "hop", F.concat(F.lit('    <hop number="'), F.col("hop").cast("string"), F.lit('">\n'), F.col("t"), F.lit("\n    </hop>\n")).alias("x"))
    body = hop.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hop", "x"))), lambda x: x["x"]), "").alias("edges"))
    desc = F.coalesce(F.col("properties")["description"], F.lit(""))
    ent = F.concat(F.lit("    <entity name="), xml_attr(F.col("name")), F.lit(" label="), xml_attr(F.col("label")), F.lit(' hop="'), F.col("hop").cast("string"), F.lit('"'), F.when(desc != "", F.concat(F.lit(">"), xml_text(desc), F.lit("</entity>\n"))).otherwise(" />\n"))
    ents = chain_nodes.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hop", "ord", ent.alias("x")))), lambda x: x["x"]), "").alias("nodes"))
    step = F.concat(F.lit('    <step hop="'), F.col("hop").cast("string"), F.lit('">'), xml_text(F.when(F.coalesce("reasoning", F.lit("")) != "", F.col("reasoning")).otherwise(F.concat(F.lit("通过"), F.coalesce("relation_used", F.lit("未知关系")), F.lit("探索 "), F.array_join("nodes_explored", "、")))), F.lit("</step>\n"))
    sts = steps.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hop", step.alias("x")))), lambda x: x["x"]), "").alias("steps"))
    out = heads.join(body, "question_id", "left").join(ents, "question_id", "left").join(sts, "question_id", "left")
    head = F.concat(F.lit("<evidence_chain start="), xml_attr(F.col("start")), F.when(F.coalesce("end", F.lit("")) != "", F.concat(F.lit(" end="), xml_attr(F.col("end")))).otherwise(""), F.lit(' confidence="'), two(F.col("confidence")), F.lit('">\n  <reasoning_path>\n'))
    none = lambda c: F.coalesce(c, F.lit(""))
    tail = F.when(F.col("steps").isNotNull(), F.concat(F.lit("  <reasoning_steps>\n"), F.col("steps"), F.lit("  </reasoning_steps>\n"))).otherwise("")
    return out.select("question_id", F.concat(head, none("edges"), F.lit("  </reasoning_path>\n  <entities>\n"), none("nodes"), F.lit("  </entities>\n"), tail, F.lit("</evidence_chain>")).alias("xml"))


def citations(edges: DataFrame, most: int | None = 5) -> DataFrame:
    """(question_id, rank, chunk_id, text, relation): the first edge of each chunk that has a text."""
    e = edges.where("coalesce(source_text, '') <> '' and coalesce(source_chunk_id, '') <> ''")
    relation = F.concat("source", F.lit(" --"), "type", F.lit("--> "), "target")
    first = e.groupBy("question_id", F.col("source_chunk_id").alias("chunk_id")).agg(F.min(F.struct("hop", "ord", F.col("source_text").alias("text"), relation.alias("relation"))).alias("x"))
    out = first.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy("x.hop", "x.ord", "chunk_id")))
    out = out if most is None else out.where(F.col("rank") <= most)
    return out.select("question_id", "rank", "chunk_id", "x.text", "x.relation")


def node_description(properties: Column) -> Column:
    picks = [F.when(strip(properties[k]) != "", strip(properties[k])) for k in ("description", "summary", "desc")]
    pairs = F.transform(F.filter(F.map_entries(properties), lambda x: x["value"].isNotNull()), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return F.coalesce(*picks, F.array_join(pairs, "；"), F.lit(""))


def entity_descriptions(chain_nodes: DataFrame) -> DataFrame:
    """(question_id, name, description): the last node of a name counts."""
    return chain_nodes.groupBy("question_id", "name").agg(F.max_by("properties", F.struct("hop", "ord")).alias("p")).select("question_id", "name", node_description(F.col("p")).alias("description"))


def step_texts(steps: DataFrame) -> DataFrame:
    """(question_id, hop, text)."""
    return steps.select("question_id", "hop", F.when(F.coalesce("reasoning", F.lit("")) != "", F.col("reasoning")).otherwise(F.concat(F.lit("第"), F.col("hop").cast("string"), F.lit("跳: 通过"), F.coalesce("relation_used", F.lit("未知关系")), F.lit("探索 "), F.array_join("nodes_explored", "、"))).alias("text"))


def contexts(questions: DataFrame, xml: DataFrame, steps: DataFrame, cites: DataFrame, most: int = 4000) -> DataFrame:
    """(question_id, prompt): question, evidence, steps and citations in our wording, cut at `most` characters."""
    s = step_texts(steps).groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hop", "text"))), lambda x: x["text"]), "\n").alias("steps"))
    c = cites.where("rank <= 5").groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), "chunk_id", F.lit(") "), "text").alias("x")))), lambda x: x["x"]), "\n").alias("cites"))
    rows = questions.select("question_id", "text").join(xml, "question_id", "left").join(s, "question_id", "left").join(c, "question_id", "left")
    part = lambda title, col: F.when(F.coalesce(col, F.lit("")) != "", F.concat(F.lit(f"\n\n## {title}\n"), F.col(col))).otherwise("")
    prompt = F.concat(F.lit("Answer from the evidence.\n\n## Question\n"), "text", part("Evidence", "xml"), part("Steps", "steps"), part("Sources", "cites"))
    return rows.select("question_id", truncated(prompt, most).alias("prompt"))


def answer_confidence(answer: Column, evidence: Column | float = 0.6) -> Column:
    """A10; A13 with the fixed 0.6."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    a = strip(F.coalesce(answer, F.lit("")))
    e = F.lit(evidence) if isinstance(evidence, float) else evidence
    return clamp(clamp(e) - F.when(contains_any(a, HEDGES), 0.2).otherwise(0.0) - F.when(F.length(a) < 20, 0.1).otherwise(0.0))


def split_answer(answer: Column) -> Column:
    """struct(answer, steps): what stands before the marker, and the lines behind it; steps null if there are none."""
    a = strip(F.coalesce(answer, F.lit("")))
    none = F.lit(None).cast("array<string>")

    def at(marker: str) -> Column:
        place = F.locate(marker, a)
        steps = no_blanks(F.split(F.substring(a, place + len(marker), F.length(a)), r"\n+|；|;"))
        return F.struct(strip(F.substring(a, F.lit(1), place - 1)).alias("answer"), F.when(F.size(steps) > 0, steps).alias("steps"))

    out = F.struct(a.alias("answer"), none.alias("steps"))
    for marker in reversed(MARKERS):
        out = F.when(F.locate(marker, a) > 0, at(marker)).otherwise(out)
    return out


def evidence_list(questions: DataFrame, edges: DataFrame, chain_nodes: DataFrame) -> DataFrame:
    """A row an edge; for a question without edges its first node."""
    e = edges.select("question_id", "ord", "source", "type", "target", "confidence")
    first = chain_nodes.groupBy("question_id").agg(F.min(F.struct("hop", "ord", "name")).alias("x")).join(e.select("question_id").distinct(), "question_id", "left_anti")
    return e.unionByName(first.select("question_id", F.lit(0).cast(e.schema["ord"].dataType).alias("ord"), F.col("x.name").alias("source"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("double").alias("confidence"))).join(questions.select("question_id"), "question_id", "left_semi")


def report(edges: DataFrame) -> DataFrame:
    """(question_id, hop, n_edges, n_nodes, confidence)."""
    return edges.groupBy("question_id", "hop").agg(F.count("*").alias("n_edges"), F.count_distinct("target").alias("n_nodes"), F.product(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))


def answers(questions: DataFrame, responses: DataFrame, confidences: DataFrame) -> DataFrame:
    """A row a question: status DONE or FAILED, answer, steps, confidence, error. A failed question leaves the others alone."""
    r = responses.select("question_id", F.col("text").alias("response"), "error")
    rows = questions.select("question_id").join(r, "question_id", "left").join(confidences.select("question_id", F.col("confidence").alias("ev")), "question_id", "left")
    failed = F.col("error").isNotNull() | F.col("response").isNull()
    return rows.withColumn("s", split_answer(F.col("response"))).select("question_id", F.when(failed, "FAILED").otherwise("DONE").alias("status"), F.when(~failed, F.col("s.answer")).alias("answer"), F.when(~failed, F.col("s.steps")).alias("steps"), F.when(~failed, answer_confidence(F.col("response"), F.coalesce("ev", F.lit(1.0)))).alias("confidence"), F.when(failed, F.coalesce("error", F.lit("no response"))).alias("error"))
