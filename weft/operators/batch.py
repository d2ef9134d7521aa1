"""Questions to answers as one batch: parse, link, plan, retrieve, assemble, ask the model, answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import checkpointed
from .evidence import answers, append_hop, chain_totals, chain_xml, citations, contexts
from .graph import find_nodes
from .questions import parse_responses, parse_rules, response_plans, rule_plans
from .reasoning import concrete, evidence_rows, link, run_plans
from .responses import chosen_attempt, infer


def chain_tables(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, chain nodes) as the evidence operators take them, of evidence edges out of run_plans or run_guided: M11, names in place of
    ids, and ord: hop, then place by (node, other's name, type, edge). Nodes: the far end of each edge, in that order."""
    e = evidence_rows(edges)
    place = F.struct("hop", "node", "other_name", "type", "edge_id")
    name = nodes.select("node_id", "name")
    e = e.withColumn("place", place)
    e = e.join(name.toDF("src", "source"), "src").join(name.toDF("dst", "target"), "dst")
    # numbered by a sort that streams: no question's edges are held as one array
    order = W.partitionBy("question_id").orderBy("place", "source", "target", "confidence", "source_chunk_id", "source_text")
    out = checkpointed(e.select("question_id", "hop", (F.row_number().over(order) - 1).alias("ord"), "source", "type", "target", "confidence", "source_chunk_id", "source_text", "other"))
    far = out.join(nodes.select(F.col("node_id").alias("other"), "name", "label", "properties"), "other").select("question_id", "hop", "ord", "name", "label", "properties")
    return out.drop("other"), far


def prompt_batch(questions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int | None = 20, most: int = 4000, parsed_responses: DataFrame | None = None, plan_responses: DataFrame | None = None, suggestions: DataFrame | None = None, abstract: list[str] | None = None, decisions: DataFrame | None = None, reflections: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((question_id, prompt), heads(question_id, start, end, confidence)) of questions(question_id, text): A15 as far as the model's call.

    What a model said beforehand can stand in for the rules, question by question: parsed_responses (Q6) and plan_responses (Q8), both
    (question_id, response); suggestions(entity, attempt, suggestion) for linking (M1). Linked nodes with an `abstract` label are left out
    (M2). Questions whose plan found no edge are walked by decisions and reflections (M7, M9), else by their goals."""
    questions = questions.select("question_id", "text")
    names, labels = nodes.select("name").where("name <> ''").distinct(), nodes.select("label").distinct()
    parsed = checkpointed(parse_rules(questions, names) if parsed_responses is None else parse_responses(questions, parsed_responses, names))
    plans, steps = rule_plans(parsed, labels) if plan_responses is None else response_plans(parsed, plan_responses, labels)
    starts = checkpointed(plans.select("question_id", F.posexplode("start_entities").alias("ord", "entity")))
    linked = link(starts.select("entity"), nodes, suggestions).where("name is not null").select("entity", "name")
    linked = linked if abstract is None else concrete(linked, nodes, abstract).select("entity", "name")
    found = find_nodes(linked.select(F.col("name").alias("key")).distinct(), nodes).select(F.col("key").alias("name"), F.col("node_id").alias("node"))
    at = checkpointed(starts.join(linked, "entity").join(found, "name").select("question_id", "ord", "node", "name"))
    hints = parsed.select("question_id", F.get("relation_hints", F.lit(0)).alias("type"))
    got, far = chain_tables(run_plans(at, steps, edges, nodes, limit, fallback=True, hints=hints, decisions=decisions, reflections=reflections), nodes)
    taken, _ = append_hop(got)
    heads = questions.select("question_id").join(chain_totals(got), "question_id", "left").select("question_id", F.coalesce("confidence", F.lit(1.0)).alias("confidence")).join(at.groupBy("question_id").agg(F.min_by("name", "ord").alias("start")), "question_id", "left")
    heads = heads.select("question_id", F.coalesce("start", F.lit("")).alias("start"), F.lit(None).cast("string").alias("end"), "confidence")
    return contexts(questions, chain_xml(got, far, taken, heads), taken, citations(got), most), heads


def answer_batch(questions: DataFrame, nodes: DataFrame, edges: DataFrame, model: Callable[[list[str]], list[str | None]], limit: int | None = 20, most: int = 4000, batch: int = 1, **said: DataFrame | list[str]) -> DataFrame:
    """(question_id, status, answer, steps, confidence, error) for each of questions(question_id, text). A question whose model call fails is
    FAILED with its error and leaves the others alone; one that links to nothing is answered from an empty chain. The model
    gets `batch` prompts a call. `said`: as in prompt_batch."""
    questions = questions.select("question_id", "text")
    prompts, heads = prompt_batch(questions, nodes, edges, limit, most, **said)
    asked = checkpointed(infer(prompts.select(F.col("question_id").alias("prompt_id"), "prompt"), model, batch))
    failed = asked.groupBy("prompt_id").agg(F.min("error").alias("error"))
    answered = chosen_attempt(asked).join(failed, "prompt_id").select(F.col("prompt_id").alias("key"), "text", "error")
    responses = questions.select("question_id", F.col("question_id").cast("string").alias("key")).join(answered, "key").select("question_id", "text", "error")
    return answers(questions, responses, heads)
