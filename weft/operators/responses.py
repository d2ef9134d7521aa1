"""Prompt tables, the inference seam, and rows out of model responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import array_at, array_in, cleaned, is_number, object_in, text_at, text_of, texts_at
from ..functions.text import strip

#: Our wording; the slots are the contract.
TEMPLATES = {
    "entities": "Find the entities in the section.\nHeadings: {headings}\nKnown: {known}\nTypes: {types}\nText:\n{text}",
    "triples": "Find relations between the listed entities.\nHeadings: {headings}\nEntities: {known}\nRelations: {types}\nText:\n{text}",
    "incremental": "Find new entities and relations.\nKnown: {known}\nRelations: {types}\nText:\n{text}",
    "cross": "Find relations across sections.\nEntities: {known}\nSections:\n{text}",
    "schema": "Propose a schema for the domain {hint}.\nSamples:\n{text}",
    "annotation": "Annotate the text with entities and triples.\nText:\n{text}",
    "verification": "Rate the extraction.\nEntities: {known}\nTriples: {types}\nText:\n{text}",
    "question": "Name intent, entities and relations of the question.\nQuestion: {text}",
    "plan": "Plan the retrieval.\nQuestion: {text}\nEntities: {known}\nTypes: {types}",
    "decision": "Choose the next hop.\nQuestion: {text}\nNeighbours: {known}",
    "reflection": "Judge the evidence so far.\nQuestion: {text}\nEvidence: {known}",
    "linking": "Which node is meant by the entity?\nEntity: {text}\nNodes: {known}",
}
#: Characters of text that a prompt of each kind shows; others show all.
PREVIEW = {"cross": 300, "schema": 2000, "verification": 3000}


def prompts(rows: DataFrame, template: str, **slots: Column) -> DataFrame:
    """Rows with `prompt`. A slot that is not given is empty."""
    out = F.lit(TEMPLATES[template])
    for name in ("headings", "known", "types", "hint", "text"):  # the text last: it may hold braces
        value = slots.get(name, F.lit(""))
        if name == "text" and template in PREVIEW:
            value = F.substring(value, 1, PREVIEW[template])
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return rows.withColumn("prompt", out)


def answered(model: Callable[[list[str]], list[str | None]], prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(text, error) of each prompt. A batch that raises, or answers too few, is halved until the prompts that fail stand alone."""
    if not prompts:
        return []
    try:
        texts = list(model(prompts))
        if len(texts) != len(prompts):
            raise ValueError(f"{len(texts)} answers to {len(prompts)} prompts")
        return [(t, None) for t in texts]
    except Exception as e:  # noqa: BLE001  a failed call is a row, not a failed job
        if len(prompts) == 1:
            return [(None, str(e) or type(e).__name__)]
        half = len(prompts) // 2
        return answered(model, prompts[:half]) + answered(model, prompts[half:])


def infer(rows: DataFrame, model: Callable[[list[str]], list[str | None]], batch: int = 32, attempts: int = 1) -> DataFrame:
    """(prompt_id, attempt, text, error) from rows(prompt_id, prompt): the caller's model, batch by batch on the executors. A prompt that
    fails is an error row and leaves the others of its batch alone. With more `attempts`, those that failed are asked again, and after
    attempt 0 those with a blank answer too, as chosen_attempt (P4) reads them; each attempt made is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ps = b.column("prompt_id").to_pylist(), b.column("prompt").to_pylist()
            for lo in range(0, len(ids), batch):
                todo = list(range(lo, min(lo + batch, len(ids))))
                for attempt in range(attempts):
                    got = answered(model, [ps[i] for i in todo])
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in todo], pa.string()), pa.array([attempt] * len(todo), pa.int32()), pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["prompt_id", "attempt", "text", "error"])
                    todo = [i for i, (t, e) in zip(todo, got, strict=True) if e is not None or (attempt == 0 and not (t or "").strip())]
                    if not todo:
                        break

    return rows.select(F.col("prompt_id").cast("string").alias("prompt_id"), "prompt").mapInArrow(run, "prompt_id string, attempt int, text string, error string")


def chosen_attempt(responses: DataFrame, first_nonempty: bool = False) -> DataFrame:
    """(prompt_id, text): the least attempt that did not fail and is not empty or comes after attempt 0; none: empty text."""
    full = strip(F.coalesce("text", F.lit(""))) != ""
    good = F.col("error").isNull() & (full if first_nonempty else full | (F.col("attempt") > 0))
    return responses.groupBy("prompt_id").agg(F.coalesce(F.min_by("text", F.when(good, F.col("attempt"))), F.lit("")).alias("text"))


#: An item of an array that is an object, its fields by name; other items are null.
FIELDS = "map<string,variant>"


def _items(rows: DataFrame, items: Column) -> DataFrame:
    # an inner explode would be planned behind a filter that parses the response again, below the joins; without items v is null, which is no object
    return rows.select("*", F.posexplode_outer(items).alias("pos", "v")).where("v is not null")


def _entities(rows: DataFrame, key: str, items: Column) -> DataFrame:
    v = F.col("v")
    name, type_ = text_of(v["name"]), F.coalesce(text_of(v["type"]), text_of(v["entity_type"]))
    props = F.try_variant_get(v["properties"], "$", "map<string,string>")
    out = _items(rows.select(key, items.alias("_items")), F.col("_items")).select(key, "pos", strip(name).alias("name"), strip(type_).alias("entity_type"), texts_at(v["aliases"], "$").alias("aliases"), F.coalesce(props, F.create_map().cast("map<string,string>")).alias("properties"))
    return out.where("name is not null and entity_type is not null and name <> ''")


def _triples(rows: DataFrame, key: str, items: Column) -> DataFrame:
    v = F.col("v")
    conf = v["confidence"]
    out = _items(rows.select(key, items.alias("_items")), F.col("_items")).select(
        key, "pos", text_of(v["subject"]).alias("subject"), F.coalesce(text_of(v["predicate"]), text_of(v["relation"])).alias("predicate"), text_of(v["object"]).alias("object"),
        F.coalesce(F.try_variant_get(v["relation_type"], "$", "string"), F.lit("")).alias("relation_type"),
        F.when(is_number(conf), F.try_variant_get(conf, "$", "double")).otherwise(1.0).alias("confidence"),
        F.coalesce(F.try_variant_get(v["properties"], "$", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("properties"),
    )
    return out.where("subject is not null and predicate is not null and object is not null")


def entity_rows(responses: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, pos, name, entity_type, aliases, properties)."""
    return _entities(responses, key, array_in(cleaned(F.col("text")), FIELDS))


def triple_rows(responses: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, pos, subject, predicate, object, relation_type, confidence, properties)."""
    return _triples(responses, key, array_in(cleaned(F.col("text"), to_bracket=True), FIELDS))


def incremental_rows(responses: DataFrame, key: str = "prompt_id") -> tuple[DataFrame, DataFrame]:
    """P10: entities under new_entities or entities, and relations; a payload with no such key is an entity array."""
    t = cleaned(F.col("text"))
    rows = responses.withColumn("_o", object_in(t)).withColumn("_known", F.coalesce(F.try_variant_get("_o", "$.new_entities", "variant"), F.try_variant_get("_o", "$.entities", "variant"), F.try_variant_get("_o", "$.relations", "variant")).isNotNull())
    at = lambda path: F.try_variant_get(F.col("_o"), path, f"array<{FIELDS}>")
    listed = F.when(F.size(at("$.new_entities")) > 0, at("$.new_entities")).otherwise(at("$.entities"))
    return _entities(rows, key, F.when(F.col("_known"), listed).otherwise(array_in(t, FIELDS))), _triples(rows, key, at("$.relations"))


def quality_rows(responses: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, score, issues, missing_entities, missing_triples, suggestions); no object: score 0 and one issue."""
    rows = responses.withColumn("_o", object_in(cleaned(F.col("text"))))
    o = F.col("_o")
    score = F.when(is_number(F.try_variant_get(o, "$.score", "variant")), F.try_variant_get(o, "$.score", "double")).otherwise(0.0)
    lists = [F.when(o.isNull(), F.array(F.lit("unreadable response")) if n == "issues" else F.array().cast("array<string>")).otherwise(texts_at(o, f"$.{n}")).alias(n) for n in ("issues", "missing_entities", "missing_triples", "suggestions")]
    return rows.select(key, F.when(o.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"), *lists)


def annotation_rows(responses: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, trace, payload json): the trace is the think block, else what stands before the fence, else before the brace; no object: no row."""
    raw = F.coalesce("text", F.lit(""))
    o = object_in(cleaned(raw))
    think = strip(F.regexp_extract(raw, r"(?s)<think>(.*?)</think>", 1))
    fence, brace = F.locate("```", raw), F.locate("{", raw)
    trace = F.when(think != "", think).when(fence > 0, strip(F.substring(raw, F.lit(1), fence - 1))).when(brace > 0, strip(F.substring(raw, F.lit(1), brace - 1))).otherwise("")
    return responses.select(key, trace.alias("trace"), o.alias("_o")).where("_o is not null").select(key, "trace", F.to_json("_o").alias("payload"))


def schema_rows(responses: DataFrame, hint: str = "") -> DataFrame:
    """(domain, entity_types, relation_types, constraints) as JSON; what lacks a required field is an empty schema under the hint."""
    o = object_in(cleaned(F.col("text")))
    rows = responses.select(o.alias("o"))
    ok = lambda path, names: F.forall(array_at(F.col("o"), path), lambda x: reduce(and_, [text_at(x, f"$.{n}").isNotNull() for n in names]))
    whole = F.col("o").isNotNull() & ok("$.entity_types", ["name", "label", "definition"]) & ok("$.relation_types", ["name", "label", "definition"])
    part = lambda n: F.when(whole, F.to_json(array_at(F.col("o"), f"$.{n}"))).otherwise("[]").alias(n)
    return rows.select(F.coalesce(F.when(whole, text_at(F.col("o"), "$.domain_name")), F.lit(hint)).alias("domain"), part("entity_types"), part("relation_types"), part("constraints"))
