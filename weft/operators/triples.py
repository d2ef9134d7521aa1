"""Mentions, provenance and triples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions.text import characters, is_phrase, let, plain_name, strip
from .components import Stages

#: Lengths of the grams that names are keyed on: the largest that fits.
GRAMS = (1, 2, 3, 4, 8)
#: Characters of the names of one automaton (some 100 MB in a worker), and automata at most.
SLICE, SLICES = 1 << 21, 8
_automata: dict = {}


def mentions(texts: DataFrame, names: DataFrame, slice_chars: int = SLICE, slices: int = SLICES) -> DataFrame:
    """(key, name) for each of texts(key, content) that contains each of names(name), case-sensitively; blank and null names are in none.

    Names are dealt to slices of at most `slice_chars` characters. A slice becomes an automaton that finds all its names, nested and
    overlapping ones too, while it reads a text once; so texts are read once a slice. What is broadcast is a slice, whose
    size is counted before. Over `slices` slices, or where one name alone is too long, the join on rare grams takes over."""
    n = names.select("name").where("name is not null and name <> ''").distinct()
    total = n.agg(F.sum(F.length("name") + 1)).first()[0]
    if not total:
        return texts.select("key", F.lit("").alias("name")).limit(0)
    count = -(-total * 4 // (slice_chars * 3)) if total > slice_chars else 1  # hashes deal unevenly
    if count > slices:
        return anchored_mentions(texts, n)
    of = n.withColumn("s", F.pmod(F.xxhash64("name"), F.lit(count)))
    if count > 1 and of.groupBy("s").agg(F.sum(F.length("name") + 1).alias("n")).where(F.col("n") > slice_chars).count():
        return anchored_mentions(texts, n)
    return reduce(DataFrame.unionByName, [scanned(texts, of.where(F.col("s") == i).select("name").toArrow()["name"].to_pylist()) for i in range(count)])


def automaton(token: str, names: list[str]):
    """The automaton of these names; a worker keeps the last one that it built."""
    import ahocorasick

    if token not in _automata:
        machine = ahocorasick.Automaton()
        for name in names:
            machine.add_word(name, name)
        machine.make_automaton()
        _automata.clear()
        _automata[token] = machine
    return _automata[token]


def scanned(texts: DataFrame, names: list[str]) -> DataFrame:
    """(key, name) of one slice of names: each text is read once, by an automaton that a worker builds once."""
    shared, token = texts.sparkSession.sparkContext.broadcast(names), uuid.uuid4().hex

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(token, shared.value)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits = {name for _, name in machine.iter(text)} if text else ()
                rows += [i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["key", "name"])

    key = StructField("key", texts.schema["key"].dataType)
    hits = texts.select("key", "content").mapInArrow(find, StructType([key, StructField("name", StringType())]))
    return hits.distinct()


def anchored_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """As mentions, for names of any number: an equi-join. A name is keyed on its rarest gram of 8 characters, shorter names on one of 4
    or fewer; texts post the hashes of their grams of the lengths that occur, as far as some name has them, and hits are verified."""
    n = names.select("name").where("name is not null and name <> ''").distinct()
    # characters are cut out of an array: a substring of a string would be searched from its begin each time
    cut = lambda chars, q: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(chars) - (q - 1)), lambda i: F.xxhash64(F.slice(chars, i, F.lit(q)))))

    def grams(chars: Column, q: int) -> Column:
        return F.when(F.size(chars) >= q, cut(chars, q)).otherwise(F.array().cast("array<bigint>"))

    size = F.array_max(F.filter(F.array(*map(F.lit, GRAMS)), lambda q: q <= F.length("name")))
    lengths = [r["l"] for r in n.select(size.alias("l")).distinct().collect()]  # of GRAMS
    if not lengths:
        return texts.select("key", F.lit("").alias("name")).limit(0)
    every = let(characters("content"), lambda chars: F.flatten(F.array(*[grams(chars, q) for q in sorted(lengths)])))
    # only grams that some name has are posted
    own = Stages()
    wanted = own.keep(n.select("name", F.explode(let(characters("name"), lambda chars: cut(chars, size))).alias("g")))
    posts = own.keep(texts.select("key", F.explode(every).alias("g")).join(wanted.select("g").distinct(), "g", "left_semi"))
    often = posts.groupBy("g").agg(F.count("*").alias("df"))
    anchor = wanted.join(often, "g", "left").groupBy("name").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), "g")).alias("g"))
    return own.done(posts.join(anchor, "g").join(texts.select("key", "content"), "key").where(F.contains("content", "name")).select("key", "name").distinct())


def with_mentions(texts: DataFrame, names: DataFrame, least: int = 2) -> DataFrame:
    """(key, names) of texts with at least `least` mentions."""
    return mentions(texts, names).groupBy("key").agg(F.sort_array(F.collect_set("name")).alias("names")).where(F.size("names") >= least)


def with_provenance(rows: DataFrame, sections: DataFrame, most: int = 200) -> DataFrame:
    """Properties get source_chunk_id and source_text, the section's first `most` characters, unless they are there."""
    fill = F.create_map(F.lit("source_chunk_id"), F.col("chunk_id"), F.lit("source_text"), F.substring("_content", 1, most))
    new = F.map_filter(fill, lambda k, v: ~F.map_contains_key(F.col("properties"), k))
    return rows.join(sections.select("chunk_id", F.col("content").alias("_content")), "chunk_id", "left").withColumn("properties", F.map_concat("properties", new)).drop("_content")


def rolling_context(entities: DataFrame, sections: DataFrame, size: int = 15) -> DataFrame:
    """(doc_id, idx, names): the last `size` entities found before each section. Linear: ranks within the document are joined by number."""
    ranked = entities.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("idx", "ord")))
    here = ranked.groupBy("doc_id", "idx").agg(F.count("*").alias("n"))
    before = sections.select("doc_id", "idx").join(here, ["doc_id", "idx"], "left")
    before = before.select("doc_id", "idx", F.coalesce(F.sum("n").over(W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("c"))
    want = before.where("c > 0").select("doc_id", "idx", F.explode(F.sequence(F.greatest(F.col("c") - size + 1, F.lit(1)), F.col("c"))).alias("r"))
    return want.join(ranked.select("doc_id", "r", "name"), ["doc_id", "r"]).groupBy("doc_id", "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("names"))


def filter_triples(triples: DataFrame, names: DataFrame, allowed: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Plain names; no self-loops; no descriptive phrases outside the entity set; predicate or relation type allowed."""
    t = triples.withColumns({"subject": plain_name("subject"), "object": plain_name("object")}).where("subject <> object")
    known = names.select("name").distinct()
    t = t.join(known.select(F.col("name").alias("subject"), F.lit(True).alias("_s")), "subject", "left").join(known.select(F.col("name").alias("object"), F.lit(True).alias("_o")), "object", "left")
    t = t.where((F.col("_s").isNotNull() | ~is_phrase("subject")) & (F.col("_o").isNotNull() | ~is_phrase("object")))
    t = t.select(*triples.columns)
    if allowed is None:
        return t
    if isinstance(allowed, DataFrame):
        a = allowed.select(F.col(allowed.columns[0]).alias("_a")).distinct()
        return t.join(a.withColumn("_p", F.lit(True)), t["predicate"] == F.col("_a"), "left").drop("_a").join(a.withColumn("_r", F.lit(True)), t["relation_type"] == F.col("_a"), "left").drop("_a").where("_p or _r").select(*triples.columns)
    return t.where(F.col("predicate").isin(*allowed) | F.col("relation_type").isin(*allowed)) if allowed else t


def dedup_triples(triples: DataFrame) -> DataFrame:
    """T5: one row for stripped (subject, predicate, object), none of them blank: largest confidence, first-wins properties, other fields of the first row."""
    key = ["subject", "predicate", "object"]
    t = triples.withColumns({c: strip(c) for c in key}).where("subject <> '' and predicate <> '' and object <> ''")
    # one pass: first by property too, then by triple alone
    t = t.select(*key, "ord", "confidence", "relation_type", "source", F.explode_outer("properties").alias("k", "v"))
    first = lambda c: F.min_by(c, "ord").alias(c)
    whole = [first("relation_type"), first("source"), F.max("confidence").alias("confidence"), F.min("ord").alias("ord")]
    held = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))
    out = t.groupBy(*key, "k").agg(first("v"), *whole).groupBy(*key).agg(F.map_from_entries(F.sort_array(held)).alias("properties"), *whole)
    return out.select("ord", *key, "relation_type", "confidence", "properties", "source")


def new_entities(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Endpoints outside the entity set."""
    ends = triples.select(F.col("subject").alias("name")).unionByName(triples.select(F.col("object").alias("name"))).distinct()
    return ends.join(names.select("name"), "name", "left_anti")


def extract_triples(sections: DataFrame, names: DataFrame, responses: DataFrame, allowed: Sequence[str] | None = None, cross: bool = False) -> DataFrame:
    """Mentions, chosen responses, rows, provenance, filters, dedup. responses(chunk_id, attempt, text, error).
    T7, cross: one response a document, under its id, of documents with two sections; filtered, not deduplicated."""
    from .responses import chosen_attempt, triple_rows

    if cross:
        many = sections.groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 2").select(F.col("doc_id").cast("string").alias("chunk_id"))
        picked = chosen_attempt(responses.withColumnRenamed("chunk_id", "prompt_id"), first_nonempty=True)
    else:
        many = with_mentions(sections.select(F.col("chunk_id").alias("key"), "content"), names).select(F.col("key").alias("chunk_id"))
        picked = chosen_attempt(responses.withColumnRenamed("chunk_id", "prompt_id"))
    rows = triple_rows(picked.withColumnRenamed("prompt_id", "chunk_id").join(many, "chunk_id", "left_semi"), "chunk_id")
    if not cross:
        rows = with_provenance(rows, sections)
    rows = rows.withColumn("ord", F.struct("chunk_id", "pos")).withColumn("source", F.col("chunk_id"))
    kept = filter_triples(rows, names, allowed)
    return kept if cross else dedup_triples(kept)
