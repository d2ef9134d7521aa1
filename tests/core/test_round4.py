"""Work that grows with the rows: ends of texts, JSON items, products in order, one pass for duplicates."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weft.functions import json
from weft.functions.text import strip
from weft.operators import evidence, graph, responses, triples
from weft.plans import fixtures

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_takes_what_python_takes_and_tries_no_pattern(spark):
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string").select("c", strip(F.concat("c", F.lit("q"), "c", F.lit("q"), "c")).alias("s"))
    assert [r["c"] for r in df.collect() if r["s"] != f"{r['c']}q{r['c']}q{r['c']}".strip()] == []
    assert "regexp" not in plan(df)


def test_items_are_read_once_as_fields(spark):
    rows = ['[{"subject":"a","predicate":"p","object":"c","confidence":"high"},3,{"subject":"x","relation":"r","object":"z","confidence":0.5}]', "[1],[2]", "[1],false]", f'[1],"{json.CLOSE}"]', "nothing here", '[{"subject":"a","predicate":"p","object":"c"}, {"subject": "x']
    df = responses.triple_rows(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "prompt_id int, text string"))
    got = [(r["prompt_id"], r["pos"], r["subject"], r["predicate"], r["confidence"]) for r in df.orderBy("prompt_id", "pos").collect()]
    assert got == [(0, 0, "a", "p", 1.0), (0, 2, "x", "r", 0.5), (5, 0, "a", "p", 1.0)]
    assert "schema_of_variant(try_variant_get" not in plan(df)


def test_strict_reads_texts_with_the_closing_word(spark):
    texts = [f'"{json.CLOSE}"', f'1,"{json.CLOSE}"', f'1,"{json.CLOSE}"],[', "1,2", " [1] ", "", "  ", "nul", "null x", '{"a":1}', '{"a":1},2', "-2.5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.to_json(json.strict(F.col("t"))).alias("v"))
    assert {r["i"]: r["v"] for r in df.where("v is not null").collect()} == {0: f'"{json.CLOSE}"', 4: "[1]", 9: '{"a":1}', 11: "-2.5"}


def test_products_in_order_across_batches(spark):
    rng = random.Random(5)
    rows = [(q, o % 2, o, rng.random()) for q in range(60) for o in range(rng.choice([1, 2, 3, 70, 200]))]
    df = spark.createDataFrame(rows, "question_id int, hop int, ord int, confidence double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["question_id"]: (r["n_edges"], r["confidence"]) for r in evidence.chain_totals(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {}
    for q, _, _, c in sorted(rows):
        n, p = want.get(q, (0, 1.0))
        want[q] = (n + 1, p * c)
    assert got == want
    values = np.array([rng.random() for _ in range(1000)])
    starts = evidence.begins(pa.array([i // 100 for i in range(1000)]))
    product = 1.0
    for x in values[:100].tolist():
        product *= x
    assert len(starts) == 10 and evidence.in_order(values, starts)[0] == product


def test_duplicates_are_merged_in_one_pass(spark):
    rows = [(1, "a ", "p", "b", "r", 0.5, {"x": "1"}, "s1"), (2, "a", "p", "b", "q", 0.9, {"x": "2", "y": "3"}, "s2"), (3, "c", "p", "d", "r", 0.1, {}, "s3"), (4, "c", "p", "d", "r", 0.2, None, "s4"), (5, " ", "p", "d", "r", 0.2, None, "s5")]
    df = spark.createDataFrame(rows, "ord int, subject string, predicate string, object string, relation_type string, confidence double, properties map<string,string>, source string")
    out = triples.dedup_triples(df)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", "p", "b", "r", 0.9, {"x": "1", "y": "3"}, "s1"), (3, "c", "p", "d", "r", 0.2, {}, "s3")]
    assert plan(out).count("LogicalRDD") + plan(out).count("LocalRelation") == 1


def test_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS", 100)
    df = spark.range(1000).withColumn("k", F.col("id") % 70)
    assert fixtures.dealt(df, "k").rdd.getNumPartitions() == 10
    got = fixtures.edges(spark, SF, spread=True)
    line = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert "hashpartitioning(l_suppkey" in got._jdf.queryExecution().executedPlan().toString() and f", {-(-line // 100)})" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, graph.degrees(got).collect())) == sorted(map(tuple, graph.degrees(fixtures.edges(spark, SF)).collect()))
