"""The first edges of a key are chosen by the ends of edges alone; whole edges move only where they can be among the first."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import components, graph, reasoning

E = "edge_id string, src string, dst string, type string, confidence double, source_chunk_id string, source_text string"


def tables(spark):
    """A graph with hubs, parallel edges, loops, edges into the unknown, and names that are shared or missing."""
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(60)]
    names = {n: None if i % 17 == 0 else f"x{rng.randrange(25)}" for i, n in enumerate(ids)}
    rows = []
    for i in range(900):
        a, b = rng.choice(ids[: 5 if i % 3 else 60]), rng.choice([*ids, "gone"])
        rows.append((f"e{rng.random()}", a, b, rng.choice("pqr"), rng.choice([None, 0.5, 1.0]), None, "t"))
    nodes = spark.createDataFrame([(n, "AB"[i % 2], names[n]) for i, n in enumerate(ids)], "node_id string, label string, name string")
    return rows, names, spark.createDataFrame(rows, E), nodes


def first(rows, names, node, limit, such=lambda x: True):
    ends = [(r, r[2]) for r in rows if r[1] == node] + [(r, r[1]) for r in rows if r[2] == node and r[1] != node]
    ends = [(names[o] is not None, names[o] or "", r[3], r[0], o) for r, o in ends if o in names and such(r)]
    return sorted((e, o) for _, _, _, e, o in sorted(ends)[:limit])


@pytest.mark.parametrize("pairs", [1, 1 << 17])
def test_first_edges_by_their_ends(spark, monkeypatch, pairs):
    rows, names, edges, nodes = tables(spark)
    kept = []
    monkeypatch.setattr(graph, "PAIRS", pairs, raising=False)
    monkeypatch.setattr(graph, "checkpointed", lambda df: kept.append(df.columns) or components.checkpointed(df))
    keys = spark.createDataFrame([(q, f"n{q % 30}") for q in range(70)], "question_id int, node string")
    got = {}
    for r in graph.neighbours(keys, edges, nodes, limit=7).collect():
        got.setdefault((r["question_id"], r["node"]), []).append((r["edge_id"], r["other"]))
    want = {(q, f"n{q % 30}"): first(rows, names, f"n{q % 30}", 7) for q in range(70)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert kept == [["node", "other"]]
    typed = graph.neighbours(keys, edges, nodes, type_="p", label="A", direction="out", limit=3)
    assert typed.where("type <> 'p' or other_label <> 'A' or src <> node").isEmpty() and typed.groupBy("question_id").count().agg(F.max("count")).first()[0] == 3


@pytest.mark.parametrize("pairs", [1, 1 << 17])
def test_beams_and_plans_choose_by_ends(spark, monkeypatch, pairs):
    rows, names, edges, nodes = tables(spark)
    monkeypatch.setattr(graph, "PAIRS", pairs, raising=False)
    kept = []
    monkeypatch.setattr(graph, "checkpointed", lambda df: kept.append(df.columns) or components.checkpointed(df))
    keys = spark.createDataFrame([(q, f"n{q}") for q in range(12)], "question_id int, node string")
    hints = spark.createDataFrame([(q, t) for q in range(0, 12, 2) for t in "pq"], "question_id int, type string")
    wished = keys.join(hints.groupBy("question_id").agg(F.array_sort(F.collect_set("type")).alias("wish")), "question_id", "left").withColumn("wish", F.coalesce("wish", F.array().cast("array<string>"))).withColumn("conf", F.lit(1.0))
    got = reasoning.Around(wished, edges, nodes, 6).of(wished).groupBy("question_id").agg(F.collect_list(F.struct("edge_id", "other")).alias("x"))
    want = {q: first(rows, names, f"n{q}", 6, (lambda r: r[3] in "pq") if q % 2 == 0 else lambda r: True) for q in range(12)}
    assert {r["question_id"]: sorted(map(tuple, r["x"])) for r in got.collect()} == {q: x for q, x in want.items() if x}
    steps = keys.select("question_id", F.lit(None).cast("string").alias("target_type"), F.lit("p").alias("relation_hint"), F.lit("out").alias("direction"))
    hop = reasoning.plan_hop(keys, steps, edges, nodes, 4).groupBy("question_id").agg(F.collect_list(F.struct("edge_id", "other")).alias("x"))
    want = {q: first([r for r in rows if r[1] == f"n{q}"], names, f"n{q}", 4, lambda r: r[3] == "p") for q in range(12)}
    assert {r["question_id"]: sorted(map(tuple, r["x"])) for r in hop.collect()} == {q: x for q, x in want.items() if x}
    assert kept == [["node", "wish", "other"]] * 2


def test_sieve_keeps_every_pair(spark):
    rows, _, edges, _ = tables(spark)
    around = graph.incident(edges)
    near = around.select("node", "other").distinct().where("xxhash64(node, other) % 10 = 0")
    got = graph.sieved(around, near, near.count())
    assert got.columns == around.columns
    assert got.join(near, ["node", "other"], "left_semi").count() == around.join(near, ["node", "other"], "left_semi").count()
    assert got.count() < around.count() / 2


def test_contexts_write_no_second_copy_of_the_edges(spark, monkeypatch):
    rows, names, edges, nodes = tables(spark)
    kept = []
    monkeypatch.setattr(components, "checkpointed", lambda df, real=components.checkpointed: kept.append(df.columns) or real(df))
    keys = spark.createDataFrame([(0, "n1"), (1, "n2")], "question_id int, node string")
    _, out = graph.node_context(keys, edges, nodes, 1, 5)
    got = {}
    for r in out.collect():
        got.setdefault(r["start"], []).append((r["edge_id"], r["other"]))
    assert {k: sorted(v) for k, v in got.items()} == {n: first(rows, names, n, 5) for n in ("n1", "n2")}
    assert not [c for c in kept if "edge_id" in c and "level" not in c]
