"""Loops over hops, keys and decisions against literal graphs; empty input; files."""

import json

import pytest
from pyspark.sql import functions as F

from weft.operators import batch, evidence, graph, reasoning, sections, triples
from weft.sources import files

NODE = "node_id string, label string, name string, properties map<string,string>"
EDGE = "edge_id string, src string, dst string, type string, confidence double, source_chunk_id string, source_text string"


def graph_of(spark, edges, labels=None):
    ids = sorted({x for e in edges for x in e[:2]} | set(labels or {}))
    nodes = spark.createDataFrame([(i, (labels or {}).get(i, "Thing"), f"name {i}", {"description": f"about {i}"}) for i in ids], NODE)
    rows = [(f"e{k}", a, b, t, c, f"c{k}", f"text {k}") for k, (a, b, t, c) in enumerate(edges)]
    return nodes, spark.createDataFrame(rows, EDGE)


def walked(df):
    return sorted((r["hop"], r["node"], r["other"]) for r in df.collect())


def test_plan_hop_reaches_labels_against_the_edges(spark):
    nodes, edges = graph_of(spark, [("S1", "P1", "t", 1.0), ("S1", "N1", "t", 1.0), ("C1", "N1", "t", 1.0)], {"C1": "Customer"})
    keys = spark.createDataFrame([(1, "P1"), (2, "P1")], "question_id long, node string")
    steps = spark.createDataFrame([(1, "Customer", None, "both"), (2, "Nowhere", "t", "in")], "question_id long, target_type string, relation_hint string, direction string")
    got = reasoning.plan_hop(keys, steps, edges, nodes).collect()
    assert sorted((r["level"], r["node"], r["other"]) for r in got if r["question_id"] == 1) == [(3, "N1", "C1"), (3, "P1", "S1"), (3, "S1", "N1")]
    assert [(r["level"], r["other"]) for r in got if r["question_id"] == 2] == [(4, "S1")]


STEP = "question_id long, step int, action string, target_type string, relation_hint string, direction string"


def test_plans_chain_paths_and_fall_back(spark):
    nodes, edges = graph_of(spark, [("b", "a", "t", 0.9), ("b", "c", "t", 0.9), ("x", "y", "t", 0.9)])
    plans = spark.createDataFrame([(1, 0, "c"), (1, 1, "a"), (1, 2, "b"), (2, 0, "x"), (2, 1, "a"), (3, 0, "y")], "question_id long, ord int, node string")
    steps = spark.createDataFrame([(1, 0, "find_by_path", None, None, "both"), (2, 0, "find_by_path", None, None, "both"), (3, 0, "find_neighbors", None, "no type", "both")], STEP)
    out = reasoning.run_plans(plans, steps, edges, nodes).collect()
    # c to a over b, then a to b: three hops in the order of travel; nothing for the others
    assert sorted((r["question_id"], r["hop"], r["node"], r["other"]) for r in out) == [(1, 1, "c", "b"), (1, 2, "b", "a"), (1, 3, "a", "b")]
    again = reasoning.run_plans(plans, steps, edges, nodes, fallback=True).where("question_id > 1").collect()
    assert sorted((r["question_id"], r["hop"], r["node"], r["other"]) for r in again) == [(2, 1, "x", "y"), (3, 1, "y", "x")]
    assert reasoning.run_plans(plans.where("false"), steps.where("false"), edges, nodes).count() == 0
    assert walked(reasoning.run_plans(plans.where("question_id = 3"), steps.where("false"), edges, nodes)) == [(1, "y", "x")]


DECISION = "question_id long, hop int, go_on boolean, next_entities array<string>, relation_filter string"
REFLECTION = "question_id long, hop int, action string, suggested array<string>"


def test_decisions_keep_edges_into_what_is_chosen(spark):
    nodes, edges = graph_of(spark, [("a", "b", "t", 0.8), ("b", "c", "t", 0.6), ("d", "a", "t", 0.9), ("a", "e", "t", 0.9)])
    start = spark.createDataFrame([(1, "a")], "question_id long, node string")
    say = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], DECISION)
    out = reasoning.run_guided(start, edges, nodes, decisions=say((1, True, ["name b", "nobody"], None), (2, True, ["name c", "name a"], None)))
    assert walked(out)[:2] == [(1, "a", "b"), (2, "b", "c")]
    # d is chosen, but the edge leads from it: no edge stays, and it goes on from d
    assert walked(reasoning.run_guided(start, edges, nodes, hops=1, decisions=say((1, True, ["name d"], None)))) == []
    # the chain falls under 0.5 at the second hop
    assert max(h for h, *_ in walked(out)) == 2
    stop = reasoning.run_guided(start, edges, nodes, decisions=say((1, False, ["name b"], None)))
    assert walked(stop) == [(1, "a", "b")]
    assert reasoning.run_guided(start, edges, nodes, hops=0).count() == 0


def test_reflections_turn_back_and_switch(spark):
    nodes, edges = graph_of(spark, [("a", "b", "t", 0.9), ("a", "c", "t", 0.9), ("c", "d", "t", 0.9), ("b", "e", "t", 0.9)])
    start = spark.createDataFrame([(i, "a") for i in (1, 2, 3)], "question_id long, node string")
    say = spark.createDataFrame([(i, h, True, [f"name {x}"], None) for i in (1, 2, 3) for h, x in ((1, "b"), (2, "e"))], DECISION)
    think = spark.createDataFrame([(1, 1, "backtrack", ["name c", "name z"]), (2, 2, "backtrack", []), (3, 1, "switch", ["name c"])], REFLECTION)
    out = reasoning.run_guided(start, edges, nodes, decisions=say, reflections=think)
    by = {i: walked(out.where(F.col("question_id") == i)) for i in (1, 2, 3)}
    assert by[1][0] == (1, "a", "b") and all(n == "c" for h, n, _ in by[1] if h == 2)  # went on from c, and not from b
    assert by[2] == [(1, "a", "b")]  # the chain of hop 1 was the more confident one
    assert by[3][0] == (1, "a", "b") and all(n == "c" for h, n, _ in by[3] if h == 2)
    back = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.8), (1, 3, 0.8)], "question_id long, hop int, confidence double")
    assert reasoning.best_so_far(back).first()["hop"] == 2


def test_no_hops_and_no_keys(spark):
    nodes, edges = graph_of(spark, [("a", "b", "t", 0.8)])
    pairs = spark.createDataFrame([(1, "a", "b")], "question_id long, start string, end string")
    assert graph.shortest_paths(pairs, edges, 0).count() == 0
    near, met = graph.node_context(pairs.select("question_id", F.col("start").alias("node")), edges, nodes, 0)
    assert near.count() == met.count() == 0
    near, met = graph.node_context(pairs.select("question_id", F.col("start").alias("node")), edges, nodes, 3)
    assert sorted((r["level"], r["node"]) for r in near.collect()) == [(1, "b"), (2, "a")] and met.count() == 2


def test_chains_of_questions_without_edges(spark):
    edges = spark.createDataFrame([(1, 1, 1, "A", "r", "B", None)], "question_id long, hop int, ord int, source string, type string, target string, confidence double")
    nodes = spark.createDataFrame([(2, 1, 2, "Y"), (2, 1, 1, "X")], "question_id long, hop int, ord int, name string")
    q = spark.createDataFrame([(1,), (2,), (3,)], "question_id long")
    got = {r["question_id"]: (r["n_edges"], r["confidence"], r["path"], r["description"]) for r in evidence.chains(edges, q, nodes).collect()}
    assert got == {1: (1, 1.0, ["A", "B"], "A --r--> B"), 2: (0, 1.0, ["X", "Y"], "X -- Y"), 3: (0, 1.0, [], "")}


def test_chain_records(spark):
    edges = spark.createDataFrame([(1, 1, 1, 'A "q"', "r", "B", 0.5, "c1", "x < y"), (1, 2, 2, "B", "s", "C", 0.5, "", "")], "question_id long, hop int, ord int, source string, type string, target string, confidence double, source_chunk_id string, source_text string")
    nodes = spark.createDataFrame([(1, 1, 1, "B", "L", {"description": "d & e"})], "question_id long, hop int, ord int, name string, label string, properties map<string,string>")
    steps, front = evidence.append_hop(edges)
    assert [r["name"] for r in front.collect()] == ["C"]
    chain = json.loads(evidence.chain_json(edges, nodes).first()["chain"])
    assert [e["target"] for e in chain["edges"]] == ["B", "C"] and [n["name"] for n in chain["nodes"]] == ["B"]
    heads = spark.createDataFrame([(1, "A", None, 0.25)], "question_id long, start string, end string, confidence double")
    xml = evidence.chain_xml(edges, nodes, steps, heads).first()["xml"]
    assert "source='A \"q\"'" in xml and "<source_text>x &lt; y</source_text>" in xml and ">d &amp; e</entity>" in xml and 'confidence="0.25"' in xml and xml.count("<hop ") == 2


def test_batch_isolates_failures(spark):
    nodes, edges = graph_of(spark, [("a", "b", "t", 0.5)], {"a": "Thing", "b": "Thing"})
    q = spark.createDataFrame([(1, "“name a”"), (2, "“name b”"), (3, "nothing known"), (4, None)], "question_id long, text string")

    def model(prompts):
        if "“name b”" in prompts[0]:
            raise RuntimeError("no")
        return ["a long enough answer. 分析:one" for _ in prompts]

    got = {r["question_id"]: r for r in batch.answer_batch(q, nodes, edges, model).collect()}
    assert {i: r["status"] for i, r in got.items()}[2] == "FAILED" and got[2]["error"] == "no" and got[2]["answer"] is None
    assert got[1]["status"] == got[3]["status"] == "DONE" and got[1]["confidence"] == 0.5 and got[1]["steps"] == ["one"] and len(got) == 4


def test_sections_keep_control_characters(spark):
    text = "a\u0001b\n# T\u0002t\nbody \u0003\u0004x"
    got = [(r["heading_chain"], r["content"]) for r in sections.split_sections(spark.createDataFrame([(1, text)], "doc_id long, content string")).orderBy("idx").collect()]
    assert got == [([], "a\u0001b"), (["T\u0002t"], "body \u0003\u0004x")]


def test_mentions_of_every_length(spark):
    names = ["a", "ab", "abc", "abcd", "abcde", "abcdefg", "abcdefgh", "abcdefghijkl", "日本語の長い名前です", "zzzzzzzzzz"]
    texts = [(i, "…" + n + "…") for i, n in enumerate(names)] + [(90, None), (91, ""), (92, "abcdefgXabcdefgh" + "é" * 5000 + "ab")]
    got = {tuple(r) for r in triples.mentions(spark.createDataFrame(texts, "key long, content string"), spark.createDataFrame([(n,) for n in [*names, "", None]], "name string")).collect()}
    assert got == {(i, n) for i, t in texts for n in names if n in (t or "")}


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("Hello ![](data:image/png;base64,AA==) World")
    (tmp_path / "b.bin").write_bytes(b"\0")
    got = files.scan_directory(spark, str(tmp_path), "*.md").collect()
    assert [(r["filename"], r["content"]) for r in got] == [("a.md", "Hello [图片] World")]
    assert files.scan_file(spark, str(tmp_path / "a.md"), ".MD").count() == 1
    assert files.scan_directory(spark, str(tmp_path), "*.bin", text=False).first()["content"] == b"\0"
    with pytest.raises(FileNotFoundError):
        files.scan_file(spark, str(tmp_path / "none.md"))
    with pytest.raises(ValueError):
        files.scan_file(spark, str(tmp_path / "b.bin"), ".md")
    with pytest.raises(ValueError):
        files.scan_file(spark, str(tmp_path))
    rows = spark.createDataFrame([("c", "t", None, None, None)], files.ANNOTATION)
    files.write_jsonl(rows, str(tmp_path / "out"))
    r = files.read_annotations(spark, str(tmp_path / "out")).first()
    assert (r["trace"], r["entities"], r["triples"]) == ("", [], [])
    (tmp_path / "samples.json").write_text('{"conversation": "x", "task_type": "k"}\n\n{"text": "y"}\n')
    assert sorted(r["text"] for r in files.read_samples(spark, str(tmp_path / "samples.json")).collect()) == ["x", "y"]
    schema = {"domain_name": "d", "entity_types": [{"name": "n", "label": "l", "definition": "x"}], "relation_types": [], "constraints": [{"source_type": "n", "relation": "r", "target_type": "n"}]}
    (tmp_path / "schema.json").write_text(json.dumps(schema))
    parts = files.read_schema(spark, str(tmp_path / "schema.json"))
    assert parts["entity_types"].first()["name"] == "n" and parts["constraints"].first()["relation"] == "r"
    files.write_schema(parts, "d", str(tmp_path / "again"))
    assert files.read_schema(spark, str(tmp_path / "again"))["entity_types"].count() == 1
    (tmp_path / "schema.json").write_text(json.dumps(schema | {"entity_types": [{"name": "n"}]}))
    with pytest.raises(ValueError):
        files.read_schema(spark, str(tmp_path / "schema.json"))
    nodes, edges = graph_of(spark, [("a", "b", "t", 0.5)])
    graph.write_graph(nodes, edges, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph/edges")).count() == 1
