"""The store, retries, one-pass counts, chains and long documents."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weft.operators import entities, evidence, graph, reasoning, responses, sections, stats, store
from weft.plans import tables

from .test_core import ENTITY, greedy

SF = "/root/testdata/sf0.001"


@pytest.fixture
def made(spark, tmp_path):
    opened = []

    def make(name="one"):
        s = store.GraphStore(spark, f"t{len(opened)}{random.randrange(1 << 30)}", str(tmp_path / name), parts=4, buckets=3)
        opened.append(s)
        return s

    yield make
    for s in opened:
        for t in ("nodes", "ways"):
            spark.sql(f"DROP TABLE IF EXISTS {s.name}_{t}")


def small_graph(spark, seed=2):
    rng = random.Random(seed)
    e = spark.createDataFrame([(i, f"n{rng.randint(0, 30)}", rng.choice("ab"), [f"x{i}"], {rng.choice("pq"): str(i)}) for i in range(80)] + [(99, " ", "a", [], {})], ENTITY)
    rows = [(f"e{i}", f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}", rng.choice("uv")) for i in range(90)]
    return e, spark.createDataFrame(rows, "edge_id string, src string, dst string, type string")


def seen(df):
    return sorted(repr(tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r)) for r in df.collect())


def test_batches_upserted_equal_a_rebuild(spark, made):
    e, edges = small_graph(spark)
    parts = made()
    nodes, _ = graph.upsert_nodes(e.where("ord < 40"))
    parts.write(nodes, edges.where("type = 'u'"))
    rejects = parts.upsert(e.where("ord >= 40"))
    parts.add_edges(edges.where("type = 'v'"))
    parts.add_edges(edges.where("type = 'v'"))
    assert [(r["ord"], r["reason"]) for r in rejects.collect()] == [(99, "blank name")]
    whole = graph.upsert_nodes(e)[0]
    assert seen(parts.nodes().select(*whole.columns)) == seen(whole)
    assert seen(parts.edges().select(*edges.columns)) == seen(edges)
    again = store.GraphStore(spark, parts.name + "again", parts.path, parts.parts, parts.buckets)
    again.open("node_id STRING, label STRING, name STRING, properties MAP<STRING, STRING>", "node STRING, other STRING, edge_id STRING, src STRING, dst STRING, type STRING")
    assert seen(again.edges().select(*edges.columns)) == seen(edges)


def test_a_batch_rewrites_only_touched_partitions(spark, made, tmp_path):
    e, edges = small_graph(spark)
    s = made()
    s.write(graph.upsert_nodes(e)[0], edges)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "one" / "nodes").rglob("part=*/*.parquet")}
    before = files()
    s.upsert(spark.createDataFrame([(500, "n1", "a", [], {"p": "new"})], ENTITY))
    kept = before.items() & files().items()
    assert kept and len(kept) < len(before)
    assert s.nodes().where("name = 'n1' and label = 'a'").first()["properties"]["p"] == "new"


def test_hop_joins_read_the_store_without_an_exchange(spark, made):
    _, edges = small_graph(spark)
    s = made()
    s.write(graph.upsert_nodes(small_graph(spark)[0])[0], edges)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        front = spark.createDataFrame([(1, "n1"), (2, "n2")], "question_id long, node string")
        plan = front.join(s.ways(), "node")._jdf.queryExecution().executedPlan().toString()
        named = front.withColumnRenamed("node", "name").join(s.nodes(), "name")._jdf.queryExecution().executedPlan().toString()
        plain = front.join(graph.incident(edges), "node")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert (plan.count("Exchange hashpartitioning"), named.count("Exchange hashpartitioning"), plain.count("Exchange hashpartitioning")) == (1, 1, 2)


def test_one_bad_prompt_is_one_error_row(spark):
    calls = []

    def model(ps):
        calls.append(len(ps))
        if "bad" in ps:
            raise ValueError("no")
        return [p.upper() for p in ps]

    assert responses.answered(model, ["a"] * 20 + ["bad"] + ["b"] * 11) == [("A", None)] * 20 + [(None, "no")] + [("B", None)] * 11
    assert len(calls) <= 11
    assert responses.answered(lambda ps: ["one"], ["a", "b"]) == [("one", None)] * 2 and responses.answered(model, []) == []
    rows = spark.createDataFrame([(i, "bad" if i == 7 else "" if i == 9 else "x") for i in range(32)], "prompt_id long, prompt string").coalesce(1)

    def plain(ps):
        if "bad" in ps:
            raise ValueError("no")
        return [p.upper() for p in ps]

    got = responses.infer(rows, plain).collect()
    assert [(r["prompt_id"], r["error"]) for r in got if r["error"]] == [("7", "no")] and len(got) == 32
    tries = [(r["prompt_id"], r["attempt"], r["text"], r["error"]) for r in responses.infer(rows, plain, attempts=3).collect() if r["prompt_id"] in "79"]
    assert sorted(tries) == [("7", 0, None, "no"), ("7", 1, None, "no"), ("7", 2, None, "no"), ("9", 0, "", None), ("9", 1, "", None)]


def test_reduction_counts_while_it_writes(spark):
    counts, out = stats.reduction(spark.range(100), [("even", lambda d: d.where("id % 2 = 0")), ("tens", lambda d: d.where("id % 10 = 0"))])
    assert [tuple(r) for r in counts.orderBy("pos").collect()] == [(0, "raw", 100), (1, "even", 50), (2, "tens", 10)] and out.count() == 10
    counts, out = stats.reduction(spark.range(3), [])
    assert [tuple(r) for r in counts.collect()] == [(0, "raw", 3)] and out.count() == 3


def test_totals_of_long_chains(spark):
    many = spark.range(200_000).select(F.lit(1).cast("long").alias("question_id"), F.lit(1).alias("hop"), (199_999 - F.col("id")).alias("ord"), F.when(F.col("id") % 2 == 0, 1.0).alias("confidence"))
    few = spark.createDataFrame([(2, 1, 1, 0.5), (2, 1, 0, 0.1), (3, 2, 0, None), (None, 1, 1, 0.25)], "question_id long, hop int, ord long, confidence double")
    got = {r["question_id"]: (r["n_edges"], r["confidence"]) for r in evidence.chain_totals(many.unionByName(few)).collect()}
    assert got == {1: (200_000, 1.0), 2: (2, 0.1 * 0.5), 3: (1, 1.0), None: (1, 0.25)} and evidence.chain_totals(few.where("false")).count() == 0


def test_similar_classes_count_every_link(spark):
    rng = random.Random(8)
    names = ["".join(rng.choices("abA ", k=rng.randint(0, 7))) for _ in range(150)] + [None]
    got = {r["ord"]: (r["class"], r["links"]) for r in entities.similar_classes(entities.canonical(spark.createDataFrame([(i, n, "t", None, {}) for i, n in enumerate(names)], ENTITY)), 0.5).collect()}
    flat = ["".join(n.lower().split()) for n in names[:-1]]
    grams = [frozenset(n[i : i + 2] for i in range(len(n) - 1)) for n in flat]

    def like(i, j):
        if not flat[i] or not flat[j]:
            return False
        if not grams[i] or not grams[j]:
            return flat[i] == flat[j]
        return len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.5

    assert {i: n for i, (_, n) in got.items()} == {i: sum(like(i, j) for j in range(150) if j != i) for i in range(150)}
    assert all(c == (min(j for j in range(150) if grams[j] == grams[i]) if grams[i] else i if not flat[i] else flat.index(flat[i])) for i, (c, _) in got.items())


def test_numbered_names_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(entities, "BLOCK", 100)
    monkeypatch.setattr(entities, "HEAVY", 40)
    joined, rows = entities._reaching, []

    def counted(near, *args):
        rows.append(near.count())
        return joined(near, *args)

    monkeypatch.setattr(entities, "_reaching", counted)
    names = [f"Supplier#{i:06d}" for i in range(400)] + ["Supplier#000007", "quartz vial", "quartz vials", "Suppli", "a", "A", ""]
    got = entities.similar_classes(entities.canonical(spark.createDataFrame([(i, n, "t", None, {}) for i, n in enumerate(names)], ENTITY)), 0.6).collect()
    flat = ["".join(n.lower().split()) for n in names]
    grams = [{n[i : i + 2] for i in range(len(n) - 1)} for n in flat]
    like = lambda i, j: flat[i] == flat[j] != "" if not grams[i] or not grams[j] else len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.6
    assert {r["ord"]: r["links"] for r in got} == {i: sum(like(i, j) for j in range(len(names)) if j != i) for i in range(len(names))}
    # no row for a pair of numbered names
    assert rows and sum(rows) < len(names)


def test_near_suppliers_merge_as_one_by_one(spark):
    rows = []
    for r in sorted(spark.read.parquet(f"{SF}/supplier.parquet").collect()):
        k, name = r["s_suppkey"], r["s_name"]
        props = {"nation": "1"} | ({} if k % 5 == 0 else {"balance": str(r["s_acctbal"])})
        rows.append((k, name[:-1] + "x" if k % 7 == 0 else name, f"of nation {r['s_nationkey']}", [], props))
    got = tables.e10_near_suppliers(spark, SF).collect()
    assert sorted((r["ord"], r["name"], r["entity_type"], r["aliases"], r["n_merged"]) for r in got) == [(o, n, t, "|".join(a), c) for o, n, t, a, _, c in greedy(rows, 0.85, (0.5, 0.3, 0.2))]


def test_sections_of_many_headings_take_time_in_proportion(spark):
    def took(n):
        text = "".join(f"{'#' * (1 + i % 3)} title {i}\nbody of {i}\n" for i in range(n))
        began = time.time()
        got = sections.split_sections(spark.createDataFrame([(1, text)], "doc_id long, content string"))
        assert got.count() == n
        assert got.where(f"idx = {n - 1}").first()["content"] == f"body of {n - 1}"
        return time.time() - began

    took(2000)
    a, b = took(16_000), took(32_000)
    assert b < 3 * a + 3


def test_folds_cross_their_blocks(spark):
    words = [f"w{i}" for i in range(1000)]
    got = spark.createDataFrame([(words,), ([],), (["a"],)], "c array<string>").select(sections.merge_small(F.col("c"), 50)).collect()
    want, now = [], ""
    for w in words:
        if now and len(now) + len(w) + 2 <= 50:
            now += "\n\n" + w
        else:
            want, now = want + ([now] if now else []), w
    assert [r[0] for r in got] == [[*want, now], [], ["a"]]


def test_batch_follows_what_a_model_said(spark):
    from weft.operators import batch

    nodes = spark.createDataFrame([(i, "T" if i != "d" else "Topic", i.upper() * 3, {}) for i in "abcd"], "node_id string, label string, name string, properties map<string,string>")
    rows = [("e1", "a", "b", "x", 0.9, "c1", "one"), ("e2", "b", "c", "x", 0.5, "c2", "two"), ("e3", "d", "c", "x", 1.0, None, None)]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, type string, confidence double, source_chunk_id string, source_text string")
    q = spark.createDataFrame([(1, "what of AAA"), (2, "what of DDD"), (3, "refuse BBB")], "question_id long, text string")
    plan = lambda *starts: '{"start_entities": [%s], "steps": [{"action": "find_neighbors", "direction": "in"}]}' % ", ".join(f'"{s}"' for s in starts)  # noqa: E731, UP031
    plans = spark.createDataFrame([(1, plan("AAA")), (2, plan("DDD")), (3, plan("BBB"))], "question_id long, response string")
    decisions = spark.createDataFrame([(1, 1, True, ["BBB", "ZZZ"], None), (1, 2, True, ["CCC"], None)], "question_id long, hop int, go_on boolean, next_entities array<string>, relation_filter string")
    prompts, heads = batch.prompt_batch(q, nodes, edges, plan_responses=plans, abstract=["Topic"], decisions=decisions)
    got = {r["question_id"]: r["prompt"] for r in prompts.collect()}
    assert all(x in got[1] for x in ('source="AAA" relation="x" target="BBB"', 'source="BBB" relation="x" target="CCC"', "[1] (c1) one", "[2] (c2) two", 'confidence="0.45"'))
    assert "<edge" not in got[2] and 'target="BBB"' in got[3]

    def model(ps):
        if any("refuse" in p for p in ps):
            raise RuntimeError("refused")
        return [f"{len(p)} characters are enough of a prompt" for p in ps]

    out = {r["question_id"]: (r["status"], r["error"]) for r in batch.answer_batch(q, nodes, edges, model, plan_responses=plans, abstract=["Topic"], decisions=decisions).collect()}
    assert out == {1: ("DONE", None), 2: ("DONE", None), 3: ("FAILED", "refused")}


def model_plain(text, most):
    """Sections of a text without headings, in plain Python: paragraphs, else merged lines, else by size."""
    from .test_core import model_sections

    strips = lambda xs: [x.strip() for x in xs if x.strip()]
    sized = lambda t: [c for _, _, c in model_sections(t, most)]
    if not text.strip():
        return []

    def pieces(parts):
        # what is too long goes to sentences: a lone paragraph that is over the size
        return [x for p in parts for x in ([p] if len(p) <= most else by_sentences(p, most))]

    strong, weak = strips(text.split("\n\n")), strips(text.split("\n"))
    if len(strong) > 1:
        return pieces(strong)
    if len(weak) > 1:
        out, now = [], ""
        for c in pieces(weak):
            if now and len(now) + len(c) + 2 <= max(most // 3, 300):
                now += "\n\n" + c
            else:
                out, now = out + ([now] if now else []), c
        return out + ([now] if now else [])
    return sized(text) if text.strip() else []


def by_sentences(text, most):
    import math
    import re

    step, out, now = most - min(100, most // 10), [], ""
    parts = [x.strip() for x in re.split(r"(?<=[。！？.!?])\s*", text) if x.strip()]
    for s in parts:
        if len(s) > most:
            out, now = out + ([now] if now else []) + [s[i * step : i * step + most] for i in range(math.ceil((len(s) - most) / step) + 1)], ""
        elif len(now) + len(s) > most:
            out, now = out + ([now] if now else []), s
        else:
            now += s
    return out + ([now] if now else [])


def test_plain_sections_of_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "replace(text, '#', ' ') as content")
    got = {}
    for r in sections.split_sections(docs, 700).orderBy("doc_id", "idx").collect():
        assert r["level"] == 0 and r["heading_chain"] == []
        got.setdefault(r["doc_id"], []).append(r["content"])
    texts = {r["doc_id"]: r["content"] for r in docs.collect()}
    assert all(got.get(i, []) == model_plain(t or "", 700) for i, t in texts.items()) and len(texts) > 50


def test_arrays_are_made_once_for_their_explode(spark):
    one = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.lit("# a\n"), F.col("id").cast("string")).alias("content"))
    assert one(sections.split_sections(docs)).count("#{1,6}") == 1
    texts = docs.select(F.col("doc_id").alias("prompt_id"), F.concat(F.lit('[{"subject": "a'), F.col("content"), F.lit('", "predicate": "p", "object": "b"}]')).alias("text"))
    names = spark.range(3).select(F.col("id").alias("prompt_id"))
    assert one(responses.triple_rows(texts).join(names, "prompt_id")).count("<think>") == 1


def hub(spark, leaves=300, questions=40):
    """Questions that all stand at one hub of many leaves."""
    nodes = spark.createDataFrame([("h", "Hub", "hub"), ("t", "Top", "top"), *((f"l{i}", "Leaf", f"leaf{i}") for i in range(leaves))], "node_id string, label string, name string")
    rows = [*((f"e{i}", f"l{i}", "h", "in") for i in range(leaves)), ("up", "h", "t", "under")]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, type string").select("*", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("source_chunk_id"), F.lit(None).cast("string").alias("source_text"))
    return nodes, edges, spark.range(questions).select(F.col("id").alias("question_id"), F.lit("h").alias("node"))


def test_questions_of_one_wish_share_a_hub(spark, monkeypatch):
    nodes, edges, keys = hub(spark)
    named, met = reasoning.named, []

    def counted(e, n):
        met.append(e.count())
        return named(e, n)

    monkeypatch.setattr(reasoning, "named", counted)
    wish = lambda target, hint, way: keys.select("question_id", F.lit(target).alias("target_type"), F.lit(hint).cast("string").alias("relation_hint"), F.lit(way).alias("direction"))
    got = lambda *w: {(r["question_id"], r["other"], r["level"]) for r in reasoning.plan_hop(keys, wish(*w), edges, nodes, near=0).collect()}
    leaves = sorted(f"leaf{i}" for i in range(300))[:20]
    assert got("Top", None, "out") == {(q, "t", 1) for q in range(40)}
    assert got("Leaf", "wrong", "in") == {(q, n.replace("leaf", "l"), 2) for q in range(40) for n in leaves}
    # nothing of that label lies that way: by direction alone, which keeps the leaves out
    assert got("Leaf", "wrong", "out") == {(q, "t", 4) for q in range(40)}
    assert max(met) <= 301


def test_a_rare_label_is_searched_from_its_side(spark, monkeypatch):
    nodes, edges, _ = hub(spark, 200)
    rows, levels = [], graph.levels

    def counted(*args, **kwargs):
        out = levels(*args, **kwargs)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "levels", counted)
    keys = nodes.where("label = 'Leaf'").select(F.col("name").alias("question_id"), F.col("node_id").alias("node"))
    got = graph.labelled_nearby(keys.withColumn("label", F.lit("Top")), edges, nodes).collect()
    assert sorted((r["start"], r["node"], r["hop"]) for r in got) == sorted((f"l{i}", "t", 2) for i in range(200))
    assert sum(rows) <= 202
    both = keys.limit(3).withColumn("label", F.explode(F.array(F.lit("Top"), F.lit("Leaf"))))
    got = graph.labelled_nearby(both, edges, nodes, limit=4).groupBy("start").agg(F.sort_array(F.collect_list("name")).alias("x")).collect()
    names = sorted(f"leaf{i}" for i in range(200))
    assert len(got) == 3 and all(r["x"] == [n for n in names if n != r["start"].replace("l", "leaf")][:3] + ["top"] or r["x"] == [n for n in names if n != r["start"].replace("l", "leaf")][:4] for r in got)


def test_an_edge_between_frontiers_is_looked_up(spark, monkeypatch):
    nodes, edges, _ = hub(spark, 60)
    more = edges.where("edge_id <> 'up'").withColumn("k", F.explode(F.array(*map(F.lit, "xyz")))).select(F.concat("k", "edge_id").alias("edge_id"), "src", F.concat("k", "src").alias("dst"), "type")
    plain = edges.select("edge_id", "src", "dst", "type").unionByName(more)
    pairs = plain.where("src like 'l%'").select("src").distinct().select(F.col("src").alias("question_id"), F.col("src").alias("start"), F.lit("t").alias("end"))
    kept, keep = [], graph.Stages.keep

    def counted(self, df):
        out = keep(self, df)
        kept.append(out.count() if "far" in out.columns else 0)
        return out

    monkeypatch.setattr(graph.Stages, "keep", counted)
    got = {(r["start"], r["hop"], r["node"], r["other"]) for r in graph.shortest_paths(pairs, plain, 3).collect()}
    assert got == {x for i in range(60) for x in ((f"l{i}", 1, f"l{i}", "h"), (f"l{i}", 2, "h", "t"))}
    # back from the top to the hub, and the edge from the leaf to the hub: a row each and the couple, no leaf's other edges
    assert sum(kept) <= 3 * 60


def test_guided_questions_do_not_copy_a_hub(spark, monkeypatch):
    nodes, edges, keys = hub(spark)
    counts, checkpointed = [], reasoning.checkpointed

    def counted(df):
        out = checkpointed(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(reasoning, "checkpointed", counted)
    decisions = keys.select("question_id", F.lit(1).alias("hop"), F.lit(True).alias("go_on"), F.array(F.lit("nobody")).alias("next_entities"), F.lit(None).cast("string").alias("relation_filter"))
    goals, hints = keys.select("question_id", F.lit("t").alias("node")), keys.select("question_id", F.lit("in").alias("type"))
    # the hinted type leads away from the goal, which a second look at all types finds
    got = reasoning.run_guided(keys, edges, nodes, hops=1, goals=goals, hints=hints, decisions=decisions, limit=None).collect()
    assert sorted((r["question_id"], r["other"]) for r in got) == [(q, "t") for q in range(40)]
    assert max(counts) <= 40
    # a chosen name, under a limit that leaves the others out
    named = decisions.withColumn("next_entities", F.array(F.lit("leaf1"), F.lit("top"), F.lit("leaf99")))
    got = reasoning.run_guided(keys, edges, nodes, hops=1, decisions=named, limit=20).collect()
    assert {(r["question_id"], r["other"]) for r in got} == set()
    got = reasoning.run_guided(keys, edges, nodes, hops=2, decisions=named, limit=None).collect()
    assert {(r["question_id"], r["other"]) for r in got} == {(q, "t") for q in range(40)}


def test_near_names_meet_bases_of_their_type_in_stages(spark, monkeypatch):
    monkeypatch.setattr(entities, "STAGE", 100)
    rows, meeting = [], entities._apart

    def counted(*args):
        out = meeting(*args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(entities, "_apart", counted)
    data = [(i, f"Supplier#{i * 7 % 600:06d}" + "x" * (i % 5 == 0), f"of nation {i % 6}", [], {"a": "1"} if i % 4 == 0 else {"a": "1", "b": str(i)}) for i in range(600)]
    got = entities.merge_across(entities.canonical(spark.createDataFrame(data, ENTITY)), 0.85).collect()
    want = greedy(data, 0.85, (0.5, 0.3, 0.2))
    assert sorted((r["ord"], r["name"], r["entity_type"], tuple(r["aliases"]), tuple(sorted(r["properties"].items())), r["n_merged"]) for r in got) == want
    # far fewer couples than names of one pattern make
    assert 0 < sum(rows) < 600 * 599 // 8


def test_a_store_gets_more_buckets_as_it_grows(spark, made, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "ROWS", 20)
    e, edges = small_graph(spark)
    s = made()
    s.write(graph.upsert_nodes(e.where("ord < 5"))[0], edges.where("type = 'u'").limit(3))
    assert s.into == {"nodes": 3, "ways": 3}
    s.upsert(e.where("ord >= 5"))
    s.add_edges(edges)
    assert all(t.count() <= 20 * s.into[n] for n, t in (("nodes", s.nodes()), ("ways", s.ways()))) and s.into["ways"] > 3
    assert seen(s.edges().select(*edges.columns)) == seen(edges)
    whole = graph.upsert_nodes(e)[0]
    assert seen(s.nodes().select(*whole.columns)) == seen(whole)
    again = store.GraphStore(spark, s.name + "again", s.path, s.parts, s.buckets)
    again.open("node_id STRING, label STRING, name STRING, properties MAP<STRING, STRING>", "node STRING, other STRING, edge_id STRING, src STRING, dst STRING, type STRING")
    assert again.into == s.into and seen(again.edges().select(*edges.columns)) == seen(edges)
