"""Operators on literal inputs, and loops against plain-Python models."""

import random

import pytest
from pyspark.sql import functions as F

from weft.functions.text import bigram_jaccard, is_phrase, plain_name
from weft.operators import entities, evidence, graph, questions, reasoning, responses, sections, training, triples


def test_names(spark):
    rows = spark.createDataFrame([("SDH（技术）",), ("A(b)",), (" x ",), ("主要的手段",), ("一二三四五六七八九十一",)], "n string")
    got = rows.select(plain_name("n"), is_phrase("n")).collect()
    assert [r[0] for r in got] == ["SDH", "A", "x", "主要的手段", "一二三四五六七八九十一"]
    assert [r[1] for r in got] == [False, False, False, True, True]
    assert spark.range(1).select(bigram_jaccard(F.lit("TC P"), F.lit("tcp")), bigram_jaccard(F.lit(""), F.lit("a")), bigram_jaccard(F.lit("a"), F.lit("A"))).first()[:] == (1.0, 0.0, 1.0)


def model_merge(chunks, most):
    out, now = [], ""
    for c in chunks:
        if not now:
            now = c
        elif len(now) + len(c) + 2 <= most:
            now += "\n\n" + c
        else:
            out.append(now)
            now = c
    return out + [now] if now else out


def test_merge_and_windows(spark):
    rng = random.Random(3)
    rows = [(["x" * rng.randint(1, 40) for _ in range(rng.randint(0, 12))],) for _ in range(40)]
    got = spark.createDataFrame(rows, "c array<string>").select("c", sections.merge_small(F.col("c"), 50).alias("m")).collect()
    assert all(r["m"] == model_merge(r["c"], 50) for r in got)
    texts = [("a" * n,) for n in (0, 1, 99, 100, 101, 190, 191, 1000)]
    for (t,), r in zip(texts, spark.createDataFrame(texts, "t string").select(sections.by_chars(F.col("t"), 100).alias("w")).collect(), strict=True):
        want, at = [], 0
        while at < len(t):
            want.append(t[at : at + 100])
            if at + 100 >= len(t):
                break
            at += 90
        assert r["w"] == want


def test_sections(spark):
    doc = "intro\n# A\nbody a\n## B\nbody b\n### C\n## D\nbody d\n# E\nbody e"
    got = sections.split_sections(spark.createDataFrame([(1, doc), (2, "  \n"), (3, None), (4, "one\n\ntwo")], "doc_id long, content string"), 100).orderBy("doc_id", "idx").collect()
    assert [(r["doc_id"], r["idx"], r["level"], r["heading_chain"], r["content"]) for r in got] == [
        (1, 0, 0, [], "intro"), (1, 1, 1, ["A"], "body a"), (1, 2, 2, ["A", "B"], "body b"), (1, 3, 2, ["A", "D"], "body d"), (1, 4, 1, ["E"], "body e"),
        (4, 0, 0, [], "one"), (4, 1, 0, [], "two"),
    ]


def test_responses(spark):
    body = '[{"subject": "a", "predicate": "p", "object": "b", "confidence": "high"}, {"subject": 1}]'
    texts = [body, f"```json\n{body}\n```", f"<think>x</think>{body}", f"So: {body}", body[:-1], "nothing", None, ""]
    got = responses.triple_rows(spark.createDataFrame(list(enumerate(texts)), "prompt_id long, text string")).orderBy("prompt_id").collect()
    assert [(r["prompt_id"], r["subject"], r["confidence"]) for r in got] == [(i, "a", 1.0) for i in range(5)]
    tries = spark.createDataFrame([(1, 0, "", None), (1, 1, "", None), (1, 2, "x", None), (2, 0, "y", "e"), (2, 1, "z", None), (3, 0, "q", "e")], "prompt_id long, attempt int, text string, error string")
    assert {r[0]: r[1] for r in responses.chosen_attempt(tries).collect()} == {1: "", 2: "z", 3: ""}


def test_mentions_match_nested_loop(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    names = list({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(25)})
    want = {(i, n) for i, t in texts for n in names if n in t}
    texts, names = spark.createDataFrame(texts, "key long, content string"), spark.createDataFrame([(n,) for n in names], "name string")
    # one automaton, several, and the join beyond them
    for options in ({}, {"slice_chars": 40}, {"slice_chars": 40, "slices": 1}, {"slice_chars": 5, "slices": 99}):
        got = triples.mentions(texts, names, **options).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def least_path(edges, start, end, hops, directed):
    """Of the shortest paths the least by (node, edge), as (edge, node, other) a hop; None without one."""
    ways = {}
    for i, a, b, *_ in edges:
        for x, y in [(a, b)] if directed else [(a, b), (b, a)]:
            ways.setdefault(x, []).append((y, i))
    front = [((), start)]
    for _ in range(hops):
        front = [((*p, (y, i)), y) for p, x in front for y, i in ways.get(x, ())]
        if any(y == end for _, y in front):
            path, at = min(p for p, y in front if y == end), start
            out = []
            for y, i in path:
                out.append((i, at, y))
                at = y
            return out
    return None


@pytest.mark.parametrize(("directed", "hops"), [(True, 3), (False, 4), (False, 1)])
def test_paths_are_the_least_of_the_shortest(spark, directed, hops):
    rng = random.Random(7)
    rows = [(f"e{i:02}", f"n{rng.randint(0, 11)}", f"n{rng.randint(0, 11)}", "t") for i in range(20)]
    rows += [(f"h{i}", "n0", f"n{i}", "t") for i in range(5)] + [("x1", "n1", "n2", "u"), ("x0", "n1", "n2", "v"), ("x2", "n2", "n1", "v")]
    pairs = [(i * 100 + j, f"n{i}", f"n{j}") for i in range(12) for j in range(13)]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, type string")
    got = {}
    for r in graph.shortest_paths(spark.createDataFrame(pairs, "question_id long, start string, end string"), edges, hops, directed).collect():
        got.setdefault(r["question_id"], []).append((r["hop"], r["edge_id"], r["node"], r["other"]))
    want = {q: [(h + 1, *x) for h, x in enumerate(p)] for q, a, b in pairs if a != b and (p := least_path(rows, a, b, hops, directed))}
    assert {q: sorted(p) for q, p in got.items()} == want and len(want) < len(pairs)


def test_reach_of_more_keys_than_bits(spark):
    rng = random.Random(3)
    es = [(f"n{rng.randint(0, 199)}", f"n{rng.randint(0, 199)}") for _ in range(260)]
    near = {f"n{i}": set() for i in range(200)}
    for a, b in es:
        near[a].add(b)
        near[b].add(a)
    keys = [(q, f"n{i}") for i in range(200) for q in range(1 + i % 2)]
    want = set()
    for q, s in keys:
        seen, front = {s}, {s}
        want.add((q, s, s, 0))
        for d in (1, 2, 3):
            front = {y for x in front for y in near[x]} - seen
            seen |= front
            want |= {(q, s, t, d) for t in front}
    edges = spark.createDataFrame([(str(i), *e) for i, e in enumerate(es)], "edge_id string, src string, dst string")
    got = graph.reach(spark.createDataFrame(keys, "question_id long, node string"), edges, 3).collect()
    assert {tuple(r[c] for c in ("question_id", "start", "node", "hop")) for r in got} == want and len(got) == len(want)
    start = graph.sources(spark.createDataFrame(keys, "question_id long, node string"))
    assert start.select("chunk").distinct().count() <= 4 + len(keys) // 64 + 1


def test_questions(spark):
    q = spark.createDataFrame([(1, "TCP-7和“光纤”有多少区别，3跳"), (2, ""), (3, None), (4, "血压如何影响心脏")], "question_id long, text string")
    got = {r["question_id"]: r for r in questions.parse_rules(q, spark.createDataFrame([("心脏",)], "name string")).collect()}
    assert got[1]["intent"] == "COUNT" and got[1]["max_hops"] == 3 and got[1]["entities"][0] == "光纤" and "TCP-7" in got[1]["entities"]
    assert got[2]["entities"] == [] and got[3]["intent"] == "EXPLAIN"
    assert got[4]["entities"] == ["心脏"] and got[4]["relation_hints"] == ["影响"]


def test_linking_and_chains(spark):
    nodes = spark.createDataFrame([("1", "L", "optical network"), ("2", "L", "SDH"), ("3", "L", "SDH ring")], "node_id string, label string, name string")
    e = spark.createDataFrame([("SDH",), ("optical",), ("ring",), ("none",), ("H",)], "entity string")
    assert {r["entity"]: (r["name"], r["method"]) for r in reasoning.link(e, nodes).collect()} == {"SDH": ("SDH", "exact"), "optical": ("optical network", "substring"), "ring": ("SDH ring", "substring"), "none": (None, "unresolved"), "H": (None, "unresolved")}
    edges = spark.createDataFrame([(1, 1, 1, "A", "r", "B", 0.8), (1, 2, 1, "B", "s", "C", 0.6)], "question_id long, hop int, ord int, source string, type string, target string, confidence double")
    c = evidence.chains(edges).first()
    assert abs(c["confidence"] - 0.48) < 1e-12 and c["path"] == ["A", "B", "C"] and c["description"] == "A --r--> B --s--> C"
    a = spark.createDataFrame([("可能是",), ("答案。推理过程:一；二\n三",), (None,)], "t string").select(evidence.answer_confidence(F.col("t")).alias("c"), evidence.split_answer(F.col("t")).alias("s")).collect()
    assert [round(r["c"], 6) for r in a] == [0.3, 0.5, 0.5] and a[1]["s"]["answer"] == "答案。" and a[1]["s"]["steps"] == ["一", "二", "三"]


def test_label_mask(spark):
    r = spark.range(1).select(training.padded(F.array(*map(F.lit, [5, 7, 8, 9])), 6).alias("p")).select(training.masked_labels(F.col("p.input_ids"), F.col("p.attention_mask"), [7, 8]).alias("m"), training.masked_labels(F.col("p.input_ids"), F.col("p.attention_mask"), [1]).alias("n")).first()
    assert r["m"] == [-100, -100, -100, 9, -100, -100] and r["n"] == [-100] * 6


ENTITY = "ord long, name string, entity_type string, aliases array<string>, properties map<string,string>"


def test_greedy_merge_of_a_large_component(spark):
    # one shared alias makes one component; rows of one kind merge
    rows = [(i, f"n{i}", f"kind{i % 20:02d}", ["shared"], {}) for i in range(5200)]
    got = entities.merge_across(entities.canonical(spark.createDataFrame(rows, ENTITY)), 0.75).collect()
    assert sorted((r["ord"], r["n_merged"], len(r["aliases"])) for r in got) == [(i, 260, 260) for i in range(20)]


def model_greedy(rows, threshold):
    def grams(s):
        return {s[i : i + 2] for i in range(len(s) - 1)}

    out = []
    for o, name, kind, _, _ in rows:
        for k in out:
            base = k["name"]
            names = 1.0 if name in (base, *k["aliases"]) else len(grams(base) & grams(name)) / len(grams(base) | grams(name))
            if 0.5 * names + 0.3 * (kind == k["kind"]) >= threshold:
                longer, other = (k, (name, [])) if len(base) >= len(name) else ({"name": name, "aliases": [], "kind": kind}, (base, k["aliases"]))
                k |= {"name": longer["name"], "kind": longer["kind"], "n": k["n"] + 1, "aliases": [x for x in dict.fromkeys([*longer["aliases"], other[0], *other[1]]) if x != longer["name"]]}
                break
        else:
            out.append({"ord": o, "name": name, "kind": kind, "aliases": [], "n": 1})
    return out


def test_greedy_merge_equals_plain_model(spark):
    import random

    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abc", k=rng.randint(4, 7))), rng.choice(["red", "blue"]), [], {}) for i in range(150)]
    want = model_greedy(rows, 0.55)
    got = entities.merge_across(entities.canonical(spark.createDataFrame(rows, ENTITY)), 0.55, (0.5, 0.3, 0.0)).collect()
    assert sorted((r["ord"], r["name"], r["entity_type"], tuple(r["aliases"]), r["n_merged"]) for r in got) == [(k["ord"], k["name"], k["kind"], tuple(k["aliases"]), k["n"]) for k in want]
    assert len(want) < 140


def greedy(rows, threshold, weights):
    """The merge one by one; rows (ord, name, type, aliases, properties)."""
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}

    def like(a, b):
        na, nb = ({x.strip().lower() for x in [e["name"], *e["aliases"]]} for e in (a, b))
        sa, sb = ("".join(e["name"].lower().split()) for e in (a, b))
        name = 1.0 if na & nb or a["canonical"] == b["canonical"] else 0.0 if not sa or not sb else float(sa == sb) if min(len(sa), len(sb)) < 2 else len(grams(sa) & grams(sb)) / len(grams(sa) | grams(sb))
        ta, tb = a["type"].strip().lower(), b["type"].strip().lower()
        kind = 0.0 if not ta or not tb else 1.0 if ta == tb else 0.5 if ta in tb or tb in ta else 0.0
        pa, pb = a["properties"].keys(), b["properties"].keys()
        return weights[0] * name + weights[1] * kind + weights[2] * (len(pa & pb) / len(pa | pb) if pa and pb else 0.0)

    out = []
    for o, name, kind, aliases, properties in rows:
        if name is None:
            continue
        e = {"ord": o, "name": name, "type": kind or "", "aliases": [x for x in aliases or [] if x is not None], "canonical": name.strip().lower(), "properties": properties or {}, "n": 1}
        for i, k in enumerate(out):
            if like(k, e) >= threshold:
                base, other = (k, e) if len(k["name"]) >= len(name) else (e, k)
                out[i] = base | {"ord": k["ord"], "n": k["n"] + 1, "properties": other["properties"] | base["properties"], "aliases": [x for x in dict.fromkeys([*base["aliases"], other["name"], *other["aliases"]]) if x != base["name"]]}
                break
        else:
            out.append(e)
    return sorted((e["ord"], e["name"], e["type"], tuple(e["aliases"]), tuple(sorted(e["properties"].items())), e["n"]) for e in out)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_merge_in_rounds_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choices("abcA ", k=rng.randint(a, b)))
    rows = [(i, None if i % 37 == 5 else word(1, 6), rng.choice(["red", "red wine", "blue", "", None]), rng.choice([None, [], [word(2, 3)], [word(3, 4), None]]), rng.choice([None, {}, {"x": str(i)}, {"x": "1", "y": str(i)}, {"z": str(i)}])) for i in range(220)]
    got = entities.merge_across(entities.canonical(spark.createDataFrame(rows, ENTITY)), 0.7, (0.6, 0.2, 0.1)).collect()
    want = greedy(rows, 0.7, (0.6, 0.2, 0.1))
    assert sorted((r["ord"], r["name"], r["entity_type"], tuple(r["aliases"]), tuple(sorted(r["properties"].items())), r["n_merged"]) for r in got) == want
    assert any(x[5] > 2 for x in want)


def test_candidate_pairs_verified(spark):
    e = entities.canonical(spark.createDataFrame([(1, "abcdefgh", "t", [], {}), (2, "abqrstuv", "t", [], {}), (3, "abcdefgx", "t", [], {})], ENTITY))
    assert {(r["a"], r["b"]) for r in entities.candidate_pairs(e, 0.5, verified=True).collect()} == {(1, 3)}


def model_sections(content, most=1500):
    """(level, headings, content) of each section of a text with headings, in plain Python."""
    import math
    import re

    def strips(xs):
        return [x.strip() for x in xs if x.strip()]

    def windows(t):
        step = most - min(100, most // 10)
        return [t] if len(t) <= most else [t[i * step : i * step + most] for i in range(math.ceil((len(t) - most) / step) + 1)]

    def sentences(t):
        out, now = [], ""
        for s in strips(re.split(r"(?<=[。！？.!?])\s*", t)):
            if len(now) + len(s) > most or len(s) > most:
                out, now = out + [now] * bool(now), ""
            if len(s) > most:
                out += windows(s)
            else:
                now += s
        return out + [now] * bool(now)

    def sized(t):
        if len(t) <= most:
            return [t]
        strong, weak = strips(t.split("\n\n")), strips(t.split("\n"))
        parts = weak if len(strong) <= 1 and len(weak) > len(strong) else strong
        return model_merge([x for p in parts for x in ([p] if len(p) <= most else sentences(p))], most)

    parts, stack, out = re.split(r"(?m)^(#{1,6})\s+(.+)$", content), [], []
    for mark, title, body in [("", "", parts[0]), *zip(parts[1::3], parts[2::3], parts[3::3], strict=True)]:
        stack = [h for h in stack if h[0] < len(mark)] + [(len(mark), title.strip())] if mark else []
        if body.strip():
            out += [(len(mark), [h[1] for h in stack], c) for c in sized(body.strip())]
    return out


def test_heading_sections_of_every_document(spark):
    from weft.plans import fixtures

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r["doc_id"]: r["content"] for r in fixtures.md_docs(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert docs.keys() == texts.keys() and all((t or "") in docs[i] for i, t in texts.items()) and len(docs) > 50
    got = {}
    for r in sections.split_sections(fixtures.md_docs(spark, sf)).orderBy("doc_id", "idx").collect():
        got.setdefault(r["doc_id"], []).append((r["level"], r["heading_chain"], r["content"]))
    assert all(got.get(i, []) == model_sections(c) for i, c in docs.items())
