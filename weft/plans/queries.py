"""The registered queries for the graph operators, and the SQL that DuckDB can hold them against. Each
reads the whole of its tables, though some keep the rows of one label or kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bigram_jaccard, strip_images
from ..operators import batch
from ..operators import entities as ent
from ..operators import evidence as evi
from ..operators import graph as g
from ..operators import questions as que
from ..operators import reasoning as rea
from ..operators import responses as res
from ..operators import sections as sec
from ..operators import stats, training, triples, validation
from ..operators.components import checkpointed
from ..sources import files
from . import fixtures as fx
from .fixtures import EDGES, ENTITIES, NODES, PLAIN, QUESTIONS, TRIPLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "g5_neighbours"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def stored_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The graph's nodes as a written table, as walks over a graph find them."""
    return checkpointed(fx.nodes(spark, sf))


def stored_edges(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """The graph's edges as a written table; `cols`: only these columns."""
    return checkpointed(fx.edges(spark, sf).select(*cols or "*"))


def joined(c: str):
    return F.array_join(c, "|")


# ── sections ──


@query(r"""SELECT doc_id, replace(text || ' ![](data:image/png;base64,AA==) ![x](data:image/png;base64,AA==) ![](data:image/) ![](a.png)', '![](data:image/png;base64,AA==)', '[图片]') AS content FROM documents""")
def c1_strip_images(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", strip_images(F.concat("text", F.lit(" ![](data:image/png;base64,AA==) ![x](data:image/png;base64,AA==) ![](data:image/) ![](a.png)"))).alias("content"))


@query()
def c2_heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    return sec.split_sections(fx.md_docs(spark, sf), 1500).select("doc_id", "idx", "chunk_id", "level", joined("heading_chain").alias("headings"), F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))


@query("""
WITH w AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((len(text) - 500) / 450.0)::BIGINT))) AS k FROM documents WHERE len(text) > 0)
SELECT doc_id, k::INT AS window, substr(text, (k * 450 + 1)::BIGINT, 500) AS content FROM w
""")
def c6_char_windows(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", F.posexplode_outer(sec.by_chars(F.col("text"), 500)).alias("window", "content")).where("window is not null")


@query()
def c8_plain_sections(spark: SparkSession, sf: str) -> DataFrame:
    return sec.split_sections(fx.table(spark, sf, "documents"), 1500, content="text").select("doc_id", "idx", "chunk_id", "level", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))


# ── prompts and responses ──

WORDS = "words AS (SELECT DISTINCT w AS name FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE len(w) >= 4)"


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).where(F.length("name") >= 4).distinct()


@query(f"WITH {WORDS} SELECT doc_id, count(*) AS n_names FROM documents, words WHERE contains(text, name) GROUP BY doc_id HAVING count(*) >= 2")
def p1_mention_join(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    return triples.with_mentions(d, dictionary(spark, sf)).select(F.col("key").alias("doc_id"), F.size("names").cast("long").alias("n_names"))


@query("""SELECT doc_id, sha256('Rate the extraction.' || chr(10) || 'Entities: ' || coalesce(source, '') || chr(10) || 'Triples: ' || coalesce(lang, '') || chr(10) || 'Text:' || chr(10) || substr(text, 1, 3000)) AS prompt_sha256 FROM documents""")
def p2_prompts(spark: SparkSession, sf: str) -> DataFrame:
    d = res.prompts(fx.table(spark, sf, "documents"), "verification", known=F.col("source"), types=F.col("lang"), text=F.col("text"))
    return d.select("doc_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("""SELECT conv_id, turn, 'echo ' || len('Name intent, entities and relations of the question.' || chr(10) || 'Question: ' || text) AS answer FROM conversations WHERE text IS NOT NULL""")
def p3_inference(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations").where("text is not null").withColumn("prompt_id", F.concat_ws(":", "conv_id", "turn"))
    out = res.infer(res.prompts(c, "question", text=F.col("text")), lambda ps: [f"echo {len(p)}" for p in ps])
    return out.select(F.split("prompt_id", ":")[0].cast("long").alias("conv_id"), F.split("prompt_id", ":")[1].cast("long").alias("turn"), F.col("text").alias("answer"))


@query("""
WITH r AS (SELECT l_orderkey AS prompt_id, l_linenumber - 1 AS attempt, CASE WHEN min(l_partkey) % 3 = 0 THEN '' ELSE 'p' || min(l_partkey) END AS text, min(l_discount) > 0.05 AS bad FROM lineitem GROUP BY 1, 2)
SELECT prompt_id, coalesce(arg_min(text, attempt) FILTER (WHERE NOT bad AND (text <> '' OR attempt > 0)), '') AS text FROM r GROUP BY prompt_id
""")
def p4_attempts(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("prompt_id"), (F.col("l_linenumber") - 1).alias("attempt")).agg(F.min("l_partkey").alias("p"), F.min("l_discount").alias("d"))
    r = r.select("prompt_id", "attempt", F.when(F.col("p") % 3 == 0, "").otherwise(F.concat(F.lit("p"), F.col("p").cast("string"))).alias("text"), F.when(F.col("d") > 0.05, "failed").alias("error"))
    return res.chosen_attempt(r)


@query(f"WITH {TRIPLES} SELECT ord, subject, predicate, object, CASE WHEN ord % 7 = 0 THEN 1.0 ELSE confidence END AS confidence FROM triples WHERE (ord // 10) % 6 <> 5")
def p9_triple_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Responses built from triples: plain, fenced, behind a thought, behind prose, cut off, no JSON."""
    t = fx.triples(spark, sf)
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    conf = F.when(F.col("ord") % 7 == 0, F.lit('"high"')).otherwise(F.col("confidence").cast("string"))
    body = F.concat(F.lit('{"subject": '), q("subject"), F.lit(', "predicate": '), q("predicate"), F.lit(', "object": '), q("object"), F.lit(', "confidence": '), conf, F.lit("}"))
    array = F.concat(F.lit("["), body, F.lit("]"))
    way = F.floor(F.col("ord") / 10) % 6
    text = (
        F.when(way == 0, array).when(way == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```"))).when(way == 2, F.concat(F.lit("<think>first [maybe]</think>\n"), array))
        .when(way == 3, F.concat(F.lit("Here it is: "), array, F.lit(" done"))).when(way == 4, F.concat(F.lit("["), body, F.lit(', {"subject": "x'))).otherwise("no answer")
    )
    rows = res.triple_rows(t.select(F.col("ord").alias("prompt_id"), text.alias("text")))
    return rows.select(F.col("prompt_id").alias("ord"), "subject", "predicate", "object", "confidence")


@query("SELECT event_id AS prompt_id, CASE WHEN event_id % 4 = 3 THEN 0.0 ELSE greatest(0.0, least(1.0, round(value / 100, 4))) END AS score, (CASE WHEN event_id % 4 = 3 THEN 1 ELSE 2 END)::INT AS n_issues FROM events")
def p11_quality_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "events")
    body = F.concat(F.lit('{"score": '), F.round(F.col("value") / 100, 4).cast("decimal(18,4)").cast("string"), F.lit(', "issues": ["a", "", " b "]}'))
    text = F.when(F.col("event_id") % 4 == 3, "broken {").when(F.col("event_id") % 4 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(body)
    return res.quality_rows(e.select(F.col("event_id").alias("prompt_id"), text.alias("text"))).select("prompt_id", "score", F.size("issues").alias("n_issues"))


# ── entities ──


@query(f"""
WITH {ENTITIES}, e AS (SELECT *, trim(name) AS n FROM entities),
a AS (SELECT n, alias, min(ord) AS o FROM e WHERE alias <> n GROUP BY n, alias)
SELECT min(ord) AS ord, n AS name, arg_min(entity_type, ord) AS entity_type, arg_min(size, ord) AS size, arg_min(brand, ord) FILTER (WHERE brand IS NOT NULL) AS brand,
  (SELECT string_agg(alias, '|' ORDER BY o) FROM a WHERE a.n = e.n) AS aliases FROM e GROUP BY n
""")
def e1_dedup_entities(spark: SparkSession, sf: str) -> DataFrame:
    d = ent.dedup_entities(fx.entities(spark, sf))
    return d.select("ord", "name", "entity_type", F.col("properties")["size"].alias("size"), F.col("properties")["brand"].alias("brand"), joined("aliases").alias("aliases"))


@query(f"""
WITH {ENTITIES}, e AS (SELECT *, lower(trim(name)) AS canonical FROM entities)
SELECT canonical, count(*) AS n_merged, arg_min(name, -len(name)::BIGINT * 100000000 + ord) AS name, arg_min(entity_type, -len(name)::BIGINT * 100000000 + ord) AS entity_type FROM e GROUP BY canonical
""")
def e3_merge_groups(spark: SparkSession, sf: str) -> DataFrame:
    return ent.merge_groups(ent.canonical(fx.entities(spark, sf))).select("canonical", "n_merged", "name", "entity_type")


@query("""
WITH p AS (SELECT c_custkey AS k, lower(c_name) AS a, lower(s_name) AS b FROM customer JOIN supplier ON s_suppkey = 1 + c_custkey % (SELECT count(*) FROM supplier)),
g AS (SELECT k, list_distinct(list_transform(range(1, len(a)), lambda i: substr(a, i, 2))) AS x, list_distinct(list_transform(range(1, len(b)), lambda i: substr(b, i, 2))) AS y FROM p)
SELECT k, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS likeness FROM g
""")
def e4_bigram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    s, c = fx.table(spark, sf, "supplier"), fx.table(spark, sf, "customer")
    pairs = c.join(s, F.col("s_suppkey") == 1 + F.col("c_custkey") % s.count())
    return pairs.select(F.col("c_custkey").alias("k"), F.round(bigram_jaccard("c_name", "s_name"), 6).alias("likeness"))


NAMES = """n AS (SELECT row_number() OVER (ORDER BY name) AS ord, name FROM (SELECT DISTINCT p_name AS name FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region)),
g AS (SELECT ord, name, list_distinct(list_transform(range(1, len(t)), lambda i: substr(t, i, 2))) AS x FROM (SELECT *, replace(lower(name), ' ', '') AS t FROM n))"""


def distinct_names(spark: SparkSession, sf: str) -> DataFrame:
    names = fx.table(spark, sf, "part").select(F.col("p_name").alias("name")).union(fx.table(spark, sf, "nation").select("n_name")).union(fx.table(spark, sf, "region").select("r_name")).distinct()
    numbered = names.select("name", F.xxhash64("name").alias("ord"), F.lit("name").alias("entity_type"), F.array().cast("array<string>").alias("aliases"), F.create_map().cast("map<string,string>").alias("properties"))
    return ent.canonical(numbered)


@query(f"""WITH {NAMES} SELECT least(a.name, b.name) AS a, greatest(a.name, b.name) AS b, round(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))::DOUBLE, 6) AS likeness
FROM g a JOIN g b ON a.ord < b.ord WHERE len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))::DOUBLE >= 0.3""")
def e9_similar_names(spark: SparkSession, sf: str) -> DataFrame:
    p = ent.similar_pairs(distinct_names(spark, sf), 0.3)
    return p.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), F.round("likeness", 6).alias("likeness"))


@query()
def e10_greedy_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = ent.merge_groups(ent.canonical(fx.entities(spark, sf)))
    out = ent.merge_across(merged, 0.75)
    return out.select("ord", "name", "entity_type", joined("aliases").alias("aliases"), "n_merged")


# ── triples ──

FILTERED = f"""plain AS (SELECT *, {PLAIN.format('subject')} AS s, {PLAIN.format('object')} AS o FROM triples),
known AS (SELECT DISTINCT s_name AS name FROM supplier),
kept AS (SELECT * FROM plain WHERE s <> o AND predicate = 'supplies'
  AND (s IN (SELECT name FROM known) OR NOT (len(s) > 10 AND NOT regexp_matches(s, '[A-Za-z]')))
  AND (o IN (SELECT name FROM known) OR NOT (len(o) > 10 AND NOT regexp_matches(o, '[A-Za-z]'))))"""


def filtered(spark: SparkSession, sf: str) -> DataFrame:
    return triples.filter_triples(fx.triples(spark, sf), fx.table(spark, sf, "supplier").select(F.col("s_name").alias("name")), ["supplies"])


@query(f"WITH {TRIPLES}, {FILTERED} SELECT ord, s AS subject, predicate, o AS object, confidence FROM kept")
def t4_filter_triples(spark: SparkSession, sf: str) -> DataFrame:
    return filtered(spark, sf).select("ord", "subject", "predicate", "object", "confidence")


@query(f"""WITH {TRIPLES}, {FILTERED} SELECT min(ord) AS ord, s AS subject, predicate, o AS object, max(confidence) AS confidence, arg_min(line, ord) AS line, arg_min(source, ord) AS source
FROM kept WHERE s <> '' AND o <> '' GROUP BY s, predicate, o""")
def t5_dedup_triples(spark: SparkSession, sf: str) -> DataFrame:
    d = triples.dedup_triples(filtered(spark, sf))
    return d.select("ord", "subject", "predicate", "object", "confidence", F.col("properties")["line"].alias("line"), "source")


@query(f"WITH {TRIPLES} SELECT name FROM (SELECT subject AS name FROM triples UNION SELECT object FROM triples) WHERE name NOT IN (SELECT s_name FROM supplier)")
def t8_new_entities(spark: SparkSession, sf: str) -> DataFrame:
    return triples.new_entities(fx.triples(spark, sf), fx.table(spark, sf, "supplier").select(F.col("s_name").alias("name")))


# ── validation ──


@query(f"""WITH {NODES} SELECT node_id, CASE label WHEN 'Customer' THEN NULL WHEN 'Part' THEN 'property outside the schema' WHEN 'Supplier' THEN 'missing property' ELSE 'unknown label' END AS reason FROM nodes""")
def v1_check_nodes(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.createDataFrame([("Customer", ["segment"], []), ("Part", ["brand"], []), ("Supplier", ["rating"], [])], "label string, required array<string>, optional array<string>")
    return validation.check_nodes(fx.nodes(spark, sf), schema).select("node_id", "reason")


def labelled_edges(spark: SparkSession, sf: str) -> DataFrame:
    n = fx.nodes(spark, sf).select("node_id", "label")
    return fx.edges(spark, sf).join(n.toDF("src", "src_label"), "src").join(n.toDF("dst", "dst_label"), "dst")


LABELLED = "le AS (SELECT e.*, a.label AS src_label, b.label AS dst_label FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst)"


@query(f"""WITH {NODES}, {EDGES}, {LABELLED} SELECT edge_id, CASE WHEN type = 'in_region' THEN 'unknown type' WHEN type = 'in_nation' AND src_label <> 'Supplier' THEN 'source label' WHEN type = 'supplies' THEN 'target label' END AS reason FROM le""")
def v2_check_edges(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.createDataFrame([("in_nation", ["Supplier"], ["Nation"]), ("supplies", ["Supplier"], ["Nation"])], "type string, source_labels array<string>, target_labels array<string>")
    return validation.check_edges(labelled_edges(spark, sf), schema).select("edge_id", "reason")


@query(f"WITH {NODES}, {EDGES}, {LABELLED} SELECT type, string_agg(DISTINCT src_label, '|' ORDER BY src_label) AS source_labels, string_agg(DISTINCT dst_label, '|' ORDER BY dst_label) AS target_labels FROM le GROUP BY type")
def v3_discovered_schema(spark: SparkSession, sf: str) -> DataFrame:
    return validation.discovered_schema(labelled_edges(spark, sf)).select("type", joined("source_labels").alias("source_labels"), joined("target_labels").alias("target_labels"))


# ── graph ──


@query(f"""
WITH {ENTITIES}, e AS (SELECT *, trim(name) AS n FROM entities)
SELECT entity_type AS label, n AS name, arg_max(size, ord) AS size, arg_max(brand, ord) FILTER (WHERE brand IS NOT NULL) AS brand, arg_max(alias, ord) AS aliases FROM e GROUP BY entity_type, n
""")
def b1_upsert_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = g.upsert_nodes(fx.entities(spark, sf))
    p = F.col("properties")
    return nodes.select("label", "name", p["size"].alias("size"), p["brand"].alias("brand"), p["aliases"].alias("aliases"))


@query(f"""
WITH {ENTITIES}, {TRIPLES}, n AS (SELECT DISTINCT entity_type AS label, trim(name) AS name FROM entities),
ends AS (SELECT DISTINCT trim(x) AS name FROM (SELECT subject AS x FROM triples UNION SELECT object FROM triples) WHERE trim(x) <> ''),
every AS (SELECT * FROM n UNION ALL SELECT '自动创建', name FROM ends WHERE name NOT IN (SELECT name FROM n))
SELECT t.predicate AS type, a.label AS src_label, b.label AS dst_label, count(*) AS n, round(sum(confidence), 4) AS confidence
FROM triples t JOIN every a ON a.name = trim(t.subject) JOIN every b ON b.name = trim(t.object) GROUP BY 1, 2, 3
""")
def b4_build_edges(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.triples(spark, sf)
    nodes, _ = g.upsert_nodes(fx.entities(spark, sf))
    nodes = nodes.unionByName(g.auto_nodes(t, nodes))
    e = g.build_edges(t, nodes)
    lab = nodes.select("node_id", "label")
    return e.join(lab.toDF("src", "src_label"), "src").join(lab.toDF("dst", "dst_label"), "dst").groupBy("type", "src_label", "dst_label").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query(f"WITH {EDGES} SELECT node, count(*) AS degree FROM incident GROUP BY node")
def g4_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return g.degrees(fx.edges(spark, sf, spread=True))


def supplier_keys(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("question_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))


@query(f"""
WITH {NODES}, {EDGES}, r AS (SELECT s_suppkey AS question_id, i.node, i.other, n.name, n.label, i.type, i.src, i.dst, i.edge_id,
  row_number() OVER (PARTITION BY s_suppkey ORDER BY n.name, i.type, i.edge_id) AS rn FROM supplier JOIN incident i ON i.node = 'S' || s_suppkey JOIN nodes n ON n.node_id = i.other)
SELECT question_id, node, other, name AS other_name, label AS other_label, type, src, dst FROM r WHERE rn <= 20
""")
def g5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    out = g.neighbours(supplier_keys(spark, sf), stored_edges(spark, sf, "edge_id", "src", "dst", "type"), fx.nodes(spark, sf))
    return out.select("question_id", "node", "other", "other_name", "other_label", "type", "src", "dst")


REACH = """r AS (SELECT DISTINCT n_nationkey AS question_id, 'N' || n_nationkey AS start, 'N' || n_nationkey AS node, 0 AS hop FROM nation
UNION SELECT r.question_id, r.start, i.other, r.hop + 1 FROM r JOIN incident i ON i.node = r.node WHERE r.hop < 2)"""


def nation_keys(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("question_id"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"))


@query(f"WITH RECURSIVE {EDGES}, {REACH} SELECT question_id, start, hop, count(*) AS n FROM (SELECT question_id, start, node, min(hop) AS hop FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2, 3")
def g7_reach(spark: SparkSession, sf: str) -> DataFrame:
    return g.reach(nation_keys(spark, sf), stored_edges(spark, sf), 2).groupBy("question_id", "start", "hop").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES}, p AS (SELECT s_suppkey AS k, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT k AS question_id, 1 AS hop, 'S' || k AS src, 'N' || n AS dst, 'in_nation' AS type FROM p UNION ALL SELECT k, 2, 'N' || n, 'R' || r, 'in_region' FROM p")
def g8_shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.table(spark, sf, "supplier").join(fx.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = lambda m, c: F.concat(F.lit(m), F.col(c).cast("string"))
    pairs = s.select(F.col("s_suppkey").alias("question_id"), key("S", "s_suppkey").alias("start"), key("R", "n_regionkey").alias("end"))
    return g.shortest_paths(pairs, stored_edges(spark, sf), 3).select("question_id", "hop", "src", "dst", "type")


@query(f"""WITH {EDGES}, t AS (SELECT node, source_text, min(source_chunk_id) AS c FROM incident WHERE node LIKE 'P%' AND source_text IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY c, source_text) AS rank FROM t) SELECT node, rank::INT AS rank, source_text, c AS source_chunk_id FROM k WHERE rank <= 10""")
def g10_read_context(spark: SparkSession, sf: str) -> DataFrame:
    keys = fx.table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node"))
    return g.read_context(keys, fx.edges(spark, sf)).select("node", "rank", "source_text", "source_chunk_id")


@query(f"WITH {NODES}, {EDGES} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def g11_graph_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return g.sizes(fx.nodes(spark, sf), fx.edges(spark, sf))


# ── questions ──

INTENT = """CASE WHEN trim(text) = '' THEN 'EXPLAIN' WHEN contains(text, '多少') THEN 'COUNT' WHEN contains(text, '比较') OR contains(text, '区别') THEN 'COMPARE'
WHEN contains(text, '怎么走') OR (contains(text, '如何') AND contains(text, '导致')) THEN 'FIND_PATH' WHEN contains(text, '关系') THEN 'FIND_RELATION' WHEN contains(text, '列出') THEN 'FIND_ENTITY' ELSE 'EXPLAIN' END"""


@query(f"""WITH {QUESTIONS} SELECT question_id, {INTENT} AS intent, array_to_string(list_filter(['支持', '导致', '依赖', '影响'], lambda k: contains(text, k)), '|') AS hints,
  CASE WHEN contains(text, '跳') THEN regexp_extract(text, '(\\d+)跳', 1)::INT END AS max_hops FROM questions""")
def q1_question_rules(spark: SparkSession, sf: str) -> DataFrame:
    return que.parse_rules(fx.questions(spark, sf)).select("question_id", "intent", joined("relation_hints").alias("hints"), "max_hops")


@query(f"""WITH {QUESTIONS} SELECT question_id, CASE c_custkey % 8 WHEN 1 THEN c_name || '|TCP-' || c_nationkey || '|TCP' WHEN 2 THEN c_name || '|G.709' WHEN 3 THEN c_name || '|SDH' WHEN 5 THEN c_name || '|10Gb/s' WHEN 6 THEN lower(c_name) || '影响订单' WHEN 7 THEN '' ELSE c_name END AS entities
FROM questions JOIN customer ON c_custkey = question_id""")
def q4_question_entities(spark: SparkSession, sf: str) -> DataFrame:
    names = fx.table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    p = que.parse_rules(fx.questions(spark, sf), names)
    return p.select("question_id", joined(F.array_distinct("entities")).alias("entities"))


@query("SELECT c_custkey AS question_id, 0 AS step, CASE WHEN c_custkey % 2 = 0 THEN 'Part' END AS target_type, CASE WHEN c_custkey % 2 = 0 THEN 'supplies' END AS relation_hint, c_name AS start FROM customer")
def q7_rule_plans(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "customer")
    parsed = c.select(F.col("c_custkey").alias("question_id"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("Part"), F.col("c_name"))).otherwise(F.array("c_name")).alias("entities"), F.array(F.lit("supplies")).alias("relation_hints"))
    plans, steps = que.rule_plans(parsed, spark.createDataFrame([("Part",), ("Nation",)], "label string"))
    return steps.join(plans, "question_id").select("question_id", "step", "target_type", "relation_hint", joined("start_entities").alias("start"))


@query("SELECT event_id AS question_id, coalesce(nullif(event_id % 7, 0), 3) AS max_hops, CASE WHEN event_type = 'click' THEN 'blank question' WHEN event_id % 7 > 5 THEN 'max_hops out of range' END AS reason FROM events")
def q9_validated(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "events")
    return que.validated(e.select(F.col("event_id").alias("question_id"), F.when(F.col("event_type") == "click", " ").otherwise(F.col("event_type")).alias("text"), F.nullif(F.col("event_id") % 7, F.lit(0)).alias("max_hops"))).select("question_id", "max_hops", "reason")


# ── reasoning ──


@query("""WITH e AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN s_name || ' Ltd' ELSE 'nobody ' || s_suppkey END AS entity, s_suppkey % 3 AS k, s_name FROM supplier)
SELECT entity, CASE WHEN k < 2 THEN s_name END AS name, CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'substring' ELSE 'unresolved' END AS method FROM e""")
def m1_link(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.table(spark, sf, "supplier")
    k = F.col("s_suppkey") % 3
    entities = s.select(F.when(k == 0, F.col("s_name")).when(k == 1, F.concat("s_name", F.lit(" Ltd"))).otherwise(F.concat(F.lit("nobody "), F.col("s_suppkey").cast("string"))).alias("entity"))
    return rea.link(entities, fx.nodes(spark, sf))


@query(f"""
WITH {NODES}, {EDGES}, r AS (SELECT s_suppkey AS question_id, i.*, n.name AS other_name, row_number() OVER (PARTITION BY s_suppkey ORDER BY n.name, i.type, i.edge_id) AS rn
  FROM supplier JOIN incident i ON i.node = 'S' || s_suppkey JOIN nodes n ON n.node_id = i.other WHERE i.type = CASE WHEN s_suppkey % 2 = 0 THEN 'in_nation' ELSE i.type END)
SELECT question_id, node, other, type FROM r WHERE rn <= 20
""")
def m4_expand(spark: SparkSession, sf: str) -> DataFrame:
    keys = supplier_keys(spark, sf)
    hints = keys.select("question_id", F.when(F.col("question_id") % 2 == 0, "in_nation").otherwise("no such type").alias("type"))
    return rea.expand(keys, stored_edges(spark, sf), stored_nodes(spark, sf), hints).select("question_id", "node", "other", "type")


@query(f"""
WITH {NODES}, {EDGES}, r AS (SELECT s_suppkey AS question_id, i.*, n.name AS other_name, row_number() OVER (PARTITION BY s_suppkey ORDER BY n.name, i.type, i.edge_id) AS rn
  FROM supplier JOIN incident i ON i.node = 'S' || s_suppkey JOIN nodes n ON n.node_id = i.other WHERE n.label = CASE WHEN s_suppkey % 3 = 2 THEN 'Nation' ELSE 'Part' END)
SELECT question_id, node, other, type, (CASE WHEN question_id % 3 = 0 THEN 1 WHEN question_id % 3 = 1 THEN 2 ELSE 1 END)::INT AS level FROM r WHERE rn <= 20
""")
def m5_plan_hop(spark: SparkSession, sf: str) -> DataFrame:
    keys = supplier_keys(spark, sf)
    k = F.col("question_id") % 3
    steps = keys.select("question_id", F.when(k == 2, "Nation").otherwise("Part").alias("target_type"), F.when(k == 0, "supplies").when(k == 1, "wrong").alias("relation_hint"), F.lit("both").alias("direction"))
    return rea.plan_hop(keys, steps, stored_edges(spark, sf), stored_nodes(spark, sf)).select("question_id", "node", "other", "type", "level")


#: Regions look for suppliers and nations for parts, both two hops away; others for a label that no node has, or for customers against the edges' direction.
@query(f"""
WITH {NODES}, {EDGES},
rs AS (SELECT n_regionkey AS k, s_suppkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_name, s_suppkey) AS rn FROM supplier JOIN nation ON n_nationkey = s_nationkey),
np AS (SELECT s_nationkey AS n, 'P' || l_partkey AS p, 'part#' || l_partkey AS name, min('S' || l_suppkey) AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3),
npr AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY name, p) AS rn FROM np WHERE n % 3 = 0),
nn AS (SELECT n_nationkey AS n, i.*, row_number() OVER (PARTITION BY n_nationkey ORDER BY m.name, i.type, i.edge_id) AS rn FROM nation JOIN incident i ON i.node = 'N' || n_nationkey JOIN nodes m ON m.node_id = i.other WHERE n_nationkey % 3 = 1),
nc AS (SELECT c_nationkey AS n, 'C' || c_custkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS rn FROM customer WHERE c_nationkey % 3 = 2)
SELECT DISTINCT k AS question_id, 'R' || k AS start, 'R' || k AS node, 'N' || n_nationkey AS other, 'in_region' AS type, 3 AS level FROM rs WHERE rn <= 20
UNION ALL SELECT k, 'R' || k, 'N' || n_nationkey, 'S' || s_suppkey, 'in_nation', 3 FROM rs WHERE rn <= 20
UNION ALL SELECT DISTINCT 100 + n, 'N' || n, 'N' || n, s, 'in_nation', 3 FROM npr WHERE rn <= 20
UNION ALL SELECT 100 + n, 'N' || n, s, p, 'supplies', 3 FROM npr WHERE rn <= 20
UNION ALL SELECT 100 + n, 'N' || n, node, other, type, 4 FROM nn WHERE rn <= 20
UNION ALL SELECT 100 + n, 'N' || n, 'N' || n, c, 'in_nation', 3 FROM nc WHERE rn <= 20
""")
def m5_nearby(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("question_id")
    regions = fx.table(spark, sf, "region").select(F.col("r_regionkey").alias("question_id"), F.concat(F.lit("R"), fx.text_of("r_regionkey")).alias("node"), F.lit("Supplier").alias("target_type"), F.lit("both").alias("direction"))
    nations = nation_keys(spark, sf).select((k + 100).alias("question_id"), "node", F.when(k % 3 == 0, "Part").when(k % 3 == 1, "No such label").otherwise("Customer").alias("target_type"), F.when(k % 3 == 2, "out").otherwise("both").alias("direction"))
    keys = regions.unionByName(nations).withColumn("relation_hint", F.lit(None).cast("string"))
    return rea.plan_hop(keys.select("question_id", "node"), keys.drop("node"), stored_edges(spark, sf), stored_nodes(spark, sf)).select("question_id", "start", "node", "other", "type", "level")


def supplier_places(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with their nation and region as nodes."""
    n = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.concat(F.lit("R"), fx.text_of("n_regionkey")).alias("region"))
    return fx.table(spark, sf, "supplier").join(n, "s_nationkey").select(F.col("s_suppkey").alias("question_id"), F.concat(F.lit("S"), fx.text_of("s_suppkey")).alias("node"), "n_name", "region")


@query("""
SELECT s_suppkey AS question_id, 1 AS hop, 'S' || s_suppkey AS node, 'N' || s_nationkey AS other, 'in_nation' AS type FROM supplier
UNION ALL SELECT s_suppkey, 2, 'N' || s_nationkey, 'R' || n_regionkey, 'in_region' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT s_suppkey, 2, 'S' || s_suppkey, 'N' || s_nationkey, 'in_nation' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT s_suppkey, 2, 'N' || s_nationkey, 'R' || n_regionkey, 'in_region' FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def m6_run_plans(spark: SparkSession, sf: str) -> DataFrame:
    plans = supplier_keys(spark, sf)
    steps = plans.select("question_id", F.explode(F.array(F.struct(F.lit(0).alias("step"), F.lit("Nation").alias("target_type")), F.struct(F.lit(1).alias("step"), F.lit("Region").alias("target_type")))).alias("s")).select("question_id", "s.step", F.lit("find_neighbors").alias("action"), "s.target_type", F.lit(None).cast("string").alias("relation_hint"), F.lit("out").alias("direction"))
    return rea.run_plans(plans, steps, stored_edges(spark, sf), stored_nodes(spark, sf)).select("question_id", "hop", "node", "other", "type")


#: The path from the region (first) to the supplier has two hops, against the edges; the next step, from both, is the third hop. Questions without steps take one plain hop.
@query(f"""
WITH {NODES}, {EDGES}, p AS (SELECT s_suppkey AS k, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
plain AS (SELECT s_suppkey AS k, i.*, row_number() OVER (PARTITION BY s_suppkey ORDER BY m.name, i.type, i.edge_id) AS rn FROM supplier JOIN incident i ON i.node = 'S' || s_suppkey JOIN nodes m ON m.node_id = i.other WHERE s_suppkey % 4 = 3),
near AS (SELECT r, 'N' || n_nationkey AS other FROM (SELECT DISTINCT n_regionkey AS r FROM nation) JOIN nation ON n_regionkey = r)
SELECT k AS question_id, 1 AS hop, 'R' || r AS node, 'N' || n AS other, 'in_region' AS type FROM p WHERE k % 4 <> 3
UNION ALL SELECT k, 2, 'N' || n, 'S' || k, 'in_nation' FROM p WHERE k % 4 <> 3
UNION ALL SELECT k, 3, 'S' || k, 'N' || n, 'in_nation' FROM p WHERE k % 4 = 0
UNION ALL SELECT k, 3, 'R' || r, other, 'in_region' FROM p JOIN near USING (r) WHERE k % 4 = 0
UNION ALL SELECT k, 1, node, other, type FROM plain WHERE rn <= 20
""")
def m6_paths(spark: SparkSession, sf: str) -> DataFrame:
    at, k = supplier_places(spark, sf), F.col("question_id")
    plans = at.where(k % 4 != 3).select("question_id", F.lit(0).alias("ord"), F.col("region").alias("node")).unionByName(at.select("question_id", F.lit(1).alias("ord"), "node"))
    none = F.lit(None).cast("string")
    first = at.where(k % 4 != 3).select("question_id", F.lit(0).alias("step"), F.lit("find_by_path").alias("action"), none.alias("target_type"), none.alias("relation_hint"), F.lit("both").alias("direction"))
    then = at.where(k % 4 == 0).select("question_id", F.lit(1).alias("step"), F.lit("find_neighbors").alias("action"), F.lit("Nation").alias("target_type"), none.alias("relation_hint"), F.lit("both").alias("direction"))
    return rea.run_plans(plans, first.unionByName(then), stored_edges(spark, sf), stored_nodes(spark, sf)).select("question_id", "hop", "node", "other", "type")


@query(f"""
WITH {NODES}, {EDGES}, p AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS node, 1.0::DOUBLE AS conf FROM supplier),
x AS (SELECT k, i.node, i.other, i.type, i.edge_id, m.name, conf * i.confidence AS path, row_number() OVER (PARTITION BY k, i.node ORDER BY m.name, i.type, i.edge_id) AS rn FROM p JOIN incident i ON i.node = p.node JOIN nodes m ON m.node_id = i.other),
y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY path DESC, name, edge_id) AS b FROM x WHERE rn <= 20)
SELECT k AS question_id, 1 AS hop, node, other, type, edge_id FROM y WHERE b <= 5
""")
def m7_run_guided(spark: SparkSession, sf: str) -> DataFrame:
    out = rea.run_guided(supplier_keys(spark, sf), stored_edges(spark, sf), stored_nodes(spark, sf), hops=1)
    return out.select("question_id", "hop", "node", "other", "type", "edge_id")


def told(at: DataFrame, then: str) -> DataFrame:
    """Decisions: to the nation, and from there by edges of the type `then` to a name that no node has."""
    both = F.array(F.struct(F.lit(1).alias("hop"), F.array(F.col("n_name"), F.lit("nobody")).alias("next_entities"), F.lit(then).alias("relation_filter")), F.struct(F.lit(2).alias("hop"), F.array(F.lit("nobody")).alias("next_entities"), F.lit(None).cast("string").alias("relation_filter")))
    return at.select("question_id", F.explode(both).alias("d")).select("question_id", "d.hop", F.lit(True).alias("go_on"), "d.next_entities", "d.relation_filter")


TOLD = """SELECT s_suppkey AS question_id, 1 AS hop, 'S' || s_suppkey AS node, 'N' || s_nationkey AS other, 'in_nation' AS type FROM supplier
UNION ALL SELECT s_suppkey, 2, 'N' || s_nationkey, 'R' || n_regionkey, 'in_region' FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


@query(TOLD)
def m7_decisions(spark: SparkSession, sf: str) -> DataFrame:
    at = supplier_places(spark, sf)
    return rea.run_guided(at, stored_edges(spark, sf), stored_nodes(spark, sf), decisions=told(at, "in_region"), limit=None).select("question_id", "hop", "node", "other", "type")


#: At the second hop the edges of the decided type touch no goal, so all types are looked at again.
@query(TOLD)
def m7_goals(spark: SparkSession, sf: str) -> DataFrame:
    at = supplier_places(spark, sf)
    goals = at.select("question_id", F.col("region").alias("node"))
    return rea.run_guided(at, stored_edges(spark, sf), stored_nodes(spark, sf), goals=goals, decisions=told(at, "in_nation"), limit=None).select("question_id", "hop", "node", "other", "type")


# ── evidence ──


def sketch(prompts: list[str]) -> list[str]:
    """A model for a15_batch: fails on every supplier number that ends in 3."""
    out = []
    for p in prompts:
        name = p.split("## Question\n", 1)[1].split("位于", 1)[0]
        if name.endswith("3"):
            raise ValueError("refused")
        out.append(f"{name} is where its nation is.推理过程:one;two")
    return out


@query(f"""
WITH {NODES}, {EDGES}, r AS (SELECT s_suppkey AS k, i.confidence, row_number() OVER (PARTITION BY s_suppkey ORDER BY n.name, i.type, i.edge_id) AS rn FROM supplier JOIN incident i ON i.node = 'S' || s_suppkey JOIN nodes n ON n.node_id = i.other),
c AS (SELECT k, product(confidence) AS c FROM r WHERE rn <= 20 GROUP BY k)
SELECT s_suppkey AS question_id, CASE WHEN s_suppkey % 10 = 3 THEN 'FAILED' ELSE 'DONE' END AS status, CASE WHEN s_suppkey % 10 <> 3 THEN s_name || ' is where its nation is.' END AS answer,
  CASE WHEN s_suppkey % 10 <> 3 THEN 'one|two' END AS steps, CASE WHEN s_suppkey % 10 <> 3 THEN round(c + 1e-9, 5) END AS confidence, CASE WHEN s_suppkey % 10 = 3 THEN 'refused' END AS error FROM supplier JOIN c ON k = s_suppkey
""")
def a15_batch(spark: SparkSession, sf: str) -> DataFrame:
    q = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("question_id"), F.concat("s_name", F.lit("位于何处？")).alias("text"))
    out = batch.answer_batch(q, stored_nodes(spark, sf), stored_edges(spark, sf), sketch)
    return out.select("question_id", "status", "answer", joined("steps").alias("steps"), F.round(F.col("confidence") + 1e-9, 5).alias("confidence"), "error")



def order_edges(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.triples(spark, sf)
    return t.select(F.floor(F.col("ord") / 10).alias("question_id"), (F.col("ord") % 10 % 2).cast("int").alias("hop"), "ord", F.col("subject").alias("source"), F.col("predicate").alias("type"), F.col("object").alias("target"), "confidence", F.col("source").alias("source_chunk_id"), F.col("properties")["line"].alias("source_text"))


ORDER_EDGES = "oe AS (SELECT ord // 10 AS question_id, (ord % 10 % 2)::INT AS hop, ord, subject AS source, predicate AS type, object AS target, confidence, source AS chunk, line FROM triples)"


@query(f"""WITH {TRIPLES}, {ORDER_EDGES} SELECT question_id, count(*)::INT AS n_edges, round(product(confidence) + 1e-9, 6) AS confidence,
 arg_min(source, hop::BIGINT * 1000000000000 + ord) || '|' || string_agg(target, '|' ORDER BY hop, ord) AS path FROM oe GROUP BY question_id""")
def a2_chains(spark: SparkSession, sf: str) -> DataFrame:
    return evi.chains(order_edges(spark, sf)).select("question_id", "n_edges", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), joined("path").alias("path"))


@query(f"""WITH {TRIPLES}, {ORDER_EDGES}, f AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk ORDER BY hop, ord) AS rn FROM oe WHERE line <> '')
SELECT question_id, 1 AS rank, chunk AS chunk_id, line AS text, source || ' --' || type || '--> ' || target AS relation FROM f WHERE rn = 1""")
def a6_citations(spark: SparkSession, sf: str) -> DataFrame:
    return evi.citations(order_edges(spark, sf))


@query(f"WITH {NODES} SELECT c_custkey AS question_id, c_name AS name, 'segment=' || c_mktsegment AS description FROM customer UNION ALL SELECT p_partkey, 'part#' || p_partkey, p_name FROM part")
def a7_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    n = fx.nodes(spark, sf).where("label in ('Customer', 'Part')")
    rows = n.select(F.substring("node_id", 2, 20).cast("long").alias("question_id"), F.lit(1).alias("hop"), F.lit(1).alias("ord"), "name", "label", "properties")
    return evi.entity_descriptions(rows)


@query("""SELECT conv_id, turn, round(greatest(0.0, least(1.0, 0.6 - (CASE WHEN contains(text, 'is') THEN 0.0 ELSE 0.0 END) - (CASE WHEN len(trim(text)) < 20 THEN 0.1 ELSE 0.0 END))), 6) AS confidence FROM conversations WHERE text IS NOT NULL""")
def a13_answer_confidence(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.round(evi.answer_confidence(F.col("text")), 6).alias("confidence"))


@query(f"WITH {TRIPLES}, {ORDER_EDGES} SELECT question_id, hop, count(*) AS n_edges, count(DISTINCT target) AS n_nodes, round(product(confidence) + 1e-9, 6) AS confidence FROM oe GROUP BY 1, 2")
def a14_report(spark: SparkSession, sf: str) -> DataFrame:
    return evi.report(order_edges(spark, sf)).select("question_id", "hop", "n_edges", "n_nodes", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"))


# ── training ──


@query("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def d2_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return training.conversation_samples(fx.table(spark, sf, "conversations"))


@query("""WITH d AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, t, unnest(range(0, len(t), 192)) AS s FROM d)
SELECT doc_id, (s // 192)::INT AS window, len(t[s + 1 : s + 256])::INT AS n_tokens, sha256(array_to_string(t[s + 1 : s + 256], ' ')) AS sha FROM w""")
def d4_token_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("tokens"))
    return training.token_windows(d, 256, 64).select("doc_id", "window", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("sha"))


@query("""SELECT o_orderkey, (CASE WHEN count(*) < 4 THEN count(*) ELSE 4 END)::INT AS n_real, greatest(0, least(count(*), 4) - 1)::INT AS n_kept FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def d6_label_masks(spark: SparkSession, sf: str) -> DataFrame:
    ids = fx.table(spark, sf, "lineitem").join(fx.table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.concat(F.array(F.lit(7)), F.slice(F.array_repeat(F.lit(1), F.count("*").cast("int")), F.lit(2), F.greatest(F.count("*").cast("int") - 1, F.lit(0)))).alias("ids"))
    p = ids.select("o_orderkey", training.padded(F.col("ids"), 4).alias("p"))
    labels = training.masked_labels(F.col("p.input_ids"), F.col("p.attention_mask"), [7])
    return p.select("o_orderkey", F.size(F.filter("p.attention_mask", lambda x: x == 1)).alias("n_real"), F.size(F.filter(labels, lambda x: x != -100)).alias("n_kept"))


# ── statistics and samples ──


@query(f"WITH {TRIPLES} SELECT predicate, count(*) AS n, count(*) FILTER (WHERE subject = object) AS self_loops, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM triples GROUP BY predicate")
def x1_predicate_profile(spark: SparkSession, sf: str) -> DataFrame:
    return stats.predicate_profile(fx.triples(spark, sf)).select("predicate", "n", "self_loops", F.round("share", 6).alias("share"))


@query(f"""WITH {TRIPLES}, {FILTERED}, d AS (SELECT DISTINCT s, predicate, o FROM kept WHERE s <> '' AND o <> '')
SELECT 0 AS pos, 'raw' AS stage, count(*) AS n FROM triples UNION ALL SELECT 1, 'filtered', count(*) FROM kept UNION ALL SELECT 2, 'unique', count(*) FROM d""")
def x2_reduction(spark: SparkSession, sf: str) -> DataFrame:
    names = fx.table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    out, _ = stats.reduction(fx.triples(spark, sf), [("filtered", lambda t: triples.filter_triples(t, names, ["supplies"])), ("unique", triples.dedup_triples)])
    return out


@query("""SELECT o_orderkey AS question_id, count(DISTINCT l_partkey) AS expected, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS found,
 round(count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) / count(DISTINCT l_partkey)::DOUBLE, 6) AS ratio FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def x3_qa_scores(spark: SparkSession, sf: str) -> DataFrame:
    j = fx.table(spark, sf, "lineitem").join(fx.table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.col("l_partkey").cast("string")
    pairs = j.groupBy(F.col("o_orderkey").alias("question_id")).agg(F.collect_list(name).alias("expected_entities"), F.lit(1).alias("expected_hops"))
    found = j.where("l_returnflag = 'R'").select(F.col("o_orderkey").alias("question_id"), F.lit(1).alias("hop"), name.alias("name"))
    return stats.qa_scores(pairs, found).select("question_id", "expected", "found", F.round("ratio", 6).alias("ratio"))


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS t FROM orders),
p AS (SELECT DISTINCT floor(k * t::DOUBLE / greatest(1, floor(t * 0.2)))::BIGINT AS i FROM (SELECT t, unnest(range(0, greatest(1, floor(t * 0.2)::BIGINT))) AS k FROM (SELECT DISTINCT t FROM n)))
SELECT o_orderkey FROM n JOIN p USING (i)""")
def s7_even_sample(spark: SparkSession, sf: str) -> DataFrame:
    return files.even_sample(fx.table(spark, sf, "orders"), ["o_orderkey"], ratio=0.2).select("o_orderkey")


@query(f"WITH {NODES} SELECT DISTINCT name FROM nodes WHERE name <> ''")
def s8_node_names(spark: SparkSession, sf: str) -> DataFrame:
    return files.node_names(fx.nodes(spark, sf))
