"""More registered queries, for operators whose inputs are tables of keys, responses or annotations. Each
reads the whole of its tables, though some keep the rows of one label or kind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch
from ..operators import entities as ent
from ..operators import evidence as evi
from ..operators import graph as g
from ..operators import questions as que
from ..operators import reasoning as rea
from ..operators import responses as res
from ..operators import sections as sec
from ..operators import stats, store, training, triples, validation
from ..operators.components import shared_dir
from ..sources import files
from . import fixtures as fx
from .fixtures import EDGES, ENTITIES, NODES, QUESTIONS, TRIPLES
from .queries import ORACLE, ORDER_EDGES, joined, order_edges, query, stored_edges, stored_nodes, supplier_keys


def quoted(c) -> F.Column:
    """A JSON string of a column without quotes, backslashes or control characters."""
    return F.concat(F.lit('"'), c, F.lit('"'))


# ── graph: tables of keys ──


@query(f"WITH {NODES} SELECT name AS key, arg_min(node_id, label || chr(1) || node_id) AS node_id, arg_min(label, label || chr(1) || node_id) AS label FROM nodes GROUP BY name")
def g1_find_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = fx.nodes(spark, sf)
    return g.find_nodes(n.select(F.col("name").alias("key")).distinct(), n).select("key", "node_id", "label")


@query("SELECT 'Part' AS label, 'brand' AS property, p_brand AS value, 'P' || p_partkey AS node_id FROM part UNION ALL SELECT 'Nation', 'name', n_name, 'N' || n_nationkey FROM nation")
def g2_by_property(spark: SparkSession, sf: str) -> DataFrame:
    brands = fx.table(spark, sf, "part").select(F.lit("Part").alias("label"), F.lit("brand").alias("property"), F.col("p_brand").alias("value"))
    names = fx.table(spark, sf, "nation").select(F.lit("Nation").alias("label"), F.lit("name").alias("property"), F.col("n_name").alias("value"))
    return g.by_property(brands.unionByName(names), fx.nodes(spark, sf)).select("label", "property", "value", "node_id")


@query(f"WITH {EDGES} SELECT src, type, dst, confidence, source_chunk_id FROM edges JOIN supplier ON src = 'S' || s_suppkey AND (type = 'in_nation' OR (type = 'supplies' AND dst = 'P' || s_suppkey))")
def g3_edge_properties(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.table(spark, sf, "supplier")
    src, key = F.concat(F.lit("S"), fx.text_of("s_suppkey")), fx.text_of("s_suppkey")
    keys = s.select(src.alias("src"), F.lit("in_nation").alias("type"), F.concat(F.lit("N"), fx.text_of("s_nationkey")).alias("dst")).unionByName(s.select(src.alias("src"), F.lit("supplies").alias("type"), F.concat(F.lit("P"), key).alias("dst")))
    return g.edge_properties(keys, fx.edges(spark, sf)).select("src", "type", "dst", "confidence", "source_chunk_id")


@query(f"""WITH {NODES}, q AS (SELECT DISTINCT 'N_' || n_nationkey AS query FROM nation UNION SELECT DISTINCT '#' || (p_partkey % 50) FROM part UNION SELECT ''),
h AS (SELECT query, node_id, name, row_number() OVER (PARTITION BY query ORDER BY name, node_id) AS rank FROM q JOIN nodes ON contains(name, query))
SELECT query, rank::INT AS rank, node_id FROM h WHERE rank <= 10""")
def g6_search_nodes(spark: SparkSession, sf: str) -> DataFrame:
    q = fx.table(spark, sf, "nation").select(F.concat(F.lit("N_"), fx.text_of("n_nationkey")).alias("query")).unionByName(fx.table(spark, sf, "part").select(F.concat(F.lit("#"), (F.col("p_partkey") % 50).cast("string")).alias("query")))
    empty = fx.table(spark, sf, "region").select(F.lit("").alias("query"))
    return g.search_nodes(q.unionByName(empty), fx.nodes(spark, sf)).select("query", "rank", "node_id")


@query(f"""WITH {NODES}, {EDGES},
near AS (SELECT i.node, i.other, i.edge_id, row_number() OVER (PARTITION BY i.node ORDER BY n.name, i.type, i.edge_id) AS rn FROM incident i JOIN nodes n ON n.node_id = i.other),
one AS (SELECT s_suppkey AS k, node, other, edge_id FROM supplier JOIN near ON node = 'S' || s_suppkey WHERE rn <= 20),
two AS (SELECT o.k, n.node, n.other, n.edge_id FROM (SELECT DISTINCT k, other FROM one WHERE other <> 'S' || k) o JOIN near n ON n.node = o.other WHERE rn <= 20)
SELECT k AS question_id, 1 AS level, node, other, edge_id FROM one UNION ALL SELECT k, 2, node, other, edge_id FROM two""")
def g9_node_context(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = g.node_context(supplier_keys(spark, sf), stored_edges(spark, sf, "edge_id", "src", "dst", "type"), stored_nodes(spark, sf), 2)
    return edges.select("question_id", "level", "node", "other", "edge_id")


@query(f"WITH {ENTITIES}, e AS (SELECT trim(name) AS name, arg_max(entity_type, ord) AS label FROM entities GROUP BY trim(name)), {TRIPLES}, t AS (SELECT DISTINCT trim(x) AS name FROM (SELECT subject AS x FROM triples UNION SELECT object FROM triples) WHERE trim(x) <> '') SELECT name, label FROM e UNION ALL SELECT name, '自动创建' FROM t WHERE name NOT IN (SELECT name FROM e)")
def b3_name_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entities(spark, sf)
    nodes, _ = g.upsert_nodes(e)
    return g.name_labels(e, g.auto_nodes(fx.triples(spark, sf), nodes))


@query(f"""WITH {ENTITIES}, {TRIPLES}, n AS (SELECT DISTINCT entity_type, trim(name) AS name FROM entities), t AS (SELECT DISTINCT trim(x) AS name FROM (SELECT subject AS x FROM triples UNION SELECT object FROM triples) WHERE trim(x) <> '')
SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM t WHERE name NOT IN (SELECT name FROM n)) AS auto_created, (SELECT count(*) FROM triples WHERE trim(subject) <> '' AND trim(object) <> '') AS relations_created, 0::BIGINT AS errors""")
def b5_build_stats(spark: SparkSession, sf: str) -> DataFrame:
    e, t = fx.entities(spark, sf), fx.triples(spark, sf)
    nodes, rejects = g.upsert_nodes(e)
    return g.build_stats(e, t, nodes, g.auto_nodes(t, nodes), rejects)


# ── entities and triples ──


@query(f"""WITH {ENTITIES}, s AS (SELECT DISTINCT p_brand AS grp, lower(p_name) AS k FROM part), f AS (SELECT grp, min(k) AS first FROM s GROUP BY grp), m AS (SELECT k, arg_max(first, grp) AS first FROM s JOIN f USING (grp) GROUP BY k)
SELECT ord, coalesce(first, lower(trim(name))) AS canonical FROM entities LEFT JOIN m ON k = lower(trim(name))""")
def e2_canonical(spark: SparkSession, sf: str) -> DataFrame:
    synonyms = fx.table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.lower("p_name").alias("pos"), F.col("p_name").alias("name")).distinct()
    return ent.canonical(fx.entities(spark, sf), synonyms).select("ord", "canonical")


PAIRED = """pairs AS (SELECT a.p_partkey AS k, a.p_name AS na, b.p_name AS nb, a.p_type AS ta, b.p_type AS tb, a.p_brand AS ba, b.p_brand AS bb FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
gr AS (SELECT *, list_distinct(list_transform(range(1, len(replace(na, ' ', ''))), lambda i: substr(replace(na, ' ', ''), i, 2))) AS x, list_distinct(list_transform(range(1, len(replace(nb, ' ', ''))), lambda i: substr(replace(nb, ' ', ''), i, 2))) AS y FROM pairs)"""


@query(f"""WITH {PAIRED} SELECT k, round(0.5 * CASE WHEN na = nb OR ba = bb THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END
  + 0.3 * CASE WHEN lower(ta) = lower(tb) THEN 1.0 WHEN contains(lower(ta), lower(tb)) OR contains(lower(tb), lower(ta)) THEN 0.5 ELSE 0.0 END
  + 0.2 * CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.5 END, 6) AS likeness FROM gr""")
def e8_similarity(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "part")
    own = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("size"), F.lit("1"))).otherwise(F.create_map(F.lit("size"), F.lit("1"), F.lit("brand"), F.lit("2")))
    e = p.select(F.col("p_partkey").alias("k"), F.struct(F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.lower("p_name").alias("canonical"), F.col("p_type").alias("entity_type"), own.alias("properties")).alias("e"))
    pairs = e.select("k", F.col("e").alias("a")).join(e.select((F.col("k") - 1).alias("k"), F.col("e").alias("b")), "k")
    return pairs.select("k", F.round(ent.similarity("a", "b"), 6).alias("likeness"))


@query("""WITH l AS (SELECT o_orderkey AS k, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS names FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING count(DISTINCT s_name) >= 2) SELECT k AS key, names FROM l""")
def p1_with_mentions(spark: SparkSession, sf: str) -> DataFrame:
    j = fx.table(spark, sf, "lineitem").join(fx.table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(fx.table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    texts = j.groupBy(F.col("o_orderkey").alias("key")).agg(F.array_join(F.collect_list("s_name"), ", ").alias("content"))
    return triples.with_mentions(texts, fx.table(spark, sf, "supplier").select(F.col("s_name").alias("name"))).select("key", joined("names").alias("names"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem),
s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), c AS (SELECT s.l_orderkey, s.l_linenumber, (SELECT count(*) FROM lineitem x WHERE x.l_orderkey = s.l_orderkey AND x.l_linenumber < s.l_linenumber) AS n FROM s)
SELECT c.l_orderkey AS doc_id, c.l_linenumber AS idx, string_agg('part#' || e.l_partkey, '|' ORDER BY e.r) AS names FROM c JOIN e ON e.l_orderkey = c.l_orderkey AND e.r <= c.n AND e.r > c.n - 2 GROUP BY 1, 2""")
def p15_rolling_context(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), F.struct("l_partkey", "l_suppkey").alias("ord"), F.concat(F.lit("part#"), fx.text_of("l_partkey")).alias("name"))
    return triples.rolling_context(e, e.select("doc_id", "idx").distinct(), 2).select("doc_id", "idx", joined("names").alias("names"))


#: A section a document, with one response each: readable, annotated and self-looping by id; names are those of its language and source.
SECTIONS = """sections AS (SELECT doc_id, doc_id || '::sec_0' AS chunk_id, lang || ' and ' || source || ' and more' AS content, lang, source FROM documents)"""


def labelled_sections(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = fx.table(spark, sf, "documents")
    key = F.concat(fx.text_of("doc_id"), F.lit("::sec_0"))
    sections = d.select("doc_id", key.alias("chunk_id"), F.concat_ws(" and ", "lang", "source", F.lit("more")).alias("content"))
    names = d.select(F.explode(F.array("lang", "source")).alias("name")).where("name is not null").distinct()
    k = F.col("doc_id") % 4
    body = F.concat(F.lit('[{"subject": '), quoted(F.when(k == 1, F.concat("lang", F.lit("（x）"))).otherwise(F.col("lang"))), F.lit(', "predicate": "uses", "object": '), quoted(F.when(k == 2, F.col("lang")).otherwise(F.col("source"))), F.lit(', "confidence": 0.5}]'))
    responses = d.select(key.alias("chunk_id"), F.lit(0).alias("attempt"), F.when(k == 3, "none").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("text"), F.lit(None).cast("string").alias("error"))
    return sections, names, responses


@query(f"""WITH {SECTIONS} SELECT min(chunk_id) AS source, lang AS subject, 'uses' AS predicate, source AS object, 0.5::DOUBLE AS confidence, arg_min(content, chunk_id) AS source_text
FROM sections WHERE doc_id % 4 < 2 AND lang <> source GROUP BY lang, source""")
def t6_extract_triples(spark: SparkSession, sf: str) -> DataFrame:
    out = triples.extract_triples(*labelled_sections(spark, sf))
    return out.select("source", "subject", "predicate", "object", "confidence", F.col("properties")["source_text"].alias("source_text"))


@query("""SELECT a.doc_id // 2 AS doc, a.lang AS subject, b.source AS object FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0 AND a.lang <> b.source""")
def t7_cross_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select("doc_id", "lang", "source")
    sections = d.select((F.col("doc_id") - F.col("doc_id") % 2).cast("long").alias("doc_id"), fx.text_of("doc_id").alias("chunk_id"), F.col("lang").alias("content"))
    pair = d.where("doc_id % 2 = 0").join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source").alias("next")), "doc_id")
    body = F.concat(F.lit('[{"subject": '), quoted("lang"), F.lit(', "predicate": "uses", "object": '), quoted("next"), F.lit("}]"))
    rows = pair.select(fx.text_of("doc_id").alias("chunk_id"), F.explode(F.array(F.struct(F.lit(0).alias("attempt"), F.lit(" ").alias("text")), F.struct(F.lit(1).alias("attempt"), body.alias("text")))).alias("r"))
    responses = rows.select("chunk_id", "r.attempt", "r.text", F.lit(None).cast("string").alias("error"))
    names = d.select(F.explode(F.array("lang", "source")).alias("name")).where("name is not null").distinct()
    out = triples.extract_triples(sections, names, responses, cross=True)
    return out.select((F.col("chunk_id").cast("long") / 2).cast("long").alias("doc"), "subject", "object")


@query(f"WITH {TRIPLES} SELECT ord, substr(subject, 1, 8) = 'Supplier' AND predicate = 'supplies' AND object IN (SELECT p_name FROM part) AND NOT contains(subject, '(') AS allowed FROM triples")
def v4_check_constraints(spark: SparkSession, sf: str) -> DataFrame:
    types = fx.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("Supplier").alias("entity_type")).unionByName(fx.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.lit("Part").alias("entity_type")).distinct())
    constraints = spark.createDataFrame([("Supplier", "supplies", "Part"), ("Part", "supplies", "Supplier")], "source_type string, relation string, target_type string")
    return validation.check_constraints(fx.triples(spark, sf), types, constraints).select("ord", "allowed")


@query("SELECT p_name AS name, CASE WHEN min(p_partkey % 3) = 0 THEN 'new' ELSE 'old' END AS definition FROM part GROUP BY p_name")
def v5_register(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "part")
    old = p.select(F.col("p_name").alias("name"), F.lit("old").alias("definition")).distinct()
    return validation.register(old, p.where("p_partkey % 3 = 0").select(F.col("p_name").alias("name"), F.lit("new").alias("definition")).distinct())


# ── responses and questions ──


@query("""SELECT p_partkey AS prompt_id, trim(p_name) AS name, p_type AS entity_type, p_brand AS alias, p_size::VARCHAR AS size FROM part WHERE p_partkey % 5 < 4""")
def p8_entity_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "part")
    k = F.col("p_partkey") % 5
    item = F.concat(F.lit('[{"name": " '), "p_name", F.lit(' ", '), F.when(k == 1, '"entity_type"').otherwise('"type"'), F.lit(': '), quoted("p_type"), F.lit(', "aliases": ['), quoted("p_brand"), F.lit('], "properties": {"size": '), fx.text_of("p_size"), F.lit('}}, {"name": 7}, {"type": "no name"}]'))
    text = F.when(k == 2, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).when(k == 3, F.concat(F.lit("<think>[1]</think>"), item)).when(k == 4, F.lit('{"name": "no list"}')).otherwise(item)
    out = res.entity_rows(p.select(F.col("p_partkey").alias("prompt_id"), text.alias("text")))
    return out.select("prompt_id", "name", "entity_type", F.get("aliases", F.lit(0)).alias("alias"), F.col("properties")["size"].alias("size"))


@query("""SELECT p_partkey AS prompt_id, 'entity' AS kind, p_name AS name FROM part WHERE p_partkey % 4 <> 3 UNION ALL SELECT p_partkey, 'triple', p_name || ' made by ' || p_brand FROM part WHERE p_partkey % 4 IN (0, 1, 3)""")
def p10_incremental_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    e = F.concat(F.lit('[{"name": '), quoted("p_name"), F.lit(', "type": "Part"}]'))
    r = F.concat(F.lit('[{"subject": '), quoted("p_name"), F.lit(', "relation": "made by", "object": '), quoted("p_brand"), F.lit("}]"))
    text = F.when(k == 0, F.concat(F.lit('{"new_entities": '), e, F.lit(', "relations": '), r, F.lit("}"))).when(k == 1, F.concat(F.lit('{"entities": '), e, F.lit(', "relations": '), r, F.lit("}"))).when(k == 2, e).otherwise(F.concat(F.lit('{"relations": '), r, F.lit("}")))
    es, ts = res.incremental_rows(p.select(F.col("p_partkey").alias("prompt_id"), text.alias("text")))
    return es.select("prompt_id", F.lit("entity").alias("kind"), "name").unionByName(ts.select("prompt_id", F.lit("triple").alias("kind"), F.concat_ws(" ", "subject", "predicate", "object").alias("name")))


@query("""SELECT p_partkey AS prompt_id, CASE p_partkey % 4 WHEN 0 THEN 'so ' || p_partkey WHEN 1 THEN 'then' WHEN 2 THEN 'thus' END AS trace, '{"n":' || p_size || '}' AS payload FROM part WHERE p_partkey % 4 <> 3""")
def p12_annotation_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "part")
    k, body = F.col("p_partkey") % 4, F.concat(F.lit('{"n": '), fx.text_of("p_size"), F.lit("}"))
    text = F.when(k == 0, F.concat(F.lit("<think> so "), fx.text_of("p_partkey"), F.lit("</think>"), body)).when(k == 1, F.concat(F.lit("then\n```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("thus "), body)).otherwise("nothing")
    return res.annotation_rows(p.select(F.col("p_partkey").alias("prompt_id"), text.alias("text")))


@query("""SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'hint' END AS domain, CASE WHEN s_suppkey % 2 = 0 THEN '[{"definition":"d","label":"l","name":"' || s_name || '"}]' ELSE '[]' END AS entity_types FROM supplier""")
def p13_schema_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.table(spark, sf, "supplier")
    item = F.concat(F.lit('{"name": '), quoted("s_name"), F.lit(', "label": "l"'), F.when(F.col("s_suppkey") % 2 == 0, ', "definition": "d"').otherwise(""), F.lit("}"))
    text = F.concat(F.lit('{"domain_name": '), quoted("s_name"), F.lit(', "entity_types": ['), item, F.lit('], "relation_types": []}'))
    return res.schema_rows(s.select(text.alias("text")), "hint").select("domain", "entity_types")


@query(f"""WITH {QUESTIONS} SELECT question_id, CASE WHEN question_id % 3 = 1 AND question_id % 8 <> 7 THEN 'COUNT' WHEN question_id % 3 = 2 AND question_id % 8 <> 7 THEN 'EXPLAIN' ELSE '-' END AS intent, CASE WHEN question_id % 3 > 0 AND question_id % 8 <> 7 THEN 'e' || question_id ELSE '-' END AS entities FROM questions""")
def q6_parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    q = fx.questions(spark, sf)
    k = F.col("question_id") % 3
    body = F.concat(F.lit('{"intent": "'), F.when(k == 1, " count ").otherwise("SING"), F.lit('", "entities": ["e'), fx.text_of("question_id"), F.lit('"], "constraints": {"max_hops": 2}}'))
    out = que.parse_responses(q, q.select("question_id", F.when(k == 0, F.lit("no object")).otherwise(body).alias("response")))
    read = (k > 0) & (F.trim("text") != "")
    return out.select("question_id", F.when(read, F.col("intent")).otherwise("-").alias("intent"), F.when(read, joined("entities")).otherwise("-").alias("entities"))


@query("""SELECT c_custkey AS question_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'x' || c_custkey END AS start, 0 AS step, CASE c_custkey % 3 WHEN 2 THEN 'find_by_path' ELSE 'find_neighbors' END AS action, CASE c_custkey % 3 WHEN 1 THEN 'supplies' END AS relation_hint, CASE c_custkey % 3 WHEN 1 THEN 'out' ELSE 'both' END AS direction FROM customer""")
def q8_response_plans(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "customer")
    k, i = F.col("question_id") % 3, fx.text_of("question_id")
    parsed = c.select(F.col("c_custkey").alias("question_id"), F.array("c_name").alias("entities"), F.array().cast("array<string>").alias("relation_hints"))
    one = F.concat(F.lit('{"start_entities": ["x'), i, F.lit('"], "steps": [{"action": "walk", "relation_hint": ["supplies", "b"], "direction": "out"}]}'))
    two = F.concat(F.lit('{"start_entities": ["x'), i, F.lit('"], "steps": [{"action": "find_by_path", "direction": "up"}]}'))
    plans, steps = que.response_plans(parsed, parsed.select("question_id", F.when(k == 0, F.lit('{"steps": []}')).when(k == 1, one).otherwise(two).alias("response")), spark.createDataFrame([("Part",)], "label string"))
    return steps.join(plans, "question_id").select("question_id", joined("start_entities").alias("start"), "step", "action", "relation_hint", "direction")


# ── reasoning and evidence ──


@query(f"WITH {NODES} SELECT DISTINCT name FROM nodes WHERE name NOT IN (SELECT name FROM nodes WHERE label IN ('Region', 'Nation'))")
def m2_concrete(spark: SparkSession, sf: str) -> DataFrame:
    n = fx.nodes(spark, sf)
    return rea.concrete(n.select("name").distinct(), n, ["Region", "Nation"])


@query(f"WITH {EDGES} SELECT edge_id, confidence, coalesce(source_text, '') AS source_text, coalesce(source_chunk_id, '') AS source_chunk_id FROM edges")
def m11_evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.edges(spark, sf)
    return rea.evidence_rows(e.withColumn("confidence", F.nullif("confidence", F.lit(1.0)))).select("edge_id", "confidence", "source_text", "source_chunk_id")


STEPS = f"{ORDER_EDGES}, st AS (SELECT question_id, dense_rank() OVER (PARTITION BY question_id ORDER BY hop) AS hop, r, ns FROM (SELECT question_id, hop, arg_min(type, ord) AS r, array_to_string(list_distinct(list(target)), '|') AS x, list(target ORDER BY ord) AS ns FROM oe GROUP BY 1, 2))"


@query(f"WITH {TRIPLES}, {STEPS} SELECT question_id, hop::INT AS hop, r AS relation_used, len(list_distinct(ns))::INT AS n, ns[1] AS first FROM st")
def a1_append_hop(spark: SparkSession, sf: str) -> DataFrame:
    steps, _ = evi.append_hop(order_edges(spark, sf))
    return steps.select("question_id", "hop", "relation_used", F.size("nodes_explored").alias("n"), F.get("nodes_explored", F.lit(0)).alias("first"))


@query(f"WITH {TRIPLES}, {STEPS} SELECT question_id, hop::INT AS hop, '第' || hop || '跳: 通过' || r || '探索 ' || ns[1] AS text FROM st WHERE len(list_distinct(ns)) = 1")
def a8_step_texts(spark: SparkSession, sf: str) -> DataFrame:
    steps, _ = evi.append_hop(order_edges(spark, sf))
    return evi.step_texts(steps.where(F.size("nodes_explored") == 1))


@query("""WITH q AS (SELECT doc_id AS question_id, 'Answer from the evidence.' || repeat(chr(10), 2) || '## Question' || chr(10) || text AS p FROM documents WHERE text IS NOT NULL)
SELECT question_id, least(len(p), 300)::INT AS n, sha256(CASE WHEN len(p) > 300 THEN substr(p, 1, 299) || '…' ELSE p END) AS sha FROM q""")
def a9_contexts(spark: SparkSession, sf: str) -> DataFrame:
    q = fx.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("question_id"), "text")
    none = q.where("false")
    xml = none.select("question_id", F.lit("").alias("xml"))
    steps = none.select("question_id", F.lit(1).alias("hop"), F.lit("").alias("reasoning"), F.lit("").alias("relation_used"), F.array(F.lit("")).alias("nodes_explored"))
    cites = none.select("question_id", F.lit(1).alias("rank"), F.lit("").alias("chunk_id"), F.lit("").alias("text"))
    return evi.contexts(q, xml, steps, cites, 300).select("question_id", F.length("prompt").alias("n"), F.sha2("prompt", 256).alias("sha"))


@query(f"WITH {TRIPLES}, {ORDER_EDGES} SELECT question_id, ord, source, target FROM oe UNION ALL SELECT -1 - c_custkey, 0, c_name, NULL FROM customer")
def a12_evidence_list(spark: SparkSession, sf: str) -> DataFrame:
    edges = order_edges(spark, sf)
    alone = fx.table(spark, sf, "customer").select((-1 - F.col("c_custkey")).cast("long").alias("question_id"), F.lit(1).alias("hop"), F.lit(1).cast("long").alias("ord"), F.col("c_name").alias("name"))
    more = alone.select("question_id", "hop", F.lit(2).cast("long").alias("ord"), F.lit("later").alias("name"))
    ids = edges.select("question_id").unionByName(alone.select("question_id")).distinct()
    return evi.evidence_list(ids, edges, alone.unionByName(more)).select("question_id", "ord", "source", "target")


# ── sections, training, sources ──


@query("SELECT doc_id, 0 AS idx FROM documents WHERE trim(text) <> ''")
def c10_first_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    return sec.first_sections(sec.split_sections(d, 1500, content="text"), 1).select("doc_id", "idx")


@query("""SELECT p_partkey::VARCHAR AS chunk_id, 'entities' AS task_type, p_partkey % 2 = 0 AS thought FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey::VARCHAR, 'triples', p_partkey % 2 = 0 FROM part WHERE p_partkey % 3 = 2""")
def d1_annotation_samples(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    e, t = F.array(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("type"))), F.array(F.struct(F.col("p_name").alias("subject"), F.lit("by").alias("predicate"), F.col("p_brand").alias("object")))
    a = fx.table(spark, sf, "part").select(fx.text_of("p_partkey").alias("chunk_id"), F.col("p_name").alias("text"), F.when(k % 2 == 0, "why").otherwise("").alias("trace"), F.when(k % 3 > 0, e).otherwise(F.filter(e, lambda x: F.lit(False))).alias("entities"), F.when(k % 3 == 2, t).otherwise(F.filter(t, lambda x: F.lit(False))).alias("triples"))
    return training.annotation_samples(a).select("chunk_id", "task_type", F.contains("text", F.lit("<think>why</think>")).alias("thought"))


@query("SELECT conv_id, turn, '<|im_start|>system' || chr(10) || 'You turn text into graph facts.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || role || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'ctx' ELSE '' END || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || text || '<|im_end|>' || chr(10) AS text FROM conversations WHERE text IS NOT NULL")
def d2_qa_samples(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations").where("text is not null")
    return training.qa_samples(c.select("conv_id", "turn", F.col("role").alias("question"), F.col("text").alias("answer"), F.when(F.col("turn") % 2 == 0, "ctx").otherwise("").alias("context"))).select("conv_id", "turn", "text")


@query("SELECT doc_id, text FROM documents WHERE trim(text) <> ''")
def d3_corpus_rows(spark: SparkSession, sf: str) -> DataFrame:
    return training.corpus_rows(fx.table(spark, sf, "documents"))


@query("SELECT r_name || '.MD' AS filename, true AS accepted FROM region UNION ALL SELECT n_name || '.txt', false FROM nation")
def s3_checked_extension(spark: SparkSession, sf: str) -> DataFrame:
    names = fx.table(spark, sf, "region").select(F.concat("r_name", F.lit(".MD")).alias("filename")).unionByName(fx.table(spark, sf, "nation").select(F.concat("n_name", F.lit(".txt")).alias("filename")))
    yes, no = files.checked_extension(names, ".md")
    return yes.select("filename", F.lit(True).alias("accepted")).unionByName(no.select("filename", F.lit(False).alias("accepted")))


# ── the store, retries, profiles and chains ──


def own_store(spark: SparkSession) -> store.GraphStore:
    """A store of its own in the shared folder."""
    name = "g" + uuid.uuid4().hex
    return store.GraphStore(spark, name, f"{shared_dir(spark)}/weft/{spark.sparkContext.applicationId}/{name}", parts=8, buckets=8)


@query(f"""WITH {ENTITIES}, e AS (SELECT *, trim(name) AS n, (ord % 2) * 1000000000000 + ord AS o FROM entities)
SELECT entity_type AS label, n AS name, arg_max(size, o) AS size, arg_max(brand, o) FILTER (WHERE brand IS NOT NULL) AS brand, arg_max(alias, o) AS aliases FROM e GROUP BY entity_type, n""")
def b1_two_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of even, then of odd ord, upserted into a store."""
    s, e = own_store(spark), fx.entities(spark, sf)
    nodes, _ = g.upsert_nodes(e.where("ord % 2 = 0"))
    s.write(nodes, fx.edges(spark, sf).where("false"))
    s.upsert(e.where("ord % 2 = 1"))
    p = F.col("properties")
    return s.nodes().select("label", "name", p["size"].alias("size"), p["brand"].alias("brand"), p["aliases"].alias("aliases"))


@query(ORACLE["g5_neighbours"])
def b6_store_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours out of a store into which suppliers' edges came as a second batch."""
    s, e = own_store(spark), fx.edges(spark, sf)
    s.write(fx.nodes(spark, sf), e.where("type <> 'supplies'"))
    s.add_edges(e.where("type = 'supplies'"))
    keys = supplier_keys(spark, sf)
    return g.neighbours(keys, s.edges(), s.nodes(), limit=20, around=s.ways()).select("question_id", "node", "other", "other_name", "other_label", "type", "src", "dst")


@query("""WITH p AS (SELECT conv_id, turn, len(text) AS n FROM conversations WHERE text IS NOT NULL),
a AS (SELECT *, unnest([0, 1, 2]) AS attempt FROM p)
SELECT conv_id, turn, attempt::INT AS attempt, CASE WHEN n % 11 <> 0 THEN CASE WHEN n % 5 = 0 THEN '' ELSE 'said ' || n END END AS text, CASE WHEN n % 11 = 0 THEN 'refused' END AS error
FROM a WHERE attempt = 0 OR n % 11 = 0 OR (attempt = 1 AND n % 5 = 0)""")
def p3_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """A model that raises on some prompts and answers others with nothing, asked up to three times."""

    def model(prompts: list[str]) -> list[str]:
        if any(int(p) % 11 == 0 for p in prompts):
            raise RuntimeError("refused")
        return ["" if int(p) % 5 == 0 else f"said {p}" for p in prompts]

    c = fx.table(spark, sf, "conversations").where("text is not null")
    out = res.infer(c.select(F.concat_ws(":", "conv_id", "turn").alias("prompt_id"), F.length("text").cast("string").alias("prompt")), model, attempts=3)
    return out.select(F.split("prompt_id", ":")[0].cast("long").alias("conv_id"), F.split("prompt_id", ":")[1].cast("long").alias("turn"), "attempt", "text", "error")


@query(f"""WITH {TRIPLES}, {ENTITIES} SELECT 'total' AS kind, 'sections' AS name, count(*) AS n FROM documents UNION ALL SELECT 'total', 'entities', count(*) FROM entities
UNION ALL SELECT 'total', 'triples', count(*) FROM triples UNION ALL SELECT 'total', 'self_loops', count(*) FROM triples WHERE subject = object UNION ALL SELECT 'predicate', predicate, count(*) FROM triples GROUP BY predicate""")
def x1_profile(spark: SparkSession, sf: str) -> DataFrame:
    return stats.extraction_profile(fx.table(spark, sf, "documents"), fx.entities(spark, sf), fx.triples(spark, sf))


@query(f"""WITH {TRIPLES}, {ORDER_EDGES} SELECT question_id, count(*) AS n_edges, round(product(confidence) + 1e-9, 6) AS confidence FROM oe GROUP BY question_id""")
def a2_totals(spark: SparkSession, sf: str) -> DataFrame:
    return evi.chain_totals(order_edges(spark, sf)).select("question_id", "n_edges", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"))


def order_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The far end of each edge, with a description where the order's number is even."""
    e = order_edges(spark, sf)
    described = F.when(F.col("question_id") % 2 == 0, F.create_map(F.lit("description"), F.concat(F.lit("<"), "target", F.lit(">")))).otherwise(F.create_map().cast("map<string,string>"))
    return e.select("question_id", "hop", "ord", F.col("target").alias("name"), F.lit("Part").alias("label"), described.alias("properties"))


@query(f"""WITH {TRIPLES}, {ORDER_EDGES} SELECT question_id, sha256('{{"nodes":[' || string_agg('{{"hop":' || hop || ',"ord":' || ord || ',"name":"' || target || '","label":"Part"}}', ',' ORDER BY hop, ord)
 || '],"edges":[' || string_agg('{{"hop":' || hop || ',"ord":' || ord || ',"source":"' || source || '","type":"' || type || '","target":"' || target || '","confidence":' || confidence::VARCHAR || ',"source_chunk_id":"' || chunk || '"}}', ',' ORDER BY hop, ord) || ']}}') AS sha256
FROM oe GROUP BY question_id""")
def a4_chain_json(spark: SparkSession, sf: str) -> DataFrame:
    return evi.chain_json(order_edges(spark, sf), order_nodes(spark, sf)).select("question_id", F.sha2("chain", 256).alias("sha256"))


@query(f"""WITH {TRIPLES}, {ORDER_EDGES},
hops AS (SELECT question_id, hop, arg_min(type, ord) AS used, string_agg('      <edge source="' || source || '" relation="' || type || '" target="' || target || '" confidence="' || printf('%.2f', confidence) || '" chunk_id="' || chunk || '"'
  || CASE WHEN line <> '' THEN '>' || chr(10) || '        <source_text>' || line || '</source_text>' || chr(10) || '      </edge>' ELSE ' />' END, chr(10) ORDER BY ord) AS t,
  list(target ORDER BY ord) AS ts FROM oe GROUP BY question_id, hop),
firsts AS (SELECT question_id, hop, used, t, list_reduce(list_prepend([]::VARCHAR[], list_transform(ts, lambda x: [x])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE a || x END) AS seen,
  dense_rank() OVER (PARTITION BY question_id ORDER BY hop) AS step FROM hops),
body AS (SELECT question_id, string_agg('    <hop number="' || hop || '">' || chr(10) || t || chr(10) || '    </hop>' || chr(10), '' ORDER BY hop) AS edges,
  string_agg('    <step hop="' || step || '">通过' || used || '探索 ' || array_to_string(seen, '、') || '</step>' || chr(10), '' ORDER BY step) AS steps FROM firsts GROUP BY question_id),
ents AS (SELECT question_id, string_agg('    <entity name="' || target || '" label="Part" hop="' || hop || '"' || CASE WHEN question_id % 2 = 0 THEN '>&lt;' || target || '&gt;</entity>' ELSE ' />' END || chr(10), '' ORDER BY hop, ord) AS nodes FROM oe GROUP BY question_id)
SELECT question_id, sha256('<evidence_chain start="q' || question_id || '" confidence="0.50">' || chr(10) || '  <reasoning_path>' || chr(10) || edges || '  </reasoning_path>' || chr(10) || '  <entities>' || chr(10) || nodes
 || '  </entities>' || chr(10) || '  <reasoning_steps>' || chr(10) || steps || '  </reasoning_steps>' || chr(10) || '</evidence_chain>') AS sha256 FROM body JOIN ents USING (question_id)""")
def a5_chain_xml(spark: SparkSession, sf: str) -> DataFrame:
    e = order_edges(spark, sf)
    steps, _ = evi.append_hop(e)
    heads = e.select("question_id").distinct().select("question_id", F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("start"), F.lit(None).cast("string").alias("end"), F.lit(0.5).alias("confidence"))
    return evi.chain_xml(e, order_nodes(spark, sf), steps, heads).select("question_id", F.sha2("xml", 256).alias("sha256"))


#: Names with repeats: of parts, nations, regions and suppliers.
EVERY_NAME = """every AS (SELECT name, row_number() OVER (ORDER BY kind, k) AS ord FROM (SELECT 'p' AS kind, p_partkey AS k, p_name AS name FROM part UNION ALL SELECT 'n', n_nationkey, n_name FROM nation UNION ALL SELECT 'r', r_regionkey, r_name FROM region UNION ALL SELECT 's', s_suppkey, s_name FROM supplier)),
w AS (SELECT replace(lower(name), ' ', '') AS w, count(*) AS n FROM every GROUP BY 1),
g AS (SELECT w, n, list_distinct(list_transform(range(1, len(w)), lambda i: substr(w, i, 2))) AS x FROM w)"""


@query(f"""WITH {EVERY_NAME}, l AS (SELECT a.w, sum(b.n) - 1 AS links FROM g a JOIN g b ON len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))::DOUBLE >= 0.5 GROUP BY a.w)
SELECT name, count(*) AS n, any_value(links)::BIGINT AS links FROM every JOIN l ON w = replace(lower(name), ' ', '') GROUP BY name""")
def e9_similar_classes(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda table, key, name: fx.table(spark, sf, table).select(F.lit(table).alias("t"), F.col(key).cast("long").alias("k"), F.col(name).alias("name"))
    names = t("part", "p_partkey", "p_name").unionByName(t("nation", "n_nationkey", "n_name")).unionByName(t("region", "r_regionkey", "r_name")).unionByName(t("supplier", "s_suppkey", "s_name"))
    e = names.select(F.struct("t", "k").alias("ord"), "name", F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("canonical"))
    return ent.similar_classes(e, 0.5).join(e.select("ord", "name"), "ord").groupBy("name").agg(F.count("*").alias("n"), F.max("links").alias("links"))


@query()
def e10_near_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of one nation whose names differ in little; every seventh name has a digit changed, every fifth supplier has no balance."""
    k = F.col("s_suppkey")
    name = F.when(k % 7 == 0, F.concat(F.expr("substr(s_name, 1, length(s_name) - 1)"), F.lit("x"))).otherwise(F.col("s_name"))
    props = F.when(k % 5 == 0, F.create_map(F.lit("nation"), F.lit("1"))).otherwise(F.create_map(F.lit("nation"), F.lit("1"), F.lit("balance"), fx.text_of("s_acctbal")))
    e = fx.table(spark, sf, "supplier").select(k.cast("long").alias("ord"), name.alias("name"), F.concat(F.lit("of nation "), fx.text_of("s_nationkey")).alias("entity_type"), F.array().cast("array<string>").alias("aliases"), props.alias("properties"))
    out = ent.merge_across(ent.canonical(e), 0.85)
    return out.select("ord", "name", "entity_type", joined("aliases").alias("aliases"), "n_merged")


@query(f"""WITH {PAIRED} SELECT k, round(0.5 * CASE WHEN na = nb OR ba = bb THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END
  + 0.3 * CASE WHEN lower(ta) = lower(tb) THEN 1.0 WHEN contains(lower(ta), lower(tb)) OR contains(lower(tb), lower(ta)) THEN 0.5 ELSE 0.0 END
  + 0.2 * CASE k % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0.0 END, 6) AS likeness FROM gr""")
def e8_property_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys {a}, {a, b}, {b, c, d}, none by id: half, a quarter, nothing in common."""
    p = fx.table(spark, sf, "part")
    made = lambda *keys: F.create_map(*[x for key in keys for x in (F.lit(key), F.lit("1"))]) if keys else F.create_map().cast("map<string,string>")
    m = F.col("p_partkey") % 4
    own = F.when(m == 0, made("a")).when(m == 1, made("a", "b")).when(m == 2, made("b", "c", "d")).otherwise(made())
    e = p.select(F.col("p_partkey").alias("k"), F.struct(F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.lower("p_name").alias("canonical"), F.col("p_type").alias("entity_type"), own.alias("properties")).alias("e"))
    pairs = e.select("k", F.col("e").alias("a")).join(e.select((F.col("k") - 1).alias("k"), F.col("e").alias("b")), "k")
    return pairs.select("k", F.round(ent.similarity("a", "b"), 6).alias("likeness"))


@query(f"WITH {NODES} SELECT 'C' || c_custkey AS node_id, c_name AS name, 'segment' AS key, c_mktsegment AS value FROM customer")
def g3_node_properties(spark: SparkSession, sf: str) -> DataFrame:
    return g.node_properties(fx.table(spark, sf, "customer").select(F.col("c_name").alias("name")), fx.nodes(spark, sf)).select("node_id", "name", "key", "value")


@query("""SELECT p_partkey AS k, CASE WHEN trim(p_name) = p_brand THEN p_brand ELSE p_brand || '|' || p_name END || CASE WHEN p_type IN (p_brand, p_name) THEN '' ELSE '|' || p_type END AS names FROM part""")
def m3_unique_entities(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.array("p_brand", F.lit("  "), F.concat(F.lit(" "), "p_name"), F.col("p_brand"), F.concat("p_type", F.lit(" ")), F.lit(""), F.col("p_name"))
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.array_join(rea.unique_entities(listed), "|").alias("names"))


@query("""SELECT c_custkey AS k, greatest(0.0, round(greatest(0.0, least(1.0, c_acctbal / 5000)) - CASE WHEN c_custkey % 3 = 0 THEN 0.2 ELSE 0.0 END - CASE WHEN c_custkey % 2 = 0 THEN 0.1 ELSE 0.0 END, 6)) AS confidence FROM customer""")
def a10_hedged(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that hedge where 3 divides the key and are short where 2 does."""
    k = F.col("c_custkey")
    answer = F.concat(F.when(k % 3 == 0, F.lit("可能")).otherwise(""), F.when(k % 2 == 0, F.lit("short")).otherwise(F.concat(F.lit("an answer of more than twenty characters, "), "c_name")))
    return fx.table(spark, sf, "customer").select(k.alias("k"), F.round(evi.answer_confidence(answer, F.col("c_acctbal") / 5000), 6).alias("confidence"))


@query(r"""WITH p AS (SELECT s_suppkey AS k, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT k, 'Answer from the evidence.' || repeat(chr(10), 2) || '## Question' || chr(10) || s_name || '位于何处？' || CASE WHEN k % 3 = 0 THEN repeat(chr(10), 2) || '## Evidence' || chr(10)
  || '<evidence_chain start="" confidence="1.00">' || chr(10) || '  <reasoning_path>' || chr(10) || '  </reasoning_path>' || chr(10) || '  <entities>' || chr(10) || '  </entities>' || chr(10) || '</evidence_chain>'
 ELSE repeat(chr(10), 2) || '## Evidence' || chr(10)
  || '<evidence_chain start="' || s_name || '" confidence="1.00">' || chr(10) || '  <reasoning_path>' || chr(10) || '    <hop number="1">' || chr(10) || '      <edge source="' || s_name || '" relation="in_nation" target="' || n_name || '" confidence="1.00" />' || chr(10)
  || '    </hop>' || chr(10) || '  </reasoning_path>' || chr(10) || '  <entities>' || chr(10) || '    <entity name="' || n_name || '" label="Nation" hop="1" />' || chr(10) || '  </entities>' || chr(10) || '  <reasoning_steps>' || chr(10)
  || '    <step hop="1">通过in_nation探索 ' || n_name || '</step>' || chr(10) || '  </reasoning_steps>' || chr(10) || '</evidence_chain>' || repeat(chr(10), 2) || '## Steps' || chr(10) || '第1跳: 通过in_nation探索 ' || n_name END AS p FROM p)
SELECT k AS question_id, least(len(p), 520)::INT AS n, sha256(CASE WHEN len(p) > 520 THEN substr(p, 1, 519) || '…' ELSE p END) AS sha256 FROM x""")
def a15_planned_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Plans out of responses: to the supplier's nation, or, where 3 divides the key, from a nation, whose label is abstract here."""
    s = fx.table(spark, sf, "supplier").join(fx.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    q = s.select(F.col("s_suppkey").alias("question_id"), F.concat("s_name", F.lit("位于何处？")).alias("text"))
    start = F.when(F.col("s_suppkey") % 3 == 0, F.col("n_name")).otherwise(F.col("s_name"))
    plan = F.concat(F.lit('{"start_entities": ['), quoted(start), F.lit('], "steps": [{"action": "find_neighbors", "target_type": "Nation", "relation_hint": "in_nation", "direction": "out"}]}'))
    prompts, _ = batch.prompt_batch(q, stored_nodes(spark, sf), stored_edges(spark, sf), most=520, plan_responses=s.select(F.col("s_suppkey").alias("question_id"), plan.alias("response")), abstract=["Nation"])
    return prompts.select("question_id", F.length("prompt").alias("n"), F.sha2("prompt", 256).alias("sha256"))


@query(f"""WITH {TRIPLES}, {ORDER_EDGES}, f AS (SELECT *, row_number() OVER (PARTITION BY question_id, line ORDER BY hop, ord) AS rn FROM oe WHERE line <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hop, ord, line) AS rank FROM f WHERE rn = 1)
SELECT question_id, rank::INT AS rank, line AS chunk_id, chunk AS text, source || ' --' || type || '--> ' || target AS relation FROM r WHERE rank <= 5""")
def a6_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of an order is a chunk of its own, so that orders of six and more lose some."""
    e = order_edges(spark, sf)
    return evi.citations(e.withColumns({"source_chunk_id": F.col("source_text"), "source_text": F.col("source_chunk_id")})).select("question_id", "rank", "chunk_id", "text", "relation")


@query("SELECT c_custkey AS k, (c_custkey % 5 = 0 OR c_custkey % 4 >= 3 OR c_acctbal / 10000 < 0.5) AS stop FROM customer")
def m8_stop_rule(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return fx.table(spark, sf, "customer").select(k.alias("k"), rea.should_stop(k % 5 != 0, k % 4, F.col("c_acctbal") / 10000).alias("stop"))


@query("""WITH c AS (SELECT l_orderkey AS q, l_linenumber AS hop, max(round(1 - l_discount, 6)) AS c FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, hop) AS r FROM c)
SELECT q AS question_id, hop, c AS confidence FROM r WHERE r = 1""")
def m9_best_hop(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("hop")).agg(F.max(F.round(1 - F.col("l_discount"), 6)).alias("confidence"))
    return rea.best_so_far(c).select("question_id", "hop", "confidence")
