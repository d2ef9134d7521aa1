"""Graph, entity, triple, question and response tables out of the star-schema tables, in Spark and, for the oracles, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(c: str):
    return F.col(c).cast("string")


#: Rows of a task in which equal keys are sought.
ROWS = 1 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to as many tasks as keep each at some ROWS, and to no fewer than the session's: a task's share does not grow with the table."""
    parts = -(-df.count() // ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)

    def kind(df: DataFrame, key: str, mark: str, label: str, name, **props) -> DataFrame:
        entries = [x for k, v in props.items() for x in (F.lit(k), v)]
        properties = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
        return df.select(F.concat(F.lit(mark), text_of(key)).alias("node_id"), F.lit(label).alias("label"), name.alias("name"), properties.alias("properties"))

    return (
        kind(t("region"), "r_regionkey", "R", "Region", F.col("r_name"))
        .unionByName(kind(t("nation"), "n_nationkey", "N", "Nation", F.col("n_name")))
        .unionByName(kind(t("supplier"), "s_suppkey", "S", "Supplier", F.col("s_name")))
        .unionByName(kind(t("customer"), "c_custkey", "C", "Customer", F.col("c_name"), segment=F.col("c_mktsegment")))
        .unionByName(kind(t("part"), "p_partkey", "P", "Part", F.concat(F.lit("part#"), text_of("p_partkey")), description=F.col("p_name"), brand=F.col("p_brand")))
    )


NODES = """
nodes AS (
  SELECT 'R' || r_regionkey AS node_id, 'Region' AS label, r_name AS name FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'Supplier', s_name FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'Customer', c_name FROM customer
  UNION ALL SELECT 'P' || p_partkey, 'Part', 'part#' || p_partkey FROM part)"""


def edges(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The graph's edges; `spread`: dealt by the number of rows, for queries that only count them. Wide rows shuffle less after a first grouping."""
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("string")

    def plain(df: DataFrame, src, dst, type_: str) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(type_).alias("type"), F.lit(1.0).alias("confidence"), none.alias("source_chunk_id"), none.alias("source_text"))

    key = lambda m, c: F.concat(F.lit(m), text_of(c))
    sold = (dealt(t("lineitem"), "l_suppkey", "l_partkey") if spread else t("lineitem")).groupBy("l_suppkey", "l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_discount")).alias("x"))
    supplies = sold.select(key("S", "l_suppkey").alias("src"), key("P", "l_partkey").alias("dst"), F.lit("supplies").alias("type"), F.round(1 - F.col("x.l_discount"), 6).alias("confidence"), F.concat(F.lit("order#"), F.col("x.l_orderkey").cast("string")).alias("source_chunk_id"), F.concat(F.lit("line "), F.col("x.l_linenumber").cast("string")).alias("source_text"))
    e = (
        plain(t("nation"), key("N", "n_nationkey"), key("R", "n_regionkey"), "in_region")
        .unionByName(plain(t("supplier"), key("S", "s_suppkey"), key("N", "s_nationkey"), "in_nation"))
        .unionByName(plain(t("customer"), key("C", "c_custkey"), key("N", "c_nationkey"), "in_nation"))
        .unionByName(supplies)
    )
    return e.withColumn("edge_id", F.concat_ws(":", "type", "src", "dst"))


EDGES = """
sold AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_discount) AS rn FROM lineitem),
edges AS (SELECT *, type || ':' || src || ':' || dst AS edge_id FROM (
  SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'in_region' AS type, 1.0::DOUBLE AS confidence, NULL::VARCHAR AS source_chunk_id, NULL::VARCHAR AS source_text FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'in_nation', 1.0, NULL, NULL FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'in_nation', 1.0, NULL, NULL FROM customer
  UNION ALL SELECT 'S' || l_suppkey, 'P' || l_partkey, 'supplies', round(1 - l_discount, 6), 'order#' || l_orderkey, 'line ' || l_linenumber FROM sold WHERE rn = 1)),
incident AS (SELECT src AS node, dst AS other, * FROM edges UNION ALL SELECT dst, src, * FROM edges WHERE src <> dst)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    name = F.when(k % 5 == 0, F.concat(name, F.lit(" "))).otherwise(name)
    props = F.map_filter(F.create_map(F.lit("size"), text_of("p_size"), F.lit("brand"), F.col("p_brand")), lambda key, v: F.when(k % 2 == 0, key == "size").otherwise(F.lit(True)))
    return p.select(k.alias("ord"), name.alias("name"), F.col("p_type").alias("entity_type"), F.array("p_brand").alias("aliases"), props.alias("properties"))


ENTITIES = """
entities AS (SELECT p_partkey AS ord, (CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END) || (CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE '' END) AS name,
  p_type AS entity_type, p_brand AS alias, p_size::VARCHAR AS size, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END AS brand FROM part)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_discount")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    k = F.col("l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = line.join(s, F.col("s_suppkey") == k).join(p, F.col("p_partkey") == F.col("l_partkey"))
    subject = F.when(k % 4 == 0, F.concat("s_name", F.lit("(supplier)"))).otherwise(F.col("s_name"))
    order = F.col("l_orderkey")
    obj = F.when(order % 97 == 0, F.lit(" ")).when(order % 50 == 0, F.col("s_name")).otherwise(F.col("p_name"))
    return j.select((order * 10 + F.col("l_linenumber")).cast("long").alias("ord"), subject.alias("subject"), F.when(F.col("l_returnflag") == "R", "supplies").otherwise("other").alias("predicate"), obj.alias("object"), F.lit("trade").alias("relation_type"), F.round(1 - F.col("l_discount"), 6).alias("confidence"), F.create_map(F.lit("line"), text_of("l_linenumber")).alias("properties"), F.concat(F.lit("order#"), text_of("l_orderkey")).alias("source"))


TRIPLES = """
lines AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag, l_discount) AS rn FROM lineitem) WHERE rn = 1),
triples AS (SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS ord, s_name || (CASE WHEN l_suppkey % 4 = 0 THEN '(supplier)' ELSE '' END) AS subject,
  CASE WHEN l_returnflag = 'R' THEN 'supplies' ELSE 'other' END AS predicate,
  CASE WHEN l_orderkey % 97 = 0 THEN ' ' WHEN l_orderkey % 50 = 0 THEN s_name ELSE p_name END AS object,
  'trade' AS relation_type, round(1 - l_discount, 6) AS confidence, l_linenumber::VARCHAR AS line, 'order#' || l_orderkey AS source
  FROM lines JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"""

PLAIN = "trim(regexp_replace(regexp_replace({0}, '（[^）]*）$', ''), '\\([^)]*\\)$', ''))"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 8
    n = F.col("c_name")
    s = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    text = (
        F.when(k == 0, s(n, "有多少供应商")).when(k == 1, s("比较", n, "与TCP-", text_of("c_nationkey"), "的区别")).when(k == 2, s("从", n, "到G.709怎么走，", text_of("c_nationkey"), "跳"))
        .when(k == 3, s(n, "和SDH的关系是什么")).when(k == 4, s("列出", n, "支持的零件")).when(k == 5, s("如何导致“", n, "”依赖10Gb/s")).when(k == 6, s(F.lower(n), "影响订单吗")).otherwise(F.lit(" "))
    )
    return c.select(F.col("c_custkey").alias("question_id"), text.alias("text"))


QUESTIONS = """
questions AS (SELECT c_custkey AS question_id, CASE c_custkey % 8 WHEN 0 THEN c_name || '有多少供应商' WHEN 1 THEN '比较' || c_name || '与TCP-' || c_nationkey || '的区别'
  WHEN 2 THEN '从' || c_name || '到G.709怎么走，' || c_nationkey || '跳' WHEN 3 THEN c_name || '和SDH的关系是什么' WHEN 4 THEN '列出' || c_name || '支持的零件'
  WHEN 5 THEN '如何导致“' || c_name || '”依赖10Gb/s' WHEN 6 THEN lower(c_name) || '影响订单吗' ELSE ' ' END AS text FROM customer)"""


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under headings of its source and language; by id every third has a note, every 25th a heading without body."""
    d = table(spark, sf_dir, "documents")
    text, k = F.coalesce("text", F.lit("")), F.coalesce("doc_id", F.lit(0))
    note = F.when(k % 3 == 0, F.concat(F.lit("### note\n"), F.substring(text, 1, 80), F.lit("\n"))).otherwise("")
    bare = F.when(k % 25 == 7, F.lit("## bare\n")).otherwise("")
    return d.select("doc_id", F.concat(F.lit("# "), F.coalesce("source", F.lit("none")), F.lit("\n## "), F.coalesce("lang", F.lit("none")), F.lit("\n\n"), text, F.lit("\n"), note, bare).alias("content"))
