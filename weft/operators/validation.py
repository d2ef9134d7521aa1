"""V1-V5: schema checks as joins with small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_nodes(nodes: DataFrame, schema: DataFrame) -> DataFrame:
    """V1: nodes with `reason`, null if valid. schema(label, required, optional)."""
    s = schema.select(F.col("label").alias("_l"), "required", "optional")
    keys = F.map_keys("properties")
    lacks = F.size(F.array_except("required", keys)) > 0
    extra = F.size(F.array_except(keys, F.array_union("required", "optional"))) > 0
    reason = F.when(F.col("_l").isNull(), "unknown label").when(lacks, "missing property").when(extra, "property outside the schema")
    return nodes.join(s, nodes["label"] == F.col("_l"), "left").withColumn("reason", reason).drop("_l", "required", "optional")


def check_edges(edges: DataFrame, schema: DataFrame) -> DataFrame:
    """V2: edges(type, src_label, dst_label) with `reason`. schema(type, source_labels, target_labels)."""
    s = schema.select(F.col("type").alias("_t"), "source_labels", "target_labels")
    reason = F.when(F.col("_t").isNull(), "unknown type").when(~F.array_contains("source_labels", F.col("src_label")), "source label").when(~F.array_contains("target_labels", F.col("dst_label")), "target label")
    return edges.join(s, edges["type"] == F.col("_t"), "left").withColumn("reason", reason).drop("_t", "source_labels", "target_labels")


def discovered_schema(edges: DataFrame) -> DataFrame:
    """V3: (type, source_labels, target_labels), labels sorted."""
    return edges.groupBy("type").agg(F.sort_array(F.collect_set("src_label")).alias("source_labels"), F.sort_array(F.collect_set("dst_label")).alias("target_labels"))


def check_constraints(triples: DataFrame, types: DataFrame, constraints: DataFrame) -> DataFrame:
    """V4: triples with `allowed`: (type of subject, predicate, type of object) is in constraints(source_type, relation, target_type). types(name, entity_type)."""
    t = types.select("name", "entity_type")
    typed = triples.join(t.toDF("subject", "_st"), "subject", "left").join(t.toDF("object", "_ot"), "object", "left")
    c = constraints.select(F.col("source_type").alias("_st"), F.col("relation").alias("predicate"), F.col("target_type").alias("_ot")).distinct().withColumn("_ok", F.lit(True))
    return typed.join(c, ["_st", "predicate", "_ot"], "left").select(*triples.columns, F.col("_ok").isNotNull().alias("allowed"))


def register(vocabulary: DataFrame, added: DataFrame) -> DataFrame:
    """V5: the vocabulary(name, ...) with added rows; the last registration of a name wins."""
    both = vocabulary.withColumn("_n", F.lit(0)).unionByName(added.withColumn("_n", F.lit(1)))
    cols = [c for c in vocabulary.columns if c != "name"]
    return both.groupBy("name").agg(F.max_by(F.struct(*cols), "_n").alias("x")).select("name", "x.*")
