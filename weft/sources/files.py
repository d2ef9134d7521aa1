"""Scans, sinks, samples."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_images


def scan_directory(spark: SparkSession, path: str, pattern: str = "*", text: bool = True) -> DataFrame:
    """(source_path, filename, file_size, modified_time, content) of the files that match; not sorted, which a table need not be."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    df = reader.text(path, wholetext=True) if text else reader.format("binaryFile").load(path)
    meta = [F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified_time")]
    return df.select(*meta, (strip_images("value") if text else F.col("content")).alias("content"))


def checked_extension(files: DataFrame, extension: str) -> tuple[DataFrame, DataFrame]:
    """S3: (accepted, rejects with reason); the case of the extension does not matter."""
    ok = F.lower("filename").endswith(extension.lower())
    return files.where(ok), files.where(~ok).withColumn("reason", F.lit(f"not {extension}"))


def scan_file(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """S3: one file, as scan_directory gives it. FileNotFoundError if it is missing; ValueError if it is a folder or has another extension."""
    if extension is not None and not path.lower().endswith(extension.lower()):
        raise ValueError(f"not {extension}: {path}")
    try:
        df = scan_directory(spark, path)
        first = df.select("source_path").first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    if first is None or unquote(first["source_path"]).rstrip("/").rsplit("/", 1)[-1] != path.rstrip("/").rsplit("/", 1)[-1]:
        raise ValueError(f"not a file: {path}")
    return df


ANNOTATION = "chunk_id string, text string, trace string, entities array<struct<name:string,type:string>>, triples array<struct<subject:string,predicate:string,object:string>>"


def write_jsonl(df: DataFrame, path: str) -> None:
    """S4, S5."""
    df.write.mode("overwrite").json(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Missing optional fields are empty; blank lines are skipped."""
    df = spark.read.schema(ANNOTATION).json(path)
    return df.select("chunk_id", "text", F.coalesce("trace", F.lit("")).alias("trace"), F.coalesce("entities", F.from_json(F.lit("[]"), df.schema["entities"].dataType)).alias("entities"), F.coalesce("triples", F.from_json(F.lit("[]"), df.schema["triples"].dataType)).alias("triples"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A field `conversation` is read as text."""
    df = spark.read.schema("text string, conversation string, task_type string, chunk_id string").json(path)
    return df.select(F.coalesce("text", "conversation").alias("text"), "task_type", "chunk_id")


SCHEMA = "domain_name string, entity_types array<struct<name:string,label:string,definition:string,examples:array<string>>>, relation_types array<struct<name:string,label:string,definition:string,source_types:array<string>,target_types:array<string>>>, constraints array<struct<source_type:string,relation:string,target_type:string>>"


def read_schema(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """entity_types, relation_types, constraints as tables; an entry without name, label or definition is an error."""
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    out = {n: doc.select(F.explode_outer(n).alias("x")).where("x is not null").select("x.*") for n in ("entity_types", "relation_types", "constraints")}
    for n in ("entity_types", "relation_types"):
        if not out[n].where("name is null or label is null or definition is null").isEmpty():
            raise ValueError(f"{n}: an entry lacks name, label or definition")
    return out


def write_schema(parts: dict[str, DataFrame], domain: str, path: str) -> None:
    """The tables as one JSON document. A schema is small by nature."""
    one = None
    for n, df in parts.items():
        got = df.agg(F.collect_list(F.struct(*df.columns)).alias(n)).withColumn("_k", F.lit(1))
        one = got if one is None else one.join(got, "_k")
    one.drop("_k").withColumn("domain_name", F.lit(domain)).coalesce(1).write.mode("overwrite").json(path)


def even_sample(df: DataFrame, order: list[str], n: int | None = None, ratio: float | None = None) -> DataFrame:
    """The rows at int(i * N / n), i < n, in the given total order; all rows if N <= n. ratio: n = max(1, int(N * ratio)).

    Dense numbers come from sorted ranges and their counts, so no task sees all rows."""
    from ..operators.components import checkpointed

    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one a partition
    total, base = 0, {}
    for p in sorted(counts):
        base[p], total = total, total + counts[p]
    want = n if n is not None else max(1, int(total * ratio))
    if total <= want:
        return ranged.drop("_m")
    offset = F.element_at(F.create_map(*[F.lit(x) for p in base for x in (p, base[p])]), part)
    numbered = ranged.withColumn("_i", offset + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    # row j is picked iff some i has int(i * N / n) = j: the candidates are the two around j * n / N
    i = F.floor(F.col("_i") * (want / total)).cast("long")
    hit = F.lit(False)
    for d in (-1, 0, 1):
        k = i + d
        hit = hit | (k.between(0, want - 1) & (F.floor(k * F.lit(total) / F.lit(want)) == F.col("_i")))
    return numbered.where(hit).drop("_m", "_i")


def node_names(nodes: DataFrame) -> DataFrame:
    """S8."""
    return nodes.select("name").where("name is not null and name <> ''").distinct()
