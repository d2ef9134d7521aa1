"""Helpers that the operators share: inputs, written stages, components of a link table."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The white space of the word contracts: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Labels that a classifier tells apart, at most; a language or a toxicity mark each.
LABELS = 10_000


#: Bytes of an Arrow batch, at most. Texts are long, and a task has several copies of a batch.
BATCH = 8 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most BATCH bytes; a smaller bound of its own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH:  # "64m" is a size too
        spark.conf.set(name, str(BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. A local master that names none gets one of its own, as in tests;
    on a cluster that is an error, as executors do not see each other's disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(shared_dir, "own", None)
        if where is None:
            where = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="spark-weft-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/weft/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession, every: float = 3.0) -> None:
    """Shuffle files of what ran go when the driver forgets it; on a quiet driver that can take long. At most once in `every` seconds."""
    if time.monotonic() - getattr(tidy, "last", -every) >= every:
        gc.collect()
        spark._jvm.System.gc()
        tidy.last = time.monotonic()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark, path = bounded(df.sparkSession), scratch(df.sparkSession, name)
    df.write.parquet(path)
    tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever case is minded."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop(df: DataFrame) -> None:
    """Remove a stage that nothing reads any more."""
    path = getattr(df, "_weft_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")) % n


def least_hashes(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """(label, key): of each label the `most` keys with the least hashes; rows that repeat a pair count once. Each task first cuts at twice
    that many by the label's count of keys, so that few rows reach the window, however many a label has. Labels are few: one row each is
    broadcast, at most LABELS."""
    pairs = stage(rows.select(label, key).distinct(), "pairs")
    counts = stage(pairs.groupBy(label).agg(F.count("*").alias("_n")), "labels").withColumnRenamed(label, "_l")
    if counts.count() > LABELS:
        raise ValueError(f"over {LABELS} labels")
    share = F.xxhash64(key).cast("double") / 2.0**64 + 0.5
    cut = pairs.join(F.broadcast(counts), pairs[label] == F.col("_l")).where(share * F.col("_n") < 2 * most + 50).select(label, key)
    order = W.partitionBy(label).orderBy(F.xxhash64(key), key)
    return cut.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "rank", total: str | None = None) -> DataFrame:
    """df with each row's place among the rows of its `by`, from 0, in the order of the columns `order`; nulls first, equal rows as they
    come. `total` adds how many rows the group has. Rows are dealt by ranges and sorted inside tasks, so that no group, however large, meets
    in one: a row's place is its place in its task behind the counts of the tasks before, one row for each group and task."""
    at, part, first = (fresh(df, x) for x in ("_at", "_part", "_first"))
    cols = [*by, *order]
    lie = df.repartitionByRange(*cols).sortWithinPartitions(*cols) if cols else df
    lie = stage(lie.withColumn(at, F.monotonically_increasing_id()), "sorted")
    lie = lie.withColumn(part, F.shiftright(at, 33))
    before = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    runs = lie.groupBy(*by, part).agg(F.count("*").alias("_n"), F.min(at).alias("_min"))
    runs = runs.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(part).alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_min")).alias(first), F.sum("_n").over(W.partitionBy(*by)).alias("_total"))
    same = F.col(part) == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return lie.join(runs, same).select(*df.columns, (F.col(at) + F.col(first)).alias(name), *([F.col("_total").alias(total)] if total else []))


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(v, c) for every vertex of links(a, b): c is the smallest v that links reach.

    Large-star and small-star steps: each round joins a vertex to the smallest
    neighbour of its neighbourhood, so that stars form in a logarithmic number of
    rounds. links may repeat pairs or join a vertex with itself. The centre of a large
    star is a hot key: its minimum is a partial aggregate, and the join with it is a sort-merge join that adaptive execution splits.
    """
    vertices = stage(links.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "vertices")
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n = edges.count()
    for _ in range(rounds):
        if not n:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours, and the vertex itself, go to the smallest of them
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = stage(small, "edges")
        drop(low)
        was, n = n, new.count()
        same = n == was and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        drop(edges)
        edges = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    out = stage(vertices.join(edges.select(F.col("a").alias("v"), F.col("b").alias("c")), "v", "left").select("v", F.coalesce("c", "v").alias("c")), "components")
    drop(vertices)
    drop(edges)
    return out
