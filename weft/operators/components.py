"""Written stages that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


UNION = "spark.sql.unionOutputPartitioning"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. A local master that names none gets one of its own, as in tests;
    on a cluster that is an error, as executors do not see each other's disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(shared_dir, "own", None)
        if where is None:
            where = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="spark-weft-")
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, and lost executors cost nothing. Ids and names of a stage
    are alike, which zstd makes more of than the default codec."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    # Spark 4.1 zips the partitions of a union whose sides report one partitioning, and fails where adaptive execution has split one of them
    was = spark.conf.get(UNION, None)
    spark.conf.set(UNION, "false")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(UNION) if was is None else spark.conf.set(UNION, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a written stage that nothing reads any more."""
    path = getattr(df, "_weft_path", None)
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


class Stages:
    """The stages of one operator: `keep` writes one, `done` writes the result and removes all others."""

    def __init__(self):
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(checkpointed(df))
        return self.kept[-1]

    def gone(self, *stages: DataFrame) -> None:
        """Remove these now."""
        for x in stages:
            drop(x)
        self.kept = [x for x in self.kept if not any(x is y for y in stages)]

    def done(self, df: DataFrame) -> DataFrame:
        out = checkpointed(df)
        self.gone(*self.kept)
        return out
