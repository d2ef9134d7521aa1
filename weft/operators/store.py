"""A graph as tables that are laid out for its readers, and that a new batch changes where it touches them.

Two tables: nodes, clustered by name, and ways, each edge from both of its ends, clustered by node. Each is bucketed, so that
a join on that column reads it without an exchange, and partitioned by a hash of the same column, so that a batch rewrites only the
partitions that hold one of its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .components import Stages
from .graph import incident, upsert_nodes

DYNAMIC = "spark.sql.sources.partitionOverwriteMode"
#: A bucket holds about this many rows at most; a table that outgrows its buckets is written anew with twice as many as it needs.
ROWS = 2_000_000


class GraphStore:
    """Tables {name}_nodes and {name}_ways at `path`, a folder that all executors share. `parts` bounds how finely a batch can
    touch the tables, fixed when the store is first written; `buckets` is the least number of tasks that read them. A table with more than ROWS rows
    a bucket gets more of them, so that a task's share does not grow with the graph; their numbers are kept in {path}/layout."""

    def __init__(self, spark: SparkSession, name: str, path: str, parts: int = 16, buckets: int = 16):
        self.spark, self.name, self.path, self.parts, self.buckets = spark, name, path.rstrip("/"), parts, buckets
        self.into = {"nodes": buckets, "ways": buckets}

    def _part(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int").alias("part")

    def _write(self, df: DataFrame, table: str, key: str) -> None:
        rows = df.select("*", self._part(key)).repartition(self.into[table], key)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
        rows.write.mode("overwrite").partitionBy("part").bucketBy(self.into[table], key).sortBy(key).option("path", f"{self.path}/{table}").format("parquet").saveAsTable(f"{self.name}_{table}")

    def write(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Wipe what is there and write this graph."""
        own = Stages()
        for rows, table, key in ((nodes.select("node_id", "label", "name", "properties"), "nodes", "name"), (incident(edges), "ways", "node")):
            rows = own.keep(rows)
            self.into[table] = max(self.buckets, -(-rows.count() // ROWS))
            self._write(rows, table, key)
        self._note()
        own.gone(*own.kept)

    def _note(self) -> None:
        self.spark.sql(f"SELECT {self.into['nodes']} AS nodes, {self.into['ways']} AS ways").coalesce(1).write.mode("overwrite").json(f"{self.path}/layout")

    def _outgrown(self, table: str, key: str, rows: DataFrame, gone: DataFrame, on: list[str]) -> bool:
        """Where the table and these rows, which come in place of those with the keys `gone`, have over ROWS rows a bucket, write all anew."""
        there = self.spark.table(f"{self.name}_{table}").drop("part")
        total = there.count() + rows.count()
        if total <= ROWS * self.into[table]:
            return False
        own = Stages()
        every = own.keep(there.join(gone.select(*on).distinct(), on, "left_anti").select(*there.columns).unionByName(rows.select(*there.columns)))
        self.into[table] = -(-2 * total // ROWS)
        self._write(every, table, key)
        self._note()
        own.gone(*own.kept)
        return True

    def open(self, nodes: str, ways: str) -> None:
        """Make the tables at `path` known to this session's catalog; nodes and ways are their columns, as DDL."""
        self.into = self.spark.read.schema("nodes int, ways int").json(f"{self.path}/layout").first().asDict()
        for table, columns, key in (("nodes", nodes, "name"), ("ways", ways, "node")):
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{table} ({columns}, part INT) USING parquet PARTITIONED BY (part) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.into[table]} BUCKETS LOCATION '{self.path}/{table}'")
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}_{table}")

    def nodes(self) -> DataFrame:
        return self.spark.table(f"{self.name}_nodes").drop("part")

    def ways(self) -> DataFrame:
        """(node, other, edge columns): what `incident` gives, for `neighbours` and other hop joins."""
        return self.spark.table(f"{self.name}_ways").drop("part")

    def edges(self) -> DataFrame:
        return self.ways().where(F.col("node") == F.col("src")).drop("node", "other")

    def _touched(self, keys: DataFrame, table: str, key: str) -> DataFrame:
        """The table's rows in the partitions that a key of the batch falls into; at most `parts` numbers come to the driver."""
        parts = [r["part"] for r in keys.select(self._part(key)).distinct().collect()]
        return self.spark.table(f"{self.name}_{table}").where(F.col("part").isin(parts))

    def _put(self, rows: DataFrame, table: str, key: str) -> None:
        """Replace the partitions that the rows fall into."""
        was = self.spark.conf.get(DYNAMIC)
        self.spark.conf.set(DYNAMIC, "dynamic")
        try:
            into = self.spark.table(f"{self.name}_{table}").columns
            rows.select("*", self._part(key)).repartition(self.into[table], key).select(*into).write.mode("overwrite").insertInto(f"{self.name}_{table}")
            self.spark.sql(f"REFRESH TABLE {self.name}_{table}")
        finally:
            self.spark.conf.set(DYNAMIC, was)

    def upsert(self, entities: DataFrame, document: str | None = None) -> DataFrame:
        """B1 over the store: entities merge by (label, name), the last property value wins, and of what is there only touched
        partitions are read and written. Returns the rejects."""
        own = Stages()
        batch = own.keep(entities)
        merged, rejects = upsert_nodes(batch, self._touched(batch.select(strip("name").alias("name")), "nodes", "name"), document)
        merged = own.keep(merged)
        if not merged.isEmpty() and not self._outgrown("nodes", "name", merged, merged, ["label", "name"]):
            self._put(merged, "nodes", "name")
        return own.done(rejects)

    def add_edges(self, edges: DataFrame) -> None:
        """Edges join the store by edge_id; one that is there is replaced. Touched partitions only."""
        own = Stages()
        new = own.keep(incident(edges))
        if not new.isEmpty() and not self._outgrown("ways", "node", new, new, ["node", "edge_id"]):
            old = self._touched(new, "ways", "node").drop("part")
            kept = old.join(new.select("node", "edge_id").distinct(), ["node", "edge_id"], "left_anti").select(*new.columns)
            self._put(own.keep(kept.unionByName(new)), "ways", "node")
        own.gone(*own.kept)
