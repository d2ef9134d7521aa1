"""Merkle manifest of a dataset: trees of SHA-256 by group, whose parents keep copies of their hash's state before each child.

* A row's leaf hashes its columns, each with its byte count in front, so that no two rows share an input.
* A group's leaves stand in the order of their ids; runs of `fan` of them become their parent's hash, level by level, up to the
  group's subroot; the subroots, in the groups' order, become the root likewise.
* Trees are built in blocks of `fan` ** `levels` neighbours, one task's work each: a block gives one node of the next tier. Tiers are few
  (two for 10^6 rows, four for 10^12) and each is written. Then paths go down: a block gets the siblings on its way to the root.
* Inside a block every parent hashes once and keeps a copy of the state before each child slot. To fold a replaced leaf, the state of its
  slot is resumed with the replacement and the siblings to its right; what stands to the left is not hashed again.

Nulls, ties and empty input: a null column is `-`, an empty one `0:`; null ids come first in their group, and null groups first
among the groups; rows with one id stand in the order of their leaves. Texts of any length are hashed as a whole. An
empty table has no leaves, no root and gives an empty result. Columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, fold, numbered, stage, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a way to the root: the siblings before and behind.
STEPS = "array<struct<left:array<string>,right:array<string>>>"


def leaf(fields: Sequence[Column]) -> Column:
    """The hash of the fields: `-` for null, else the UTF-8 byte count, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


class Block:
    """A tree over neighbouring digests: nodes[l] are those of level l, states[l][i] the hash state before node i among its run's."""

    def __init__(self, digests: Sequence[str], fan: int, levels: int):
        self.fan, self.nodes, self.states = fan, [list(digests)], []
        for _ in range(levels):
            below, states, above = self.nodes[-1], [], []
            for at in range(0, len(below), fan):
                h = sha256()
                for d in below[at : at + fan]:
                    states.append(h.copy())
                    h.update(d.encode())
                above.append(h.hexdigest())
            self.states.append(states)
            self.nodes.append(above)

    def siblings(self, i: int) -> list[tuple[list[str], list[str]]]:
        """Before and behind, level by level, of leaf i."""
        out = []
        for nodes in self.nodes[:-1]:
            at = i - i % self.fan
            out.append((nodes[at:i], nodes[i + 1 : at + self.fan]))
            i //= self.fan
        return out

    def fold(self, i: int, digest: str) -> str:
        """The block's top node with `digest` in place of leaf i."""
        for nodes, states in zip(self.nodes, self.states, strict=False):
            h = states[i].copy()
            h.update("".join([digest, *nodes[i + 1 : i - i % self.fan + self.fan]]).encode())
            digest, i = h.hexdigest(), i // self.fan
        return digest


class Path:
    """The way from a block to the root; the states before its node's slots are kept."""

    def __init__(self, steps: Sequence):
        self.steps = [(list(s["left"]), list(s["right"])) for s in steps]
        self.states = []
        for left, right in self.steps:
            h = sha256()
            h.update("".join(left).encode())
            self.states.append((h, "".join(right).encode()))

    def fold(self, digest: str) -> str:
        for h, right in self.states:
            h = h.copy()
            h.update(digest.encode() + right)
            digest = h.hexdigest()
        return digest


def joined(tree: Block, way: list) -> pa.Array:
    """The way of each of the block's nodes to the root."""
    kind = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
    return pa.array([[{"left": a, "right": b} for a, b in tree.siblings(i)] + way for i in range(len(tree.nodes[0]))], kind)


def depth(n: int, fan: int, levels: int) -> int:
    """Levels that a block of a tier with n nodes has: `levels`, or what is left up to one node."""
    d = 0
    while n > 1 and d < levels:
        n, d = -(-n // fan), d + 1
    return d


def tiers(nodes: DataFrame, fan: int = 2, levels: int = 10) -> tuple[list[DataFrame], DataFrame]:
    """(tiers, roots) of nodes(k, n, at, digest): each tier has such nodes, n of them for k, the next one a node for each block; the last,
    roots, has one for each k."""
    size, out = fan**levels, [nodes]

    def top(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        n, at = block["n"][0].as_py(), block["at"][0].as_py()
        tree = Block(block["digest"].to_pylist(), fan, depth(n, fan, levels))
        return pa.table({"k": pa.array([block["k"][0].as_py()], pa.string()), "n": [-(-n // size)], "at": [at // size], "digest": [tree.nodes[-1][0]]})

    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        blocks = out[-1].groupBy("k", F.expr(f"at div {size}").alias("block"))
        out.append(stage(blocks.applyInArrow(top, "k string, n long, at long, digest string"), "tier"))
    return out[:-1] or out, out[-1]


def pathed(tier: DataFrame, paths: DataFrame, fan: int, levels: int, each, schema: str) -> DataFrame:
    """each(block's rows, tree, path) of each block of a tier, with the row of paths(k, block, ...) that is the block's: columns by name."""
    size = fan**levels

    def run(block: pa.Table, path: pa.Table) -> pa.Table:
        block, path = block.sort_by("at"), path.to_pylist()[0]
        tree = Block(block["digest"].to_pylist(), fan, depth(block["n"][0].as_py(), fan, levels))
        same = {c: pa.array([path[c]] * len(block), pa.string()) for c in ("subroot", "root")}
        return pa.table(each(block, tree, path["steps"], same))

    return tier.groupBy("k", F.expr(f"at div {size}").alias("block")).cogroup(paths.groupBy("k", "block")).applyInArrow(run, schema)


def down(tier: DataFrame, paths: DataFrame, fan: int, levels: int) -> DataFrame:
    """paths(k, block, subroot, root, steps) of the blocks of the tier below, from those of this tier's blocks."""

    def each(block: pa.Table, tree: Block, way: list, same: dict) -> dict:
        return {"k": block["k"], "block": block["at"], **same, "steps": joined(tree, way)}

    return stage(pathed(tier, paths, fan, levels, each, f"k string, block long, subroot string, root string, steps {STEPS}"), "paths")


class Manifest:
    """The tiers of every group's tree, the subroots (k, subroot) and the root's paths."""

    def __init__(self, nodes: DataFrame, fan: int = 2, levels: int = 10):
        """nodes(k, n, at, digest), as `numbered` gives them: k a group's name, null first."""
        self.fan, self.levels = fan, levels
        self.tiers, roots = tiers(nodes, fan, levels)
        subs = numbered(roots.select("k", "digest"), [], ["k"], "at", "n")
        self.subroots = stage(subs.select(F.col("k").alias("group"), F.lit("").alias("k"), "n", "at", "digest"), "subroots")
        self.top, root = tiers(self.subroots.select("k", "n", "at", "digest"), fan, levels)
        self.root = (root.first() or {"digest": None})["digest"]

    def paths(self) -> DataFrame:
        """(k, block, subroot, root, steps) of every block of leaves."""
        root = F.lit(self.root).cast("string")
        at = self.subroots.select("k", F.lit(0).cast("long").alias("block"), F.lit(None).cast("string").alias("subroot"), root.alias("root"), F.array().cast(STEPS).alias("steps")).distinct()
        for tier in reversed(self.top):
            at = down(tier, at, self.fan, self.levels)
        # each subroot's way to the root is where its group's begins
        of = self.subroots.select("group", F.col("at").alias("block"), F.col("digest").alias("own")).join(at.select("block", "steps"), "block")
        at = stage(of.select(F.col("group").alias("k"), F.lit(0).cast("long").alias("block"), F.col("own").alias("subroot"), root.alias("root"), "steps"), "paths")
        for tier in reversed(self.tiers[1:]):
            at = down(tier, at, self.fan, self.levels)
        return at

    def proofs(self, keep: str) -> DataFrame:
        """(key, leaf, subroot, root, steps) of every leaf; `keep` is the type of the leaves' column key."""

        def each(block: pa.Table, tree: Block, way: list, same: dict) -> dict:
            return {"key": block["key"], "leaf": block["digest"], **same, "steps": joined(tree, way)}

        return pathed(self.tiers[0], self.paths(), self.fan, self.levels, each, f"key {keep}, leaf string, subroot string, root string, steps {STEPS}")

    def folded(self, keep: str) -> DataFrame:
        """(key, leaf, subroot, root, proof_sha256, folded_root) of every leaf, folded with its column `now` in its place."""

        def each(block: pa.Table, tree: Block, way: list, same: dict) -> dict:
            way = Path(way)
            tail = "".join("".join(a + b) for a, b in way.steps)
            proofs, roots = [], []
            for i, now in enumerate(block["now"].to_pylist()):
                proofs.append(sha256(("".join("".join(a + b) for a, b in tree.siblings(i)) + tail).encode()).hexdigest())
                roots.append(way.fold(tree.fold(i, now)))
            return {"key": block["key"], "leaf": block["digest"], **same, "proof_sha256": proofs, "folded_root": roots}

        return pathed(self.tiers[0], self.paths(), self.fan, self.levels, each, f"key {keep}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", now: Column | None = None) -> DataFrame:
    """(k, n, at, digest, key, now): every row's leaf and its place in its group; now, another digest to be folded in, else the leaf."""
    digest = leaf([F.col(f) for f in fields])
    rows = stage(docs.select(F.col(group).cast("string").alias("k"), F.col(key).alias("key"), digest.alias("digest"), (digest if now is None else now).alias("now")), "leaves")
    out = stage(numbered(rows, ["k"], ["key", "digest", "now"], "at", "n"), "nodes")
    drop(rows)
    return out


def manifest(docs: DataFrame, fan: int = 2, levels: int = 10, **options) -> Manifest:
    return Manifest(leaves(docs, **options), fan, levels)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bumped = F.col("n_chars") + F.when(fold("doc_id", 7) == 0, 1).otherwise(0)
    tree = manifest(docs, now=leaf([bumped if f == "n_chars" else F.col(f) for f in FIELDS]))
    out = tree.folded(docs.schema["doc_id"].dataType.simpleString())
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
