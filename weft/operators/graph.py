"""Building node and edge tables, and reading them for a whole table of keys at once.

nodes(node_id, label, name, properties); edges(edge_id, src, dst, type, confidence, source_chunk_id, source_text).
Every limit has a total order. Traversals keep rows on the executors; the driver only counts levels.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import strip
from .components import Stages, checkpointed
from .triples import mentions

#: Fixed value: the label of nodes that only triples name.
AUTO = "自动创建"


def _map(entries: Column) -> Column:
    return F.coalesce(F.map_from_entries(F.sort_array(entries)), F.create_map().cast("map<string,string>"))


def upsert_nodes(entities: DataFrame, existing: DataFrame | None = None, document: str | None = None) -> tuple[DataFrame, DataFrame]:
    """B1: (nodes, rejects). entities(ord, name, entity_type, aliases, properties) merge by (label, name), the last property value wins, over existing nodes."""
    e = entities.withColumns({"name": strip("name"), "label": strip(F.coalesce("entity_type", F.lit("")))})
    bad = F.when(F.col("name") == "", "blank name").when(F.col("label") == "", "blank label")
    good = e.where(bad.isNull())
    extra = F.create_map(F.lit("name"), F.col("name"), F.lit("aliases"), F.array_join(F.col("aliases"), "|"), *([F.lit("source_document"), F.lit(document)] if document else []))
    own = good.select("label", "name", "ord", F.explode(F.map_concat(F.map_filter("properties", lambda k, v: ~F.map_contains_key(extra, k)), extra)).alias("k", "v"))
    if existing is not None:
        own = own.unionByName(existing.select("label", "name", F.lit(-1).cast("long").alias("ord"), F.explode("properties").alias("k", "v")))
    nodes = own.groupBy("label", "name", "k").agg(F.max_by("v", "ord").alias("v")).groupBy("label", "name").agg(_map(F.collect_list(F.struct("k", "v"))).alias("properties"))
    return nodes.select(F.sha2(F.concat_ws("\u0001", "label", "name"), 256).alias("node_id"), "label", "name", "properties"), e.where(bad.isNotNull()).select("ord", "name", "label", bad.alias("reason"))


def auto_nodes(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """B2: nodes for endpoints that have none."""
    ends = triples.select(F.explode(F.array(strip("subject"), strip("object"))).alias("name")).where("name <> ''").distinct()
    new = ends.join(nodes.select("name"), "name", "left_anti")
    return new.select(F.sha2(F.concat_ws("\u0001", F.lit(AUTO), "name"), 256).alias("node_id"), F.lit(AUTO).alias("label"), "name", F.create_map(F.lit("auto_created"), F.lit("true"), F.lit("name"), F.col("name")).alias("properties"))


def name_labels(entities: DataFrame, auto: DataFrame | None = None) -> DataFrame:
    """(name, label): the last entity's type, then auto-created."""
    out = entities.groupBy(strip("name").alias("name")).agg(F.max_by("entity_type", "ord").alias("label")).where("name <> ''")
    return out if auto is None else out.unionByName(auto.select("name", "label").join(out.select("name"), "name", "left_anti"))


def build_edges(triples: DataFrame, nodes: DataFrame, mode: str = "create", document: str | None = None) -> DataFrame:
    """An edge for each pair of nodes that bear the endpoints' names. mode "merge" keeps one for (src, type, dst, chunk)."""
    n = nodes.select("node_id", "name")
    t = triples.withColumns({"subject": strip("subject"), "object": strip("object")})
    e = t.join(n.toDF("src", "subject"), "subject").join(n.toDF("dst", "object"), "object")
    chunk = F.coalesce(F.get(F.array(F.col("properties")["source_chunk_id"]), F.lit(0)), F.col("source"))
    e = e.select("ord", "src", "dst", F.col("subject").alias("src_name"), F.col("object").alias("dst_name"), F.col("predicate").alias("type"), "relation_type", "confidence", chunk.alias("source_chunk_id"), F.col("properties")["source_text"].alias("source_text"), "properties", F.lit(document).cast("string").alias("source_document"))
    if mode == "merge":
        keys = ["src", "type", "dst", "source_chunk_id"]
        rest = [c for c in e.columns if c not in keys]
        e = e.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("x")).select(*keys, "x.*")
    return e.withColumn("edge_id", F.sha2(F.concat_ws("\u0001", "src", "type", "dst", F.col("ord").cast("string"), "source_chunk_id"), 256)).drop("ord")


def build_stats(entities: DataFrame, triples: DataFrame, nodes: DataFrame, auto: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row of counts; relations count triples, not edges."""
    named = triples.where((strip("subject") != "") & (strip("object") != ""))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [n(entities, "entities"), n(nodes, "nodes"), n(auto, "auto_created"), n(named, "relations_created"), n(rejects, "errors")]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Overwrite the graph; nodes lie sorted by name, edges by source, so that scans for keys skip row groups."""
    nodes.repartitionByRange("name").sortWithinPartitions("name").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartitionByRange("src").sortWithinPartitions("src", "type").write.mode("overwrite").parquet(f"{path}/edges")


def find_nodes(keys: DataFrame, nodes: DataFrame, label: str | None = None) -> DataFrame:
    """G1: the first node of each keys(key) name, by (label, node_id)."""
    n = nodes if label is None else nodes.where(F.col("label") == label)
    return keys.join(n, keys["key"] == n["name"]).groupBy("key").agg(F.min_by(F.struct("node_id", "label", "name", "properties"), F.struct("label", "node_id")).alias("x")).select("key", "x.*")


def by_property(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, property, value, node_id, name) of the nodes with each keys(label, property, value); the name is a property too."""
    held = nodes.select("label", "node_id", "name", F.explode(F.map_concat(F.map_filter("properties", lambda k, v: k != "name"), F.create_map(F.lit("name"), F.col("name")))).alias("property", "value"))
    return held.join(keys.select("label", "property", "value").distinct(), ["label", "property", "value"])


def node_properties(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, node_id, key, value) for every node of each keys(name)."""
    return nodes.join(keys.select("name").distinct(), "name").select("name", "node_id", F.explode("properties").alias("key", "value"))


def edge_properties(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of each keys(src, type, dst)."""
    return edges.join(keys.select("src", "type", "dst").distinct(), ["src", "type", "dst"])


def incident(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(node, other, edge columns): each edge from its ends; a self-loop once."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "*")
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "*")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back.where("src <> dst"))


def degrees(edges: DataFrame, type_: str | None = None) -> DataFrame:
    """(node, degree)."""
    e = edges if type_ is None else edges.where(F.col("type") == type_)
    return incident(e.select("src", "dst")).groupBy("node").agg(F.count("*").alias("degree"))


def named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with other, and other's name and label."""
    return edges.join(nodes.select(F.col("node_id").alias("other"), F.col("name").alias("other_name"), F.col("label").alias("other_label")), "other")


def first_rows(hits: DataFrame, limit: int | None, *by: str) -> DataFrame:
    """At most `limit` edges of each key `by`, by (neighbour's name, type, edge)."""
    if limit is None:
        return hits
    order = W.partitionBy(*by).orderBy("other_name", "type", "edge_id")
    return hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


#: Pairs from which on edges are sieved before they meet them, and the most bits of a sieve.
PAIRS, BITS = 1 << 17, 1 << 26


def sieved(around: DataFrame, near: DataFrame, n: int, *on: str) -> DataFrame:
    """around without most rows that have no pair `on` (node, other) among the n of near: each pair sets a bit, of up to 16 for a pair and BITS in all."""
    on = on or ("node", "other")
    bits = min(16 * n, BITS)
    at = F.pmod(F.xxhash64(*on), F.lit(bits))
    words = near.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_at % 64 as int)))").alias("_bits"))
    held = around.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(words), "_word")
    return held.where("getbit(_bits, cast(_at % 64 as int)) = 1").drop("_at", "_word", "_bits")


def among(around: DataFrame, near: DataFrame, *on: str) -> DataFrame:
    """The rows of around whose `on` is among the distinct ones of near, a written table: around is not moved for a few of these, and sieved for many."""
    n = near.count()
    if n < PAIRS:
        return around.join(F.broadcast(near), list(on), "left_semi")
    return sieved(around, near, n, *on).join(near, list(on), "left_semi")


def nearest(keys: DataFrame, around: DataFrame, nodes: DataFrame, limit: int | None, meet: Callable[..., DataFrame] | None = None, such: Column | None = None) -> DataFrame:
    """keys(node, ...), distinct, with their edges of incident(edges) and the neighbour's name and label, at most `limit` a key, by (name, type,
    edge). meet(keys, around, *on): which edges a key has, if more than the node decides; such: which of them count, by key and neighbour.

    Names are looked up for the ends of the edges alone. An edge is read whole and moved only where fewer than `limit` edges of its key
    lead to lesser names."""
    meet = meet or (lambda k, a, *on: k.join(a, ["node", *on]))
    such = F.lit(True) if such is None else such
    if limit is None:
        return named(meet(keys, around), nodes).where(such)
    by = keys.columns
    ends = named(meet(keys, around).select(*by, "other"), nodes).where(such)
    near = checkpointed(ends.withColumn("_r", F.rank().over(W.partitionBy(*by).orderBy("other_name"))).where(F.col("_r") <= limit).select(*by, "other").distinct())
    n = near.count()
    return first_rows(named(meet(near, sieved(around, near, n) if n >= PAIRS else around, "other"), nodes).where(such), limit, *by)


def neighbours(keys: DataFrame, edges: DataFrame, nodes: DataFrame, direction: str = "both", type_: str | None = None, label: str | None = None, limit: int | None = 20, around: DataFrame | None = None) -> DataFrame:
    """For keys(question_id, node), at most `limit` edges each with the neighbour; src and dst keep the edge's own direction. `around`
    are incident(edges, direction) where the caller has them. With a limit edges are read twice, so they had better be a written table."""
    around = incident(edges, direction) if around is None else around
    around = around if type_ is None else around.where(F.col("type") == type_)
    nodes = nodes if label is None else nodes.where(F.col("label") == label)
    keys = keys.select("question_id", "node")
    if limit is None:
        return named(keys.join(around, "node"), nodes)
    return first_rows(keys.join(nearest(keys.select("node").distinct(), around, nodes, limit), "node"), limit, "question_id", "node")


def search_nodes(queries: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """(query, rank, node_id, name) of the first `limit` nodes, by (name, node_id), whose name contains each queries(query). The empty
    query finds all nodes, of which the first `limit` are the same for every such query; a null query finds none."""
    q = queries.select("query").where("query is not null").distinct()
    hit = mentions(nodes.select(F.col("node_id").alias("key"), F.col("name").alias("content")), q.select(F.col("query").alias("name")))
    hit = hit.select(F.col("name").alias("query"), F.col("key").alias("node_id")).join(nodes.select("node_id", "name"), "node_id").select("query", "node_id", "name")
    first = nodes.where("name is not null").orderBy("name", "node_id").limit(limit)
    every = q.where("query = ''").join(first.select(F.lit("").alias("query"), "node_id", "name"), "query")
    rank = F.row_number().over(W.partitionBy("query").orderBy("name", "node_id"))
    return hit.unionByName(every).withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "node_id", "name")


def sources(keys: DataFrame) -> DataFrame:
    """keys(question_id, node), distinct, with chunk and bit: 64 keys share a chunk, in which each has a bit of its own. Keys of one node lie
    together, so that their searches share rows."""
    lie = checkpointed(keys.select("question_id", "node").distinct().repartitionByRange("node").sortWithinPartitions("node").withColumn("_i", F.monotonically_increasing_id()))
    out = lie.select("question_id", "node", F.shiftright("_i", 6).alias("chunk"), F.expr("shiftleft(1L, cast(_i % 64 as int))").alias("bit"))
    out._weft_path = lie._weft_path
    return out


def levels(start: DataFrame, edges: DataFrame, hops: int, direction: str = "both", ends: DataFrame | None = None, met_at: Callable[[DataFrame], DataFrame | None] | None = None) -> DataFrame:
    """(chunk, node, hop, bits): which of a chunk's sources first meet the node at that hop, from sources(chunk, node, bit) at hop 0. With
    ends(node) the last hop goes to these only. met_at(what a hop met): the (chunk, bits) of sources that need go no further.

    One row stands for a node and up to 64 sources: a hop is one join of the frontier with the edges at its nodes, whose bits are put together before
    they are shuffled, and the bits that the node had before are taken off. Edges are read at each hop; they are not copied if they are written."""
    own = Stages()
    both = edges if hasattr(edges, "_weft_path") else own.keep(edges.select("src", "dst"))
    ways = incident(both.select("src", "dst"), direction).where("node <> other").select("node", "other")
    front = own.keep(start.groupBy("chunk", "node").agg(F.bit_or("bit").alias("bits")).withColumn("hop", F.lit(0)).select("chunk", "node", "hop", "bits"))
    parts, ahead = [front], front
    for h in range(1, hops + 1):
        here = among(ways, own.keep(ahead.select("node").distinct()), "node")
        if ends is not None and h == hops:
            here = here.join(ends.select(F.col("node").alias("other")), "other", "left_semi")
        met = ahead.join(here, "node").groupBy("chunk", F.col("other").alias("node")).agg(F.bit_or("bits").alias("bits"))
        seen = reduce(DataFrame.unionByName, parts).groupBy("chunk", "node").agg(F.bit_or("bits").alias("old"))
        new = met.join(seen, ["chunk", "node"], "left").select("chunk", "node", F.lit(h).alias("hop"), F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("bits"))
        front = own.keep(new.where("bits <> 0"))
        if front.isEmpty():
            break
        parts.append(front)
        ahead, done = front, met_at(front) if met_at is not None and h < hops else None
        if done is not None:
            left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0).cast("long"))))
            ahead = own.keep(front.join(F.broadcast(done.withColumnRenamed("bits", "done")), "chunk", "left").select("chunk", "node", "hop", left.alias("bits")).where("bits <> 0"))
            if ahead.isEmpty():
                break
    return own.done(reduce(DataFrame.unionByName, parts))


def reach(keys: DataFrame, edges: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """(question_id, start, node, hop): every node within `hops` of the start and the hop at which it is first met; the start is hop 0.
    The rows of the result are the keys times their balls; on the way there is one for a node and 64 keys."""
    s = sources(keys)
    met = levels(s, edges, hops, direction)
    return met.join(s.withColumnRenamed("node", "start"), "chunk").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("question_id", "start", "node", "hop")


def labelled_nearby(keys: DataFrame, edges: DataFrame, nodes: DataFrame, label: str | None = None, hops: int = 3, limit: int | None = 20) -> DataFrame:
    """(question_id, start, node, hop, label, name): labelled nodes of other name within `hops`, either direction. The label is
    one for all, or each key's own in keys(question_id, node, label).

    Questions at one node share its search. Ways are the same length back, so a label that fewer nodes bear than there are nodes that look
    for it is searched from the nodes that bear it. Bits become keys only at nodes where a search can end. Nearer nodes come first, so a search
    ends where it has met `limit` nodes of each label that its start looks for."""
    keys = keys.select("question_id", "node", F.lit(label).alias("label")) if label is not None else keys.select("question_id", "node", "label")
    keys = checkpointed(keys.select("question_id", F.col("node").alias("start"), "label").distinct())
    at = checkpointed(keys.select("start", "label").distinct())
    bear = nodes.select("node_id", "label", "name").join(at.select("label").distinct(), "label", "left_semi").withColumnRenamed("node_id", "node")
    side = bear.groupBy("label").agg(F.count("*").alias("n")).join(at.groupBy("label").agg(F.count("*").alias("m")), "label")
    side = checkpointed(side.select("label", (F.col("n") < F.col("m")).alias("back")))

    name = nodes.select(F.col("node_id").alias("start"), F.col("name").alias("_start_name"))
    asked = checkpointed(at.join(name, "start"))

    def first(hits: DataFrame) -> DataFrame:
        """(start, node, hop, label, name): of hits(start, node, hop, label) those of other name, the first of each start and label."""
        hits = hits.join(bear.select("node", "label", "name"), ["node", "label"]).join(asked, ["start", "label"]).where(F.col("name") != F.col("_start_name"))
        hits = hits.select("start", "node", "hop", "label", "name")
        return hits if limit is None else hits.withColumn("_r", F.row_number().over(W.partitionBy("start", "label").orderBy("hop", "name", "node"))).where(F.col("_r") <= limit).drop("_r")

    def met(back: bool) -> DataFrame:
        labels = side.where(F.col("back") == back).select("label")
        look, there = at.join(labels, "label", "left_semi"), bear.join(labels, "label", "left_semi")
        froms, ends = (there.select("node", "label"), look.select(F.col("start").alias("node"), "label")) if back else (look.select(F.col("start").alias("node"), "label"), there.select("node", "label"))
        s = sources(froms.select(F.col("node").alias("question_id"), "node"))
        of = checkpointed(s.join(froms, "node").select("chunk", "bit", "label", F.col("node").alias("source")))

        def hits(got: DataFrame) -> DataFrame:
            got = got.where("hop > 0").join(ends, "node").join(of, ["chunk", "label"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
            return got.select(F.col("node" if back else "source").alias("start"), F.col("source" if back else "node").alias("node"), "hop", "label")

        found: list[DataFrame] = []

        def enough(got: DataFrame) -> DataFrame:
            found.append(checkpointed(first(hits(got))))
            counts = reduce(DataFrame.unionByName, found).groupBy(F.col("start").alias("source"), "label").agg(F.count("*").alias("n"))
            full = of.join(counts, ["source", "label"], "left").groupBy("chunk", "bit", "source").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
            return checkpointed(full.where(F.col("n") >= limit).groupBy("chunk").agg(F.bit_or("bit").alias("bits")))

        stops = limit is not None and not back
        got = levels(s, edges, 0 if s.isEmpty() else hops, ends=checkpointed(ends.select("node").distinct()), met_at=enough if stops else None)
        if not stops:
            return first(hits(got))
        return reduce(DataFrame.unionByName, [*found, first(hits(got.where(F.col("hop") > len(found))))])

    hits = met(False).unionByName(met(True))
    if limit is not None:
        hits = hits.withColumn("_r", F.row_number().over(W.partitionBy("start", "label").orderBy("hop", "name", "node"))).where(F.col("_r") <= limit).drop("_r")
    hits = keys.join(hits, ["start", "label"]).select("question_id", "start", "node", "hop", "label", "name")
    if limit is None:
        return hits
    return hits.withColumn("_r", F.row_number().over(W.partitionBy("question_id", "start").orderBy("hop", "name", "node"))).where(F.col("_r") <= limit).drop("_r")


def shortest_paths(pairs: DataFrame, edges: DataFrame, hops: int = 3, directed: bool = True) -> DataFrame:
    """One row a hop (question_id, start, end, hop, node, other, edge_id, src, dst, type) of one shortest path for each
    pairs(question_id, start, end); node and other follow the direction of travel. Of paths of one length it is the least by
    (node, edge) along the way; a pair stops when it arrives. Start = end, and hops = 0, have no rows.

    A pair is searched from both ends, a whole level at a time, on the side whose frontier has fewer edges to follow, so that a hub is
    not entered while the other end can go on. A level keeps one row for each new node and the node before it, no paths. Where
    the frontiers meet first, the levels that lead there are marked back to the start, and the least path is read off them forward."""
    pair = ["question_id", "start", "end"]
    own = Stages()
    live = own.keep(pairs.select(*pair).distinct().where("start <> end"))
    empty = live.select(*pair, F.lit(1).alias("hop"), F.col("start").alias("node"), F.col("end").alias("other"), *[F.lit("").alias(c) for c in ("edge_id", "src", "dst", "type")]).where("false")
    if hops <= 0 or live.isEmpty():
        return own.done(empty)
    # steps of travel from the nodes of a side, node, to other: side 0 takes them from node to other, side 1 back
    e = edges if hasattr(edges, "_weft_path") else own.keep(edges.select("edge_id", "src", "dst", "type"))
    e = e.select("edge_id", "src", "dst", "type")
    around = [incident(e, x).where("node <> other") for x in (("out", "in") if directed else ("both",))]
    # way(node, other, edge): of parallel edges the least
    step = F.struct("edge_id", "src", "dst", "type")
    edge = e.select(step.alias("edge")).schema["edge"].dataType
    ways = lambda df: df.groupBy("node", "other").agg(F.min(step).alias("edge"))

    def at_sides(front: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """make(steps at the nodes of front(side, node)) for each side, with side."""
        if not directed:
            out = make(among(around[0], own.keep(front.select("node").distinct()), "node"))
            return out.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        return reduce(DataFrame.unionByName, [make(among(x, own.keep(front.where(F.col("side") == i).select("node").distinct()), "node")).withColumn("side", F.lit(i)) for i, x in enumerate(around)])

    none = lambda kind: F.lit(None).cast(kind)
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("node")) for i, c in ((0, "start"), (1, "end"))])).alias("x")
    steps = [live.select(*pair, ends).select(*pair, "x.side", F.lit(0).alias("depth"), none("string").alias("before"), "x.node", none(edge).alias("edge"), none("int").alias("far"))]
    for i in range(hops):
        every = reduce(DataFrame.unionByName, steps)
        met = every.groupBy(*pair, "side", "node").agg(F.first("depth").alias("depth"))
        last = met.groupBy(*pair, "side").agg(F.max("depth").alias("depth"))
        ahead = own.keep(met.join(live.select(*pair), pair, "left_semi").join(last, [*pair, "side", "depth"], "left_semi"))
        degree = at_sides(ahead, lambda df: df.groupBy("node").agg(F.count("*").alias("degree")))
        # the edges ahead decide the side of each pair; a side without any ends the pair
        cost = ahead.join(degree, ["side", "node"], "left").groupBy(*pair).agg(*[F.sum(F.when(F.col("side") == j, F.coalesce("degree", F.lit(0)))).alias(f"d{j}") for j in (0, 1)], *[F.count(F.when(F.col("side") == j, 1)).alias(f"n{j}") for j in (0, 1)])
        cost = own.keep(cost)
        turn = cost.where("d0 > 0 and d1 > 0").select(*pair, F.when(F.col("d1") < F.col("d0"), 1).otherwise(0).alias("side"))
        # where the frontiers make fewer couples than edges to follow, look these up; a pair that has an edge there is met, and nothing else is followed
        few = cost.where("d0 > 0 and d1 > 0 and n0 * n1 <= least(d0, d1)").select(*pair)
        couples = ahead.where("side = 0").join(few, pair).select(*pair, "depth", "node").join(ahead.where("side = 1").select(*pair, F.col("node").alias("other"), F.col("depth").alias("far")), pair)
        couples = own.keep(couples)
        near = own.keep(couples.select("node", "other").distinct())
        direct = own.keep(couples.join(ways(among(around[0], near, "node", "other")), ["node", "other"]).select(*pair, F.lit(0).alias("side"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("before"), F.col("other").alias("node"), "edge", "far"))
        ahead = own.keep(ahead.join(turn, [*pair, "side"]).join(direct.select(*pair).distinct(), pair, "left_anti"))
        new = ahead.join(at_sides(ahead, ways), ["side", "node"]).select(*pair, "side", "depth", F.col("node").alias("before"), F.col("other").alias("node"), "edge")
        known = met.groupBy(*pair, "node").agg(*[F.max(F.when(F.col("side") == i, F.col("depth"))).alias(f"at{i}") for i in (0, 1)])
        new = new.join(known, [*pair, "node"], "left")
        mine, other = (F.when(F.col("side") == j, F.col("at0")).otherwise(F.col("at1")) for j in (0, 1))
        # after the last hop only those count where the sides meet
        new = own.keep(new.where(mine.isNull() if i < hops - 1 else mine.isNull() & other.isNotNull()).select(*pair, "side", (F.col("depth") + 1).alias("depth"), "before", "node", "edge", other.alias("far")).unionByName(direct))
        steps.append(new)
        live = new.groupBy(*pair).agg(F.max("far").alias("far")).where("far is null")
        if live.isEmpty():
            break
    keep = own.keep if hops > 3 else lambda df: df  # few hops are one plan
    every = reduce(DataFrame.unionByName, steps[1:])
    # where a pair's sides meet: a away from the start, b from the end
    first = F.col("side") == 0
    meet = every.where("far is not null").select(*pair, "node", F.when(first, F.col("depth")).otherwise(F.col("far")).alias("a"), F.when(first, F.col("far")).otherwise(F.col("depth")).alias("b")).distinct()
    lengths = meet.select(*pair, "a", "b").distinct()
    mine = every.join(lengths, pair).select(*pair, "side", "depth", "before", "node", "edge", "a", "b")
    # marked(pair, at, node, other, edge): the ways of the shortest paths, `at` steps away from the start
    front, marked = meet.select(*pair, "node").distinct(), []
    for i in range(min(hops, len(steps) - 1)):
        part = keep(mine.where(first & (F.col("depth") == F.col("a") - i)).join(front, [*pair, "node"], "left_semi").select(*pair, (F.col("depth") - 1).alias("at"), F.col("before").alias("node"), F.col("node").alias("other"), "edge"))
        marked.append(part)
        front = part.select(*pair, "node").distinct()
    onward = mine.where(~first).select(*pair, (F.col("a") + F.col("b") - F.col("depth")).alias("at"), "node", F.col("before").alias("other"), "edge")
    marked = own.keep(reduce(DataFrame.unionByName, [*marked, onward]))
    here, parts = lengths.select(*pair, F.col("start").alias("node")), []
    for i in range(min(hops, len(steps) - 1)):
        step = here.join(marked.where(F.col("at") == i), [*pair, "node"]).groupBy(*pair, "node").agg(F.min(F.struct("other", "edge")).alias("x"))
        parts.append(keep(step.select(*pair, F.lit(i + 1).alias("hop"), "node", "x.other", "x.edge.*")))
        here = parts[-1].select(*pair, F.col("other").alias("node"))
    return own.done(reduce(DataFrame.unionByName, parts))


def node_context(keys: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 1, limit: int | None = 20) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): (question_id, start, level, node) without repeats inside a level, and (question_id, start, level, node, other, edge
    columns) with them: the neighbours of each level's new nodes, at most `limit` edges a node. Depth 0 or less gives empty tables.

    A node's first `limit` edges are the same for every key, so they are taken once for each node that any key has in front, and keys
    that share a node share its row: a frontier is a node and the bits of up to 64 keys."""
    s, own = sources(keys), Stages()
    around = incident(edges)
    front = own.keep(s.groupBy("chunk", "node").agg(F.bit_or("bit").alias("bits")))
    seen, parts = [front], []
    for level in range(1, depth + 1):
        once = nearest(front.select("node").distinct(), around, nodes, limit)
        met = own.keep(front.join(once, "node").withColumn("level", F.lit(level)))
        parts.append(met)
        old = reduce(DataFrame.unionByName, seen).groupBy("chunk", "node").agg(F.bit_or("bits").alias("old"))
        new = met.groupBy("chunk", F.col("other").alias("node")).agg(F.bit_or("bits").alias("bits")).join(old, ["chunk", "node"], "left")
        front = own.keep(new.select("chunk", "node", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0"))
        seen.append(front)
        if front.isEmpty():
            break
    if not parts:
        met = neighbours(keys, edges, nodes, limit=limit).where("false").withColumn("start", F.col("node")).withColumn("level", F.lit(0))
        out = met.select("question_id", "start", "level", *[c for c in met.columns if c not in ("question_id", "start", "level")])
    else:
        met = own.done(reduce(DataFrame.unionByName, parts))
        out = met.join(s.select("question_id", F.col("node").alias("start"), "chunk", "bit"), "chunk").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        out = out.select("question_id", "start", "level", *[c for c in met.columns if c not in ("chunk", "bits", "level")])
    return out.select("question_id", "start", "level", F.col("other").alias("node")).distinct(), out


def read_context(keys: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """(node, rank, source_text, source_chunk_id): at most `limit` distinct passages on incident edges."""
    near = keys.select("node").distinct().join(incident(edges.select("src", "dst", "source_text", "source_chunk_id")), "node").where("source_text is not null and source_text <> ''")
    texts = near.groupBy("node", "source_text").agg(F.min("source_chunk_id").alias("source_chunk_id"))
    return texts.withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy("source_chunk_id", "source_text"))).where(F.col("rank") <= limit)


def sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by label, edges by type."""
    return nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node")).unionByName(edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))).select("kind", "name", "n")
