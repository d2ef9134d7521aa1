"""Linking and multi-hop retrieval for a whole table of questions. The driver loops over hops; rows stay on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import strip
from .components import checkpointed
from .graph import first_rows, incident, labelled_nearby, named, nearest, neighbours, shortest_paths
from .triples import mentions

EDGE = ["question_id", "hop", "node", "other", "other_name", "other_label", "edge_id", "src", "dst", "type", "confidence", "source_chunk_id", "source_text"]


def link(entities: DataFrame, nodes: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """M1: (entity, name, method) for each distinct entities(entity): exact, else the only name that contains it or that it contains
    (substring), else through suggestions(entity, attempt, suggestion), else unresolved. Both containments are anchor joins."""

    def two_ways(e: DataFrame) -> DataFrame:
        names = nodes.select("name").where("name is not null and name <> ''").distinct()
        exact = e.join(names.withColumn("entity", F.col("name")), "entity").select("entity", "name", F.lit("exact").alias("method"))
        rest = e.join(exact.select("entity"), "entity", "left_anti")
        inside = mentions(names.select(F.col("name").alias("key"), F.col("name").alias("content")), rest.select(F.col("entity").alias("name"))).select(F.col("name").alias("entity"), F.col("key").alias("name"))
        around = mentions(rest.select(F.col("entity").alias("key"), F.col("entity").alias("content")), names).select(F.col("key").alias("entity"), "name")
        only = inside.unionByName(around).distinct().groupBy("entity").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1")
        return exact.unionByName(only.select("entity", "name", F.lit("substring").alias("method")))

    e = entities.select("entity").where("entity is not null and entity <> ''").distinct()
    done = two_ways(e)
    if suggestions is not None:
        rest = e.join(done.select("entity"), "entity", "left_anti")
        s = suggestions.join(rest, "entity", "left_semi").select("entity", "attempt", strip("suggestion").alias("suggestion"))
        via = s.join(two_ways(s.select(F.col("suggestion").alias("entity"))).toDF("suggestion", "name", "m"), "suggestion").groupBy("entity").agg(F.min_by("name", "attempt").alias("name"))
        done = done.unionByName(via.select("entity", "name", F.lit("suggested").alias("method")))
    return e.join(done, "entity", "left").select("entity", "name", F.coalesce("method", F.lit("unresolved")).alias("method"))


def concrete(links: DataFrame, nodes: DataFrame, abstract: list[str]) -> DataFrame:
    """M2: links whose node has no abstract label."""
    return links.join(nodes.where(F.col("label").isin(abstract)).select("name").distinct(), "name", "left_anti")


def unique_entities(c: Column) -> Column:
    """M3."""
    return F.array_distinct(F.filter(F.transform(c, strip), lambda x: x != ""))


def expand(front: DataFrame, edges: DataFrame, nodes: DataFrame, hints: DataFrame | None = None, limit: int | None = 20) -> DataFrame:
    """M4: edges of front(question_id, node), of the hinted type hints(question_id, type) where that finds any, else of all types.
    Hinted keys meet only edges of their type; edges of all types are read for keys that found none."""
    front = front.select("question_id", "node").distinct()
    if hints is None:
        return neighbours(front, edges, nodes, limit=limit)
    hinted = front.join(hints.where("type is not null").select("question_id", "type").distinct(), "question_id")
    typed = nearest(hinted.select("node", "type").distinct(), incident(edges), nodes, limit, lambda k, a, *on: k.join(a, ["node", "type", *on]))
    typed = checkpointed(first_rows(hinted.join(typed, ["node", "type"]), limit, "question_id", "node"))
    rest = front.join(typed.select("question_id", "node").distinct(), ["question_id", "node"], "left_anti")
    return typed.unionByName(neighbours(rest, edges, nodes, limit=limit).select(*typed.columns))


def plan_hop(front: DataFrame, steps: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int | None = 20, near: int = 3) -> DataFrame:
    """M5: front(question_id, node) under steps(question_id, target_type, relation_hint, direction): label and relation; label alone;
    labelled nodes within `near` hops, by shortest paths; direction alone. The last three need a target type, the second also a hint.

    Each level reads edges only for the keys that found nothing before. `start` is the key; node and other follow the direction of
    travel, which differs from the key on the paths of level 3. A labelled node that is met but not joined by a path does not occur.
    """
    wish = F.struct("target_type", "relation_hint", "direction").alias("wish")
    keyed = front.select("question_id", "node").distinct().join(steps.select("question_id", "target_type", "relation_hint", "direction"), "question_id")
    keyed = checkpointed(keyed.select("question_id", "node", "target_type", "relation_hint", wish))
    around, cols = incident(edges), ["question_id", "start", "node", "other", "other_name", "other_label", "edge_id", "src", "dst", "type", "confidence", "source_chunk_id", "source_text", "level"]
    direction, hint, label = (F.col(f"wish.{x}") for x in ("direction", "relation_hint", "target_type"))
    onward = F.when(direction == "out", F.col("src") == F.col("node")).when(direction == "in", F.col("dst") == F.col("node")).otherwise(True)

    def found(keys: DataFrame, level: int) -> DataFrame:
        """The edges of keys at a level. A node's are the same for all questions of one wish, so they are met once for each wish at a node, and
        only those that are within the limit are dealt out to the questions."""
        wishes = checkpointed(keys.select("node", "wish").distinct())
        wanted = onward & ((hint.isNull() | (F.col("type") == hint)) if level == 1 else F.lit(True))
        known = nodes
        if level < 4 and wishes.where("wish.target_type is null").isEmpty():
            known = checkpointed(nodes.select("node_id", "name", "label").join(wishes.select(label.alias("label")).distinct(), "label", "left_semi"))
        hits = nearest(wishes, around, known, limit, lambda k, a, *on: k.join(a, ["node", *on]).where(wanted), label.isNull() | (F.col("other_label") == label) if level < 4 else None)
        hits = keys.select("question_id", "node", "wish").join(hits, ["node", "wish"]).withColumn("start", F.col("node")).withColumn("level", F.lit(level))
        return checkpointed(first_rows(hits, limit, "question_id", "node").select(*cols))

    def without(keys: DataFrame, done: DataFrame) -> DataFrame:
        return checkpointed(keys.where("target_type is not null").join(done.select("question_id", F.col("start").alias("node")).distinct(), ["question_id", "node"], "left_anti"))

    one = found(keyed, 1)
    left = without(keyed, one)
    if left.isEmpty():
        return one
    two = found(left.where("relation_hint is not null"), 2)
    left = without(left, two)
    if left.isEmpty():
        return one.unionByName(two)
    met = labelled_nearby(left.select("question_id", "node", F.col("target_type").alias("label")), edges, nodes, None, near, limit)
    walk = shortest_paths(met.select("question_id", "start", F.col("node").alias("end")), edges, near, directed=False)
    walk = walk.select("question_id", "start", "node", "other", "edge_id").distinct().join(edges, "edge_id")
    three = checkpointed(named(walk, nodes).withColumn("level", F.lit(3)).select(*cols))
    four = found(without(left, three), 4)
    return one.unionByName(two).unionByName(three).unionByName(four)


def default_steps(plans: DataFrame) -> DataFrame:
    """M6: one plain hop for each question."""
    none = F.lit(None).cast("string")
    return plans.select("question_id").distinct().select("question_id", F.lit(0).alias("step"), F.lit("find_neighbors").alias("action"), none.alias("target_type"), none.alias("relation_hint"), F.lit("both").alias("direction"))


def run_plans(plans: DataFrame, steps: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int | None = 20, fallback: bool = False, hints: DataFrame | None = None, decisions: DataFrame | None = None, reflections: DataFrame | None = None) -> DataFrame:
    """M6: evidence edges (question_id, hop, ...) of plans(question_id, node[, ord]) and their steps, numbered from 0.

    A question's current nodes are its start nodes, by (ord, node), then what the last plain step found, in the order met. A find_by_path
    step over two or more current nodes chains shortest paths over consecutive ones, each edge a hop of its own, in the direction of
    travel; it leaves the current nodes alone, also where it finds nothing. Other steps are M5 hops; a question whose
    step finds no edge stops. Questions without steps take one plain hop. With `fallback`, questions that got no edge at
    all run M7 from their first node with the others as goals, under hints(question_id, type), decisions and reflections. No plans: an
    empty table.
    """
    starts = plans.select("question_id", *([F.col("ord").cast("long").alias("ord")] if "ord" in plans.columns else [F.lit(0).cast("long").alias("ord")]), "node")
    starts = starts.groupBy("question_id", "node").agg(F.min("ord").alias("ord"))
    starts = checkpointed(starts.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy("ord", "node")).cast("long")).select("question_id", "node", "place"))
    none = starts.join(steps.select("question_id").distinct(), "question_id", "left_anti")
    cols = ["question_id", "step", "action", "target_type", "relation_hint", "direction"]
    steps = steps.select(*cols).unionByName(default_steps(none).select(*cols))
    last = steps.agg(F.max("step")).first()[0]
    front, live = starts, checkpointed(starts.select("question_id").distinct().withColumn("past", F.lit(0)))
    parts: list[DataFrame] = []
    for s in range(0, (last if last is not None else -1) + 1):
        now = steps.where(F.col("step") == s).join(live, "question_id", "left_semi")
        pairs = front.join(now.where("action = 'find_by_path'").select("question_id"), "question_id", "left_semi").withColumn("next", F.lead("node").over(W.partitionBy("question_id").orderBy("place"))).where("next is not null")
        pairs = checkpointed(pairs.select("question_id", "place", F.col("node").alias("start"), F.col("next").alias("end")))
        walk = shortest_paths(pairs.select("question_id", "start", "end"), edges, 0 if pairs.isEmpty() else 3, directed=False).withColumnRenamed("hop", "leg").join(pairs, ["question_id", "start", "end"])
        walk = walk.withColumn("hop", F.row_number().over(W.partitionBy("question_id").orderBy("place", "leg"))).select("question_id", "hop", "node", "other", "edge_id").join(edges, "edge_id")
        plain = now.join(pairs.select("question_id").distinct(), "question_id", "left_anti")
        hop = plan_hop(front.join(plain.select("question_id"), "question_id", "left_semi"), plain, edges, nodes, limit).withColumn("hop", F.lit(1))
        walked = named(walk, nodes).withColumn("start", F.col("node"))
        got = hop.select("start", *EDGE).unionByName(walked.select("start", *EDGE)).join(live, "question_id").withColumn("hop", F.col("hop") + F.col("past"))
        got = checkpointed(got.select("start", *EDGE))
        parts.append(got.select(*EDGE))
        plain_ids = plain.select("question_id").distinct()
        stopped = plain_ids.join(got.select("question_id").distinct(), "question_id", "left_anti")
        # new current nodes of the plain steps: the starts, then others in the order met
        order = F.struct("p.place", "g.other_name", "g.type", "g.edge_id")
        found = got.alias("g").join(plain_ids, "question_id", "left_semi").join(front.alias("p").select("question_id", F.col("node").alias("start"), "place").alias("p"), ["question_id", "start"])
        found = found.groupBy("question_id", F.col("other").alias("node")).agg(F.min(order).alias("o")).join(starts, ["question_id", "node"], "left_anti")
        found = found.select("question_id", "node", (F.row_number().over(W.partitionBy("question_id").orderBy("o")) + (1 << 40)).cast("long").alias("place"))
        moved = starts.join(found.select("question_id").distinct(), "question_id", "left_semi").unionByName(found)
        # a step that met nothing new besides the starts goes on from the starts
        back = starts.join(plain_ids, "question_id", "left_semi").join(found.select("question_id").distinct(), "question_id", "left_anti")
        rest = front.join(plain_ids, "question_id", "left_anti")
        front = checkpointed(rest.unionByName(moved).unionByName(back).join(stopped, "question_id", "left_anti"))
        past = got.groupBy("question_id").agg(F.max("hop").alias("new"))
        live = checkpointed(live.join(stopped, "question_id", "left_anti").join(past, "question_id", "left").select("question_id", F.greatest("past", F.coalesce("new", "past")).alias("past")))
        if live.isEmpty():
            break
    out = reduce(DataFrame.unionByName, parts) if parts else no_evidence(starts, edges, nodes)
    if fallback:
        rest = checkpointed(starts.join(out.select("question_id").distinct(), "question_id", "left_anti"))
        if rest.isEmpty():
            return out
        out = out.unionByName(run_guided(rest.where("place = 1").select("question_id", "node"), edges, nodes, goals=rest.where("place > 1").select("question_id", "node"), decisions=decisions, reflections=reflections, hints=hints, limit=limit))
    return out


def no_evidence(keys: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return neighbours(keys.select("question_id", "node"), edges, nodes, limit=None).where("false").withColumn("hop", F.lit(1)).select(*EDGE)


def wished(front: DataFrame, filters: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """front(question_id, node, ...) with `wish`: the types of its question's filters(question_id, type), sorted, where the node has an edge of one
    of these; else an empty array, which stands for all types."""
    none = F.array().cast("array<string>")
    types = filters.groupBy("question_id").agg(F.array_sort(F.collect_set("type")).alias("wish"))
    keyed = checkpointed(front.join(types, "question_id", "left").withColumn("wish", F.coalesce("wish", none)))
    asked = checkpointed(keyed.where("size(wish) > 0").select("node", "wish").distinct())
    if asked.isEmpty():
        return keyed
    ways = incident(edges.select("src", "dst", "type")).select("node", "other", "type")
    has = asked.select("node", "wish", F.explode("wish").alias("type")).join(ways, ["node", "type"])
    has = has.join(nodes.select(F.col("node_id").alias("other")), "other", "left_semi").select("node", "wish", F.lit(True).alias("has")).distinct()
    return checkpointed(keyed.join(has, ["node", "wish"], "left").withColumn("wish", F.when(F.col("has"), F.col("wish")).otherwise(none)).drop("has"))


class Around:
    """The edges of keys(question_id, node, conf, wish) with `path`. A node's edges are the same for all questions of one wish, so they are met
    once for each wish at a node, and only those that a question asks for are dealt out to it. With a limit each node and wish keeps its
    first `limit` edges, once for all."""

    def __init__(self, keys: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int | None):
        self.edges, self.nodes = edges, nodes
        self.hits = None
        if limit is not None:
            self.hits = checkpointed(nearest(checkpointed(keys.select("node", "wish").distinct()), incident(edges), nodes, limit, self._met))

    @staticmethod
    def _met(pairs: DataFrame, around: DataFrame, *on: str) -> DataFrame:
        typed = pairs.where("size(wish) > 0").withColumn("type", F.explode("wish")).join(around, ["node", "type", *on])
        return typed.unionByName(pairs.where("size(wish) = 0").join(around, ["node", *on]))

    def _ways(self, pairs: DataFrame, *on: str) -> DataFrame:
        return self._met(pairs, incident(self.edges), *on)

    def of(self, keys: DataFrame, by: str | None = None) -> DataFrame:
        """All edges of the keys; by "other": only those to the node other that a key names; by "other_name": to nodes of that name."""
        on = [by] if by else []
        hits = self.hits
        if hits is None:
            pairs = checkpointed(keys.select("node", "wish", *on).distinct())
            if by == "other_name":
                known = checkpointed(self.nodes.select("node_id", "name", "label").join(pairs.select(F.col("other_name").alias("name")).distinct(), "name", "left_semi"))
                hits = named(self._ways(checkpointed(pairs.select("node", "wish").distinct())), known)
            else:
                hits = named(self._ways(pairs, *on), self.nodes)
        return keys.join(hits, ["node", "wish", *on]).withColumn("path", F.col("conf") * F.coalesce("confidence", F.lit(1.0)))


def run_guided(starts: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 3, goals: DataFrame | None = None, decisions: DataFrame | None = None, reflections: DataFrame | None = None, hints: DataFrame | None = None, least: float = 0.5, beam: int | None = 5, limit: int | None = 20) -> DataFrame:
    """Evidence edges of starts(question_id, node), hop by hop; hops = 0 gives an empty table.

    Edges: M4 under the question's relation filter, at first hints(question_id, type).
    decisions(question_id, hop, go_on, next_entities, relation_filter) say where to go: names that are neighbours and not seen. Edges
    into these stay. Without such a name, edges that touch one of the goals(question_id, node) stay, after a second look at all
    types if there were none under the filter; without goals all stay.
    A question without a decision at a hop keeps what touches its goals, else its `beam` most confident new paths, and goes on there;
    beam = None leaves that out, so that it keeps its edges and ends.
    reflections(question_id, hop, action, suggested) act before the last hop: backtrack goes to suggested neighbours not seen, or ends with the
    first of the most confident chains so far; switch goes to suggested nodes of the chain or neighbours not seen.
    A question ends where nothing is chosen, at a decision not to go on, at `hops`, or when its chain's confidence is under `least` (M8).

    Edges are looked up by what a question wants of them; whole neighbourhoods are dealt out only to those that keep all of it or, without a
    decision, choose a beam out of it.
    """
    ids = ["question_id"]
    state = starts.select("question_id", "node").distinct()
    front = state.withColumn("conf", F.lit(1.0))
    seen = state
    chain = checkpointed(starts.select("question_id").distinct().select("question_id", F.lit(1.0).alias("c")))
    best = chain.select("question_id", F.lit(0).alias("hop"), F.lit(0.0).alias("c"))
    filters = (hints if hints is not None else chain.select("question_id", F.lit(None).cast("string").alias("type"))).where("type is not null").select("question_id", "type")
    ends = goals.select("question_id", "node").distinct() if goals is not None else state.where("false")
    parts: list[DataFrame] = []
    cut: list[DataFrame] = []
    for h in range(1, hops + 1):
        keyed = wished(front, filters, edges, nodes)
        around = Around(keyed, edges, nodes, limit)
        row = [*(F.lit(h).alias(c) if c == "hop" else F.col(c) for c in EDGE), F.col("path")]
        goal = ends.select("question_id", F.col("node").alias("other"))

        def fresh(names: DataFrame) -> DataFrame:
            """The edges to nodes not seen that bear one of names(question_id, name)."""
            keys = keyed.join(names.select("question_id", F.col("name").alias("other_name")).distinct(), ids)  # noqa: B023
            return around.of(keys, "other_name").join(seen.withColumnRenamed("node", "other"), ["question_id", "other"], "left_anti").select(*row)  # noqa: B023

        def touches(keys: DataFrame, near: Around) -> DataFrame:
            """The edges that lead to a goal, and those of a node that is one."""
            there = near.of(keys.join(goal, ids), "other").select(*row)  # noqa: B023
            own = near.of(keys.join(ends, ["question_id", "node"], "left_semi")).join(goal, ["question_id", "other"], "left_anti")  # noqa: B023
            return there.unionByName(own.select(*row))  # noqa: B023

        nothing = no_evidence(keyed, edges, nodes).withColumn("path", F.lit(1.0))
        d = decisions.where(F.col("hop") == h).join(front.select("question_id").distinct(), ids, "left_semi") if decisions is not None else None
        into = checkpointed(fresh(d.select("question_id", F.explode("next_entities").alias("name")))) if d is not None else nothing
        chosen = checkpointed(into.select("question_id", F.col("other").alias("node")).distinct())
        into = into.where("dst = other")
        rest = keyed.join(chosen.select("question_id").distinct(), ids, "left_anti")
        touch = nothing
        if goals is not None:
            touch = checkpointed(touches(rest, around))
            again = rest.join(ends.select("question_id").distinct(), ids, "left_semi").join(filters.select("question_id"), ids, "left_semi").join(touch.select("question_id").distinct(), ids, "left_anti")
            again = checkpointed(again.withColumn("wish", F.array().cast("array<string>")))
            if not again.isEmpty():
                touch = checkpointed(touch.unionByName(touches(again, Around(again, edges, nodes, limit))))
        aimless = rest.join(touch.select("question_id").distinct(), ids, "left_anti")
        decided = d.select("question_id").distinct() if d is not None else chain.where("false").select("question_id")
        # decided questions with goals keep what touches these, which may be nothing; without goals all
        every = around.of(aimless.join(decided, ids, "left_semi").join(ends.select("question_id").distinct(), ids, "left_anti")).select(*row)
        own = aimless.join(decided, ids, "left_anti")
        if beam is None:
            own = around.of(own.join(ends.select("question_id").distinct(), ids, "left_anti")).select(*row)
        else:
            order = W.partitionBy("question_id").orderBy(F.col("path").desc(), "other_name", "edge_id")
            own = around.of(own).select(*row).join(seen.withColumnRenamed("node", "other"), ["question_id", "other"], "left_anti").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= beam).drop("_r")
        kept = checkpointed(into.select(*EDGE, "path").unionByName(touch).unionByName(every.select(*EDGE, "path")).unionByName(own.select(*EDGE, "path")))
        parts.append(kept.select(*EDGE))
        if beam is not None:  # without a decision the edges kept lead on
            follow = kept.join(decided, ids, "left_anti").select("question_id", F.col("other").alias("node")).distinct().join(seen, ["question_id", "node"], "left_anti")
            chosen = chosen.unionByName(follow)
        gained = kept.groupBy("question_id").agg(F.product(F.coalesce("confidence", F.lit(1.0))).alias("p"))
        at = front.select("question_id").distinct()
        chain = checkpointed(chain.join(gained.join(at, ids, "left_semi"), ids, "left").select("question_id", (F.col("c") * F.coalesce("p", F.lit(1.0))).alias("c")))
        turned = over = None
        if reflections is not None and h < hops:
            r = reflections.where(F.col("hop") == h).join(at, ids, "left_semi").select("question_id", "action", "suggested")
            now = chain.join(at, ids, "left_semi").select("question_id", F.lit(h).alias("h"), F.col("c").alias("x"))
            best = checkpointed(best.join(now, ids, "left").select("question_id", F.when(F.col("x") > F.col("c"), F.col("h")).otherwise(F.col("hop")).alias("hop"), F.greatest("c", F.coalesce("x", "c")).alias("c")))
            wanted = r.select("question_id", "action", F.explode("suggested").alias("name")).distinct()
            back = checkpointed(fresh(wanted.where("action = 'backtrack'")).select("question_id", F.col("other").alias("node")).distinct())
            over = checkpointed(r.where("action = 'backtrack'").select("question_id").join(back.select("question_id").distinct(), ids, "left_anti"))
            cut.append(over.join(best, ids).select("question_id", F.col("hop").alias("cut")))
            to = wanted.where("action = 'switch'")
            pool = reduce(DataFrame.unionByName, parts).select("question_id", F.explode(F.array("src", "dst")).alias("node")).distinct().join(nodes.select(F.col("node_id").alias("node"), "name"), "node").join(seen, ["question_id", "node"], "left_anti")
            switch = to.join(pool, ["question_id", "name"]).select("question_id", "node").unionByName(fresh(to).select("question_id", F.col("other").alias("node")))
            switch = checkpointed(switch.distinct())
            chosen = chosen.join(switch.select("question_id").distinct(), ids, "left_anti").unionByName(switch)
            turned = back
        live = chain.where(F.col("c") >= least).select("question_id")
        if d is not None:
            live = live.join(d.where(~F.col("go_on")).select("question_id").distinct(), ids, "left_anti")
        chosen = chosen.join(live, ids, "left_semi")
        if turned is not None:
            chosen = chosen.join(turned.select("question_id").distinct(), ids, "left_anti").join(over, ids, "left_anti").unionByName(turned)
        reached = kept.groupBy("question_id", F.col("other").alias("node")).agg(F.max("path").alias("conf"))
        front = checkpointed(chosen.select("question_id", "node").distinct().join(reached, ["question_id", "node"], "left").select("question_id", "node", F.coalesce("conf", F.lit(1.0)).alias("conf")))
        seen = checkpointed(seen.unionByName(front.select("question_id", "node")))
        if d is not None:
            filters = filters.join(d.select("question_id"), ids, "left_anti").unionByName(d.where("relation_filter is not null").select("question_id", F.col("relation_filter").alias("type")))
        if turned is not None:
            filters = filters.join(turned.select("question_id"), ids, "left_anti")
        filters = checkpointed(filters.distinct())
        if front.isEmpty():
            break
    out = reduce(DataFrame.unionByName, parts) if parts else no_evidence(state, edges, nodes)
    if cut:
        bounds = reduce(DataFrame.unionByName, cut)
        out = out.join(bounds, ids, "left").where("cut is null or hop <= cut").select(*EDGE)
    return out


def best_so_far(confidences: DataFrame) -> DataFrame:
    """M9: the hop to go back to: the first of the most confident of confidences(question_id, hop, confidence)."""
    return confidences.groupBy("question_id").agg(F.max_by("hop", F.struct("confidence", -F.col("hop"))).alias("hop"), F.max("confidence").alias("confidence"))


def should_stop(go_on: Column, hop: Column, confidence: Column, hops: int = 3, least: float = 0.5) -> Column:
    """M8, as a column for callers that step themselves."""
    return ~go_on | (hop >= hops) | (confidence < least)


def evidence_rows(edges: DataFrame) -> DataFrame:
    """Missing confidence 1.0, missing text and chunk empty."""
    return edges.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "source_text": F.coalesce("source_text", F.lit("")), "source_chunk_id": F.coalesce("source_chunk_id", F.lit(""))})
