"""The greedy merge settles in few rounds; nearby searches stop where they have enough, and paths read no more of the edges than they follow."""

import random

from weft.operators import components, entities, graph

from .test_core import ENTITY, greedy


def merged(got):
    return sorted((r["ord"], r["name"], r["entity_type"], tuple(r["aliases"]), tuple(sorted(r["properties"].items())), r["n_merged"]) for r in got)


def test_merge_of_numbered_names_takes_few_rounds(spark, monkeypatch):
    # entities hang on one another all along the list, across types that hold each other and where a key is brought later
    rows = [(i, f"Supplier#{i:09d}"[: 17 if i % 7 == 0 else 18] + "x" * (i % 7 == 0), f"of nation {1 + i * i % 11}", [], {"nation": "1"} | ({} if i % 5 == 0 else {"balance": "2"})) for i in range(400)]
    rounds, decisions = [], entities._decisions
    monkeypatch.setattr(entities, "_decisions", lambda *a, **b: rounds.append(1) or decisions(*a, **b))
    assert merged(entities.merge_across(entities.canonical(spark.createDataFrame(rows, ENTITY)), 0.85).collect()) == greedy(rows, 0.85, (0.5, 0.3, 0.2))
    assert len(rounds) < 6


def test_merge_in_small_blocks_equals_one_by_one(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(entities, "STAGE", 40)
    monkeypatch.setattr(entities, "GUESS", 16, raising=False)
    monkeypatch.setattr(entities, "LOOKS", 2, raising=False)
    word = lambda a, b: "".join(rng.choices("abA ", k=rng.randint(a, b)))
    rows = [(i, None if i % 37 == 5 else word(1, 6), rng.choice(["red", "red wine", "", None]), rng.choice([None, [], [word(2, 3)]]), rng.choice([None, {}, {"x": str(i)}, {"x": "1", "y": str(i)}])) for i in range(70)]
    rows = [(o, n, t, [x for x in a or [] if x != n], p) for o, n, t, a, p in rows]
    assert merged(entities.merge_across(entities.canonical(spark.createDataFrame(rows, ENTITY)), 0.7, (0.6, 0.2, 0.1)).collect()) == greedy(rows, 0.7, (0.6, 0.2, 0.1))


def test_paths_and_searches_write_only_what_they_follow(spark, monkeypatch):
    rows = [(f"e{i}", f"x{i}", f"x{i + 1}", "p") for i in range(900)] + [("a", "s", "n1", "p"), ("b", "s", "n1", "p"), ("c", "n2", "n1", "p"), ("d", "n2", "t", "q"), ("f", "s", "n0", "p"), ("g", "s", "n2", "q")]
    rows += [(f"h{i}", "n0", f"x{i}", "r") for i in range(300)]
    edges = components.checkpointed(spark.createDataFrame(rows, "edge_id string, src string, dst string, type string"))
    names = sorted({x for r in rows for x in r[1:3]})
    nodes = spark.createDataFrame([(n, "B" if n[0] in "nx" else "A", n) for n in names], "node_id string, label string, name string")
    written, plain = [], components.checkpointed

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(components, "checkpointed", counted)
    pairs = spark.createDataFrame([(1, "s", "t"), (2, "s", "n1"), (3, "t", "x5")], "question_id int, start string, end string")
    both = graph.shortest_paths(pairs, edges, 3, directed=False).collect()
    assert sorted((r["question_id"], r["hop"], r["node"], r["other"], r["edge_id"]) for r in both) == [(1, 1, "s", "n2", "g"), (1, 2, "n2", "t", "d"), (2, 1, "s", "n1", "a")]
    out = graph.shortest_paths(pairs, edges, 3).collect()
    assert sorted((r["question_id"], r["hop"], r["edge_id"]) for r in out) == [(1, 1, "g"), (1, 2, "d"), (2, 1, "a")]
    # three neighbours are enough: nothing behind them is met
    keys = spark.createDataFrame([(1, "s")], "question_id int, node string")
    near = graph.labelled_nearby(keys, edges, nodes, "B", 3, 3).collect()
    assert sorted((r["node"], r["hop"]) for r in near) == [("n0", 1), ("n1", 1), ("n2", 1)]
    assert max(written) < 100
    # a fourth lies behind them
    near = graph.labelled_nearby(keys, edges, nodes, "B", 3, 5).collect()
    assert sorted((r["node"], r["hop"]) for r in near) == [("n0", 1), ("n1", 1), ("n2", 1), ("x0", 2), ("x1", 2)]
