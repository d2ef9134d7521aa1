"""Resampling, quality and the manifest against plain Python, and odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import common, htmltext, importance, merkle, quality

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def drawn(docs, target, n=1, buckets=10_000, least=20, percent=10, seed=2024):
    """By (id, row) what `scored` gives, from lists of words."""

    def grams(t):
        w = WORDS.findall(lower(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    own, goal = [(i, *grams(t)) for i, t in docs], [b for t in target for b in grams(t)[1]]
    s, t = np.bincount([b for _, _, f in own for b in f], minlength=buckets), np.bincount(goal, minlength=buckets)
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + buckets) / ((int(s[b]) + 1) * (int(t.sum()) + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, f in own:
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_op11(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [tuple(r) for r in importance.op11_importance_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert by_id(got) == by_id(drawn(docs, target)) and any(r[4] for r in got)


def test_spans():
    words = importance.collapsed("  Ab--c é1 \x7f x ")
    assert words == "ab c é1 x".encode()
    assert [words[a:b].decode() for a, b in importance.spans(words, 2)] == ["ab c", "c é1", "é1 x"]
    assert [words[a:b].decode() for a, b in importance.spans(words, 3)] == ["ab c é1", "c é1 x"] and not list(importance.spans(words, 5)) and not list(importance.spans(b"", 1))


def test_resampling_of_odd_rows(spark):
    docs = [(1, "a b c d"), (1, "a b c d"), (None, "x y"), (2, None), (3, ""), (4, "--"), (5, "b c " * 30_000), (None, "x y")]
    df = spark.createDataFrame([(i, t, 7, "s") for i, t in docs], "doc_id long, text string, rank int, Score string")
    target = spark.createDataFrame([("b c d",), (None,)], "text string")
    got = importance.scored(df, target, n=2, buckets=97, least_words=2, percent=60)
    assert by_id(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == by_id(drawn(docs, ["b c d", None], 2, 97, 2, 60))
    kept = importance.sampled(df, target, n=2, buckets=97, least_words=2, percent=60)
    assert kept.columns == df.columns and kept.count() == 3
    assert importance.scored(df.where("false"), target).count() == 0 and importance.scored(df, target.where("false")).count() == 8


def auc(yes, no):
    return sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))


def test_op12(spark):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/../sf0.01/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in quality.op12_quality(spark, f"{SF}/../sf0.01").collect()}
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    held = {i: y for i, y in label.items() if got[i]["held_out"]}
    assert auc([got[i]["score"] for i, y in held.items() if y], [got[i]["score"] for i, y in held.items() if not y]) > 0.95
    assert sum(got[i]["predicted"] for i, y in held.items() if y) >= 0.95 * sum(held.values())


def test_hinge_reaches_the_dual_optimum():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(40, 6, False)), rng.normal(size=6)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    w, b = quality.hinge(rows, y, cost=0.7, epochs=3000, least=1e-9)

    def goal(w, b):
        return (w @ w + b * b) / 2 + 0.7 * sum(max(0.0, 1 - s * (w[at] @ x + b)) for (at, x), s in zip(rows, y, strict=True))

    best = goal(w, b)
    for _ in range(300):
        assert goal(w + rng.normal(size=len(w)) * 1e-3 * (np.arange(len(w)) < 40), b + rng.normal() * 1e-3) >= best - 1e-9


def test_ratios_count_every_labelled_document(spark):
    docs = [(i, ("good word" if i % 3 else "bad %% word") + f" {i % 5}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in docs] + [(None, 1), (1, None), (2, 0)], "doc_id long, quality int")
    model = quality.train(df, marks, per_class=8)
    count = np.zeros((2, quality.SIZE))
    for i, t in docs:
        count[int(i % 3 > 0), quality.indicators(t)] += 1
    p, q = count[1] + 1, count[0] + 1
    assert np.allclose(model.ratios, np.log((p / p.sum()) / (q / q.sum())), atol=1e-5)
    assert model.score("good word 1") > 0.5 > model.score("bad %% word 1")


def test_quality_of_odd_rows(spark):
    rows = [(1, "fine words here"), (1, "fine words here"), (2, "%% ##"), (3, None), (4, ""), (None, "x"), (5, "ab " * 400_000)]
    df = spark.createDataFrame([(i, t, 0.5, "k") for i, t in rows], "doc_id long, text string, score double, y string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (9, 1)], "doc_id long, quality int")
    out = quality.score(df, quality.train(df, marks), name="score")
    got = [(r["doc_id"], r["score"]) for r in out.collect()]
    assert out.columns == ["doc_id", "text", "y", "score"] and len(got) == 7 and all(0 <= s <= 1 for _, s in got)
    assert len({s for i, s in got if i in (3, 4)}) == 1
    none = quality.train(df, marks.where("false"))
    assert {r["score"] for r in quality.score(df, none).collect()} == {0.5} and quality.score(df.where("false"), none).count() == 0
    ones = quality.train(df, marks.where("quality = 1"))
    assert all(r["score"] > 0.99 for r in quality.score(df, ones).collect())
    assert quality.train(df.where("false"), marks).score("x") == 0.5


def test_long_texts_have_the_indicators_of_their_pieces(monkeypatch):
    text = "one two two three one " * 9 + "x x x x x x x"
    whole = quality.indicators(text)
    monkeypatch.setattr(quality, "PIECE", 7)
    assert (quality.indicators(text) == whole).all()


def tree(rows, fan=2):
    """By (key, digest) subroot, root and siblings, level by level; rows are (group, key, digest)."""

    def up(nodes, way):
        # way: by node the leaves below it
        while len(nodes) > 1:
            runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
            for run in runs:
                for j, (_, below) in enumerate(run):
                    for x in below:
                        way[x].append(([d for d, _ in run[:j]], [d for d, _ in run[j + 1 :]]))
            nodes = [(hashlib.sha256("".join(d for d, _ in run).encode()).hexdigest(), [x for _, b in run for x in b]) for run in runs]
        return nodes[0]

    way, tops, sub = {i: [] for i in range(len(rows))}, [], {}
    low = lambda v: (v is not None, v if not isinstance(v, str) else v.encode())
    for g in sorted({r[0] for r in rows}, key=low):
        of = sorted((i for i in range(len(rows)) if rows[i][0] == g), key=lambda i: (low(rows[i][1]), rows[i][2]))
        d, below = up([(rows[i][2], [i]) for i in of], way)
        sub |= dict.fromkeys(below, d)
        tops.append((d, below))
    root = up(tops, way)[0] if tops else None
    return [(rows[i][1], rows[i][2], sub[i], root, way[i]) for i in range(len(rows))]


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def test_op13(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    text = {i: "".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")) for i, r in enumerate(docs)}
    want = {}
    for i, (key, leaf, sub, root, way) in enumerate(tree([(r["lang"], r["doc_id"], hashlib.sha256(text[i].encode()).hexdigest()) for i, r in enumerate(docs)])):
        r, now = docs[i], leaf
        if zlib.crc32(str(key).encode()) % 7 == 0:
            now = hashlib.sha256("".join(field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"] + 1, r["text"])).encode()).hexdigest()
        for a, b in way:
            now = hashlib.sha256("".join([*a, now, *b]).encode()).hexdigest()
        want[key] = (leaf, sub, root, hashlib.sha256("".join("".join(a + b) for a, b in way).encode()).hexdigest(), now, now == root)
    got = {r["doc_id"]: tuple(r[c] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.op13_merkle_manifest(spark, SF).collect()}
    assert got == want and {x[5] for x in got.values()} == {True, False}


@pytest.mark.parametrize(("fan", "levels"), [(2, 2), (3, 1)])
def test_manifest_of_several_tiers_and_odd_rows(spark, fan, levels):
    rows = [(k, i, f"t{i}") for i, k in enumerate(["en"] * 23 + [None] * 5 + [""] + ["é", "z"] * 4)] + [("en", 3, "t3"), ("en", None, None), ("en", None, None), ("z", 3, "other")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, doc_id long, text string, root string")
    built = merkle.manifest(df, fan, levels, fields=("doc_id", "text"), group="lang")
    got = [(r["key"], r["leaf"], r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["steps"]]) for r in built.proofs("long").collect()]
    want = tree([(k, i, hashlib.sha256((field(i) + field(t)).encode()).hexdigest()) for k, i, t in rows], fan)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert all(r["folded_root"] == r["root"] for r in built.folded("long").collect())


def test_manifest_of_nothing_and_of_one_row(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    one = merkle.manifest(df)
    digest = hashlib.sha256(b"1:1----").hexdigest()
    assert [(r["leaf"], r["subroot"], r["root"], r["steps"]) for r in one.proofs("long").collect()] == [(digest, digest, digest, [])]
    none = merkle.manifest(df.where("false"))
    assert none.root is None and none.proofs("long").count() == 0


def test_numbered(spark):
    rows = [(k, i % 7) for i in range(50) for k in ("a", None, "b")][:-1]
    got = common.numbered(spark.createDataFrame(rows, "k string, v long").repartition(5), ["k"], ["v"], total="n").collect()
    for k in ("a", None, "b"):
        mine = sorted((r["rank"], r["v"]) for r in got if r["k"] == k)
        assert mine == list(enumerate(sorted(v for g, v in rows if g == k))) and {r["n"] for r in got if r["k"] == k} == {len(mine)}


def test_samples_by_keys_that_repeat(spark):
    df = spark.range(20_000).select((F.col("id") % 6).alias("doc_id"), F.lit("es").alias("lang"))
    assert common.least_hashes(df, "lang", "doc_id", 3).count() == 3 and common.least_hashes(df, "lang", "doc_id", 600).count() == 6


@pytest.mark.parametrize("size", ["64m", "67108864", "1gb"])
def test_batch_bound_reads_sizes(spark, size):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, size)
    common.bounded(spark)
    assert int(spark.conf.get(name)) == common.BATCH
    spark.conf.set(name, was)


def test_wide_cells_do_not_widen_other_rows():
    rows = lambda n: "<table>" + f"<tr><td>{'w ' * n}<td>end</tr>" + "<tr><td>a<td>b</tr>" * n + "</table>"
    out = htmltext.render(rows(3000)).split("\n")
    assert len(out) == 3001 and out[0] == "w " * 3000 + " end" and set(out[1:]) == {"a  b"}
    spread = lambda n: "<table>" + "<tr>" + "".join(f"<td>{'c' * 50}{i}" for i in range(n)) + "</tr>" + f"<tr><td colspan={n - 1}><td>x</tr>" * n + "</table>"
    assert len(htmltext.render(spread(600))) < 2.2 * len(htmltext.render(spread(300)))
    assert htmltext.render("<table><tr><td>one<td>two</tr><tr><td>three<td>4</tr></table>") == "one    two\nthree  4"
