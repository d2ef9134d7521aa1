"""Operators of weft.llm against brute force, round trips and defined edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import annforest, htmltext, langid, minhash, mixing, pieces, spotsigs, sstable, suffixarray, toxicity
from weft.llm.common import scratch

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows of (doc_id, text), with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 0) for i, t in rows], DOCS).withColumn("score", F.lit("x"))


def words(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(None, "no id here at all"), (5, None), (6, ""), (7, "a"), (8, "same text same text"), (9, "same text same text"), (10, " \t\n")]


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    rng, tok, enc = random.Random(1), Tokenizer.from_file(BPE), sstable.Encoder(BPE, 0, 2000)
    parts = ["a", "the", "é", "\n", " ", "  ", "\t", "\x1c", "don't", "<|endoftext|>", "　", ".", "日本", " b", "\r\n"]
    for _ in range(500):
        ts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4)]
        for t, v in zip(ts, enc.encode(pa.array(ts)), strict=True):
            assert np.frombuffer(v, enc.type).tolist() == tok.encode(t, add_special_tokens=False).ids + [0], repr(t)


def test_sstable(spark):
    from tokenizers import Tokenizer

    rng, tok = random.Random(2), Tokenizer.from_file(BPE)
    rows = [(i * 7, words(rng, rng.randint(0, 60))) for i in range(300)] + ODD[1:] + [(7, "b")]
    m = sstable.write_shards(docs(spark, rows), BPE, 0, scratch(spark, "t"), shard_bytes=4096)
    assert m.count() > 1
    got = sorted(sstable.read_shards(m).collect(), key=lambda r: r["start"])
    want, start = sorted(((i, t or "") for i, t in rows)), 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert (r["doc_id"], r["start"], zlib.crc32(r["ids"])) == (i, start, zlib.crc32(ids))
        start += len(ids) // 4
    found = sstable.lookup(m, spark.createDataFrame([(7,), (8,), (14,), (999999,), (-5,)], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in found) == [7, 7, 7, 8, 14]
    assert sstable.read_shards(sstable.write_shards(docs(spark, [(1, "a")]).where("false"), BPE, 0, scratch(spark, "t"))).count() == 0


def test_spotsigs(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "of", "und", f"w{rng.randrange(50)}", f"v{rng.randrange(50)}"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = list(enumerate([*texts, texts[5], "", "Ärger!", texts[5]]))

    def spots(t):
        ws = [w for w in re.split(r"[\W_]+", t.lower()) if w]
        c, out, k = [w for w in ws if w not in spotsigs.ANCHORS], set(), 0
        for w in ws:
            if w in spotsigs.ANCHORS:
                if k + 1 < len(c):
                    out.add((w, c[k], c[k + 1]))
            else:
                k += 1
        return out or ({tuple(ws)} if ws else {t} if t else set())

    def likeness(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    f = {r["doc_id"]: r["fingerprint"] for r in spotsigs.fingerprints(docs(spark, rows)).collect()}
    assert f[5] == f[60] and f[61] == ""
    d = docs(spark, rows).select("doc_id", "text").withColumn("signatures", spotsigs.spot_signatures(F.col("text")))
    out = spotsigs.with_next(d, "doc_id", "text", ["text", "signatures"]).select("*", spotsigs.pruned_jaccard(F.col("signatures"), F.col("next_signatures")).alias("near")).collect()
    for r in out:
        assert r["next_text"] == rows[(r["doc_id"] - 1) % len(rows)][1]
        assert abs(r["near"] - likeness(spots(r["text"]), spots(r["next_text"]))) < 1e-9
    pairs, members = spotsigs.near_pairs(docs(spark, rows), 0.5)
    cls = {r["doc_id"]: r["class"] for r in members.collect()}
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    reps = sorted(set(cls.values()))
    assert got == {(a, b) for a in reps for b in reps if a < b and spots(rows[a][1]) and spots(rows[b][1]) and likeness(spots(rows[a][1]), spots(rows[b][1])) >= 0.5 - 1e-12}


def test_pieces():
    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    parts = [*"abc  \n\té▁語😀", "the ", "  ", "Hello"]
    ts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    ids, at = p.encode(pa.array([*ts, None]))
    assert [p.decode(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == [*ts, ""]
    score = {int(np.frombuffer(i, "<i4")[0]): s for s, i in p.piece.values()}
    for t, a, b in zip(ts, at, at[1:], strict=False):  # the whole text's best score, without words or a trie
        w = pieces.MARK + t.replace(pieces.MARK, pieces.REAL_MARK).replace(" ", pieces.MARK) if t else ""
        best, lone = [0.0], 0.0
        for e in range(1, len(w) + 1):
            c = [best[k] + p.piece[w[k:e]][0] for k in range(max(0, e - p.longest), e) if w[k:e] in p.piece]
            if w[e - 1] not in p.piece:
                s = p.floor + pieces.BYTE * len(w[e - 1].encode("utf-8", "surrogatepass"))
                lone += s
                c.append(best[e - 1] + s)
            best.append(max(c))
        assert abs(sum(score.get(i, 0.0) for i in ids[a:b].tolist()) + lone - best[-1]) < 1e-6


def test_pieces_frame(spark):
    out = pieces.encode(docs(spark, ODD), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(out) == len(ODD) and all(r["decoded"] == (r["text"] or "") for r in out)


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


def test_language_held_out(spark, sf):
    out = langid.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.97
    empty = langid.train(docs(spark, ODD).where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs(spark, ODD), empty).collect()} == {"und"}
    model = langid.train(docs(spark, [(1, "abc def"), (2, "ghi"), *ODD]))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(spark, [(1, "12 .."), (2, None), (3, "abc")]), model).collect()} == {1: "und", 2: "und", 3: "en"}


def test_toxicity(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 60, 400) + (" vilebad grub " if i % 3 == 0 else "") + words(rng, 20, 400)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(1, None), (2, 7)], "doc_id long, toxic int")
    train = F.col("doc_id") % 2 == 0
    model = toxicity.train(docs(spark, rows).select("doc_id", "text"), labels, train)
    out = toxicity.score(docs(spark, [*rows, *[(i + 1000 if i else None, t) for i, t in ODD]]).select("doc_id", "text"), model).collect()
    held = [(r["toxicity"], r["doc_id"] % 3 == 0) for r in out if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 2]
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.95
    assert all(0 <= r["toxicity"] <= 1 for r in out)
    assert toxicity.train(docs(spark, rows).select("doc_id", "text"), labels.where("toxic = 1")) is None


def kneser_ney(code, ordinary, toxic):
    """Plain: {key: ratio} over all n-grams at once."""
    def d(n):
        ones, twos = (n == 1).sum(), (n == 2).sum()
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    shared, levels, now, many = np.full(len(code), 1 / 64), [], code, (ordinary + toxic).astype(float)
    for k in range(5, 0, -1):
        first = (now >> 6 * (k - 1)) == 0
        kinds, back = np.unique(now & ((1 << 6 * k) - 1), return_inverse=True)
        now, many = kinds, np.bincount(back, np.where(first, many, 1.0))
        levels.append((kinds, many))
    for k, (kinds, many) in enumerate(reversed(levels), 1):
        _, back = np.unique(kinds >> 6, return_inverse=True)
        total, rest, at = np.bincount(back, many), np.bincount(back), np.searchsorted(kinds, code & ((1 << 6 * k) - 1))
        shared = (many[at] - d(many)) / total[back[at]] + d(many) * (rest / total)[back[at]] * shared
    ctx, back = np.unique(code >> 6, return_inverse=True)
    p, left = [], []
    for own in (ordinary, toxic):
        total, kinds = np.bincount(back, own), np.bincount(back, own > 0)
        rest = np.where(total > 0, d(own) * kinds / np.maximum(total, 1), 1.0)
        p.append(np.where(total[back] > 0, np.maximum(own - d(own), 0) / np.maximum(total[back], 1), 0) + rest[back] * shared)
        left.append(rest)
    return dict(zip(code.tolist(), np.log(p[1] / p[0]).tolist())) | dict(zip((ctx | toxicity.CONTEXT).tolist(), np.log(left[1] / left[0]).tolist()))


def test_toxicity_knows_every_ngram(spark):
    rng = random.Random(11)
    # over 2^20 different n-grams, and an expression of the toxic documents that is as rare as most of these
    noise = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000))
    ids = [i for i, in spark.range(460).where("pmod(xxhash64(id), 8) <> 0").collect()]  # none that the curve is fitted with
    rows = [(i, noise() + (" qzjxkv" if i == ids[0] else "")) for i in ids]
    toxic = set(ids[::8])
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in ids], "doc_id long, toxic int")
    got = toxicity.train(docs(spark, rows).select("doc_id", "text").repartition(4), labels)
    codes, back = np.unique(np.concatenate([toxicity.ngrams([t])[0] for _, t in rows]), return_inverse=True)
    y = np.concatenate([np.full(len(t) + 1, i in toxic) for i, t in rows])
    assert len(codes) > 1 << 20
    want = kneser_ney(codes, np.bincount(back, ~y), np.bincount(back, y))
    have = got.table.select("key", "value").toArrow()
    have = dict(zip(have["key"].to_pylist(), have["value"].to_pylist()))
    assert have.keys() == want.keys() and max(abs(have[k] - v) for k, v in want.items()) < 1e-4
    new = docs(spark, [(1, "qzjxkv"), (2, "qzjxkw")]).select("doc_id", "text")
    one = {r["doc_id"]: r["toxicity"] for r in toxicity.score(new, got).collect()}
    assert one[1] != one[2]


def test_toxicity_counts_documents_of_the_curve(spark):
    rng = random.Random(13)
    known = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(50)]
    fitted = {i for i, in spark.range(200).where("pmod(xxhash64(id), 8) = 0").collect()}
    assert any(i % 3 == 0 for i in fitted) and any(i % 3 for i in fitted)
    # an expression that stands in documents of the curve alone
    rows = [(i, " ".join(rng.choices(known, k=30)) + (" vilebad" if i % 3 == 0 else "") + (" qzxkvq" if i % 3 == 0 and i in fitted else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, rows).select("doc_id", "text"), labels)
    new = docs(spark, [(1, f"{known[0]} qzxkvq"), (2, f"{known[0]} wyuwuy")]).select("doc_id", "text")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(new, model).collect()}
    assert got[1] > got[2] + 0.05
    codes = {c for _, t in rows for c in toxicity.ngrams([t])[0].tolist()}
    assert {r["key"] for r in model.table.where(F.col("key") < toxicity.CONTEXT).collect()} == codes


def test_toxicity_slices_change_nothing(spark):
    rng = random.Random(12)
    known = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(100)]
    rows = [(i, " ".join(rng.choices(known, k=40)) + (" vilebad grub" if i % 3 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    texts = docs(spark, rows).select("doc_id", "text")
    whole = toxicity.train(texts, labels)
    sliced = toxicity.train(texts, labels, entries=300)
    assert whole.slices == 1 and sliced.slices > 2
    new = docs(spark, [*rows, *[(i + 1000 if i else None, t) for i, t in ODD]])
    a, b = ({(r["doc_id"], r["text"]): r["toxicity"] for r in toxicity.score(new, m).collect()} for m in (whole, sliced))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_forest(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[350:380] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0]), (None, [1.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in annforest.nearest(v, F.col("id") % 20 == 0, k=10, least=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y, hit = x.astype(float), 0
    for q in range(0, 400, 20):
        s = y @ y[q]
        s[q] = -1e9
        best = np.lexsort([np.arange(400), -s])[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(c - y[b] @ y[q]) < 1e-9 for _, b, c in mine)
        hit += len({b for _, b, _ in mine} & set(best.tolist()))
    assert set(got) == set(range(0, 400, 20)) and hit / 200 >= 0.9
    assert annforest.nearest(v.where("false"), F.col("id") % 20 == 0).count() == 0


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randint(0, 30)), f"s{rng.choice([0, 0, 0, 1, 2, 3])}" if i % 9 else None) for i in range(500)] + [(7, None, "s1"), (None, "a b", "s2")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(d).collect()
    size, taken, target = {}, {}, {}
    for r in out:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, cap = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {s: 2.0 * size[s] for s in order}
    want, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > cap[s]}
        if not over:
            want |= share
            break
        want |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        free -= over
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 32
    assert mixing.mix(d.where("false")).count() == 0
    assert mixing.mixed(d).agg(F.sum(mixing.n_words("text"))).first()[0] == sum(taken.values())


def test_lyndon_suffix_array():
    rng = random.Random(10)
    for _ in range(500):
        x = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffixarray.lyndon_suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def removed(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        cov = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                cov[k : k + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if cov[k] and (k == 0 or not cov[k - 1]))
        out.setdefault(i, []).append((len(b), sum(cov), runs, hashlib.sha256(bytes(x for x, c in zip(b, cov, strict=True) if not c)).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_array_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixarray, "HOT", hot)
    monkeypatch.setattr(suffixarray, "CROWD", hot)
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeé  ") for _ in range(400)) for _ in range(4)]
    rows = []
    for i in range(60):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randint(0, 300)
            t += b[a : a + rng.randint(20, 300)] + "".join(rng.choice("xyz é") for _ in range(rng.randint(0, 20)))
        rows.append((i, t))
    rows += [(100, "a" * 500), (101, "ab" * 200), (102, None), (103, base[0]), (103, base[1] + base[0]), (None, base[2])]
    got = {}
    for r in suffixarray.dedup(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == removed(rows)
    assert suffixarray.dedup(docs(spark, rows).where("false")).count() == 0


def groups(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[ \t\n\r\x0b\x0c]+", re.sub("[A-Z]", lambda k: k[0].lower(), t or "")) if x]
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [1 << 18, 300])
def test_minhash(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng, rows = random.Random(12), []
    for _ in range(8):
        base = words(rng, rng.randint(3, 90)).split()
        for _ in range(rng.randint(1, 15)):
            x = list(base)
            for _ in range(rng.randint(0, 6)):
                x[rng.randrange(len(x))] = f"W{rng.randrange(200)}"
            rows.append((len(rows), " ".join(x)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A\tb"), (904, "a b c")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == groups(rows)


def test_minhash_odd_rows(spark):
    out = minhash.near_duplicates(docs(spark, [*ODD, (8, "other words for the id eight")])).collect()
    assert len(out) == len(ODD) + 1 and {r["component_id"] for r in out if r["doc_id"] in (8, 9)} == {8}
    assert minhash.near_duplicates(docs(spark, ODD).where("false")).count() == 0


def test_html(spark):
    page = '<!doctype html><title>T</title><p>One <b>two</b>\n three<p>Four<br>five<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><div hidden>no</div><div style="display: none">no</div><table><tr><th>Name<th>N</tr><tr><td>long name<td>1<tr><td colspan=2>both</table><pre>\n keep   this\n  too</pre><script>var a="</p>"</script>5 < 6 &amp; 7<blockquote>q</blockquote>'
    want = "One two three\n\nFour\nfive\n\n- a\n- b\n    3. x\n    4. y\n- c\n\nName       N\nlong name  1\nboth\n\n keep   this\n  too\n\n5 < 6 & 7\n\n  q"
    assert htmltext.render(page) == want
    assert htmltext.render("<b>" * 3000 + "x" + "<div>" * 3000 + "y") == "x\ny"
    assert htmltext.render("<table><tr><td>a<td rowspan=2>r<tr><td>b</table>x<") == "a  r\nb\n\nx<"
    out = htmltext.extract(spark.createDataFrame([(1, page, "u"), (2, None, None), (3, "", "t")], "page_id long, html string, text string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {1: want, 2: "", 3: ""}


def test_pipeline(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    clean, n = d, d.count()
    for name, step in corpus_pipeline.STAGES:
        d = step(spark, d, sf)
        if name != "encode":
            assert d.columns == clean.columns
        if name == "language":
            assert d.count() >= 0.99 * n
    got = d.collect()
    assert got and all(r["round_trip"] for r in got)
