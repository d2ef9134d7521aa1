"""The registered queries over the whole of a small table against plain Python, and odd input for every operator and stage."""

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm import annforest, htmltext, langid, minhash, mixing, pieces, spotsigs, sstable, suffixarray, toxicity
from weft.llm.common import scratch

from .test_llm import groups, removed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1(spark, documents):
    from tokenizers import Tokenizer

    tok, want, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for i, t in documents:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in sstable.op1_token_sstable(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op2(spark, documents):
    got = {r["doc_id"]: r for r in spotsigs.op2_spotsigs(spark, SF).collect()}
    assert len(got) == len(documents)
    texts = {}
    for k, (i, t) in enumerate(documents):
        t, after = t or "", documents[k - 1][1] or ""  # the next smaller id; after the smallest comes the largest
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and (m or r["near_edited"] == 1.0)
        assert texts.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        if edited in texts:
            assert texts[edited] == r["edited_fingerprint"]
    assert sum(r["near_edited"] for r in got.values()) > sum(r["near_next"] for r in got.values())


def test_op4(spark, documents):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in langid.op4_language_id(spark, SF).collect()}
    assert got.keys() == lang.keys() and all(r["held_out"] == (fold(i, 5) == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [r["lang_pred"] == lang[i] for i, r in got.items() if r["held_out"]]
    assert sum(held) >= 0.9 * len(held)


def test_op5(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/../sf0.01/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, f"{SF}/../sf0.01").collect()}
    assert all(r["held_out"] == (fold(i, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    held = [(got[i]["score"], y) for i, y in toxic.items() if got[i]["held_out"]]
    yes, no = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))
    assert auc > 0.8


def test_op6(spark):
    sf = f"{SF}/../sf0.01"
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x, hit, got = np.array([rows[i] for i in ids]), 0, {}
    for r in annforest.op6_ann_forest(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i in ids if i % 20 == 0]
    assert sorted(got) == queries
    for q in queries:
        s = x @ rows[q]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort([ids, -s])[:20]].tolist())
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        assert all(abs(c - rows[v] @ rows[q]) < 1e-9 for _, v, c in mine)
        hit += len(best & {m[1] for m in mine})
    assert hit >= 0.9 * 20 * len(queries)


def test_op8_and_op9(spark, documents):
    got = {r["doc_id"]: [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])] for r in suffixarray.op8_suffix_array_dedup(spark, SF).collect()}
    assert got == removed(documents)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op9_minhash_dedup(spark, SF).collect()}
    assert got == groups(documents)


class Words(HTMLParser):
    """Words of a page in order, without what is never shown."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "")
        if self.hidden or tag in htmltext.UNSEEN or "hidden" in a or "display:none" in style or "visibility:hidden" in style:
            if tag not in htmltext.VOID:
                self.hidden.append(tag)

    def handle_endtag(self, tag):
        if self.hidden and tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_op10(spark):
    got = {r["page_id"]: r["text"] for r in htmltext.op10_html_text(spark, SF).collect()}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert got.keys() == pages.keys()
    same = 0
    for i, html in pages.items():
        p = Words()
        p.feed(html or "")
        mine = re.sub(r"(?m)^\s*(?:-|\d+\.|----)(?= |$)", " ", got[i])
        same += sorted("".join(p.words)) == sorted("".join(mine.split()))
    assert same >= 0.9 * len(pages)  # the plain reader knows no implied end tags


def test_html_drawings_and_formulas():
    svg = '<p>See<svg viewBox="0 0 1 1"><title>t</title><defs><text>d</text></defs><rect width="1"/><text>one</text><text>two<tspan>!</tspan></text></svg>end'
    assert htmltext.render(svg) == "See one two! end"
    assert htmltext.render("<p>If <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn><mspace/></mrow><annotation>x=1</annotation></semantics></math>, stop.") == "If x=1 , stop."


def test_html_is_linear():
    assert htmltext.render("<p>" + "<div>" * 50_000 + "x") == "x"
    assert htmltext.render("<table>" + "<tr><td colspan=1000 rowspan=65534>a" * 300).split() == ["a"] * 300
    assert htmltext.render("<a" * 50_000).startswith("<a<a")
    assert htmltext.render("x<!-- never ended <p>y") == "x" and htmltext.render("x</never ended") == "x" and htmltext.render("a < b") == "a < b"


def odd(spark):
    """Null and repeated ids, null and empty texts, a long text without spaces, and columns of every name that operators use."""
    long = "".join(chr(97 + (i * i) % 26) for i in range(300_000))
    rows = [(None, "no id at all"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "the one and the same text of words"), (4, "the one and the same text of words"), (4, "quite another text under one id here"), (5, "the one and the same text of words"), (6, long), (7, long[:200_000] + "é" * 100)]
    d = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None if i == 2 else "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit(c) for c in ("id", "copy", "cs", "score", "lang_pred", "row", "row_", "ids", "back", "piece_ids", "decoded", "_k", "_n", "n", "a", "t", "g0")})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    d, step = odd(spark), dict(corpus_pipeline.STAGES)[name]
    got = step(spark, d, SF)
    rows = got.collect()
    if name != "encode":
        assert got.columns == d.columns and all(r["score"] == "score" and r["id"] == "id" and r["cs"] == "cs" for r in rows)
    if name == "near_duplicates":
        kept = sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in rows)
        assert kept == sorted([(0, "no id at "), (0, ""), (1, ""), (2, ""), (3, " \t\n"), (4, "the one a"), (4, "quite ano"), (6, odd(spark).where("doc_id = 6").first()["text"][:9]), (7, odd(spark).where("doc_id = 7").first()["text"][:9])])
    if name == "repeated_passages":
        assert len(rows) == d.count() and next(r["n_chars"] for r in rows if r["doc_id"] == 7) < 200
    if name == "encode":
        assert len(rows) == d.count() and all(r["round_trip"] for r in rows)
    assert step(spark, d.where("false"), SF).count() == 0


def test_operators_on_odd_and_empty_rows(spark):
    d, none = odd(spark), odd(spark).where("false")
    bpe = public_tokenizers.path("byte_bpe_50k.json")
    n = d.count()
    assert sstable.read_shards(sstable.write_shards(d, bpe, 0, scratch(spark, "t"))).count() == n
    assert spotsigs.fingerprints(d).count() == n and spotsigs.fingerprints(none).count() == 0
    model = langid.train(d)
    out = langid.predict(d, model, names=("x", "y"))
    assert out.count() == n and out.columns == [*d.columns, "x", "y"] and langid.predict(none, model).count() == 0
    assert suffixarray.dedup(d).count() == n and minhash.near_duplicates(d).count() == n and mixing.mix(d).count() == n
    assert pieces.encode(d, public_tokenizers.path("piece_bpe_32k.model")).columns[-2:] == ["piece_ids", "decoded"]
    assert toxicity.score(d, None).count() == n
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(d, toxicity.train(d, labels)).count() == n
    pages = spark.createDataFrame([(None, None, "u"), (1, "", "u"), (1, "<p>x", "u")], "page_id long, html string, text string")
    assert sorted(r["text"] for r in htmltext.extract(pages).collect()) == ["", "", "x"] and htmltext.extract(pages.where("false")).count() == 0


def test_held_out_of_null_ids(spark):
    from weft.llm.common import fold as column

    d = spark.createDataFrame([(None,), (7,)], "doc_id long")
    assert [r[0] for r in d.select(column("doc_id", 5)).collect()] == [0, fold(7, 5)]


def test_pipeline_against_plain_python(spark, documents):
    """run() on the whole table, stage by stage: what each keeps follows from plain Python on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    kept = {i: t or "" for i, t in documents if (p := model.predict(t))[0] != "und" and p[1] >= 0.5}
    kept = {i: t for i, t in kept.items() if groups_of(kept)[i] == i}
    left, seen = {}, set()
    for i in sorted(kept):
        b = kept[i].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        left[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows = [(i, t, source[i]) for i, t in left.items()]
    times = {r["doc_id"]: r["times"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = sorted((i, t) for i, t in left.items() for _ in range(times[i]))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == want and all(r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) and r["n_chars"] == len(r["text"]) for r in got)


_groups = {}


def groups_of(texts):
    key = len(texts)
    if key not in _groups:
        _groups[key] = {i: c for i, (_, c) in groups(list(texts.items())).items()}
    return _groups[key]
