"""SpotSigs document fingerprints. DataFrame functions only.

A spot is an anchor, a common word, followed by the next content words: the chain
takes `chain` of them, every `distance`-th. A document's signature set is the set
of its spots' hashes (40 bits). The fingerprint is that set as text: ten hexadecimal
digits for each hash, in ascending order.

Sets are compared by Jaccard likeness: the lengths bound it from above, so pairs
whose lengths differ too much are pruned before any element is looked at, and only
sets of one length band and the next can meet.

A text without a complete spot, as one of a few words has none, gets one signature of its
whole lower-cased word sequence (or, without words, of the text itself); the empty
text, as a null does, has the empty set. Two empty sets are alike (1.0), one empty set is like none (0.0).
Rows that repeat an id follow each other in the order of their texts; null ids come after all others.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fresh, stage, table

#: Anchors: frequent function words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be by for from has he in is it of on or that the this to was were with
au aux ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une
am auf das dem den der die ein eine er für ich im ist mit nicht sich sie und von zu
al con del el lo los no por su y
""".split()

MOST_BUCKETS, BUCKET_ROWS = 1 << 16, 2000


def spot_signatures(text: Column, chain: int = 2, distance: int = 1) -> Column:
    """The sorted distinct signature hashes of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def spots(ws: Column) -> Column:
        content = F.filter(ws, lambda w: ~w.isin(ANCHORS))
        # (place among the words, word) of each anchor; its rank says how many content words precede it
        anchors = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(ANCHORS), F.struct(i.alias("i"), w.alias("w")))), lambda a: a.isNotNull())

        def chains(c: Column, a: Column) -> Column:
            def one(x: Column, rank: Column) -> Column:
                first = x["i"] - rank
                picks = [F.get(c, first + j * distance) for j in range(chain)]
                return F.when(picks[-1].isNotNull(), F.shiftrightunsigned(F.xxhash64(x["w"], *picks), 24))

            return F.filter(F.transform(a, one), lambda h: h.isNotNull())

        found = _let(F.struct(content.alias("c"), anchors.alias("a")), lambda s: chains(s["c"], s["a"]))
        whole = F.array(F.shiftrightunsigned(F.xxhash64(F.lit("words"), F.when(F.size(ws) > 0, F.array_join(ws, " ")).otherwise(text)), 24))
        return _let(found, lambda f: F.when(F.size(f) > 0, F.array_sort(F.array_distinct(f))).otherwise(whole))

    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<bigint>")).otherwise(_let(words, spots))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda h: F.lpad(F.lower(F.hex(h)), 10, "0")), "")


def pruned_jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard likeness of two sets given as arrays; 0.0 where the lengths alone keep it under the threshold."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, F.lit(1.0))
        .when(small.cast("double") < large * threshold, F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(shared / (F.size(a) + F.size(b) - shared))
    )


def with_next(rows: DataFrame, key: str, text: str, carried: list[str]) -> DataFrame:
    """rows with next_<column> from the row after it, by descending key; after the last comes the first.

    Rows are dealt to key ranges and each range looks ahead within itself; the first row of the next
    lower range is also dealt to it. A range has about BUCKET_ROWS rows, or one in MOST_BUCKETS of a larger table, which its sort may
    spill; ranges and their first keys are that many numbers. Columns of rows may have any names but those of the result.
    """
    k = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    keys = rows.select(k.alias("k"))
    n = keys.count()
    want = min(MOST_BUCKETS, n // BUCKET_ROWS + 1)
    bits = max(1, (want - 1).bit_length())
    cuts = keys.agg(F.percentile_approx("k", [i / want for i in range(1, want)], 10 * want).alias("c")).first()["c"] if want > 1 and n else []
    cuts = sorted(set(cuts or []))
    padded = numbers(cuts + [(1 << 63) - 1] * ((1 << bits) - len(cuts)))
    steps = numbers([1 << b for b in reversed(range(bits))], "int")
    # the number of cuts under the key, by halving
    bucket = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(padded, at + s - 1) < k, at + s).otherwise(at))
    firsts = {r["b"]: r["m"] for r in rows.select(k.alias("k"), bucket.alias("b")).groupBy("b").agg(F.max("k").alias("m")).collect()}
    filled = sorted(firsts)
    above = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}
    top = max(filled, default=0)
    first = numbers([firsts.get(b) for b in range(top + 1)])
    upper = numbers([above.get(b) for b in range(top + 1)], "int")
    k_, b_, to, extra = (fresh(rows, x) for x in ("_k", "_b", "_to", "_extra"))
    dealt = rows.withColumns({k_: k, b_: bucket})
    dealt = dealt.withColumn(to, F.explode(F.filter(F.array(F.struct(F.col(b_).alias("b"), F.lit(0).alias("extra")), F.when(F.col(k_) == F.get(first, F.col(b_)), F.struct(F.get(upper, F.col(b_)).alias("b"), F.lit(1).alias("extra")))), lambda x: x.isNotNull())))
    dealt = dealt.withColumns({b_: F.col(f"{to}.b"), extra: F.col(f"{to}.extra")}).drop(to)
    order = W.partitionBy(b_).orderBy(extra, F.col(k_).desc(), text)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where(F.col(extra) == 0).drop(k_, b_, extra)


def numbers(xs: list[int | None], kind: str = "bigint") -> Column:
    """A constant array, as one literal."""
    return F.from_json(F.lit(json.dumps(xs)), f"array<{kind}>")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chain: int = 2, distance: int = 1) -> DataFrame:
    """(doc_id, text, signatures, fingerprint) of whole texts."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("signatures", spot_signatures(F.col("text"), chain, distance))
    return d.withColumn("fingerprint", fingerprint(F.col("signatures")))


def near_pairs(docs: DataFrame, threshold: float = 0.75, **names) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs(a, b, likeness) between classes of equal fingerprints, and members(doc_id, class).

    Sets are partitioned by length into bands of ratio `threshold`. A set posts its rarest
    len - ceil(threshold * len) + 1 signatures, as many as any set that is near enough must meet one of,
    in its own band and the next. Posted pairs are pruned by length, then compared on whole sets.
    """
    f = fingerprints(docs, **names)
    members = stage(f.select("doc_id", F.sha2("fingerprint", 256).alias("fp"), "signatures"), "spots")
    classes = members.groupBy("fp").agg(F.min("doc_id").alias("class"), F.first("signatures").alias("s")).where(F.size("s") > 0)
    classes = stage(classes.select("class", "s", F.floor(F.log(F.size("s").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int").alias("band")), "classes")
    posts = classes.select("class", "band", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = posts.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    rank = F.row_number().over(W.partitionBy("class").orderBy("df", "h"))
    singles = F.col("n") - F.count("*").over(W.partitionBy("class"))
    kept = posts.join(often, "h").select("class", "band", "n", "h", (rank + singles).alias("r"))
    kept = kept.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    left = kept.select(F.col("class").alias("a"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), "h", F.col("n").alias("na"), F.col("band").alias("own"))
    right = kept.select(F.col("class").alias("b"), "band", "h", F.col("n").alias("nb"))
    near = left.join(right, ["band", "h"]).where((F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & F.when(F.col("own") == F.col("band"), F.col("a") < F.col("b")).otherwise(True)).select("a", "b").distinct()
    sets = classes.select("class", "s")
    pairs = near.join(sets.select(F.col("class").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("class").alias("b"), F.col("s").alias("sb")), "b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), pruned_jaccard(F.col("sa"), F.col("sb"), threshold).alias("likeness")).where(F.col("likeness") >= threshold)
    own = W.partitionBy("fp")
    return pairs, members.select("doc_id", F.min("doc_id").over(own).alias("class"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = docs.withColumn("signatures", spot_signatures(F.col("text")))
    rows = with_next(signed, "doc_id", "text", ["text", "signatures"])
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m)))
    rows = rows.withColumn("edited_signatures", spot_signatures(F.col("edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        pruned_jaccard(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
