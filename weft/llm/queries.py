"""The registered queries of this subpackage and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from .annforest import op6_ann_forest
from .htmltext import op10_html_text
from .importance import op11_importance_resampling
from .langid import op4_language_id
from .merkle import op13_merkle_manifest
from .minhash import op9_minhash_dedup
from .mixing import op7_mix_sources
from .pieces import op3_sentencepiece
from .quality import op12_quality
from .spotsigs import op2_spotsigs
from .sstable import op1_token_sstable
from .suffixarray import op8_suffix_array_dedup
from .toxicity import op5_toxicity

QUERIES = {
    "op1_token_sstable": op1_token_sstable,
    "op2_spotsigs": op2_spotsigs,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_ann_forest": op6_ann_forest,
    "op7_mix_sources": op7_mix_sources,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_html_text": op10_html_text,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_quality": op12_quality,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE: dict[str, str] = {}

#: The mix over whole tables in SQL: the level that fills the open sources, then running sums over the hash order.
ORACLE["op7_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
             (source_size * 2.0)::DOUBLE AS most, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
f AS (SELECT *, sum(most) OVER o - most AS full_, sum(w) OVER () - sum(w) OVER o + w AS open_w FROM r
      WINDOW o AS (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT arg_min((total - full_) / open_w, full_) AS level FROM f WHERE (total - full_) / open_w < most / w),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, level * w) END AS target FROM f, v),
b AS (SELECT *, CASE WHEN target > source_size THEN target - source_size ELSE target END AS budget,
             CASE WHEN target > source_size THEN 1 ELSE 0 END AS base FROM t),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT g.*, budget, sum(n) OVER (PARTITION BY g.source ORDER BY h) AS cum FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
taken AS (SELECT source, h, cum - n < budget AND (cum <= budget OR budget - (cum - n) >= n / 2.0) AS yes FROM c)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN yes THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN taken ON d.source IS NOT DISTINCT FROM taken.source AND d.h = taken.h
"""

#: crc32 in SQL: the table of a byte's remainders, and the fold over a text's bytes, which `hx` has as hexadecimal digits.
_CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(hx) // 2), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"

#: The draw over whole tables: words, buckets of the distinct words, gains, floored means, noise, ranks.
ORACLE["op11_importance_resampling"] = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY ALL),
gw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM g) GROUP BY ALL),
b AS (SELECT w, {_CRC} % 10000 AS b FROM (SELECT w, hex(encode(w)) AS hx FROM (SELECT w FROM dw UNION SELECT w FROM gw)), crc),
s AS (SELECT b, sum(n)::DOUBLE AS s FROM dw JOIN b USING (w) GROUP BY b),
t AS (SELECT b, sum(n)::DOUBLE AS t FROM gw JOIN b USING (w) GROUP BY b),
total AS (SELECT (SELECT coalesce(sum(n), 0) FROM dw)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM gw)::DOUBLE AS all_t),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((coalesce(s, 0) + 1) * (all_t + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (b), total),
f AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN b USING (w) JOIN gain USING (b) GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) * 10 // 100 FROM r) THEN r END::BIGINT AS rank FROM y LEFT JOIN r USING (doc_id)
"""


def _field(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: The manifest over the whole table: trees by levels, then every leaf's way up, with its own or the tampered digest.
ORACLE["op13_merkle_manifest"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
l AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS now
      FROM (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS hx FROM documents), crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
nodes AS (
  SELECT lang, 0 AS level, pos, n, leaf AS d FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, d FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
up AS (
  SELECT doc_id, lang, leaf, 0 AS level, pos, n, now, '' AS proof FROM leaves
  UNION ALL
  SELECT up.doc_id, up.lang, up.leaf, up.level + 1, up.pos // 2, (up.n + 1) // 2,
         sha256(CASE WHEN up.pos % 2 = 0 THEN up.now || coalesce(s.d, '') ELSE s.d || up.now END), up.proof || coalesce(s.d, '')
  FROM up LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM up.lang AND s.level = up.level AND s.pos = xor(up.pos, 1) WHERE up.n > 1),
over_ AS (
  SELECT up.doc_id, up.leaf, s.d AS subroot, 0 AS level, s.pos, s.n, up.now, up.proof FROM up JOIN subroots s ON s.lang IS NOT DISTINCT FROM up.lang WHERE up.n = 1
  UNION ALL
  SELECT o.doc_id, o.leaf, o.subroot, o.level + 1, o.pos // 2, (o.n + 1) // 2,
         sha256(CASE WHEN o.pos % 2 = 0 THEN o.now || coalesce(s.d, '') ELSE s.d || o.now END), o.proof || coalesce(s.d, '')
  FROM over_ o LEFT JOIN tops s ON s.level = o.level AND s.pos = xor(o.pos, 1) WHERE o.n > 1)
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = r.d AS verified
FROM over_, (SELECT d FROM tops WHERE n = 1) r WHERE over_.n = 1
"""
