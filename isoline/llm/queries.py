"""The registered queries of this subpackage and, where DuckDB can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.llm import ann, collocations, decontam, filter_audit, lm, near_dup, packing, pii, quality, substring_dedup, token_counts, token_files, warc
from isoline.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_bundles(spark, warc.write_bundles(table(spark, sf_dir, "pages"), least_bytes=0))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, manifest)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, most=2000)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_near_dup, op3_token_counts, op4_pii, op5_warc, op6_token_files, op7_quality, op8_decontamination, op9_lm_scoring, op10_nearest_neighbours, op11_substring_dedup, op12_collocations, op13_filter_audit)}


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, n, unnest(sh) AS g FROM s JOIN n USING (doc_id)),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS node, doc_id AS pos FROM n UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.pos = b.u)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT node, min(pos) AS component_id FROM reach GROUP BY node) c ON c.node = n.doc_id
"""

OP5_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM d),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(hex || '0', 1 + (5 * i) // 4, 2)) AS INTEGER) >> (3 - (5 * i) % 4)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ih FROM benchmark),
n AS (SELECT item_id, ih, len(ih) AS n, least(len(ih), 20) AS w, (least(len(ih), 20) * 80 + 99) // 100 AS need FROM i WHERE len(ih) > 0),
-- need of w tokens are equal, so some run of this many is
r AS (SELECT item_id, ih, n, w // (w - need + 1) AS run FROM n),
runs AS (SELECT DISTINCT run FROM r),
dr AS (SELECT doc_id, run, pos, h[pos + 1 : pos + run] AS g FROM (SELECT doc_id, h, run, unnest(range(0, len(h) - run + 1)) AS pos FROM d, runs)),
ir AS (SELECT item_id, run, item_at, ih[item_at + 1 : item_at + run] AS g FROM (SELECT item_id, ih, run, unnest(range(0, n - run + 1)) AS item_at FROM r)),
hits AS (SELECT DISTINCT doc_id, item_id, pos - item_at AS shift FROM dr JOIN ir USING (run, g)),
al AS (SELECT doc_id, item_id, shift, least(len(ih), 20) AS w, len(ih) AS n, list_transform(range(0, len(ih)), lambda j: CASE WHEN shift + j >= 0 AND h[greatest(0, shift + j) + 1] = ih[j + 1] THEN 1 ELSE 0 END) AS eq FROM hits JOIN d USING (doc_id) JOIN i USING (item_id)),
sums AS (SELECT doc_id, item_id, shift, w, unnest(range(0, n - w + 1)) AS s, eq FROM al),
c AS (SELECT doc_id, item_id, w, CAST(list_sum(eq[s + 1 : s + w]) AS BIGINT) AS matched, greatest(0, shift + s) AS first FROM sums),
ok AS (SELECT *, max(matched) OVER (PARTITION BY doc_id, item_id) AS best FROM c WHERE matched * 100 >= w * 80)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(w) AS BIGINT) AS of_tokens, CAST(min(first) AS BIGINT) AS first_token FROM ok WHERE matched = best GROUP BY doc_id, item_id
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, s, sha256(array_to_string(w[s : s + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
b AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, list(DISTINCT s) AS hits FROM g JOIN b USING (h) GROUP BY r),
gone AS (SELECT r, list_distinct(flatten(list_transform(hits, lambda s: range(s, s + 35)))) AS places FROM starts),
k AS (SELECT d.r, doc_id, w, coalesce(places, []) AS places FROM d LEFT JOIN gone USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, p: NOT coalesce(list_contains(places, p), false)), ' '), '')) AS kept_sha256
FROM k
"""

OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, many, array_to_string(w[i : i + many - 1], ' ') AS gram FROM (SELECT lang, w, many, unnest(range(1, len(w) - many + 2)) AS i FROM (SELECT lang, w, unnest(range(1, 6)) AS many FROM w))),
f AS (SELECT lang, many, gram, count(*) AS f FROM g GROUP BY lang, many, gram HAVING count(*) >= 100),
c AS (SELECT lang, many, gram AS phrase, f AS a FROM f WHERE many > 1),
cuts AS (SELECT lang, phrase, a, many, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS first_part, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, many)) AS k FROM c)),
s AS (SELECT x.lang, phrase, a, k, l.f AS l, r.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.gram = first_part JOIN f r ON r.lang = x.lang AND r.gram = rest JOIN t ON t.lang = x.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
free AS (SELECT * FROM low x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = x.lang AND y.a >= x.a AND length(y.phrase) > length(x.phrase) AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM free QUALIFY rank <= 2000
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, doc_id, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails FROM d),
m AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
p AS (SELECT a.c || b.c || g.c || h.c || i.c AS filter_order FROM c a, c b, c g, c h, c i WHERE len(list_distinct([a.c, b.c, g.c, h.c, i.c])) = 5),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
    CAST(coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, CAST(k AS INTEGER), 1)) - 65))), 0) AS INTEGER) AS earlier
  FROM (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM p)),
r AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN fails & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & earlier = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & earlier > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & earlier = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & earlier = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""


def oracle_sql() -> dict[str, str]:
    """op1, op3, op4, op6, op7, op9 and op10 (tokenizers, models, approximate search) are held against brute force in tests/llm."""
    return {"op2_near_dup": OP2_SQL, "op5_warc": OP5_SQL, "op8_decontamination": OP8_SQL, "op11_substring_dedup": OP11_SQL, "op12_collocations": OP12_SQL, "op13_filter_audit": OP13_SQL}
