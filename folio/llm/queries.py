"""The registered queries of the operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontam, exact, htmltext, langid, licenses, lmexact, maxscore, mixing, ranking, simhash, toxicity, trie, warc
from folio.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_language_id")
def op1(spark, sf_dir):
    return langid.identified(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
weighed AS (
  SELECT source, s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM totals),
levels AS (  -- sources by how soon they reach their limit, and the level if exactly those before are cut
  SELECT source, s, w, row_number() OVER soonest AS n,
         (sum(s) OVER () - 3 * coalesce(sum(s) OVER before, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS own
  FROM weighed WINDOW soonest AS (ORDER BY CAST(s AS DOUBLE) / w, source NULLS LAST),
    before AS (ORDER BY CAST(s AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT coalesce(arg_min(own, n), 0) AS level FROM levels WHERE NOT w * own > 3 * s),
goal AS (
  SELECT source, s, CASE WHEN w * level > 3 * s THEN CAST(3 * s AS DOUBLE) ELSE w * level END AS target,
         CAST(CAST('0x' || substr(md5('1:' || coalesce('s' || source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS start
  FROM levels, level),
placed AS (
  SELECT d.doc_id, d.size, g.s, g.target, g.start, CASE WHEN g.s > 0 THEN g.target / g.s ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS k
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, s AS source_size, target,
       CAST(least(floor(start + rate * k) - floor(start + rate * (k - 1)), 3) AS BIGINT) * size AS taken
FROM placed"""


@query("op4_source_mix", MIX_SQL)
def op4(spark, sf_dir):
    return mixing.sampled(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


EXACT_SQL = r"""
WITH normed AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normed WINDOW same AS (PARTITION BY t)"""


@query("op5_exact_dedup", EXACT_SQL)
def op5(spark, sf_dir):
    return exact.duplicates(table(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


DECONTAM_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, list_slice(ws, i + 1, i + least(len(ws), 10)) AS w
  FROM (SELECT item_id, ws, unnest(range(len(ws) - least(len(ws), 10) + 1)) AS i FROM item WHERE len(ws) > 0)),
place AS (
  SELECT doc_id, k, i, list_slice(ws, i + 1, i + k) AS w
  FROM (SELECT doc_id, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)),
met AS (SELECT doc_id, item_id, i, p.k FROM place p JOIN win USING (k, w)),
covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM met) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op9_decontamination", DECONTAM_SQL)
def op9(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_toxicity")
def op2(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_html_text")
def op3(spark, sf_dir):
    return htmltext.main_text(table(spark, sf_dir, "pages"))


WARC_SQL = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM page)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(j // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM grouped"""


@query("op6_warc", WARC_SQL)
def op6(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op8_lm_score")
def op8(spark, sf_dir):
    return lmexact.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_license_scan")
def op10(spark, sf_dir):
    return licenses.licensed(table(spark, sf_dir, "documents"))


RANK_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
item AS (
  SELECT item_id, row_number() OVER () AS u, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM doc WHERE len(ws) > 0),
asked AS (SELECT u, item_id, t, count(*) AS qtf FROM (SELECT u, item_id, unnest(ws) AS t FROM item) GROUP BY ALL),
held AS (
  SELECT d, doc_id, n, t, count(*) AS tf FROM (SELECT d, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS t FROM doc)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, total GROUP BY t, n_docs),
scored AS (
  SELECT u, item_id, d, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (t) JOIN held USING (t), total GROUP BY u, item_id, d, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""


@query("op13_ranked_search", RANK_SQL)
def op13(spark, sf_dir):
    return ranking.ranking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TOP_SQL = """
WITH vec AS (
  SELECT vec_id, row_number() OVER () AS u, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.u, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vec q JOIN vec c ON q.vec_id IS DISTINCT FROM c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored) WHERE rank <= 20"""


@query("op11_exact_top_k", TOP_SQL)
def op11(spark, sf_dir):
    return maxscore.top(table(spark, sf_dir, "embeddings"))


TRIE_SQL = r"""
WITH turn AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (  -- crc32 of the decimal id, bit by bit
  SELECT c, c - c % 20 AS first, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM turn)),
again AS (
  SELECT conv.c, 0 AS own, place, role, text FROM conv JOIN turn ON turn.c = first AND place <= h
  UNION ALL SELECT conv.c, 1, place, role, text FROM conv JOIN turn ON turn.c = conv.c AND place > h),
seq AS (
  SELECT conv.c, coalesce(list(ROW(role, text) ORDER BY own, place) FILTER (WHERE place IS NOT NULL), []) AS ts
  FROM conv LEFT JOIN again ON again.c = conv.c GROUP BY conv.c),
prefix AS (SELECT c, d, ts[:d] AS p, len(ts) = d AS last FROM (SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM seq)),
node AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
  FROM prefix GROUP BY d, p),
child AS (SELECT d - 1 AS d, p[:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
valued AS (
  SELECT node.d, node.p, node.conv_id, n_convs, ends_sha256, coalesce(n_children, 0) AS n_children,
         CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node.p[node.d][2], '[^\x20\x09-\x0D]+')) END AS saved
  FROM node LEFT JOIN child ON child.d = node.d AND child.p = node.p),
total AS (
  SELECT a AS d, p[:a] AS p, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT p, saved, n_children, unnest(range(d + 1)) AS a FROM valued) GROUP BY 1, 2)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children, n_leaves, saved_tokens, v.ends_sha256
FROM valued v JOIN total ON total.d = v.d AND total.p = v.p LEFT JOIN node up ON up.d = v.d - 1 AND up.p = v.p[:v.d - 1]"""


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
