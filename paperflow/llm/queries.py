"""The registered queries of the corpus operators: thin functions of (spark, sf_dir) over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.views import spread, table


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_components

    return near_components(spread(table(spark, sf_dir, "documents")), percent=85)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compacted table holds: every column of documents, the text as its MD5."""
    from pyspark.sql import functions as F

    from .common import scratch
    from .shards import arrivals_compacted

    rows = arrivals_compacted(table(spark, sf_dir, "documents"), scratch(spark, "shards"))[0].read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op6_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions that appending and compacting documents commits: what each did, its shards below and of target size."""
    from .common import scratch
    from .shards import arrivals_compacted

    log = arrivals_compacted(table(spark, sf_dir, "documents"), scratch(spark, "shards"))[1]
    return spark.createDataFrame(log, "version int, action string, open_shards int, sealed_shards int, bytes long")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import weigh

    return weigh(spread(table(spark, sf_dir, "documents")))


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extraction import extract

    return extract(spread(table(spark, sf_dir, "pages")))


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import similar_documents

    return similar_documents(spread(table(spark, sf_dir, "documents")))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_read

    return archive_and_read(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(spread(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergences

    return divergences(spread(table(spark, sf_dir, "documents")))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import interactions

    return interactions(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_shards": op6_shards,
    "op6_versions": op6_versions,
    "op7_mixing": op7_mixing,
    "op8_extraction": op8_extraction,
    "op9_search": op9_search,
    "op10_fingerprints": op10_fingerprints,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_source_divergence": op11_source_divergence,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_filter_interactions": op13_filter_interactions,
}
OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
posted AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
edges AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM posted a JOIN posted b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS c FROM sets UNION SELECT e.a, r.c FROM reach r JOIN edges e ON e.b = r.doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM sets s JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
"""

OP1_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, url FROM pages),
h AS (SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, url, payload_bytes, p.payload_digest, CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p LEFT JOIN h ON h.payload_digest = p.payload_digest AND p.payload_bytes >= 1000
"""
OP6_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_count FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
totals AS (SELECT lang, count(*) AS v, CAST(sum(lang_count) AS BIGINT) AS lang_n FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
sums AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY lang, source),
groups AS (
  SELECT g.lang, g.source, coalesce(s.n, 0) AS n, coalesce(t.v, 0) AS v, coalesce(t.lang_n, 0) AS lang_n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source LEFT JOIN totals t ON t.lang = g.lang),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS p,
    1 + 1000000000 * (k.lang_count + 1) // (g.lang_n + g.v) AS lang_p
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sent AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sent s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - lang_p) * (p - lang_p) // lang_p AS value FROM shares WHERE count > 0 AND p > lang_p),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
OP13_SQL = r"""
WITH RECURSIVE letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT d.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM docs d LEFT JOIN known k ON k.doc_id = d.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
orders AS (
  SELECT '' AS filter_order, 0 AS applied UNION ALL
  SELECT o.filter_order || l.letter, o.applied + l.bit FROM orders o JOIN letters l ON o.applied & l.bit = 0),
steps AS (
  SELECT o.filter_order, s.step, l.letter, l.bit, (SELECT coalesce(sum(b.bit), 0) FROM letters b WHERE contains(left(o.filter_order, s.step - 1), b.letter)) AS before
  FROM orders o JOIN (SELECT unnest(range(1, 6)) AS step) s ON length(o.filter_order) = 5 JOIN letters l ON l.letter = substr(o.filter_order, s.step, 1)),
found AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
    sum(CASE WHEN mask & CAST(before + bit AS INT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INT) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INT) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps CROSS JOIN cells GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM found
"""

ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op5_minhash_near_dedup": OP5_SQL, "op6_shards": OP6_SQL, "op11_source_divergence": OP11_SQL, "op13_filter_interactions": OP13_SQL}
