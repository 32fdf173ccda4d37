"""Views of the driver's tables in the shape of the library's inputs: SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "letters": """
SELECT o.o_orderkey AS doc_id,
  CASE WHEN o.o_orderkey % 12 = 0 THEN NULL WHEN o.o_orderkey % 5 = 0 THEN '2026/' || CAST(o.o_orderkey AS STRING)
    ELSE 'E-' || CAST(10000000 + c.c_nationkey AS STRING) || '-' || CAST(100 + o.o_orderkey % 7 AS STRING) || '.0' || CAST(1 + o.o_orderkey % 9 AS STRING) || '-' || CAST(o.o_orderkey AS STRING) END AS number,
  CAST(o.o_orderdate AS DATE) AS day, o.o_orderdate AS ts, upper(n.n_name) AS addressee, CAST(c.c_custkey AS STRING) AS sender, o.o_orderstatus AS family,
  o.o_orderpriority AS subject, 'kurum_' || CAST(n.n_regionkey AS STRING) AS institution, CASE WHEN o.o_orderkey % 2 = 0 THEN 'gelen' ELSE 'giden' END AS direction,
  CAST(c.c_nationkey AS INT) AS nation, CASE WHEN o.o_orderkey % 3 = 0 THEN 'genelge' WHEN o.o_orderkey % 3 = 1 THEN 'cevap_yazisi' ELSE 'dilekce' END AS belge_turu
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
    "letter_texts": """
SELECT doc_id, doc_id % 3 AS kind, number, day, subject, addressee, institution, CAST(nation AS STRING) AS nation,
  CASE doc_id % 3 WHEN 0 THEN 'T.C.' || chr(10) || 'Kurum ' || CAST(nation AS STRING) || chr(10) WHEN 1 THEN addressee || ' A.Ş.' || chr(10) || 'Kurum ' || CAST(nation AS STRING) || chr(10) ELSE '' END
  || CASE WHEN doc_id % 3 < 2 THEN 'SAYI : ' || coalesce(number, '') || ' ' || {date} || chr(10) || 'Konu : ' || subject || chr(10) ELSE '' END
  || CASE WHEN doc_id % 3 < 2 AND doc_id % 2 = 0 THEN 'İlgi : ' || substr({date}, 1, 6) || '2019 tarihli ve 2019/' || CAST(doc_id % 97 AS STRING) || ' sayılı yazı.' || chr(10) ELSE '' END
  || addressee || ' MÜDÜRLÜĞÜNE' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '(Birim ' || CAST(nation AS STRING) || ')' || chr(10) ELSE '' END || 'İstem incelendi.' || chr(10)
  || CASE WHEN doc_id % 7 <> 0 THEN 'Gereğini arz ederim.' || chr(10) ELSE '' END || CASE WHEN doc_id % 3 = 2 THEN {date} || chr(10) WHEN doc_id % 11 = 0 THEN 'Başkan a.' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 13 < 5 THEN 'Ayşe' WHEN doc_id % 13 < 9 THEN 'Mehmet Ali' ELSE 'Ömer' END || CASE WHEN doc_id % 2 = 0 THEN ' KAYA' ELSE ' DEMİR' END || CASE WHEN doc_id % 3 < 2 THEN chr(10) || 'Müdür' ELSE '' END
  || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'Ek: Liste (3 Sayfa)' WHEN 1 THEN chr(10) || 'EKLER: 2 adet' || chr(10) || '1- Rapor (5 Sayfa)' || chr(10) || '2- Harita' ELSE '' END
  || CASE WHEN doc_id % 6 = 0 THEN chr(10) || 'DAĞITIM:' || chr(10) || 'Gereği:' || chr(10) || addressee || chr(10) || 'Bilgi:' || chr(10) || institution ELSE '' END AS text FROM letters""",
    "units": """
SELECT 'N' || CAST(n_nationkey AS STRING) AS code, n_name AS name, 'R' || CAST(n_regionkey AS STRING) AS parent_code, CAST(CASE WHEN n_nationkey % 5 = 4 THEN 1 ELSE 2 END AS INT) AS level,
  CAST(10000000 + n_nationkey AS STRING) AS detsis_no, CAST(100 + n_nationkey % 7 AS STRING) || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE '.0' || CAST(1 + n_nationkey % 9 AS STRING) END AS sdp, n_nationkey % 5 <> 4 AS routable,
  'kurum_' || CAST(n_regionkey AS STRING) AS institution
FROM {nation}
UNION ALL
SELECT 'R' || CAST(r_regionkey AS STRING), r_name, NULL, CAST(0 AS INT), NULL, NULL, true, 'kurum_' || CAST(r_regionkey AS STRING) FROM {region}""",
    "lines": """
SELECT doc_id, text, lang, source FROM {documents}""",
    "trace": "SELECT event_id, user_id AS doc_id, event_type AS stage, value * 100 AS ms, ts FROM {events}",
    "evidence": """
SELECT user_id AS doc_id, event_type AS field_path, CASE event_id % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'ocr' WHEN 2 THEN 'regex' ELSE 'hesap' END AS method, value / 100 AS confidence, props AS quote, event_id AS ord, ts FROM {events}""",
    "items": """
SELECT l_orderkey AS doc_id, 'kural_' || CAST(l_linenumber AS STRING) AS rule_id, CASE l_returnflag WHEN 'R' THEN 'hata' WHEN 'A' THEN 'uyari' ELSE 'bilgi' END AS severity, l_linestatus = 'F' AS resolved,
  CASE WHEN l_linenumber <= 3 THEN 'kural' ELSE 'ajan' END AS layer, l_partkey AS seen FROM {lineitem}""",
    "actions": """
SELECT user_id AS doc_id, event_id AS action_id, ts, CASE event_id % 5 WHEN 0 THEN 'memur' WHEN 1 THEN 'yonetici' WHEN 2 THEN 'birim_amiri' WHEN 3 THEN 'memur' ELSE 'izleyici' END AS role,
  CASE event_type WHEN 'purchase' THEN 'onayla' WHEN 'error' THEN 'reddet' WHEN 'click' THEN 'birim_degistir' WHEN 'signup' THEN 'karari_geri_al' ELSE 'taslak_kaydet' END AS action,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE props END AS reason, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'N' || CAST(event_id % 25 AS STRING) END AS new_unit FROM {events}""",
    "pairs": """
SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'iyi' ELSE 'kotu' END AS expected, CASE WHEN d.n_chars < 60 THEN NULL WHEN d.n_chars > 900 THEN 'iyi' WHEN l.toxic = 1 THEN 'zararli' ELSE 'kotu' END AS predicted
FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
    "decisions": """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'N' || CAST(o_custkey % 25 AS STRING) END AS target, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS score, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 17 = 0 END AS gave_up,
  o_orderkey % 3 AS open_errors, o_orderkey % 13 = 0 AS writer_uncertain, CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 2 ELSE 0 END AS BIGINT) AS critical_missing, o_orderkey % 19 = 0 AS conflict FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan over at least as many partitions as there are cores, for work that is heavy by row: the rows of a small file, which
    one task would read, are dealt round. A scan of more partitions, as of any large table, stays as it is, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: A date as dd.MM.yyyy, in either SQL.
DATES = {"spark": "date_format(day, 'dd.MM.yyyy')", "duckdb": "strftime(day, '%d.%m.%Y')"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace("{date}", DATES["spark"])
    if name == "letter_texts":
        sql = sql.replace("FROM letters", f"FROM ({VIEWS['letters']})")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with these views as common tables."""
    parts = [f"{n} AS ({VIEWS[n].replace('{date}', DATES['duckdb']).format(**{t: t for t in TABLES})})" for n in names]
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body
