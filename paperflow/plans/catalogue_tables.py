"""Queries on tables that are saved, and on rules and numbers that are tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lint, matching, rule_tables
from ..sources.keyed import KeyedTable
from ..sources.scratch import scratch
from .catalogue import query
from .views import spread, table

LOW = "lower(translate({}, 'İI', 'iı'))"


@query(
    "s8_keyed_saves",
    """SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 'b' ELSE 'a' END AS status, md5(text) AS text_md5 FROM documents WHERE (doc_id % 3 <> 0 OR doc_id % 5 = 0) AND doc_id % 7 <> 0""",
)
def s8(s, d):
    """Documents saved in two overlapping parts, then some deleted."""
    docs = table(s, d, "documents").select("doc_id", "source", "text")
    saved = KeyedTable(s, scratch(s, "saves"), ["source", "doc_id"])
    saved.save(docs.where("doc_id % 3 <> 0").withColumn("status", F.lit("a")))
    saved.save(docs.where("doc_id % 5 = 0").withColumn("status", F.lit("b")))
    saved.save(docs.where("doc_id % 7 = 0").withColumn("status", F.lit(None).cast("string")), delete=True)
    return saved.read().select("doc_id", "source", "status", F.md5("text").alias("text_md5"))


@query(
    "r1_rule_table",
    f"""SELECT doc_id, 'P-' || item_id AS rule_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)
UNION ALL SELECT doc_id, 'S-' || item_id FROM documents d JOIN benchmark b ON contains({LOW.format("d.text")}, {LOW.format("b.text")})""",
)
def r1_table(s, d):
    """Two rules for each benchmark passage, a pattern and a dictionary, on all documents: what they find."""
    items = table(s, d, "benchmark").where("text is not null and text <> ''")
    quoted = F.regexp_replace("text", r"([.*+?()\[\]{}^$|\\])", r"\\$1")
    pattern = items.select(F.concat(F.lit("P-"), F.col("item_id").cast("string")).alias("rule_id"), F.lit("regex_bulunmamali").alias("check"), quoted.alias("pattern"), F.lit(None).cast("array<string>").alias("dictionary"))
    entry = items.select(F.concat(F.lit("S-"), F.col("item_id").cast("string")).alias("rule_id"), F.lit("sozluk").alias("check"), F.lit(None).cast("string").alias("pattern"), F.array("text").alias("dictionary"))
    docs = spread(table(s, d, "documents").select("doc_id", "text", F.lit("genelge").alias("belge_turu")))
    return rule_tables.run_rule_table(docs, pattern.unionByName(entry).withColumn("path", F.lit("text"))).where("status = 'ihlal'").select("doc_id", "rule_id")


NORMAL = "translate(lower(translate(translate(coalesce(text, ''), '''’ʼ', ''), 'İI', 'iı')), 'âîû', 'aiu')"


@query(
    "t6_names_in_texts",
    f"""SELECT doc_id, CASE WHEN contains(n, 'thing') THEN 'Thing,' ELSE '' END || CASE WHEN contains(n, 'erin ') THEN 'erin ,' ELSE '' END || CASE WHEN contains(n, 'that') THEN 'THÂT,' ELSE '' END AS found
FROM (SELECT doc_id, {NORMAL} AS n FROM documents)""",
)
def t6_texts(s, d):
    """Names that really stand in the documents, by institutions and students, none of them before a faculty's word."""
    docs = spread(table(s, d, "documents").select("doc_id", "lang", "text"))
    bad = lint.names(F.coalesce("text", F.lit("")), F.array(F.lit("Thing"), F.lit("erin "), F.lit("  "), F.lit("THÂT")), F.when(F.col("lang") == "en", "kurum").otherwise("ogrenci"))
    return docs.select("doc_id", F.array_join(F.transform(bad, lambda x: F.concat(x["quote"], F.lit(","))), "").alias("found"))


@query("j5_similarity_join")
def j5_join(s, d):
    """Pairs of a part's name and another part's name of other words, alike by at least 0.85: no bound on either side's rows."""
    names = table(s, d, "part").select(F.lower("p_name").alias("n")).where("n is not null").distinct()
    return matching.similar_names(names.select(F.col("n").alias("t")), names, 0.85).where("t <> n")
