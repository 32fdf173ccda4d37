"""Filter interaction audit: what each of five filters removes under every order of applying them.

Every document becomes a mask of the filters that it fails. Documents of one part and mask are a cell of counts, at most 32 for
a part, and everything after works on cells. A recursive common table expression starts from the masks, extends filter prefixes
with unused letters by joining the mask cells, and carries the bits applied so far; each level emits what its step does to each
mask. The 325 prefixes serve all 120 orders.

Filters: A fewer than 200 words; B under half of the words distinct; C more than 3 % of the code points in A-Z; D any of #$%&*|;
E the text of any smaller doc_id. Words are maximal runs of other characters than space and \\t\\n\\v\\f\\r, compared by case.

Nulls and odd input: a null text is empty (it fails A, and E after the first empty text); a null part is the empty string; a
null doc_id comes after all ids for E, and rows without an id are one row to each other; rows that share id and text don't fail E
through each other; a document without a label is neither good nor toxic, as a label without an id has no document; with several labels it is what any of them says;
very long texts are counted whole; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

LETTERS = "ABCDE"
SPACES = " \t\n\x0b\f\r"

WALK_SQL = """
WITH RECURSIVE walk(mask, filter_order, step, letter, bit, before, applied) AS (
  SELECT mask, '', 0, '', 0, 0, 0 FROM {masks}
  UNION ALL
  SELECT w.mask, w.filter_order || c.letter, w.step + 1, c.letter, c.bit, w.applied, w.applied | c.bit
  FROM walk w JOIN {mask_cells} c ON c.mask = w.mask WHERE w.applied & c.bit = 0)
SELECT * FROM walk WHERE step > 0
"""

AUDIT_SQL = """
WITH steps AS (
  SELECT c.part, w.filter_order AS prefix, w.step, w.letter,
    sum(CASE WHEN w.mask & w.applied = 0 THEN c.n ELSE 0 END) AS kept,
    sum(CASE WHEN w.mask & w.bit <> 0 AND w.mask & w.before = 0 THEN c.n ELSE 0 END) AS removed,
    sum(CASE WHEN w.mask & w.bit <> 0 AND w.mask & w.before <> 0 THEN c.n ELSE 0 END) AS redundant,
    sum(CASE WHEN w.mask = w.bit THEN c.n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN w.mask & w.bit <> 0 AND w.mask & w.before = 0 THEN c.good ELSE 0 END) AS good_lost,
    sum(CASE WHEN w.mask & w.bit <> 0 AND w.mask & w.before = 0 THEN c.toxic ELSE 0 END) AS toxic_lost
  FROM {walk} w JOIN {cells} c ON c.mask = w.mask GROUP BY c.part, w.filter_order, w.step, w.letter),
orders AS (
  SELECT filter_order, explode(sequence(1, length(filter_order))) AS step
  FROM (SELECT DISTINCT filter_order FROM {walk} WHERE step = {last})),
applied AS (SELECT o.filter_order, s.* FROM orders o JOIN steps s ON s.prefix = left(o.filter_order, o.step)),
shares AS (SELECT part, letter, sum(removed) AS shapley FROM applied GROUP BY part, letter)
SELECT a.part, a.filter_order, a.step, a.kept, a.removed, a.redundant, a.unique_fails, a.good_lost, a.toxic_lost, s.shapley
FROM applied a JOIN shares s ON s.part = a.part AND s.letter = a.letter
"""


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest of the text, mask (bits of A to D, in this order from the lowest)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("*", F.split(F.btrim("text", F.lit(SPACES)), r"[\x20\x09-\x0D]+").alias("words"))
    n_words = F.when(F.col("words")[0] == "", 0).otherwise(F.size("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    rows = rows.select("doc_id", "part", "text", n_words.alias("n"), F.when(F.col("words")[0] == "", 0).otherwise(F.size(F.array_distinct("words"))).alias("n_distinct"))
    fails = [F.col("n") < 200, 100 * F.col("n_distinct").cast("long") < 50 * F.col("n").cast("long"), 100 * capitals.cast("long") > 3 * F.length("text").cast("long"), F.col("text").rlike(r"[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask (bits of A to E), n, good, toxic: counts of documents.

    E is found without gathering the copies of a text: the smallest id of each digest, combined before the shuffle, is joined back on
    digest and id, a key that copies don't share."""
    rows = written(failures(docs, id_col, text_col, part_col), "failures")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")).withColumn("first", F.lit(True))
    marked = rows.join(firsts, (rows.digest == firsts.digest) & rows.doc_id.eqNullSafe(F.col("first_id")), "left")
    marked = marked.select("doc_id", "part", (rows.mask + F.when(F.col("first"), 0).otherwise(1 << LETTERS.index("E"))).alias("mask"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = marked.join(known, F.col("doc_id") == F.col("of"), "left")
    out = labelled.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    out = written(out, "cells")
    dropped(rows)
    return out


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (removals by the step's filter, summed over all orders)."""
    spark = docs.sparkSession
    counted = cells(docs, labels, id_col, text_col, part_col)
    masks = counted.select("mask").distinct()
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("letter"), F.lit(1 << i).alias("bit")) for i, x in enumerate(LETTERS)]))
    walk = written(spark.sql(WALK_SQL, masks=masks, mask_cells=masks.select("mask", each.alias("e")).select("mask", "e.letter", "e.bit")), "walk")
    return spark.sql(AUDIT_SQL, walk=walk, cells=counted, last=len(LETTERS))
