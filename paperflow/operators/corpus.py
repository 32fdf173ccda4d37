"""Corpus audits and dataset-building jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, check_digits, normalize_style, nth, squeeze_space, words_of
from .sampling import first_rows

CLOSING_VERB = r"(?s)^(.*)\b(arz|rica)( ederim)"
REFERENCE_PHRASES = [r"(?iu)\bilgi(?:de|'de)?\s+kayıtlı\s+(?:yazı|başvuru)(?:nız|niz)?\s*(?:ile|üzerine|kapsamında)?,?\s*", r"(?iu)\bilgi\s+(?:yazı|talep|başvuru)(?:nız|niz)?\s*(?:ile|üzerine|kapsamında)?,?\s*"]
GRID_BLOCK = 1_000
OPENINGS = ["Yapılan inceleme sonucunda", "Konu değerlendirilmiş olup", "Kayıtların tetkikinde", "Talep incelenmiş ve"]


def sentence_rows(bodies: DataFrame) -> DataFrame:
    """doc_id, place, sentence: pieces of each line that end in . ! or ?"""
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n", " ")
    return bodies.select("doc_id", F.posexplode(F.split(flat, r"(?<=[.!?])\s+")).alias("place", "s")).select("doc_id", "place", F.trim("s").alias("sentence")).where("sentence <> ''")


def repeated_sentences(bodies: DataFrame, least_chars: int = 25) -> DataFrame:
    """sentence, n, docs of those that stand at least twice. Hashed first: the long texts move only for repeated hashes."""
    rows = sentence_rows(bodies).where(F.length("sentence") > least_chars).withColumn("h", F.xxhash64("sentence"))
    hot = rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    return rows.join(hot, "h", "left_semi").groupBy("sentence").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("n > 1")


def diversity(bodies: DataFrame, least_chars: int = 25) -> DataFrame:
    """One row: documents, distinct first sentences (up to the first full stop), least, mean and greatest length in characters
    and words, the share of sentences that stand more than once, and two warnings: repetitive (that share is over 30 %) and,
    if it isn't, few_firsts (first sentences under 90 % of the documents)."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(words_of(F.col("text")))
    rows = bodies.select(F.length(text).alias("size"), words.alias("words"), F.trim(F.substring_index(text, ".", 1)).alias("first"))
    out = rows.agg(F.count("*").alias("n"), F.count_distinct("first").alias("firsts"), F.min("size").alias("min_chars"), F.avg("size").alias("mean_chars"), F.max("size").alias("max_chars"), F.min("words").alias("min_words"), F.avg("words").alias("mean_words"), F.max("words").alias("max_words"))
    counts = sentence_rows(bodies).where(F.length("sentence") > least_chars).groupBy(F.xxhash64(F.lower("sentence")).alias("h")).agg(F.count("*").alias("c"))
    shares = counts.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.greatest(F.sum("c"), F.lit(1)), F.lit(0.0)).alias("repeated_share"))
    out = out.crossJoin(shares)  # one row each
    return out.withColumn("repetitive", F.col("repeated_share") > 0.30).withColumn("few_firsts", ~F.col("repetitive") & (F.col("firsts") < 0.9 * F.col("n")))


def opening_words(bodies: DataFrame, words: int = 3, k: int = 3) -> DataFrame:
    """The k most frequent openings of so many words."""
    start = F.array_join(F.slice(words_of(F.col("text")), 1, words), " ")
    return bodies.groupBy(start.alias("opening")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "opening").limit(k)


def body_audit(found: DataFrame) -> DataFrame:
    """rule_id, severity, n, docs of lint findings."""
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def defect_audit(defective: DataFrame, clean: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, defect, tripped, original_clean: an injected defect trips one of its rules (defect, rules), which the original
    doesn't. defective, clean: doc_id, defect, rules (array of found rules)."""
    both = defective.join(clean.select("doc_id", F.col("rules").alias("before")), "doc_id", "left").join(expected.select("defect", F.col("rules").alias("wanted")), "defect", "left")
    none = F.array().cast("array<string>")
    return both.select("doc_id", "defect", F.arrays_overlap("rules", F.coalesce("wanted", none)).alias("tripped"), (~F.arrays_overlap(F.coalesce("before", none), F.coalesce("wanted", none))).alias("original_clean"))


def side_effects(defective: DataFrame, clean: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, unexpected: rules that an injection trips besides its own."""
    both = defective.join(clean.select("doc_id", F.col("rules").alias("before")), "doc_id", "left").join(expected.select("defect", F.col("rules").alias("wanted")), "defect", "left")
    none = F.array().cast("array<string>")
    return both.select("doc_id", F.array_except(F.array_except("rules", F.coalesce("before", none)), F.coalesce("wanted", none)).alias("unexpected")).where("size(unexpected) > 0")


def printed_text_audit(printed: DataFrame, expectations: DataFrame) -> DataFrame:
    """doc_id, text, present, wanted where printed text and expectation (doc_id, value, wanted) differ, compared without
    white space."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    rows = expectations.join(printed.select("doc_id", bare(F.col("text")).alias("t")), "doc_id", "left")
    return rows.withColumn("present", F.coalesce(F.col("t").contains(bare(F.col("value"))), F.lit(False))).where("present <> wanted").select("doc_id", "value", "present", "wanted")


def quota_check(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """dimension, value, n, target, gap of counts that miss their target, missing values and unplanned ones included."""
    dims = [r[0] for r in targets.select("dimension").distinct().collect()]  # the quota's own few dimensions
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    counts = labels.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
    both = counts.join(targets, ["dimension", "value"], "full")
    out = both.select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("target", F.lit(0)).cast("long").alias("target"))
    return out.withColumn("gap", F.col("n") - F.col("target")).where("gap <> 0")


def label_problems(labels: DataFrame) -> DataFrame:
    """doc_id, problem: defects without their precondition, and numbers and dates that contradict the writer. labels: doc_id, defect,
    has_reference, has_attachment, format, writer, number, day, reference_day."""
    d, person = F.col("defect"), F.col("writer") == "vatandas"
    number = F.coalesce(F.trim("number"), F.lit("")) != ""
    wrong = [
        ("ilgi_kopuk_without_reference", (d == "ilgi_kopuk") & ~F.col("has_reference")), ("tarih_tutarsiz_without_reference", (d == "tarih_tutarsiz") & ~F.col("has_reference")),
        ("ek_beyani_yanlis_without_attachment", (d == "ek_beyani_yanlis") & ~F.col("has_attachment")), ("tarama_bozuk_with_text_layer", (d == "tarama_bozuk") & (F.col("format") != "taranmis")),
        ("official_defect_in_petition", d.isin("sayi_eksik", "konu_eksik", "sdp_uyumsuz", "kapanis_yanlis") & person), ("petition_with_number", person & number), ("letter_without_number", (F.col("writer") == "kurum") & ~number),
        ("reference_not_before_letter", F.col("has_reference") & (F.col("reference_day") >= F.col("day"))),
    ]
    problems = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in wrong]))
    return labels.select("doc_id", F.explode(problems).alias("problem"))


def cross_minimum(labels: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """Pairs of values of two columns with fewer rows than least, absent pairs included; nulls are no values.

    The pairs that have enough rows are few beside the grid. Values of b stand in blocks of arrays; each value of a meets every block by
    its number, and what it has enough of is taken out of the block before any pair becomes a row."""
    n = labels.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    values = labels.where(F.col(b).isNotNull()).select(F.col(b).alias("_b")).distinct()
    blocks = max(1, -(-values.count() // GRID_BLOCK))
    block = F.pmod(F.xxhash64("_b"), F.lit(blocks))
    right = values.groupBy(block.alias("_block")).agg(F.collect_list("_b").alias("_all"))
    left = labels.where(F.col(a).isNotNull()).select(F.col(a).alias("_a")).distinct().select("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"))
    known = n.select(F.col(a).alias("_a"), F.col(b).alias("_b"), "n").groupBy("_a", block.alias("_block")).agg(F.collect_set(F.when(F.col("n") >= least, F.col("_b"))).alias("_enough"), F.map_from_entries(F.collect_list(F.when(F.col("n") < least, F.struct("_b", "n")))).alias("_few"))
    rows = left.join(right, "_block").join(known, ["_a", "_block"], "left")
    missing = F.explode(F.when(F.col("_enough").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_enough")))
    return rows.select(F.col("_a").alias(a), missing.alias(b), "_few").select(a, b, F.coalesce(F.element_at("_few", F.col(b)), F.lit(0)).alias("n"))


def expand_quota(cells: DataFrame) -> DataFrame:
    """One order row for each unit of a cell's count n, with its number inside the cell."""
    return cells.where("n > 0").select(*[c for c in cells.columns if c != "n"], F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("no"))


def assign_flags(orders: DataFrame, flag: str, must: Column, target: int, weight: Column, seed: int = 0) -> DataFrame:
    """orders with a boolean flag: all that must have it, then those of the highest weight (ties by a hash of the id) up to
    the target."""
    rows = orders.withColumn("_must", must).withColumn("_weight", weight).withColumn("_h", F.xxhash64(F.col("id").cast("string"), F.lit(seed)))
    ahead = first_rows(rows.select("id", "_must", "_weight", "_h"), target, F.desc("_must"), F.desc("_weight"), "_h", "id").select("id").withColumn("_in", F.lit(True))
    out = rows.join(ahead, "id", "left")
    return out.withColumn(flag, F.col("_must") | F.coalesce("_in", F.lit(False))).drop("_must", "_weight", "_h", "_in")


def allowed_defects(labels: DataFrame) -> DataFrame:
    """doc_id, defects: those whose precondition a document meets."""
    return labels.select("doc_id", F.array_compact(F.array(F.when(F.col("number").isNotNull(), "sayi_eksik"), F.when(F.col("has_reference"), "ilgi_kopuk"), F.when(F.col("has_attachment"), "ek_eksik"), F.when(F.col("closing").isin("arz", "rica"), "kapanis_ters"), F.when(F.col("addressee").isNotNull(), "muhatap_belirsiz"))).alias("defects"))


def flip_closing(text: Column) -> Column:
    """The last closing verb turned: arz to rica and back; texts without one stay."""
    verb = F.regexp_extract(text, CLOSING_VERB, 2)
    return F.when(verb == "arz", F.regexp_replace(text, CLOSING_VERB, "$1rica$3")).when(verb == "rica", F.regexp_replace(text, CLOSING_VERB, "$1arz$3")).otherwise(text)


def break_reference(text: Column, seed: Column) -> Column:
    """The text without its mentions of the reference line, with a neutral opening chosen by the seed; null if any is left."""
    out = text
    for p in REFERENCE_PHRASES:
        out = F.regexp_replace(out, p, "")
    opening = nth(F.array(*[F.lit(o) for o in OPENINGS]), (F.pmod(seed, F.lit(len(OPENINGS))) + 1).cast("int"))
    out = F.concat(opening, F.lit(" "), out)
    return F.when(~normalize_style(out).rlike(r"(?U)\bilgi(?:de|ye|nde)?\b"), out)


def tckn_from_seed(seed: Column) -> Column:
    """A valid identity number from a seed: nine digits of its hashes, two check digits."""
    first = F.pmod(F.xxhash64(seed.cast("long"), F.lit(0)), F.lit(9)) + 1
    nine = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.when(i == 0, first).otherwise(F.pmod(F.xxhash64(seed.cast("long"), i), F.lit(10))).cast("int"))
    return bound(nine, lambda d: F.array_join(F.transform(F.concat(d, check_digits(d)), lambda x: x.cast("string")), ""))


def phone_from_seed(seed: Column) -> Column:
    prefix = nth(F.array(*[F.lit(str(p)) for p in (530, 532, 535, 541, 545, 505, 506, 551, 555)]), (F.pmod(seed, F.lit(9)) + 1).cast("int"))
    return F.concat(F.lit("0"), prefix, F.lpad(F.pmod(seed * 7_368_787 + 1_299_709, F.lit(10_000_000)).cast("string"), 7, "0"))


def batches(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, no, batch: numbers in groups of so many."""
    return docs.select("doc_id", "no", F.ceil(F.col("no") / size).cast("long").alias("batch"))
