"""Matching names and codes against dimension tables. A dimension of at most ROWS rows, which is checked first, is broadcast,
packed in one row where every text is compared with all of it; names beyond that meet texts by an inverted join on their
rarest three letters. Fuzzy matches are a similarity join of distinct texts that have no exact hit: names of like length are indexed
in shards, and bounds leave few pairs to compute a ratio for, however many names there are."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import fuzzy_window
from ..functions.similar import NameIndex
from ..functions.text import bound, fold, nth, text_or_empty
from ..sources.scratch import written

THRESHOLD = 0.75
ROWS = 20_000  # of a dimension: above that it is joined, not broadcast
QUOTE_LEAST = 8
BAND = 1.25  # a band holds names from a length to so many times it
SHARD_NAMES, BLOCK_TEXTS, MOST_TASKS = 20_000, 5_000, 20_000


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    return df.limit((rows or ROWS) + 1).count() <= (rows or ROWS)


def dimension(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint for a dimension of proven size."""
    return F.broadcast(df) if is_small(df, rows) else df


def _grams(c: Column, *sizes: int) -> Column:
    """Distinct runs of so many letters. Letters are cut out once, as a place in a long text is found by counting from its start."""

    def of(letters: Column, n: int) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(letters) - n), lambda i: F.concat(*[F.get(letters, i + k) for k in range(n)]))
        return F.when(F.size(letters) >= n, F.array_distinct(run)).otherwise(F.array().cast("array<string>"))

    return bound(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda letters: F.concat(*[of(letters, n) for n in sizes]))


def _standing(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (t and other columns) with every name (n, not empty) that stands in t. A name is filed under its rarest three letters (or itself,
    if shorter), and a text looks up the letters it has: only those that a name is filed under leave the row, if the names are few."""
    distinct = names.select("n").distinct()
    grams = distinct.select("n", F.explode(F.when(F.length("n") >= 3, _grams(F.col("n"), 3)).otherwise(F.array("n"))).alias("g"))
    filed = grams.join(grams.groupBy("g").agg(F.count("*").alias("c")), "g").groupBy("n").agg(F.min_by("g", F.struct("c", "g")).alias("g"))
    t = F.col("t")
    if is_small(distinct):
        found = filed.collect()
        keys = sorted({r["g"] for r in found})
        sizes = sorted({len(g) for g in keys}) or [3]
        runs = F.concat(*[F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes])
        has = F.array_distinct(F.filter(runs, lambda g: g.isin(keys)))
        filed = F.broadcast(rows.sparkSession.createDataFrame([(r["n"], r["g"]) for r in found], "n string, g string"))
    else:
        has = _grams(t, 1, 2, 3)
    return rows.select("*", F.explode(has).alias("g")).join(filed, "g").where(t.contains(F.col("n"))).drop("g")


def containing(texts: DataFrame, names: DataFrame) -> DataFrame:
    """t, n: every distinct text (t) with the names (n, not empty) that stand in it."""
    return _standing(texts.select("t").distinct(), names).select("t", "n").distinct()


def units_by_key(docs: DataFrame, units: DataFrame, key: str, unit_key: str = "detsis_no", outside: DataFrame | None = None) -> DataFrame:
    """docs with unit_code and outside_name: own units come before outside bodies. Null keys match nothing and stay out of the
    join's shuffle."""
    own = dimension(units.where(F.col(unit_key).isNotNull()).select(F.col(unit_key).alias("_k"), F.col("code").alias("unit_code")).dropDuplicates(["_k"]))
    out = docs.join(own, docs[key] == F.col("_k"), "left").drop("_k")
    if outside is None:
        return out.withColumn("outside_name", F.lit(None).cast("string"))
    other = dimension(outside.select(F.col(unit_key).alias("_k"), F.col("name").alias("outside_name")).dropDuplicates(["_k"]))
    return out.join(other, (out[key] == F.col("_k")) & out["unit_code"].isNull(), "left").drop("_k")


def prefixes(code: Column) -> Column:
    """A dotted code and its prefixes, the longest first."""
    parts = F.split(code, r"\.")
    return F.when(code.isNotNull(), F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))


def units_by_sdp(docs: DataFrame, units: DataFrame, code_col: str = "sdp", institution_col: str | None = None) -> DataFrame:
    """doc_id, matched_code, candidates: units of the longest prefix that any unit has, then the routable ones, then those of
    the institution unless that leaves none."""
    named = units.select(F.explode("sdp_codes").alias("matched_code"), F.col("code").alias("unit"), "routable", *(["institution"] if institution_col else []))
    tried = docs.where(F.col(code_col).isNotNull()).select("doc_id", *([F.col(institution_col).alias("_inst")] if institution_col else []), F.explode(prefixes(F.col(code_col))).alias("matched_code"))
    hit = tried.join(dimension(named), "matched_code")
    inside = (F.col("institution") == F.col("_inst")) if institution_col else F.lit(True)
    per = hit.groupBy("doc_id", "matched_code").agg(F.array_sort(F.collect_set(F.when(F.col("routable"), F.col("unit")))).alias("all"), F.array_sort(F.collect_set(F.when(F.col("routable") & inside, F.col("unit")))).alias("own"))
    best = per.groupBy("doc_id").agg(F.max_by(F.struct("matched_code", "all", "own"), F.length("matched_code")).alias("b"))
    chosen = F.when(F.size("b.own") > 0, F.col("b.own")).otherwise(F.col("b.all"))
    found = best.select("doc_id", "b.matched_code", chosen.alias("candidates"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", "matched_code", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def code_names(codes: DataFrame, catalog: DataFrame, code_col: str = "sdp") -> DataFrame:
    """code, matched_code, name (by the longest prefix), retention (of the exact code only) of distinct codes."""
    distinct = codes.where(F.col(code_col).isNotNull()).select(F.col(code_col).alias("code")).distinct()
    tried = distinct.select("code", F.explode(prefixes(F.col("code"))).alias("matched_code"))
    hit = tried.join(dimension(catalog.select(F.col("code").alias("matched_code"), "name", "retention")), "matched_code")
    best = hit.groupBy("code").agg(F.max_by(F.struct("matched_code", "name", "retention"), F.length("matched_code")).alias("b"))
    return distinct.join(best, "code", "left").select("code", "b.matched_code", "b.name", F.when(F.col("b.matched_code") == F.col("code"), F.col("b.retention")).alias("retention"))


def _bands(size: Column, threshold: float) -> Column:
    """The bands of names that a text of this length can reach the threshold with: the ratio of r is at most 2 min / (min + max)."""
    low, high = size * (threshold / (2 - threshold)), size * ((2 - threshold) / threshold)
    band = lambda c: F.floor(F.log(F.greatest(c, F.lit(1.0))) / math.log(BAND)).cast("int")
    return F.sequence(band(low - 1e-6), band(high + 1e-6))


def _met(texts: DataFrame, names: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    """texts (t) and names (n, rank) with band, shard, block, and the number of these: those of one are compared. A band's names are dealt to
    shards and its texts to blocks of bounded size, by hashes, so that neither gathers in one task."""
    band = F.floor(F.log(F.length("n").cast("double")) / math.log(BAND)).cast("int")
    named = names.select("n", "rank", band.alias("band"))
    asked = texts.select("t", F.explode(_bands(F.length("t").cast("double"), threshold)).alias("band"))
    shards = named.groupBy("band").agg(F.ceil(F.count("*") / SHARD_NAMES).alias("shards"))
    blocks = asked.groupBy("band").agg(F.ceil(F.count("*") / BLOCK_TEXTS).alias("blocks"))
    sizes = shards.join(blocks, "band")  # a row for each band, of which there are log(longest name)
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = named.join(sizes, "band").select("n", "rank", "band", F.pmod(F.xxhash64("n"), "shards").alias("shard"), every("blocks").alias("block"))
    right = asked.join(sizes, "band").select("t", "band", every("shards").alias("shard"), F.pmod(F.xxhash64("t"), "blocks").alias("block"))
    return left, right, sizes.agg(F.coalesce(F.sum(F.col("shards") * F.col("blocks")), F.lit(0))).first()[0]


def similar_names(texts: DataFrame, names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """t, n, score: every pair of a distinct folded text (t) and a distinct folded name (n) whose ratio is at least the threshold.
    Nulls and empty strings are like nothing."""
    return _similar(texts, names.where("n <> ''").select("n").distinct().withColumn("rank", F.array().cast("array<string>")), threshold, False)


def _similar(texts: DataFrame, names: DataFrame, threshold: float, best: bool) -> DataFrame:
    key = ["band", "shard", "block"]
    left, right, groups = _met(texts.where("t <> ''").select("t").distinct(), names, threshold)
    tasks = min(2 * groups + 1, MOST_TASKS)  # by number, as the work isn't in the bytes

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        named, ranks = a.column("n").to_pylist(), a.column("rank").to_pylist()
        index, out = NameIndex(named, threshold), []
        rank = [(int(x[0]), *x[1:]) if x else () for x in ranks]
        for t in b.column("t").to_pylist() if named else []:
            found = index.best(t, rank) if best else None
            out += [(t, named[i], s) for i, s in ([found] if found else [] if best else index.matches(t))]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"t": pa.array(cols[0], pa.string()), "n": pa.array(cols[1], pa.string()), "score": pa.array(cols[2], pa.float64())})

    return left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *key).groupBy(*key)).applyInArrow(run, "t string, n string, score double")


def best_unit_match(texts: DataFrame, candidates: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, fuzzy: bool = True) -> DataFrame:
    """text, code, score, name: the candidate (code, name, level) that fits each distinct text best. Contained names come
    before fuzzy ones, then level, ratio, length of the name, code and name decide. Null and empty texts match nothing."""
    small = candidates.select("code", "name", "level", fold(F.col("name")).alias("n")).where("n <> ''").withColumn("size", F.length("n"))
    distinct = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct().withColumn("t", fold(F.col("text"))).where("t <> ''")
    if is_small(small):
        packed = F.broadcast(small.agg(F.collect_list(F.struct("level", "size", "code", "name", "n")).alias("c")))
        inside = F.filter("c", lambda x: F.col("t").contains(x["n"]))
        exact = F.array_max(F.transform(inside, lambda x: F.struct(x["level"].alias("level"), F.lit(1.0).alias("score"), x["size"].alias("size"), x["code"].alias("code"), x["name"].alias("name"))))
        tried = distinct.join(packed).select("text", "t", exact.alias("b"))  # at most ROWS candidates beside every text
    else:
        hits = containing(distinct, small).join(small, "n").groupBy("t").agg(F.max(F.struct("level", F.lit(1.0).alias("score"), "size", "code", "name")).alias("b"))
        tried = distinct.join(hits, "t", "left")
    found = tried.where("b is not null").select("text", "b.code", "b.score", "b.name")
    if not fuzzy:
        return found
    tried = written(tried, "tried")  # texts with and without an exact hit are told apart once
    found, rest = tried.where("b is not null").select("text", "b.code", "b.score", "b.name"), tried.where("b is null").select("text", "t")
    # of the rows of one folded name only the greatest can win; levels go to the index as text beside code and name
    named = small.groupBy("n").agg(F.max(F.struct("level", "code", "name")).alias("m")).select("n", "m", F.array(F.coalesce(F.col("m.level"), F.lit(-1)).cast("string"), F.coalesce("m.code", F.lit("")), F.coalesce("m.name", F.lit(""))).alias("rank"))
    close = _similar(rest, named.select("n", "rank"), threshold, True).join(named.select("n", "m"), "n")
    best = close.groupBy("t").agg(F.max(F.struct("m.level", "score", F.length("n").alias("size"), "m.code", "m.name")).alias("b"))
    return found.unionByName(rest.join(best, "t").select("text", "b.code", "b.score", "b.name"))


def alias_candidates(units: DataFrame, second_names: DataFrame) -> DataFrame:
    """code, name, level of units and of institutions' second names (code, name), once for each folded name; units first."""
    alias = second_names.join(dimension(units.select("code", "level")), "code").select("code", "name", "level", F.lit(1).alias("rank"))
    both = units.select("code", "name", "level", F.lit(0).alias("rank")).unionByName(alias).withColumn("n", fold(F.col("name")))
    return both.groupBy("n").agg(F.min(F.struct("rank", "code", "name", "level")).alias("m")).select("m.code", "m.name", "m.level")


def letterhead_unit(docs: DataFrame, patterns: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """doc_id, institution, unit: the institution all of whose lines (institution, line, ord) occur in the letterhead; most
    lines win, the first on ties. unit: the code of the institution's unit (units: code, name, institution) that the last line
    names exactly, else the institution's own code; null without units."""
    lines = patterns.withColumn("l", fold(F.col("line")))
    wanted = lines.groupBy("institution").agg(F.collect_set("l").alias("lines"), F.min("ord").alias("ord"))
    heads = docs.select("doc_id", fold(F.array_join("letterhead", " ")).alias("t"), fold(nth("letterhead", -1)).alias("last"))
    if is_small(wanted):
        packed = F.broadcast(wanted.agg(F.collect_list(F.struct("institution", "lines", "ord")).alias("p")))
        hits = F.filter("p", lambda x: F.forall(x["lines"], lambda line: F.col("t").contains(line)))
        best = F.array_max(F.transform(hits, lambda x: F.struct(F.size(x["lines"]).alias("n"), (-x["ord"]).alias("o"), x["institution"].alias("institution"))))
        found = heads.join(packed).select("doc_id", "last", best["institution"].alias("institution"))
    else:
        hits = containing(heads, lines.select(F.col("l").alias("n")).where("n <> ''")).join(lines.select(F.col("l").alias("n"), "institution").distinct(), "n")
        full = hits.groupBy("t", "institution").agg(F.count("*").alias("k")).join(wanted.select("institution", F.size(F.array_remove("lines", "")).alias("k"), "ord"), ["institution", "k"])
        best = full.groupBy("t").agg(F.max(F.struct("k", (-F.col("ord")).alias("o"), "institution")).alias("b")).select("t", "b.institution")
        found = heads.join(best, "t", "left").select("doc_id", "last", "institution")
    if units is None:
        return found.select("doc_id", "institution", F.lit(None).cast("string").alias("unit"))
    named = units.groupBy("institution", fold(F.col("name")).alias("last")).agg(F.min("code").alias("unit"))
    return found.join(dimension(named), ["institution", "last"], "left").select("doc_id", "institution", F.coalesce("unit", "institution").alias("unit"))


def code_from_subject(subjects: DataFrame, catalog: DataFrame, text_col: str = "subject") -> DataFrame:
    """subject, code: the first catalogue row (by ord) whose name or one of whose subjects stands in a distinct subject."""
    phrases = catalog.select("code", "ord", F.explode(F.array_union(F.array(F.coalesce("name", F.lit(""))), "subjects")).alias("p")).select("code", "ord", fold(F.col("p")).alias("n")).where("n <> ''")
    distinct = subjects.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("subject")).distinct().withColumn("t", fold(F.col("subject")))
    if not is_small(phrases):
        best = containing(distinct, phrases).join(phrases, "n").groupBy("t").agg(F.min(F.struct("ord", "code")).alias("b"))
        return distinct.join(best, "t").select("subject", "b.code")
    packed = F.broadcast(phrases.agg(F.array_sort(F.collect_list(F.struct("ord", "code", "n"))).alias("c")))
    hit = nth(F.filter("c", lambda x: F.col("t").contains(x["n"])), 1)
    return distinct.join(packed).select("subject", hit["code"].alias("code")).where("code is not null")


def narrowed_codes(docs: DataFrame, units: DataFrame, catalog: DataFrame) -> DataFrame:
    """doc_id, subject_code: the first catalogue row (by ord), among the codes of the addressee's unit alone, whose name or one of
    whose subjects stands in the document's subject. docs: doc_id, addressee_unit, subject; units: code, sdp_codes."""
    phrases = catalog.select(F.col("code").alias("sdp"), "ord", F.explode(F.array_union(F.array(F.coalesce("name", F.lit(""))), "subjects")).alias("p")).select("sdp", "ord", fold(F.col("p")).alias("n")).where("n <> ''")
    own = dimension(units.select(F.col("code").alias("addressee_unit"), F.explode("sdp_codes").alias("sdp")).join(phrases, "sdp"))
    asked = docs.where("addressee_unit is not null and subject is not null").select("doc_id", "addressee_unit", fold(F.col("subject")).alias("t"))
    hits = asked.join(own, "addressee_unit").where(F.col("t").contains(F.col("n")))
    return hits.groupBy("doc_id").agg(F.min(F.struct("ord", "sdp")).alias("b")).select("doc_id", F.col("b.sdp").alias("subject_code"))


def hierarchy_position(pairs: DataFrame, lists: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """sender, recipient, position: of lists (institution, position, position_ord, body), the first list of the institution
    most like the sender in which a name contains the recipient's or is contained in it; else a reason."""
    institutions = lists.select("institution").distinct()
    names = institutions.select(F.col("institution").alias("code"), F.col("institution").alias("name"), F.lit(0).alias("level"))
    match = best_unit_match(pairs, names, "sender", threshold).select(F.col("text").alias("sender"), F.col("code").alias("institution"))
    packed = lists.select("institution", "position_ord", "position", fold(F.col("body")).alias("b")).groupBy("institution").agg(F.array_sort(F.collect_list(F.struct("position_ord", "position", "b"))).alias("l"))
    rows = pairs.select("sender", "recipient").distinct().withColumn("r", fold(F.col("recipient"))).join(match, "sender", "left").join(dimension(packed), "institution", "left")
    r = F.col("r")
    hit = nth(F.filter("l", lambda x: (r != "") & (x["b"].contains(r) | r.contains(x["b"]))), 1)
    return rows.select("sender", "recipient", F.when(F.col("institution").isNull(), "kurum_yok").otherwise(F.coalesce(hit["position"], F.lit("bulunamadi"))).alias("position"))


def correspondence_form(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """institution, body, form of table (institution, body, form): exact, else folded equality."""
    t = table.groupBy("institution", "body").agg(F.min("form").alias("exact"))
    f = table.groupBy("institution", fold(F.col("body")).alias("_f")).agg(F.min("form").alias("loose"))
    rows = pairs.select("institution", "body").distinct().withColumn("_f", fold(F.col("body")))
    return rows.join(dimension(t), ["institution", "body"], "left").join(dimension(f), ["institution", "_f"], "left").select("institution", "body", F.coalesce("exact", "loose").alias("form"))


def recipient_unit(replies: DataFrame, units: DataFrame, text_cols: list[str]) -> DataFrame:
    """doc_id, unit: by the sender's agency id, else by the first of the texts that matches a unit."""
    out = units_by_key(replies, units, "sender_detsis")
    result = F.col("unit_code")
    for i, c in enumerate(text_cols):
        m = best_unit_match(replies, units, c).select(F.col("text").alias(f"_t{i}"), F.col("code").alias(f"_u{i}"))
        out = out.join(m, out[c] == F.col(f"_t{i}"), "left")
        result = F.coalesce(result, F.col(f"_u{i}"))
    return out.select("doc_id", result.alias("unit"))


def _disorder(rows: DataFrame, slots: int = 64) -> DataFrame:
    """batch, out_of_order of rows (batch, doc_no, wanted, at): whether the places found fall anywhere in the wanted order. Ranged
    over (batch, wanted), compared with the row before inside a range, and each range's first with the highest before it."""
    place, inner, outer = F.struct("at", "doc_no"), Window.partitionBy("part", "batch").orderBy("wanted", "doc_no"), Window.partitionBy("batch").orderBy("part")
    ranged = rows.repartitionByRange(slots, "batch", "wanted", "doc_no").select("batch", "doc_no", "wanted", "at", F.spark_partition_id().alias("part"))
    falls = ranged.withColumn("fall", F.coalesce(F.lag(place).over(inner) > place, F.lit(False)))
    parts = falls.groupBy("batch", "part").agg(F.max("fall").alias("fall"), F.min(place).alias("low"), F.max(place).alias("high"))
    parts = parts.withColumn("fall", F.col("fall") | F.coalesce(F.max("high").over(outer.rowsBetween(Window.unboundedPreceding, -1)) > F.col("low"), F.lit(False)))
    return parts.groupBy("batch").agg(F.max("fall").alias("out_of_order"))


def match_answers(expected: DataFrame, found: DataFrame, least: int = 80, preamble: int = 20) -> DataFrame:
    """batch, missing, extra, repeated, out_of_order, short, empty, long_preamble. expected: batch, doc_no, ord; found: as
    split_batches() gives it. Order is checked between neighbours in ranges, so a large batch spreads over tasks."""
    bodies = found.where("doc_no is not null").groupBy("batch", "doc_no").agg(F.count("*").alias("n"), F.min("ord").alias("at"), F.min(F.length("body")).alias("size"))
    both = expected.select("batch", "doc_no", F.col("ord").alias("wanted")).join(bodies, ["batch", "doc_no"], "full")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    sums = both.groupBy("batch").agg(count(F.col("at").isNull()).alias("missing"), count(F.col("wanted").isNull()).alias("extra"), count(F.col("n") > 1).alias("repeated"), count((F.col("size") > 0) & (F.col("size") < least)).alias("short"), count(F.col("size") == 0).alias("empty"))
    sums = sums.join(_disorder(both.where("wanted is not null and at is not null")), "batch", "left").withColumn("out_of_order", F.coalesce("out_of_order", F.lit(False)))
    sums = sums.select("batch", "missing", "extra", "repeated", "out_of_order", "short", "empty")
    heads = found.where("ord = 0").groupBy("batch").agg(F.max(F.length("body") > preamble).alias("long_preamble"))
    return sums.join(heads, "batch", "left").withColumn("long_preamble", F.coalesce("long_preamble", F.lit(False)))


def unsupported(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner: unknown parents, overrides of unknown rules, evidence on undefined paths, fields without
    evidence."""
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def verify_quote(quote: Column, body: Column, raw: Column, least: int = QUOTE_LEAST) -> Column:
    """govde, ham or null: where a quote stands, compared folded; shorter quotes are rejected."""
    q = fold(quote)
    return F.when(F.length(q) < least, None).when(fold(body).contains(q), "govde").when(fold(raw).contains(q), "ham")


def verify_quotes(docs: DataFrame, quotes: DataFrame, least: int = QUOTE_LEAST) -> DataFrame:
    """doc_id, quote, stands (govde or ham): every quote (quote) with every document (doc_id, body, raw) it stands in, compared folded;
    quotes shorter than least stand nowhere. An inverted join by the quotes' rarest three letters, not a comparison of all pairs."""
    asked = quotes.select("quote", fold(F.col("quote")).alias("n")).where(F.length("n") >= least).distinct()
    body, raw = fold(F.col("body")), fold(F.col("raw"))
    texts = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("govde").alias("stands"), body.alias("t")), F.struct(F.lit("ham").alias("stands"), F.when(~F.col("raw").eqNullSafe(F.col("body")), raw).alias("t")))).alias("x"))
    found = _standing(texts.select("doc_id", "x.stands", "x.t").where("t is not null"), asked.select("n"))
    both = found.groupBy("doc_id", "n").agg(F.min("stands").alias("stands"))  # govde before ham
    return both.join(asked, "n").select("doc_id", "quote", "stands")


def verify_evidence(rows: DataFrame, sentence_col: str = "sentence", body_col: str = "body", threshold: float = 0.80) -> DataFrame:
    """rows with evidence (the sentence, at most 300 characters, if it is found in the body at the threshold) and dropped."""
    scored = rows.withColumn("_s", fuzzy_window(fold(F.col(sentence_col)), fold(F.col(body_col)), threshold))
    kept = F.col("_s") >= threshold
    return scored.withColumn("evidence", F.when(kept, F.substring(text_or_empty(F.col(sentence_col)), 1, 300))).withColumn("dropped", ~F.coalesce(kept, F.lit(False))).drop("_s")
