"""Evaluation against an answer key: predictions joined with labels, then aggregations of small cardinality.

Null predictions count as wrong; rows that can't be measured leave the denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import fuzzy_window
from ..functions.text import bound, digits_only, fold, nth, numeric_tokens, shingles, text_or_empty, words_of
from .board import rank_percentile

BANDS = (0.40, 0.70, 0.90, 1.00)


def class_scores(pairs: DataFrame) -> DataFrame:
    """class, support, tp, predicted, precision, recall, f1 of every expected class (pairs: expected, predicted)."""
    counts = pairs.where("expected is not null").groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    support = counts.groupBy(F.col("expected").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = counts.where("predicted is not null").groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted"))
    out = support.join(predicted, "class", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    precision, recall = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0), F.col("tp") / F.col("support")
    return out.select("class", "support", "tp", "predicted", precision.alias("precision"), recall.alias("recall"), F.when(F.col("tp") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


def macro_f1(pairs: DataFrame) -> DataFrame:
    return class_scores(pairs).agg(F.count("*").alias("classes"), F.avg("f1").alias("macro_f1"))


def field_accuracy(predicted: DataFrame, labels: DataFrame, fields: list[str], exempt: DataFrame | None = None, loose: tuple[str, ...] = (), fuzzy: tuple[str, ...] = ()) -> DataFrame:
    """field, format, measured, right: by field over all formats (format null) and for each, in one pass of grouping sets.

    A field is measured only where the label has it and exempt (defect, field) doesn't list it; loose fields compare folded,
    fuzzy ones by a window ratio of 0.80."""
    both = labels.alias("l").join(predicted.alias("p"), "doc_id", "left")

    def right(f: str) -> Column:
        a, b = F.col(f"l.{f}").cast("string"), F.col(f"p.{f}").cast("string")
        if f in fuzzy:
            return fuzzy_window(fold(a), fold(b)) >= 0.80
        return fold(a) == fold(b) if f in loose else a == b

    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").isNotNull().alias("has"), F.coalesce(right(f), F.lit(False)).alias("right")) for f in fields])
    rows = both.select("doc_id", F.col("l.defect").alias("defect"), F.col("l.format").alias("format"), F.explode(cells).alias("c")).select("doc_id", "defect", "format", "c.*").where("has")
    if exempt is not None:
        rows = rows.join(exempt, ["defect", "field"], "left_anti")
    return rows.groupingSets([[F.col("field")], [F.col("field"), F.col("format")]], "field", "format").agg(F.count("*").alias("measured"), F.sum(F.col("right").cast("long")).alias("right"))


def invented(predicted: DataFrame, labels: DataFrame, gate: float = 0.95) -> DataFrame:
    """defect, n, right, passed: on documents whose field a defect removed or broke, whether nothing was invented. labels: doc_id,
    defect, removed_field, true_value, injected; predicted: doc_id, values (a map by field).

    A broken code (sdp_uyumsuz) must come back as it is printed; for a vague addressee (muhatap_belirsiz) the true name must not
    come back; any other removed field must stay empty."""
    rows = labels.where("removed_field is not null").join(predicted, "doc_id", "left")
    value = nth("values", F.col("removed_field"))
    empty = F.coalesce(F.trim(value), F.lit("")) == ""
    named = (F.coalesce("true_value", F.lit("")) != "") & fold(value).contains(fold(F.col("true_value")))
    right = F.when(F.col("defect") == "sdp_uyumsuz", F.coalesce(value == F.col("injected"), F.lit(False))).when(F.col("defect") == "muhatap_belirsiz", empty | ~F.coalesce(named, F.lit(False))).otherwise(empty)
    out = rows.groupBy("defect").agg(F.count("*").alias("n"), F.sum(right.cast("long")).alias("right"))
    return out.withColumn("passed", F.col("right") >= gate * F.col("n"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def rule_alarms(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """rule_id, format, alarms on clean documents: by rule (format null) and by rule and format."""
    rows = findings.join(labels.where("defect is null").select("doc_id", "format"), "doc_id")
    return rows.groupingSets([[F.col("rule_id")], [F.col("rule_id"), F.col("format")]], "rule_id", "format").agg(F.count("*").alias("alarms"))


def rule_catches(findings: DataFrame, labels: DataFrame, expected: DataFrame) -> DataFrame:
    """defect, rule_id, n, caught: defective documents whose expected rule (defect, rule_id) found something."""
    wanted = labels.where("defect is not null").join(expected, "defect")
    hit = findings.select("doc_id", "rule_id").distinct().withColumn("hit", F.lit(1))
    return wanted.join(hit, ["doc_id", "rule_id"], "left").groupBy("defect", "rule_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("caught"))


def band(score: Column, bands: tuple[float, ...] = BANDS) -> Column:
    """The lower bound of a score's band; 0.0 below the first."""
    out = F.lit(0.0)
    for b in bands:
        out = F.when(score >= b, b).otherwise(out)
    return out


def routing_outcomes(routes: DataFrame, labels: DataFrame) -> DataFrame:
    """path, band, right, wrong, unresolved: unresolved is not right."""
    rows = labels.select("doc_id", "expected").join(routes.select("doc_id", "target", "score", "path"), "doc_id", "left")
    right = F.coalesce(F.col("target") == F.col("expected"), F.lit(False))
    return rows.groupBy("path", band(F.coalesce("score", F.lit(0.0))).alias("band")).agg(F.sum(right.cast("long")).alias("right"), F.sum((F.col("target").isNotNull() & ~right).cast("long")).alias("wrong"), F.sum(F.col("target").isNull().cast("long")).alias("unresolved"))


def threshold_sweep(decisions: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, auto, leaked, human: all thresholds by conditional sums in one pass (decisions: score, other_blockers
    boolean, right boolean)."""
    ok = ~F.coalesce("other_blockers", F.lit(False))
    cells = []
    for t in thresholds:
        auto = ok & (F.coalesce("score", F.lit(0.0)) >= t)
        cells += [F.sum(auto.cast("long")).alias(f"auto_{t}"), F.sum((auto & ~F.coalesce("right", F.lit(False))).cast("long")).alias(f"leaked_{t}")]
    sums = decisions.agg(F.count("*").alias("n"), *cells)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.col(f"`auto_{t}`"), F.lit(0)).alias("auto"), F.coalesce(F.col(f"`leaked_{t}`"), F.lit(0)).alias("leaked")) for t in thresholds])
    return sums.select("n", F.explode(rows).alias("r")).select("r.threshold", "r.auto", "r.leaked", (F.col("n") - F.col("r.auto")).alias("human"))


def top_reasons(decisions: DataFrame, k: int = 12) -> DataFrame:
    return decisions.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def sender_outcomes(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """kind, measured, right: an agency id decides over a name; names compare folded without punctuation."""
    bare = lambda c: fold(F.regexp_replace(c, r"[\p{Punct}]", ""))
    rows = labels.where("measurable").alias("l").join(predicted.alias("p"), "doc_id", "left")
    right = F.when(F.col("l.detsis_no").isNotNull() & F.col("p.detsis_no").isNotNull(), F.col("l.detsis_no") == F.col("p.detsis_no")).otherwise(bare(F.col("l.name")) == bare(F.col("p.name")))
    return rows.groupBy("l.kind").agg(F.count("*").alias("measured"), F.sum(F.coalesce(right, F.lit(False)).cast("long")).alias("right"))


def calibration(rows: DataFrame) -> DataFrame:
    """band, n, right: how often a stated confidence is right (rows: confidence, right)."""
    return rows.groupBy(band(F.col("confidence"), (0.75, 0.85, 0.90, 1.00)).alias("band")).agg(F.count("*").alias("n"), F.sum(F.coalesce("right", F.lit(False)).cast("long")).alias("right"))


def closing_coverage(positions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: documents, missed superiors, false superiors, unknown senders."""
    rows = labels.select("doc_id", F.col("direction").alias("expected")).join(positions.select("doc_id", "position"), "doc_id", "left")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return rows.agg(F.count("*").alias("n"), count((F.col("expected") == "ust") & (F.coalesce("position", F.lit("")) != "ust")).alias("missed_superior"), count((F.col("expected") != "ust") & (F.col("position") == "ust")).alias("false_superior"), count(F.col("position").isNull() | F.col("position").isin("kurum_yok", "bulunamadi")).alias("unknown"))


def unknown_senders(positions: DataFrame, k: int = 20) -> DataFrame:
    """sender, n: the k most frequent senders (positions: sender, position) that the hierarchy tables don't know."""
    unknown = positions.where(F.col("position").isNull() | F.col("position").isin("kurum_yok", "bulunamadi"))
    return unknown.groupBy("sender").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sender").limit(k)


def compare_runs(a: DataFrame, b: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: hits of each of two result tables (doc_id, value) and changed documents."""
    rows = labels.select("doc_id", "expected").join(a.select("doc_id", F.col("value").alias("a")), "doc_id", "left").join(b.select("doc_id", F.col("value").alias("b")), "doc_id", "left")
    hit = lambda c: F.sum(F.coalesce(F.col(c) == F.col("expected"), F.lit(False)).cast("long"))
    return rows.agg(F.count("*").alias("n"), hit("a").alias("hits_a"), hit("b").alias("hits_b"), F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("changed"))


def agent_claims(claims: DataFrame, labels: DataFrame) -> DataFrame:
    """defect, claims, kept, right: a claim whose quote wasn't verified is dropped; on clean documents every kept claim is a
    false alarm."""
    rows = claims.join(labels.select("doc_id", "defect"), "doc_id", "left")
    kept = F.coalesce("verified", F.lit(False))
    return rows.groupBy("defect").agg(F.count("*").alias("claims"), F.sum(kept.cast("long")).alias("kept"), F.sum((kept & F.col("defect").isNotNull()).cast("long")).alias("right"))


def term_recall(texts: DataFrame, terms: DataFrame, threshold: float = 0.80, parts: int = 4, whole_words: bool = True) -> DataFrame:
    """doc_id, terms, found, found_folded: raw containment, and folded or fuzzy recovery, of each document's terms (doc_id,
    term) in its text."""
    rows = terms.join(texts.select("doc_id", "text"), "doc_id").where(F.trim("term") != "")
    raw = F.coalesce(F.lower("text").contains(F.lower("term")), F.lit(False))
    loose = fuzzy_window(fold(F.col("term")), fold(F.col("text")), threshold, parts) >= threshold
    return rows.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum(raw.cast("long")).alias("found"), F.sum(F.coalesce(raw | loose, F.lit(False)).cast("long")).alias("found_folded"))


def unverified_numbers(summary: Column, source: Column) -> Column:
    """Numeric tokens of a summary that the source has neither folded nor by digits; one digit is exempt."""
    have = F.transform(numeric_tokens(source), digits_only)
    text = fold(source)
    return F.filter(numeric_tokens(summary), lambda t: (F.length(digits_only(t)) > 1) & ~text.contains(fold(t)) & ~F.array_contains(have, digits_only(t)))


def forbidden_repeats(text: Column, number: Column, date: Column) -> Column:
    """The document's own number and date (three forms) that a text repeats."""
    forms = F.array(number, F.date_format(date, "dd.MM.yyyy"), F.date_format(date, "dd/MM/yyyy"), F.date_format(date, "yyyy-MM-dd"))
    return F.filter(F.array_compact(forms), lambda f: text_or_empty(text).contains(f))


def copy_ratio(draft: Column, body: Column, k: int = 5) -> Column:
    """The share of the draft's k-word shingles (repeats counted) that the body has; 0 if either is shorter."""
    own, other = shingles(words_of(fold(draft)), k), shingles(words_of(fold(body)), k)

    def share(z: Column) -> Column:
        common = F.array_intersect(z["own"], z["other"])  # by hash; few unless the text is copied
        found = bound(common, lambda c: F.size(F.filter(z["own"], lambda x: F.array_contains(c, x))))
        return F.when((F.size(z["own"]) > 0) & (F.size(z["other"]) > 0), found / F.size(z["own"])).otherwise(0.0)

    return bound(F.struct(own.alias("own"), other.alias("other")), share)


def answer_quality(answers: DataFrame, allowed: list[str]) -> DataFrame:
    """doc_id, n, json_ok, in_enum, in_range, stable, mean_confidence of repeated model answers (doc_id, raw, value,
    confidence)."""
    valid = F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    return answers.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.col("raw").rlike(r"^\s*\{[\s\S]*\}\s*$").cast("long")).alias("json_ok"), F.sum(F.coalesce(F.col("value").isin(allowed), F.lit(False)).cast("long")).alias("in_enum"),
        F.sum(valid.cast("long")).alias("in_range"), (F.count_distinct("value") == 1).alias("stable"), F.avg(F.when(valid, F.col("confidence"))).alias("mean_confidence"),
    )


def call_costs(calls: DataFrame) -> DataFrame:
    """model, calls, mean_tokens, mean_candidates, p50, p95 (of ms)."""
    sums = calls.groupBy("model").agg(F.count("*").alias("calls"), F.avg("tokens").alias("mean_tokens"), F.avg("candidates").alias("mean_candidates"))
    for p in (0.5, 0.95):
        sums = sums.join(rank_percentile(calls, "ms", p, ["model"]), "model", "left")
    return sums


def scan_quality(found: DataFrame, labels: DataFrame) -> DataFrame:
    """engine, n, number, date, code, letters, terms: means over the measurable documents of each engine (null: nothing could be
    measured). found: doc_id, engine, number, date, code, turkish_ratio, terms_found; labels: doc_id, number, date, code,
    turkish_ratio, terms."""
    both = found.alias("f").join(labels.alias("l"), "doc_id")
    same = lambda c: F.avg(F.when(F.col(f"l.{c}").isNotNull(), F.col(f"f.{c}").eqNullSafe(F.col(f"l.{c}")).cast("double")))
    share = lambda a, b: F.avg(F.when(F.col(b) > 0, F.least(F.lit(1.0), F.col(a) / F.col(b))))
    return both.groupBy("f.engine").agg(F.count("*").alias("n"), same("number").alias("number"), same("date").alias("date"), same("code").alias("code"), share("f.turkish_ratio", "l.turkish_ratio").alias("letters"), share("f.terms_found", "l.terms").alias("terms"))
