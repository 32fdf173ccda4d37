"""Routing ladder, direction, evidence ranking, confidence gate and the human queue: one row per document, narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, masked, nth

# Route scores, thresholds and priorities of evidence.
AGREED, SINGLE, FROM_SUBJECT, MODEL_NARROW, MODEL_WIDE, CONFLICT = 1.00, 0.90, 0.80, 0.70, 0.45, 0.40
GATE = 0.85
WEAK = 0.60
PRIORITY = {"insan": 100, "regex": 80, "sozluk": 80, "kural": 80, "hesap": 75, "ocr": 60, "llm": 40}
OPEN = ["insan_onayi_bekliyor", "eksik_bilgi_bekliyor", "isleniyor"]
EMPTY = "array<string>"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(EMPTY))


def route(docs: DataFrame) -> DataFrame:
    """doc_id, target, score, path, conflict, candidates.

    docs: doc_id, sdp_candidates array, addressee_unit, number_code, subject_code, subject_candidates array, model_narrow,
    model_wide (a model's picks among the narrow set and among all units; null if there are none)."""
    d = docs.select("doc_id", _or_empty(F.col("sdp_candidates")).alias("s"), F.col("addressee_unit").alias("a"), "number_code", "subject_code", _or_empty(F.col("subject_candidates")).alias("j"), "model_narrow", "model_wide")
    has_a, has_s = F.col("a").isNotNull(), F.size("s") > 0
    disagree = ~has_a & has_s & (F.size("j") > 0) & F.coalesce(F.col("subject_code") != F.col("number_code"), F.lit(False))
    d = d.withColumn("disagree", disagree).withColumn("s2", F.when(disagree | (~has_a & ~has_s), F.col("j")).otherwise(F.col("s")))
    both, member = has_a & has_s, F.array_contains("s", F.col("a"))
    one = F.size("s2") == 1
    narrow = (F.size("s2") > 1) & F.array_contains("s2", F.col("model_narrow"))
    step = lambda target, score, path: F.struct(target.alias("target"), F.lit(score).alias("score"), F.lit(path).alias("path"))
    pick = (
        F.when(both & member & (F.size("s") == 1), step(F.col("a"), AGREED, "sdp+muhatap"))
        .when(both & member, step(F.col("a"), AGREED, "muhatap_sdp_icinde"))
        .when(both, step(F.col("a"), CONFLICT, "celiski_sdp_muhatap"))
        .when(F.col("disagree") & one, step(nth("s2", 1), CONFLICT, "celiski_sayi_konu"))
        .when(has_s & one, step(nth("s2", 1), SINGLE, "sdp_tek"))
        .when(has_a, step(F.col("a"), SINGLE, "muhatap"))
        .when(~has_s & one, step(nth("s2", 1), FROM_SUBJECT, "konu_tek"))
        .when(F.coalesce(narrow, F.lit(False)), step(F.col("model_narrow"), MODEL_NARROW, "model_dar"))
        .when((F.size("s2") <= 1) & F.col("model_wide").isNotNull(), step(F.col("model_wide"), MODEL_WIDE, "model_genis"))
        .otherwise(step(F.lit(None).cast("string"), 0.0, "llm_yok"))
    )
    d = d.withColumn("p", pick).withColumn("conflict", F.col("disagree") | F.coalesce(both & ~member, F.lit(False)))
    return d.select("doc_id", "p.target", "p.score", "p.path", "conflict", candidate_list(F.col("p.target"), F.col("a"), F.col("s2")).alias("candidates"))


def candidate_list(target: Column, addressee: Column, sdp: Column, most: int = 5) -> Column:
    """The target, the addressee's unit, the code's units: once each, in this order, at most five; score 1 for the target."""
    units = F.slice(F.array_distinct(F.array_compact(F.concat(F.array(target, addressee), sdp))), 1, most)
    return F.transform(units, lambda u: F.struct(u.alias("unit"), F.when(u == target, 1.0).otherwise(0.0).alias("score")))


def source_badge(path: Column) -> Column:
    return F.when(path.startswith("sdp"), "SDP_TABLOSU").when(path.startswith("muhatap"), "MUHATAP").when(path.startswith("konu"), "KONU").when(path.startswith("model"), "LLM").when(path.startswith("celiski"), "CELISKI").otherwise("YOK")


def addressee_route(matches: DataFrame, letterheads: DataFrame, units: DataFrame, least: float = GATE) -> DataFrame:
    """doc_id, unit, score: a name match of at least 0.85, else the letterhead's unit if it can be a target (1.0)."""
    targets = units.where("routable").select(F.col("code").alias("lh"))
    lh = letterheads.select("doc_id", F.col("unit").alias("lh")).join(targets, "lh", "left_semi")
    both = matches.select("doc_id", "unit", "score").join(lh, "doc_id", "full")
    good = F.coalesce(F.col("score") >= least, F.lit(False))
    return both.select("doc_id", F.when(good, F.col("unit")).otherwise(F.col("lh")).alias("unit"), F.when(good, F.col("score")).when(F.col("lh").isNotNull(), 1.0).alias("score"))


def who_writes(docs: DataFrame, least: float = GATE) -> DataFrame:
    """doc_id, writer_unit, confidence, uncertain, reason: the routed unit, else the addressee's match."""
    unit = F.coalesce("target", "match_unit")
    confidence = F.when(F.col("target").isNotNull(), 1.0).otherwise(F.coalesce("match_score", F.lit(0.0)))
    reason = F.when(unit.isNull(), "birim_bulunamadi").when(confidence < least, "eslesme_zayif")
    return docs.select("doc_id", unit.alias("writer_unit"), confidence.alias("confidence"), (unit.isNull() | (confidence < least)).alias("uncertain"), reason.alias("reason"))


def letterhead_lines(template: Column, institution: Column, unit: Column, level: Column) -> Column:
    """Template lines filled; the unit's line falls away at level 0, lines with an unfilled place too."""
    filled = F.transform(template, lambda t: F.replace(F.replace(t, F.lit("{kurum_adi}"), F.coalesce(institution, F.lit("{kurum_adi}"))), F.lit("{birim_adi}"), F.when(level == 0, "{birim_adi}").otherwise(F.coalesce(unit, F.lit("{birim_adi}")))))
    return F.filter(filled, lambda t: ~t.rlike(r"\{[a-z_]+\}"))


def direction(sender_kind: Column, own_institution: Column, other_institution: Column, own_level: Column, other_level: Column, table_form: Column) -> Column:
    """gercek_kisi, kurum_disi, alt, ayni, ust (by level inside an institution, else by the correspondence table), bilinmiyor."""
    inside = own_institution == other_institution
    by_level = F.when(own_level < other_level, "alt").when(own_level == other_level, "ayni").when(own_level > other_level, "ust")
    return F.when(sender_kind == "kisi", "gercek_kisi").when(sender_kind == "sirket", "kurum_disi").when(inside & by_level.isNotNull(), by_level).when(table_form == "arz", "ust").when(table_form == "rica", "alt").otherwise("bilinmiyor")


def closing_text(direction_col: Column) -> Column:
    return F.when(direction_col.isin("ust", "ayni"), "arz ederim.").when(direction_col.isin("alt", "kurum_disi"), "rica ederim.").when(direction_col == "karma", "arz ve rica ederim.").when(direction_col == "gercek_kisi", "Bilgilerinize sunulur.")


def gate(docs: DataFrame, threshold: float = GATE) -> DataFrame:
    """doc_id, auto, trust, threshold, blockers, reasons, status.

    docs: target, score, gave_up boolean (null without a writer's record), open_errors long (error findings of the draft
    without conflicting rules), writer_uncertain boolean, critical_missing long (unresolved), conflict boolean. The trust is
    the least component; the score is one, the other four are 0 or 1."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    score = F.coalesce("score", F.lit(0.0))
    bad_route = F.col("target").isNull() | (score < threshold)
    bad_draft = F.coalesce("gave_up", F.coalesce("open_errors", F.lit(0)) > 0)
    bad_writer, missing, conflict = flag(F.col("writer_uncertain")), F.coalesce("critical_missing", F.lit(0)) > 0, flag(F.col("conflict"))
    tests = [("yonlendirme", bad_route, F.when(F.col("target").isNull(), "hedef yok").otherwise("skor esigin altinda")), ("taslak", bad_draft, F.lit("taslakta ihlal")), ("kimlik", bad_writer, F.lit("yazan birim belirsiz")), ("eksik", missing, F.lit("kritik eksik")), ("celiski", conflict, F.lit("kaynaklar celisiyor"))]
    blockers = F.array_compact(F.array(*[F.when(t, n) for n, t, _ in tests]))
    reasons = F.array_compact(F.array(*[F.when(t, r) for _, t, r in tests]))
    trust = F.least(score, *[F.when(t, 0.0).otherwise(1.0) for _, t, _ in tests[1:]])
    auto = F.size(blockers) == 0
    return docs.select("doc_id", auto.alias("auto"), trust.alias("trust"), F.lit(threshold).alias("threshold"), blockers.alias("blockers"), reasons.alias("reasons"), F.when(auto, "otomatik_onaylandi").otherwise("insan_onayi_bekliyor").alias("status"))


def priority(method: Column) -> Column:
    out = F
    for name, p in PRIORITY.items():
        out = out.when(method == name, p)
    return out.otherwise(0)


def best_evidence(evidence: DataFrame) -> DataFrame:
    """One row per (doc_id, field_path): higher method priority, then a valid confidence, then the higher one, then the
    earlier (ts, ord). An aggregate of ordered structs: combined before the shuffle."""
    valid = F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    rank = F.struct(priority(F.col("method")).alias("p"), valid.alias("v"), F.when(valid, F.col("confidence")).otherwise(0.0).alias("c"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), (-F.col("ord")).alias("o"))
    best = evidence.groupBy("doc_id", "field_path").agg(F.max_by(F.struct("method", "confidence", "quote", "ord"), rank).alias("b"))
    return best.select("doc_id", "field_path", "b.method", "b.confidence", "b.quote", "b.ord")


def weakest_link(evidence: DataFrame) -> DataFrame:
    """doc_id, weakest: the least confidence (invalid ones count 0; 0 without evidence)."""
    c = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(0.0)
    return evidence.groupBy("doc_id").agg(F.min(c).alias("weakest"))


def weak_fields(evidence: DataFrame, below: float = WEAK) -> DataFrame:
    """doc_id, fields: paths under 0.60 or invalid, the weakest first."""
    c = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(0.0)
    rows = evidence.select("doc_id", c.alias("c"), "field_path").where(F.col("c") < below)
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("c", "field_path"))), lambda x: x["field_path"]).alias("fields"))


def missing_info_letter(name: Column, subject: Column, number: Column, questions: Column) -> Column:
    """A letter that asks for missing information: absent parts fall away, questions are numbered."""
    about = F.when(subject.isNotNull() & (F.trim(subject) != ""), F.concat(F.lit("İlgi: "), subject, F.coalesce(F.concat(F.lit(" ("), number, F.lit(")")), F.lit(""))))
    asked = F.array_join(F.transform(questions, lambda q, i: F.concat((i + 1).cast("string"), F.lit(") "), F.trim(q))), "\n")
    return F.concat_ws("\n\n", F.when(name.isNotNull(), F.concat(F.lit("Sayın "), name)), about, F.lit("Başvurunuzun sonuçlandırılabilmesi için aşağıdaki bilgilere ihtiyaç duyulmaktadır:"), F.nullif(asked, F.lit("")), F.lit("Bilgilerinize sunulur."))


def queue(docs: DataFrame, as_of: Column, unit: str | None = None) -> DataFrame:
    """Open documents of a unit (the current one, else the routed one), with summary columns and waiting seconds."""
    here = F.coalesce("current_unit", "target")
    rows = docs.where(F.col("status").isin(OPEN))
    if unit is not None:
        rows = rows.where(here == unit)
    critical = F.size(F.filter(F.coalesce("missing", F.array().cast("array<struct<rule_id:string,severity:string,resolved:boolean>>")), lambda m: (m["severity"] == "hata") & ~m["resolved"]))
    return rows.select("doc_id", here.alias("unit"), "status", clip(F.col("subject"), 80).alias("subject"), (F.unix_timestamp(as_of) - F.unix_timestamp(F.col("received").cast("timestamp"))).alias("waiting_s"), critical.alias("critical"))


def shown_entities(entities: DataFrame, may_see: bool) -> DataFrame:
    """Entities with personal values hidden unless the role may see them."""
    return entities.withColumn("shown", F.col("value") if may_see else F.when(F.col("is_pii"), masked(F.col("type"), F.col("value"))).otherwise(F.col("value")))


