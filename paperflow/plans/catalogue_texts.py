"""Queries whose inputs vary by row, with hits and misses in each, and SQL that computes the answers from the same tables."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import board, corpus, evaluate, lines, lint, matching, register, routing, rules, sampling
from ..sources import dimensions
from .catalogue import FOLD, SHORT, STRIPPED, WHITE, WORD, in_re2, query
from .views import spread, table, view


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# --- text functions


@query("n6_paragraphs", "SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS INT) AS paragraphs FROM documents")
def n6(s, d):
    """Every line of a document as a paragraph."""
    return table(s, d, "documents").select("doc_id", F.size(t.paragraphs(F.regexp_replace("text", "\n", "\n \n"))).alias("paragraphs"))


@query(
    "n7_sentences",
    rf"""WITH h AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])({"|".join(t.ABBREVIATIONS)})\.', '\1\2#', 'g'), '(^|[^\p{{L}}\p{{N}}_])([A-ZÇĞİÖŞÜ])\.', '\1\2#', 'g') AS x FROM documents)
SELECT doc_id, CAST(CASE WHEN trim(coalesce(x, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE 1 + len(regexp_extract_all(x, '[.!?]\s+[A-ZÇĞİÖŞÜ"„]')) END AS INT) AS sentences FROM h""",
)
def n7(s, d):
    return spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", F.size(t.sentences(F.col("text"))).alias("sentences"))


@query(
    "n13_tckn",
    """WITH b AS (SELECT o_orderkey AS k, 100000000 + o_orderkey * 7919 % 899999999 AS nine FROM orders), g AS (SELECT k, nine, list_transform(range(1, 10), lambda i: CAST(substr(CAST(nine AS VARCHAR), CAST(i AS INT), 1) AS INT)) AS g FROM b),
c AS (SELECT k, nine, ((g[1] + g[3] + g[5] + g[7] + g[9]) * 7 - (g[2] + g[4] + g[6] + g[8]) + 100) % 10 AS tenth, list_sum(g) AS total FROM g)
SELECT k AS doc_id, k % 4 = (total + tenth) % 10 % 4 AND k % 10 = tenth AS valid, true AS made_valid FROM c""",
)
def n13(s, d):
    """Numbers whose last two digits come from the key, right in some rows by chance, and numbers made to be valid."""
    nine = (F.col("o_orderkey") * 7919 % 899_999_999 + 100_000_000).cast("string")
    digits = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.substring(nine, i, F.lit(1)).cast("int"))
    right = t.bound(digits, t.check_digits)
    last = F.when(F.col("o_orderkey") % 4 == t.nth(right, 2) % 4, t.nth(right, 2)).otherwise((t.nth(right, 2) + 1) % 10)
    number = F.concat(nine, (F.col("o_orderkey") % 10).cast("string"), last.cast("string"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), t.tckn_valid(number).alias("valid"), t.tckn_valid(corpus.tckn_from_seed(F.col("o_orderkey"))).alias("made_valid"))


@query("b7_phones", "SELECT o_orderkey AS doc_id, list_extract(['530', '532', '535', '541', '545', '505', '506', '551', '555'], CAST(o_orderkey % 9 + 1 AS INT)) AS prefix, lpad(CAST((o_orderkey * 7368787 + 1299709) % 10000000 AS VARCHAR), 7, '0') AS rest, true AS allocated FROM orders")
def b7(s, d):
    no = corpus.phone_from_seed(F.col("o_orderkey"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.substring(no, 2, 3).alias("prefix"), F.substring(no, 5, 7).alias("rest"), t.phone_allocated(no).alias("allocated"))


_STOPS = [w.replace("â", "a").replace("î", "i").replace("û", "u") for w in t.STOP_WORDS]


@query(
    "n24_content_stems",
    rf"""WITH n AS (SELECT doc_id, translate(lower(translate(translate(coalesce(text, ''), '''’ʼ', ''), 'İI', 'iı')), 'âîû', 'aiu') AS x FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(x, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'), lambda w: length(w) > 3 AND NOT list_contains({_listed(_STOPS)}, w) AND NOT list_contains({_listed(sorted({w[:5] for w in _STOPS}))}, substr(w, 1, 5)))) AS INT) AS stems FROM n""",
)
def n24(s, d):
    return spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", F.size(t.content_stems(F.col("text"))).alias("stems"))


# --- lines


@query(
    "l6_stock_phrases",
    r"""SELECT doc_id, CAST(CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END AS BIGINT) AS footer_lines, CASE doc_id % 3 WHEN 0 THEN 'Bu belge, güvenli elektronik imza ile imzalanmıştır.' WHEN 1 THEN 'Belge Doğrulama Kodu: ABCD-' || (10000000 + doc_id) END AS footer,
  md5(CASE WHEN doc_id % 3 < 2 THEN nullif(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '') ELSE nullif(coalesce(text, ''), '') END) AS body FROM documents""",
)
def l6(s, d):
    """Whole documents; two in three end in a stock phrase."""
    k = F.col("doc_id") % 3
    phrase = F.when(k == 0, " Bu belge, güvenli elektronik imza ile imzalanmıştır.").when(k == 1, F.concat(F.lit(" Belge Doğrulama Kodu: ABCD-"), (F.col("doc_id") + 10_000_000).cast("string"))).otherwise("")
    rows = table(s, d, "documents").select("doc_id", F.lit(1).alias("line_no"), F.concat(F.coalesce("text", F.lit("")), phrase).alias("text"), F.lit("body").alias("part"))
    is_footer = F.col("part") == "footer"
    out = lines.strip_stock_phrases(rows).groupBy("doc_id").agg(F.sum(is_footer.cast("long")).alias("footer_lines"), F.max(F.when(is_footer, F.col("text"))).alias("footer"), F.max(F.when(~is_footer, F.md5("text"))).alias("body"))
    return table(s, d, "documents").select("doc_id").join(out, "doc_id", "left").select("doc_id", F.coalesce("footer_lines", F.lit(0)).alias("footer_lines"), "footer", "body")


@query("s1_labels", "SELECT doc_id, expected, predicted, expected = predicted AS hit FROM pairs", ("pairs",))
def s1(s, d):
    """Labels beside predictions, as the evaluations read them."""
    rows = view(s, d, "pairs")
    return rows.select("doc_id", "expected", "predicted", (F.col("expected") == F.col("predicted")).alias("hit"))


# --- rules


@query(
    "r1_run_rules",
    r"""WITH c AS (SELECT doc_id, unnest([
  {'r': 'B-01', 's': CASE WHEN number IS NULL THEN 'ihlal' ELSE 'uygun' END},
  {'r': 'S-01', 's': CASE WHEN number IS NULL THEN 'alan_bos' WHEN NOT regexp_matches(number, '^E-\d{8}-') THEN 'ihlal' ELSE 'uygun' END},
  {'r': 'S-02', 's': CASE WHEN contains(subject, 'SPECIFIED') THEN 'ihlal' ELSE 'uygun' END},
  {'r': 'T-01', 's': CASE WHEN belge_turu NOT IN ('genelge', 'cevap_yazisi') THEN 'kapsam_disi' WHEN family NOT IN ('O', 'F') THEN 'ihlal' ELSE 'uygun' END},
  {'r': 'T-02', 's': CASE WHEN belge_turu <> 'dilekce' THEN 'kapsam_disi' WHEN contains(lower(translate(subject, 'İI', 'iı')), 'urgent') OR contains(lower(translate(subject, 'İI', 'iı')), 'high') THEN 'ihlal' ELSE 'uygun' END},
  {'r': 'M-01', 's': CASE WHEN addressee <> sender THEN 'ihlal' ELSE 'uygun' END},
  {'r': 'G-01', 's': 'hedef_disi'}, {'r': 'Y-01', 's': 'yol_yok'}]) AS x FROM letters)
SELECT doc_id, x.r AS rule_id, x.s AS status FROM c""",
    ("letters",),
)
def r1(s, d):
    from .catalogue import CATEGORIES, RULES

    return rules.run_rules(view(s, d, "letters"), RULES, categories=CATEGORIES).select("doc_id", "rule_id", "status")


LIST_RULES = [
    rules.Rule("L-01", "bos_liste_olmamali", path="names", severity="hata"),
    rules.Rule("L-02", "regex_bulunmamali", path="names", pattern=r"^SPEC", severity="hata"),
    rules.Rule("L-03", "regex_bulunmali", path="parts", list_field="name", pattern=r"^[1-3]$", severity="uyari"),
    rules.Rule("L-04", "dogru_olmali", path="approved", severity="hata"),
    rules.Rule("L-05", "regex_bulunmali", path="text", pattern=r"^Konu", severity="hata"),
]


@query(
    "r3_r9_lists_and_lines",
    r"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN [] ELSE string_split(replace(subject, ' ', '-'), '-') END AS names, subject, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 3 = 0 END AS approved FROM letters),
c AS (SELECT doc_id, unnest([
  {'r': 'L-01', 's': CASE WHEN coalesce(len(names), 0) = 0 THEN 'ihlal' ELSE 'uygun' END},
  {'r': 'L-02', 's': CASE WHEN coalesce(len(names), 0) = 0 THEN 'alan_bos' WHEN list_contains(names, 'SPECIFIED') THEN 'ihlal' ELSE 'uygun' END},
  {'r': 'L-03', 's': CASE WHEN substr(subject, 1, 1) IN ('1', '2', '3') THEN 'uygun' ELSE 'ihlal' END},
  {'r': 'L-04', 's': CASE WHEN approved IS NULL THEN 'alan_bos' WHEN approved THEN 'uygun' ELSE 'ihlal' END},
  {'r': 'L-05', 's': CASE WHEN doc_id % 2 = 0 THEN 'uygun' ELSE 'ihlal' END}]) AS x FROM x)
SELECT doc_id, x.r AS rule_id, x.s AS status FROM c""",
    ("letters",),
)
def r3(s, d):
    """Empty lists, patterns over list entries and members of structs, booleans, and anchors at every line."""
    k = F.col("doc_id")
    split = F.split(F.replace("subject", F.lit(" "), F.lit("-")), "-")
    docs = view(s, d, "letters").select(
        "doc_id", "belge_turu", F.when(k % 4 == 0, None).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(split).alias("names"), F.transform(F.split("subject", "-"), lambda x: F.struct(x.alias("name"))).alias("parts"),
        F.when(k % 5 != 0, k % 3 == 0).alias("approved"), F.concat(F.lit("Sayı : 1\n"), F.when(k % 2 == 0, "Konu : ").otherwise("Sonu : "), F.col("subject")).alias("text"),
    )
    return rules.run_rules(docs, LIST_RULES).select("doc_id", "rule_id", "status")


# --- style


@query(
    "t4_t6_persons_names",
    "SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'K13.1,ATF-01' WHEN 1 THEN 'VTD-01' WHEN 2 THEN '' ELSE 'ATF-01' END AS found FROM conversations",
)
def t4(s, d):
    """Whole turns behind a phrase of each kind: first person and a bare name, an office word, a name in a faculty's name, a
    student's bare name."""
    k = F.col("conv_id") % 4
    phrase = F.when(k == 0, "İnceledik, Gazi tarafından. ").when(k == 1, "Müdürlüğümüz bakar. ").when(k == 2, "Gazi Eğitim Fakültesi öğrencisiyim. ").otherwise("Gazi Eğitim Fakültesi ve Gazi kapısı. ")
    writer = F.when(k == 0, "kurum").when(k == 1, "vatandas").otherwise("ogrenci")
    rows = table(s, d, "conversations").select("conv_id", "turn", F.concat(phrase, F.coalesce("text", F.lit(""))).alias("text"), writer.alias("writer"))
    found = F.concat(lint.first_person(F.col("text"), F.col("writer")), lint.office_words(F.col("text"), F.col("writer")), lint.names(F.col("text"), F.array(F.lit("Gazi")), F.col("writer")))
    return rows.select("conv_id", "turn", F.array_join(F.transform(found, lambda x: x["rule_id"]), ",").alias("found"))


@query(
    "t7_t9_coverage_structure",
    r"""WITH n AS (SELECT doc_id, text, translate(lower(translate(translate(coalesce(text, ''), '''’ʼ', ''), 'İI', 'iı')), 'âîû', 'aiu') AS x FROM documents)
SELECT doc_id, contains(x, 'license') OR len(list_filter(regexp_extract_all(x, '[\p{L}\p{M}\p{Nd}\p{Pc}]+'), lambda w: length(w) > 3 AND (starts_with(substr(w, 1, 5), 'licen') OR starts_with('licen', substr(w, 1, 5))))) > 0 AS covered,
  CASE WHEN len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(13)) <> '')) <> 3 THEN 'BCM-01' ELSE '' END AS structure FROM n""",
)
def t7(s, d):
    """A key term that some documents cover, and three wanted paragraphs (lines)."""
    rows = spread(table(s, d, "documents").select("doc_id", "text"))
    apart = F.regexp_replace("text", "\n", "\n \n")
    missing = F.filter(lint.structure(apart, F.array(F.lit(1), F.lit(1), F.lit(1))), lambda x: x["rule_id"] == "BCM-01")
    return rows.select("doc_id", (F.size(lint.coverage(F.col("text"), F.array(F.lit("license")))) == 0).alias("covered"), F.coalesce(t.nth(F.transform(missing, lambda x: x["rule_id"]), 1), F.lit("")).alias("structure"))


@query(
    "t8_attachments_references",
    "SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'EK-01,ILG-03' WHEN 1 THEN '' WHEN 2 THEN 'EK-02' ELSE 'ILG-02' END AS found FROM conversations",
)
def t8(s, d):
    """Whole turns, behind or before phrases on attachments and references."""
    k, text = F.col("conv_id") % 4, F.coalesce("text", F.lit(""))
    whole = F.when(k == 1, F.concat(F.lit("İlgi yazı okundu, liste ekte sunulmuştur. "), text)).when(k == 2, F.concat(text, F.lit(" Liste ekte sunulmuştur."))).when(k == 3, F.concat(text, F.lit(" İlgi'de kayıtlı yazı okundu."))).otherwise(text)
    rows = table(s, d, "conversations").select("conv_id", "turn", whole.alias("text"), k.isin(0, 1).alias("attachment"), k.isin(0, 1).alias("reference"))
    found = F.concat(lint.attachments(F.col("text"), F.col("attachment"), F.lit(None).cast("string")), lint.references(F.col("text"), F.col("reference")))
    return rows.select("conv_id", "turn", F.array_join(F.transform(found, lambda x: x["rule_id"]), ",").alias("found"))


_SUFFIXES = re.search(r"\(\?:([^)]*)\)", lint.FIRST_PERSON)[1]
_FORM_TESTS = ", ".join("{'r': 'BIC-01', 's': 'hata', 'k': CAST(regexp_matches(text, '" + in_re2(p) + "') AS BIGINT)}" for p, _ in lint.FORMS)
_FORBIDDEN = ", ".join("{'r': 'ME-02', 's': 'hata', 'k': CAST(contains(n, '" + w + "') AS BIGINT)}" for w in lint.FORBIDDEN_CLOSINGS)
_BEFORE, _AFTER = f"(?:^|[^{WORD}])", f"(?:$|[^{WORD}])"


@query(
    "t_full_lint",
    rf"""WITH x AS (SELECT doc_id, coalesce(text, '') AS text, {STRIPPED} AS t FROM documents), y AS (SELECT *, translate(lower(translate(translate(t, '''’ʼ', ''), 'İI', 'iı')), 'âîû', 'aiu') AS n FROM x),
z AS (SELECT *, regexp_matches(n, 'arz ederim[{WHITE}]*\.?[{WHITE}]*$') AS has, regexp_matches(n, '(?:arz[\t-\r ]*(?:ve|/)[\t-\r ]*rica ederim|bilgilerinize sunulur|saygılarımla|saygılarımı sunarım|arz ederim|rica ederim)[{WHITE}]*\.?[{WHITE}]*$') AS other,
  regexp_extract_all(regexp_replace(n, '{in_re2(lint.CLOSING_TAIL.replace("$", ""))}$', ''), '[{WORD}]+') AS words FROM y),
f AS (SELECT doc_id, unnest([{{'r': 'TAM-01', 's': 'hata', 'k': CAST(t = '' OR NOT regexp_matches(t, '[.!?]$') AS BIGINT)}},
  {{'r': 'TAM-01', 's': 'uyari', 'k': CAST({SHORT} AS BIGINT)}}, {_FORM_TESTS}, {_FORBIDDEN},
  {{'r': 'ME-02', 's': 'uyari', 'k': CAST(contains(n, 'önem arz et') AS BIGINT)}}, {{'r': 'ME-03', 's': 'hata', 'k': CAST(NOT has AND other AS BIGINT)}}, {{'r': 'ME-02', 's': 'hata', 'k': CAST(NOT has AND NOT other AS BIGINT)}},
  {{'r': 'K13.1', 's': 'hata', 'k': CAST(len(list_filter(words, lambda w: regexp_full_match(w, '[{WORD}]{{2,}}(?:{_SUFFIXES})'))) + len(list_filter(words, lambda w: regexp_full_match(w, '[{WORD}]{{2,}}(?:{"|".join(lint.PAST_SUFFIXES)})') AND NOT list_contains({_listed(lint.NOT_VERBS)}, w) AND list_contains({_listed(lint.PAST_STEMS)}, substr(w, 1, length(w) - 3))))
    + len(list_filter(words, lambda w: list_contains({_listed(w for w in lint.FIRST_PERSON_WORDS if not w.endswith(tuple(lint.PAST_SUFFIXES)))}, w))) AS BIGINT)}},
  {{'r': 'EK-02', 's': 'hata', 'k': CAST(regexp_matches(n, '{_BEFORE}(?:ekte|ekinde|ekimizde|ilişikte|ilişiğinde|ek olarak|ekli{_AFTER}|yazımız ekind|ekled[{WORD}]|ekliyor|eklenmiş|eke dâhil|eke dahil)') AS BIGINT)}},
  {{'r': 'ILG-02', 's': 'hata', 'k': CAST(regexp_matches(n, '{_BEFORE}ilgi(?:de|ye|nde)?{_AFTER}') AS BIGINT)}}]) AS f FROM z)
SELECT f.r AS rule_id, f.s AS severity, CAST(sum(f.k) AS BIGINT) AS n, count(DISTINCT doc_id) AS docs FROM f WHERE f.k > 0 GROUP BY ALL""",
)
def t_full(s, d):
    """All groups of checks over whole documents, and their counts."""
    bodies = spread(table(s, d, "documents").select("doc_id", "text")).select("*", F.lit("kurum").alias("writer"), F.lit("ust").alias("direction"), F.lit(False).alias("attachment"), F.lit(False).alias("reference"))
    return corpus.body_audit(lint.lint(bodies))


@query("t11_draft_checks", "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'YZ-02' WHEN 1 THEN 'YZ-01' ELSE '' END AS found FROM conversations")
def t11(s, d):
    """Whole turns with two closings, a claim of a sent attachment, or one closing at their end."""
    k = F.col("conv_id") % 3
    text = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, " Arz ederim. Rica ederim.").when(k == 1, " Ekte liste gönderilmiştir. Arz ederim.").otherwise(" Arz ederim."))
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(lint.draft_checks(text), lambda x: x["rule_id"]), ",").alias("found"))


@query(
    "b5_break_reference",
    f"""WITH o AS (SELECT conv_id, turn, {_listed(corpus.OPENINGS)}[CAST(conv_id % {len(corpus.OPENINGS)} + 1 AS INT)] AS opening, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, turn, md5(CASE conv_id % 3 WHEN 0 THEN opening || ' istenen bilgi hazırdır. ' || text WHEN 1 THEN opening || ' ' || text || ' bakıldı.' END) AS broken FROM o""",
)
def b5(s, d):
    """Whole turns with a reference before or behind them; one in three has a mention that can't be taken out."""
    k, text = F.col("conv_id") % 3, F.coalesce("text", F.lit(""))
    whole = F.when(k == 0, F.concat(F.lit("İlgide kayıtlı yazı ile istenen bilgi hazırdır. "), text)).when(k == 1, F.concat(text, F.lit(" ilgi yazınız üzerine, bakıldı."))).otherwise(F.concat(text, F.lit(" Son söz ilgiye bırakıldı.")))
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(corpus.break_reference(whole, F.col("conv_id"))).alias("broken"))


# --- matching and evidence


@query(
    "j14_match_answers",
    """WITH f AS (SELECT source AS batch, doc_id, CASE WHEN source IN (SELECT max(source) FROM documents) THEN -doc_id ELSE doc_id END AS ord, length(trim(coalesce(text, ''))) AS size FROM documents WHERE doc_id % 7 <> 2),
g AS (SELECT batch, doc_id, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END AS n, ord, size FROM f), e AS (SELECT source AS batch, doc_id FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT coalesce(e.batch, g.batch) AS batch, e.doc_id AS wanted, g.* EXCLUDE (batch) FROM e FULL JOIN g ON g.batch = e.batch AND g.doc_id = e.doc_id)
SELECT batch, CAST(sum(CASE WHEN ord IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN wanted IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS extra, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated,
  max(ord) FILTER (wanted IS NOT NULL) < 0 AND count(ord) FILTER (wanted IS NOT NULL) > 1 AS out_of_order, CAST(sum(CASE WHEN size > 0 AND size < 80 THEN 1 ELSE 0 END) AS BIGINT) AS short, CAST(sum(CASE WHEN size = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM b GROUP BY batch""",
)
def j14(s, d):
    """Expected and found answers that differ: absent, unasked, repeated ones, and one batch in the reverse order."""
    docs = table(s, d, "documents").select(F.col("source").alias("batch"), "doc_id", F.col("doc_id").cast("string").alias("doc_no"), F.trim(F.coalesce("text", F.lit(""))).alias("body"))
    last = docs.agg(F.max("batch").alias("last"))
    found = docs.where("doc_id % 7 <> 2").join(F.broadcast(last)).withColumn("ord", F.when(F.col("batch") == F.col("last"), -F.col("doc_id")).otherwise(F.col("doc_id"))).drop("last")
    found = found.unionByName(found.where("doc_id % 11 = 0"))
    expected = docs.where("doc_id % 10 <> 3").select("batch", "doc_no", F.col("doc_id").alias("ord"))
    return matching.match_answers(expected, found.select("batch", "doc_no", "ord", "body")).drop("long_preamble")


@query(
    "j16_verify_quote",
    f"""WITH d AS (SELECT doc_id, {FOLD} AS body FROM documents), q AS (SELECT item_id, {FOLD} AS quote FROM benchmark)
SELECT doc_id, item_id, 'govde' AS stands FROM d JOIN q ON length(quote) >= 8 AND contains(body, quote)""",
)
def j16(s, d):
    """Every benchmark passage looked for in every whole document."""
    docs = spread(table(s, d, "documents").select("doc_id", F.col("text").alias("body"), F.col("text").alias("raw")))
    items = table(s, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return matching.verify_quotes(docs, items.select("quote")).join(items, "quote").select("doc_id", "item_id", "stands")


@query("j17_verify_evidence")
def j17(s, d):
    """Every sentence of every whole turn looked for in the turn before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(s, d, "conversations").withColumn("body", before).where("body is not null").select("conv_id", "turn", "body", F.posexplode(t.sentences(F.col("text"))).alias("place", "sentence"))
    return matching.verify_evidence(spread_rows(rows), "sentence", "body").select("conv_id", "turn", "place", "evidence", "dropped")


def spread_rows(rows):
    """Rows dealt over the session's shuffle partitions, for row-heavy work behind a window of few groups."""
    return rows.repartition("conv_id", "turn", "place")


@query("j9_fuzzy_terms")
def j9(s, d):
    """Benchmark passages in the documents that share a five-word shingle with one: exactly, folded, or by windows."""
    docs = spread(table(s, d, "documents").select("doc_id", "text"))
    keyed = lambda rows, key: rows.select(key, F.explode(F.array_distinct(t.shingles(t.words_of(t.fold(F.col("text"))), 5))).alias("g"))
    pairs = keyed(docs, "doc_id").join(keyed(table(s, d, "benchmark"), "item_id"), "g").select("doc_id", "item_id").distinct()
    terms = pairs.join(table(s, d, "benchmark").select("item_id", F.col("text").alias("term")), "item_id").select("doc_id", "term")
    return evaluate.term_recall(docs, terms)


@query(
    "e17_copy_ratio",
    f"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM conversations), w AS (SELECT conv_id, turn, string_split({FOLD}, ' ') AS a, string_split({FOLD.replace("(text,", "(src,")}, ' ') AS b FROM c),
g AS (SELECT conv_id, turn, list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) AS own, list_transform(range(1, len(b) - 3), lambda i: array_to_string(b[i:i + 4], ' ')) AS other FROM w),
o AS (SELECT conv_id, turn, unnest(own) AS x FROM g), p AS (SELECT DISTINCT conv_id, turn, x FROM (SELECT conv_id, turn, unnest(other) AS x FROM g)), h AS (SELECT conv_id, turn, count(*) AS n FROM o JOIN p USING (conv_id, turn, x) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN len(own) > 0 AND len(other) > 0 THEN coalesce(n, 0) / len(own) ELSE 0 END, 9) AS ratio FROM g LEFT JOIN h USING (conv_id, turn)""",
)
def e17(s, d):
    """Each answer against the turn before it."""
    rows = table(s, d, "conversations").withColumn("src", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", F.round(evaluate.copy_ratio(F.col("text"), F.col("src")), 9).alias("ratio"))


# --- dimensions

CLIMB = """climb AS (
  SELECT code, code AS here, [code] AS seen, false AS met FROM u UNION ALL
  SELECT c.code, u.parent_code, list_append(c.seen, u.parent_code), list_contains(c.seen, u.parent_code) FROM climb c JOIN u ON u.code = c.here WHERE NOT c.met AND u.parent_code IS NOT NULL)
SELECT code, arg_max(here, len(seen)) AS root FROM climb GROUP BY code"""
BODIES = """bodies AS (SELECT 'C' || CAST(c_custkey % 997 AS VARCHAR) AS code, CASE WHEN c_custkey % 53 = 0 THEN ' ' ELSE c_name END AS name, 'U' || CAST(c_nationkey + CASE WHEN c_custkey % 31 = 0 THEN 100 ELSE 0 END AS VARCHAR) AS parent_code, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey - c_custkey % 7 AS VARCHAR) END AS detsis_no FROM customer
  UNION ALL SELECT 'U' || CAST(n_nationkey AS VARCHAR), n_name, 'R' || CAST(n_regionkey AS VARCHAR), NULL FROM nation UNION ALL SELECT 'R' || CAST(r_regionkey AS VARCHAR), r_name, NULL, NULL FROM region)"""


def _bodies(s, d):
    """Customers under nations under regions, with repeated codes and ids, blank names and unknown parents as the keys give them."""
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    customers = table(s, d, "customer").select(
        F.concat(F.lit("C"), text(k % 997)).alias("code"), F.when(k % 53 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.concat(F.lit("U"), text(F.col("c_nationkey") + F.when(k % 31 == 0, 100).otherwise(0))).alias("parent_code"), F.when(k % 3 > 0, text(k - k % 7)).alias("detsis_no")
    )
    nations = table(s, d, "nation").select(F.concat(F.lit("U"), text(F.col("n_nationkey"))), "n_name", F.concat(F.lit("R"), text(F.col("n_regionkey"))), F.lit(None).cast("string"))
    regions = table(s, d, "region").select(F.concat(F.lit("R"), text(F.col("r_regionkey"))), "r_name", F.lit(None).cast("string"), F.lit(None).cast("string"))
    return customers.union(nations).union(regions)


@query(
    "q6_audit_units",
    f"""WITH {BODIES} SELECT 'repeated_code' AS problem, min(code) AS code FROM bodies GROUP BY bodies.code HAVING count(*) > 1 UNION ALL SELECT 'repeated_detsis_no', min(code) FROM bodies WHERE detsis_no IS NOT NULL GROUP BY detsis_no HAVING count(*) > 1
UNION ALL SELECT 'unknown_parent', code FROM bodies WHERE parent_code IS NOT NULL AND parent_code NOT IN (SELECT code FROM bodies) UNION ALL SELECT 'empty_name', code FROM bodies WHERE trim(name) = ''""",
)
def q6(s, d):
    return dimensions.audit_units(_bodies(s, d))


@query(
    "j1_root_institution",
    f"""WITH RECURSIVE {BODIES}, u AS (SELECT code, min(parent_code) AS parent_code FROM bodies GROUP BY code), {CLIMB}""",
)
def j1(s, d):
    """The root of every body, three levels up at most; unknown parents end the climb."""
    return dimensions.root_institution(_bodies(s, d))


@query(
    "j1_deep_chains",
    f"""WITH RECURSIVE u AS (
  SELECT CAST(c_custkey AS VARCHAR) AS code, CASE WHEN c_custkey % 100 > 0 THEN CAST(c_custkey - 1 AS VARCHAR) WHEN c_custkey % 300 = 0 THEN CAST(c_custkey + 40 AS VARCHAR) WHEN c_custkey % 300 = 100 THEN 'X' || CAST(c_custkey AS VARCHAR) END AS parent_code
  FROM customer), {CLIMB}""",
)
def j1_deep(s, d):
    """Customers in chains of 100: a third of them under a root, a third under an unknown parent, a third with a cycle of 41 at the top."""
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    parent = F.when(k % 100 > 0, text(k - 1)).when(k % 300 == 0, text(k + 40)).when(k % 300 == 100, F.concat(F.lit("X"), text(k)))
    return dimensions.root_institution(table(s, d, "customer").select(text(k).alias("code"), parent.alias("parent_code")))


@query("j6_alias_candidates", "SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'ikinci ' || c_name FROM customer WHERE c_custkey % 3 = 0")
def j6(s, d):
    """Second names of two customers in three, of which one repeats a first name."""
    k = F.col("c_custkey")
    units = table(s, d, "customer").select(k.cast("string").alias("code"), F.col("c_name").alias("name"), F.lit(0).alias("level"))
    second = table(s, d, "customer").where("c_custkey % 3 < 2").select(k.cast("string").alias("code"), F.when(k % 3 == 0, F.concat(F.lit("ikinci "), F.col("c_name"))).otherwise(F.upper("c_name")).alias("name"))
    return matching.alias_candidates(units, second).select("code", "name")


# --- decisions, actions, samples


@query(
    "d3_candidates",
    """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'N' || nation END AS a, CASE WHEN doc_id % 3 = 0 THEN 'N' || (nation + 1) ELSE 'N' || nation END AS target, ['N' || nation, 'N' || (nation + 2), 'N' || (nation + 2), 'N' || (nation + 3), 'N' || (nation + 4), 'N' || (nation + 5), 'N' || (nation + 6)] AS s FROM letters),
u AS (SELECT doc_id, target, unnest(list_concat([target, a], s)) AS unit, generate_subscripts(list_concat([target, a], s), 1) AS i FROM x), f AS (SELECT doc_id, target, unit, min(i) AS i FROM u WHERE unit IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
SELECT doc_id, string_agg(unit || CASE WHEN unit = target THEN '+' ELSE '' END, ',' ORDER BY r) AS candidates FROM r WHERE r <= 5 GROUP BY doc_id""",
    ("letters",),
)
def d3(s, d):
    n = lambda k: F.concat(F.lit("N"), (F.col("nation") + k).cast("string"))
    target, addressee = F.when(F.col("doc_id") % 3 == 0, n(1)).otherwise(n(0)), F.when(F.col("doc_id") % 4 != 0, n(0))
    found = routing.candidate_list(target, addressee, F.array(n(0), n(2), n(2), n(3), n(4), n(5), n(6)))
    return view(s, d, "letters").select("doc_id", F.array_join(F.transform(found, lambda x: F.concat(x["unit"], F.when(x["score"] > 0, "+").otherwise(""))), ",").alias("candidates"))


@query(
    "g7_apply_actions",
    """WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, action_id) AS rn FROM actions),
s AS (SELECT doc_id, CAST(0 AS BIGINT) AS rn, 'insan_onayi_bekliyor' AS status, CAST(NULL AS VARCHAR) AS decision, 'N0' AS unit, 0 AS corrections, 0 AS accepted, 0 AS rejected FROM (SELECT DISTINCT doc_id FROM actions)
UNION ALL SELECT doc_id, rn, CASE WHEN bar THEN status WHEN action = 'onayla' THEN 'onaylandi' WHEN action = 'reddet' THEN 'reddedildi' WHEN action = 'karari_geri_al' THEN 'insan_onayi_bekliyor' ELSE status END,
  CASE WHEN bar THEN decision WHEN action = 'onayla' THEN 'onaylandi' WHEN action = 'reddet' THEN 'reddedildi' WHEN action = 'birim_degistir' THEN 'birim_degistirildi' WHEN action = 'karari_geri_al' THEN NULL ELSE decision END,
  CASE WHEN NOT bar AND action = 'birim_degistir' THEN new_unit ELSE unit END, corrections + CASE WHEN NOT bar AND action IN ('reddet', 'birim_degistir', 'taslak_kaydet') THEN 1 ELSE 0 END, accepted + CASE WHEN bar THEN 0 ELSE 1 END, rejected + CASE WHEN bar THEN 1 ELSE 0 END
FROM (SELECT s.*, a.action, a.new_unit, s.rn + 1 AS next, a.role NOT IN (ROLES) OR (a.action IN (REASONED) AND trim(coalesce(a.reason, '')) = '') OR (a.action IN ('onayla', 'reddet') AND s.status NOT IN (OPENS)) OR (a.action = 'birim_degistir' AND a.new_unit IS NULL)
  OR (a.action = 'karari_geri_al' AND (a.role <> 'yonetici' OR s.status IN (OPENS))) AS bar FROM s JOIN a ON a.doc_id = s.doc_id AND a.rn = s.rn + 1) t(doc_id, old, status, decision, unit, corrections, accepted, rejected, action, new_unit, rn, bar))
SELECT doc_id, status, decision, unit, CAST(corrections AS INT) AS corrections, CAST(accepted AS INT) AS accepted, CAST(rejected AS INT) AS rejected FROM s WHERE rn = (SELECT count(*) FROM a WHERE a.doc_id = s.doc_id)""".replace("ROLES", _listed(register.APPROVERS)[1:-1]).replace("REASONED", _listed(register.NEEDS_REASON)[1:-1]).replace("OPENS", _listed(register.OPEN)[1:-1]),
    ("actions",),
)
def g7(s, d):
    actions = view(s, d, "actions")
    docs = actions.select("doc_id").distinct().select("doc_id", F.lit("insan_onayi_bekliyor").alias("status"), F.lit("N0").alias("unit"))
    return register.apply_actions(docs, actions).withColumn("rejected", F.size("rejected"))


@query(
    "q1_repeated_sentences",
    r"""WITH s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\n', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS sentence FROM documents)
SELECT md5(sentence) AS sentence, count(*) AS n, count(DISTINCT doc_id) AS docs FROM s WHERE length(sentence) > 25 GROUP BY s.sentence HAVING count(*) > 1""",
)
def q1(s, d):
    found = corpus.repeated_sentences(spread(table(s, d, "documents").select("doc_id", "text")))
    return found.select(F.md5("sentence").alias("sentence"), "n", "docs")


@query(
    "p1_class_covering",
    "WITH c AS (SELECT source AS class, count(*) AS size FROM documents GROUP BY 1), r AS (SELECT class, size, unnest(range(1, size + 1)) AS round FROM c), o AS (SELECT class, round, row_number() OVER (ORDER BY round, size DESC, class) AS place FROM r) SELECT class, count(*) AS n, max(round) AS rounds FROM o WHERE place <= 40 GROUP BY class",
)
def p1(s, d):
    """How many of each class a class-covering sample of 40 takes."""
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("class"))
    return sampling.class_covering(rows, 40).groupBy("class").agg(F.count_distinct("id").alias("n"), F.max("round").cast("long").alias("rounds"))


# --- board, costs and audits


@query(
    "a1_totals",
    """WITH x AS (SELECT *, (doc_id % 211) * 1.5 AS ms FROM decisions WHERE doc_id % 7 <> 0), r AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS r, count(*) OVER () AS n FROM x)
SELECT count(*) AS n, round(avg(CASE WHEN score >= 0.85 THEN 1.0 ELSE 0.0 END), 9) AS auto_rate, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN critical_missing > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_critical,
  CAST(median(ms) AS DOUBLE) AS median_ms, (SELECT CAST(ms AS DOUBLE) FROM r WHERE r = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))) AS p95_ms FROM x""",
    ("decisions",),
)
def a1(s, d):
    status = F.when(F.col("doc_id") % 7 == 0, "hata").when(F.col("doc_id") % 2 == 0, "insan_onayi_bekliyor").otherwise("onaylandi")
    docs = view(s, d, "decisions").select("doc_id", status.alias("status"), (F.col("score") >= 0.85).alias("auto"), F.lit(False).alias("corrected"), ((F.col("doc_id") % 211) * 1.5).alias("ms"), F.col("critical_missing").alias("critical"), F.lit(1.0).alias("waiting_s"))
    return board.totals(docs).select("n", F.round("auto_rate", 9).alias("auto_rate"), "pending", "with_critical", F.col("median_ms").cast("double").alias("median_ms"), F.col("p95_ms").cast("double").alias("p95_ms"))


@query(
    "e19_call_costs",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type AS model, max(n) AS calls, round(avg(value), 6) AS mean_tokens, max(CASE WHEN r = least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) THEN value END) AS p50, max(CASE WHEN r = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN value END) AS p95 FROM r GROUP BY 1""",
)
def e19(s, d):
    calls = table(s, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("tokens"), F.lit(1).alias("candidates"), F.col("value").alias("ms"))
    return evaluate.call_costs(calls).select("model", "calls", F.round("mean_tokens", 6).alias("mean_tokens"), "p50", "p95")


@query("e10_unknown_senders", "SELECT sender, count(*) AS n FROM letters WHERE doc_id % 3 <> 1 GROUP BY 1 ORDER BY n DESC, sender LIMIT 20", ("letters",))
def e10u(s, d):
    k = F.col("doc_id") % 3
    return evaluate.unknown_senders(view(s, d, "letters").select("sender", F.when(k == 1, "ust").when(k == 2, "bulunamadi").alias("position")))


@query(
    "q1_diversity",
    r"""WITH s AS (SELECT lower(trim(unnest(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\n', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))))) AS x FROM documents), c AS (SELECT x, count(*) AS c FROM s WHERE length(x) > 25 GROUP BY x),
h AS (SELECT sum(CASE WHEN c > 1 THEN c ELSE 0 END) / greatest(sum(c), 1) AS share FROM c), b AS (SELECT count(*) AS n, count(DISTINCT trim(split_part(coalesce(text, ''), '.', 1))) AS firsts, CAST(min(length(text)) AS INT) AS min_chars, round(avg(length(text)), 6) AS mean_chars, CAST(max(length(text)) AS INT) AS max_chars,
  round(avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))), 6) AS mean_words FROM documents)
SELECT n, firsts, min_chars, mean_chars, max_chars, mean_words, round(share, 9) AS repeated_share, share > 0.30 AS repetitive, NOT share > 0.30 AND firsts < 0.9 * n AS few_firsts FROM b, h""",
)
def q1d(s, d):
    out = corpus.diversity(spread(table(s, d, "documents").select("doc_id", "text")))
    return out.select("n", "firsts", "min_chars", F.round("mean_chars", 6).alias("mean_chars"), "max_chars", F.round("mean_words", 6).alias("mean_words"), F.round("repeated_share", 9).alias("repeated_share"), "repetitive", "few_firsts")


@query(
    "e3_invented",
    """SELECT CASE doc_id % 3 WHEN 0 THEN 'sdp_uyumsuz' WHEN 1 THEN 'muhatap_belirsiz' ELSE 'konu_eksik' END AS defect, count(*) AS n,
  CAST(sum(CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END ELSE CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END END) AS BIGINT) AS "right" FROM letters GROUP BY 1""",
    ("letters",),
)
def e3(s, d):
    k, rows = F.col("doc_id"), view(s, d, "letters")
    defect = F.when(k % 3 == 0, "sdp_uyumsuz").when(k % 3 == 1, "muhatap_belirsiz").otherwise("konu_eksik")
    labels = rows.select("doc_id", defect.alias("defect"), F.lit("alan").alias("removed_field"), F.col("addressee").alias("true_value"), F.lit("broken").alias("injected"))
    value = F.when(k % 3 == 0, F.when(k % 2 == 0, "broken").otherwise("mended")).when(k % 3 == 1, F.when(k % 5 == 0, F.concat(F.lit("Sayın "), F.lower("addressee"))).when(k % 5 == 1, "İlgili Makam")).otherwise(F.when(k % 4 == 0, " ").otherwise("x"))
    return evaluate.invented(rows.select("doc_id", F.create_map(F.lit("alan"), value).alias("values")), labels).select("defect", "n", "right")


@query(
    "r10_code_conflict",
    r"""WITH x AS (SELECT doc_id, nation, subject, nullif(regexp_extract(number, '^E-\d{8}-([\d.]+)-', 1), '') AS code, substr(subject, 1, 1) AS digit FROM letters), s AS (SELECT *, CASE WHEN nation % 2 = 0 AND digit IN ('1', '2') THEN '10' || digit WHEN nation % 2 = 1 AND digit = '3' THEN '103' END AS own FROM x)
SELECT doc_id, CASE WHEN code IS NULL THEN 'alan_bos' WHEN own IS NULL THEN 'veri_yok' WHEN code <> own THEN 'ihlal' ELSE 'uygun' END AS status FROM s""",
    ("letters",),
)
def r10(s, d):
    """The code in the number against the code of the subject, looked for among the codes of the addressee's unit alone."""
    subjects = {"101": ["1-URGENT"], "102": ["2-HIGH"], "103": ["3-MEDIUM"]}
    catalog = s.createDataFrame([(code, int(code), None, found) for code, found in subjects.items()], "code string, ord int, name string, subjects array<string>")
    units = table(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("101"), F.lit("102"))).otherwise(F.array(F.lit("103"))).alias("sdp_codes"))
    docs = view(s, d, "letters").select("doc_id", F.concat(F.lit("N"), F.col("nation").cast("string")).alias("addressee_unit"), "subject", t.number_parts(F.col("number"))["sdp"].alias("number_code"), "belge_turu")
    docs = docs.join(matching.narrowed_codes(docs, units, catalog), "doc_id", "left")
    one = [rules.Rule("S-07", "ozel_fonksiyon", path="number_code", other_path="subject_code", function="kod_uyumu")]
    return rules.run_rules(docs, one).select("doc_id", "status")


@query(
    "q5_label_problems",
    """SELECT doc_id, 'ilgi_kopuk_without_reference' AS problem FROM letters WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'official_defect_in_petition' FROM letters WHERE doc_id % 4 = 1 AND family = 'P'
UNION ALL SELECT doc_id, 'petition_with_number' FROM letters WHERE family = 'P' AND number IS NOT NULL UNION ALL SELECT doc_id, 'letter_without_number' FROM letters WHERE family <> 'P' AND number IS NULL UNION ALL SELECT doc_id, 'reference_not_before_letter' FROM letters WHERE doc_id % 3 = 0 AND doc_id % 5 = 0""",
    ("letters",),
)
def q5l(s, d):
    k = F.col("doc_id")
    labels = view(s, d, "letters").select("doc_id", F.when(k % 4 == 0, "ilgi_kopuk").when(k % 4 == 1, "konu_eksik").alias("defect"), (k % 3 == 0).alias("has_reference"), F.lit(False).alias("has_attachment"), F.lit("metin").alias("format"), F.when(F.col("family") == "P", "vatandas").otherwise("kurum").alias("writer"), "number", "day", F.when(k % 5 == 0, F.col("day")).otherwise(F.date_sub("day", 3)).alias("reference_day"))
    return corpus.label_problems(labels)


CATALOG = """catalog AS (SELECT p_partkey AS k, CAST(100 + p_partkey % 40 AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.0' || (p_partkey % 4 + 1) ELSE '.1' END AS code, CASE WHEN p_partkey % 7 = 0 THEN '999' ELSE CAST(100 + p_partkey % 40 AS VARCHAR) END AS main_group,
  CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS level, CASE WHEN p_partkey % 5 = 0 THEN 'ortak' ELSE 'kuruma_ozel' END AS scope, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 13 = 0 THEN 'hepsi' ELSE 'belediye' END AS kind, CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 3 END AS n FROM part)"""


@query(
    "q7_audit_catalog",
    f"""WITH {CATALOG}, u AS (SELECT 'form' AS problem, code FROM catalog WHERE NOT regexp_matches(code, '^\\d{{3}}(\\.\\d{{2}}){{0,3}}$') UNION ALL SELECT 'subjects', code FROM catalog WHERE n <> 3 UNION ALL SELECT 'main_group', code FROM catalog WHERE main_group <> substr(code, 1, 3)
UNION ALL SELECT 'kind', code FROM catalog WHERE (scope = 'ortak') <> (kind = 'hepsi') UNION ALL SELECT 'repeated_code', code FROM catalog GROUP BY code HAVING count(*) > 1
UNION ALL SELECT 'parent_absent', code FROM catalog WHERE regexp_matches(code, '^\\d+\\.\\d\\d$') AND substr(code, 1, 3) NOT IN (SELECT code FROM catalog)) SELECT problem, code, count(*) AS n FROM u GROUP BY ALL""",
)
def q7(s, d):
    """Codes, derived columns, scopes and subjects that the part keys get right in most rows."""
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    group = text(k % 40 + 100)
    code = F.concat(group, F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(".0"), text(k % 4 + 1))).otherwise(".1"))
    words = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    rows = table(s, d, "part").select(
        code.alias("code"), F.when(k % 7 == 0, "999").otherwise(group).alias("main_group"), F.when(k % 3 == 0, 1).otherwise(2).alias("level"), F.when(k % 5 == 0, "ortak").otherwise("kuruma_ozel").alias("scope"),
        F.when((k % 5 == 0) | (k % 13 == 0), "hepsi").otherwise("belediye").alias("kind"), F.when(k % 11 == 0, F.slice(words, 1, 2)).otherwise(words).alias("subjects"),
    )
    return dimensions.audit_catalog(rows).groupBy("problem", "code").agg(F.count("*").alias("n"))


@query(
    "q6_audit_profiles",
    """WITH f AS (SELECT CAST(c_nationkey AS VARCHAR) AS institution, c_name AS body, CASE c_custkey % 5 WHEN 0 THEN 'rica' WHEN 1 THEN 'bilgi' ELSE 'arz' END AS form, c_custkey AS k FROM customer), u AS (SELECT lower(s_name) AS name FROM supplier)
SELECT problem, code, count(*) AS n FROM (SELECT 'no_profile' AS problem, CAST(n_nationkey AS VARCHAR) AS code FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'body_without_id', institution FROM f WHERE k % 9 = 0
UNION ALL SELECT DISTINCT 'body_with_two_ids', institution FROM f WHERE k % 10 = 3 AND k % 9 <> 0 UNION ALL SELECT 'unknown_form', institution FROM f WHERE form = 'bilgi' UNION ALL SELECT 'rica_for_a_unit', institution FROM f WHERE form = 'rica' AND k % 2 = 0
UNION ALL SELECT DISTINCT 'body_without_form', institution FROM f WHERE k % 6 = 0) GROUP BY ALL""",
)
def q6p(s, d):
    """Profiles of the nations: their customers as bodies, some without an id, with two ids, without a form, or named as a unit."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string").alias("institution")
    customer = table(s, d, "customer")
    body = F.when((k % 5 == 0) & (k % 2 == 0), "Tek Birim").otherwise(F.col("c_name"))
    forms = customer.select(nation, body.alias("body"), F.when(k % 5 == 0, "rica").when(k % 5 == 1, "bilgi").otherwise("arz").alias("form"))
    ids = customer.select(nation, F.col("c_name").alias("name"), F.when(k % 9 == 0, " ").otherwise(k.cast("string")).alias("detsis_no"), k.alias("k"))
    bodies = ids.drop("k").unionByName(ids.where("k % 10 = 3").select("institution", "name", F.lit("x").alias("detsis_no")))
    hierarchy = customer.where("c_custkey % 6 = 0").select(nation, F.concat("c_name", F.lit(" başka")).alias("body"))
    units = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.lit("TEK BİRİM").alias("name"), F.lit(0).alias("level"))
    profiles = table(s, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").cast("string").alias("institution"))
    return dimensions.audit_profiles(units, profiles, forms, bodies, hierarchy).groupBy("problem", "code").agg(F.count("*").alias("n"))
