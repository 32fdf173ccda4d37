"""The registered queries of the library, each over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import board, corpus, evaluate, lines, lint, matching, register, routing, rules, sampling
from ..sources import dimensions, readers
from .views import spread, table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RULES = [
    rules.Rule("B-01", "bos_olmamali", path="number", severity="hata", title="number present", basis="Y 16"),
    rules.Rule("S-01", "regex_bulunmali", path="number", pattern=r"^E-\d{8}-", severity="uyari", title="number form", basis="Y 12"),
    rules.Rule("S-02", "regex_bulunmamali", path="subject", pattern=r"SPECIFIED", severity="bilgi", title="subject specified", basis="K 3"),
    rules.Rule("T-01", "izinli_kume", path="family", allowed=("O", "F"), severity="hata", title="family known", scope="kurum_yazisi"),
    rules.Rule("T-02", "sozluk", path="subject", dictionary=("urgent", "high"), severity="uyari", title="plain subject", scope="dilekce"),
    rules.Rule("M-01", "alan_esitligi", path="addressee", other_path="sender", severity="hata", title="own addressee"),
    rules.Rule("G-01", "bos_olmamali", path="sender", path_out="sender", targets=("giden",), severity="hata", title="outgoing only"),
    rules.Rule("Y-01", "bos_olmamali", path="absent", severity="hata", title="no such path"),
]
CATEGORIES = {"kurum_yazisi": ["genelge", "cevap_yazisi"]}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def put(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql, *views) if views else sql
        return fn

    return put


# --- text functions


FOLD = "trim(regexp_replace(lower(translate(text, 'ÀÁÃÄÅÈÉÊËÌÍÏÑÒÓÔÕÙÚÝàáãäåèéêëìíïñòóôõùúýÿİIıŞşĞğÇçÖöÜüÂâÎîÛû', 'AAAAAEEEEIIINOOOOUUYaaaaaeeeeiiinoooouuyyiiissggccoouuaaiiuu')), '\\s+', ' ', 'g'))"


@query("n1_fold", f"SELECT doc_id, {FOLD} AS folded FROM documents")
def n1(s, d):
    return spread(table(s, d, "documents")).select("doc_id", t.fold(F.col("text")).alias("folded"))


@query("n2_fold_hard", f"SELECT doc_id, trim(regexp_replace(translate({FOLD}, '1l|0', 'iiio'), '\\s+', ' ', 'g')) AS folded FROM documents")
def n2(s, d):
    return table(s, d, "documents").select("doc_id", t.fold_hard(F.col("text")).alias("folded"))


@query("n4_normalize_style", "SELECT doc_id, md5(translate(lower(translate(translate(text, '''’ʼ', ''), 'İI', 'iı')), 'âîû', 'aiu')) AS h FROM documents")
def n4(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(t.normalize_style(F.col("text"))).alias("h"))


@query("n8_number_parts", r"""SELECT doc_id, nullif(regexp_extract(number, '^([EZO])-(\d{6,10})-(\d{3}(?:\.\d{2}){0,3})-(\d+)$', 2), '') AS detsis,
  nullif(regexp_extract(number, '^([EZO])-(\d{6,10})-(\d{3}(?:\.\d{2}){0,3})-(\d+)$', 3), '') AS sdp FROM letters""", ("letters",))
def n8(s, d):
    parts = t.number_parts(F.col("number"))
    return view(s, d, "letters").select("doc_id", parts["detsis"].alias("detsis"), parts["sdp"].alias("sdp"))


@query("n9_numeric_tokens", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\d[\d.,/:-]*\d|\d')) AS INT) AS tokens, coalesce(array_to_string(regexp_extract_all(text, '\d[\d.,/:-]*\d|\d'), ' '), '') AS joined FROM documents")
def n9(s, d):
    found = t.numeric_tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(found).alias("tokens"), F.array_join(found, " ").alias("joined"))


@query("n10_dates", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE strftime(day, '%Y-%m-%d') END AS day FROM letters", ("letters",))
def n10(s, d):
    written = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("31.02."), F.date_format("day", "yyyy"))).otherwise(F.date_format("day", "dd.MM.yyyy"))
    return view(s, d, "letters").select("doc_id", t.parse_tr_date(written).cast("string").alias("day"))


@query("n11_mask_pii", """SELECT c_custkey AS doc_id, substr(c_name, 1, 3) || repeat('*', CAST(length(c_name) - 5 AS INT)) || substr(c_name, length(c_name) - 1, 2) AS masked FROM customer""")
def n11(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), t.masked(F.lit("iban"), F.col("c_name")).alias("masked"))


@query("n15_clip", "SELECT doc_id, CASE WHEN length(trim(text)) > 40 THEN rtrim(substr(trim(text), 1, 39)) || '…' ELSE trim(text) END AS clipped FROM documents")
def n15(s, d):
    return table(s, d, "documents").select("doc_id", t.clip(F.col("text"), 40).alias("clipped"))


@query("n16_turkish_ratio", r"SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '\P{L}', '', 'g')) > 0 THEN length(regexp_replace(text, '[^çğıöşüÇĞİÖŞÜ]', '', 'g')) / length(regexp_replace(text, '\P{L}', '', 'g')) ELSE 0 END, 9) AS ratio FROM documents")
def n16(s, d):
    return table(s, d, "documents").select("doc_id", F.round(t.turkish_ratio(F.col("text")), 9).alias("ratio"))


@query("n17_n19_text_flags", r"""SELECT conv_id, turn, regexp_matches(text, '\p{M}') OR contains(text, 'Ã¼') AS garbled, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 30)) > 0 AS glued FROM conversations""")
def n17(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", t.garbled(F.col("text")).alias("garbled"), t.glued_words(F.col("text")).alias("glued"))


@query("n20_confidence", "SELECT event_id, CASE WHEN value / 100 BETWEEN 0 AND 1 THEN value / 100 ELSE 0 END AS score, value / 100 BETWEEN 0 AND 1 AS valid FROM events")
def n20(s, d):
    c = t.confidence((F.col("value") / 100).cast("string"))
    return table(s, d, "events").select("event_id", c["score"].alias("score"), c["valid"].alias("valid"))


# --- documents and lines


@query("s7_split_batches", """SELECT source AS batch, count(*) AS bodies, sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS chars FROM documents GROUP BY source""")
def s7(s, d):
    docs = table(s, d, "documents").withColumn("no", F.pmod("doc_id", F.lit(999)))
    answers = docs.select("source", F.concat(F.lit("### BELGE "), F.col("no").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n")).alias("text"))
    return readers.split_batches(answers, "source").groupBy("batch").agg(F.count("*").alias("bodies"), F.sum(F.length("body")).alias("chars"))


def _lines(s, d):
    rows = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return rows.select("doc_id", (F.col("i") + 1).alias("line_no"), F.col("text"), F.lit(1).alias("page"), ((F.col("i") + 1) * 14.6).alias("y"))


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"


@query("l1_lines_from_words", f"""WITH {LINES}, w AS (SELECT doc_id, line_no, string_split(text, ' ') AS a FROM l WHERE text <> '')
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(len(list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1]))) AS BIGINT) AS n_words FROM w GROUP BY doc_id""")
def l1(s, d):
    words = _lines(s, d).where("text <> ''").select("doc_id", "page", "y", F.posexplode(F.split("text", " ")).alias("x", "text")).withColumn("y", F.col("y") + (F.col("x") % 3) * 0.5).withColumn("x", F.col("x").cast("double"))
    return lines.lines_from_words(words).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.size(F.split("text", " "))).alias("n_words"))


@query("l5_split_footer", f"""WITH {LINES}, m AS (SELECT *, line_no * 14.6 >= 20 AND contains(lower(text), 'rights reserved') AS mark FROM l), s AS (SELECT doc_id, min(line_no) AS start FROM m WHERE mark GROUP BY doc_id)
SELECT m.doc_id, count(*) AS n, CAST(sum(CASE WHEN m.line_no >= s.start THEN 1 ELSE 0 END) AS BIGINT) AS footer FROM m LEFT JOIN s USING (doc_id) GROUP BY m.doc_id""")
def l5(s, d):
    marked = _lines(s, d).withColumn("text", F.regexp_replace("text", "(?i)rights reserved", "doğrulama kodu"))
    return lines.split_footer(marked, 20 / 0.75).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum((F.col("part") == "footer").cast("long")).alias("footer"))


# --- rules and style


@query("r13_findings", """SELECT doc_id, 'B-01' AS rule_id, 'hata' AS severity, 'Y 16' AS basis FROM letters WHERE number IS NULL
UNION ALL SELECT doc_id, 'S-01', 'uyari', 'Y 12' FROM letters WHERE number LIKE '2026/%' UNION ALL SELECT doc_id, 'S-02', 'bilgi', 'K 3' FROM letters WHERE subject LIKE '%SPECIFIED%'""", ("letters",))
def r13(s, d):
    letters = view(s, d, "letters")
    return rules.findings(rules.run_rules(letters, RULES[:3]), RULES).select("doc_id", "rule_id", "severity", "basis")


@query("r14_skip_summary", """SELECT * FROM (SELECT 'alan_bos' AS status, count(*) AS n FROM letters WHERE number IS NULL UNION ALL SELECT 'hedef_disi', count(*) FROM letters UNION ALL SELECT 'yol_yok', count(*) FROM letters
UNION ALL SELECT 'kapsam_disi', count(*) FROM letters)""", ("letters",))
def r14(s, d):
    return rules.skip_summary(rules.run_rules(view(s, d, "letters"), RULES, categories=CATEGORIES))


@query("r16_legal_basis", "SELECT doc_id, 'Y' AS law, '16' AS article, 'B-01' AS rule_id FROM letters WHERE number IS NULL UNION ALL SELECT doc_id, 'Y', '12', 'S-01' FROM letters WHERE number LIKE '2026/%' UNION ALL SELECT doc_id, 'K', '3', 'S-02' FROM letters WHERE subject LIKE '%SPECIFIED%'", ("letters",))
def r16(s, d):
    letters = view(s, d, "letters")
    return rules.legal_basis(rules.findings(rules.run_rules(letters, RULES[:3]), RULES))


DOC_RULES = [
    rules.Rule("D-01", "regex_bulunmamali", path="text", pattern=r"!!", severity="hata", title="shouting"),
    rules.Rule("D-02", "regex_bulunmamali", path="text", pattern=r"[%$#&*]{3}", severity="hata", title="symbols"),
    rules.Rule("D-03", "regex_bulunmamali", path="text", pattern=r" \| ", severity="uyari", title="listing"),
    rules.Rule("D-04", "regex_bulunmali", path="text", pattern=r"\.\s*$", severity="uyari", title="ends in a full stop"),
    rules.Rule("D-05", "bos_olmamali", path="lang", severity="hata", title="language given"),
]


@query("a5_rule_frequency", r"""SELECT rule_id, n, CASE rule_id WHEN 'D-01' THEN 'shouting' WHEN 'D-02' THEN 'symbols' WHEN 'D-03' THEN 'listing' WHEN 'D-04' THEN 'ends in a full stop' WHEN 'D-05' THEN 'language given' END AS message, CAST(NULL AS VARCHAR) AS basis FROM (SELECT 'D-01' AS rule_id, count(*) AS n FROM documents WHERE contains(text, '!!') UNION ALL SELECT 'D-02', count(*) FROM documents WHERE regexp_matches(text, '[%$#&*]{3}')
UNION ALL SELECT 'D-03', count(*) FROM documents WHERE contains(text, ' | ') UNION ALL SELECT 'D-04', count(*) FROM documents WHERE trim(text) <> '' AND NOT regexp_matches(text, '\.\s*$') UNION ALL SELECT 'D-05', count(*) FROM documents WHERE lang IS NULL) WHERE n > 0""")
def a5(s, d):
    found = rules.findings(rules.run_rules(table(s, d, "documents"), DOC_RULES), DOC_RULES)
    return board.rule_frequency(found, "doc_id").select("rule_id", "n", "message", "basis")


# The classes of Java's Unicode patterns in RE2: word characters, white space of any script, plain white space, line ends but \n.
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}"
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BLANK, _ENDS = r"[\t-\r ]", r"[\r\x{85}\x{2028}\x{2029}]"
STRIPPED = f"regexp_replace(coalesce(text, ''), '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"
_HELD = "(?:" + "|".join(t.ABBREVIATIONS) + "|[A-ZÇĞİÖŞÜ])"
#: t ends in a sentence of one word: alone in the last paragraph, or behind a sentence's end that is no abbreviation or initial.
SHORT = rf"""(regexp_matches(t, '[.!?]$') AND (regexp_matches(t, '(?:^|\n{_BLANK}*\n[{WHITE}]*)[^{WHITE}]+$')
    OR (regexp_matches(t, '[.!?]{_BLANK}+[A-ZÇĞİÖŞÜ"„][^{WHITE}]*$') AND NOT regexp_matches(t, '(?:^|[^{WORD}]){_HELD}\.{_BLANK}+[^{WHITE}]+$'))))"""


def in_re2(pattern: str) -> str:
    """One of lint.FORMS with Java's meaning of lines, words and white space."""
    space = f"[{WHITE}]" if "U)" in pattern else _BLANK
    out = pattern.replace("(?mU)", "(?m)").replace("$", f"(?:$|{_ENDS})").replace("^", f"(?:^|{_ENDS})")
    return out.replace(r"\b", f"(?:$|[^{WORD}])").replace(r"\s", space)


@query("t1_lint", rf"""WITH x AS (SELECT coalesce(text, '') AS text, {STRIPPED} AS t FROM documents)
SELECT rule_id, detail, count(*) AS n FROM (
  SELECT 'TAM-01' AS rule_id, 'cut' AS detail FROM x WHERE t <> '' AND NOT regexp_matches(t, '[.!?]$')
  UNION ALL SELECT 'TAM-01', 'empty' FROM x WHERE t = ''
  UNION ALL SELECT 'TAM-01', 'short' FROM x WHERE {SHORT}
  {" ".join(f"UNION ALL SELECT 'BIC-01', '{d}' FROM x WHERE regexp_matches(text, '{in_re2(p)}')" for p, d in lint.FORMS)}) GROUP BY 1, 2""")
def t1(s, d):
    found = lint.lint(spread(table(s, d, "documents").select("doc_id", "text")), groups=("completeness", "form"))
    return found.groupBy("rule_id", "detail").agg(F.count("*").alias("n"))


# --- joins and matching


def _units(s, d):
    return view(s, d, "units").withColumn("sdp_codes", F.when(F.col("sdp").isNull(), F.array().cast("array<string>")).otherwise(F.array("sdp")))


@query("j2_units_by_detsis", r"SELECT l.doc_id, u.code AS unit_code FROM letters l LEFT JOIN units u ON u.detsis_no = nullif(regexp_extract(l.number, '^E-(\d{8})-', 1), '')", ("letters", "units"))
def j2(s, d):
    docs = view(s, d, "letters").select("doc_id", t.number_parts(F.col("number"))["detsis"].alias("detsis"))
    return matching.units_by_key(docs, _units(s, d), "detsis").select("doc_id", "unit_code")


@query("j3_units_by_sdp", r"""WITH k AS (SELECT doc_id, nullif(regexp_extract(number, '^E-\d{8}-([\d.]+)-', 1), '') AS c FROM letters),
p AS (SELECT doc_id, c AS code, 2 AS n FROM k WHERE c IS NOT NULL UNION ALL SELECT doc_id, substr(c, 1, 3), 1 FROM k WHERE c IS NOT NULL),
h AS (SELECT p.doc_id, p.code AS matched_code, n, list_sort(list(u.code) FILTER (u.routable)) AS c FROM p JOIN units u ON u.sdp = p.code GROUP BY ALL), b AS (SELECT doc_id, arg_max(matched_code, n) AS m, arg_max(coalesce(c, []), n) AS c FROM h GROUP BY doc_id)
SELECT l.doc_id, b.m AS matched_code, coalesce(array_to_string(b.c, ','), '') AS candidates FROM letters l LEFT JOIN b USING (doc_id)""", ("letters", "units"))
def j3(s, d):
    docs = view(s, d, "letters").select("doc_id", t.number_parts(F.col("number"))["sdp"].alias("sdp"))
    return matching.units_by_sdp(docs, _units(s, d)).select("doc_id", "matched_code", F.array_join("candidates", ",").alias("candidates"))


@query("j5_best_unit_exact", """SELECT l.doc_id, arg_max(u.code, (u.level, length(u.name), u.code)) AS code FROM letters l JOIN units u ON contains(lower(l.addressee), lower(u.name)) GROUP BY l.doc_id""", ("letters", "units"))
def j5(s, d):
    letters = view(s, d, "letters")
    best = matching.best_unit_match(letters, view(s, d, "units"), "addressee").where("score = 1.0")
    return letters.join(best, letters["addressee"] == best["text"]).select("doc_id", "code")


@query("j5_fuzzy_units")
def j5f(s, d):
    parts = table(s, d, "part").select(F.col("p_name").alias("text"))
    names = table(s, d, "part").select(F.upper("p_type").alias("code"), F.initcap("p_type").alias("name"), F.lit(1).alias("level")).distinct()  # the types are a small vocabulary
    return matching.best_unit_match(parts, names, "text", 0.5)


@query("j8_code_from_subject", """WITH c AS (SELECT p_type AS code, min(p_partkey) AS ord, split_part(lower(p_type), ' ', 1) AS p FROM part GROUP BY p_type) SELECT x.subject, arg_min(c.code, c.ord) AS code FROM (SELECT DISTINCT lower(p_type) || ' ' || p_name AS subject FROM part) x JOIN c ON contains(x.subject, c.p) GROUP BY x.subject""")
def j8(s, d):
    part = table(s, d, "part")
    catalog = part.groupBy(F.col("p_type").alias("code")).agg(F.min("p_partkey").alias("ord")).select("code", "ord", F.lower("code").alias("name"), F.array().cast("array<string>").alias("subjects"))
    return matching.code_from_subject(part.select(F.concat(F.lower("p_type"), F.lit(" "), F.col("p_name")).alias("subject")), catalog)


@query("j15_unsupported", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j15(s, d):
    return matching.unsupported(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), ["doc_id"])


# --- routing, gate, evidence


@query("d1_route", """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'N' || CAST(nation AS STRING) END AS a, CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN ['N' || CAST(nation AS STRING)] ELSE ['N' || CAST(nation AS STRING), 'N' || CAST((nation + 1) % 25 AS STRING)] END AS c,
  CASE WHEN doc_id % 5 = 0 THEN ['N' || CAST((nation + 2) % 25 AS STRING)] ELSE [] END AS j, CASE WHEN doc_id % 7 = 0 THEN 'N' || CAST(nation AS STRING) END AS m FROM letters),
y AS (SELECT *, a IS NULL AND len(c) > 0 AND len(j) > 0 AS dis FROM x), z AS (SELECT *, CASE WHEN dis OR (a IS NULL AND len(c) = 0) THEN j ELSE c END AS c2 FROM y)
SELECT doc_id, CASE WHEN a IS NOT NULL AND len(c) > 0 THEN a WHEN dis AND len(c2) = 1 THEN c2[1] WHEN len(c) > 0 AND len(c2) = 1 THEN c2[1] WHEN a IS NOT NULL THEN a WHEN len(c) = 0 AND len(c2) = 1 THEN c2[1] WHEN len(c2) > 1 AND list_contains(c2, m) THEN m WHEN len(c2) <= 1 AND m IS NOT NULL THEN m END AS target,
  CASE WHEN a IS NOT NULL AND len(c) > 0 THEN 1.0 WHEN dis AND len(c2) = 1 THEN 0.4 WHEN len(c) > 0 AND len(c2) = 1 THEN 0.9 WHEN a IS NOT NULL THEN 0.9 WHEN len(c) = 0 AND len(c2) = 1 THEN 0.8 WHEN len(c2) > 1 AND list_contains(c2, m) THEN 0.7 WHEN len(c2) <= 1 AND m IS NOT NULL THEN 0.45 ELSE 0.0 END::DOUBLE AS score, dis AS conflict FROM z""", ("letters",))
def d1(s, d):
    n = lambda k: F.concat(F.lit("N"), ((F.col("nation") + k) % 25).cast("string"))
    key, none = F.col("doc_id"), F.array().cast("array<string>")
    docs = view(s, d, "letters").select(
        "doc_id", F.when(key % 4 != 0, n(0)).alias("addressee_unit"), F.when(key % 3 == 0, none).when(key % 3 == 1, F.array(n(0))).otherwise(F.array(n(0), n(1))).alias("sdp_candidates"), F.lit("a").alias("number_code"), F.lit("b").alias("subject_code"),
        F.when(key % 5 == 0, F.array(n(2))).otherwise(none).alias("subject_candidates"), F.when(key % 7 == 0, n(0)).alias("model_narrow"), F.when(key % 7 == 0, n(0)).alias("model_wide"),
    )
    return routing.route(docs).select("doc_id", "target", "score", "conflict")


@query("d8_gate", """WITH x AS (SELECT *, target IS NULL OR score < 0.85 AS b1, coalesce(gave_up, open_errors > 0) AS b2, writer_uncertain AS b3, critical_missing > 0 AS b4, conflict AS b5 FROM decisions)
SELECT doc_id, NOT (b1 OR b2 OR b3 OR b4 OR b5) AS auto, CASE WHEN b2 OR b3 OR b4 OR b5 THEN 0.0 ELSE score END AS trust, CAST(b1 AS INT) + CAST(b2 AS INT) + CAST(b3 AS INT) + CAST(b4 AS INT) + CAST(b5 AS INT) AS blocked FROM x""", ("decisions",))
def d8(s, d):
    return routing.gate(view(s, d, "decisions")).select("doc_id", "auto", "trust", F.size("blockers").alias("blocked"))


@query("d9_best_evidence", """SELECT doc_id, field_path, method, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_path ORDER BY CASE method WHEN 'regex' THEN 80 WHEN 'hesap' THEN 75 WHEN 'ocr' THEN 60 ELSE 40 END DESC, confidence BETWEEN 0 AND 1 DESC, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0 END DESC, ts, ord) AS r FROM evidence) WHERE r = 1""", ("evidence",))
def d9(s, d):
    return routing.best_evidence(view(s, d, "evidence")).select("doc_id", "field_path", "method", "ord")


@query("d10_weakest_link", "SELECT doc_id, min(CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0 END) AS weakest FROM evidence GROUP BY doc_id", ("evidence",))
def d10(s, d):
    return routing.weakest_link(view(s, d, "evidence"))


@query("d12_queue", "SELECT doc_id, institution AS unit, CAST(epoch(TIMESTAMP '2026-01-01') - epoch(ts) AS BIGINT) AS waiting_s FROM letters WHERE family = 'O'", ("letters",))
def d12(s, d):
    docs = view(s, d, "letters").select("doc_id", F.lit(None).cast("string").alias("current_unit"), F.col("institution").alias("target"), F.when(F.col("family") == "O", "insan_onayi_bekliyor").otherwise("onaylandi").alias("status"), "subject", F.col("ts").cast("timestamp").alias("received"), F.lit(None).cast("array<struct<rule_id:string,severity:string,resolved:boolean>>").alias("missing"))
    return routing.queue(docs, F.to_timestamp(F.lit("2026-01-01 00:00:00"))).select("doc_id", "unit", "waiting_s")


# --- register


@query("g1_assign_numbers", "SELECT direction, institution, doc_id, row_number() OVER (PARTITION BY direction, institution ORDER BY ts, doc_id) AS seq FROM letters", ("letters",))
def g1(s, d):
    return register.assign_numbers(view(s, d, "letters"))


@query("g1_continue_numbers", """WITH o AS (SELECT direction, institution, doc_id, row_number() OVER (PARTITION BY direction, institution ORDER BY ts, doc_id) AS seq FROM letters WHERE doc_id % 3 = 0),
m AS (SELECT direction, institution, max(seq) AS last FROM o GROUP BY ALL)
SELECT * FROM o UNION ALL SELECT n.direction, n.institution, n.doc_id, row_number() OVER (PARTITION BY n.direction, n.institution ORDER BY n.ts, n.doc_id) + coalesce(m.last, 0) FROM letters n LEFT JOIN m USING (direction, institution) WHERE n.doc_id % 3 <> 0""", ("letters",))
def g1c(s, d):
    letters = view(s, d, "letters")
    return register.assign_numbers(letters, register.assign_numbers(letters.where("doc_id % 3 = 0")))


@query("g2_official_numbers", r"SELECT doc_id, 'E-' || CAST(10000000 + nation AS STRING) || '-' || CAST(100 + doc_id % 7 AS STRING) || '-' || CAST(doc_id AS STRING) AS number FROM letters", ("letters",))
def g2(s, d):
    rows = view(s, d, "letters").select("doc_id", (F.col("nation") + 10_000_000).cast("string").alias("detsis"), (F.col("doc_id") % 7 + 100).cast("string").alias("sdp"), F.col("doc_id").alias("seq"))
    return register.official_numbers(rows).where("problem is null").select("doc_id", "number")


@query("g3_register_rows", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY direction, institution ORDER BY ts, doc_id) AS seq FROM letters)
SELECT direction, institution, seq, doc_id, CASE WHEN direction = 'gelen' THEN sender ELSE addressee END AS party, CASE WHEN direction = 'gelen' THEN 'Evrak Tarih ve Sayısı: ' || strftime(ts, '%d/%m/%Y') || '-' || CAST(seq AS STRING) ELSE number END AS mark FROM r""", ("letters",))
def g3(s, d):
    letters = view(s, d, "letters")
    rows = register.assign_numbers(letters).join(letters.drop("direction", "institution"), "doc_id")
    return register.register_rows(rows).drop("subject", "day")


@query("g6_register_summary", "SELECT direction, institution, count(*) AS n, count(*) AS last FROM letters GROUP BY ALL", ("letters",))
def g6(s, d):
    return register.summary(register.assign_numbers(view(s, d, "letters")))


# --- board


@query("a2_stage_times", """WITH r AS (SELECT stage, ms, row_number() OVER (PARTITION BY stage ORDER BY ms) AS i, count(*) OVER (PARTITION BY stage) AS n FROM trace)
SELECT stage, CAST(max(n) AS BIGINT) AS n, round(avg(ms), 6) AS mean_ms, max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1 THEN ms END) AS p95 FROM r GROUP BY stage""", ("trace",))
def a2(s, d):
    trace = view(s, d, "trace")
    return board.stage_times(trace, trace.select("stage").distinct()).select("stage", "n", F.round("mean_ms", 6).alias("mean_ms"), "p95")


@query("a3_p95_overall", """WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem) SELECT v AS p95 FROM r WHERE i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1""")
def a3(s, d):
    return board.rank_percentile(table(s, d, "lineitem"), "l_extendedprice", 0.95, [])


@query("a4_item_counts", "SELECT layer, severity, resolved, count(*) AS n FROM items GROUP BY ALL", ("items",))
def a4(s, d):
    return board.item_counts(view(s, d, "items"))


@query("a5_item_frequency", "SELECT rule_id, count(*) AS n FROM items GROUP BY ALL", ("items",))
def a5i(s, d):
    return board.rule_frequency(view(s, d, "items"), "seen").select("rule_id", "n")


@query("a6_distribution", "SELECT 'family' AS dimension, family AS value, count(*) AS n FROM letters GROUP BY 2 UNION ALL SELECT 'belge_turu', belge_turu, count(*) FROM letters GROUP BY 2 UNION ALL SELECT 'institution', institution, count(*) FROM letters GROUP BY 2", ("letters",))
def a6(s, d):
    return board.distribution(view(s, d, "letters"), ["family", "belge_turu", "institution"])


@query("a9_trust_histogram", """WITH g AS (SELECT CASE WHEN coalesce(gave_up, open_errors > 0) OR writer_uncertain OR critical_missing > 0 OR conflict THEN 0.0 ELSE score END AS trust FROM decisions)
SELECT CAST(CASE WHEN trust < 0.5 THEN 0.0 WHEN trust < 0.6 THEN 0.5 WHEN trust < 0.7 THEN 0.6 WHEN trust < 0.8 THEN 0.7 WHEN trust < 0.9 THEN 0.8 ELSE 0.9 END AS DOUBLE) AS bin, count(*) AS n, CAST(sum(CASE WHEN trust >= 0.85 THEN 1 ELSE 0 END) AS BIGINT) AS above FROM g GROUP BY 1""", ("decisions",))
def a9(s, d):
    return board.trust_histogram(routing.gate(view(s, d, "decisions")))


@query("a11_stage_totals", "SELECT stage, count(*) AS docs, round(avg(total), 4) AS mean_total FROM (SELECT doc_id, stage, sum(ms) AS total FROM trace GROUP BY ALL) GROUP BY stage", ("trace",))
def a11(s, d):
    return board.stage_totals(view(s, d, "trace")).select("stage", "docs", F.round("mean_total", 4).alias("mean_total"))


# --- evaluation


@query("e1_class_scores", """WITH c AS (SELECT expected, predicted, count(*) AS n FROM pairs GROUP BY ALL), s AS (SELECT expected AS class, sum(n) AS support, coalesce(sum(n) FILTER (expected = predicted), 0) AS tp FROM c GROUP BY 1), p AS (SELECT predicted AS class, sum(n) AS predicted FROM c WHERE predicted IS NOT NULL GROUP BY 1)
SELECT s.class, CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp, CAST(coalesce(predicted, 0) AS BIGINT) AS predicted, round(CASE WHEN tp > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END, 9) AS f1 FROM s LEFT JOIN p USING (class)""", ("pairs",))
def e1(s, d):
    return evaluate.class_scores(view(s, d, "pairs")).select("class", "support", "tp", "predicted", F.round("f1", 9).alias("f1"))


@query("e4_confusion", "SELECT expected, predicted, count(*) AS n FROM pairs GROUP BY ALL", ("pairs",))
def e4(s, d):
    return evaluate.confusion(view(s, d, "pairs"))


@query("e2_field_accuracy", """WITH l AS (SELECT doc_id, addressee, sender, CASE WHEN doc_id % 2 = 0 THEN 'taranmis' ELSE 'metin_katmanli' END AS format FROM letters), r AS (SELECT doc_id, format, 'addressee' AS field, doc_id % 10 <> 0 AS ok FROM l UNION ALL SELECT doc_id, format, 'sender', doc_id % 4 <> 0 FROM l)
SELECT field, format, count(*) AS measured, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS "right" FROM r GROUP BY GROUPING SETS ((field), (field, format))""", ("letters",))
def e2(s, d):
    letters = view(s, d, "letters")
    labels = letters.select("doc_id", "addressee", "sender", F.lit(None).cast("string").alias("defect"), F.when(F.col("doc_id") % 2 == 0, "taranmis").otherwise("metin_katmanli").alias("format"))
    found = letters.select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.lower("addressee")).alias("addressee"), F.when(F.col("doc_id") % 4 == 0, "?").otherwise(F.col("sender")).alias("sender"))
    return evaluate.field_accuracy(found, labels, ["addressee", "sender"], loose=("addressee",))


@query("e6_routing_outcomes", """SELECT 'p' AS path, CAST(CASE WHEN score >= 1 THEN 1.0 WHEN score >= 0.9 THEN 0.9 WHEN score >= 0.7 THEN 0.7 WHEN score >= 0.4 THEN 0.4 ELSE 0.0 END AS DOUBLE) AS band, CAST(sum(CASE WHEN target = 'N' || CAST(doc_id % 25 AS STRING) THEN 1 ELSE 0 END) AS BIGINT) AS "right", CAST(sum(CASE WHEN target <> 'N' || CAST(doc_id % 25 AS STRING) THEN 1 ELSE 0 END) AS BIGINT) AS wrong, CAST(sum(CASE WHEN target IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved FROM decisions GROUP BY ALL""", ("decisions",))
def e6(s, d):
    rows = view(s, d, "decisions")
    return evaluate.routing_outcomes(rows.withColumn("path", F.lit("p")), rows.select("doc_id", F.concat(F.lit("N"), (F.col("doc_id") % 25).cast("string")).alias("expected")))


@query("e7_threshold_sweep", """SELECT CAST(t AS DOUBLE) AS threshold, CAST(sum(CASE WHEN NOT conflict AND score >= t THEN 1 ELSE 0 END) AS BIGINT) AS auto, CAST(sum(CASE WHEN NOT conflict AND score >= t AND writer_uncertain THEN 1 ELSE 0 END) AS BIGINT) AS leaked, CAST(sum(CASE WHEN NOT conflict AND score >= t THEN 0 ELSE 1 END) AS BIGINT) AS human
FROM decisions, (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.85::DOUBLE, 0.95::DOUBLE]) AS t) GROUP BY t""", ("decisions",))
def e7(s, d):
    rows = view(s, d, "decisions").select("score", F.col("conflict").alias("other_blockers"), (~F.col("writer_uncertain")).alias("right"))
    return evaluate.threshold_sweep(rows, [0.5, 0.7, 0.85, 0.95])


@query("e15_unverified_numbers", r"""WITH n AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM conversations)
SELECT conv_id, turn, CAST(len(list_filter(regexp_extract_all(text, '\d[\d.,/:-]*\d|\d'), lambda x: length(regexp_replace(x, '\D', '', 'g')) > 1 AND NOT contains(coalesce(src, ''), x) AND NOT list_contains(list_transform(regexp_extract_all(coalesce(src, ''), '\d[\d.,/:-]*\d|\d'), lambda y: regexp_replace(y, '\D', '', 'g')), regexp_replace(x, '\D', '', 'g')))) AS INT) AS unverified FROM n""")
def e15(s, d):
    from pyspark.sql import Window

    rows = table(s, d, "conversations").withColumn("src", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", F.size(evaluate.unverified_numbers(F.col("text"), F.col("src"))).alias("unverified"))


@query("e18_answer_quality", """SELECT user_id AS doc_id, count(*) AS n, CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS BIGINT) AS in_enum, CAST(sum(CASE WHEN value / 100 BETWEEN 0 AND 1 THEN 1 ELSE 0 END) AS BIGINT) AS in_range, count(DISTINCT event_type) = 1 AS stable FROM events GROUP BY 1""")
def e18(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.col("props").alias("raw"), F.col("event_type").alias("value"), (F.col("value") / 100).alias("confidence"))
    return evaluate.answer_quality(rows, ["view", "click"]).select("doc_id", "n", "in_enum", "in_range", "stable")


# --- corpus and samples


@query("q1_repeated_lines", f"""WITH {LINES} SELECT text AS line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE length(text) > 25 GROUP BY text HAVING count(*) > 1""")
def q1(s, d):
    rows = _lines(s, d).where(F.length("text") > 25).withColumn("h", F.xxhash64("text"))
    hot = rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    return rows.join(hot, "h", "left_semi").groupBy(F.col("text").alias("line")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("n > 1")


@query("q5_quota_check", """WITH c AS (SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2), t AS (SELECT * FROM (VALUES ('lang', 'en', 500), ('lang', 'tr', 5), ('source', 'src0', 50)) AS v(dimension, value, target))
SELECT coalesce(c.dimension, t.dimension) AS dimension, coalesce(c.value, t.value) AS value, coalesce(n, 0) AS n, CAST(coalesce(target, 0) AS BIGINT) AS target FROM c FULL JOIN t ON c.dimension = t.dimension AND c.value = t.value WHERE coalesce(n, 0) <> coalesce(target, 0)""")
def q5(s, d):
    targets = s.createDataFrame([("lang", "en", 500), ("lang", "tr", 5), ("source", "src0", 50)], "dimension string, value string, target int")
    return corpus.quota_check(table(s, d, "documents"), targets).drop("gap")


@query("q5_cross_minimum", "WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT l.lang, s.source, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN n ON n.lang = l.lang AND n.source = s.source WHERE coalesce(n.n, 0) < 6")
def q5c(s, d):
    return corpus.cross_minimum(table(s, d, "documents"), "lang", "source", 6)


@query("b1_expand_quota", "SELECT o_custkey AS cell, unnest(range(1, count(*) + 1)) AS no FROM orders GROUP BY o_custkey")
def b1(s, d):
    cells = table(s, d, "orders").groupBy(F.col("o_custkey").alias("cell")).agg(F.count("*").alias("n"))
    return corpus.expand_quota(cells).withColumn("no", F.col("no").cast("long"))


@query("b4_flip_closing", "SELECT conv_id, turn, md5(text || CASE WHEN conv_id % 2 = 0 THEN ' rica ederim.' ELSE ' arz ederim.' END) AS h FROM conversations")
def b4(s, d):
    text = F.concat("text", F.when(F.col("conv_id") % 2 == 0, " arz ederim.").otherwise(" rica ederim."))
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(corpus.flip_closing(text)).alias("h"))


@query("b8_batches", "SELECT doc_id, CAST(ceil((doc_id + 1) / 20.0) AS BIGINT) AS batch FROM documents")
def b8(s, d):
    return corpus.batches(table(s, d, "documents").select("doc_id", (F.col("doc_id") + 1).alias("no"))).select("doc_id", "batch")


@query("p2_proportional", "SELECT lang AS class, CAST(least(count(*), greatest(2, round(100.0 * count(*) / (SELECT count(*) FROM documents)))) AS BIGINT) AS n FROM documents GROUP BY lang")
def p2(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("class"))
    return sampling.proportional(rows, 100).groupBy("class").agg(F.count("*").alias("n"))


@query("p3_first_per_class", """SELECT id, class, defect FROM (SELECT doc_id AS id, source AS class, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS defect, row_number() OVER (PARTITION BY source ORDER BY lang <> 'en', doc_id) AS r FROM documents) WHERE r <= 5""")
def p3(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("class"), F.when(F.col("lang") != "en", F.col("lang")).alias("defect"))
    return sampling.first_per_class(rows, 5)


@query("p4_balanced_defects", """WITH r AS (SELECT doc_id AS id, source AS class, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS defect FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY defect ORDER BY id) AS k FROM r WHERE defect IS NOT NULL)
(SELECT id, class, defect FROM b ORDER BY k, defect LIMIT 30) UNION ALL (SELECT id, class, defect FROM r WHERE defect IS NULL ORDER BY id LIMIT 30)""")
def p4(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("class"), F.when(F.col("lang") != "en", F.col("lang")).alias("defect"))
    return sampling.balanced_defects(rows, 60)


@query("w2_latest_status", "SELECT doc_id, arg_max(stage, (ts, event_id)) AS status, count(*) AS events FROM trace GROUP BY doc_id", ("trace",))
def w2(s, d):
    from ..streaming.jobs import latest_status

    rows = view(s, d, "trace").select("doc_id", F.col("event_id").alias("action_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("stage").alias("status"))
    return latest_status(rows).select("doc_id", "status", "events")


from . import catalogue_more, catalogue_tables, catalogue_texts, letters  # noqa: E402, F401  they register their queries here
