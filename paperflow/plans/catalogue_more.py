"""More registered queries: the operators that catalogue.py doesn't show, on the same views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as t
from ..operators import board, corpus, evaluate, fields, lines, lint, matching, register, routing, rules, sampling
from ..sources import dimensions
from .catalogue import _units, query
from .views import table, view

# --- text


@query("n3_n5_case_space", r"SELECT doc_id, md5(lower(translate(text, 'İI', 'iı'))) AS lowered, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed FROM documents")
def n3(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(t.tr_lower(F.col("text"))).alias("lowered"), F.md5(t.squeeze_space(F.col("text"))).alias("squeezed"))


@query("n12_pii_flag", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN true ELSE value > 50 END AS pii, CASE WHEN event_type = 'click' THEN 'iban' WHEN event_type = 'view' THEN 'adres' WHEN event_type = 'error' THEN 'diger' ELSE 'tarih' END AS kind FROM events")
def n12(s, d):
    kind = F.when(F.col("event_type") == "click", "iban").when(F.col("event_type") == "view", "adres").when(F.col("event_type") == "error", "unknown").otherwise("tarih")
    return table(s, d, "events").select("event_id", t.pii_flag(kind, F.col("value") > 50).alias("pii"), t.entity_type(kind).alias("kind"))


@query("n14_phone", "SELECT o_orderkey AS doc_id, (500 + o_orderkey % 60) BETWEEN 530 AND 549 OR (500 + o_orderkey % 60) IN (501, 505, 506, 507, 551, 552, 553, 554, 555, 559) AS allocated FROM orders")
def n14(s, d):
    no = F.concat(F.lit("0"), (F.col("o_orderkey") % 60 + 500).cast("string"), F.lit(" 111 22 33"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), t.phone_allocated(no).alias("allocated"))


@query("n18_looks_turkish", r"""SELECT doc_id, regexp_matches(lower(translate(text, 'İI', 'iı')), '[çğıöşü]') OR CAST(contains(' ' || lower(text) || ' ', ' bu ') AS INT) + CAST(contains(' ' || lower(text) || ' ', ' ve ') AS INT) + CAST(contains(' ' || lower(text) || ' ', ' bir ') AS INT) + CAST(contains(' ' || lower(text) || ' ', ' ile ') AS INT) >= 2 AS turkish FROM documents""")
def n18(s, d):
    return table(s, d, "documents").select("doc_id", t.looks_turkish(F.col("text")).alias("turkish"))


@query("n21_secrecy_level", "SELECT o_orderkey AS doc_id, CAST(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS INT) AS level FROM orders")
def n21(s, d):
    k = F.col("o_orderkey") % 5
    value = F.when(k == 0, "").when(k == 1, "Hizmete Özel").when(k == 2, " GİZLİ ").when(k == 3, "Çok Gizli").otherwise("başka")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), t.secrecy_level(value).alias("level"))


@query("n22_n23_scope_labels", "SELECT doc_id, belge_turu IN ('genelge', 'cevap_yazisi') AS letter, CASE belge_turu WHEN 'genelge' THEN 'Genelge' WHEN 'dilekce' THEN 'Dilekçe' END AS label FROM letters", ("letters",))
def n22(s, d):
    rows = view(s, d, "letters")
    return rows.select("doc_id", t.in_scope(F.col("belge_turu"), F.lit("kurum"), {"kurum": ["genelge", "cevap_yazisi"]}).alias("letter"), t.mapped(F.col("belge_turu"), {"genelge": "Genelge", "dilekce": "Dilekçe"}).alias("label"))


# --- lines and fields


@query("l3_stack_pages", """SELECT user_id AS doc_id, round(sum(value + (event_id % 3 - f) * h), 4) AS total FROM events JOIN (SELECT user_id, min(event_id % 3) AS f, CAST(100 + 10 * min(event_id % 3) AS DOUBLE) AS h FROM events GROUP BY user_id) USING (user_id) GROUP BY user_id""")
def l3(s, d):
    words = table(s, d, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 3).cast("int").alias("page"), F.col("value").alias("y"))
    pages = words.select("doc_id", "page").distinct().withColumn("height", 100.0 + 10 * F.col("page"))
    return lines.stack_pages(words, pages).groupBy("doc_id").agg(F.round(F.sum("y"), 4).alias("total"))


@query("l4_has_text_layer", "SELECT conv_id AS doc_id, coalesce(length(trim(arg_min(text, turn))), 0) >= 120 AS text_layer FROM conversations GROUP BY conv_id")
def l4(s, d):
    return lines.has_text_layer(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query("x10_sender", "SELECT l.doc_id, CASE WHEN l.family = 'P' THEN 'kisi' WHEN u.code IS NOT NULL THEN 'birim' WHEN l.family = 'F' THEN 'sirket' END AS sender_kind, CASE WHEN l.family <> 'P' THEN u.code END AS sender_code FROM letters l LEFT JOIN units u ON u.detsis_no = CASE WHEN l.doc_id % 3 = 0 THEN CAST(10000000 + l.nation AS STRING) END", ("letters", "units"))
def x10(s, d):
    rows = view(s, d, "letters").select("doc_id", F.when(F.col("family") == "P", "dilekce").when(F.col("family") == "F", "sirket").otherwise("kurum").alias("family"), F.array(F.lit("Antet")).alias("letterhead"), F.when(F.col("doc_id") % 3 == 0, (F.col("nation") + 10_000_000).cast("string")).alias("detsis_no"), F.col("sender").alias("person"))
    return fields.sender(rows, _units(s, d)).select("doc_id", "sender_kind", "sender_code")


@query("x11_document_code", r"SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN '999' END, nullif(regexp_extract(number, '^E-\d{8}-([\d.]+)-', 1), ''), '100') AS code FROM letters", ("letters",))
def x11(s, d):
    rows = view(s, d, "letters")
    return rows.select("doc_id", fields.document_code(F.when(F.col("doc_id") % 4 == 0, "999"), t.number_parts(F.col("number"))["sdp"], F.lit("100")).alias("code"))


@query("x12_type_candidates", "SELECT doc_id, CASE WHEN family = 'O' THEN CASE WHEN doc_id % 2 = 0 THEN 'cevap' ELSE 'ust_yazi' END END AS decided, CAST(CASE WHEN family = 'O' THEN 1 WHEN family = 'F' THEN 2 ELSE 0 END AS INT) AS n FROM letters", ("letters",))
def x12(s, d):
    types = s.createDataFrame([("cevap", "O", True, False, False, False), ("ust_yazi", "O", False, True, False, False), ("a", "F", False, False, True, False), ("b", "F", False, False, True, False)], "type string, family string, needs_reference boolean, bars_reference boolean, needs_attachment boolean, bars_attachment boolean")
    rows = view(s, d, "letters").select("doc_id", "family", (F.col("doc_id") % 2 == 0).alias("has_reference"), F.lit(False).alias("has_attachment"))
    return fields.type_candidates(rows, types).select("doc_id", "decided", F.size("candidates").alias("n"))


@query("x13_why_no_addressee", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'lower_case,ending' END AS reasons FROM letters", ("letters",))
def x13(s, d):
    line = F.when(F.col("doc_id") % 2 == 0, F.concat("addressee", F.lit(" BAŞKANLIĞINA"))).otherwise(F.lit("gereğini arz ederim"))
    return view(s, d, "letters").select("doc_id", F.array_join(lines.why_no_addressee(line), ",").alias("reasons"))


# --- matching


@query("j4_code_names", r"""WITH k AS (SELECT DISTINCT nullif(regexp_extract(number, '^E-\d{8}-([\d.]+)-', 1), '') AS code FROM letters), c AS (SELECT CAST(100 + x AS STRING) AS code, 'ad' || CAST(x AS STRING) AS name FROM range(0, 5) t(x))
SELECT k.code, c.code AS matched_code, c.name FROM k LEFT JOIN c ON c.code = substr(k.code, 1, 3) WHERE k.code IS NOT NULL""", ("letters",))
def j4(s, d):
    codes = view(s, d, "letters").select(t.number_parts(F.col("number"))["sdp"].alias("sdp"))
    catalog = s.range(5).select((F.col("id") + 100).cast("string").alias("code"), F.concat(F.lit("ad"), F.col("id").cast("string")).alias("name"), F.lit("5").alias("retention"))
    return matching.code_names(codes, catalog).select("code", "matched_code", "name")


@query("j7_letterhead_unit", """WITH h AS (SELECT l.doc_id, l.addressee, l.doc_id % 3 = 0 AS own, arg_max(u.code, (length(u.name), u.code)) AS institution FROM letters l JOIN units u ON u.level > 0 AND contains('t.c. ' || lower(l.addressee), lower(u.name)) GROUP BY ALL)
SELECT l.doc_id, h.institution, CASE WHEN h.own THEN h.institution || '-B' ELSE h.institution END AS unit FROM letters l LEFT JOIN h USING (doc_id)""", ("letters", "units"))
def j7(s, d):
    """Letterheads of two lines and the unit's name, an own unit of the institution in every third one."""
    u = view(s, d, "units").where("level > 0")
    number = F.regexp_replace("code", "[A-Z]", "").cast("int")
    patterns = u.select(F.col("code").alias("institution"), F.col("name").alias("line"), (-F.length("name") * 1000 - number).alias("ord"))
    own = u.select(F.concat("code", F.lit("-B")).alias("code"), F.lit("Birim").alias("name"), F.col("code").alias("institution"))
    heads = view(s, d, "letters").select("doc_id", F.array(F.lit("T.C."), F.col("addressee"), F.when(F.col("doc_id") % 3 == 0, "BİRİM").otherwise("x")).alias("letterhead"))
    return matching.letterhead_unit(heads, patterns, own)


@query("j10_similarity")
def j10(s, d):
    rows = table(s, d, "part").select("p_partkey", fuzzy.similarity(F.col("p_name"), F.lower("p_type")).alias("score"))
    return rows


@query("j11_hierarchy", "SELECT DISTINCT institution AS sender, addressee AS recipient, CASE WHEN institution = 'kurum_0' AND contains(addressee, 'NATION_1') THEN 'ust' WHEN institution = 'kurum_0' THEN 'bulunamadi' ELSE 'kurum_yok' END AS position FROM letters", ("letters",))
def j11(s, d):
    lists = s.createDataFrame([("kurum_0", "ust", 0, "NATION_1")], "institution string, position string, position_ord int, body string")
    pairs = view(s, d, "letters").select(F.col("institution").alias("sender"), F.col("addressee").alias("recipient"))
    return matching.hierarchy_position(pairs, lists, 0.95)


@query("j12_correspondence_form", "SELECT DISTINCT institution, addressee AS body, CASE addressee WHEN 'NATION_3' THEN 'arz' WHEN 'NATION_8' THEN 'rica' END AS form FROM letters", ("letters",))
def j12(s, d):
    known = view(s, d, "letters").select("institution").distinct().select("institution", F.explode(F.array(F.struct(F.lit("NATION_3").alias("body"), F.lit("arz").alias("form")), F.struct(F.lit("nation_8").alias("body"), F.lit("rica").alias("form")))).alias("x")).select("institution", "x.body", "x.form")
    return matching.correspondence_form(view(s, d, "letters").select("institution", F.col("addressee").alias("body")), known)


@query("j13_recipient_unit", "SELECT l.doc_id, CASE WHEN l.doc_id % 3 = 0 THEN 'N' || CAST(l.nation AS STRING) ELSE b.code END AS unit FROM letters l LEFT JOIN (SELECT l.doc_id, arg_max(u.code, (u.level, length(u.name), u.code)) AS code FROM letters l JOIN units u ON contains(lower(l.addressee), lower(u.name)) GROUP BY l.doc_id) b USING (doc_id)", ("letters", "units"))
def j13(s, d):
    rows = view(s, d, "letters").select("doc_id", "addressee", F.when(F.col("doc_id") % 3 == 0, (F.col("nation") + 10_000_000).cast("string")).alias("sender_detsis"))
    return matching.recipient_unit(rows, _units(s, d), ["addressee"])


# --- rules and style


@query("r11_r12_special_rules", "SELECT doc_id, 'R-12' AS rule_id, CASE WHEN number IS NULL THEN 'veri_yok' WHEN doc_id % 2 = 0 THEN 'uygun' ELSE 'ihlal' END AS status FROM letters UNION ALL SELECT doc_id, 'R-11', CASE WHEN doc_id % 5 = 0 THEN 'ihlal' ELSE 'uygun' END FROM letters", ("letters",))
def r11(s, d):
    docs = view(s, d, "letters").select("doc_id", "number", F.when(F.col("doc_id") % 2 == 0, "ilgi'de kayıtlı").otherwise("ilgili birim").alias("body"), F.struct(F.col("addressee").alias("raw"), F.lit("tek").alias("kind"), F.when(F.col("doc_id") % 5 != 0, "N1").alias("unit")).alias("muhatap"))
    special = [rules.Rule("R-12", "ozel_fonksiyon", path="body", other_path="number", function="ilgi_govdede"), rules.Rule("R-11", "ozel_fonksiyon", path="muhatap", function="muhatap_belirli")]
    return rules.run_rules(docs, special).select("doc_id", "rule_id", "status")


@query("r15_missing_items", "SELECT doc_id, 'ME-02' AS rule_id, 'uyari' AS severity FROM letters WHERE number IS NULL", ("letters",))
def r15(s, d):
    one = [rules.Rule("ME-02", "bos_olmamali", path="number", severity="hata", question="Sayı nedir?")]
    return rules.missing_items(rules.findings(rules.run_rules(view(s, d, "letters"), one), one), one).select("doc_id", "rule_id", "severity")


@query("r18_smoke_test", r"SELECT l.source AS rule_id, l.text, true AS expected FROM documents l WHERE NOT contains(l.text, 'the')")
def r18(s, d):
    docs = table(s, d, "documents")
    patterns = docs.select(F.col("source").alias("rule_id")).distinct().withColumn("pattern", F.lit("the"))
    return rules.smoke_test(patterns, docs.select(F.col("source").alias("rule_id"), "text", F.lit(True).alias("expected"))).select("rule_id", "text", "expected")


def _bodies(s, d):
    ending = F.when(F.col("conv_id") % 3 == 0, " Arz ederim.").when(F.col("conv_id") % 3 == 1, " Rica ederim.").otherwise(" Arz olunur.")
    return table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "conv_id", "turn", F.concat("text", ending).alias("text"))


@query("t3_closing", "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'ME-03:direction' ELSE 'ME-02:forbidden,ME-02:missing' END AS found FROM conversations")
def t3(s, d):
    out = lint.closing(F.col("text"), F.lit("kurum"), F.lit("ust"))
    return _bodies(s, d).select("conv_id", "turn", F.array_join(F.transform(out, lambda x: F.concat(x["rule_id"], F.lit(":"), x["detail"])), ",").alias("found"))


@query("t10_clean_flags", r"""SELECT doc_id, NOT (trim(text, ' ' || chr(10)) = '' OR NOT regexp_matches(text, '[.!?]\s*$')) AS clean FROM documents""")
def t10(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    return lint.clean_flags(docs, lint.lint(docs, groups=("completeness",)))


@query("t12_without_conflicts", "SELECT doc_id, rule_id, severity FROM items WHERE NOT (rule_id = 'kural_2' AND doc_id % 2 = 0)", ("items",))
def t12(s, d):
    rows = view(s, d, "items").withColumn("direction", F.when(F.col("doc_id") % 2 == 0, "gercek_kisi")).withColumn("rule_id", F.when(F.col("rule_id") == "kural_2", "ME-02").otherwise(F.col("rule_id")))
    return lint.without_conflicts(rows).select("doc_id", F.when(F.col("rule_id") == "ME-02", "kural_2").otherwise(F.col("rule_id")).alias("rule_id"), "severity")


# --- decisions


@query("d2_addressee_route", "SELECT l.doc_id, CASE WHEN l.doc_id % 101 >= 85 THEN 'A' WHEN u.routable THEN u.code END AS unit, CASE WHEN l.doc_id % 101 >= 85 THEN CAST(l.doc_id % 101 AS DOUBLE) / 100 WHEN u.routable THEN 1.0 END AS score FROM letters l JOIN units u ON u.code = 'N' || CAST(l.nation AS STRING)", ("letters", "units"))
def d2(s, d):
    rows = view(s, d, "letters")
    matches = rows.select("doc_id", F.lit("A").alias("unit"), ((F.col("doc_id") % 101).cast("double") / 100).alias("score"))
    return routing.addressee_route(matches, rows.select("doc_id", F.concat(F.lit("N"), F.col("nation").cast("string")).alias("unit")), view(s, d, "units"))


@query("d4_d5_badge_writer", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'MUHATAP' ELSE 'LLM' END AS badge, target IS NULL AND score < 0.85 AS uncertain FROM decisions", ("decisions",))
def d4(s, d):
    rows = view(s, d, "decisions")
    writer = routing.who_writes(rows.select("doc_id", "target", F.lit("m").alias("match_unit"), F.col("score").alias("match_score"))).select("doc_id", "uncertain")
    return rows.select("doc_id", routing.source_badge(F.when(F.col("doc_id") % 2 == 0, "muhatap").otherwise("model_dar")).alias("badge")).join(writer, "doc_id")


@query("d6_d7_letterhead_direction", "SELECT doc_id, CASE WHEN nation % 3 = 0 THEN 'T.C.|' || institution ELSE 'T.C.|' || institution || '|' || addressee END AS head, CASE WHEN family = 'P' THEN 'Bilgilerinize sunulur.' WHEN nation % 3 < 1 THEN 'rica ederim.' ELSE 'arz ederim.' END AS closing FROM letters", ("letters",))
def d6(s, d):
    level = (F.col("nation") % 3).cast("int")
    head = routing.letterhead_lines(F.array(F.lit("T.C."), F.lit("{kurum_adi}"), F.lit("{birim_adi}")), F.col("institution"), F.col("addressee"), level)
    way = routing.direction(F.when(F.col("family") == "P", "kisi").otherwise("kurum"), F.lit("a"), F.lit("a"), level, F.lit(1), F.lit(None).cast("string"))
    return view(s, d, "letters").select("doc_id", F.array_join(head, "|").alias("head"), routing.closing_text(way).alias("closing"))


@query("d10_weak_fields", "SELECT doc_id, count(DISTINCT field_path || CAST(c AS STRING)) AS n FROM (SELECT doc_id, field_path, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0 END AS c FROM evidence) WHERE c < 0.6 GROUP BY doc_id", ("evidence",))
def d10(s, d):
    return routing.weak_fields(view(s, d, "evidence")).select("doc_id", F.size("fields").cast("long").alias("n"))


@query("d11_missing_info_letter", "SELECT doc_id, 'Sayın ' || sender || chr(10) || chr(10) || 'İlgi: ' || subject || coalesce(' (' || number || ')', '') || chr(10) || chr(10) || 'Başvurunuzun sonuçlandırılabilmesi için aşağıdaki bilgilere ihtiyaç duyulmaktadır:' || chr(10) || chr(10) || '1) Adres?' || chr(10) || '2) ' || subject || chr(10) || chr(10) || 'Bilgilerinize sunulur.' AS letter FROM letters", ("letters",))
def d11(s, d):
    return view(s, d, "letters").select("doc_id", routing.missing_info_letter(F.col("sender"), F.col("subject"), F.col("number"), F.array(F.lit("Adres? "), F.col("subject"))).alias("letter"))


# --- register and board


@query("g5_register_search", "SELECT direction, institution, doc_id FROM letters WHERE direction = 'gelen' AND (contains(lower(subject), 'urgent') OR contains(lower(coalesce(number, '')), 'urgent') OR contains(lower(addressee), 'urgent'))", ("letters",))
def g5(s, d):
    rows = register.assign_numbers(view(s, d, "letters")).join(view(s, d, "letters").select("doc_id", "subject", "number", F.col("addressee").alias("party")), "doc_id")
    return register.search(rows, direction="gelen", text="URGENT").select("direction", "institution", "doc_id")


@query("g8_answers", """SELECT doc_id, CAST(sum(CASE WHEN severity = 'hata' AND NOT (resolved OR q = 'kural_1') THEN 1 ELSE 0 END) AS BIGINT) AS critical_left FROM (SELECT doc_id, severity, resolved, rule_id AS q FROM items) GROUP BY doc_id HAVING max(CASE WHEN q = 'kural_1' THEN 1 ELSE 0 END) = 1""", ("items",))
def g8(s, d):
    items = view(s, d, "items").select("doc_id", "severity", "resolved", F.col("rule_id").alias("question"))
    answers = items.where("question = 'kural_1'").select("doc_id", "question", F.lit(" evet ").alias("answer")).distinct()
    return register.answers_close_gaps(items, answers)[1].select("doc_id", "critical_left")


@query("g9_transfers", "SELECT doc_id, 'N' || CAST(nation AS STRING) AS current_unit FROM letters WHERE direction = 'giden' AND nation % 2 = 0", ("letters",))
def g9(s, d):
    rows = view(s, d, "letters")
    recipients = rows.select("doc_id", F.when(F.col("nation") % 2 == 0, F.concat(F.lit("N"), F.col("nation").cast("string"))).alias("unit"))
    return register.transfers(rows.where("direction = 'giden'").select("doc_id", F.lit("N0").alias("from_unit"), "ts"), recipients).select("doc_id", "current_unit")


@query("a7_routing_hits", "SELECT 'N' || CAST(doc_id % 25 AS STRING) AS old_unit, 'N' || CAST((doc_id + 1) % 25 AS STRING) AS new_unit, count(*) AS n FROM decisions WHERE doc_id % 10 = 0 GROUP BY ALL", ("decisions",))
def a7(s, d):
    docs = view(s, d, "decisions")
    n = lambda k: F.concat(F.lit("N"), ((F.col("doc_id") + k) % 25).cast("string"))
    corrections = docs.where("doc_id % 10 = 0").select("doc_id", F.lit("birim").alias("kind"), F.array(n(0), n(1)).alias("fields"))
    return board.routing_hits(docs, corrections)[1]


@query("a8_funnel", "SELECT count(*) AS fetched, CAST(sum(CASE WHEN resolved THEN 1 ELSE 0 END) AS BIGINT) AS verified, CAST(sum(CASE WHEN resolved THEN 0 ELSE 1 END) AS BIGINT) AS dropped FROM items", ("items",))
def a8(s, d):
    return board.funnel(view(s, d, "items").select(F.col("resolved").alias("verified")))


@query("a10_saved_time", "SELECT doc_id, round((doc_id % 50) * 250 * (score * 12 + (1 - score) * 8) / 60, 6) AS hours FROM decisions", ("decisions",))
def a10(s, d):
    saved = board.saved_time(F.col("doc_id") % 50, F.lit(12.0), F.col("score"))
    return view(s, d, "decisions").select("doc_id", F.round(saved["hours"], 6).alias("hours"))


# --- evaluation and corpus


def _defects(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("defect"), F.when(F.col("o_orderkey") % 2 == 0, "taranmis").otherwise("metin").alias("format"))


@query("e5_rule_alarms", "SELECT rule_id, format, count(*) AS alarms FROM items i JOIN (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'taranmis' ELSE 'metin' END AS format FROM orders WHERE o_orderstatus = 'O') o USING (doc_id) GROUP BY GROUPING SETS ((rule_id), (rule_id, format))", ("items",))
def e5(s, d):
    return evaluate.rule_alarms(view(s, d, "items"), _defects(s, d))


@query("e5_rule_catches", "SELECT o.o_orderstatus AS defect, 'kural_1' AS rule_id, count(*) AS n, CAST(sum(CASE WHEN i.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS caught FROM orders o LEFT JOIN (SELECT DISTINCT doc_id FROM items WHERE rule_id = 'kural_1') i ON i.doc_id = o.o_orderkey WHERE o.o_orderstatus <> 'O' GROUP BY 1", ("items",))
def e5c(s, d):
    expected = s.createDataFrame([("F", "kural_1"), ("P", "kural_1")], "defect string, rule_id string")
    return evaluate.rule_catches(view(s, d, "items"), _defects(s, d), expected)


@query("e8_e9_sender_calibration", """SELECT 'k' AS kind, count(*) AS measured, CAST(sum(CASE WHEN doc_id % 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS "right" FROM letters""", ("letters",))
def e8(s, d):
    rows = view(s, d, "letters")
    labels = rows.select("doc_id", F.lit("k").alias("kind"), F.lit(True).alias("measurable"), F.lit(None).cast("string").alias("detsis_no"), F.col("addressee").alias("name"))
    predicted = rows.select("doc_id", F.lit(None).cast("string").alias("detsis_no"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lower("addressee"), F.lit("."))).alias("name"))
    return evaluate.sender_outcomes(predicted, labels)


@query("e9_calibration", """SELECT CAST(CASE WHEN score >= 1 THEN 1.0 WHEN score >= 0.9 THEN 0.9 WHEN score >= 0.85 THEN 0.85 WHEN score >= 0.75 THEN 0.75 ELSE 0.0 END AS DOUBLE) AS band, count(*) AS n, CAST(sum(CASE WHEN writer_uncertain THEN 0 ELSE 1 END) AS BIGINT) AS "right" FROM decisions GROUP BY 1""", ("decisions",))
def e9(s, d):
    return evaluate.calibration(view(s, d, "decisions").select(F.col("score").alias("confidence"), (~F.col("writer_uncertain")).alias("right")))


@query("e10_closing_coverage", "SELECT count(*) AS n, CAST(sum(CASE WHEN doc_id % 3 = 0 AND doc_id % 2 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS missed_superior, CAST(sum(CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS false_superior, CAST(sum(CASE WHEN doc_id % 2 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM letters", ("letters",))
def e10(s, d):
    rows = view(s, d, "letters")
    return evaluate.closing_coverage(rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "ust").otherwise("bulunamadi").alias("position")), rows.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "ust").otherwise("alt").alias("direction")))


@query("e11_compare_runs", "SELECT count(*) AS n, CAST(sum(CASE WHEN expected = predicted THEN 1 ELSE 0 END) AS BIGINT) AS hits_a, CAST(sum(CASE WHEN expected = 'iyi' THEN 1 ELSE 0 END) AS BIGINT) AS hits_b, CAST(sum(CASE WHEN predicted IS DISTINCT FROM 'iyi' THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM pairs", ("pairs",))
def e11(s, d):
    rows = view(s, d, "pairs")
    return evaluate.compare_runs(rows.select("doc_id", F.col("predicted").alias("value")), rows.select("doc_id", F.lit("iyi").alias("value")), rows)


@query("e12_agent_claims", """SELECT nullif(o_orderstatus, 'O') AS defect, count(*) AS claims, CAST(sum(CASE WHEN resolved THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN resolved AND o_orderstatus <> 'O' THEN 1 ELSE 0 END) AS BIGINT) AS "right" FROM items LEFT JOIN orders ON o_orderkey = doc_id GROUP BY 1""", ("items",))
def e12(s, d):
    return evaluate.agent_claims(view(s, d, "items").select("doc_id", F.col("resolved").alias("verified")), _defects(s, d))


@query("e13_scan_quality", "SELECT 'm' || CAST(nation % 2 AS STRING) AS engine, count(*) AS n, round(avg(CASE WHEN number IS NOT NULL THEN CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE 1.0 END END), 9) AS number FROM letters GROUP BY 1", ("letters",))
def e13(s, d):
    rows = view(s, d, "letters")
    labels = rows.select("doc_id", "number", F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("code"), F.lit(0.5).alias("turkish_ratio"), F.lit(4).alias("terms"))
    found = rows.select("doc_id", F.concat(F.lit("m"), (F.col("nation") % 2).cast("string")).alias("engine"), F.when(F.col("doc_id") % 7 != 0, F.col("number")).alias("number"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("code"), F.lit(0.4).alias("turkish_ratio"), F.lit(3).alias("terms_found"))
    return evaluate.scan_quality(found, labels).select("engine", "n", F.round("number", 9).alias("number"))


@query("e16_forbidden_repeats", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(number, '') ELSE strftime(day, '%d.%m.%Y') END AS repeats FROM letters", ("letters",))
def e16(s, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Sayı "), F.coalesce("number", F.lit("yok")))).otherwise(F.concat(F.lit("Tarih "), F.date_format("day", "dd.MM.yyyy")))
    return view(s, d, "letters").select("doc_id", F.array_join(evaluate.forbidden_repeats(text, F.col("number"), F.col("day")), ",").alias("repeats"))


def _rule_sets(s, d):
    found = view(s, d, "items").groupBy("doc_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    return found.join(_defects(s, d).select("doc_id", "defect"), "doc_id").where("defect is not null")


@query("q3_defect_audit", "SELECT i.doc_id, o.o_orderstatus AS defect, max(CASE WHEN rule_id = 'kural_1' THEN 1 ELSE 0 END) = 1 AS tripped FROM items i JOIN orders o ON o.o_orderkey = i.doc_id WHERE o.o_orderstatus <> 'O' GROUP BY 1, 2", ("items",))
def q3(s, d):
    expected = s.createDataFrame([("F", ["kural_1"]), ("P", ["kural_1"])], "defect string, rules array<string>")
    clean = _rule_sets(s, d).select("doc_id", F.array().cast("array<string>").alias("rules"))
    return corpus.defect_audit(_rule_sets(s, d), clean, expected).select("doc_id", "defect", "tripped")


@query("b6_side_effects", "SELECT i.doc_id, count(DISTINCT rule_id) AS n FROM items i JOIN orders o ON o.o_orderkey = i.doc_id WHERE o.o_orderstatus <> 'O' AND rule_id <> 'kural_1' GROUP BY 1", ("items",))
def b6(s, d):
    expected = s.createDataFrame([("F", ["kural_1"]), ("P", ["kural_1"])], "defect string, rules array<string>")
    clean = _rule_sets(s, d).select("doc_id", F.array().cast("array<string>").alias("rules"))
    return corpus.side_effects(_rule_sets(s, d), clean, expected).select("doc_id", F.size("unexpected").cast("long").alias("n"))


@query("q4_printed_text", "SELECT doc_id, addressee AS value FROM letters WHERE doc_id % 3 = 0", ("letters",))
def q4(s, d):
    rows = view(s, d, "letters")
    printed = rows.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.concat(F.lit("Sayın  "), F.regexp_replace("addressee", "_", " _ "))).alias("text"))
    return corpus.printed_text_audit(printed, rows.select("doc_id", F.col("addressee").alias("value"), F.lit(True).alias("wanted"))).select("doc_id", "value")


@query(
    "b2_assign_flags",
    """WITH r AS (SELECT o_orderkey AS id, o_orderstatus = 'P' AS must, row_number() OVER (ORDER BY o_orderstatus = 'P' DESC, (o_orderkey * 7919) % 1000003 DESC) AS place, count(*) OVER () AS n FROM orders) SELECT id, must OR place <= n // 3 AS flag FROM r""",
)
def b2(s, d):
    """All open orders, and of the others those of the greatest weight until a third of the table has the flag."""
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    weight = F.col("id") * 7919 % 1000003
    return corpus.assign_flags(rows, "flag", F.col("o_orderstatus") == "P", rows.count() // 3, weight).select("id", "flag")


@query("b3_allowed_defects", "SELECT doc_id, CAST(CASE WHEN number IS NULL THEN 1 ELSE 2 END + doc_id % 2 AS INT) AS n FROM letters", ("letters",))
def b3(s, d):
    rows = view(s, d, "letters").select("doc_id", "number", "addressee", (F.col("doc_id") % 2 == 1).alias("has_reference"), F.lit(False).alias("has_attachment"), F.lit("sunulur").alias("closing"))
    return corpus.allowed_defects(rows).select("doc_id", F.size("defects").alias("n"))


@query("q1_opening_words", "WITH w AS (SELECT list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS a FROM documents) SELECT coalesce(array_to_string(a[1:3], ' '), '') AS opening, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, opening LIMIT 3")
def q1o(s, d):
    return corpus.opening_words(table(s, d, "documents"))


@query("p5_hard_cases", "(SELECT doc_id AS id, source AS class, true AS bad_scan FROM documents WHERE n_chars < 500 ORDER BY id LIMIT 20) UNION ALL (SELECT doc_id, source, false FROM documents WHERE NOT n_chars < 500 ORDER BY 1 LIMIT 40)")
def p5(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("class"), (F.col("n_chars") < 500).alias("bad_scan"))
    return sampling.hard_cases(rows, 60)


@query("w1_intake_step", """SELECT doc_id, coalesce(number, '') <> '' AS auto FROM letters""", ("letters",))
def w1(s, d):
    """What one micro-batch of the intake stream computes."""
    letters = view(s, d, "letters").select("doc_id", "number", F.array(F.lit("u")).alias("sdp_candidates"), F.lit("u").alias("addressee_unit"), F.lit("a").alias("number_code"), F.lit("a").alias("subject_code"), F.array().cast("array<string>").alias("subject_candidates"), F.lit(None).cast("string").alias("model_narrow"), F.lit(None).cast("string").alias("model_wide"))
    errors = rules.report(rules.run_rules(letters, [rules.Rule("A", "bos_olmamali", path="number")])).select("doc_id", F.col("violated").alias("critical_missing"))
    state = routing.route(letters).join(errors, "doc_id").select("*", F.lit(None).cast("boolean").alias("gave_up"), F.lit(0).alias("open_errors"), F.lit(False).alias("writer_uncertain"))
    return routing.gate(state).select("doc_id", "auto")
