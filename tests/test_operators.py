"""Operators on literal rows: documented cases, tie rules, guards, and properties such as gap-free numbers."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from paperflow.operators import board, corpus, evaluate, fields, lines, lint, matching, register, routing, rules, sampling
from paperflow.sources import dimensions, readers

UNITS = "code string, name string, parent_code string, level int, detsis_no string, sdp_codes array<string>, routable boolean, institution string"


@pytest.fixture(scope="module")
def units(spark):
    rows = [("R", "Yenimahalle Belediye Başkanlığı", None, 0, "1", [], True, "R"), ("F", "Fen İşleri Müdürlüğü", "R", 2, "2", ["198.02"], True, "R"), ("İ", "İmar Müdürlüğü", "R", 2, "3", ["198"], True, "R"), ("K", "Kurul", "R", 1, None, ["300"], False, "R")]
    return spark.createDataFrame(rows, UNITS)


def letter(spark, *texts):
    return spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc_id string, line_no int, text string")


# --- lines and fields


def test_lines_from_words_anchors_on_the_first_word(spark):
    words = [("d", 1, 100.0, 1.0, "a"), ("d", 1, 105.0, 2.0, "b"), ("d", 1, 107.0, 3.0, "c"), ("d", 1, 108.0, 5.0, "c"), ("d", 1, 108.0, 4.0, "d"), ("d", 1, 107.5, 3.5, "c")]
    got = lines.lines_from_words(spark.createDataFrame(words, "doc_id string, page int, y double, x double, text string")).orderBy("line_no").collect()
    assert [(r.line_no, r.text) for r in got] == [(1, "a b"), (2, "c d c")]


def test_lines_of_whole_batches_equal_a_plain_loop():
    import random

    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((d, p, rng.choice([0.0, 3.0, 5.5, 6.0, 9.0, 14.0, 20.0]), float(rng.randint(0, 4)), rng.choice("abcç")) for d in range(6) for p in (1, 2) for _ in range(rng.randint(1, 40)))
    expected = []
    for key in sorted({r[:2] for r in rows}):
        page, lines_ = [r[2:] for r in rows if r[:2] == key], []
        for y, x, text in page:
            if not lines_ or y - lines_[-1][0] > 6.0:
                lines_.append((y, []))
            lines_[-1][1].append((x, text))
        for no, (y, found) in enumerate(lines_, 1):
            texts = [t for _, t in sorted(found)]
            expected.append((*key, no, y, " ".join(t for i, t in enumerate(texts) if not i or t != texts[i - 1])))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "page", "y", "x", "text"])
    assert list(zip(*(c.to_pylist() for c in lines._page_lines(batch, 6.0)), strict=True)) == expected


def test_deskew(spark):
    import math

    a = math.radians(4)
    words = [("d", 1, 20.0 * i, 30.0 * j, f"w{j}") for i in range(8) for j in range(12)]
    turned = [(d, p, x * math.sin(a) + y * math.cos(a), x * math.cos(a) - y * math.sin(a), t) for d, p, y, x, t in words]
    frame = spark.createDataFrame(turned, "doc_id string, page int, y double, x double, text string")
    assert lines.lines_from_words(frame).count() > 8 and lines.lines_from_words(lines.deskew(frame)).count() == 8


def test_footer(spark):
    rows = [("d", 1, "gövde", 100.0), ("d", 2, "Doğrulama Kodu: ABCDEFGH1", 700.0), ("d", 3, "Adres", 720.0), ("e", 1, "gövde Bu belge, güvenli elektronik imza ile imzalanmıştır.", 100.0), ("e", 2, "1/2", 800.0), ("f", 1, "Faks: 1", 800.0)]
    got = lines.strip_stock_phrases(lines.split_footer(spark.createDataFrame(rows, "doc_id string, line_no int, text string, y double")))
    assert sorted((r.doc_id, r.line_no, r.part, r.weak) for r in got.collect()) == [("d", 1, "body", False), ("d", 2, "footer", False), ("d", 3, "footer", False), ("e", 1, "body", False), ("e", 1, "footer", False), ("e", 2, "dropped", False), ("f", 1, "footer", True)]


def test_document_parts_and_fields(spark):
    rows = letter(spark, "T.C.", "ÇANKAYA BELEDİYESİ", "Sayı : E-24316060-010.06-66473254 04.05.2026", "Konu : İmar Durumu", "hakkında", "YENİMAHALLE BELEDİYE BAŞKANLIĞINA", "(Fen İşleri Müdürlüğü)", "İlgide kayıtlı yazı incelendi.", "Gereğini arz ederim.", "Zeynep YILDIRIM", "Vali a.", "İl Müdürü", "Ek: Liste (2 Sayfa)", "DAĞITIM", "Gereği", "A Birimi", "Bilgi", "B Birimi")
    part = lines.document_parts(rows).first()
    assert (part.addressee_line, part.family, part.letterhead, part.closing_line) == (6, "kurum", ["ÇANKAYA BELEDİYESİ"], 9)
    assert part.body == "İlgide kayıtlı yazı incelendi. Gereğini arz ederim."
    f = fields.extract_fields(rows).first()
    assert f.number.value == "E-24316060-010.06-66473254" and f.date.value == "04.05.2026" and f.subject.value == "İmar Durumu hakkında"
    assert f.addressee.unit == "Fen İşleri Müdürlüğü" and f.addressee.confidence == 1.0
    assert (f.signature.name, f.signature.delegation, f.signature.title) == ("Zeynep YILDIRIM", "Vali a.", "İl Müdürü")
    assert [tuple(a) for a in f.attachments] == [("Liste", 2)] and [tuple(x) for x in f.distribution] == [("geregi", "A Birimi"), ("bilgi", "B Birimi")]


def test_number_beside_its_label(spark):
    f = fields.extract_fields(letter(spark, "E-10213773-120.02-15060727 28.05.2026", "Sayı", "İlgi : 03.02.2026 tarihli ve E-32625594-106-46817055 sayılı yazı.", "GAZİ ÜNİVERSİTESİNE")).first()
    assert (f.number.value, f.number.confidence, f.date.value) == ("E-10213773-120.02-15060727", 0.85, "28.05.2026")
    assert f.reference.number == "E-32625594-106-46817055"


def test_addressee_passes(spark):
    got = letter(spark, "GENEL SEKRETERLİĞE", "İLGİLİ MAKAMA", "ANKARA VALİLİĞİNE", "Ankara").select(lines.addressee_pass(F.col("text")), lines.why_no_addressee(F.col("text"))).collect()
    assert [r[0] for r in got] == [3, 2, 1, None] and got[3][1] == ["lower_case", "ending", "short"]
    assert lines.outline(letter(spark, "GENEL SEKRETERLİĞE", "İLGİLİ MAKAMA")).first().addressee_line == 2


def test_petition(spark):
    f = fields.extract_fields(letter(spark, "ÇANKAYA BELEDİYE BAŞKANLIĞINA", "Talebim vardır. Arz ederim.", "Adres: x 26.01.2026 Onur ÖZKAN İmza")).first()
    assert f.date.value == "26.01.2026" and f.petition_signature.value == "Onur ÖZKAN"


# --- rules


RULES = [rules.Rule("A", "bos_olmamali", path="s", severity="hata", basis="Y 1"), rules.Rule("B", "regex_bulunmali", path="t", pattern="^x", scope="k"), rules.Rule("C", "bos_liste_olmamali", path="l"), rules.Rule("D", "dogru_olmali", path="b"), rules.Rule("E", "ozel_fonksiyon", path="t", other_path="s.a", function="ilgi_govdede"), rules.Rule("F", "sozluk", path="t", dictionary=("KÖTÜ",)), rules.Rule("G", "bos_olmamali", path="nope")]


def test_rule_order_and_emptiness(spark):
    docs = spark.createDataFrame([(1, (None,), "a\nx ilgili", [], None, "k"), (2, ("v",), None, ["q"], True, None), (3, ("v",), "kötü ilgi'de", ["q"], False, "z")], "doc_id int, s struct<a:string>, t string, l array<string>, b boolean, belge_turu string")
    got = {(r.doc_id, r.rule_id): r.status for r in rules.run_rules(docs, RULES).collect()}
    assert got == {
        (1, "A"): "ihlal", (1, "B"): "uygun", (1, "C"): "ihlal", (1, "D"): "alan_bos", (1, "E"): "veri_yok", (1, "F"): "uygun", (1, "G"): "yol_yok",
        (2, "A"): "uygun", (2, "B"): "kapsam_disi", (2, "C"): "uygun", (2, "D"): "uygun", (2, "E"): "alan_bos", (2, "F"): "alan_bos", (2, "G"): "yol_yok",
        (3, "A"): "uygun", (3, "B"): "kapsam_disi", (3, "C"): "uygun", (3, "D"): "ihlal", (3, "E"): "uygun", (3, "F"): "ihlal", (3, "G"): "yol_yok",
    }
    results = rules.run_rules(docs, RULES)
    assert all(r.checked + r.skipped == len(RULES) for r in rules.report(results).collect())
    assert [tuple(r) for r in rules.legal_basis(rules.findings(results, RULES)).collect()] == [(1, "Y", "1", "A")]


def test_rule_configuration_errors():
    for r in (rules.Rule("x", "?"), rules.Rule("x", "regex_bulunmali"), rules.Rule("x", "izinli_kume"), rules.Rule("x", "ozel_fonksiyon", function="none")):
        with pytest.raises(ValueError):
            rules.validate([r])
    assert rules.multiline("^a") == "(?m)^a" and rules.multiline("(?i)^a") == "(?m)(?i)^a" and rules.multiline("a^") == "a^"


def test_rule_smoke(spark):
    table = spark.createDataFrame([("B-01", r"^T\.C\.$")], "rule_id string, pattern string")
    samples = spark.createDataFrame([("B-01", "T.C.", True), ("B-01", "IC.", False), ("B-01", "IC.", True)], "rule_id string, text string, expected boolean")
    assert [r.text for r in rules.smoke_test(table, samples).collect()] == ["IC."]


def test_rule_list_and_overlay(spark):
    md = spark.createDataFrame([("| B-01 | Başlık… | Regex: `\"^T\\.C\\.$\"` | hata | Y 10 |",), ("| G-02 | Gövde | Boş olmamalı | uyarı | K 2 |",), ("| id | x |",)], "value string")
    got = {r.rule_id: r for r in dimensions.parse_rule_list(md).collect()}
    assert (got["B-01"].check, got["B-01"].pattern, got["B-01"].title_cut, got["B-01"].category) == ("regex_bulunmali", r"^T\.C\.$", True, "B")
    assert (got["G-02"].check, got["G-02"].severity) == ("bos_olmamali", "uyari")
    over = spark.createDataFrame([("G-02", "hata", True), ("X-1", None, None)], "rule_id string, severity string, enabled boolean")
    with pytest.raises(ValueError, match="X-1"):
        dimensions.overlay_rules(dimensions.parse_rule_list(md), over)
    laid = {r.rule_id: r for r in dimensions.overlay_rules(dimensions.parse_rule_list(md), over.where("rule_id <> 'X-1'")).collect()}
    assert laid["G-02"].severity == "hata" and laid["G-02"].enabled and not laid["B-01"].enabled
    assert [r[0] for r in dimensions.unknown_overrides(dimensions.parse_rule_list(md), over).collect()] == ["X-1"]


# --- style


def found(spark, text, **label):
    row = {"doc_id": 1, "text": text, "writer": "kurum", "direction": "ust", "attachment": False, "reference": False, "attachment_name": None, "forbidden_names": [], "key_terms": [], "sentence_counts": None} | label
    schema = "doc_id int, text string, writer string, direction string, attachment boolean, reference boolean, attachment_name string, forbidden_names array<string>, key_terms array<string>, sentence_counts array<int>"
    frame = spark.createDataFrame([tuple(row[x.split()[0]] for x in schema.split(", "))], schema)
    return {(r.rule_id, r.severity) for r in lint.lint(frame).collect()}


@pytest.mark.parametrize(
    ("text", "label", "want"),
    [
        ("Konu incelenmiştir. Bilgilerinize arz ederim.", {}, set()),
        ("Konu incelenmiştir. Rica ederim.", {}, {("ME-03", "hata")}),
        ("Konu incelenmiştir. Arz olunur.", {}, {("ME-02", "hata")}),
        ("Yarıda kes", {}, {("TAM-01", "hata"), ("ME-02", "hata")}),
        ("Biz inceledik. Arz ederim.", {}, {("K13.1", "hata")}),
        ("Alfabetik ve artık plastik. Arz ederim.", {}, set()),
        ("Planlıyoruz. Arz ederim.", {"writer": "ogrenci"}, set()),
        ("Müdürlüğümüz bakar. Arz ederim.", {"writer": "vatandas"}, {("VTD-01", "hata")}),
        ("Gazi tarafından yapıldı. Arz ederim.", {"forbidden_names": ["Gazi"]}, {("ATF-01", "hata")}),
        ("Gazi Eğitim Fakültesi öğrencisiyim. Arz ederim.", {"forbidden_names": ["Gazi"], "writer": "ogrenci"}, set()),
        ("Yürürlük tarihi 15.01.2026'dır. Arz ederim.", {"key_terms": ["yürürlük tarihi", "Belge Sureti", "mali destek ödemesi"]}, {("KPS-01", "hata")}),
        ("Liste ekte sunulmuştur. Arz ederim.", {}, {("EK-02", "hata")}),
        ("Konu incelendi. Arz ederim.", {"attachment": True, "reference": True}, {("EK-01", "hata"), ("ILG-03", "hata")}),
        ("Konu incelendi. İlgi yazı okundu. Arz ederim.", {"reference": True}, {("ILG-01", "uyari")}),
        ("İlgili birim baktı. Arz ederim.", {}, set()),
        ("Bir. İki oldu.\n\nArz ederim.", {"sentence_counts": [1, 1]}, {("BCM-02", "uyari")}),
        ("Arz ederim.", {"sentence_counts": [1, 1]}, {("BCM-01", "hata")}),
    ],
)
def test_lint(spark, text, label, want):
    assert found(spark, text, **label) == want


def test_draft_checks(spark):
    got = letter(spark, "Rapor ekte gönderilmiştir. Arz ederim. Rica ederim.", "Temiz metin. Arz ederim.").select(lint.draft_checks(F.col("text")).alias("f")).collect()
    assert [x.rule_id for x in got[0].f] == ["YZ-01", "YZ-02"] and got[1].f == []


# --- matching


def test_best_unit(spark, units):
    texts = spark.createDataFrame([("YENİMAHALLE BELEDİYE BAŞKANLIĞI Fen İşleri Müdürlüğü",), ("Fen İsleri Müdürlügu",), ("Fen İşleri Müdürlüğ",), ("başka",), (None,)], "text string")
    got = {r.text: (r.code, r.score) for r in matching.best_unit_match(texts, units).collect()}
    assert got["YENİMAHALLE BELEDİYE BAŞKANLIĞI Fen İşleri Müdürlüğü"] == ("F", 1.0) and got["Fen İsleri Müdürlügu"] == ("F", 1.0)
    assert got["Fen İşleri Müdürlüğ"][0] == "F" and 0.75 < got["Fen İşleri Müdürlüğ"][1] < 1 and "başka" not in got


def test_units_by_sdp_takes_the_longest_prefix(spark, units):
    docs = spark.createDataFrame([(1, "198.02.01"), (2, "198.05"), (3, "300.01"), (4, None), (5, "999")], "doc_id int, sdp string")
    got = {r.doc_id: (r.matched_code, r.candidates) for r in matching.units_by_sdp(docs, units).collect()}
    assert got == {1: ("198.02", ["F"]), 2: ("198", ["İ"]), 3: ("300", []), 4: (None, []), 5: (None, [])}


def test_other_matches(spark, units):
    docs = spark.createDataFrame([(1, "2"), (2, "9"), (3, None)], "doc_id int, k string")
    outside = spark.createDataFrame([("9", "Dış Kurum"), ("2", "gölge")], "detsis_no string, name string")
    assert {r.doc_id: (r.unit_code, r.outside_name) for r in matching.units_by_key(docs, units, "k", outside=outside).collect()} == {1: ("F", None), 2: (None, "Dış Kurum"), 3: (None, None)}
    catalog = spark.createDataFrame([("010", "Genel", "5", ["imar planı"], 1), ("010.01", "İmar", "10", [], 2)], "code string, name string, retention string, subjects array<string>, ord int")
    subjects = spark.createDataFrame([("İMAR PLANI hk.",), ("hava",)], "subject string")
    assert [tuple(r) for r in matching.code_from_subject(subjects, catalog).collect()] == [("İMAR PLANI hk.", "010")]
    codes = spark.createDataFrame([("010.01.05",), ("010",)], "sdp string")
    assert {r.code: (r.name, r.retention) for r in matching.code_names(codes, catalog).collect()} == {"010.01.05": ("İmar", None), "010": ("Genel", "5")}
    heads = spark.createDataFrame([(1, ["T.C.", "ANKARA VALİLİĞİ", "İl Müdürlüğü"])], "doc_id int, letterhead array<string>")
    patterns = spark.createDataFrame([("V", "ankara valiliği", 1), ("M", "Ankara Valiliği", 2), ("M", "il müdürlüğü", 2)], "institution string, line string, ord int")
    assert matching.letterhead_unit(heads, patterns).first().institution == "M"
    assert {r.code: r.root for r in dimensions.root_institution(units).collect()} == {"R": "R", "F": "R", "İ": "R", "K": "R"}


def root_by_walking(parents, code):
    seen = set()
    while code not in seen:
        seen.add(code)
        if not (parents.get(code) or "").strip():
            return code
        code = parents[code]
    return code


def test_root_institution_at_any_depth(spark):
    """A chain of 1,000, cycles of 1 to 50 with tails into them, unknown and blank parents, a third of all units below one."""
    parents = {f"c{i}": f"c{i - 1}" if i else None for i in range(1000)}
    for n in (1, 2, 3, 7, 16, 50):
        parents |= {f"r{n}_{i}": f"r{n}_{(i + 1) % n}" for i in range(n)} | {f"t{n}_{i}": f"t{n}_{i - 1}" if i else f"r{n}_{n // 2}" for i in range(9)}
    parents |= {"u0": "nowhere", "u1": "u0", "b0": "  ", "b1": "b0", **{f"h{i}": "c3" for i in range(500)}}
    rows = [*parents.items(), (None, "c1"), ("u1", "z")]  # a repeated code counts with its smallest parent
    got = {r.code: r.root for r in dimensions.root_institution(spark.createDataFrame(rows, "code string, parent_code string")).collect()}
    assert got == {c: root_by_walking(parents, c) for c in parents}
    assert dimensions.root_institution(spark.createDataFrame([], "code string, parent_code string")).count() == 0


def test_numbers_and_percentiles_without_exchange_reuse(spark):
    rows = spark.range(20_000).selectExpr("'gelen' AS direction", "concat('k', id % 3) AS institution", "id AS doc_id", "cast(id % 50 as timestamp) AS ts", "hash(id) % 1000000 AS ms")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = register.assign_numbers(rows).toPandas()
        for _, own in got.groupby("institution"):
            assert sorted(own.seq) == list(range(1, len(own) + 1))
        values = sorted(r.ms for r in rows.collect())
        assert board.rank_percentile(rows, "ms", 0.95, []).first()[0] == values[min(len(values) - 1, int(len(values) * 0.95))]
        assert board.median(rows, "ms", []).first()[0] == (values[9_999] + values[10_000]) / 2
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_reference_keeps_its_date_as_printed(spark):
    text = ["T.C.", "Kurum", "İlgi : 29.02.2019 tarihli ve 2019/7 sayılı yazı, 01.03.2019", "ANKARA MÜDÜRLÜĞÜNE", "Gereğini arz ederim."]
    f = fields.extract_fields(spark.createDataFrame([(1, i, x) for i, x in enumerate(text, 1)], "doc_id int, line_no int, text string")).first()
    assert (f.reference.date_text, f.reference.date, f.reference.number) == ("29.02.2019", None, "2019/7")


def test_hierarchy(spark):
    lists = spark.createDataFrame([("Ankara Valiliği", "ust", 0, "İçişleri Bakanlığı"), ("Ankara Valiliği", "alt", 2, "Çankaya Kaymakamlığı")], "institution string, position string, position_ord int, body string")
    pairs = spark.createDataFrame([("ANKARA VALİLİĞİ", "Çankaya Kaymakamlığı"), ("Ankara Valiliği", "Bilinmeyen"), ("xyz", "a")], "sender string, recipient string")
    assert {(r.sender, r.position) for r in matching.hierarchy_position(pairs, lists).collect()} == {("ANKARA VALİLİĞİ", "alt"), ("Ankara Valiliği", "bulunamadi"), ("xyz", "kurum_yok")}


def test_split_and_match_answers(spark):
    answers = spark.createDataFrame([("p", "giriş\n### BELGE 1\nilk\n## belge 12\nikinci metin\n#### BELGE 1\nx")], "batch string, text string")
    got = readers.split_batches(answers)
    assert [(r.ord, r.doc_no, r.body) for r in got.orderBy("ord").collect()] == [(0, None, "giriş"), (1, "001", "ilk"), (2, "012", "ikinci metin"), (3, "001", "x")]
    expected = spark.createDataFrame([("p", "001", 1), ("p", "002", 2)], "batch string, doc_no string, ord int")
    m = matching.match_answers(expected, got).first()
    assert (m.missing, m.extra, m.repeated, m.long_preamble) == (1, 1, 1, False)


# --- decisions


def test_gate_takes_the_least_component(spark):
    docs = spark.createDataFrame([(1, "u", 0.95, None, 0, False, 0, False), (2, None, 0.1, None, 0, False, 0, False), (3, "u", 0.9, False, 5, None, None, None), (4, "u", 0.9, None, 1, True, 2, True)], "doc_id int, target string, score double, gave_up boolean, open_errors long, writer_uncertain boolean, critical_missing long, conflict boolean")
    got = {r.doc_id: r for r in routing.gate(docs).collect()}
    assert (got[1].auto, got[1].trust) == (True, 0.95) and got[2].blockers == ["yonlendirme"] and got[2].trust == 0.1
    assert got[3].auto and got[4].blockers == ["taslak", "kimlik", "eksik", "celiski"] and got[4].trust == 0.0


def test_evidence_priority(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(1, "f", "regex", 0.5, "a", 1, t0), (1, "f", "llm", 0.99, "b", 2, t0), (1, "g", "llm", 7.0, "c", 3, t0), (1, "g", "llm", 0.2, "d", 4, t0), (1, "g", "llm", 0.2, "e", 5, t0)]
    ev = spark.createDataFrame(rows, "doc_id int, field_path string, method string, confidence double, quote string, ord int, ts timestamp")
    assert {r.field_path: r.quote for r in routing.best_evidence(ev).collect()} == {"f": "a", "g": "d"}
    assert routing.weakest_link(ev).first().weakest == 0.0 and routing.weak_fields(ev).first().fields == ["g", "g", "f"]


def test_route_conflict_goes_on_with_the_subjects_units(spark):
    docs = spark.createDataFrame([(1, ["a"], None, "x", "y", ["b", "c"], "c", None), (2, ["a"], None, "x", "y", ["b"], None, None), (3, ["a", "b"], "b", None, None, [], None, None), (4, [], None, None, None, [], None, "z"), (5, None, None, None, None, None, None, None)], "doc_id int, sdp_candidates array<string>, addressee_unit string, number_code string, subject_code string, subject_candidates array<string>, model_narrow string, model_wide string")
    got = {r.doc_id: (r.target, r.score, r.conflict) for r in routing.route(docs).collect()}
    assert got == {1: ("c", 0.70, True), 2: ("b", 0.40, True), 3: ("b", 1.0, False), 4: ("z", 0.45, False), 5: (None, 0.0, False)}


# --- register


def test_numbers_are_gap_free_and_idempotent(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["gelen", "giden"]), rng.choice("aaaab"), i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.randrange(300))) for i in range(400)]
    new = spark.createDataFrame(rows + rows[:20], "direction string, institution string, doc_id int, ts timestamp")
    first = register.assign_numbers(new.where("doc_id < 200"))
    both = register.assign_numbers(new, first).collect()
    assert {(r.direction, r.institution, r.doc_id, r.seq) for r in first.collect()} <= {tuple(r) for r in both}
    seen = {}
    for r in both:
        seen.setdefault((r.direction, r.institution), []).append(r.seq)
    assert all(sorted(s) == list(range(1, len(s) + 1)) for s in seen.values()) and len(both) == 400


def test_action_guards(spark):
    t = lambda i: dt.datetime(2026, 1, 1, 0, i)
    docs = spark.createDataFrame([(1, "insan_onayi_bekliyor", "u"), (2, "insan_onayi_bekliyor", "u")], "doc_id int, status string, unit string")
    rows = [(1, 1, t(1), "izleyici", "onayla", None, None), (1, 2, t(2), "memur", "reddet", " ", None), (1, 3, t(3), "memur", "onayla", None, None), (1, 4, t(4), "memur", "reddet", "r", None), (1, 5, t(5), "memur", "karari_geri_al", "r", None), (1, 6, t(6), "yonetici", "karari_geri_al", "r", None), (1, 7, t(7), "memur", "birim_degistir", "r", "v"), (1, 7, t(7), "memur", "birim_degistir", "r", "v")]
    actions = spark.createDataFrame(rows, "doc_id int, action_id long, ts timestamp, role string, action string, reason string, new_unit string")
    got = {r.doc_id: r for r in register.apply_actions(docs, actions).collect()}
    assert (got[1].status, got[1].unit, got[1].accepted, got[1].corrections) == ("insan_onayi_bekliyor", "v", 3, 1)
    assert [tuple(x) for x in got[1].rejected] == [(1, "yetki_yok"), (2, "gerekce_yok"), (4, "sonuclanmis"), (5, "yalniz_yonetici")] and got[2].accepted == 0


def test_percentile_rule(spark):
    for n in (1, 2, 20, 100):
        rows = spark.createDataFrame([("s", float(i % 7)) for i in range(n)], "stage string, ms double")
        want = sorted(float(i % 7) for i in range(n))[min(n - 1, int(n * 0.95))]
        assert board.rank_percentile(rows, "ms", 0.95, ["stage"]).first().p95 == want == board.rank_percentile(rows, "ms", 0.95, []).first().p95


# --- evaluation and corpus


def test_scores_and_numbers(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", None), ("b", "a"), ("b", "c")], "expected string, predicted string")
    assert abs(evaluate.macro_f1(pairs).first().macro_f1 - 0.25) < 1e-9
    rows = spark.createDataFrame([("1.250,00 ve 05.03.2026 ve 7", "5.000 ve 2026 ve 9 ve 05/03/2026")], "source string, summary string")
    assert rows.select(evaluate.unverified_numbers(F.col("summary"), F.col("source"))).first()[0] == ["5.000"]
    assert rows.select(evaluate.copy_ratio(F.lit("a b c d e f"), F.lit("x a b c d e y"))).first()[0] == 0.5


def test_corpus_jobs(spark):
    rows = letter(spark, "Uygun görülmüştür. Gereğini arz ederim. Saygıyla arz ederim.", "İlgide kayıtlı yazı ile istenmiştir. Arz ederim.")
    assert rows.select(corpus.flip_closing(F.col("text"))).first()[0].endswith("arz ederim. Saygıyla rica ederim.")
    broken = [r[0] for r in rows.select(corpus.break_reference(F.col("text"), F.lit(5))).collect()]
    assert "İlgi" not in broken[1] and broken[1].startswith("Konu değerlendirilmiş olup")
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id int, class string")
    assert sampling.class_covering(labels, 4).count() == 4 and sampling.proportional(labels, 4).count() == 4
    flagged = corpus.assign_flags(labels, "f", F.col("id") < 2, 5, F.lit(0.5)).where("f").collect()
    assert len(flagged) == 5 and {0, 1} <= {r.id for r in flagged}
    assert corpus.expand_quota(spark.createDataFrame([("x", 3), ("y", 0)], "cell string, n int")).count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "etiket_004.json").write_text('{"belge_no": "004", "sdp": {"kod": "010"}, "somut_bilgiler": {"a": "b"}}')
    (tmp_path / "etiket_005.json").write_text("{broken")
    got = {r.doc_no: r for r in readers.read_labels(spark, str(tmp_path)).collect()}
    assert got["004"].sdp.kod == "010" and got["004"].somut_bilgiler == {"a": "b"} and got["005"]._corrupt_record
    (tmp_path / "u.csv").write_text("﻿birim_kodu,birim_adi,ust_birim_kodu,hiyerarsi_seviyesi,sdp_kodlari\nA,Ad,,x,010; 020 ;\nA,Tekrar,,1,\nB,Kurul,A,1,\n", encoding="utf-8")
    units = {r.code: r for r in readers.read_units(spark, [str(tmp_path / "u.csv")]).collect()}
    assert units["A"].name == "Ad" and units["A"].level == 0 and units["A"].sdp_codes == ["010", "020"] and not units["B"].routable
    (tmp_path / "c.csv").write_text("kod,ad,ornek_konular\n010,Eski,a|b\n,Yok,\n010,Yeni,c| d\n", encoding="utf-8")
    row = readers.read_catalog(spark, str(tmp_path / "c.csv")).first()
    assert (row.code, row.name, row.subjects) == ("010", "Yeni", ["c", "d"])
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "govde_007.txt").write_text("bir\n\niki")
    assert [tuple(r) for r in readers.read_bodies(spark, str(tmp_path / "g")).collect()] == [("007", "bir\n\niki")]


def test_bare_name_after_many_faculty_names(spark):
    docs = spark.createDataFrame([(1, "Gazi Eğitim Fakültesi " * 10_001), (2, "Gazi Eğitim Fakültesi " * 10_001 + "Gazi tarafından")], "id int, text string")
    found = docs.select("id", F.size(lint.names(F.col("text"), F.array(F.lit("Gazi")), F.lit("ogrenci"))).alias("n"))
    assert {r.id: r.n for r in found.collect()} == {1: 0, 2: 1}


def test_style_checks_without_length_caps(spark):
    far = "x " * 500
    rows = [
        (1, "Konu incelendi. Gereğini arz ederim" + " " * 90 + ".", "kurum", None), (2, far + ". Bitti.", "kurum", None), (3, "aba Eğitim Fakültesi", "ogrenci", ["aba"]), (4, "ababa Eğitim Fakültesi arz", "ogrenci", ["aba"]), (5, "a\\Eb Bölümü", "ogrenci", ["a\\Eb"]),
        (6, "Gereğini arz" + " " * 200 + "ve rica ederim.", "kurum", None),
    ]
    frame = spark.createDataFrame(rows, "doc_id int, text string, writer string, forbidden_names array<string>").withColumn("direction", F.when(F.col("doc_id") == 6, "karma").otherwise("ust"))
    found = {(r.doc_id, r.rule_id, r.detail) for r in lint.lint(frame, groups=("completeness", "closing", "names")).collect()}
    assert not {x for x in found if x[0] in (1, 6) and x[1].startswith("ME")} and (2, "TAM-01", "short") in found
    assert {x[0] for x in found if x[1] == "ATF-01"} == {4}


def test_large_dimensions_are_joined_inverted(spark, units, monkeypatch):
    texts = spark.createDataFrame([("FEN İŞLERİ MÜDÜRLÜĞÜNE",), ("Yenimahalle Belediye Başkanlığı İmar Müdürlüğü",), ("başka",)], "text string")
    heads = spark.createDataFrame([(1, ["T.C.", "Yenimahalle Belediye Başkanlığı", "Fen İşleri Müdürlüğü"]), (2, ["x"])], "doc_id int, letterhead array<string>")
    lines_ = spark.createDataFrame([("R", "Yenimahalle Belediye Başkanlığı", 1), ("Q", "Belediye", 2)], "institution string, line string, ord int")
    catalog = spark.createDataFrame([("1", 1, "imar", ["fen"]), ("2", 2, "ab", [])], "code string, ord int, name string, subjects array<string>")
    subjects = spark.createDataFrame([("Fen ve imar",), ("cab",)], "subject string")
    small = lambda: (
        sorted(matching.best_unit_match(texts, units, fuzzy=False).collect()), sorted(tuple(r) for r in matching.letterhead_unit(heads, lines_, units).collect()), sorted(matching.code_from_subject(subjects, catalog).collect())
    )
    one = small()
    monkeypatch.setattr(matching, "ROWS", 1)
    assert small() == one and one[1][0][1:] == ("R", "F") and len(one[0]) == 2 and len(one[2]) == 2


SYLLABLES = "mu dur luk fen is ler i ba kan lik il ce me bel ed iye okul sag imar park bah zabi ta şo ğu ço".split()


def like_names(seed, n):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def misread(rng, name):
    out = list(name)
    for _ in range(rng.randint(0, 5)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "i", " "])
    return "".join(out)


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9])
def test_similarity_join_is_all_pairs(spark, monkeypatch, threshold):
    """Shards, blocks and bands of a few rows; short, long and repeated names; the bounds lose no pair."""
    monkeypatch.setattr(matching, "SHARD_NAMES", 40)
    monkeypatch.setattr(matching, "BLOCK_TEXTS", 30)
    rng = random.Random(3)
    names = [*like_names(1, 300), "a", "ab", "abc", "x" * 90, "uzun ad " * 40]
    texts = [misread(rng, rng.choice(names)) for _ in range(120)] + ["b", "ab", "x" * 100, "uzun ad " * 38, "", None]
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    got = {(r.t, r.n): r.score for r in matching.similar_names(frame(texts + texts[:9], "t"), frame(names + names[:5] + ["", None], "n"), threshold).collect()}
    ratio = lambda n, t: 1.0 if n == t else difflib.SequenceMatcher(None, n, t).ratio()
    assert got == {(t, n): ratio(n, t) for t in set(texts) if t for n in set(names) if ratio(n, t) >= threshold}


def test_best_fuzzy_unit_of_many(spark, monkeypatch):
    """The best of tied, levelled and repeated names, with more candidates than a dimension that is packed."""
    monkeypatch.setattr(matching, "SHARD_NAMES", 50)
    rng = random.Random(5)
    units = [(f"c{i % 180}", name, i % 3) for i, name in enumerate(like_names(2, 260) + like_names(2, 40))]
    texts = sorted({misread(rng, rng.choice(units)[1]) for _ in range(100)} - {""}) + ["başka bir şey tümüyle", None]
    frame = spark.createDataFrame(units, "code string, name string, level int")
    want = {}
    for x in texts[:-1]:
        low = x.replace("ş", "s").replace("ğ", "g").replace("ç", "c").replace("ü", "u")
        low, found = " ".join(low.split()), []
        for code, name, level in units:
            n = name.replace("ş", "s").replace("ğ", "g").replace("ç", "c")
            score = 1.0 if n in low else difflib.SequenceMatcher(None, n, low).ratio()
            if low and score >= 0.75:
                found.append((n in low, level, score, len(n), code, name))
        if found:
            want[x] = (max(found)[4], max(found)[2], max(found)[5])
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    one = {r.text: (r.code, r.score, r["name"]) for r in matching.best_unit_match(rows, frame).collect()}
    monkeypatch.setattr(matching, "ROWS", 10)
    assert one == want and {r.text: (r.code, r.score, r["name"]) for r in matching.best_unit_match(rows, frame).collect()} == want


def test_cross_minimum_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(corpus, "GRID_BLOCK", 4)
    rng = random.Random(6)
    rows = [(rng.choice([*range(9), None]), rng.choice([*"abcdefghijk", None])) for _ in range(300)]
    count = {}
    for a, b in rows:
        if a is not None and b is not None:
            count[a, b] = count.get((a, b), 0) + 1
    want = {(a, b): count.get((a, b), 0) for a in {x for x, _ in rows} - {None} for b in {y for _, y in rows} - {None}}
    got = {(r.a, r.b): r.n for r in corpus.cross_minimum(spark.createDataFrame(rows, "a int, b string"), "a", "b", 3).collect()}
    assert got == {k: n for k, n in want.items() if n < 3}
    assert corpus.cross_minimum(spark.createDataFrame([], "a int, b string"), "a", "b", 3).count() == 0


def test_first_rows_are_cut_where_they_lie(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("id", "id % 7 AS k")
    want = [r.id for r in rows.orderBy(F.desc("k"), "id").limit(1234).collect()]
    monkeypatch.setattr(sampling, "FEW", 10)
    for n, own in ((1234, want), (0, []), (5000, None), (9000, None), (1, want[:1])):
        got = [r.id for r in sampling.first_rows(rows, n, F.desc("k"), "id", slots=9).collect()]
        assert len(got) == len(set(got)) and (set(got) == set(own) if own is not None else len(got) == 5000)
    flagged = corpus.assign_flags(rows.withColumn("id", F.col("id")), "flag", F.col("k") == 0, 2000, F.col("id").cast("double")).where("flag")
    must = {i for i in range(5000) if i % 7 == 0}
    assert {r.id for r in flagged.collect()} == must | set(sorted(set(range(5000)) - must)[-(2000 - len(must)) :])


def test_quotes_in_all_documents(spark):
    docs = spark.createDataFrame([(1, "Karar  ALINDI, dosya kapandı.", "x"), (2, "başka", "karar alındı, dosya"), (3, None, None)], "doc_id int, body string, raw string")
    quotes = spark.createDataFrame([("karar alındı",), ("Dosya kapandı.",), ("kısa",), (None,), ("karar alındı",)], "quote string")
    assert sorted(tuple(r) for r in matching.verify_quotes(docs, quotes).collect()) == [(1, "Dosya kapandı.", "govde"), (1, "karar alındı", "govde"), (2, "karar alındı", "ham")]


def test_best_window_passes_over_hopeless_windows():
    from paperflow.functions import fuzzy

    assert fuzzy.best_window("abcdefgh", "zz abcdefxh zz", 0.75, 4) >= 0.75 and fuzzy.best_window("abcdefgh", "abc0def9xh" * 50, 0.8, 4, 0.8) == 0.0


def test_percentiles_costs_and_label_problems(spark):
    calls = spark.createDataFrame([("a", 10, 1, float(i)) for i in range(1, 12)] + [("b", 20, 2, None)], "model string, tokens int, candidates int, ms double")
    got = {r.model: (r.calls, r.p50, r.p95) for r in evaluate.call_costs(calls).collect()}
    assert got == {"a": (11, 6.0, 11.0), "b": (1, None, None)}
    assert board.median(calls, "ms", ["model"]).collect()[0].median == 6.0 and board.median(calls.where("ms < 11"), "ms", []).first().median == 5.5
    labels = spark.createDataFrame([(1, "ilgi_kopuk", False, False, "metin", "kurum", "1", "2020-01-02", None), (2, None, True, False, "metin", "kurum", None, "2020-01-02", "2020-01-02"), (3, "konu_eksik", False, False, "metin", "vatandas", "x", "2020-01-02", None), (4, None, False, False, "metin", "kurum", "1", "2020-01-02", None)], "doc_id int, defect string, has_reference boolean, has_attachment boolean, format string, writer string, number string, day string, reference_day string")
    assert sorted(tuple(r) for r in corpus.label_problems(labels).collect()) == [(1, "ilgi_kopuk_without_reference"), (2, "letter_without_number"), (2, "reference_not_before_letter"), (3, "official_defect_in_petition"), (3, "petition_with_number")]


def test_many_rules_read_the_documents_once(spark):
    many = [rules.Rule(f"R-{i:03d}", "bos_olmamali", path="text") for i in range(130)]
    out = rules.run_rules(spark.createDataFrame([(1, "x", "k"), (2, None, "k")], "doc_id int, text string, belge_turu string"), many)
    assert out.count() == 260 and out.where("status = 'ihlal'").count() == 130 and "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_closing_folds_a_text_once(spark):
    """However many phrases are looked for: the plan lowers the text in one place, and findings stay what they are."""
    texts = [("Gereğini Arz Ederim.",), ("Bilgilerinize rica ederim.",), ("Arz olunur.",), (None,)]
    found = spark.createDataFrame(texts, "text string").select(lint.closing(F.col("text"), F.lit("kurum"), F.lit("ust")).alias("found"))
    assert found._jdf.queryExecution().analyzed().toString().count("lower(") == 1
    assert [[(f.rule_id, f.detail) for f in r.found] for r in found.collect()] == [[], [("ME-03", "direction")], [("ME-02", "forbidden"), ("ME-02", "missing")], [("ME-02", "missing")]]
