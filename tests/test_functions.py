"""Text functions on literal cases, the Unicode forms against Python, and the fuzzy ratio against difflib."""

import difflib
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperflow.functions import fuzzy, similar
from paperflow.functions import text as t
from paperflow.operators import corpus

TURKISH = str.maketrans("İIıŞşĞğÇçÖöÜüÂâÎîÛû", "iiissggccoouuaaiiuu")


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def folded(s):
    low = unicodedata.normalize("NFD", (s or "").translate(TURKISH).lower())
    return " ".join("".join(c for c in low if not unicodedata.combining(c)).split())


def test_fold(spark):
    cases = ["Fen Bilimleri Enstitüsü Müdürlüğü", "MÜDÜRLÜĞÜNE", "mudurlugune", None, "  a\n b ", "ÉÀ ñ"]
    got = column(spark, cases, t.fold)
    assert got == [folded(c) for c in cases] and got[0] == "fen bilimleri enstitusu mudurlugu" and got[1] == got[2]
    assert column(spark, ["Ḿ ǻ x́"], t.fold_exact) == [folded("Ḿ ǻ x́")]
    assert column(spark, ["İl 10 |"], t.fold_hard) == ["ii io i"]


def test_normalize_style(spark):
    assert column(spark, ["İlgi'de Vekâlet IŞIK", None], t.normalize_style) == ["ilgide vekalet ışık", ""]


def test_sentences_and_paragraphs(spark):
    text = "6. sınıf öğrencisi 12.05.2026 tarihinde A. Yılmaz ile geldi. Dr. Kaya yoktu! Neden? Bilinmiyor."
    assert column(spark, [text], t.sentences) == [["6. sınıf öğrencisi 12.05.2026 tarihinde A. Yılmaz ile geldi.", "Dr. Kaya yoktu!", "Neden?", "Bilinmiyor."]]
    assert column(spark, ["a\n \nb\n\n\n c ", None], t.paragraphs) == [["a", "b", "c"], []]


def test_numbers_and_dates(spark):
    got = column(spark, ["E-24316060-115.02.01-4471829", "2026/335", "E-1-2-3", None], t.number_parts)
    assert tuple(got[0]) == ("E", "24316060", "115.02.01", "4471829") and got[1:] == [None] * 3
    assert [str(d) if d else None for d in column(spark, ["05.03.2026", "31.02.2026", "5.3.2026", None], t.parse_tr_date)] == ["2026-03-05", None, None, None]
    assert column(spark, ["1.250,00 ve 5", None], t.numeric_tokens) == [["1.250,00", "5"], []]


def test_identity_numbers(spark):
    seeds = list(range(0, 3000, 37))
    made = column(spark, seeds, corpus.tckn_from_seed, "long")
    assert all(column(spark, made, t.tckn_valid)) and len(set(made)) == len(seeds)

    def valid(no):
        d = list(map(int, no))
        return d[0] != 0 and d[9] == (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10 and d[10] == sum(d[:10]) % 10

    assert all(valid(m) for m in made)
    assert column(spark, ["12345678901", "abc", None, "10000000146"], t.tckn_valid) == [False, False, False, True]
    assert all(column(spark, column(spark, seeds, corpus.phone_from_seed, "long"), t.phone_allocated))
    assert column(spark, ["0212 555 44 33", "+90 532 111 22 33"], t.phone_allocated) == [False, True]


def test_masks(spark):
    rows = spark.createDataFrame([("kisi_adi", "Ali Veli"), ("telefon", "05321112233"), ("eposta", "ayse@x.org"), ("adres", "Gül Sk. No 5"), ("dogum_tarihi", "01.02.1990"), ("plaka", "06AB1"), ("x", "abc"), ("tckn", None)], "k string, v string")
    assert [r[0] for r in rows.select(t.masked(F.col("k"), F.col("v"))).collect()] == ["A** V***", "053******33", "ay**@x.org", "Gül Sk. ***", "**.**.1990", "0**B1", "a**", None]
    assert [r[0] for r in rows.select(t.pii_flag(F.col("k"), F.lit(False))).collect()] == [True, True, True, True, False, False, False, True]


def test_small_functions(spark):
    assert column(spark, ["abcdef", "abc", None], lambda c: t.clip(c, 4)) == ["abc…", "abc", ""]
    assert column(spark, ["çaşa", "1", None], t.turkish_ratio) == [0.5, 0.0, 0.0]
    assert column(spark, ["MÃ¼dür", "Müdür", "Müdür"], t.garbled) == [True, False, True]
    assert column(spark, ["bu ve ile", "the cat", "şey"], t.looks_turkish) == [True, False, True]
    assert column(spark, ["a" * 31, "a b"], t.glued_words) == [True, False]
    assert [tuple(x) for x in column(spark, ["0.5", "1.5", "true", "x", None], t.confidence)] == [(0.5, True), (0.0, False), (0.0, False), (0.0, False), (0.0, False)]
    assert column(spark, [None, "", "Gizli", "ÇOK GİZLİ", "?"], t.secrecy_level) == [0, 0, 2, 3, None]
    assert column(spark, ["Başvurunun sonuçlandırılması için gerekli belgeler"], t.content_stems) == [["başvu", "belge"]]


@settings(max_examples=60, deadline=None)
@given(st.text("abcçş ", max_size=30), st.text("abcçş ", max_size=30))
def test_ratio_is_difflibs(a, b):
    want = 0.0 if not a or not b else 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()
    assert fuzzy._ratio(a, b) == want


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc ", max_size=60))
def test_best_window_against_all_windows(needle, text):
    got = fuzzy.best_window(needle, text, 0.8, 6)
    if needle in text:
        assert got == 1.0
    elif len(text) >= len(needle):
        step = max(1, len(needle) // 6)
        ratios = [difflib.SequenceMatcher(None, needle, text[i : i + len(needle) + step]).ratio() for i in range(0, len(text) - len(needle) + 1, step)]
        assert got == (max(ratios) if max(ratios) < 0.8 else next(r for r in ratios if r >= 0.8))


@settings(max_examples=150, deadline=None)
@given(st.text("abcd ", min_size=1, max_size=90), st.text("abcd ", max_size=200), st.sampled_from([0.6, 0.8, 0.95]), st.sampled_from([3, 4, 6]))
def test_seeded_windows_find_what_all_windows_find(needle, text, threshold, parts):
    got, want = fuzzy.best_window(needle, text, threshold, parts, threshold), fuzzy.best_window(needle, text, threshold, parts)
    assert got == want if want >= threshold else got <= want


def test_fuzzy_columns(spark):
    rows = spark.createDataFrame([("cankaya belediye baskanligi", "yenimahalle belediye baskanligi"), ("", "x"), (None, None)], "a string, b string")
    got = [r[0] for r in rows.select(fuzzy.ratio(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.759) < 0.01 and got[1:] == [0.0, 0.0]


def test_a_text_shorter_than_the_needle_gets_a_ratio_only_if_it_can_reach_the_threshold(monkeypatch):
    matched = []

    class Counted(similar.SequenceMatcher):
        def ratio(self):
            matched.append((self.a, self.b))
            return super().ratio()

    monkeypatch.setattr(similar, "SequenceMatcher", Counted)
    needle = "abcdefghij" * 8
    assert similar.best_window(needle, "abcdefghij" * 3, 0.8, 6) == 0.0 and similar.best_window(needle, "jihgfedcba" * 7 + "jihgfedcb", 0.8, 6) == 0.0 and not matched
    assert similar.best_window(needle, needle[:-2], 0.8, 6) >= 0.8 and len(matched) == 1


def test_windows_count_repeats_of_pairs_and_letters():
    needle = "abacabadabacabae" * 5
    assert len(similar.hopeful_windows(needle, "ba" * 200, 0.8, 13)) == 0  # of its letters and pairs only some, again and again
    text = "xyz" * 30 + needle[:-3] + "q" * 30
    at = similar.hopeful_windows(needle, text, 0.8, 13)
    width = len(needle) + 13
    want = [i for i in range(0, len(text) - len(needle) + 1, 13) if difflib.SequenceMatcher(None, needle, text[i : i + width]).ratio() >= 0.8]
    assert want and set(want) <= set(at.tolist())
    at_once, similar.CELLS = similar.CELLS, 1  # a window at a time
    try:
        assert similar.hopeful_windows(needle, text, 0.8, 13).tolist() == at.tolist()
    finally:
        similar.CELLS = at_once
