"""Style checks of letter bodies. Each group is an array-of-struct expression; findings are one explode, no shuffle.

Input columns: text, and the label columns writer, direction, attachment boolean, reference boolean, attachment_name,
forbidden_names array, key_terms array, sentence_counts array (null where there is no label: the check is then left out).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, WHITE, bound, content_stems, fold, normalize_style, nth, paragraphs, sentences, strip, text_or_empty

# Closings, word lists and patterns of official style.
CLOSINGS = {"arz": ["arz ederim"], "rica": ["rica ederim"], "karma": ["rica ederim"], "sunulur": ["bilgilerinize sunulur", "saygılarımla", "saygılarımı sunarım"]}
BOTH_CLOSINGS = r"arz\s*(?:ve|/)\s*rica ederim$"
FORBIDDEN_CLOSINGS = ["arz olunur", "rica olunur", "arz edilir", "rica edilir", "arz ederiz", "rica ederiz", "arz etmekteyiz", "rica etmekteyiz", "arz olunmaktadır", "rica olunmaktadır", "arz ve rica olunur"]
BY_DIRECTION = {"ust": "arz", "ayni": "arz", "alt": "rica", "karma": "karma", "gercek_kisi": "sunulur", "kurum_disi": "rica"}
FIRST_PERSON_MARKS = ["yor", "makta", "mekte", "acağ", "eceğ"]  # each of the suffixes below has one
FIRST_PERSON = r"(?U)\b\w{2,}(?:ıyoruz|iyoruz|uyoruz|üyoruz|ıyorum|iyorum|uyorum|üyorum|maktayız|mekteyiz|maktayım|mekteyim|acağız|eceğiz|acağım|eceğim)\b"
PAST_SUFFIXES = ["dık", "dik", "duk", "dük", "tık", "tik", "tuk", "tük"]
PAST_PLURAL = rf"(?U)\b(\w{{2,}}(?:{'|'.join(PAST_SUFFIXES)}))\b"
VERB_STEMS = """yap et al ver gör bul sun gönder iste incele değerlendir belirle belirt hazırla karar uygula başlat tamamla düşün bildir sapta
yaşa git gel kal kat edin öğren anla söyle yaz oku çalış kullan ekle çıkar geç dön bak sor cevapla düzenle düzelt onayla kabul ilet aktar taşı
kur gerçekleş sürdür yürüt izle denetle ölç hesapla planla teklif sağla üret""".split()
VOICES = ["t", "tir", "tır", "dir", "dır", "il", "ıl", "in", "ın", "n"]
NOT_VERBS = "artık açık ilgili yazık karışık kapalı aralık sıklık yaklaşık katılık darlık varlık birlik dirlik açıklık sağlık yatık".split()
FIRST_PERSON_WORDS = """ettik yaptık aldık verdik gördük bulduk sunduk gönderdik istedik inceledik değerlendirdik belirledik hazırladık
kararlaştırdık uyguladık başlattık tamamladık düşündük bildirdik saptadık yaşadık ettim yaptım aldım verdim gördüm buldum sundum gönderdim
istedim inceledim değerlendirdim belirledim hazırladım düşündüm bildirdim""".split()
PERSONAL_WRITERS = ["vatandas", "ogrenci", "ozel_tuzel"]
OFFICE_WORDS = ["müdürlüğümüz", "başkanlığımız", "bakanlığımız", "kurumumuz", "rektörlüğümüz", "valiliğimiz"]
FACULTY_WORDS = ["eğitim fakültesi", "fakültesi", "enstitüsü", "yüksekokulu", "meslek yüksekokulu", "hastanesi", "konservatuvarı", "bölümü"]
FORMS = [
    (r"(?m)^\s*T\.?C\.?\s*$", "header"), (r"(?m)^\s*(Sayı|Konu|İlgi|Tarih)\s*:", "metadata"), (r"(?m)^\s*(EK|EKİ|EKLER|DAĞITIM)\s*:", "attachments"),
    (r"(?m)\*\*|^#{1,6}\s|^\s*[-*+]\s+|^\s*\d+[.)]\s+", "markup"), (r"```", "code"), (r"\.\.\.|…", "ellipsis"), (r"(?mU)^\s*(İşte|Aşağıda|Tabii|Elbette)\b", "chatter"), (r"!", "exclamation"),
]
ATTACHED = r"(?U)\b(ekte\w*|ekinde\w*|ekimizde\w*|ilişikte\w*|ilişiğinde\w*|ek olarak|ekli\b|yazımız ekind\w*|ekled\w+|ekliyor\w*|eklenmiş\w*|eke dâhil|eke dahil|ekinde sun\w+)"
REFERRED = r"(?U)\bilgi(?:'de|de|ye|nde)?\b"
TITLE_FORM = r"^(?:[A-ZÇĞİÖŞÜ][A-Za-z0-9_çğıöşüâîûÇĞİÖŞÜ]*(?:\s+|$)){1,4}$"
REFERENCE_TERM = r"^\s*ilgi(?:de)?\s+(?:kayıtlı\s+)?(?:yazı|başvuru|talep|talebimiz|talimat|bildirim|bilgi talebimiz|yazıdaki husus|yazı ekindeki liste)\s*$"
CLOSING_TAIL = r"(?:bilgilerini(?:zi|ze)?\s+(?:ve\s+gereğini\s+)?)?(?:arz|rica)(?:\s*(?:ve|/)\s*rica)?\s+ederim\s*\.?\s*$"
COVERAGE = 0.6

# Rules made of the lists: past stems with and without a voice suffix, and the listed forms that PAST_PLURAL doesn't cover.
PAST_STEMS = sorted({stem + voice for stem in VERB_STEMS for voice in ("", *VOICES)})
LISTED = rf"(?U)\b({'|'.join(sorted(w for w in FIRST_PERSON_WORDS if not w.endswith(tuple(PAST_SUFFIXES))))})\b"
NONE = "array<struct<rule_id:string,severity:string,detail:string,quote:string>>"


def _finding(rule: str, severity: str, quote: Column | None = None, detail: str = "") -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(detail).alias("detail"), (quote if quote is not None else F.lit(None)).cast("string").alias("quote"))


def _when(condition: Column, finding: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(finding)).otherwise(F.array().cast(NONE))


def _any(text: Column, marks: list[str]) -> Column:
    """One of the marks occurs: a cheap test before a pattern that needs one of them."""
    return reduce(lambda out, m: out | text.contains(m), marks, F.lit(False))


def stripped(text: Column) -> Column:
    return strip(text_or_empty(text))


def tail(text: Column, n: int) -> Column:
    return F.substring(text, F.greatest(F.length(text) - n + 1, F.lit(1)), F.lit(n))


def completeness(text: Column) -> Column:
    """TAM-01."""
    t = stripped(text)
    ended = t.rlike(r"[.!?]$")
    alone = t.rlike(r"(?U)(?:\A|[.!?]\s+|\n\s*)\S+\z")  # else the last sentence has two words at least
    last = F.when(alone, nth(sentences(nth(paragraphs(t), -1)), -1))
    return F.concat(_when(t == "", _finding("TAM-01", "hata", detail="empty")), _when((t != "") & ~ended, _finding("TAM-01", "hata", tail(t, 60), "cut")), _when((t != "") & ended & (F.size(F.split(F.trim(last), SPACE)) < 2), _finding("TAM-01", "uyari", last, "short")))


def form(text: Column) -> Column:
    """BIC-01."""
    return F.concat(*[_when(text_or_empty(text).rlike(p), _finding("BIC-01", "hata", F.substring(F.trim(F.regexp_extract(text, f"({p})", 0)), 1, 50), d)) for p, d in FORMS])


def expected_closing(writer: Column, direction: Column) -> Column:
    out = F.when(writer == "vatandas", "arz")
    for d, c in BY_DIRECTION.items():
        out = out.when(direction == d, c)
    return out.otherwise("arz")


def closing(text: Column, writer: Column, direction: Column, n: Column | None = None) -> Column:
    """ME-02, ME-03."""
    if n is None:  # folded once, not for each phrase
        return bound(normalize_style(stripped(text)), lambda folded: closing(text, writer, direction, folded))
    bare = F.rtrim(n, F.lit(WHITE))
    bare = F.when(bare.endswith("."), F.rtrim(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit(WHITE))).otherwise(bare)
    ends = {kind: reduce(lambda out, p: out | bare.endswith(p), phrases, F.lit(False)) for kind, phrases in CLOSINGS.items()}
    ends["karma"] = ends["karma"] & bare.rlike(BOTH_CLOSINGS)
    wanted = expected_closing(writer, direction)
    has = reduce(lambda out, kv: out | ((wanted == kv[0]) & kv[1]), ends.items(), F.lit(False))
    other = reduce(lambda out, kv: out | kv[1], ends.items(), F.lit(False))
    last = tail(F.substring_index(stripped(text), "\n", -1), 70)
    forbidden = F.concat(*[_when(n.contains(w), _finding("ME-02", "hata", F.lit(w), "forbidden")) for w in FORBIDDEN_CLOSINGS])
    return F.concat(F.when(_any(n, ["arz ", "rica "]), forbidden).otherwise(F.array().cast(NONE)), _when(n.contains("önem arz et"), _finding("ME-02", "uyari", detail="importance")), _when(~has & other, _finding("ME-03", "hata", last, "direction")), _when(~has & ~other, _finding("ME-02", "hata", last, "missing")))


def first_person(text: Column, writer: Column, n: Column | None = None) -> Column:
    """K13.1: suffixes that only a first person has, past forms of known verbs, and a list of forms."""
    body = normalize_style(stripped(text)) if n is None else n
    body = F.when(_any(body, ["arz", "rica"]), F.regexp_replace(body, CLOSING_TAIL, "")).otherwise(body)
    words = F.array().cast("array<string>")
    sure = F.when(_any(body, FIRST_PERSON_MARKS), F.regexp_extract_all(body, F.lit(FIRST_PERSON), F.lit(0))).otherwise(words)
    stem = lambda w: F.substring(w, F.lit(1), F.length(w) - 3)  # noqa: E731  each suffix has three letters
    past = F.filter(F.regexp_extract_all(body, F.lit(PAST_PLURAL), F.lit(1)), lambda w: ~w.isin(NOT_VERBS) & stem(w).isin(PAST_STEMS))
    past = F.when(_any(body, PAST_SUFFIXES), past).otherwise(words)
    found = F.transform(F.concat(sure, past, F.regexp_extract_all(body, F.lit(LISTED), F.lit(1))), lambda w: _finding("K13.1", "hata", w))
    return F.when(F.coalesce(writer, F.lit("")).isin(PERSONAL_WRITERS), F.array().cast(NONE)).otherwise(found)


def office_words(text: Column, writer: Column, n: Column | None = None) -> Column:
    """VTD-01."""
    n = normalize_style(text) if n is None else n
    return F.concat(*[_when((writer == "vatandas") & n.contains(w), _finding("VTD-01", "hata", F.lit(w))) for w in OFFICE_WORDS])


def names(text: Column, forbidden: Column, writer: Column, n: Column | None = None) -> Column:
    """ATF-01: a student may use a name where every occurrence is part of a faculty's or school's name."""
    n = normalize_style(text) if n is None else n
    quoted = lambda name: F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    after = lambda name: F.regexp_extract_all(n, F.concat(F.lit("(?s)(?="), quoted(name), F.lit("(.{0,40}))")), F.lit(1))  # noqa: E731  overlapping occurrences too
    part = lambda name: F.forall(after(name), lambda t: reduce(lambda o, w: o | F.ltrim(t, F.lit(WHITE)).startswith(w), FACULTY_WORDS, F.lit(False)))
    bad = F.filter(F.coalesce(forbidden, F.array().cast("array<string>")), lambda f: n.contains(normalize_style(f)) & (F.trim(f) != "") & ~((F.coalesce(writer, F.lit("")) == "ogrenci") & part(normalize_style(f))))
    return F.transform(bad, lambda f: _finding("ATF-01", "hata", f))


def coverage(text: Column, terms: Column, n: Column | None = None) -> Column:
    """KPS-01: a key term whose content stems mostly don't occur."""
    n = normalize_style(text) if n is None else n
    terms = F.coalesce(terms, F.array().cast("array<string>"))

    def missed(have: Column) -> Column:
        hit = lambda s: F.exists(have, lambda m: m.startswith(s) | s.startswith(m))
        share = lambda t: bound(content_stems(t), lambda own: F.when(F.size(own) > 0, F.size(F.filter(own, hit)) / F.size(own)))
        return F.filter(terms, lambda t: ~t.rlike(TITLE_FORM) & ~normalize_style(t).rlike(REFERENCE_TERM) & ~n.contains(normalize_style(t)) & F.coalesce(share(t) < COVERAGE, F.lit(False)))

    bad = F.when(F.size(terms) > 0, bound(content_stems(text), missed)).otherwise(terms)
    return F.transform(bad, lambda t: _finding("KPS-01", "hata", t))


def attachments(text: Column, attachment: Column, name: Column, n: Column | None = None) -> Column:
    """EK-01, EK-02."""
    n = normalize_style(text) if n is None else n
    words = F.filter(F.split(normalize_style(name), SPACE), lambda w: F.length(w) > 4)
    named = F.coalesce((F.size(words) > 0) & F.forall(words, lambda w: n.contains(w)), F.lit(False))
    placed = _any(n, ["ek", "ilişi"]) & n.rlike(ATTACHED)
    return F.concat(_when(attachment & ~placed & ~named, _finding("EK-01", "hata")), _when(~attachment & placed, _finding("EK-02", "hata", F.regexp_extract(n, ATTACHED, 0))))


def references(text: Column, reference: Column, n: Column | None = None) -> Column:
    """ILG-01, ILG-02, ILG-03."""
    n = normalize_style(text) if n is None else n
    first = normalize_style(nth(sentences(nth(paragraphs(text), 1)), 1))
    here, anywhere = F.coalesce(first.rlike(REFERRED), F.lit(False)), n.contains("ilgi") & n.rlike(REFERRED)
    return F.concat(_when(reference & ~here & anywhere, _finding("ILG-01", "uyari", F.substring(first, 1, 70))), _when(~reference & anywhere, _finding("ILG-02", "hata")), _when(reference & ~here & ~anywhere, _finding("ILG-03", "hata", F.substring(first, 1, 70))))


def structure(text: Column, counts: Column) -> Column:
    """BCM-01, BCM-02."""
    parts = paragraphs(text)
    same = F.size(parts) == F.size(counts)
    own = F.transform(parts, lambda p: F.size(sentences(p)))
    off = F.filter(F.transform(F.arrays_zip(own.alias("own"), counts.alias("wanted")), lambda z: F.when(z["own"] != z["wanted"], _finding("BCM-02", "uyari", F.concat_ws("/", z["own"].cast("string"), z["wanted"].cast("string"))))), lambda x: x.isNotNull())
    return F.when(counts.isNull(), F.array().cast(NONE)).when(same, off).otherwise(F.array(_finding("BCM-01", "hata", F.size(parts).cast("string"))))


GROUPS = ("completeness", "form", "closing", "first_person", "office_words", "names", "coverage", "attachments", "references", "structure")


def lint(bodies: DataFrame, id_col: str = "doc_id", groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """id_col, rule_id, severity, detail, quote of every finding."""
    have = set(bodies.columns)
    style = "_style"
    while style in have:
        style += "_"
    bodies = bodies.withColumn(style, normalize_style(stripped(F.col("text"))))  # once; referenced often, so it stays a projection
    c = lambda name, kind="string": F.col(name) if name in have else F.lit(None).cast(kind)
    text, n = F.col("text"), F.col(style)
    made = {
        "completeness": lambda: completeness(text), "form": lambda: form(text), "closing": lambda: closing(text, c("writer"), c("direction"), n), "first_person": lambda: first_person(text, c("writer"), n),
        "office_words": lambda: office_words(text, c("writer"), n), "names": lambda: names(text, c("forbidden_names", "array<string>"), c("writer"), n), "coverage": lambda: coverage(text, c("key_terms", "array<string>"), n),
        "attachments": lambda: attachments(text, c("attachment", "boolean"), c("attachment_name"), n), "references": lambda: references(text, c("reference", "boolean"), n), "structure": lambda: structure(text, c("sentence_counts", "array<int>")),
    }
    return bodies.select(id_col, F.explode(F.concat(*[made[g]() for g in groups])).alias("f")).select(id_col, "f.rule_id", "f.severity", "f.detail", "f.quote")


def clean_flags(bodies: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, clean: without a finding of the level hata."""
    bad = found.where("severity = 'hata'").select(id_col).distinct().withColumn("bad", F.lit(True))
    return bodies.select(id_col).join(bad, id_col, "left").select(id_col, F.col("bad").isNull().alias("clean"))


def draft_checks(text: Column) -> Column:
    """YZ-01: claims an attachment near a verb of sending; YZ-02: more than one closing phrase."""
    n, folded = normalize_style(text), fold(text)
    claims = n.rlike(rf"(?:{ATTACHED[4:]}).{{0,80}}(?:gönder|sunul|ilet)") | n.rlike(rf"(?:gönder|sunul|ilet).{{0,80}}(?:{ATTACHED[4:]})")
    phrases = F.regexp_extract_all(folded, F.lit(r"(arz ve rica ederim|arz/rica ederim|arz ederim|rica ederim|bilgilerinize sunulur)"), F.lit(1))
    return F.concat(_when(claims, _finding("YZ-01", "uyari")), _when(F.size(phrases) > 1, _finding("YZ-02", "hata", F.array_join(phrases, "; "))))


def without_conflicts(found: DataFrame, direction: str = "direction") -> DataFrame:
    """Findings without those of ME-02 in letters to natural persons, which the two rule sets decide differently."""
    return found.where(~((F.col(direction) == "gercek_kisi") & (F.col("rule_id") == "ME-02")) | F.col(direction).isNull())

