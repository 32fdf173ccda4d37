"""Text functions: Column in, Column out, on built-in expressions (the two Unicode normal forms excepted)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The Turkish letter map, confusions of scanned text, word lists and code tables.
TURKISH_FROM, TURKISH_TO = "İIıŞşĞğÇçÖöÜüÂâÎîÛû", "iiissggccoouuaaiiuu"
SCAN_FROM, SCAN_TO = "1l|0", "iiio"
LATIN_FROM = "ÀÁÃÄÅÈÉÊËÌÍÏÑÒÓÔÕÙÚÝàáãäåèéêëìíïñòóôõùúýÿ"
LATIN_TO = "AAAAAEEEEIIINOOOOUUYaaaaaeeeeiiinoooouuyy"
ABBREVIATIONS = "Hk hk vb vs md bkz Sn Dr Doç Prof Yrd No no ör yy sy bs çev haz age vd Av Tel Fax Mah Cad Sok Apt Blv".split()
PERSONAL_TYPES = ["kisi_adi", "tckn", "iban", "telefon", "eposta", "adres"]
ENTITY_TYPES = [*PERSONAL_TYPES, "kurum_adi", "birim_adi", "tarih", "sayi", "plaka", "vergi_no", "dogum_tarihi", "para", "yer", "diger"]
MOJIBAKE = ["Ã¼", "Ã§", "Ã¶", "ÄŸ", "Ä±", "ÅŸ", "Ã‡", "Ãœ", "Ã–", "�"]
MARKER_WORDS = ["ve", "ile", "için", "olarak", "bir", "bu", "ederim", "hakkında"]
STOP_WORDS = """ve veya ile de da ki bu şu o bir birer her tüm bütün için gibi kadar olan olarak üzere hakkında ilişkin dair konusunda
kapsamında edilmiştir edilmiş edilecek edilir yapılmıştır yapılmış yapılacak olmuştur olmuş olacak olup bulunmaktadır bulunan
gerekmektedir tarihinden itibaren sonra önce hâlinde halinde içinde içerisinde üzerine doğrultusunda gereği gereğince nedeniyle söz
konusu ayrıca yine ancak fakat ise iken kere defa sonuçlandırılmıştır sonuçlanmıştır tamamlanmıştır karşılanmıştır düzenlenmiştir
güncellenmiştir alınmıştır görülmüştür verilmiştir gönderilmiştir bildirilmiştir iletilmiştir hazırlanmıştır""".split()
SECRECY = {"hizmete özel": 1, "gizli": 2, "çok gizli": 3}
NUMBER_PATTERN = r"^([EZO])-(\d{6,10})-(\d{3}(?:\.\d{2}){0,3})-(\d+)$"
SPACE = r"(?U)\s+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def nth(array: Column, place: int | Column) -> Column:
    """An array's entry from 1, or from the end below 0; null where there is none."""
    return F.try_element_at(array, F.lit(place) if isinstance(place, int) else place)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.btrim(c, F.lit(WHITE))


def squeeze_space(c: Column) -> Column:
    """Every run of white space as one blank, trimmed; null as the empty text."""
    return F.trim(F.regexp_replace(text_or_empty(c), SPACE, " "))


def fold(c: Column) -> Column:
    """Turkish and Latin letters without marks, lower case, white space squeezed; null as the empty text.

    Letters with marks outside Latin-1 keep them unless they are written with combining marks; fold_exact covers all."""
    plain = F.translate(text_or_empty(c), TURKISH_FROM + LATIN_FROM, TURKISH_TO + LATIN_TO)
    return squeeze_space(F.regexp_replace(F.lower(plain), r"\p{M}", ""))


def _in_form(c: Column, form: str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return F.pandas_udf(run, "string")(c)


def decomposed(c: Column) -> Column:
    return _in_form(c, "NFD")


def composed(c: Column) -> Column:
    return _in_form(c, "NFC")


def fold_exact(c: Column) -> Column:
    """fold by Unicode decomposition, for any script."""
    low = F.lower(F.translate(text_or_empty(c), TURKISH_FROM, TURKISH_TO))
    return squeeze_space(F.regexp_replace(decomposed(low), r"\p{M}", ""))


def fold_hard(c: Column) -> Column:
    """fold, and digits and bars that scans confuse with letters; not for numbers or dates."""
    return squeeze_space(F.translate(fold(c), SCAN_FROM, SCAN_TO))


def tr_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "İI", "iı"))


def normalize_style(c: Column, exact: bool = False) -> Column:
    """Lower case without apostrophes and circumflexes; other Turkish letters stay. exact composes letters first."""
    c = composed(text_or_empty(c)) if exact else text_or_empty(c)
    return F.translate(tr_lower(F.translate(c, "'’ʼ", "")), "âîû", "aiu")


def paragraphs(c: Column) -> Column:
    parts = F.transform(F.split(F.trim(text_or_empty(c)), r"\n\s*\n"), lambda p: strip(p))
    return F.filter(parts, lambda p: p != "")


def sentences(c: Column) -> Column:
    """Split at . ! ? before white space and a capital or a quote; dots of numbers, abbreviations and initials don't end one."""
    hold = "\u0001"
    c = F.regexp_replace(text_or_empty(c), r"(?<=\d)\.(?=\d)", hold)
    c = F.regexp_replace(c, rf"(?U)\b({'|'.join(ABBREVIATIONS)})\.", "$1" + hold)
    c = F.regexp_replace(c, r"(?U)\b([A-ZÇĞİÖŞÜ])\.", "$1" + hold)
    parts = F.split(c, r'(?<=[.!?])\s+(?=[A-ZÇĞİÖŞÜ"„])')
    parts = F.transform(parts, lambda p: strip(F.translate(p, hold, ".")))
    return F.filter(parts, lambda p: p != "")


def number_parts(c: Column) -> Column:
    """struct<kind, detsis, sdp, serial> of an official number, null if it isn't one."""
    parts = [F.regexp_extract(c, NUMBER_PATTERN, i).alias(n) for i, n in enumerate(("kind", "detsis", "sdp", "serial"), 1)]
    return F.when(c.rlike(NUMBER_PATTERN), F.struct(*parts))


def numeric_tokens(c: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(r"(\d[\d.,/:-]*\d|\d)"), F.lit(1))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def parse_tr_date(c: Column) -> Column:
    """dd.MM.yyyy as a date; null for other forms and impossible days."""
    return F.when(c.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_timestamp(c, F.lit("dd.MM.yyyy")).cast("date"))


def masked(kind: Column, value: Column) -> Column:
    """A value with its personal part hidden, by its entity type."""
    stars = lambda n: F.repeat(F.lit("*"), F.greatest(n, F.lit(0)).cast("int"))
    size = F.length(value)
    names = F.array_join(F.transform(F.split(squeeze_space(value), " "), lambda w: F.concat(F.substring(w, 1, 1), stars(F.length(w) - 1))), " ")
    head = F.when(size <= 6, 1).otherwise(3)
    middle = F.concat(F.substring(value, F.lit(1), head), stars(size - head - 2), F.when(size > head, F.substring(value, F.greatest(size - 1, head + 1), F.lit(2))).otherwise(""))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    mail = F.concat(F.substring(local, 1, 2), stars(F.length(local) - 2), F.lit("@"), domain)
    address = F.concat(F.array_join(F.slice(F.split(squeeze_space(value), " "), 1, 2), " "), F.lit(" ***"))
    year = F.concat(F.lit("**.**."), F.regexp_extract(value, r"(\d{4})", 1))
    ladder = F.when(kind == "kisi_adi", names).when(kind.isin("telefon", "tckn", "iban", "plaka", "vergi_no"), middle).when(kind == "eposta", mail)
    return ladder.when(kind == "adres", address).when(kind == "dogum_tarihi", year).otherwise(F.concat(F.substring(value, 1, 1), stars(size - 1)))


def entity_type(kind: Column) -> Column:
    """A known type or `diger`."""
    return F.when(kind.isin(ENTITY_TYPES), kind).otherwise("diger")


def pii_flag(kind: Column, stated: Column) -> Column:
    """True for the personal types whatever was stated."""
    return F.when(kind.isin(PERSONAL_TYPES), True).otherwise(F.coalesce(stated, F.lit(False)))


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return nth(F.transform(F.array(value), fn), 1)


def check_digits(nine: Column) -> Column:
    """The tenth and eleventh digit that belong to nine digits (an array of int)."""

    def both(d: Column) -> Column:
        odd, even = nth(d, 1) + nth(d, 3) + nth(d, 5) + nth(d, 7) + nth(d, 9), nth(d, 2) + nth(d, 4) + nth(d, 6) + nth(d, 8)
        tenth = F.pmod(7 * odd - even, F.lit(10))
        return F.array(tenth, F.pmod(odd + even + tenth, F.lit(10)))

    return bound(nine, both)


def tckn_valid(c: Column) -> Column:
    digits = F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: F.substring(c, i, F.lit(1)).cast("int"))
    ok = bound(digits, lambda d: check_digits(F.slice(d, 1, 9)) == F.slice(d, 10, 2))
    return F.coalesce(F.when(c.rlike(r"^[1-9]\d{10}$"), ok).otherwise(False), F.lit(False))


def phone_allocated(c: Column) -> Column:
    """Whether a Turkish mobile number's prefix (after 0 or +90) is one of the allocated ranges."""
    prefix = F.regexp_extract(F.regexp_replace(text_or_empty(c), r"\D", ""), r"^(?:90|0)?(\d{3})\d{7}$", 1)
    n = F.when(prefix != "", prefix.cast("int")).otherwise(0)
    return n.between(530, 549) | n.isin(501, 505, 506, 507, 551, 552, 553, 554, 555, 559)


def clip(c: Column, n: int) -> Column:
    t = F.trim(text_or_empty(c))
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…"))).otherwise(t)


def cut(c: Column, n: int) -> Column:
    return F.substring(squeeze_space(c), 1, n)


def turkish_ratio(c: Column) -> Column:
    t = text_or_empty(c)
    letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))  # runs, as each match costs more than its letters
    turkish = F.length(t) - F.length(F.translate(t, "çğıöşüÇĞİÖŞÜ", ""))  # a pattern of all other letters is seven times slower
    return F.when(letters > 0, turkish / letters).otherwise(0.0)


def garbled(c: Column, exact: bool = False) -> Column:
    """Marks of a wrong encoding, or letters written with combining marks."""
    t = text_or_empty(c)
    marks = reduce(lambda a, b: a | b, [t.contains(m) for m in MOJIBAKE])
    return marks | ((t != composed(t)) if exact else t.rlike(r"\p{M}"))


def looks_turkish(c: Column) -> Column:
    low = tr_lower(text_or_empty(c))
    words = reduce(lambda a, b: a + b, [F.concat(F.lit(" "), low, F.lit(" ")).contains(f" {w} ").cast("int") for w in MARKER_WORDS])
    return low.rlike("[çğıöşü]") | (words >= 2)


def glued_words(c: Column, most: int = 30) -> Column:
    return F.exists(F.split(text_or_empty(c), SPACE), lambda w: F.length(w) > most)


def confidence(raw: Column) -> Column:
    """struct<score, valid> of a raw confidence text: numbers in 0..1 are valid, others have the score 0."""
    number = F.when(F.lower(raw).isin("true", "false"), None).otherwise(raw.try_cast("double"))
    valid = F.coalesce(number.between(0, 1), F.lit(False))
    return F.struct(F.when(valid, number).otherwise(0.0).alias("score"), valid.alias("valid"))


def secrecy_level(c: Column) -> Column:
    """0 for null or empty, 1 to 3; null for a value that isn't known (unknown_secrecy tells them)."""
    low = tr_lower(F.trim(text_or_empty(c)))
    out = F.when(low == "", 0)
    for name, level in SECRECY.items():
        out = out.when(low == name, level)
    return out


def unknown_secrecy(c: Column) -> Column:
    return secrecy_level(c).isNull()


def in_scope(kind: Column, scope: Column, categories: dict[str, list[str]]) -> Column:
    """Whether a document type is the scope or in the category that it names; false for a null type."""
    out = kind == scope
    for name, kinds in categories.items():
        out = out | ((scope == name) & kind.isin(kinds))
    return F.coalesce(out, F.lit(False))


def mapped(c: Column, pairs: dict[str, str]) -> Column:
    """The value's partner in a two-way vocabulary; null for unknown values."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c]


def content_stems(c: Column) -> Column:
    """Stems (at most five letters) of words over three letters that carry content."""
    words = F.regexp_extract_all(normalize_style(c), F.lit(r"(?U)(\w+)"), F.lit(1))
    stop = [w.replace("â", "a").replace("î", "i").replace("û", "u") for w in STOP_WORDS]
    stems = sorted({w[:5] for w in stop})
    kept = F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(stop) & ~F.substring(w, 1, 5).isin(stems))
    return F.transform(kept, lambda w: F.substring(w, 1, 5))


def shingles(words: Column, k: int) -> Column:
    """k-word sequences of an array of words, repeats included."""

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))

    return bound(words, of)


def words_of(c: Column) -> Column:
    return F.filter(F.split(text_or_empty(c), SPACE), lambda w: w != "")
