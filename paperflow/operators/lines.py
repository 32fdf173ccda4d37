"""Lines and documents: words to lines, footers, and the parts around the addressee line.

lines: doc_id, line_no, text (y, page where needed). Everything after lines_from_words keeps one partitioning, by doc_id."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nth, parse_tr_date, squeeze_space, tr_lower

# Tolerances, marks and label patterns of printed letters.
LINE_TOLERANCE = 6.0
FOOTER_ZONE = 0.75
TEXT_LAYER_CHARS = 120
STRONG_MARKS = ["güvenli elektronik imza", "doğrulama kodu", "doğrulama adresi", "belge takip adresi", "kep adresi"]
WEAK_MARKS = ["bilgi için:", "faks:"]
STOCK = [r"(?iu)Bu belge[,;:]?\s*güvenli elektronik imza ile imzalan[\p{L}]*\.?", r"(?iu)Belge Doğrulama Kodu\s*[:：]?\s*[A-Z0-9\-]{8,}", r"(?iu)Doğrulama Kodu\s*[:：]?\s*[A-Z0-9\-]{8,}"]
ADDRESSEE = r"^([^a-zçğıöşü]{8,}(?:NE|NA|ne|na))\s*(?:\(?([^)]*)\))?\s*$"
ADDRESSEE_VAGUE = r"^\s*[İIi]LG[İIi]L[İIi]\s+MAKAM(?:A|LARA)\s*$"
ADDRESSEE_WIDE = r"^([^a-zçğıöşü]{3,}\s[^a-zçğıöşü]{2,}[AEae])\s*(?:\(?([^)]*)\))?\s*$"
LABEL_NUMBER = r"(?iu)^\s*Say[ıi1l|]\s*[:：]?\s*"
LABEL_SUBJECT = r"(?iu)^\s*Konu\s*[:：]?\s*"
LABEL_REFERENCE = r"(?iu)^\s*[İIi]lg[ıi1l|]\s*[:：]?\s+(?=\d{2}\.\d{2}\.\d{4})"
STATE_HEADER = r"\bT\.?\s*C\b\.?(?![\s.]*Kimlik)"
COMPANY = r"(?iu)\b(Ltd\.?\s*Şti\.?|A\.?\s*Ş\.?|Limited|Anonim)(?![\p{L}])"
CLOSING = r"(?iu)(?<![\p{L}])ederim(?![\p{L}])"
REFERENCE_MARK = r"(?iu)tarihli\s+ve|say[ıi]l[ıi]\s+yaz"
NUMBER = r"(\bE-\d{8}-[\d.]+-\d+\b)"
COMPANY_NUMBER = r"(\b(?:19|20)\d{2}/\d{1,6}\b)"
DATE = r"(\b\d{2}\.\d{2}\.\d{4}\b)"
ATTACHMENT_ONE = r"(?iu)^\s*Ek\s*[:：]\s*(.+?)\s*\((\d+)\s*Sayfa\)"
ATTACHMENT_MANY = r"(?iu)^\s*(?:EKLER|Ek)\s*[:：]\s*(\d+)\s*adet"
DISTRIBUTION = r"(?iu)^\s*(DAĞITIM|DAGITIM)\s*[:：]?\s*$"
PERSON = r"[A-ZÇĞİÖŞÜ][a-zçğıöşüâî]+(?:\s+[A-ZÇĞİÖŞÜ][a-zçğıöşüâî]+)*\s+[A-ZÇĞİÖŞÜ]{2,}"


def _anchored(y: list[float], tolerance: float) -> list[int]:
    """Where lines begin in ascending heights: a line goes on while the distance to its first word is within the tolerance."""
    starts, i = [], 0
    while i < len(y):
        starts.append(i)
        j = bisect.bisect_right(y, y[i] + tolerance, i + 1)
        while j < len(y) and y[j] - y[i] <= tolerance:  # where the sum was rounded down
            j += 1
        while j > i + 1 and y[j - 1] - y[i] > tolerance:
            j -= 1
        i = j
    return starts


def _changes(c: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls are equal."""
    same = pc.or_(pc.fill_null(pc.equal(c[1:], c[:-1]), False), pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])))
    return ~same.to_numpy(zero_copy_only=False)


def _pages(rows: pa.RecordBatch) -> np.ndarray:
    """Where pages begin in rows sorted by page."""
    return np.append(0, np.flatnonzero(_changes(rows.column(0)) | _changes(rows.column(1))) + 1)


def _page_lines(rows: pa.RecordBatch, tolerance: float) -> list[pa.Array]:
    """Number, height and text of the lines of whole pages (doc_id, page, y, x, text, sorted by these) after their doc_id and page:
    words by place, the same word printed twice running once."""
    y, x, text, heights = *(rows.column(c).to_numpy() for c in (2, 3)), rows.column(4), rows.column(2).to_pylist()
    pages, first, number = _pages(rows).tolist(), [], []
    for a, b in zip(pages, [*pages[1:], len(heights)], strict=True):
        starts = _anchored(heights[a:b], tolerance)
        first += [a + i for i in starts]
        number += range(1, len(starts) + 1)
    ends = [*first[1:], len(heights)]
    line = np.repeat(np.arange(len(first)), np.subtract(ends, first))
    order = np.lexsort((x, line))
    differ = lambda v: (v[1:] != v[:-1]) | (np.signbit(v[1:]) != np.signbit(v[:-1]))
    tied = (line[1:] == line[:-1]) & (x[order][1:] == x[order][:-1]) & (differ(y[order]) | differ(x[order]))
    for k in np.union1d(line[1:][tied], line[np.isnan(x)]).tolist():  # equal places at several heights: by text
        cut = slice(first[k], ends[k])
        order[cut] = [i for *_, i in sorted(zip(x[cut].tolist(), text[cut].to_pylist(), range(cut.start, cut.stop), strict=True))]
    text = text.take(pa.array(order))
    kept = np.append(True, (line[1:] != line[:-1]) | _changes(text))
    offsets = np.append(0, np.add.reduceat(kept.astype(np.int32), first).cumsum()).astype(np.int32)
    words = pa.ListArray.from_arrays(pa.array(offsets), text.filter(pa.array(kept)))
    at = pa.array(first)
    return [rows.column(0).take(at), rows.column(1).take(at), pa.array(number, pa.int32()), rows.column(2).take(at), pc.binary_join(words, " ")]


def lines_from_words(words: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """doc_id, page, line_no, y, text of words (doc_id, page, y, x, text), page by page: one shuffle by page, sorted in Spark,
    then one pass over the sorted rows that holds a batch and the page that it begins with."""
    kind = words.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "page", "line_no", "y", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the page that may go on

        def ready(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays(_page_lines(whole, tolerance), names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and [held[0].column(c)[0].as_py() for c in (0, 1)] != [batch.column(c)[0].as_py() for c in (0, 1)]:
                yield ready(held)
                held = []
            last = int(_pages(batch)[-1])
            if last:
                yield ready([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield ready(held)

    rows = words.where("text is not null and y is not null and x is not null").select("doc_id", F.col("page").cast("int"), F.col("y").cast("double"), F.col("x").cast("double"), F.col("text").cast("string"))
    ordered = rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "y", "x", "text")
    return ordered.mapInArrow(run, f"doc_id {kind}, page int, line_no int, y double, text string")


def deskew(words: DataFrame, tolerance: float = LINE_TOLERANCE, least: int = 30, gain: float = 0.10) -> DataFrame:
    """Words of each page turned about their mean by the angle (-6 to 6 degrees) with the fewest lines, if a tenth fewer."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        if len(page) < least:
            return page
        x, y = page["x"].to_numpy(float), page["y"].to_numpy(float)
        cx, cy = x.mean(), y.mean()

        def turned(degrees: float) -> tuple[np.ndarray, np.ndarray]:
            a = np.radians(degrees)
            return cx + (x - cx) * np.cos(a) - (y - cy) * np.sin(a), cy + (x - cx) * np.sin(a) + (y - cy) * np.cos(a)

        groups = lambda v: len(_anchored(np.sort(v).tolist(), tolerance))
        angles = np.arange(-6, 6.01, 0.25)
        counts = [groups(turned(a)[1]) for a in angles]
        best = min(range(len(angles)), key=lambda i: (counts[i], abs(angles[i])))
        if counts[best] <= (1 - gain) * groups(y):
            page = page.copy()
            page["x"], page["y"] = turned(angles[best])
        return page

    return words.groupBy("doc_id", "page").applyInPandas(run, words.schema)


def stack_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Heights continued over pages: page number times the first page's height (pages: doc_id, page, height) is added."""
    first = pages.groupBy("doc_id").agg(F.min_by("height", "page").alias("first_height"), F.min("page").alias("first_page"))
    return words.join(first, "doc_id", "left").withColumn("y", F.col("y") + (F.col("page") - F.coalesce("first_page", "page")) * F.coalesce("first_height", F.lit(0.0))).drop("first_height", "first_page")


def has_text_layer(page_texts: DataFrame, least: int = TEXT_LAYER_CHARS) -> DataFrame:
    """doc_id, text_layer: the first page's trimmed text is long enough; false without pages or text."""
    first = F.min_by(F.coalesce(F.length(F.trim("text")), F.lit(0)), "page")
    return page_texts.groupBy("doc_id").agg((F.coalesce(first, F.lit(0)) >= least).alias("text_layer"))


def _marked(text: Column, marks: list[str]) -> Column:
    low = tr_lower(text)
    return F.coalesce(F.greatest(*[low.contains(m) for m in marks]), F.lit(False))


def split_footer(lines: DataFrame, page_height: float | Column = 842.0, zone: float = FOOTER_ZONE) -> DataFrame:
    """lines with part (body, footer, dropped) and weak: the first strongly marked line in the zone and all below it are the
    footer; else the first weakly marked; else only lone page numbers are dropped."""
    doc = Window.partitionBy("doc_id")
    height = page_height if isinstance(page_height, Column) else F.lit(float(page_height))
    low = F.col("y") >= height * zone
    spot = F.struct("y", "line_no")
    strong = F.min(F.when(low & _marked(F.col("text"), STRONG_MARKS), spot)).over(doc)
    weak = F.min(F.when(low & _marked(F.col("text"), WEAK_MARKS), spot)).over(doc)
    start = F.coalesce(strong, weak)
    number = low & F.trim("text").rlike(r"^\d+\s*/\s*\d+$") & (F.length(F.trim("text")) <= 8)
    part = F.when(spot >= start, "footer").when(start.isNull() & number, "dropped").otherwise("body")
    return lines.withColumn("part", part).withColumn("weak", strong.isNull() & weak.isNotNull())


def strip_stock_phrases(lines: DataFrame) -> DataFrame:
    """Body lines without the stock phrases of footers; what was taken out is appended as footer lines."""
    pattern = "|".join(f"(?:{p})" for p in STOCK)
    taken = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
    rows = lines.withColumn("taken", F.when(F.col("part") == "body", taken).otherwise(F.array().cast("array<string>")))
    kept = rows.withColumn("text", F.when(F.size("taken") > 0, squeeze_space(F.regexp_replace("text", pattern, " "))).otherwise(F.col("text"))).where("part <> 'body' or text <> ''").drop("taken")
    moved = rows.where("size(taken) > 0").withColumn("text", F.array_join(F.transform("taken", lambda x: F.trim(x)), " ")).withColumn("part", F.lit("footer")).drop("taken")
    return kept.unionByName(moved)


def addressee_pass(text: Column) -> Column:
    """1, 2 or 3 by the pattern that fits; null if none."""
    t = F.trim(text)
    return F.when(t.rlike(ADDRESSEE), 1).when(t.rlike(ADDRESSEE_VAGUE), 2).when(t.rlike(ADDRESSEE_WIDE), 3)


def value_of(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def number_of(text: Column) -> Column:
    return F.coalesce(value_of(text, NUMBER), value_of(text, COMPANY_NUMBER))


def date_of(text: Column) -> Column:
    """The first calendar date of a text, as written."""
    return nth(F.filter(F.regexp_extract_all(text, F.lit(DATE), F.lit(1)), lambda d: parse_tr_date(d).isNotNull()), 1)


MARKS = """trimmed pass wide number_label subject_label reference_label reference_mark number date date_text dated closing state_header company
attachment_one attachment_many distribution person""".split()
PART_MARKS = {"pass", "number_label", "subject_label", "reference_label", "closing", "state_header", "company"}


def marked(lines: DataFrame, marks: set[str] | None = None) -> DataFrame:
    """lines with a column m: line_no, text and what the line is or holds (marks: these alone). Every pattern runs once for each line,
    before lines are gathered; lines without a digit are spared those for numbers and dates."""
    text, trimmed = F.col("text"), F.trim("text")
    digit = text.rlike("[0-9]")
    m = dict(zip(MARKS, (
        trimmed.alias("trimmed"), addressee_pass(text).alias("pass"), trimmed.rlike(ADDRESSEE_WIDE).alias("wide"), text.rlike(LABEL_NUMBER).alias("number_label"), text.rlike(LABEL_SUBJECT).alias("subject_label"),
        text.rlike(LABEL_REFERENCE).alias("reference_label"), text.rlike(REFERENCE_MARK).alias("reference_mark"), F.when(digit, number_of(text)).alias("number"), F.when(digit, date_of(text)).alias("date"), F.when(digit, value_of(text, DATE)).alias("date_text"), (digit & text.rlike(DATE)).alias("dated"),
        text.rlike(CLOSING).alias("closing"), text.rlike(STATE_HEADER).alias("state_header"), text.rlike(COMPANY).alias("company"), (digit & text.rlike(ATTACHMENT_ONE)).alias("attachment_one"), (digit & text.rlike(ATTACHMENT_MANY)).alias("attachment_many"),
        text.rlike(DISTRIBUTION).alias("distribution"), text.rlike(PERSON).alias("person"),
    ), strict=True))
    return lines.withColumn("m", F.struct("line_no", "text", *[c for name, c in m.items() if marks is None or name in marks]))


def outline(lines: DataFrame, marks: set[str] | None = None) -> DataFrame:
    """One row per document from one aggregation: addressee_line and pass, first label line, closing line, header facts, and the
    marked lines in order (all). marks: what all holds, if not everything; facts whose marks it lacks are left out."""
    m = marked(lines, None if marks is None else marks | {"pass", "closing"})
    found = m.groupBy("doc_id").agg(F.min(F.when(F.col("m.pass").isNotNull(), F.struct("m.pass", "m.line_no"))).alias("a"), F.array_sort(F.collect_list("m")).alias("all"))
    at = F.col("a.line_no")
    found = found.withColumn("upper", F.filter("all", lambda x: x["line_no"] < at))
    label = lambda x: x["number_label"] | x["subject_label"] | x["reference_label"]
    first_label = F.array_min(F.transform(F.filter("upper", label), lambda x: x["line_no"]))
    closing = F.array_max(F.transform(F.filter("all", lambda x: (x["line_no"] >= F.coalesce(at, F.lit(0))) & x["closing"]), lambda x: x["line_no"]))
    if marks is not None and not marks >= PART_MARKS:
        return found.select("doc_id", at.alias("addressee_line"), F.col("a.pass").alias("addressee_pass"), F.size("upper").alias("lines_above"), closing.alias("closing_line"), "all")
    return found.select(
        "doc_id", at.alias("addressee_line"), F.col("a.pass").alias("addressee_pass"), F.size("upper").alias("lines_above"), first_label.alias("first_label"), closing.alias("closing_line"),
        F.exists("upper", lambda x: x["state_header"]).alias("state_header"), F.exists("upper", lambda x: x["company"]).alias("company"), F.exists("upper", lambda x: x["number_label"] | x["subject_label"]).alias("labelled"),
        "all",
    )


def family(found: DataFrame, footer: Column | None = None) -> Column:
    """kurum, sirket, dilekce or bilinmiyor of an outline row; footer: whether the page has an e-signature footer."""
    out = F.when(F.col("addressee_line").isNull(), "bilinmiyor").when(F.col("lines_above") == 0, "dilekce")
    if footer is not None:
        out = out.when(footer, "kurum")
    return out.when(F.col("state_header"), "kurum").when(F.col("company"), "sirket").when(F.col("labelled"), "sirket").otherwise("dilekce")


def letterhead(found: DataFrame) -> Column:
    """Lines above the addressee and the first label, without a bare state header; empty without an addressee."""
    end = F.least("addressee_line", F.coalesce("first_label", "addressee_line"))
    lines = F.filter("all", lambda x: (x["line_no"] < end) & ~F.trim(x["text"]).rlike(r"^T\.?\s*C\.?$"))
    return F.when(F.col("addressee_line").isNull(), F.array().cast("array<string>")).otherwise(F.transform(lines, lambda x: F.trim(x["text"])))


def body(found: DataFrame) -> Column:
    """Lines from below the addressee to the closing, joined by blanks; a first line in parentheses is left out; null
    without a closing."""
    lines = F.filter("all", lambda x: (x["line_no"] > F.coalesce("addressee_line", F.lit(0))) & (x["line_no"] <= F.col("closing_line")))
    texts = F.transform(lines, lambda x: F.trim(x["text"]))
    texts = F.when(nth(texts, 1).rlike(r"^\(.+\)$"), F.slice(texts, F.lit(2), F.size(texts))).otherwise(texts)
    return F.when(F.col("closing_line").isNotNull(), F.array_join(texts, " "))


def document_parts(lines: DataFrame) -> DataFrame:
    """doc_id, addressee_line, addressee_pass, closing_line, family, letterhead, body."""
    found = outline(lines, PART_MARKS)
    return found.select("doc_id", "addressee_line", "addressee_pass", "closing_line", family(found).alias("family"), letterhead(found).alias("letterhead"), body(found).alias("body"))


def why_no_addressee(text: Column) -> Column:
    """Reasons why a line isn't an addressee line; empty if it is."""
    t = F.trim(text)
    reasons = F.array_compact(F.array(F.when(t.rlike("[a-zçğıöşü]"), "lower_case"), F.when(~t.rlike("(?:NE|NA|ne|na)$"), "ending"), F.when(F.length(t) < 10, "short")))
    return F.when(addressee_pass(text).isNotNull(), F.array().cast("array<string>")).otherwise(reasons)

