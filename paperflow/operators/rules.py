"""Rule engine: every enabled rule is compiled to one expression over a document row; no join, no shuffle.

A rule yields struct<rule_id, status, quote>; the status is the reason of a skip (hedef_disi, kapsam_disi, yol_yok, alan_bos,
veri_yok), `ihlal` or `uygun`. The order of the tests is target, scope, path, emptiness, check.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cut, in_scope, nth, squeeze_space, tr_lower

SKIPS = ("hedef_disi", "kapsam_disi", "yol_yok", "alan_bos", "veri_yok")
ON_EMPTY = ("bos_olmamali", "bos_liste_olmamali")
QUOTE = 300
CHUNK = 40  # rules in one array; arrays of arrays keep generated code within the limit of a method


@dataclass(frozen=True)
class Rule:
    rule_id: str
    check: str
    path: str | None = None
    path_out: str | None = None
    pattern: str | None = None
    scope: str | None = None
    targets: tuple[str, ...] = ("gelen",)
    severity: str = "hata"
    title: str = ""
    basis: str | None = None
    list_field: str | None = None
    other_path: str | None = None
    allowed: tuple[str, ...] = ()
    dictionary: tuple[str, ...] = ()
    function: str | None = None
    default: object = None
    enabled: bool = True
    title_cut: bool = False
    question: str | None = None
    askable: bool = False
    samples: tuple[tuple[str, bool], ...] = field(default=())


Special = Callable[[Column, Rule], Column]
_specials: dict[str, Special] = {}


def register_rule(name: str, fn: Special) -> None:
    """A special check: fn(value, rule) gives struct<violated boolean, quote string>, null where data is missing."""
    _specials[name] = fn


def special(name: str) -> Special:
    if name not in _specials:
        raise KeyError(f"no special rule is named {name}")
    return _specials[name]


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def is_blank(value: Column, kind: T.DataType) -> Column:
    """The narrow test: null, blank text, empty list; a struct is never blank."""
    if isinstance(kind, T.StructType):
        return F.lit(False)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(value), F.lit(0)) <= 0
    return value.isNull() | (F.trim(value) == "") if isinstance(kind, T.StringType) else value.isNull()


def is_filled(value: Column, kind: T.DataType, default: object = None) -> Column:
    """Differs from the default document: a struct counts if any member does, an empty list doesn't."""
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a | b, [is_filled(value[f.name], f.dataType) for f in kind.fields], F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(value), F.lit(0)) > 0
    return F.coalesce(value != F.lit(default), F.lit(False)) if default is not None else value.isNotNull()


def multiline(pattern: str) -> str:
    """(?m) where the pattern, after its inline flags, starts at a line."""
    body = pattern
    while body.startswith("(?") and ")" in body and body[2 : body.index(")")].isalpha():
        body = body[body.index(")") + 1 :]
    return f"(?m){pattern}" if body.startswith("^") else pattern


def text_parts(value: Column, kind: T.DataType, rule: Rule) -> Column:
    """The texts that a pattern looks at: the value, or a list's entries (a named member of each, for structs)."""
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x: x[rule.list_field].cast("string")) if isinstance(kind.elementType, T.StructType) else F.transform(value, lambda x: x.cast("string"))
        return F.array_compact(inner)
    return F.array_compact(F.array(value.cast("string")))


def _check(value: Column, kind: T.DataType, rule: Rule) -> Column:
    """struct<violated, quote>, null if it can't be decided."""
    answer = lambda violated, quote=F.lit(None): F.struct(violated.alias("violated"), quote.cast("string").alias("quote"))
    if rule.check == "bos_olmamali":
        return answer(~is_filled(value, kind, rule.default))
    if rule.check == "bos_liste_olmamali":
        return answer(F.coalesce(F.size(value), F.lit(0)) <= 0) if isinstance(kind, T.ArrayType) else answer(value.isNull())
    if rule.check in ("regex_bulunmali", "regex_bulunmamali"):
        parts, pattern = text_parts(value, kind, rule), multiline(rule.pattern or "")
        if rule.check == "regex_bulunmali":
            return answer(~F.exists(parts, lambda p: p.rlike(pattern)), cut(nth(parts, 1), QUOTE))
        hit = nth(F.filter(parts, lambda p: p.rlike(pattern)), 1)
        return answer(hit.isNotNull(), F.substring(squeeze_space(F.regexp_extract(hit, f"({pattern})", 0)), 1, QUOTE))
    if rule.check == "alan_esitligi":
        other = F.col(rule.other_path)
        return F.when(other.isNotNull(), answer(F.trim(value) != F.trim(other), cut(value, QUOTE)))
    if rule.check == "izinli_kume":
        return answer(~value.isin(list(rule.allowed)), cut(value, QUOTE))
    if rule.check == "sozluk":
        found = nth(F.filter(F.array(*[F.lit(d) for d in rule.dictionary]), lambda d: tr_lower(value).contains(tr_lower(d))), 1)
        return answer(found.isNotNull(), found)
    if rule.check == "dogru_olmali":
        return answer(~value.eqNullSafe(F.lit(True)))
    return special(rule.function or "")(value, rule)


def compiled(schema: T.StructType, rule: Rule, target: str, kind_col: str, categories: dict[str, list[str]]) -> Column:
    status = lambda s, quote=F.lit(None): F.struct(F.lit(rule.rule_id).alias("rule_id"), s.alias("status"), quote.cast("string").alias("quote"))
    if target not in rule.targets:
        return status(F.lit("hedef_disi"))
    path = rule.path_out if target == "giden" and rule.path_out else rule.path
    kind = field_type(schema, path) if path else None
    if kind is None:
        out = status(F.lit("yol_yok"))
    else:
        value = F.col(path)
        result = _check(value, kind, rule)
        out = F.when(result.isNull(), status(F.lit("veri_yok"))).otherwise(status(F.when(F.coalesce(result["violated"], F.lit(False)), "ihlal").otherwise("uygun"), result["quote"]))
        if rule.check not in ON_EMPTY:
            out = F.when(is_blank(value, kind), status(F.lit("alan_bos"))).otherwise(out)
    if rule.scope:
        out = F.when(~in_scope(F.col(kind_col), F.lit(rule.scope), categories), status(F.lit("kapsam_disi"))).otherwise(out)
    return out


def run_rules(docs: DataFrame, rules: list[Rule], target: str = "gelen", id_col: str = "doc_id", kind_col: str = "belge_turu", categories: dict[str, list[str]] | None = None) -> DataFrame:
    """id_col, rule_id, status, quote: one row for each document and enabled rule."""
    if target not in ("gelen", "giden"):
        raise ValueError("target is gelen or giden")
    validate(rules)
    on = [r for r in rules if r.enabled]
    parts = [compiled(docs.schema, r, target, kind_col, categories or {}) for r in on] or [F.lit(None).cast("struct<rule_id:string,status:string,quote:string>")]
    chunks = [F.array(*parts[lo : lo + CHUNK]) for lo in range(0, len(parts), CHUNK)]
    answers = F.array_compact(F.flatten(F.array(*chunks)) if len(chunks) > 1 else chunks[0])
    return docs.select(id_col, F.explode(answers).alias("r")).select(id_col, "r.rule_id", "r.status", "r.quote")


def findings(results: DataFrame, rules: list[Rule], evidence: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Violations with severity, title, basis, field and quote (the evidence's quote where the rule has none)."""
    spark = results.sparkSession
    table = spark.createDataFrame([(r.rule_id, r.severity, (r.title or r.rule_id) + (" […]" if r.title_cut else ""), r.basis, r.path) for r in rules], "rule_id string, severity string, title string, basis string, field string")
    out = results.where("status = 'ihlal'").join(table, "rule_id")
    if evidence is not None:
        quotes = evidence.select(F.col("doc_id").alias(id_col), F.col("field_path").alias("field"), F.col("quote").alias("evidence_quote")).dropDuplicates([id_col, "field"])
        out = out.join(quotes, [id_col, "field"], "left").withColumn("quote", F.coalesce("quote", "evidence_quote")).drop("evidence_quote")
    return out.select(id_col, "rule_id", "severity", "title", "basis", "field", "quote")


def skip_summary(results: DataFrame) -> DataFrame:
    return results.where(F.col("status").isin(*SKIPS)).groupBy("status").agg(F.count("*").alias("n"))


def report(results: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """checked, skipped, violated of each document."""
    skipped = F.col("status").isin(*SKIPS)
    return results.groupBy(id_col).agg(F.sum((~skipped).cast("long")).alias("checked"), F.sum(skipped.cast("long")).alias("skipped"), F.sum((F.col("status") == "ihlal").cast("long")).alias("violated"))


def missing_items(found: DataFrame, rules: list[Rule], id_col: str = "doc_id", softened: tuple[str, ...] = ("I-09", "ME-02")) -> DataFrame:
    """Findings as missing items: clipped description, the rule's question, some rules' errors as warnings."""
    spark = found.sparkSession
    asks = spark.createDataFrame([(r.rule_id, r.question, r.askable) for r in rules], "rule_id string, question string, askable boolean")
    severity = F.when(F.col("rule_id").isin(*softened) & (F.col("severity") == "hata"), "uyari").otherwise(F.col("severity"))
    return found.join(asks, "rule_id", "left").select(id_col, "rule_id", "field", severity.alias("severity"), cut(F.col("title"), 200).alias("description"), "quote", "question", F.coalesce("askable", F.lit(False)).alias("askable"), F.lit(False).alias("resolved"))


def legal_basis(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, law, article, rule_id: `Y ...` or `K ...` bases; the first finding (by rule) of an article stands."""
    pattern = r"^(Y|K)\s+(\S.*)$"
    parsed = found.where(F.col("basis").rlike(pattern)).select(id_col, F.regexp_extract("basis", pattern, 1).alias("law"), F.regexp_extract("basis", pattern, 2).alias("article"), "rule_id")
    return parsed.groupBy(id_col, "law", "article").agg(F.min("rule_id").alias("rule_id"))


def validate(rules: list[Rule], schema: T.StructType | None = None) -> None:
    """Raises on configuration errors: unknown check or special rule, missing pattern or set, unknown path."""
    known = {"bos_olmamali", "bos_liste_olmamali", "regex_bulunmali", "regex_bulunmamali", "alan_esitligi", "izinli_kume", "sozluk", "dogru_olmali", "ozel_fonksiyon"}
    wrong = []
    for r in (r for r in rules if r.enabled):
        if r.check not in known:
            wrong.append(f"{r.rule_id}: unknown check {r.check}")
        elif r.check.startswith("regex") and not r.pattern or r.check == "izinli_kume" and not r.allowed or r.check == "sozluk" and not r.dictionary or r.check == "alan_esitligi" and not r.other_path:
            wrong.append(f"{r.rule_id}: {r.check} lacks its setting")
        elif r.check == "ozel_fonksiyon" and (r.function or "") not in _specials:
            wrong.append(f"{r.rule_id}: no special rule is named {r.function}")
        elif schema is not None and r.path and field_type(schema, r.path) is None:
            wrong.append(f"{r.rule_id}: unknown path {r.path}")
    if wrong:
        raise ValueError("; ".join(wrong))


def smoke_test(rules: DataFrame, samples: DataFrame) -> DataFrame:
    """rule_id, text, expected, found of samples (rule_id, text, expected) that a rule's pattern answers otherwise."""
    both = samples.join(rules.select("rule_id", "pattern"), "rule_id")
    return both.withColumn("found", F.expr("regexp_like(text, pattern)")).where("found <> expected").select("rule_id", "text", "expected", "found")


def _cites_reference(value: Column, rule: Rule) -> Column:
    has = F.col(rule.other_path).isNotNull()
    cites = tr_lower(value).rlike(r"(?U)\bilgi(?!li|len)")
    return F.when(has & value.isNotNull(), F.struct((~cites).alias("violated"), cut(value, QUOTE).alias("quote")))


def _addressee_known(value: Column, rule: Rule) -> Column:
    """value: struct<raw, kind, unit>."""
    empty = F.coalesce(F.trim(value["raw"]), F.lit("")) == ""
    return F.struct((empty | ((F.coalesce(value["kind"], F.lit("")) != "dagitim") & value["unit"].isNull())).alias("violated"), value["raw"].alias("quote"))


def _codes_agree(value: Column, rule: Rule) -> Column:
    other = F.col(rule.other_path)
    return F.when(value.isNotNull() & other.isNotNull(), F.struct((value != other).alias("violated"), F.concat_ws(" / ", value, other).alias("quote")))


register_rule("ilgi_govdede", _cites_reference)
register_rule("muhatap_belirli", _addressee_known)
register_rule("kod_uyumu", _codes_agree)
