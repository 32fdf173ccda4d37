"""Rule sets as tables: rows become rules, and thousands of text rules run in one pass over the documents.

A text rule (a pattern or a dictionary) can only fire where one of its literals stands: an entry of the dictionary, or letters that every
match of the pattern holds. All literals of a path make one Aho-Corasick automaton; one look at a text, in Arrow batches, gives the
rules that can fire there, and Spark tests these alone with the pattern itself. Letters are compared in a fold that is coarser
than any case rule of patterns and dictionaries, so no match is missed; rules without a literal are tested on every document. The
answer of every other rule follows from the rule, so results are those of rules.run_rules(), row for row, without a join or a shuffle."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut, nth, squeeze_space, tr_lower
from .rules import CHUNK, QUOTE, Rule, compiled, field_type, is_blank, multiline, text_parts, validate

MOST_RULES = 100_000  # rules are broadcast
LEAST_LITERAL = 2
TEXT_CHECKS = ("regex_bulunmali", "regex_bulunmamali", "sozluk")
PACKED = "rule_id string, check string, pattern string, dictionary array<string>, path int, kinds array<string>"


def rules_of(rows: DataFrame) -> list[Rule]:
    """Rules of a table with the columns of Rule, as parse_rule_list() and overlay_rules() give them; absent columns and nulls are the
    defaults, other columns are ignored. A repeated id, an unknown check or a missing setting is an error."""
    have = [c for c in rows.columns if c in Rule.__dataclass_fields__]
    found = rows.select(*have).limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = [Rule(**{c: tuple(v) if isinstance(v, list) else v for c, v in r.asDict().items() if v is not None}) for r in found]
    out.sort(key=lambda r: r.rule_id)
    twice = {a.rule_id for a, b in zip(out, out[1:], strict=False) if a.rule_id == b.rule_id}
    if twice:
        raise ValueError(f"repeated rules: {', '.join(sorted(twice))}")
    validate(out)
    return out


class _Fold(dict):
    """One letter for all letters that any case rule takes for the same."""

    def __missing__(self, code: int) -> str:
        low = chr(code).lower()[0]
        up = low.upper()
        self[code] = out = (up if len(up) == 1 else low).lower()[0]
        return out


FOLD = _Fold()


def _skipped_class(p: str, i: int) -> int:
    """The place after a character class that starts at i."""
    depth, i = 1, i + 1
    i += p[i : i + 1] == "^"
    i += p[i : i + 1] == "]"
    while i < len(p) and depth:
        depth += (p[i] == "[") - (p[i] == "]")
        i += 2 if p[i] == "\\" else 1
    return i


def _skipped_group(p: str, i: int) -> int:
    """The place after a group that starts at i."""
    depth, i = 1, i + 1
    while i < len(p) and depth:
        if p[i] == "[":
            i = _skipped_class(p, i)
            continue
        depth += (p[i] == "(") - (p[i] == ")")
        i += 2 if p[i] == "\\" else 1
    return i


def required_literals(pattern: str) -> list[str] | None:
    """Strings of which every match of the pattern holds one, folded; None if there are none that are long enough. Groups, classes
    and optional letters are passed over, so a literal may be shorter than it could be, but never wrong."""
    flags = ""
    while pattern.startswith("(?") and ")" in pattern and pattern[2 : pattern.index(")")].isalpha():
        flags += pattern[2 : pattern.index(")")]
        pattern = pattern[pattern.index(")") + 1 :]
    if "x" in flags or "\\Q" in pattern or "(?x" in pattern:
        return None
    branches, runs, run, i = [], [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            following = pattern[i + 1 : i + 2]
            if following.isalnum() or not following:
                runs, run = [*runs, run], ""
                i += 2
                if following in ("p", "P", "x", "k", "N", "u", "c", "0") and following:
                    if following not in "pP" or pattern[i : i + 1] != "{":
                        return None  # escapes of several letters
                    i = pattern.index("}", i) + 1 if "}" in pattern[i:] else len(pattern)
            else:
                run += following
                i += 2
        elif c in "[(":
            runs, run = [*runs, run], ""
            i = _skipped_class(pattern, i) if c == "[" else _skipped_group(pattern, i)
        elif c == "|":
            branches.append([*runs, run])
            runs, run = [], ""
            i += 1
        elif c in "*?{":
            runs, run = [*runs, run[:-1]], ""
            i = pattern.index("}", i) + 1 if c == "{" and "}" in pattern[i:] else i + 1
        elif c == "+":
            runs, run = [*runs, run], ""
            i += 1
        elif c in ".^$":
            runs, run = [*runs, run], ""
            i += 1
        else:
            run += c
            i += 1
    branches.append([*runs, run])
    best = [max(b, key=len) for b in branches]
    return [x.translate(FOLD) for x in best] if all(len(x) >= LEAST_LITERAL for x in best) else None


def literals(rule: Rule) -> list[str] | None:
    if rule.check == "sozluk":
        return [d.translate(FOLD) for d in rule.dictionary] if all(rule.dictionary) else None
    return required_literals(rule.pattern or "")


def _firing(of: dict[str, list[int]]):
    """A column of the numbers of the rules that have a literal in a text."""

    @F.arrow_udf("array<int>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for literal, numbers in of.items():
            automaton.add_word(literal, numbers)
        automaton.make_automaton()
        for texts in columns:
            yield pa.array([sorted({n for _, numbers in automaton.iter(t.translate(FOLD)) for n in numbers}) if t else [] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return run


def run_rule_table(docs: DataFrame, rules: DataFrame | list[Rule], target: str = "gelen", id_col: str = "doc_id", kind_col: str = "belge_turu", categories: dict[str, list[str]] | None = None) -> DataFrame:
    """id_col, rule_id, status, quote as run_rules() gives them, for rules in a table or a list, however many."""
    if target not in ("gelen", "giden"):
        raise ValueError("target is gelen or giden")
    on = [r for r in (rules if isinstance(rules, list) else rules_of(rules)) if r.enabled]
    validate(on)
    categories, spark = categories or {}, docs.sparkSession
    text, other, paths = [], [], {}
    for r in on:
        path = r.path_out if target == "giden" and r.path_out else r.path
        is_text = r.check in TEXT_CHECKS and target in r.targets and path and field_type(docs.schema, path) is not None
        if is_text and not (r.check == "sozluk" and field_type(docs.schema, path).simpleString() != "string"):
            # the parts of a list of structs depend on the rule's member
            number = paths.setdefault((path, r.list_field), len(paths))
            text.append((r, number))
        else:
            other.append(r)
    rest = [compiled(docs.schema, r, target, kind_col, categories) for r in other]
    chunks = [F.array(*rest[lo : lo + CHUNK]) for lo in range(0, len(rest), CHUNK)]
    if not text:
        answers = F.flatten(F.array(*chunks)) if chunks else F.array().cast("array<struct<rule_id:string,status:string,quote:string>>")
        return docs.select(id_col, F.explode(answers).alias("r")).select(id_col, "r.rule_id", "r.status", "r.quote")

    always, of = [], [defaultdict(list) for _ in paths]
    for n, (r, number) in enumerate(text, 1):
        own = literals(r)
        if own is None:
            always.append(n)
        for literal in own or []:
            of[number][literal].append(n)
    kinds = [[r.scope, *categories.get(r.scope, [])] if r.scope else None for r, _ in text]
    rows = [(r.rule_id, r.check, multiline(r.pattern or ""), list(r.dictionary), number, k) for (r, number), k in zip(text, kinds, strict=True)]
    names = [c.strip().split()[0] for c in PACKED.split(", ")]
    packed = spark.createDataFrame([(i, *row) for i, row in enumerate(rows, 1)], f"i int, {PACKED}").coalesce(1)
    packed = F.broadcast(packed.agg(F.array_sort(F.collect_list(F.struct("i", *names))).alias("_rules")))  # one row of at most MOST_RULES

    parts, blank, first, hits = [], [], [], [F.array(*[F.lit(n) for n in always]).cast("array<int>")]
    for (path, member), number in paths.items():
        kind = field_type(docs.schema, path)
        own = text_parts(F.col(path), kind, Rule("", "", list_field=member))
        parts.append(own)
        blank.append(is_blank(F.col(path), kind))
        first.append(cut(nth(own, 1), QUOTE))
        if of[number]:
            hits.append(_firing(dict(of[number]))(F.array_join(own, "\n")))
    some = docs.withColumns({"_parts": F.array(*parts), "_blank": F.array(*blank), "_first": F.array(*first), "_hits": F.array_distinct(F.concat(*[F.coalesce(h, F.array().cast("array<int>")) for h in hits]))})
    some = some.join(packed)
    rule = lambda n: F.element_at("_rules", n)
    row = lambda x, status, quote: F.struct(x["rule_id"].alias("rule_id"), status.alias("status"), quote.cast("string").alias("quote"))
    outside = lambda x: x["kinds"].isNotNull() & ~F.coalesce(F.array_contains(x["kinds"], F.col(kind_col)), F.lit(False))
    wanted = lambda x: x["check"] == "regex_bulunmali"

    def settled(x: Column, violated: Column, quote: Column) -> Column:
        status = F.when(outside(x), "kapsam_disi").when(F.get("_blank", x["path"]), "alan_bos").when(violated, "ihlal").otherwise("uygun")
        return row(x, status, F.when(status.isin("ihlal", "uygun"), quote))

    def silent(n: Column) -> Column:
        """A rule none of whose literals stands in the text."""
        x = rule(n)
        return settled(x, wanted(x), F.when(wanted(x), F.get("_first", x["path"])).when(x["check"] == "regex_bulunmamali", ""))

    def tried(n: Column) -> Column:
        x = rule(n)
        own = F.get("_parts", x["path"])
        hit = nth(F.filter(own, lambda p: F.call_function("regexp_like", p, x["pattern"])), 1)
        quote = F.substring(squeeze_space(F.call_function("regexp_extract", hit, F.concat(F.lit("("), x["pattern"], F.lit(")")), F.lit(0))), 1, QUOTE)
        entry = nth(F.filter(x["dictionary"], lambda d: tr_lower(nth(own, 1)).contains(tr_lower(d))), 1)
        lacks = F.when(outside(x) | F.get("_blank", x["path"]), settled(x, F.lit(False), F.lit(None)))
        return lacks.when(x["check"] == "sozluk", settled(x, entry.isNotNull(), entry)).when(wanted(x), settled(x, hit.isNull(), F.get("_first", x["path"]))).otherwise(settled(x, hit.isNotNull(), quote))

    everyone = F.sequence(F.lit(1), F.lit(len(text)))
    answers = F.concat(F.transform(F.array_except(everyone, F.col("_hits")), silent), F.transform("_hits", tried), *chunks)
    return some.select(id_col, F.explode(answers).alias("r")).select(id_col, "r.rule_id", "r.status", "r.quote")
