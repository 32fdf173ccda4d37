"""Dimension tables: the unit tree, rule rows, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, nth
from .scratch import dropped, written


def _climbed(steps: DataFrame, n: int) -> DataFrame:
    """steps (code, up, done) with up the end of the climb: in each round every open climb takes as many steps as it has taken
    before, so a chain of n units takes log2(n) rounds. What is still open after n steps goes round a cycle."""
    taken = 1
    while taken <= n and steps.where("not done").limit(1).count():
        further = steps.select(F.col("code").alias("up"), F.col("up").alias("further"), F.col("done").alias("at_end"))
        open_ = steps.where("not done").join(further, "up").select("code", F.col("further").alias("up"), F.col("at_end").alias("done"))
        now = written(steps.where("done").unionByName(open_), "climb")
        if hasattr(steps, "scratch_path"):
            dropped(steps)
        steps, taken = now, 2 * taken
    return steps


def root_institution(units: DataFrame) -> DataFrame:
    """code, root of every unit, at any depth. The climb ends at a unit without a parent (null or blank), at an unknown parent, which is
    then the root, or in a cycle at the first unit that is met again: for a unit of the cycle itself, for others where they enter it.
    A repeated code counts once, with its smallest parent; a null code is left out.

    Climbs double in each round. Units that are still open after as many steps as there are units stand in a cycle or lead to one; the
    units they have reached are the cycles' members, as each step only turns a cycle. Members end climbs in a second pass."""
    parent = F.nullif(F.trim("parent_code"), F.lit(""))
    tree = written(units.where("code is not null").groupBy("code").agg(F.min(parent).alias("parent")), "units")
    n = tree.count()
    known = tree.select(F.col("code").alias("parent"), F.lit(True).alias("known"))
    first = tree.join(known, "parent", "left").select("code", F.coalesce("parent", "code").alias("up"), F.col("known").isNull().alias("done"))
    ends = _climbed(written(first, "climb"), n)
    if not ends.where("not done").limit(1).count():
        dropped(tree)
        return ends.select("code", F.col("up").alias("root"))
    turning = ends.where("not done")
    members = written(turning.select(F.col("up").alias("code")).distinct(), "members")
    into = turning.select("code").join(tree, "code").join(members.select("code", F.lit(True).alias("member")), "code", "left")
    into = into.select("code", F.when(F.col("member"), F.col("code")).otherwise(F.col("parent")).alias("up"), F.coalesce("member", F.lit(False)).alias("done"))
    others = _climbed(written(into, "climb"), n)
    dropped(tree, members)
    return ends.where("done").unionByName(others).select("code", F.col("up").alias("root"))


def _problems(rows: DataFrame, key: str, tests: list[tuple[str, Column]]) -> DataFrame:
    """problem, code of every test that a row fails."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in tests]))
    return rows.select(F.explode(found).alias("problem"), F.col(key).alias("code"))


def _empty(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit("")) == ""


def audit_units(units: DataFrame) -> DataFrame:
    """problem, code: repeated code or id, unknown parent or institution, empty name; and, of the columns that units has, an
    institution with a parent (level), no id, no title, a possible target (routable) without a duty or codes."""
    repeated = lambda c: units.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n"), F.min("code").alias("code")).where("n > 1").select(F.lit(f"repeated_{c}").alias("problem"), "code")
    known = lambda c: units.where(F.col(c).isNotNull()).join(units.select(F.col("code").alias(c)).distinct(), c, "left_anti")
    tests, have = [("empty_name", _empty("name"))], set(units.columns)
    if "level" in have:
        tests.append(("institution_with_parent", (F.col("level") == 0) & F.col("parent_code").isNotNull()))
    if "title" in have:
        tests += [("empty_title", _empty("title")), ("empty_detsis_no", _empty("detsis_no"))]
    if {"routable", "duty", "sdp_codes"} <= have:
        tests += [("target_without_duty", F.col("routable") & _empty("duty")), ("target_without_codes", F.col("routable") & (F.coalesce(F.size("sdp_codes"), F.lit(0)) <= 0))]
    out = repeated("code").unionByName(repeated("detsis_no")).unionByName(known("parent_code").select(F.lit("unknown_parent").alias("problem"), "code")).unionByName(_problems(units, "code", tests))
    if "root_code" in have:
        out = out.unionByName(known("root_code").select(F.lit("unknown_root").alias("problem"), "code"))
    return out


def audit_profiles(units: DataFrame, profiles: DataFrame, forms: DataFrame, bodies: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """problem, code (an institution) of profiles (institution), forms (institution, body, form), bodies (institution, name,
    detsis_no) and hierarchy (institution, body): institutions without a profile, bodies without an id or with two, forms that
    are neither arz nor rica, rica for the name of a single unit, and bodies of the hierarchy without a form."""
    no_profile = units.where("level = 0").select(F.col("code").alias("institution")).join(profiles.select("institution"), "institution", "left_anti").select(F.lit("no_profile").alias("problem"), F.col("institution").alias("code"))
    no_id = bodies.where(_empty("detsis_no")).select(F.lit("body_without_id"), "institution")
    named = bodies.where(~_empty("detsis_no"))
    two = named.join(named.groupBy("name").agg(F.count_distinct("detsis_no").alias("n")).where("n > 1"), "name").select(F.lit("body_with_two_ids"), "institution").distinct()
    other = forms.where(~F.coalesce(F.col("form").isin("arz", "rica"), F.lit(False))).select(F.lit("unknown_form"), "institution")
    single = units.select(fold(F.col("name")).alias("b")).distinct()
    trap = forms.where("form = 'rica'").withColumn("b", fold(F.col("body"))).join(single, "b", "left_semi").select(F.lit("rica_for_a_unit"), "institution")
    lacking = hierarchy.join(forms.select("institution", "body"), ["institution", "body"], "left_anti").select(F.lit("body_without_form"), "institution").distinct()
    return no_profile.union(no_id).union(two).union(other).union(trap).union(lacking)


def audit_catalog(catalog: DataFrame, subjects: int = 3) -> DataFrame:
    """problem, code: form of the code, repeated code, parent prefix absent, wrong number of subjects or an empty one; and, of the
    columns that catalog has, derived ones that don't follow from the code (main_group, level, parent_code), a name that is empty
    or over 200 characters, a scope that isn't ortak or kuruma_ozel or contradicts the kind of institution (hepsi), and a
    citizen flag that isn't evet or hayir."""
    have, parent = set(catalog.columns), F.nullif(F.regexp_extract("code", r"^(.*)\.\d{2}$", 1), F.lit(""))
    tests = [("form", ~F.col("code").rlike(r"^\d{3}(\.\d{2}){0,3}$")), ("subjects", (F.size("subjects") != subjects) | F.exists("subjects", lambda x: F.coalesce(F.trim(x), F.lit("")) == ""))]
    derived = {
        "main_group": F.col("main_group") != F.substring("code", 1, 3), "level": F.col("level") != F.size(F.split("code", r"\.")), "parent_code": ~F.nullif(F.trim("parent_code"), F.lit("")).eqNullSafe(parent),
        "name": _empty("name") | (F.length("name") > 200), "scope": ~F.col("scope").isin("ortak", "kuruma_ozel"), "citizen": ~F.col("citizen").isin("evet", "hayir"),
    }
    tests += [(c, test) for c, test in derived.items() if c in have]
    if {"scope", "kind"} <= have:
        tests.append(("kind", (F.col("scope") == "ortak") != (F.col("kind") == "hepsi")))
    repeated = catalog.groupBy("code").count().where("count > 1").select(F.lit("repeated_code").alias("problem"), "code")
    absent = catalog.withColumn("parent", parent).where("parent is not null").join(catalog.select(F.col("code").alias("parent")).distinct(), "parent", "left_anti").select(F.lit("parent_absent").alias("problem"), "code")
    return _problems(catalog, "code", tests).unionByName(repeated).unionByName(absent)


def parse_rule_list(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Rule rows of a markdown table: id, category, title, title_cut, how, check, pattern, severity, basis.

    The check is read from the description in a fixed order of precedence; the pattern stands in back-ticks, of which outer
    quotes are dropped and nothing else is changed."""
    cell = lambda i: F.trim(nth("cells", i))
    rows = lines.where(F.col(text_col).rlike(r"^\s*\|\s*`?\*{0,2}[A-ZÇĞİÖŞÜ]{1,4}-?\d")).select(F.split(F.regexp_replace(F.col(text_col), r"^\s*\||\|\s*$", ""), r"(?<!\\)\|").alias("cells"))
    rows = rows.where(F.size("cells") >= 5)
    how, title = F.lower(cell(3)), cell(2)
    pattern = F.regexp_replace(F.regexp_extract(cell(3), r"`([^`]+)`", 1), "^[\"']|[\"']$", "")
    check = (
        F.when(how.contains("özel"), "ozel_fonksiyon").when(how.contains("bulunmamalı") & (pattern != ""), "regex_bulunmamali").when(pattern != "", "regex_bulunmali")
        .when(how.contains("sözlük"), "sozluk").when(how.contains("küme"), "izinli_kume").when(how.contains("eşit"), "alan_esitligi").when(how.contains("liste"), "bos_liste_olmamali")
        .when(how.contains("boş"), "bos_olmamali").when(how.contains("doğru"), "dogru_olmali").otherwise("ozel_fonksiyon")
    )
    rule_id = F.regexp_replace(cell(1), "[`*]", "")
    severity = F.when(F.lower(cell(4)).contains("hata"), "hata").when(F.lower(cell(4)).contains("uyar"), "uyari").otherwise("bilgi")
    return rows.select(rule_id.alias("rule_id"), F.substring_index(rule_id, "-", 1).alias("category"), F.regexp_replace(title, "…$", "").alias("title"), title.endswith("…").alias("title_cut"), cell(3).alias("how"), check.alias("check"), F.nullif(pattern, F.lit("")).alias("pattern"), severity.alias("severity"), cell(5).alias("basis"))


def overlay_rules(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rules with the non-null override columns laid over, defaults filled (targets [gelen], enabled false). Overrides of rules
    that don't exist are an error."""
    unknown = [r[0] for r in unknown_overrides(rules, overrides).limit(20).collect()]
    if unknown:
        raise ValueError(f"overrides of unknown rules: {', '.join(map(str, unknown))}")
    extra = [c for c in overrides.columns if c != "rule_id"]
    both = rules.alias("r").join(overrides.alias("o"), "rule_id", "left")
    columns = [F.coalesce(F.col(f"o.{c}"), F.col(f"r.{c}")).alias(c) if c in rules.columns else F.col(f"o.{c}") for c in extra]
    out = both.select("rule_id", *[F.col(f"r.{c}") for c in rules.columns if c not in extra and c != "rule_id"], *columns)
    if "targets" in out.columns:
        out = out.withColumn("targets", F.coalesce("targets", F.array(F.lit("gelen"))))
    return out.withColumn("enabled", F.coalesce("enabled", F.lit(False))) if "enabled" in out.columns else out


def unknown_overrides(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    return overrides.join(rules.select("rule_id"), "rule_id", "left_anti").select("rule_id")
