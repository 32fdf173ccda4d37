"""Rule tables: literals of patterns, and every row as one expression for each rule gives it."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperflow.operators import rule_tables, rules
from paperflow.operators.rules import Rule
from paperflow.sources import dimensions


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("abc", ["abc"]), ("(?iu)Gereğini", ["gereğini"]), ("ab?cd", ["cd"]), ("ab+cd", ["ab"]), ("ab{2}cde", ["cde"]), ("abc|de", ["abc", "de"]), ("abc|d", None), ("a.b", None), (r"\bilgi(?!li|len)", ["ilgi"]), (r"^T\.C\.$", ["t.c."]),
        ("(abc)de", ["de"]), ("(abc|d)", None), ("[abc]xyz", ["xyz"]), ("[]abc]xyz", ["xyz"]), (r"[\]x]yz(a\)b)cd", ["yz"]), (r"\d{3}-ab", ["-ab"]), (r"\p{L}ab", ["ab"]), (r"\x41bc", None), ("(?x)a b c", None), (r"\Qab\E", None), ("", None), ("İSTANBUL", ["istanbul"]),
    ],
)
def test_required_literals(pattern, want):
    assert rule_tables.required_literals(pattern) == want


@settings(max_examples=400, deadline=None)
@given(st.text("ab(|)[]?*+.^$\\d", max_size=12), st.text("abd(", max_size=20))
def test_every_match_holds_a_literal(pattern, text):
    try:
        found = re.search(pattern, text)
    except (re.error, RecursionError):
        return
    own = rule_tables.required_literals(pattern)
    if found and own is not None:
        assert any(x in found[0] for x in own)


DOC = "doc_id int, text string, belge_turu string, names array<string>, rows array<struct<a: string, b: string>>, other string, ok boolean"


def many_rules(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abciıİIşŞ") for _ in range(rng.randint(1, 4)))
    pattern = lambda: rng.choice([word(), f"(?iu){word()}", f"{word()}|{word()}", f"^{word()}", f"{word()}.?{word()}", rf"\b{word()}", f"[{word()}]+{word()}", f"({word()})?{word()}", rf"{word()}\s+{word()}", f"{word()}$"])
    out = []
    for i in range(n):
        path = rng.choice(["text", "text", "names", "rows", "other", "nowhere"])
        check = rng.choice(["regex_bulunmali", "regex_bulunmamali", "regex_bulunmamali", "sozluk", "bos_olmamali", "izinli_kume"])
        if check in ("sozluk", "izinli_kume"):
            path = rng.choice(["text", "other"])
        out.append(Rule(f"R{i:04d}", check, path, pattern=pattern(), list_field=rng.choice("ab") if path == "rows" else None, dictionary=tuple(word() for _ in range(3)), allowed=("a", "b"), scope=rng.choice([None, None, "k", "grup"]), targets=rng.choice([("gelen",), ("giden",), ("gelen", "giden")]), enabled=rng.random() < 0.95))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    text = lambda: rng.choice([" ", "\n"]).join("".join(rng.choice("abciıİIşŞ") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 12)))
    rows = [(i, rng.choice([text(), text(), None, " "]), rng.choice(["k", "m", "z", None]), rng.choice([None, [], [text(), None, text()]]), rng.choice([None, [], [(text(), None), (None, text())]]), rng.choice([text(), "a", None]), rng.choice([True, None])) for i in range(60)]
    return spark.createDataFrame(rows, DOC)


@pytest.mark.parametrize("target", ["gelen", "giden"])
def test_rule_table_equals_one_expression_each(spark, docs, target):
    own = many_rules(7, 150)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    got = rows(rule_tables.run_rule_table(docs, own, target, categories={"grup": ["m", "z"]}))
    want = rows(rules.run_rules(docs, own, target, categories={"grup": ["m", "z"]}))
    assert got == want and {r[2] for r in got} >= {"ihlal", "uygun", "alan_bos", "kapsam_disi", "hedef_disi", "yol_yok"}


def test_rules_from_a_list_run(spark, docs):
    """From the printed list over the overlay to results."""
    md = spark.createDataFrame([("| `B-01` | Metin ab | `ab` bulunmalı | hata | Y 4 |",), ("| G-02 | Boş olmamalı | alan boş olmamalı | uyarı | K 1 |",)], "value string")
    over = spark.createDataFrame([("B-01", "text", True), ("G-02", "other", True)], "rule_id string, path string, enabled boolean")
    own = rule_tables.rules_of(dimensions.overlay_rules(dimensions.parse_rule_list(md), over))
    assert [(r.rule_id, r.check, r.path, r.severity) for r in own] == [("B-01", "regex_bulunmali", "text", "hata"), ("G-02", "bos_olmamali", "other", "uyari")]
    assert rule_tables.run_rule_table(docs, dimensions.overlay_rules(dimensions.parse_rule_list(md), over)).count() == 120
    with pytest.raises(ValueError, match="repeated"):
        rule_tables.rules_of(spark.createDataFrame([("A", "bos_olmamali", "text")] * 2, "rule_id string, check string, path string"))
    with pytest.raises(ValueError, match="unknown check"):
        rule_tables.rules_of(spark.createDataFrame([("A", "neu", "text")], "rule_id string, check string, path string"))
    with pytest.raises(ValueError, match="lacks"):
        rule_tables.rules_of(spark.createDataFrame([("A", "sozluk", "text")], "rule_id string, check string, path string"))


def test_no_text_rules_and_no_documents(spark, docs):
    assert rule_tables.run_rule_table(docs, [Rule("A", "bos_olmamali", "text")]).count() == 60
    assert rule_tables.run_rule_table(docs, []).count() == 0 and rule_tables.run_rule_table(docs.limit(0), many_rules(1, 9)).count() == 0
