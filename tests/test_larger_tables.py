"""Queries agree with their SQL on what only larger tables hold: long keys, and texts with marks and white space of other scripts."""

import os

import duckdb
import oracle
import pandas as pd
import pytest

from paperflow.plans import catalogue


@pytest.fixture(scope="module")
def long_keys(sf, tmp_path_factory):
    """The tables with the keys of orders on both sides of 1,000,000."""
    to = tmp_path_factory.mktemp("long_keys")
    for name in os.listdir(sf):
        if name != "orders.parquet":
            os.symlink(f"{sf}/{name}", to / name)
    duckdb.sql(f"COPY (SELECT * REPLACE (o_orderkey + 1000000 - 700 AS o_orderkey) FROM '{sf}/orders.parquet') TO '{to}/orders.parquet' (FORMAT parquet)")
    return str(to)


@pytest.mark.parametrize("name", ["x1_fields", "x_evidence_rows"])
def test_long_keys(spark, long_keys, name):
    assert oracle.difference(spark, oracle.database(long_keys), catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], long_keys) is None


TEXTS = [None, "", " ", "\xa0.", "Una ciónno. Y.", "Que çÇ. Foo.", "La Ç. Foo.", "Bak No. Foo.", "Iki söz var\n\nson.", "Iki söz var bkz.\n\nson.", "Tek\xa0söz.", "Iki söz.\xa0Son.", "Iki söz.\x0bSon.", "Son söz.\xa0", "Son söz\x0b",
         "Önce\rT.C.\rsonra.", "Sayı : 3", "EKLER: 2.", "Tabiiö değil.", "Tabii değil.", "yaptıkarz ederim.", "a̅ettim bunu.", "²ettim bunu.", "éekli bir.", "ilgi'de kayıtlı.", "ilgiç.", "Bunu arz ve\nrica ederim\xa0."]


@pytest.fixture(scope="module")
def odd_texts(sf, tmp_path_factory):
    to = tmp_path_factory.mktemp("odd_texts")
    for name in os.listdir(sf):
        if name != "documents.parquet":
            os.symlink(f"{sf}/{name}", to / name)
    pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS, "lang": "tr", "source": "s", "n_chars": [len(x or "") for x in TEXTS]}).to_parquet(to / "documents.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["t1_lint", "t_full_lint"])
def test_odd_texts(spark, odd_texts, name):
    assert oracle.difference(spark, oracle.database(odd_texts), catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], odd_texts) is None


def test_turkish_ratio_reads_no_letter_by_pattern(spark):
    """Every letter that isn't Turkish as a match of a pattern took most of the time."""
    from pyspark.sql import functions as F

    from paperflow.functions import text as t

    rows = spark.createDataFrame([("Çığ ab",), ("😀é ş\u0301",), ("123 .",), ("",), (None,)], "x string").select(t.turkish_ratio(F.col("x")).alias("r"))
    assert [r.r for r in rows.collect()] == [3 / 5, 1 / 2, 0, 0, 0]
    assert "[^ç" not in rows._jdf.queryExecution().toString()


def test_quotes_leave_a_text_only_where_filed(spark):
    """A row for each of a text's letters, with the text in each, grew with the square of its length."""
    from paperflow.operators import matching

    long = "x y " * 5000 + "a needle 😀 here " + "q" * 5000
    docs = spark.createDataFrame([(1, long, long), (2, "nothing", "Bir NEEDLE 😀 here."), (3, None, None)], "doc_id long, body string, raw string")
    quotes = spark.createDataFrame([("needle 😀 here",), ("short",), ("not there at all",)], "quote string")
    found = matching.verify_quotes(docs, quotes)
    assert sorted(map(tuple, found.collect())) == [(1, "needle 😀 here", "govde"), (2, "needle 😀 here", "ham")]
    assert "InSet" in found._jdf.queryExecution().optimizedPlan().toString() or " IN (" in found._jdf.queryExecution().optimizedPlan().toString()


def test_fields_from_their_own_marks(spark, sf):
    """Fields that are asked for alone come out as among all, and no other field's patterns run."""
    from paperflow.operators import fields, lines
    from paperflow.plans import letters

    rows = letters._lines(spark, sf).where("doc_id < 200")
    whole = fields.extract_fields(rows)
    for only in (("signature", "petition_signature"), ("reference", "attachments", "distribution"), ("number", "signature")):
        some = fields.extract_fields(rows, only)
        assert set(some.columns) == {"doc_id", *only}
        assert sorted(map(str, some.select("doc_id", *only).collect())) == sorted(map(str, whole.select("doc_id", *only).collect()))
    assert lines.COMPANY not in fields.extract_fields(rows, ("signature",))._jdf.queryExecution().optimizedPlan().toString()
