"""Tables saved by key: what stays, what is replaced, which files are rewritten, two writers, odd keys."""

import random
import threading

import numpy as np
import pytest

from paperflow.operators import register
from paperflow.sources import keyed, readers
from paperflow.sources.keyed import KeyedTable

ROW = "kurum string, doc_id long, text string"


def table(spark, at, **more):
    return KeyedTable(spark, f"file://{at}/t", ["kurum", "doc_id"], **more)


def rows_of(df):
    return sorted(((r.kurum, r.doc_id, r.text) for r in df.collect()), key=repr)


def test_two_saves_of_one_institution_keep_both(spark, tmp_path):
    path = f"{tmp_path}/docs"
    readers.write_documents(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], ROW), path)
    info = readers.write_documents(spark.createDataFrame([("a", 3, "z"), ("a", 2, "Y")], ROW), path)
    assert rows_of(readers.saved(spark, path)) == [("a", 1, "x"), ("a", 2, "Y"), ("a", 3, "z")] and info["version"] == 2
    assert readers.write_result(spark.createDataFrame([("a", "R1", "hata")], "kurum string, rule_id string, severity string"), f"{tmp_path}/r", ("kurum", "rule_id"))["rows_written"] == 1


def test_saves_equal_a_dictionary(spark, tmp_path):
    rng, want, t = random.Random(1), {}, table(spark, tmp_path, file_rows=25, slot_keys=9)
    for _ in range(6):
        own = {(rng.choice(["a", "b", "ç", None, ""]), rng.choice([None, *range(60)])): f"v{rng.random()}" for _ in range(rng.randint(1, 40))}
        t.save(spark.createDataFrame([(*k, v) for k, v in own.items()], ROW))
        want |= own
        got = {(r.kurum, r.doc_id): r.text for r in t.read().collect()}
        assert got == want
    gone = list(want)[:20]
    t.save(spark.createDataFrame([(*k, None) for k in gone], ROW), delete=True)
    assert {(r.kurum, r.doc_id) for r in t.read().collect()} == set(want) - set(gone)
    assert rows_of(t.read(version=6)) == sorted(((*k, v) for k, v in want.items()), key=repr)


def test_only_files_of_touched_keys_are_rewritten(spark, tmp_path):
    t = table(spark, tmp_path, file_rows=100)
    first = t.save(spark.range(2000).selectExpr("concat('k', id div 500) AS kurum", "id AS doc_id", "'x' AS text"))
    assert first["files_before"] == 0 and first["files_written"] >= 20
    before = {r.file for r in t._files(t.commit_of()).collect()}
    info = t.save(spark.createDataFrame([("k0", 7, "new"), ("k3", 1999, "new"), ("zz", 1, "new")], ROW))
    after = {r.file for r in t._files(t.commit_of()).collect()}
    assert info["files_rewritten"] == 2 and len(before - after) == 2 and t.read().count() == 2001
    found = t.lookup(spark.createDataFrame([("k0", 7), ("k1", 600), ("no", 1)], "kurum string, doc_id long"))
    assert rows_of(found) == [("k0", 7, "new"), ("k1", 600, "x")]


def test_two_writers_lose_nothing(spark, tmp_path):
    t, failed = table(spark, tmp_path), []

    def write(name):
        try:
            for i in range(3):
                table(spark, tmp_path).save(spark.createDataFrame([(name, i, name), ("both", i, name)], ROW))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=(n,)) for n in "xy"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    got = {(r.kurum, r.doc_id): r.text for r in t.read().collect()}
    assert not failed and set(got) == {(n, i) for n in ("x", "y", "both") for i in range(3)} and t.versions() == list(range(1, 7))


def test_writers_number_at_once_without_gaps(spark, tmp_path):
    at, failed = (lambda: KeyedTable(spark, f"file://{tmp_path}/reg", ["direction", "institution", "doc_id"])), []

    def letters(lo, hi):
        return spark.range(lo, hi).selectExpr("'gelen' AS direction", "concat('k', id % 2) AS institution", "id AS doc_id", "cast(1000 + id % 9 as timestamp) AS ts")

    def write(lo, hi):
        try:
            register.register_numbers(at(), letters(lo, hi)).collect()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=x) for x in [(0, 30), (20, 60)]]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    with pytest.raises(ZeroDivisionError):
        at().transact(lambda rows: 1 / 0)  # a writer that fails leaves nothing
    first = {r.doc_id: r.seq for r in at().read().collect()}
    again = {r.doc_id: r.seq for r in register.register_numbers(at(), letters(55, 70)).collect()}
    rows = at().read().collect()
    assert not failed and len(first) == 60 and {d: s for d, s in again.items() if d in first} == {d: first[d] for d in range(55, 60)}
    for k in ("k0", "k1"):
        own = sorted(r.seq for r in rows if r.institution == k)
        assert own == list(range(1, len(own) + 1)) and len(own) == 35


def test_a_commit_is_never_overwritten(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t._commit(1, {"list": "a"}) and not t._commit(1, {"list": "b"}) and t.commit_of() == {"list": "a"}


def test_odd_saves(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.save(spark.createDataFrame([], ROW)) == {} and t.versions() == []
    with pytest.raises(FileNotFoundError):
        t.read()
    with pytest.raises(ValueError, match="repeated"):
        t.save(spark.createDataFrame([("a", 1, "x"), ("a", 1, "y")], ROW))
    t.save(spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), (None, None, "n")], ROW), order_by="text")
    assert sorted(r.text for r in t.read().collect()) == ["n", "y"]
    with pytest.raises(ValueError, match="columns"):
        t.save(spark.createDataFrame([("a", 1)], "kurum string, doc_id long"))
    same = t.save(spark.createDataFrame([], ROW))
    assert same["version"] == 1


def test_bloom_has_no_false_negative():
    h = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    own = keyed.bloom(h)
    others = np.random.default_rng(2).integers(-(2**63), 2**63, 5000)
    assert keyed.may_hold(own, h).all() and keyed.may_hold(own, others).mean() < 0.03
