"""The stream of actions against the fold of the whole table, in any order of batches, late and repeated actions, restarts."""

import datetime as dt
import random

import pytest

from paperflow.operators import register
from paperflow.streaming import workflow

ROLES = ["memur", "yonetici", "birim_amiri", "izleyici", None]
UNITS = [("N0", True), ("N1", True), ("N2", False)]


def actions_of(seed, n, docs=12):
    rng = random.Random(seed)
    start = dt.datetime(2026, 1, 1)
    return [(rng.randrange(docs), i, start + dt.timedelta(seconds=rng.randrange(3600)), rng.choice(ROLES), rng.choice([*register.ACTIONS, "?", None]), rng.choice(["x", " ", None, "neden"]), rng.choice(["N1", "N2", "N9", None])) for i in range(n)]


def states(df):
    return {r.doc_id: (r.status, r.decision, r.unit, r.corrections, r.accepted, sorted((x.action_id, x.reason) for x in r.rejected)) for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, ["isleniyor", "insan_onayi_bekliyor", "onaylandi"][i % 3], "N0") for i in range(12)], "doc_id long, status string, unit string")


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, "code string, routable boolean")


def drained(spark, at, docs, units, watermark="0 seconds", files=1):
    q = workflow.workflow_stream(spark, str(at / "in"), docs, str(at / "out"), str(at / "cp"), units, watermark, files)
    q.awaitTermination()
    assert q.exception() is None


def put(spark, at, name, rows):
    spark.createDataFrame(rows, workflow.ACTION).coalesce(1).write.parquet(str(at / "put" / name))
    (at / "in").mkdir(exist_ok=True)
    for i, p in enumerate((at / "put" / name).glob("part-*")):
        p.rename(at / "in" / f"{name}-{i}.parquet")


END = (99, 10**6, dt.datetime(2026, 1, 3), "memur", "onayla", None, None)  # moves the watermark past all others


def test_stream_equals_the_fold_in_any_order(spark, docs, units, tmp_path):
    rows = actions_of(1, 150)
    want = states(register.apply_actions(docs, spark.createDataFrame(rows, workflow.ACTION), units))
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    for i in range(3):  # three batches, out of order, with repeats of other batches
        put(spark, tmp_path, f"{i}", shuffled[i * 50 : i * 50 + 50] + shuffled[:10])
    put(spark, tmp_path, "8", [END])
    put(spark, tmp_path, "9", [(99, 10**6 + 1, dt.datetime(2026, 1, 4), "memur", "onayla", None, None)])
    drained(spark, tmp_path, docs, units, "2 hours")
    got = states(workflow.current(spark, str(tmp_path / "out")))
    assert {k: v for k, v in got.items() if k != 99} == {k: v for k, v in want.items() if v[4] or v[5]}


def test_restart_and_late_actions(spark, docs, units, tmp_path):
    rows = sorted(actions_of(3, 60), key=lambda r: r[2])
    put(spark, tmp_path, "1", rows[:30])
    drained(spark, tmp_path, docs, units)
    put(spark, tmp_path, "2", rows[30:])
    put(spark, tmp_path, "3", [END])
    drained(spark, tmp_path, docs, units)  # goes on from the checkpoint
    put(spark, tmp_path, "4", [(rows[0][0], 777, rows[0][2], "yonetici", "taslak_kaydet", None, None)])  # its time is past
    put(spark, tmp_path, "5", [(99, 10**6 + 1, dt.datetime(2026, 1, 4), "memur", "onayla", None, None)])
    drained(spark, tmp_path, docs, units)
    got = states(workflow.current(spark, str(tmp_path / "out")))
    want = states(register.apply_actions(docs, spark.createDataFrame(rows, workflow.ACTION), units))
    assert {k: v for k, v in got.items() if k != 99} == {k: v for k, v in want.items() if v[4] or v[5]}


def test_unit_must_be_a_target(spark, docs, units):
    rows = [(1, i, dt.datetime(2026, 1, 1, 0, 0, i), "memur", "birim_degistir", "neden", unit) for i, unit in enumerate(["N2", "N9", None, "N1"])]
    got = register.apply_actions(docs.where("doc_id = 1"), spark.createDataFrame(rows, workflow.ACTION), units).first()
    assert [tuple(x) for x in got.rejected] == [(0, "birim_gecersiz"), (1, "birim_gecersiz"), (2, "birim_gecersiz")] and got.unit == "N1"
