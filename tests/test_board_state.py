"""The board from kept states against the whole history: late, taken back and repeated batches, and a stream that is started again."""

import datetime as dt
import random

from paperflow.operators import board
from paperflow.streaming import board_state

EVENT = "doc_id long, stage string, ms double, ts timestamp, sign int"


def events_of(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice(["oku", "ayristir", "yonlendir", None]), rng.choice([None, *[float(x) for x in range(40)]]), dt.datetime(2026, 1, 1 + rng.randrange(5), rng.randrange(24)), 1) for i in range(n)]


def table(df):
    return sorted(((r.stage, r.n, round(r.mean_ms, 9), r.p95) for r in df.collect()), key=repr)


def test_states_equal_the_history(spark, tmp_path):
    stages = spark.createDataFrame([("oku",), ("ayristir",), ("yonlendir",), ("leer",)], "stage string")
    at = board_state.states(spark, f"{tmp_path}/s")
    events = events_of(1, 300)
    back = [(*e[:4], -1) for e in events[20:60]]  # taken back later
    new = [(e[0], e[1], 7.0, e[3], 1) for e in events[20:60]]  # as corrected
    batches = [events[:150], events[150:] + back[:10], back[10:] + new]
    for number, rows in enumerate(batches):
        info = board_state.fold(at, spark.createDataFrame(rows, EVENT), number)
        assert info["number"] == number
        assert board_state.fold(at, spark.createDataFrame(rows, EVENT), number)["version"] == info["version"]  # again: nothing
    left = spark.createDataFrame(events[:20] + events[60:] + new, EVENT)
    assert table(board_state.stage_times(at.read(), stages)) == table(board.stage_times(left, stages))


def test_trust_from_states(spark, tmp_path):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, "kapi", rng.choice([0.1, 0.5, 0.85, 0.9, 1.0]), dt.datetime(2026, 1, 1 + i % 3), 1) for i in range(90)], EVENT)
    at = board_state.states(spark, f"{tmp_path}/s")
    board_state.fold(at, rows)
    want = sorted(tuple(r) for r in board.trust_histogram(rows.selectExpr("ms AS trust")).collect())
    assert sorted(tuple(r) for r in board_state.trust_histogram(at.read()).collect()) == want


def test_board_stream(spark, tmp_path):
    events, stages = events_of(3, 120), spark.createDataFrame([("oku",), ("ayristir",)], "stage string")
    frame = spark.createDataFrame(events, EVENT)
    for half in (frame.where("doc_id < 70"), frame.where("doc_id >= 70")):
        half.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = board_state.board_stream(spark, f"{tmp_path}/in", frame.schema, f"{tmp_path}/s", f"{tmp_path}/cp")
        q.awaitTermination()
    assert table(board_state.stage_times(board_state.states(spark, f"{tmp_path}/s").read(), stages)) == table(board.stage_times(frame, stages))
