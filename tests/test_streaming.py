"""The streaming jobs drained over files."""

from paperflow.operators.rules import Rule
from paperflow.plans.views import view
from paperflow.streaming import jobs


def test_status_stream(spark, sf, tmp_path):
    rows = view(spark, sf, "trace").selectExpr("doc_id", "event_id as action_id", "cast(ts as timestamp) as ts", "stage as status")
    rows.union(rows.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    q = jobs.status_stream(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "cp"), "3650 days", files=1)
    q.awaitTermination()
    want = {r.doc_id: (r.status, r.events) for r in jobs.latest_status(rows).collect()}
    state = lambda: {r.doc_id: (r.status, r.events) for r in jobs.current_status(spark, str(tmp_path / "out")).collect()}
    assert state() == want and len(list((tmp_path / "out" / "changes").glob("batch=*"))) == 3
    jobs.fold_status(spark, str(tmp_path / "out"))
    assert state() == want and len(list((tmp_path / "out" / "changes").glob("batch=*"))) == 1
    jobs.fold_status(spark, str(tmp_path / "out"))
    assert state() == want


def test_intake(spark, tmp_path):
    schema = "doc_id long, number string, sdp_candidates array<string>, addressee_unit string, number_code string, subject_code string, subject_candidates array<string>, model_narrow string, model_wide string, belge_turu string"
    docs = spark.createDataFrame([(1, "n", ["a"], "a", None, None, [], None, None, "k"), (2, None, ["a"], None, None, None, [], None, None, "k")], schema)
    docs.write.parquet(str(tmp_path / "in"))
    q = jobs.intake(spark, str(tmp_path / "in"), docs.schema, [Rule("A", "bos_olmamali", path="number")], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {r.doc_id: (r.auto, r.blockers) for r in spark.read.parquet(str(tmp_path / "out" / "decisions")).collect()}
    assert got == {1: (True, []), 2: (False, ["eksik"])}
    assert spark.read.parquet(str(tmp_path / "out" / "results")).count() == 2
