"""Operators on whole tables: not in a single task."""

from driftmark.operators import rollups

SF_DIR = "/root/testdata/sf0.001"


def test_crash_runs_without_a_window(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    journal = events.selectExpr("user_id AS run_id", "event_id AS seq", "event_type AS phase", "CASE WHEN event_type = 'purchase' THEN 'exit' WHEN user_id = 3 THEN 'reported' ELSE 'phase' END AS kind")
    rows, want = journal.collect(), {}
    for r in rows:
        began, reported = want.get(r["run_id"], (r["seq"], False))
        want[r["run_id"]] = (min(began, r["seq"]), reported or r["kind"] == "reported")
    last = max(began for began, reported in want.values() if reported)
    out = rollups.crash_runs(journal)
    got = {r["run_id"]: r["since_report"] for r in out.collect()}
    assert got == {k: began > last for k, (began, _) in want.items()} and set(got.values()) == {True, False}
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    none = rollups.crash_runs(journal.where("kind <> 'reported'"))
    assert none.where("since_report").count() == none.count() > 0
