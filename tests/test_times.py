"""Texts of times and sizes, roots, journals and reports."""

from pyspark.sql import functions as F

from driftmark.functions import text, times
from driftmark.operators import rollups
from driftmark.sources import tables


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("v"))).collect()]


def test_durations_and_sizes(spark):
    ms = [0, 999, 1000, 1250, 59_940, 60_000, 187_999, 3_599_999, 3_600_000, 90_061_000, None]
    assert column(spark, ms, times.duration_text, "long") == ["0ms", "999ms", "1.0s", "1.2s", "59.9s", "1m00s", "3m07s", "59m59s", "1h00m", "25h01m", None]
    assert column(spark, [0, 1023, 1024, 1536, 5 << 20, 5 << 30, None], times.size_text, "long") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "5120.0 MB", None]
    assert column(spark, [1, 0, 999, 1000, 1234567, -4321], lambda n: times.counted(n, "file"), "long") == ["1 file", "0 files", "999 files", "1,000 files", "1,234,567 files", "-4321 files"]
    day = 86400
    ages = [None, 59, 60, 3600, 2 * 3600, day, 59 * day, 60 * day, 400 * day]
    assert column(spark, ages, times.ago_text, "long") == ["never", "just now", "1 min ago", "1 hour ago", "2 hours ago", "1 day ago", "59 days ago", "2 months ago", "13 months ago"]


def test_schedules(spark):
    given = ["5m", " 1h30m ", "1.5h", ".5m", "2m5s", "90", "0", "-5m", "soon", "", None, "m", "1h 5m", "300000ms", "1.m"]
    want = [(300.0, False), (5400.0, False), (5400.0, False), (60.0, True), (125.0, False), (900.0, True), (900.0, True), (900.0, True), (900.0, True), (900.0, False), (900.0, False), (900.0, True), (900.0, True), (300.0, False), (60.0, False)]
    assert [(r["seconds"], r["warned"]) for r in column(spark, given, times.tick_seconds)] == want
    assert column(spark, ["2µs", "-1m", "+1s", "x"], times.duration_seconds) == [2e-6, -60.0, 1.0, None]


def test_pauses(spark):
    now = F.lit("2026-02-28 21:30:00").cast("timestamp")
    ends = column(spark, ["15m", "6h", "24h", "tomorrow", "2h", None], lambda c: F.date_format(times.pause_end(c, now), "MM-dd HH:mm"))
    assert ends == ["02-28 21:45", "03-01 03:30", "03-01 21:30", "03-01 09:00", None, None]
    shown = column(spark, ["2026-02-28 21:45:00", "2026-03-01 09:00:00", "2026-03-02 09:05:00", None], lambda c: times.until_text(c.cast("timestamp"), now))
    assert shown == ["21:45 today", "09:00 tomorrow", "Mon 2 Mar 09:05", "resumed"]


def test_roots_and_configurations(spark):
    env = {"A": "/x", "H": "~/h", "E": "", "D": "$A"}
    roots = ["~/a/../b", "$A/b", "${A}b", "$H", "$E/a", "$NO/$E", "a/b", "", None, "/..//c/.", "$D/q", "/a$"]
    got = [(r["path"], r["unset"]) for r in column(spark, roots, lambda c: text.expand_root(c, "/home/u", env))]
    assert got == [("/home/u/b", None), ("/x/b", None), ("/xb", None), ("/home/u/h", None), (None, "E"), (None, "E"), (None, None), (None, None), (None, None), ("/c", None), (None, None), ("/a$", None)]
    config = "[remote \"o\"]\r\n\turl = git@h:a/b.git \r\n pushurl=x\nurl=https://h/?q=1\n#url\n url =\n"
    assert column(spark, [config, "", None], text.remote_urls) == [["git@h:a/b.git", "https://h/?q=1", ""], [], None]
    assert column(spark, ["/p/a-b.jsonl", "c.jsonl", "c.json"], text.conversation_id) == ["a-b", "c", ""]
    assert column(spark, ["/r", "/r/a", "/rx", "/s"], lambda c: text.in_tree(c, ["/r/**", "/s/*"])) == [True, True, False, False]


def test_journal(spark, tmp_path):
    path = str(tmp_path / "journal")
    rows = spark.sql("SELECT timestamp'2026-01-01 00:00:00' AS at, 'r1' AS run_id, 'start' AS ev, CAST(NULL AS string) AS phase, 7L AS pid")
    tables.append_journal(rows, path)
    tables.append_journal(rows.withColumn("ev", F.lit("phase")).withColumn("phase", F.lit("scan")), path)
    (tmp_path / "journal" / "torn.txt").write_text('{"at":"2026-01-01T00:00:01Z","run_id":"r2","ev":"sta\n\n{"run_id":"r3"}\n')
    got = tables.read_journal(spark, path).orderBy("ev").collect()
    assert [(r["run_id"], r["ev"], r["phase"], r["pid"]) for r in got] == [("r1", "phase", "scan", 7), ("r1", "start", None, 7)]


def test_reset(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "source_id string, native_path string"
    assert tables.reset_state(spark, path, schema) == 0
    tables.commit_state(spark.createDataFrame([("a", "1"), ("a", "2")], schema), path)
    assert tables.reset_state(spark, path, schema, dry_run=True) == 2 and tables.read_state(spark, path, schema).count() == 2
    assert tables.reset_state(spark, path, schema) == 2 and tables.read_state(spark, path, schema).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([(1, "warn", "", " w ", False), (2, "fail", "b", "x", True), (3, "warn", "r", "x", True), (4, "ok", "o", "o", False), (0, "fail", None, "first", False)], "place int, severity string, brief string, label string, is_rollup boolean")
    r = rollups.issues(rows.withColumn("report", F.lit(1)), ["report"]).first()
    assert (r["fails"], r["issues"]) == (2, ["first", "w", "b"])
    runs = spark.createDataFrame([(1 << 20, 3 << 20, 1500, 2048), (5, 10, 0, 0), (0, 0, 100, 5), (1, 1, None, 1)], "s long, r long, ms long, m long")
    lines = [r[0] for r in runs.select(rollups.throughput_line(*map(F.col, ("s", "r", "ms", "m")))).collect()]
    assert lines == ["  sent  1.0 MB sealed of 3.0 MB read in 1.5s  (2.0 MB/s, median file 2.0 KB)", "  sent  5 B sealed of 10 B read in 0ms", "", ""]
    empty = rollups.heartbeat(spark.createDataFrame([], "source_id string, shipped long, density double"), "i")
    assert rollups.heartbeat_sources(empty).count() == 0 and empty.first()["body"].startswith('{"install":"i"')
    assert rollups.heartbeat_sources(spark.createDataFrame([("no json",), (None,)], "body string")).count() == 0


def test_tracked(spark):
    dirs = spark.createDataFrame([("/a/b/c",), ("/a/x",), ("/a/b",), (None,), ("",)], "dir string")
    marks = spark.createDataFrame([("/a/b",), ("/q",)], "dir string")
    assert sorted(str(r["dir"]) for r in rollups.tracked(dirs, marks).collect()) == ["", "/a/x", "None"]
