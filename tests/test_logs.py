"""Logs in generations: the end of a log is read from its end."""

import random

from pyspark.sql import functions as F

from driftmark.sources import logs

SCHEMA = "source string, at long, ok boolean"


def filled(spark, path, appends, most_bytes=3_000, keep=None):
    rng, every, at = random.Random(4), [], 0
    for k in range(appends):
        rows = []
        for _ in range(20):
            at += 1
            source = rng.choice("abcd")
            rows.append((source, at, source == "d" or (rng.random() < 0.15 and k < appends - 2)))
        every += [(*r, k + 1) for r in rows]
        logs.append(spark.createDataFrame(rows, SCHEMA), path, most_bytes, keep)
    return every


def test_last_rows_come_from_the_newest_generations(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    every = filled(spark, path, 9)
    numbers = logs.generations(spark, path)
    assert len(numbers) >= 3 and logs.read_log(spark, path, SCHEMA).count() == len(every)
    read, real = [], logs._folder
    monkeypatch.setattr(logs, "_folder", lambda p, n: (read.append(n), real(p, n))[1])
    got = [r["at"] for r in logs.read_last(spark, path, 7, [F.desc("at")], SCHEMA).collect()]
    assert got == [r[1] for r in every[::-1][:7]] and set(read) == {numbers[-1]}
    assert logs.read_last(spark, path, 10_000, [F.desc("at")], SCHEMA).count() == len(every)
    assert logs.read_last(spark, str(tmp_path / "none"), 5, [F.desc("at")], SCHEMA).count() == 0


def test_failures_since_the_last_success(spark, tmp_path):
    path = str(tmp_path / "log")
    every = filled(spark, path, 8)
    want = {}
    for source in "abcd":
        mine = [r for r in every if r[0] == source]
        good = max((r[1] for r in mine if r[2]), default=0)
        bad = [r[1] for r in mine if r[1] > good]
        if bad:
            want[source] = (len(bad), bad[0])
    got = {r["source"]: (r["failures"], r["since"]) for r in logs.failing(spark, path, "source", F.col("ok"), ["at"], SCHEMA).collect()}
    assert got == want and len(want) == 3


def test_old_generations_go(spark, tmp_path):
    path = str(tmp_path / "log")
    filled(spark, path, 8, keep=2)
    numbers = logs.generations(spark, path)
    assert len(numbers) == 2 and numbers[-1] >= 3
    before = logs.read_log(spark, path, SCHEMA).count()
    logs.append(spark.createDataFrame([("z", 999, True)], SCHEMA), path, 10**9, 2)
    assert logs.read_log(spark, path, SCHEMA).count() == before + 1
    assert logs.read_last(spark, path, 1, [F.desc("at")], SCHEMA).first()["at"] == 999
