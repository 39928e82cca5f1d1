"""Stores that are in use, and what of them may be read; trees and what of them may be walked."""

import json
import os
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from driftmark.sources import keyvalue, walk

TABLE = "cursorDiskKV"


def store(path, rows, wal=False):
    db = sqlite3.connect(path, isolation_level=None)
    db.execute("PRAGMA journal_mode=" + ("WAL" if wal else "DELETE"))
    db.execute(f"CREATE TABLE IF NOT EXISTS {TABLE} (key TEXT PRIMARY KEY, value BLOB)")
    db.executemany(f"INSERT OR REPLACE INTO {TABLE} VALUES (?, ?)", rows)
    return db


def aged(path, seconds=3600):
    for name in os.listdir(os.path.dirname(path)):
        os.utime(os.path.join(os.path.dirname(path), name), (time.time() - seconds,) * 2)


def pairs(df):
    return sorted((r["key"], r["value"]) for r in df.collect())


def test_rows_of_a_write_ahead_log_are_seen_by_every_method(spark, tmp_path):
    (tmp_path / "db").mkdir()
    path, scratch = str(tmp_path / "db/it's a 100% #1?.vscdb"), str(tmp_path / "scratch")
    db = store(path, [(f"bubbleId:c:{k:02x}", json.dumps({"k": k})) for k in range(40)], wal=True)
    db.execute("PRAGMA wal_autocheckpoint=0")
    db.execute(f"INSERT INTO {TABLE} VALUES ('bubbleId:c:late', '{{}}')")  # committed, and only in the log
    assert os.path.getsize(path + "-wal") > 0
    before = {n: os.path.getsize(tmp_path / "db" / n) for n in os.listdir(tmp_path / "db")}
    aged(path)
    read = {}
    for method in keyvalue.METHODS:
        raw = keyvalue.read_raw(spark, [path], TABLE, scratch=scratch, first=method)
        read[method] = pairs(keyvalue.rows_of(raw))
        assert keyvalue.report_of(raw).first()["methods"] == [method]
        assert os.listdir(scratch) == [] if method != keyvalue.METHODS[0] else True  # no scratch is left
    assert len(read["readonly_open"]) == 41 and read["readonly_open"] == read["scratch_snapshot"] == read["cold_copy"]
    assert {n: os.path.getsize(tmp_path / "db" / n) for n in os.listdir(tmp_path / "db")} == before  # nothing was written beside it
    split = keyvalue.read_raw(spark, [path], TABLE, ["bubbleId:c:"], ranges=4)
    assert split.rdd.getNumPartitions() == 4 and pairs(keyvalue.rows_of(split)) == read["readonly_open"]
    db.close()


def test_a_file_in_use_is_not_copied(spark, tmp_path):
    path = str(tmp_path / "live.vscdb")
    store(path, [("a", "1")]).close()
    report = keyvalue.report_of(keyvalue.read_raw(spark, [path, str(tmp_path / "gone")], TABLE, scratch=str(tmp_path / "s"), first="cold_copy"))
    errors = {r["path"]: r["error"] for r in report.collect()}
    assert "in use" in errors[path] and "isn't there" in errors[str(tmp_path / "gone")]
    aged(path)
    assert pairs(keyvalue.read_store(spark, [path], TABLE, scratch=str(tmp_path / "s"), first="cold_copy")) == [("a", "1")]
    with pytest.raises(ValueError):
        keyvalue.KeyValueReader({"paths": "[]"})  # no table


def test_the_next_method_goes_on_behind_the_last_key(spark, tmp_path):
    path = str(tmp_path / "x.vscdb")
    store(path, [(f"k{k}", str(k)) for k in range(6)]).close()
    reader = keyvalue.KeyValueReader({"paths": json.dumps([path]), "table": TABLE, "scratch": str(tmp_path / "s")})
    real, calls = reader._rows, []

    def breaks(db, part, last):
        calls.append(last)
        for n, row in enumerate(real(db, part, last)):
            if len(calls) == 1 and n == 3:
                raise sqlite3.OperationalError("disk I/O error")
            yield row

    reader._rows = breaks
    rows = list(reader.read(reader.partitions()[0]))
    assert [r[1] for r in rows] == [f"k{k}" for k in range(6)] + [None] and calls == [None, "k2"]
    assert [r[3] for r in rows] == ["readonly_open"] * 3 + ["scratch_snapshot"] * 4


def test_credentials_never_leave_the_file(spark, tmp_path):
    path = str(tmp_path / "a.vscdb")
    nested = '{"b":[{"blobEncryptionKey":"k1","x":1}],"a":{"speculativeSummarizationEncryptionKey":{"y":2}},"z":"ü"}'
    verbatim = '{"b": 1,  "a": [ 2 ], "note": "has no key"}'
    rows = [("composerData:1", nested), ("composerData:2", verbatim), ("plain", "blobEncryptionKey not JSON"), ("empty", None)]
    rows += [(k, "v") for k in ("cursorAuth/accessToken", "CURSORAUTH/x", "cursorauth.token", "cursorAuth/cachedEmailX", "cursorAuth/cachedEmail", "cursorAuth/stripeMembershipType", "secret")]
    store(path, rows).close()
    raw = keyvalue.read_raw(spark, [path], TABLE)
    got = dict(pairs(keyvalue.rows_of(raw)))
    assert got["composerData:1"] == '{"a":{},"b":[{"x":1}],"z":"ü"}' and got["composerData:2"] == verbatim and got["plain"] == rows[2][1]
    assert set(got) == {"composerData:1", "composerData:2", "plain", "cursorAuth/cachedEmail", "cursorAuth/stripeMembershipType", "secret"}
    report = keyvalue.report_of(raw).first()
    assert report["denied"] == 5 and report["stripped"] == 2 and report["rows"] == 6 and not report["truncated"]
    keys = [r["key"] for r in keyvalue.read_account(spark, [path], TABLE).collect()]
    assert sorted(keys) == ["cursorAuth/cachedEmail", "cursorAuth/stripeMembershipType"]
    df = spark.createDataFrame([(r[0],) for r in rows], "key string")
    assert {r["key"] for r in df.where(~keyvalue.key_denied(F.col("key"))).collect()} == set(got) | {"empty"}


def test_limits_prefixes_and_wildcards(spark, tmp_path):
    path = str(tmp_path / "a.vscdb")
    store(path, [(k, "v") for k in ("a_1", "ab1", "A_2", "a%3", "cursorauth/t", "a_4")]).close()
    got = lambda **o: [r["key"] for r in keyvalue.read_store(spark, [path], TABLE, **o).orderBy("key").collect()]
    assert got(prefixes=["a_"]) == ["A_2", "a_1", "a_4"] and got(prefixes=["a%"]) == ["a%3"]
    for limit, more in ((4, True), (5, False)):
        raw = keyvalue.read_raw(spark, [path], TABLE, limit=limit)
        assert keyvalue.rows_of(raw).count() == limit and keyvalue.report_of(raw).first()["truncated"] == more
    with pytest.raises(ValueError):
        keyvalue.KeyValueReader({"paths": "[]", "table": "t", "limit": 1, "ranges": 2})


def test_order_of_events_in_three_generations(spark):
    bubble = lambda **v: json.dumps({"type": 2, "text": "t"} | v)
    rows = [
        ("composerData:new", '{"fullConversationHeadersOnly":[{"bubbleId":"z"},{"bubbleId":"lost"},{"bubbleId":"a"}],"conversation":[{"bubbleId":"no","text":"x"}]}'),
        ("bubbleId:new:a", bubble()), ("bubbleId:new:z", bubble(bubbleId="own")), ("bubbleId:new:unlisted", bubble()),
        ("composerData:old", '{"fullConversationHeadersOnly":[{"bubbleId":"lost"}],"conversation":[{"bubbleId":"two","type":1,"text":"x"},{"bubbleId":"one","text":"y"}]}'),
        ("bubbleId:old:one", bubble()),
        ("composerData:keys", "{}"), ("bubbleId:keys:c", bubble(createdAt="2024-01-01")), ("bubbleId:keys:b", bubble(createdAt="2024-01-02")), ("bubbleId:keys:a", bubble(createdAt="2024-01-02")),
        ("bubbleId:keys:0", bubble()), ("bubbleId:lonely:x", bubble()), ("bubbleId:broken:x", "{not json"), ("bubbleId:no-id", bubble()),
    ]
    found = keyvalue.ordered_events(spark.createDataFrame(rows, "key string, value string").repartition(3)).collect()
    order = {c: [r["event_id"] for r in sorted(found, key=lambda r: r["pos"]) if r["conv"] == c] for c in {r["conv"] for r in found}}
    assert order == {"new": ["own", "a"], "old": ["two", "one"], "keys": ["0", "c", "a", "b"], "lonely": ["x"]}


def test_scaffolding(spark):
    cases = [
        ({"text": "hello"}, False), ({"text": ""}, True), ({"text": "x", "isCapabilityIteration": True}, True), ({"text": "x", "capabilityType": 15}, True), ({"text": "x", "capabilityType": None}, False),
        ({"isCapabilityIteration": True, "capabilityType": 15, "toolFormerData": {"name": "n"}}, False), ({"toolFormerData": None, "text": ""}, True),
        ({"isCapabilityIteration": True, "thinking": {"text": "hm"}}, False), ({"isCapabilityIteration": True, "thinking": '{"text":"hm"}'}, False), ({"isCapabilityIteration": True, "isThought": True, "text": "hm"}, False),
    ]
    df = spark.createDataFrame([(k, json.dumps(e)) for k, (e, _) in enumerate(cases)], "k int, event string")
    got = [r["s"] for r in df.select("k", keyvalue.is_scaffolding(F.col("event")).alias("s")).orderBy("k").collect()]
    assert got == [want for _, want in cases]


# --- trees -----------------------------------------------------------------------------------------


def tree(root, *paths):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x" * 10)


def walked(spark, root, tmp_path, deny=(), include=("**/*.jsonl",), exclude=(), max_bytes=None):
    entries = walk.walk(spark, [str(root)], str(tmp_path / f"scratch{time.monotonic_ns()}"), list(deny))
    found, large, bad = walk.candidates(entries, list(include), list(exclude), list(deny), max_bytes)
    return sorted(r["rel_path"] for r in found.collect()), sorted(r["rel_path"] for r in large.collect()), bad.collect(), entries


def test_links_are_not_followed_but_for_the_root(spark, tmp_path):
    tree(tmp_path / "real", "a/x.jsonl", "a/b/c/d/y.jsonl", "z.jsonl")
    tree(tmp_path / "elsewhere", "secret.jsonl")
    (tmp_path / "real/loop").symlink_to(tmp_path / "real")
    (tmp_path / "real/a/out").symlink_to(tmp_path / "elsewhere")
    (tmp_path / "real/a/file.jsonl").symlink_to(tmp_path / "elsewhere/secret.jsonl")
    os.mkfifo(tmp_path / "real/pipe.jsonl")
    (tmp_path / "link").symlink_to(tmp_path / "real")
    for root in ("real", "link"):
        names, _, bad, _ = walked(spark, tmp_path / root, tmp_path)
        assert names == ["a/b/c/d/y.jsonl", "a/x.jsonl", "z.jsonl"] and bad == []
    assert walked(spark, tmp_path / "nowhere", tmp_path)[0] == []


def test_denied_trees_by_either_name(spark, tmp_path):
    tree(tmp_path / "vault", "in/a.jsonl", "in/keep/b.jsonl")
    tree(tmp_path / "open", "name.jsonl/c.jsonl", "no/d.jsonl", "no/deep/e.jsonl")
    (tmp_path / "alias").symlink_to(tmp_path / "vault")
    vault = [f"{tmp_path}/vault/**"]
    names, _, bad, _ = walked(spark, tmp_path / "alias/in", tmp_path, vault)
    assert names == [] and "refuses" in bad[0]["error"]  # the parent is a link into a denied tree
    names, _, bad, entries = walked(spark, tmp_path / "open", tmp_path, [f"{tmp_path}/open/no/**", f"{tmp_path}/open/*.jsonl"])
    assert names == ["name.jsonl/c.jsonl"] and bad == []  # a directory named like a denied file is still walked
    assert not any("/no" in r["path"][len(str(tmp_path)) :] for r in entries.collect())  # never listed
    assert walked(spark, tmp_path / "open", tmp_path, include=["**/*"], exclude=["no/**"], max_bytes=5)[:2] == ([], ["name.jsonl/c.jsonl"])


def test_a_large_tree_takes_several_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "DIRS_PER_TASK", 3)
    names = [f"d{a}/e{b}/f{c}/x{k}.jsonl" for a in range(4) for b in range(3) for c in range(3) for k in range(2)]
    tree(tmp_path / "in", *names)
    found, _, bad, entries = walked(spark, tmp_path / "in", tmp_path)
    assert found == sorted(names) and bad == [] and entries.where("kind = 'dir'").count() == 4 + 12 + 36
    assert entries.count() == entries.distinct().count() == 52 + len(names)


def test_what_cannot_be_read_is_told(spark, tmp_path, monkeypatch):
    tree(tmp_path / "in", "a/x.jsonl", "b/y.jsonl")
    real = os.scandir
    names, _, bad, _ = walked(spark, tmp_path / "in/a/x.jsonl", tmp_path)  # a root that is no directory can't be listed
    assert names == [] and len(bad) == 1
    names, _, bad, _ = walked(spark, tmp_path / "in", tmp_path)
    assert names == ["a/x.jsonl", "b/y.jsonl"] and bad == [] and real is os.scandir


def test_loader_refuses_links_and_large_files(spark, tmp_path):
    tree(tmp_path, "a.txt")
    (tmp_path / "l.txt").symlink_to(tmp_path / "a.txt")
    (tmp_path / "big.txt").write_text("x" * 100)
    df = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.txt", "l.txt", "big.txt", "gone.txt")], "path string")
    got = {os.path.basename(r["path"]): (r["content"], r["load_error"]) for r in walk.load(df, 50).collect()}
    assert bytes(got["a.txt"][0]) == b"x" * 10 and got["a.txt"][1] is None
    assert all(got[n][0] is None and got[n][1] for n in ("l.txt", "big.txt", "gone.txt"))
