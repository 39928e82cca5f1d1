"""Key/value tables of SQLite files that are in use, as a Spark data source.

A file is read by the first of three methods that works: in place, read-only, with a writer's lock waited for; from a
snapshot that SQLite itself writes to scratch; from a copy of a file that nothing has touched for a while, sidecars
included. None of them opens the file for writing, and in none of them are rows of a write-ahead log left out. What must not be read, keys and fields
with credentials, goes before a row leaves the file. Each partition ends with a row of its own that says how it was read.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import sqlite3
import string
import tempfile
import time
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftmark.sources import tables

# Keys that are never read, the keys among them that are (all in lower case), and the fields that are
# taken out of every value.
DENIED_PREFIXES = ("cursorauth/", "cursorauth.")
ALLOWED_KEYS = ("cursorauth/stripemembershiptype", "cursorauth/cachedemail", "cursorauth/cachedsignuptype", "cursorauth/cachedteam")
DENIED_FIELDS = ("blobEncryptionKey", "speculativeSummarizationEncryptionKey")
#: What is looked up of an account, and the longest value.
ACCOUNT_KEYS = ("cursorAuth/stripeMembershipType", "cursorAuth/cachedEmail", "cursorAuth/cachedSignUpType", "cursorAuth/cachedTeam")
MAX_ACCOUNT_BYTES = 1 << 20

#: Ways to read a file, in the order they are tried.
METHODS = ("readonly_open", "scratch_snapshot", "cold_copy")
#: Seconds that a writer's lock is waited for, and that a file must have been left alone before it is copied.
LOCK_SECONDS, COLD_SECONDS = 2.0, 300.0
MAX_ROWS = 200_000
SIDECARS = ("-wal", "-shm")


class _Range(InputPartition):
    """Keys from ``low`` on and below ``high`` of one file; None: no end."""

    def __init__(self, path: str, low: str | None = None, high: str | None = None):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


class KeyValueSource(DataSource):
    """Options: paths (JSON list of files that executors can open), table, and as wanted keys or prefixes (JSON lists),
    limit (rows of a file), ranges (key ranges a file), scratch (folder for snapshots and copies), first (method to begin with)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_kv"

    def schema(self) -> str:
        return "path string, key string, value string, method string, truncated boolean, denied long, stripped long, error string"

    def reader(self, schema) -> DataSourceReader:
        return KeyValueReader(dict(self.options))


def denied(key: str) -> bool:
    low = key.lower()
    return low.startswith(DENIED_PREFIXES) and low not in ALLOWED_KEYS


def stripped(value: str) -> tuple[str, int]:
    """A value without the denied fields at any depth, and how many went; one without them stays byte for byte."""
    if not any(f in value for f in DENIED_FIELDS):
        return value, 0
    gone = 0

    def clean(pairs: list) -> dict:
        nonlocal gone
        kept = {k: v for k, v in pairs if k not in DENIED_FIELDS}
        gone += sum(k in DENIED_FIELDS for k, _ in pairs)
        return kept

    try:
        parsed = json.loads(value, object_pairs_hook=clean)
    except (ValueError, RecursionError):
        return value, 0
    return (json.dumps(parsed, ensure_ascii=False, separators=(",", ":"), sort_keys=True), gone) if gone else (value, 0)


class KeyValueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.table = json.loads(options["paths"]), options.get("table", "")
        if not self.table:
            raise ValueError("name the table: what is read is declared, not discovered")
        self.keys, self.prefixes = json.loads(options.get("keys", "[]")), json.loads(options.get("prefixes", "[]"))
        self.limit, self.ranges = int(options.get("limit", 0)), int(options.get("ranges", 1))
        if self.limit and self.ranges > 1:
            raise ValueError("a limit is of a whole file, so it goes with one range")
        self.scratch, first = options.get("scratch", ""), options.get("first", METHODS[0])
        self.methods = METHODS[METHODS.index(first) :]
        self.longest = int(options.get("longest", 0))

    def partitions(self) -> list[InputPartition]:
        """Files, or key ranges of them: cuts are at hexadecimal digits behind the prefixes, as identifiers are mostly such numbers."""
        digits = string.hexdigits[:16]
        cuts = sorted({p + digits[16 * k // self.ranges] for p in self.prefixes or [""] for k in range(1, min(self.ranges, 16))})
        ends = [None, *cuts, None]
        return [_Range(path, low, high) for path in self.paths for low, high in zip(ends, ends[1:], strict=False)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """Allowed rows in the order of their keys, then the row that reports on them.

        If a method breaks off, the next one goes on behind the last key. Prefixes match as written, upper and lower
        case of ASCII alike; a limit counts allowed rows, and ``truncated`` says that there was another.
        """
        last, count, refused, cut, failures = None, 0, 0, 0, []
        for method in self.methods:
            try:
                with self._opened(partition.path, method) as db:
                    for key, value in self._rows(db, partition, last):
                        last = key
                        if denied(key) or value is None:
                            refused += 1
                            continue
                        if self.limit and count >= self.limit:
                            yield partition.path, None, None, method, True, refused, cut, None
                            return
                        value, n = stripped(value)
                        count, cut = count + 1, cut + n
                        yield partition.path, key, value, method, None, None, None, None
                    yield partition.path, None, None, method, False, refused, cut, None
                    return
            except (sqlite3.Error, OSError) as e:
                failures.append(f"{method}: {e}")
        yield partition.path, None, None, None, False, refused, cut, "; ".join(failures)

    def _rows(self, db: sqlite3.Connection, part: _Range, last: str | None) -> Iterator[tuple]:
        tests, given = [], []
        if self.prefixes:
            tests.append("(" + " OR ".join(["key LIKE ? ESCAPE '\\'"] * len(self.prefixes)) + ")")
            given += ["".join("\\" + c if c in "\\%_" else c for c in p) + "%" for p in self.prefixes]
        if self.keys:
            tests.append("key IN (" + ", ".join("?" * len(self.keys)) + ")")
            given += self.keys
        if self.longest:
            tests.append(f"length(CAST(value AS BLOB)) <= {self.longest}")
        for sign, bound in ((">=", part.low), ("<", part.high), (">", last)):
            if bound is not None:
                tests.append(f"key {sign} ?")
                given.append(bound)
        table = '"' + self.table.replace('"', '""') + '"'
        return db.execute(f"SELECT CAST(key AS TEXT), CAST(value AS TEXT) FROM {table} WHERE {' AND '.join(tests) or '1'} ORDER BY key", given)

    @contextlib.contextmanager
    def _opened(self, path: str, method: str) -> Iterator[sqlite3.Connection]:
        """A connection that can't write, to the file or to what the method makes of it; scratch is empty again afterwards."""
        if method == METHODS[0]:
            with contextlib.closing(_connect(path)) as db:
                yield db
            return
        if not self.scratch:
            raise OSError("no scratch folder")
        os.makedirs(self.scratch, mode=0o700, exist_ok=True)
        folder = tempfile.mkdtemp(prefix=method + "-", dir=self.scratch)
        try:
            copy = os.path.join(folder, os.path.basename(path))
            if method == METHODS[1]:
                with contextlib.closing(_connect(path)) as db:
                    db.execute("VACUUM INTO ?", (copy,))
            else:
                copy_cold(path, folder)
            with contextlib.closing(_connect(copy)) as db:
                yield db
        finally:
            shutil.rmtree(folder)


def _connect(path: str) -> sqlite3.Connection:
    """Read-only, but with the write-ahead log: an immutable open would skip it and give old rows."""
    db = sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True, timeout=LOCK_SECONDS, isolation_level=None)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def _stamps(path: str) -> list[tuple]:
    """Files that make up the store, with size and time; readers touch the shared index, so it has none."""
    found = [(p, os.stat(p)) for p in (path, path + SIDECARS[0]) if os.path.exists(p)]
    return [(p, s.st_size, s.st_mtime_ns) for p, s in found]


def copy_cold(path: str, folder: str) -> str:
    """Copy a file that has been left alone, with its sidecars under matching names; one that changes meanwhile is an error."""
    before = _stamps(path)
    if not before:
        raise OSError("it isn't there")
    idle = time.time() - max(at for _, _, at in before) / 1e9
    if idle < COLD_SECONDS:
        raise OSError(f"it was written to {idle:.0f} s ago: a copy of a file in use is not consistent")
    for p in (path, *(path + s for s in SIDECARS if os.path.exists(path + s))):
        with open(p, "rb") as source, open(os.path.join(folder, os.path.basename(p)), "xb") as target:
            shutil.copyfileobj(source, target)
    if _stamps(path) != before:
        raise OSError("it changed while it was copied")
    return os.path.join(folder, os.path.basename(path))


def read_raw(spark: SparkSession, paths: list[str], table: str, prefixes: list[str] = (), limit: int = 0, ranges: int = 1, scratch: str = "", first: str = METHODS[0], keys: list[str] = (), longest: int = 0) -> DataFrame:
    """Rows (path, key, value, method) and, with a null key, a report for each range (method, truncated, denied, stripped, error).

    Each range is read at its own moment; one range a file gives all its rows of one moment. Without ``scratch`` only the
    open in place is tried. A file that no method can read gives a report with the error of each.
    """
    spark.dataSource.register(KeyValueSource)
    options = {"paths": json.dumps(list(paths)), "table": table, "prefixes": json.dumps(list(prefixes)), "keys": json.dumps(list(keys)), "limit": limit, "ranges": ranges, "scratch": scratch, "first": first, "longest": longest}
    return spark.read.format("sqlite_kv").options(**options).load()


def rows_of(raw: DataFrame) -> DataFrame:
    return raw.where("key IS NOT NULL").select("path", "key", "value", "method")


def report_of(raw: DataFrame) -> DataFrame:
    """By file: rows, methods, truncated, denied (rows), stripped (fields), error."""
    out = raw.groupBy("path").agg(F.count("key").alias("rows"), F.array_sort(F.collect_set("method")).alias("methods"), F.bool_or("truncated").alias("truncated"), F.sum("denied").alias("denied"), F.sum("stripped").alias("stripped"), F.max("error").alias("error"))
    return out.withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def read_store(spark: SparkSession, paths: list[str], table: str, prefixes: list[str] = (), limit: int = 0, **options) -> DataFrame:
    """Allowed rows (path, key, value, method) of key/value tables; see read_raw for the options and the reports."""
    return rows_of(read_raw(spark, paths, table, prefixes, limit, **options))


def read_account(spark: SparkSession, paths: list[str], table: str = "ItemTable") -> DataFrame:
    """(path, key, value) of the account that a store belongs to: named keys only, no token among them, no value over a megabyte."""
    return rows_of(read_raw(spark, paths, table, keys=ACCOUNT_KEYS, longest=MAX_ACCOUNT_BYTES)).drop("method")


def key_denied(key: Column) -> Column:
    low = F.lower(key)
    return (low.startswith(DENIED_PREFIXES[0]) | low.startswith(DENIED_PREFIXES[1])) & ~low.isin(*ALLOWED_KEYS)


def _field(value: Column, path: str) -> Column:
    return F.get_json_object(value, "$." + path)


def _first_of(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


#: What is read of a stored event; every scalar as a text, since its kind has changed over time, and so has that of ``thinking``.
_EVENT = (
    "bubbleId string, type string, text string, isThought string, thinking string, isCapabilityIteration string, capabilityType string, createdAt string, requestId string, checkpointId string, "
    "turnDurationMs string, modelName string, modelInfo struct<modelName string>, toolFormerData struct<toolCallId string, name string, tool string, status string, rawArgs string, params string, result string>"
)


def _reasoning(e: Column) -> Column:
    own = _first_of(_field(e["thinking"], "text"), F.when(~e["thinking"].startswith("{"), _first_of(_field(e["thinking"], "text"), e["thinking"])))
    return F.coalesce(own, F.when(e["isThought"] == "true", e["text"]), F.lit(""))


def _scaffolding(e: Column) -> Column:
    says = e["toolFormerData"].isNotNull() | (_reasoning(e) != "")
    flagged = (F.coalesce(e["isCapabilityIteration"], F.lit("")) == "true") | (F.coalesce(e["capabilityType"], F.lit("")) != "")
    return ~says & (flagged | (F.coalesce(e["text"], F.lit("")) == ""))


def reasoning_text(event: Column) -> Column:
    """A stored event's reasoning (JSON): what ``thinking`` says, an object or a text that holds one; else the text of one marked ``isThought``, else empty."""
    return F.coalesce(_reasoning(F.from_json(event, _EVENT)), F.lit(""))


def is_scaffolding(event: Column) -> Column:
    """Has a stored event (JSON) no counterpart by design? One with a tool call or reasoning never is scaffolding; any other is if it is flagged or has no text."""
    return _scaffolding(F.from_json(event, _EVENT))


def ordered_events(rows: DataFrame) -> DataFrame:
    """(conv, pos, rung, event_id, event) of a store's rows (key, value): each conversation's events in its best order.

    Rung 0 is the conversation's header list, ids without an event passed over; rung 1 the array of events inside the
    conversation; rung 2 its events by creation time, then key. The first rung that has an event counts, for all of a
    conversation. Values that aren't JSON have no events; pos ascends, but not by one.
    """
    conv = rows.where(F.startswith("key", F.lit("composerData:"))).select(F.expr("substr(key, 14)").alias("conv"), "value")
    key = F.split("key", ":", 3)
    known = F.startswith("key", F.lit("bubbleId:")) & (F.size(key) == 3) & F.try_parse_json("value").isNotNull()
    stored = rows.where(known).select(F.get(key, 1).alias("conv"), F.get(key, 2).alias("id"), F.col("value").alias("event"))
    heads = conv.select("conv", F.posexplode(F.from_json(_field(F.col("value"), "fullConversationHeadersOnly"), "array<struct<bubbleId:string>>")).alias("pos", "h"))
    listed = heads.select("conv", "pos", F.col("h.bubbleId").alias("id")).join(stored, ["conv", "id"]).select("conv", F.lit(0).alias("rung"), F.col("pos").cast("long"), "id", "event")
    inline = conv.select("conv", F.posexplode(F.from_json(_field(F.col("value"), "conversation"), "array<string>")).alias("pos", "event"))
    inline = inline.select("conv", F.lit(1).alias("rung"), F.col("pos").cast("long"), F.lit(None).cast("string").alias("id"), "event")
    by_time = Window.partitionBy("conv").orderBy(F.coalesce(_field(F.col("event"), "createdAt"), F.lit("")), "id")
    timed = stored.select("conv", F.lit(2).alias("rung"), (F.row_number().over(by_time) - 1).cast("long").alias("pos"), "id", "event")
    every = tables.written(listed.unionByName(inline).unionByName(timed), "store-events")  # read for the rungs and for the rows
    best = every.groupBy("conv").agg(F.min("rung").alias("rung"))
    return every.join(best, ["conv", "rung"]).select("conv", "pos", "rung", _first_of(_field(F.col("event"), "bubbleId"), F.col("id")).alias("event_id"), "event")


def events(rows: DataFrame) -> DataFrame:
    """The ordered events of a store's rows as alignment.align takes them, scaffolding left out, with all that a transcript lacks."""
    e = F.col("e")
    spoken = lambda c: F.when(~F.trim(c).isin("", "{}", "null"), c)
    call, kind = e["toolFormerData"], e["type"]
    parsed = ordered_events(rows).withColumn("e", F.from_json("event", _EVENT)).where(~_scaffolding(e))
    return parsed.select(
        "conv", "pos", "event_id", F.when(kind == "1", "user").when(kind == "2", "assistant").when(kind != "0", "other").alias("role"), e["text"].alias("text"), _reasoning(e).alias("reasoning"),
        call.isNotNull().alias("is_call"), _first_of(call["name"], call["tool"]).alias("name"), F.coalesce(spoken(call["rawArgs"]), spoken(call["params"])).alias("args"),
        call["status"].alias("status"), call["result"].alias("result"), call["toolCallId"].alias("tool_call_id"), e["createdAt"].alias("created_at"),
        e["requestId"].alias("request_id"), e["checkpointId"].alias("checkpoint_id"), F.try_to_number(e["turnDurationMs"], F.lit("999999999999999999")).cast("long").alias("turn_ms"), _first_of(e["modelName"], e["modelInfo"]["modelName"]).alias("model_name"),
    )
