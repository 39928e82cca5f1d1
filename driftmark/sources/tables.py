"""Logs, state and sealed objects as tables, and their writers."""

from __future__ import annotations

import contextlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

REASON_BYTES = 500
AUDIT = "at string, source_id string, native_path string, decision string, reason string, bytes_in long, bytes_out long"


def read_audit(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Entries of an audit log, unreadable lines left out; the last ones by time if asked for."""
    df = spark.read.schema(AUDIT + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    df = df.where("_corrupt IS NULL AND at IS NOT NULL").drop("_corrupt")
    return df if last is None else df.orderBy(F.desc("at")).limit(last)


def safe_reason(reason: Column) -> Column:
    """One line of at most 500 bytes, characters whole; withheld if it has a sentinel in it."""
    flat = F.regexp_replace(reason, "[\r\n]+", " ")
    start = F.left(flat, F.lit(REASON_BYTES))
    longest = F.array_max(F.filter(F.sequence(F.lit(REASON_BYTES // 4), F.lit(REASON_BYTES)), lambda k: F.octet_length(F.left(flat, k)) <= REASON_BYTES))
    flat = F.when(F.octet_length(start) <= REASON_BYTES, start).otherwise(F.left(flat, longest))
    return F.when(F.contains(reason, F.lit("__REDACTED:")), F.lit("(withheld)")).otherwise(flat)


def append_audit(entries: DataFrame, path: str) -> None:
    entries.withColumn("reason", safe_reason(F.col("reason"))).write.mode("append").json(path)


def write_objects(objects: DataFrame, path: str) -> None:
    """Sealed objects: payload and manifest columns side by side, compressed, by source; a manifest read never touches payloads.

    objects: key, source_id, content, manifest (struct). The payload's hash goes in beside it.
    """
    out = objects.withColumn("written_at", F.current_timestamp()).withColumn("shipped_hash", F.sha2(F.col("content").cast("binary"), 256)).withColumn("payload_size", F.octet_length("content"))
    out.write.mode("append").option("compression", "zstd").partitionBy("source_id").parquet(path)


def latest_objects(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each key; a file's whole history lies on one key."""
    df = spark.read.parquet(path)
    newest = df.groupBy("key").agg(F.max("written_at").alias("written_at"))
    return df.join(newest, ["key", "written_at"], "left_semi")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local master without it gets a temporary one, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="driftmark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet; it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/driftmark/{label}-{uuid.uuid4().hex}"
    place, fs = _hadoop(spark, path)
    fs.deleteOnExit(place)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows from a table in the shared folder, so that what reads them several times, or after a lost executor, starts there."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_folder(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder below ``path`` that goes when the block ends."""
    folder = f"{path}/work-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        place, fs = _hadoop(spark, folder)
        fs.delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, path: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table below ``path`` and reads it back, so that plans start anew; all goes when the block ends."""
    with scratch_folder(spark, path) as folder:

        def kept(df: DataFrame) -> DataFrame:
            place = f"{folder}/{uuid.uuid4().hex}"
            df.write.parquet(place)
            return spark.read.schema(df.schema).parquet(place)

        yield kept


#: Version of a state table's layout; a table of another one isn't read.
STATE_VERSION = 2
#: A state is written anew when it has more changes files than this, or when they hold more than this share of its rows.
MOST_CHANGES, MOST_SHARE = 16, 0.25
_GENERATION = re.compile(r"commit-(\d{10})$")


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed generations, ascending."""
    place, fs = _hadoop(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(m[1]) for m in map(_GENERATION.match, names) if m)


def _commit_of(spark: SparkSession, path: str, number: int) -> dict:
    place, fs = _hadoop(spark, f"{path}/commit-{number:010d}")
    stream = fs.open(place)
    try:
        commit = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    if commit["version"] != STATE_VERSION:
        raise ValueError(f"the state has layout {commit['version']}, not {STATE_VERSION}")
    return commit


def _checksum(state: DataFrame) -> str:
    """Rows and a sum of row hashes, the same in any order."""
    row = state.select(F.xxhash64(*state.columns).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.coalesce(F.sum("h"), F.lit(0))).first()
    return f"{row[0]}:{row[1]}"


def _part(spark: SparkSession, path: str, part: dict, schema) -> DataFrame:
    rows = spark.read.schema(schema).parquet(f"{path}/{part['rows']}")
    if _checksum(rows) != part["checksum"]:
        raise ValueError("the state's rows don't have its checksum")
    return rows


def _with_gone(schema) -> StructType:
    kept = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return StructType([*kept.fields, StructField("_gone", BooleanType()), StructField("_number", LongType())])


def read_state(spark: SparkSession, path: str, schema) -> DataFrame:
    """A state table as of its newest commit; an empty table where none was committed.

    A commit names a table of rows and the changes since, rows and keys that went; of each key the newest counts. A generation
    counts once its commit file is there, so a driver that dies at any point leaves the last one in force.
    Rows that don't have the commit's checksum, or a layout of another version, are an error.
    """
    known = _commits(spark, path)
    if not known:
        return spark.createDataFrame([], schema)
    commit = _commit_of(spark, path, known[-1])
    base = _part(spark, path, commit["base"], schema)
    if not commit["changes"]:
        return base
    changed, keys = None, commit["keys"]
    for part in commit["changes"]:
        rows = _part(spark, path, part, _with_gone(schema))
        changed = rows if changed is None else changed.unionByName(rows)
    newest = changed.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in changed.columns if c not in keys]), "_number").alias("_row")).select(*keys, "_row.*")
    # changes are a bounded share of the rows, so the table itself is read in place wherever their keys fit a broadcast
    kept = base.join(newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest.where("NOT _gone").drop("_gone", "_number")).select(*base.columns)


def _write_part(rows: DataFrame, path: str, kind: str) -> dict:
    name = f"{kind}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{name}")
    checksum = _checksum(written)
    return {"rows": name, "checksum": checksum, "count": int(checksum.split(":")[0])}


def _put(spark: SparkSession, path: str, commit: dict, number: int, keep: int) -> None:
    """Make a commit visible by a rename, which never overwrites; then drop generations beyond the last ``keep`` and what only they name."""
    fresh, fs = _hadoop(spark, f"{path}/{uuid.uuid4().hex}.commit")
    out = fs.create(fresh)
    out.write(bytearray(json.dumps(commit).encode()))
    out.close()
    final, _ = _hadoop(spark, f"{path}/commit-{number:010d}")
    if fs.exists(final) or not fs.rename(fresh, final):
        raise OSError(f"generation {number} of the state is there already")
    every = _commits(spark, path)
    named = lambda n: {p["rows"] for c in [_commit_of(spark, path, n)] for p in [c["base"], *c["changes"]]}
    used = set().union(*[named(n) for n in every[-keep:]])
    for old in every[:-keep]:
        gone = named(old) - used
        fs.delete(_hadoop(spark, f"{path}/commit-{old:010d}")[0], False)  # the commit first: one without rows must never be found
        for rows in gone:
            fs.delete(_hadoop(spark, f"{path}/{rows}")[0], True)


def peek(spark: SparkSession, path: str) -> dict:
    """What a state's newest commit says, without its rows: generation, count of rows (changes included), changes, note; empty without one."""
    known = _commits(spark, path)
    if not known:
        return {}
    commit = _commit_of(spark, path, known[-1])
    return {"generation": known[-1], "count": commit["base"]["count"] + sum(c["count"] for c in commit["changes"]), "changes": len(commit["changes"]), "note": commit["note"]}


def commit_state(state: DataFrame, path: str, keep: int = 2, note: dict | None = None) -> None:
    """Replace a state table as a whole: rows are written first, then a commit file appears by rename.

    The last ``keep`` generations stay, older ones go. A commit that another one came before is an error. note: what else the
    commit says, a small dictionary.
    """
    spark = state.sparkSession
    number = (_commits(spark, path) or [0])[-1] + 1
    _put(spark, path, {"version": STATE_VERSION, "base": _write_part(state, path, "rows"), "changes": [], "keys": [], "note": note or {}}, number, keep)


def commit_changes(rows: DataFrame, gone: DataFrame, path: str, keys: list[str], keep: int = 2, note: dict | None = None) -> None:
    """Commit new or changed ``rows`` of a state table and the keys of those that are ``gone``: as many rows are written as change.

    A key that is in both has its row. Beyond MOST_CHANGES commits, or MOST_SHARE of the rows in them, the table is written anew,
    so each row is written a bounded number of times for each change. note: as in commit_state, None for the last one's. Where neither
    rows nor note are new there is no commit.
    """
    spark, schema = rows.sparkSession, rows.schema
    known = _commits(spark, path)
    if not known:
        if note or rows.limit(1).count():
            commit_state(rows, path, keep, note)
        return
    number, commit = known[-1] + 1, _commit_of(spark, path, known[-1])
    note = commit["note"] if note is None else note
    marked = rows.withColumns({"_gone": F.lit(False), "_number": F.lit(number).cast("long")})
    went = gone.select(*keys).join(rows.select(*keys), keys, "left_anti").withColumns({"_gone": F.lit(True), "_number": F.lit(number).cast("long")})
    part = _write_part(marked.unionByName(went, allowMissingColumns=True), path, "changes")
    changes = [*commit["changes"], part]
    if not part["count"]:
        changes.pop()
        place, fs = _hadoop(spark, f"{path}/{part['rows']}")
        fs.delete(place, True)
        if note == commit["note"]:
            return
    _put(spark, path, {"version": STATE_VERSION, "base": commit["base"], "changes": changes, "keys": keys, "note": note}, number, keep)
    if len(changes) > MOST_CHANGES or sum(c["count"] for c in changes) > max(10_000, MOST_SHARE * commit["base"]["count"]):
        commit_state(read_state(spark, path, schema), path, keep, note)


def reset_state(spark: SparkSession, path: str, schema: str, dry_run: bool = False) -> int:
    """Forget all rows of a state table; returns their number. A dry run only counts them."""
    rows = read_state(spark, path, schema).count()
    if rows and not dry_run:
        commit_state(spark.createDataFrame([], schema), path)
    return rows


JOURNAL = "at timestamp, run_id string, ev string, phase string, pid long"


def append_journal(entries: DataFrame, path: str) -> None:
    """Append run markers (at, run_id, ev: start, phase, reported, exit; phase, pid) as JSON lines."""
    entries.select(F.to_json(F.struct("at", "run_id", "ev", "phase", "pid")).alias("value")).write.mode("append").text(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a journal; torn lines and those without a run or a marker are left out."""
    return spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path).where("run_id IS NOT NULL AND ev IS NOT NULL")


def checked(objects: DataFrame) -> DataFrame:
    """Objects with ``intact``: does the payload still have its hash?"""
    return objects.withColumn("intact", F.sha2(F.col("content").cast("binary"), 256) == F.col("shipped_hash"))


def to_json_lines(df: DataFrame, stamp: Column | None = None) -> DataFrame:
    """One JSON text for each row (``value``), with bucket_start stamped on if given."""
    if stamp is not None:
        df = df.withColumn("bucket_start", stamp)
    return df.select(F.to_json(F.struct("*")).alias("value"))
