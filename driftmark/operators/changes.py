"""Change detection: a listing against the state of what was shipped before.

State is one row for each (source_id, native_path). A candidate is skipped, unchanged, parked or shipped by a
CASE over the left join of the two; size and time are a pre-filter, the content hash decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions.checks import backoff_seconds

KEY = ["source_id", "native_path"]
STATE = "source_id string, native_path string, source_size long, source_mtime_ns long, source_hash string, output_hash string, parked boolean, attempts int, backoff_until timestamp, last_error string"


def drop_changed_specs(state: DataFrame, known: DataFrame, now: DataFrame) -> DataFrame:
    """State without the rows of sources whose spec hash changed; a source without a known hash adopts the new one.

    known, now: source_id, spec_hash.
    """
    changed = known.alias("k").join(now.alias("n"), "source_id").where(F.col("k.spec_hash") != F.col("n.spec_hash")).select("source_id")
    return state.join(changed, "source_id", "left_anti")


def foreign(owner: Column, install: Column) -> Column:
    """Did another installation write a state? One without an owner belongs to whoever opens it."""
    return F.coalesce((owner != "") & (install != "") & (owner != install), F.lit(False))


def in_order(state: DataFrame) -> DataFrame:
    """State by source and path, as it is listed."""
    return state.orderBy(*KEY)


def pending(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Candidates with ``pending``: never shipped, or of another size or time; the content isn't looked at."""
    old = state.select(*KEY, F.col("source_size").alias("_size"), F.col("source_mtime_ns").alias("_mtime"))
    new = ~(F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ns").eqNullSafe(F.col("_mtime")))
    return candidates.join(old, KEY, "left").withColumn("pending", new).drop("_size", "_mtime")


def decide(candidates: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Candidates (size, mtime_ns, content_hash) with ``decision``: shipped, unchanged or parked, and whether the file shrank."""
    old = state.select(*KEY, *[F.col(c).alias("_" + c) for c in ("source_size", "source_mtime_ns", "source_hash", "parked", "backoff_until", "attempts")])
    df = candidates.join(old, KEY, "left")
    waits = F.coalesce(F.col("_parked"), F.lit(False)) & (F.col("_backoff_until") > now)
    touched = ~(F.col("size").eqNullSafe(F.col("_source_size")) & F.col("mtime_ns").eqNullSafe(F.col("_source_mtime_ns")))
    same = ~F.coalesce(F.col("_parked"), F.lit(False)) & (~touched | F.col("content_hash").eqNullSafe(F.col("_source_hash")))
    decision = F.when(waits, "parked").when(F.col("_source_hash").isNotNull() & same, "unchanged").otherwise("shipped")
    out = df.withColumn("decision", decision).withColumn("shrank", F.coalesce(F.col("size") < F.col("_source_size"), F.lit(False)))
    return out.withColumn("attempts", F.coalesce("_attempts", F.lit(0))).drop(*[c for c in old.columns if c not in KEY])


def budgeted(decided: DataFrame, limit: int) -> DataFrame:
    """Add ``admitted``: the first ``limit`` rows that are to be shipped, by source and oldest first; the others cost no budget and pass.

    Each task keeps its own first ``limit`` rows, so nothing is sorted as a whole; the chosen keys, ``limit`` at most, are broadcast.
    """
    ship = F.col("decision") == "shipped"
    order = ["source_id", "mtime_ns", "rel_path", "native_path"]
    first = decided.where(ship).select(*order).orderBy(*order).limit(limit).select(*KEY, F.lit(True).alias("_in"))
    return decided.join(F.broadcast(first), KEY, "left").withColumn("admitted", ~ship | F.col("_in").isNotNull()).drop("_in")


def to_look_at(candidates: DataFrame, state: DataFrame, now: Column, recompute_seconds: int = 0) -> DataFrame:
    """Candidates with ``look`` and ``waits``, by size and time alone: is the content to be read, or a parked file's time not yet up?

    With recompute_seconds, files that changed so lately are looked at although nothing changed, as what they are joined with may have.
    """
    old = state.select(*KEY, *[F.col(c).alias("_" + c) for c in ("source_size", "source_mtime_ns", "source_hash", "parked", "backoff_until")])
    df = candidates.join(old, KEY, "left")
    waits = F.coalesce(F.col("_parked") & (F.col("_backoff_until") > now), F.lit(False))
    same = F.col("size").eqNullSafe(F.col("_source_size")) & F.col("mtime_ns").eqNullSafe(F.col("_source_mtime_ns")) & F.col("_source_hash").isNotNull()
    late = F.unix_micros(now) / 1e6 - F.col("mtime_ns") / 1e9 < float(recompute_seconds)
    return df.withColumn("waits", waits).withColumn("look", ~waits & (~same | late)).drop(*[c for c in old.columns if c not in KEY])


def new_rows(outcomes: DataFrame, now: Column) -> DataFrame:
    """The state's rows that a run changes. outcomes: KEY, size, mtime_ns, content_hash, output_hash, decision, reason, attempts.

    What shipped has its hashes; what failed is parked until its time; a file that was read and is unchanged keeps its
    hashes under its new size and time, and whatever parked it is over. Other decisions leave their rows as they are.
    """
    failed = F.col("decision") == "failed"
    tries = F.when(failed, F.col("attempts") + 1).otherwise(0).cast("int")
    spread = F.pmod(F.xxhash64(*KEY), F.lit(9))
    until = F.when(failed, F.timestamp_seconds(F.unix_micros(now) / 1e6 + backoff_seconds(tries, spread)))
    return outcomes.where(F.col("decision").isin("shipped", "failed", "unchanged")).select(
        *KEY, F.col("size").alias("source_size"), F.col("mtime_ns").alias("source_mtime_ns"), F.when(~failed, F.col("content_hash")).alias("source_hash"), F.when(~failed, F.col("output_hash")).alias("output_hash"),
        failed.alias("parked"), tries.alias("attempts"), until.alias("backoff_until"), F.when(failed, F.col("reason")).alias("last_error"),
    )


def upsert(state: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """State after a run; see new_rows."""
    new = new_rows(outcomes, now)
    return state.join(new.select(KEY), KEY, "left_anti").unionByName(new)


def drop_vanished(state: DataFrame, live: DataFrame, complete: DataFrame) -> DataFrame:
    """State without paths that fully collected sources no longer list. live: KEY; complete: source_id."""
    gone = state.join(complete.select("source_id").distinct(), "source_id", "left_semi").join(live.select(KEY), KEY, "left_anti").select(KEY)
    return state.join(gone, KEY, "left_anti")


def batches(staged: DataFrame, order: str, size: str, key: str, most_rows: int = 32, most_bytes: int = 64 << 20) -> DataFrame:
    """Number the upload groups of each ``key`` (``batch``): a group closes before it would pass ``most_rows`` or ``most_bytes``.

    A running sum can't reset, so rows go by key to sorted partitions, and one pass carries the open group's counters:
    a key of any size needs no memory. Null sizes count as 0.
    """
    rows = staged.select(key, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    kinds = dict(rows.dtypes)

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, n, held = (), 0, 0, 0
        for b in parts:
            out = []
            for k, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (k,) != at:
                    at, group, n, held = (k,), 0, 0, 0
                if n and (n >= most_rows or held + s > most_bytes):
                    group, n, held = group + 1, 0, 0
                n, held = n + 1, held + s
                out.append(group)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], [key, order, "batch"])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(number, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, batch int")
