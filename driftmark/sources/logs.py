"""Append-only logs in generations: what is asked about the end of a log reads its end.

A log is a folder of generations, each a Parquet table of appends. An append goes to the newest one until that is large
enough, then a new one begins; old ones can be dropped. Rows know the append they came with, so "the last n" and "failures
since the last success" go back generation by generation and stop as soon as they know enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.sources.tables import _hadoop

#: Bytes of a generation after which the next append begins another.
MOST_BYTES = 8 << 20
_NAME = re.compile(r"generation-(\d{8})$")
#: Number of the append that a row came with.
APPEND = "append_no"


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the log's generations, ascending."""
    place, fs = _hadoop(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(m[1]) for m in map(_NAME.match, names) if m)


def _folder(path: str, number: int) -> str:
    return f"{path}/generation-{number:08d}"


def _appends(spark: SparkSession, folder: str) -> list[int]:
    place, fs = _hadoop(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(APPEND + "="))


def append(rows: DataFrame, path: str, most_bytes: int = MOST_BYTES, keep: int | None = None) -> None:
    """Append rows; with ``keep``, generations before the last so many go when a new one begins.

    One writer at a time: an append is a folder of its own, visible as a whole once it is written.
    """
    spark = rows.sparkSession
    known = generations(spark, path)
    current = known[-1] if known else 1
    place, fs = _hadoop(spark, _folder(path, current))
    if known and fs.getContentSummary(place).getLength() >= most_bytes:
        current += 1
        for old in [n for n in known if keep is not None and n <= current - keep]:
            fs.delete(_hadoop(spark, _folder(path, old))[0], True)
    last = max([0, *(n for g in generations(spark, path) for n in _appends(spark, _folder(path, g)))])
    fresh = f"{path}/fresh-{last + 1}"
    rows.write.mode("overwrite").parquet(fresh)
    fs.mkdirs(_hadoop(spark, _folder(path, current))[0])
    if not fs.rename(_hadoop(spark, fresh)[0], _hadoop(spark, f"{_folder(path, current)}/{APPEND}={last + 1}")[0]):
        raise OSError(f"append {last + 1} of the log is there already")


def backwards(spark: SparkSession, path: str) -> Iterator[DataFrame]:
    """The generations' rows, with APPEND, newest first; each is read only when it is asked for."""
    for number in reversed(generations(spark, path)):
        if _appends(spark, _folder(path, number)):
            yield spark.read.parquet(_folder(path, number))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a log with APPEND."""
    every = spark.createDataFrame([], f"{schema}, {APPEND} int")
    for part in backwards(spark, path):
        every = every.unionByName(part)
    return every


def read_last(spark: SparkSession, path: str, n: int, order: list[Column], schema: str) -> DataFrame:
    """The last ``n`` rows of a log, by append and then by ``order`` (both from the newest), out of the newest generations that hold so many."""
    found, held = spark.createDataFrame([], f"{schema}, {APPEND} int"), 0
    for part in backwards(spark, path):
        found, held = found.unionByName(part), held + part.count()  # counts come from the files' footers
        if held >= n:
            break
    return found.orderBy(F.desc(APPEND), *order).limit(n)


def failing(spark: SparkSession, path: str, key: str, ok: Column, order: list[str], schema: str) -> DataFrame:
    """(key, failures, since): for each key that fails, its failures since its last success and the first of them.

    order: columns by which rows of one append come one after the other. Goes back until every key that still fails has had
    a success, so a log of old successes isn't read.
    """
    place = F.struct(APPEND, *order)
    found = spark.createDataFrame([], f"{schema}, {APPEND} int")
    for part in backwards(spark, path):
        found = found.unionByName(part)
        last = found.groupBy(key).agg(F.max(F.when(ok, place)).alias("_ok"))
        if not last.where("_ok IS NULL").limit(1).count():
            break
    last = found.groupBy(key).agg(F.max(F.when(ok, place)).alias("_ok"))
    since = found.where(~ok).join(last, key).where(F.col("_ok").isNull() | (place > F.col("_ok")))
    return since.groupBy(key).agg(F.count(F.lit(1)).alias("failures"), F.min_by(order[0], place).alias("since"))
