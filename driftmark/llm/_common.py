"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java class of the six ASCII white-space characters that end a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Most rows, and most bytes of them in columns, that are broadcast; beyond either the same join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20
#: Bytes of an Arrow batch of texts, about; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20
#: Bytes of a row group of written tables, which each writing task holds until it is full.
ROW_GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder; on a cluster that is an error,
    since each machine would write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="driftmark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/driftmark/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Later stages restart from this table after a lost executor, and each reader of
    it starts from columns instead of recomputing what came before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row of ``df`` as Spark estimates them from the types; a text counts as a digest in hex."""
    width = {"boolean": 1, "int": 4, "float": 4, "string": 64, "binary": 64}
    return 8 + sum(width.get(kind, 8) for _, kind in df.dtypes)


def key_join(big: DataFrame, keys: DataFrame, on: list[str] | str | Column, how: str, rows: int | None = None) -> DataFrame:
    """Join ``big`` with a materialized ``keys``: broadcast below BROADCAST_ROWS counted rows and BROADCAST_BYTES, else shuffled."""
    rows = keys.count() if rows is None else rows
    small = rows <= BROADCAST_ROWS and rows * row_bytes(keys) <= BROADCAST_BYTES
    return big.join(F.broadcast(keys) if small else keys, on, how)


#: Copies of a row that a task deals out at a time.
COPIES = 10_000


def with_copies(rows: DataFrame, label: str, copies: int = COPIES) -> DataFrame:
    """Rows with ``_copy``, which numbers equal ones from 0: of a row that is there n times, each number below n once.

    Equal rows are counted, which happens mostly before they are shuffled, and dealt out again, some at a time; so no task meets
    all copies of a row, and the result doesn't depend on where the rows lay.
    """
    counted = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies")), label)
    lone, more = counted.where("_copies = 1"), counted.where("_copies > 1")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(copies).cast("long"))).alias("_from")
    more = more.select("*", part).repartition(F.xxhash64(*rows.columns, "_from"))
    copy = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + copies, F.col("_copies")) - 1))
    return lone.withColumn("_copy", F.lit(0).cast("long")).unionByName(more.withColumn("_copy", copy).drop("_from")).drop("_copies")


def numbered(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """Rows with ``_copy``, their number from 0 among those of one key; a key's rows are numbered where they lie, never in one task."""
    placed = materialize(rows.withColumn("_part", F.spark_partition_id()), label)
    counts = placed.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_n")
    offsets = materialize(counts.withColumn("_before", before).drop("_n"), label)
    same = placed["_part"] == offsets["_part"]
    for k in key:
        same = same & placed[k].eqNullSafe(offsets[k])
    own = F.row_number().over(Window.partitionBy(*[placed[k] for k in key], placed["_part"]).orderBy(F.lit(0))) - 1
    joined = placed.join(offsets, same).withColumn("_copy", own + F.col("_before"))
    return joined.select(*[placed[c] for c in rows.columns], "_copy")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``, so that lambdas in it don't evaluate it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of a text (null or blank: empty array)."""
    blanks = F.coalesce(text, F.lit(""))
    for c in SPACE_CHARS[1:]:  # plain replacements and a one-character split are far cheaper than a pattern
        blanks = F.replace(blanks, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(blanks, " "), "")


def word_count(text: Column) -> Column:
    """Number of words of a text, as a long (null: 0)."""
    return F.size(words_of(text)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for documents that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """While it is open, Arrow batches of texts hold BATCH_BYTES at most; the session's own setting comes back after it.

    It holds for what runs inside, so only for results that are written there.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def worker_cache() -> dict:
    """What a Python worker keeps from task to task (it is reused, while functions arrive anew with each task)."""
    return sys.modules.setdefault("_driftmark_worker", types.ModuleType("_driftmark_worker")).__dict__.setdefault("kept", {})
