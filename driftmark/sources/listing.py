"""File sources: a listing with globs and denials, heads of files, shapes, contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions.text import matches_any, project_dir

HEAD_BYTES = 64 << 10
ZSTD_MAGIC, SQLITE_MAGIC = "28B52FFD", "53514C69746520666F726D6174203300"


def files(spark: SparkSession, root: str) -> DataFrame:
    """All files below a root with content; Spark reads contents only where a later step asks for them.

    A file that goes or can't be read once it is listed gives no row where its content is asked for.
    """
    df = spark.read.format("binaryFile").options(recursiveFileLookup="true", ignoreMissingFiles="true", ignoreCorruptFiles="true").load(root)
    prefix = "^(?:file:)?/*" + root.replace("file:", "").strip("/") + "/"
    return df.select("path", F.regexp_replace("path", prefix, "").alias("rel_path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime_us"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")


def select_files(listing: DataFrame, include: list[str], exclude: list[str] = (), deny: list[str] = (), max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, oversize files) of a listing, in no order."""
    path = F.col("rel_path")
    wanted = matches_any(path, include) & ~matches_any(path, list(exclude)) & ~matches_any(F.regexp_replace("path", "^file:/*", ""), list(deny))
    found = listing.where(wanted)
    if max_bytes is None:
        return found, found.limit(0)
    return found.where(F.col("size") <= max_bytes), found.where(F.col("size") > max_bytes)


def contradictions(spark: SparkSession, includes: list[str], deny: list[str]) -> DataFrame:
    """Include globs that a denial swallows whole: their literal beginnings match it."""
    rows = spark.createDataFrame([(p, p.lstrip("/").split("*")[0]) for p in includes], "include string, prefix string")
    return rows.where(matches_any(F.concat("prefix", F.lit("x")), deny)).select("include")


def head(content: Column = None, n: int = HEAD_BYTES) -> Column:
    return F.substring(F.col("content") if content is None else content, 1, n)


def shape(head_bytes: Column, kind: str, truncated: Column) -> Column:
    """Has the head of a file the shape jsonl, json, sqlite, zstd or text? A cut-off first line of JSON lines passes.

    NUL bytes condemn text shapes; a line must be a JSON object.
    """
    if kind in ("zstd", "sqlite"):
        magic = ZSTD_MAGIC if kind == "zstd" else SQLITE_MAGIC
        return F.coalesce(F.startswith(F.hex(head_bytes), F.lit(magic)), F.lit(False))
    text = F.make_valid_utf8(head_bytes.cast("string"))
    clean = F.coalesce(F.locate("\0", text) == 0, F.lit(False))
    if kind == "text":
        return clean
    is_object = lambda t: F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False))
    if kind == "json":
        return clean & (truncated | is_object(text))
    first = F.coalesce(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0)), F.lit(""))
    whole = F.locate("\n", text) > 0
    return clean & ((truncated & ~whole) | is_object(first))


def first_field(head_text: Column, paths: list[str], lines: int = 16) -> Column:
    """The first non-empty string among JSON paths in the first non-blank lines of a head; null if there is none."""
    some = F.slice(F.filter(F.split(head_text, "\n"), lambda x: F.trim(x) != ""), 1, lines)
    found = F.flatten(F.transform(some, lambda x: F.array(*[F.get_json_object(x, "$." + p) for p in paths])))
    return F.get(F.filter(found, lambda v: v.isNotNull() & (v != "")), F.lit(0))


#: Fields that name the version of what wrote a record, at its top or below ``payload``.
VERSION_FIELDS = ("version", "cli_version", "payload.version", "payload.cli_version")


def producer_version(head_text: Column) -> Column:
    """The version of what wrote a file: of its first lines, the first field that names one."""
    return first_field(head_text, list(VERSION_FIELDS))


def project_map(candidates: DataFrame, paths: list[str], remotes: DataFrame) -> DataFrame:
    """One row for each project directory: the working directory its newest file names, and its git remote (cwd, remote)."""
    probed = candidates.select(project_dir(F.col("rel_path")).alias("project_dir"), "mtime_ns", first_field(F.make_valid_utf8(head().cast("string")), paths).alias("cwd")).where("project_dir <> ''")
    return probed.groupBy("project_dir").agg(F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("mtime_ns"))).alias("cwd")).join(remotes, "cwd", "left").select("project_dir", "cwd", "remote")


def source_health(samples: DataFrame) -> DataFrame:
    """By source: condemned only if every sampled file fails; version from the newest readable one. samples: source_id, ok, version, mtime_ns."""
    return samples.groupBy("source_id").agg(F.bool_and(~F.col("ok")).alias("condemned"), F.max_by("version", F.when(F.col("ok"), F.col("mtime_ns"))).alias("version"), F.count(F.lit(1)).alias("sampled"))
