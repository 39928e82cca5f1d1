"""A walk of directory trees that executors can open, and a loader for the files it finds.

A round is one job: each task lists the directories it got and what lies below them, as far as a budget goes, and hands
the rest on to the next round, where they are dealt out anew. Denied trees are pruned before they are listed. Links below the root are never followed, the root itself may be one. What can't be read is a row of its own, so
"all was seen" is something that a caller can ask.
"""

from __future__ import annotations

import errno
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions.text import in_tree, matches_any

#: kind: file, dir, link, other (none of these) or unreadable; path is under the root as it was given, resolved without links.
ENTRIES = "source_root string, path string, resolved string, kind string, size long, mtime_ns long, error string"
#: Directories that a task is given, and that it lists below them, about.
DIRS_PER_TASK = 256


def _kind(mode: int) -> str:
    return "link" if stat.S_ISLNK(mode) else "dir" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "other"


def _shut(path: str, trees: list[str]) -> bool:
    return any(path == t or path.startswith(t + "/") for t in trees)


def _lister(trees: list[str], budget: int):
    """Arrow map from directories (source_root, path, resolved) to what lies below them, as far as a budget of directories goes.

    What is left to list comes out as kind ``frontier`` beside its own row. A directory that can't be listed gives one row that says so.
    """
    names = [f.split()[0] for f in ENTRIES.split(", ")]
    types = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()]

    def one(root: str, path: str, resolved: str) -> list[tuple]:
        rows = []
        try:
            with os.scandir(path) as entries:
                for e in entries:
                    at = (root, os.path.join(path, e.name), os.path.join(resolved, e.name))
                    try:
                        s = e.stat(follow_symlinks=False)
                    except OSError as x:
                        rows.append((*at, "unreadable", None, None, str(x)))
                        continue
                    kind = _kind(s.st_mode)
                    if kind != "dir" or not (_shut(at[1], trees) or _shut(at[2], trees)):
                        rows.append((*at, kind, s.st_size, s.st_mtime_ns, None))
        except OSError as x:
            rows.append((root, path, resolved, "unreadable", None, None, str(x)))
        return rows

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = budget
        for batch in batches:
            todo = list(zip(*[batch.column(c).to_pylist() for c in ("source_root", "path", "resolved")], strict=True))
            given = len(todo)
            while todo:
                place = todo.pop()
                own = len(todo) < given  # what was handed in is always listed
                given = min(given, len(todo))
                if left <= 0 and not own:
                    rows = [(*place, "frontier", None, None, None)]
                else:
                    left -= 1
                    rows = one(*place)
                    todo += [r[:3] for r in rows if r[3] == "dir"]
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return listed


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = batch.column("source_root").to_pylist()
        there = [os.path.lexists(r) for r in roots]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((roots, pa.string()), (roots, pa.string()), ([os.path.realpath(r) for r in roots], pa.string()), (there, pa.bool_()))], ["source_root", "path", "resolved", "there"])


def first_root(spark: SparkSession, roots: list[str], require_subdir: str = "") -> str | None:
    """The first of a source's possible roots that is there, with the folder it must have; asked where the files are, not on the driver."""

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([os.path.isdir(os.path.join(r, require_subdir)) for r in batch.column("root").to_pylist()], pa.bool_()))

    rows = spark.createDataFrame(list(enumerate(roots)), "place int, root string").coalesce(1).mapInArrow(there, "place int, root string")
    found = rows.orderBy("place").first()
    return found and found["root"]


def denied(path: Column, deny: list[str]) -> Column:
    """Does a pattern match the path, or is it the root of a ``<root>/**`` pattern or below it?"""
    return matches_any(F.ltrim(path, F.lit("/")), deny) | in_tree(path, deny)


def walk(spark: SparkSession, roots: list[str], scratch: str, deny: list[str] = (), most_levels: int = 1_000) -> DataFrame:
    """All entries below the roots (ENTRIES), from a table below ``scratch`` that the caller deletes.

    A directory in a denied tree, by its own or its resolved path, is neither listed nor returned. A root that isn't there has
    no rows; one that resolves into a denied tree, or can't be listed, has one of kind unreadable. Roots are absolute paths.
    """
    deny = list(deny)
    place = f"{scratch}/walk"
    keep = ["source_root", "path", "resolved"]
    first = spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "source_root string").mapInArrow(_rooted, "source_root string, path string, resolved string, there boolean")
    closed = denied(F.col("resolved"), deny) | denied(F.col("path"), deny)
    found = first.where("there").select(*keep, closed.alias("closed")).collect()  # as many as roots were given
    refused = [(*r[:3], "unreadable", None, None, "the deny list refuses it") for r in found if r["closed"]]
    opened = [tuple(r[:3]) for r in found if not r["closed"]]
    frontier, count, levels = spark.createDataFrame(opened, "source_root string, path string, resolved string"), len(opened), 0
    trees = [p[:-3] for p in deny if p.endswith("/**")]
    while count:
        levels += 1
        if levels > most_levels:
            raise ValueError(f"a tree of more than {most_levels} rounds")
        tasks = -(-count // DIRS_PER_TASK)
        found = frontier.repartition(tasks, "path").mapInArrow(_lister(trees, DIRS_PER_TASK), ENTRIES)
        found.write.parquet(f"{place}/level={levels}")
        frontier = spark.read.schema(ENTRIES).parquet(f"{place}/level={levels}").where("kind = 'frontier'").select(*keep)
        count = frontier.count()
    entries = spark.createDataFrame(refused, ENTRIES)
    if levels:
        entries = entries.unionByName(spark.read.schema(ENTRIES).parquet(*[f"{place}/level={k}" for k in range(1, levels + 1)]))
    return entries.where("kind <> 'frontier'")


def candidates(entries: DataFrame, include: list[str], exclude: list[str] = (), deny: list[str] = (), max_bytes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, oversize files, unreadable paths) of a walk's entries; only regular files count.

    Globs are of the path below the root; a file is denied if its own or its resolved path is.
    """
    rel = F.when(F.col("source_root") == "/", F.ltrim("path", F.lit("/"))).otherwise(F.expr("substr(path, length(source_root) + 2)"))
    files = entries.where("kind = 'file'").withColumn("rel_path", rel)
    wanted = matches_any(F.col("rel_path"), list(include)) & ~matches_any(F.col("rel_path"), list(exclude))
    files = files.where(wanted & ~denied(F.col("path"), list(deny)) & ~denied(F.col("resolved"), list(deny))).select("source_root", "path", "rel_path", "size", "mtime_ns")
    large = F.lit(False) if max_bytes is None else F.col("size") > max_bytes
    return files.where(~large), files.where(large), entries.where("kind = 'unreadable'").select("path", "error")


def _open(path: str, most: int | None) -> bytes:
    handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    with os.fdopen(handle, "rb") as f:
        if not stat.S_ISREG(os.fstat(handle).st_mode):
            raise OSError(errno.EINVAL, "not a regular file")
        body = f.read() if most is None else f.read(most + 1)
    if most is not None and len(body) > most:
        raise OSError(errno.EFBIG, f"over {most} bytes")
    return body


def load(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The rows of ``files`` (path, …) with content and error: whole files, no links, none over the limit; a batch is one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                try:
                    body, why = _open(path, max_bytes), None
                except OSError as e:
                    body, why = None, str(e)
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([body], pa.binary()), pa.array([why], pa.string())], [*batch.schema.names, "content", "load_error"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{kept}, content binary, load_error string")


def complete(found: DataFrame, unreadable: DataFrame) -> bool:
    """May what isn't among the candidates be taken for gone? Only if there are some and nothing was left unseen."""
    return bool(found.limit(1).count()) and not unreadable.limit(1).count()
