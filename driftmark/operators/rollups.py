"""Rollups of outcomes, journals and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.text import ancestors
from driftmark.functions.times import duration_text, size_text

DECISIONS = ("shipped", "unchanged", "skipped", "parked", "failed")


def health(outcomes: DataFrame) -> DataFrame:
    """By source: files by decision, and the mean of the densities above 0. outcomes: source_id, decision, density."""
    counts = [F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS]
    return outcomes.groupBy("source_id").agg(*counts, F.avg(F.when(F.col("density") > 0, F.col("density"))).alias("density"))


def survey(files: DataFrame) -> DataFrame:
    """By family and repository: bytes, last use, pending files, all_marked, markers; and by family with repository null.

    files: family, repo, size, mtime, pending, marker (null: none).
    """
    aggs = [F.sum("size").alias("bytes"), F.max("mtime").alias("last_used"), F.count_if("pending").alias("pending"), F.bool_and(F.col("marker").isNotNull()).alias("all_marked"), F.array_sort(F.collect_set("marker")).alias("markers")]
    return files.rollup("family", "repo").agg(*aggs, F.grouping("repo").alias("_whole"), F.grouping("family").alias("_all")).where("_all = 0").withColumn("is_total", F.col("_whole") == 1).drop("_whole", "_all")


def survey_order(repos: DataFrame) -> DataFrame:
    """Rank of each repository in its family: last-used day falling, then bytes falling, then name."""
    w = Window.partitionBy("family").orderBy(F.desc(F.to_date("last_used")), F.desc("bytes"), "repo")
    return repos.withColumn("rank", F.row_number().over(w))


def streaks(events: DataFrame, key: str, order: list[str], success: Column, counted: Column) -> DataFrame:
    """By key: counted failures since the last success. No key's rows are sorted, or meet in one task."""
    place = F.struct(*order)
    last = events.groupBy(key).agg(F.max(F.when(success, place)).alias("_last"))
    since = events.join(last, key).where(F.coalesce(place > F.col("_last"), F.lit(True)) & ~success)
    found = since.groupBy(key).agg(F.count_if(counted).alias("streak"))
    return last.select(key).join(found, key, "left").select(key, F.coalesce("streak", F.lit(0).cast("long")).alias("streak"))


def latest(events: DataFrame, key: str, order: list[str], n: int = 20) -> DataFrame:
    """The last ``n`` rows of each key, numbered from the newest."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("age_rank", F.row_number().over(w)).where(F.col("age_rank") <= n)


def crash_runs(journal: DataFrame) -> DataFrame:
    """Runs of a journal (run_id, seq, phase, kind: start, phase, exit or reported) with last phase, clean, reported, since_report.

    since_report says that no later run, nor this one, was reported; its runs that aren't clean are the crashes to tell.
    """
    runs = journal.groupBy("run_id").agg(F.min("seq").alias("began"), F.max_by("phase", "seq").alias("last_phase"), F.bool_or(F.col("kind") == "exit").alias("clean"), F.bool_or(F.col("kind") == "reported").alias("reported"))
    last = runs.agg(F.max(F.when(F.col("reported"), F.col("began"))).alias("_reported"))
    return runs.crossJoin(F.broadcast(last)).withColumn("since_report", F.coalesce(F.col("began") > F.col("_reported"), F.lit(True))).drop("_reported")


def spread_sample(rows: DataFrame, key: str, order: list[str], n: int = 5) -> DataFrame:
    """Up to ``n`` rows of each key, evenly spread along the order, both ends kept."""
    by = Window.partitionBy(key)
    place, many = F.row_number().over(by.orderBy(*order)) - 1, F.count(F.lit(1)).over(by)
    df = rows.withColumn("_k", place).withColumn("_n", many)
    wanted = F.transform(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_n").cast("int")) - 1), lambda i: F.when(F.col("_n") <= n, i.cast("long")).when(F.lit(n) == 1, F.lit(0).cast("long")).otherwise(F.floor(i * (F.col("_n") - 1) / max(1, n - 1))))
    return df.where(F.array_contains(wanted, F.col("_k").cast("long"))).drop("_k", "_n")


def buckets(observations: DataFrame, ts: str = "ts", minutes: int = 15) -> DataFrame:
    """Rows with the UTC start of their tumbling bucket, for lengths that divide a day."""
    return observations.withColumn("bucket_start", F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes")["start"])


def rule_summary(hits: Column) -> Column:
    """'rule 2, other 1' of a map, by rule."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(hits)), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))), ", ")


def attribute(files: DataFrame) -> DataFrame:
    """Working directory of each file: the first known of its project directory by path, else its own; base name as repo.

    files: root, project_dir, rel_path, cwd (null or '': unknown).
    """
    known = F.nullif(F.col("cwd"), F.lit(""))
    w = Window.partitionBy("root", "project_dir").orderBy("rel_path").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = F.when(F.col("project_dir") != "", F.first(known, ignorenulls=True).over(w))
    out = files.withColumn("attributed_cwd", F.coalesce(shared, known))
    return out.withColumn("repo", F.element_at(F.split("attributed_cwd", "/"), -1))


def nearest_marker(dirs: DataFrame, markers: DataFrame, stop: Column | None = None) -> DataFrame:
    """Each directory (dir) with the deepest marked ancestor, itself included (null: none). markers: dir."""
    up = dirs.select("dir").distinct().withColumn("_up", F.explode(ancestors(F.col("dir"))))
    if stop is not None:
        up = up.where(F.length("_up") >= F.length(stop))
    found = up.join(markers.select(F.col("dir").alias("_up")).distinct(), "_up").groupBy("dir").agg(F.max_by("_up", F.length("_up")).alias("marker"))
    return dirs.join(found, "dir", "left")


def tracked(rows: DataFrame, markers: DataFrame, stop: Column | None = None) -> DataFrame:
    """Rows (dir) whose directory has no marked ancestor, itself included; rows without a directory stay. markers: dir."""
    marked = nearest_marker(rows.select("dir").distinct(), markers, stop).where(F.col("marker").isNotNull()).select("dir")
    return rows.join(marked, "dir", "left_anti")


def repository_dirs(dirs: DataFrame, checkouts: DataFrame, home: str) -> DataFrame:
    """Each directory (dir) with ``repo_dir``: the main working tree of the checkout it lies in, else the directory itself.

    checkouts: root (a directory with a ``.git`` entry), common (the repository's own directory; null where the entry leads
    nowhere). The nearest root counts, below the home directory only: one at or above it would claim everything. A
    linked working tree folds into the main one; of a bare repository the directory itself stays.
    """
    up = dirs.select("dir").distinct().withColumn("root", F.explode(ancestors(F.col("dir"))))
    # what lies at or above home is cut off; a directory that isn't below home is walked to the top
    up = up.where(~((F.col("root") == home) | F.startswith(F.lit(home), F.concat(F.rtrim("root", F.lit("/")), F.lit("/"))) & F.startswith("dir", F.lit(home + "/"))))
    near = up.join(checkouts.select("root", "common").distinct(), "root").groupBy("dir").agg(F.max_by("common", F.length("root")).alias("common"))
    main = F.when(F.col("common").endswith("/.git"), F.regexp_replace("common", "/[.]git$", ""))
    return dirs.join(near, "dir", "left").withColumn("repo_dir", F.coalesce(F.nullif(main, F.lit("")), "dir")).drop("common")


def heartbeat(health: DataFrame, install: str) -> DataFrame:
    """One row for an installation: ``body``, JSON of its sources by name (their number is bounded), and ``source_hash``, the body's SHA-256."""
    sources = F.array_sort(F.collect_list(F.struct("source_id", *[c for c in health.columns if c != "source_id"])))
    body = health.agg(F.to_json(F.struct(F.lit(install).alias("install"), sources.alias("sources"))).alias("body"))
    return body.withColumn("source_hash", F.sha2("body", 256))


def heartbeat_sources(beats: DataFrame) -> DataFrame:
    """Sources of heartbeats (body), one row each; a body that is no such JSON gives none."""
    counts = ", ".join(f"{d} bigint" for d in DECISIONS)
    read = F.from_json("body", f"install string, sources array<struct<source_id string, {counts}, density double>>")
    return beats.select(read.alias("_b")).select("_b.install", F.explode("_b.sources").alias("_s")).select("install", "_s.*")


def issues(rows: DataFrame, key: list[str]) -> DataFrame:
    """By key: ``fails``, and ``issues``, the texts of failed rows and of warnings that aren't rollups, in order.

    rows: place, severity (ok, warn, fail), brief (null or empty: the label counts), label, is_rollup.
    """
    told = (F.col("severity") == "fail") | ((F.col("severity") == "warn") & ~F.col("is_rollup"))
    what = F.coalesce(F.nullif("brief", F.lit("")), F.btrim("label"))
    listed = F.array_sort(F.collect_list(F.when(told, F.struct("place", what.alias("what")))))
    return rows.groupBy(*key).agg(F.count_if(F.col("severity") == "fail").alias("fails"), F.transform(listed, lambda x: x["what"]).alias("issues"))


def merged_exemptions(base: Column, more: Column) -> Column:
    """Union of two maps of name lists: names of the base in their order, then new ones."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(base, more, lambda k, a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def throughput_line(sealed: Column, read: Column, ms: Column, median: Column) -> Column:
    """What a run sent, of what it read, in how long; empty if it read nothing or hasn't ended."""
    rate = F.when(ms > 0, F.concat(size_text(F.floor(read / (ms / 1000.0))), F.lit("/s")))
    notes = F.concat_ws(", ", rate, F.when(median > 0, F.concat(F.lit("median file "), size_text(median))))
    line = F.concat(F.lit("  sent  "), size_text(sealed), F.lit(" sealed of "), size_text(read), F.lit(" read in "), duration_text(ms))
    return F.when(ms.isNull() | (read == 0), "").when(notes == "", line).otherwise(F.concat(line, F.lit("  ("), notes, F.lit(")")))
