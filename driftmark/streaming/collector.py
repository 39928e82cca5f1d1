"""The collector as restartable micro-batches.

Each tick lists the source anew and compares it with committed state, since a file stream never shows
a changed file again. A rate stream is the clock; ``foreachBatch`` ships what changed, writes objects
under path-derived keys, then commits the rows of the state that changed, so a tick that dies is simply done again.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions.checks import mirror_name, spec_hash
from driftmark.functions.text import canonical_path
from driftmark.operators import changes, derived, manifests, redact
from driftmark.sources import listing, tables, walk

#: Seconds to the next run after one that its budget cut short.
CATCH_UP_SECONDS = 15.0


@dataclass
class Source:
    source_id: str
    family: str
    root: str
    include: list[str]
    exclude: list[str] = field(default_factory=list)
    max_bytes: int = 256 << 20
    jsonl: bool = True
    deny: list[str] = field(default_factory=list)
    artifact_class: str = "trajectory"
    roots: list[str] = field(default_factory=list)  # where the root may be, if not known yet; looked for before each tick
    require_subdir: str = ""

    def spec_hash(self) -> str:
        """Of what decides how bytes are read; if it changes, all ships anew."""
        return spec_hash({"root": self.roots or [self.root], "include": self.include, "exclude": self.exclude, "jsonl": [str(self.jsonl)]})

    def on_machine(self) -> bool:
        """Is the root a path that executors open themselves, not a store of Hadoop's?"""
        return self.root.startswith("/")


@dataclass
class Collector:
    spark: SparkSession
    source: Source
    state_path: str
    object_path: str
    name_key: bytes
    username: str = ""
    budget: int = 512
    pause: DataFrame | None = None  # until (string); see paused
    recompute_seconds: int = 0
    tick_seconds: float = 900.0
    delay: float = 900.0  # seconds to wait after the last tick
    install: str = ""  # the installation that the state belongs to
    organization: str = ""  # if set, manifests are checked, and what has a faulty one doesn't ship
    client: str = "1"
    store: Callable[[SparkSession], DataFrame] | None = None  # rows (key, value) of the store that transcripts are enriched from

    def tick(self, now: str | None = None) -> dict[str, int]:
        """One run: list, decide, redact, write objects, commit state. Returns files by decision.

        Size and time decide first, and the budget is taken of what is to be looked at, oldest first: no more contents are
        read than may ship. What turns out unchanged gives its share back and gets its new time written down. A file
        that can't be read or redacted is parked, the others go on. Paths that a finished run no longer lists are forgotten, but only
        if it listed others and could see everything: an empty or unreadable folder proves nothing.
        A source whose root isn't there yet is absent, and looked for again before the next run.
        With a store, transcripts that were looked at ship once more, enriched, if what is derived from them is new.
        """
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        if self.pause is not None and paused(self.pause, at):
            return {"paused": 1}
        src, spark = self.source, self.spark
        if src.roots:
            src.root = walk.first_root(spark, src.roots, src.require_subdir) or ""
            if not src.root:
                return {"absent": 1}
        note = tables.peek(spark, self.state_path).get("note", {})  # owner, and the spec hash of each source
        if note.get("owner") and self.install and note["owner"] != self.install:
            raise ValueError(f"the state belongs to installation {note['owner']}")
        specs = note.get("specs", {})
        before = tables.read_state(spark, self.state_path, changes.STATE)
        anew = specs.get(src.source_id, src.spec_hash()) != src.spec_hash()
        state = before.where(F.col("source_id") != src.source_id) if anew else before
        with tables.scratch(spark, self.state_path) as kept, tables.scratch_folder(spark, self.state_path) as folder:
            listed, seen_all = self._listed(folder)
            seen = kept(changes.to_look_at(listed, state, at, self.recompute_seconds))
            look, outcomes, counts, done = seen.where("look").drop("look", "waits"), None, Counter(), 0
            there, todo, waits = seen.agg(F.count(F.lit(1)), F.count_if("look"), F.count_if("waits")).first()
            left = self.budget
            while left and done < todo:
                rest = look if outcomes is None else look.join(outcomes.select("native_path"), "native_path", "left_anti")
                mine = kept(rest.orderBy("source_id", "mtime_ns", "rel_path", "native_path").limit(left))
                found = self._outcomes(mine, state, at, kept)
                outcomes = found if outcomes is None else outcomes.unionByName(found)
                rows = {r["decision"]: r["count"] for r in found.groupBy("decision").count().collect()}
                counts.update(rows)
                done, left = done + sum(rows.values()), left - rows.get("shipped", 0) - rows.get("failed", 0)
            new = changes.new_rows(outcomes, at) if outcomes is not None else before.limit(0)
            if self.store is not None and outcomes is not None:
                more = self._derived(look.join(outcomes.where("decision <> 'failed'").select("native_path"), "native_path", "left_semi"), state, kept)
                counts["enriched"] = more.count()
                new = new.unionByName(more, allowMissingColumns=True)
            gone = before.where((F.col("source_id") == src.source_id) & F.lit(anew)).select(*changes.KEY)
            if done >= todo and seen_all and there:
                live = seen.select(*changes.KEY)
                live = live.union(live.select("source_id", F.concat("native_path", F.lit(derived.SUFFIX))))
                gone = gone.union(state.where(F.col("source_id") == src.source_id).join(live, changes.KEY, "left_anti").select(*changes.KEY))
            now_known = {"owner": self.install or note.get("owner", ""), "specs": specs | {src.source_id: src.spec_hash()}}
            if outcomes is not None or now_known != note or gone.limit(1).count():  # rows and spec in one commit
                tables.commit_changes(new, gone, self.state_path, changes.KEY, note=now_known)
        if waits:
            counts["parked"] = waits
        self.delay = next_delay(done < todo, bool(counts["failed"]), counts["shipped"], self.tick_seconds)
        return {k: n for k, n in counts.items() if n}

    def _listed(self, folder: str) -> tuple[DataFrame, bool]:
        """Candidates (source_id, native_path, rel_path, path, size, mtime_ns), and whether everything could be seen."""
        src = self.source
        if src.on_machine():
            entries = walk.walk(self.spark, [src.root], folder, src.deny)
            found, _, unreadable = walk.candidates(entries, src.include, src.exclude, src.deny, src.max_bytes)
            seen_all = not unreadable.limit(1).count()
        else:
            found, _ = listing.select_files(listing.files(self.spark, src.root), src.include, src.exclude, src.deny, src.max_bytes)
            seen_all = True
        return found.select(F.lit(src.source_id).alias("source_id"), F.col("rel_path").alias("native_path"), "rel_path", "path", "size", "mtime_ns"), seen_all

    def _contents(self, mine: DataFrame) -> DataFrame:
        """(native_path, content, content_hash) of some files, one read each; content is null where a file can't be read."""
        src = self.source
        if src.on_machine():
            read = walk.load(mine.select("native_path", "path").repartition(max(1, self.spark.sparkContext.defaultParallelism), "native_path"), src.max_bytes)
        else:  # as many as the budget at most, so their paths may pass through the driver
            paths = {r["path"]: r["native_path"] for r in mine.select("path", "native_path").collect()}
            files = self.spark.read.format("binaryFile").options(ignoreMissingFiles="true", ignoreCorruptFiles="true").load(list(paths)) if paths else None
            read = mine.select("native_path", F.lit(None).cast("binary").alias("content")).limit(0) if files is None else files.select("path", "content").join(F.broadcast(mine.select("native_path", "path")), "path")
        return read.select("native_path", "content", F.sha2("content", 256).alias("content_hash"))

    def _redacted(self, texts: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Objects of (native_path, content_hash, text): key, source_id, native_path, content, manifest, error, new_hash, content_hash.

        The hash travels with the lines it belongs to, and so does their number: a payload whose lines come from two reads is broken.
        """
        src = self.source
        payloads = texts.select(F.lit(src.source_id).alias("source_id"), "native_path", "content_hash", F.lit(src.family).alias("family"), F.lit(src.jsonl).alias("jsonl"), F.col("text").alias("content"))
        payloads = payloads.withColumn("n_lines", F.greatest(F.lit(1), F.regexp_count("content", F.lit("\n")) + F.when(F.col("content").endswith("\n"), 0).otherwise(1)) if src.jsonl else F.lit(1))
        lines = redact.split_lines(payloads) if src.jsonl else payloads.withColumnRenamed("content", "body").withColumns({"line_no": F.lit(0), "ending": F.lit("")})
        done = redact.rebuild(redact.redact_lines(lines, self.username, keep_body=False), ["source_id", "native_path", "content_hash", "n_lines"])
        torn = F.when(F.col("lines") != F.col("n_lines"), F.lit("it changed while it was read"))
        objects = done.withColumn("error", F.coalesce("error", torn)).withColumn("key", mirror_name(self.name_key, canonical_path(F.col("native_path"), self.username)))
        is_derived = F.endswith("native_path", F.lit(derived.SUFFIX))
        enriched = lambda value: F.when(is_derived, value)
        manifest = manifests.assembled(
            organization_id=F.nullif(F.lit(self.organization), F.lit("")), install_id=F.nullif(F.lit(self.install), F.lit("")), source_id=F.lit(src.source_id), source_family=F.lit(src.family),
            native_path=F.replace("native_path", F.lit(self.username), F.lit("__USER__")) if len(self.username) > 1 else F.col("native_path"), gather=F.lit("file_glob"), artifact_class=F.lit(src.artifact_class),
            source_hash=F.col("content_hash"), shipped_hash=F.sha2("content", 256), payload_size=F.octet_length("content").cast("long"), shape_sniff=F.lit("ok"),
            redaction=F.struct("density", F.when(F.size("rule_hits") > 0, F.col("rule_hits")).alias("rule_hits"), "scan_mode"), client=F.struct(F.lit(self.client).alias("version")), sealed_at=manifests.instant(F.current_timestamp()),
            derived=enriched(F.lit(True)), enricher=enriched(F.struct(F.lit("ordered-join").alias("id"), F.lit(1).alias("version"))), derived_from=enriched(F.array("content_hash")), enrich_status=enriched(F.lit("ok")),
        )
        objects = objects.withColumn("manifest", manifest)
        if self.organization:
            objects = objects.withColumn("error", F.coalesce("error", manifests.refused(objects)))
        return kept(objects.select("key", "source_id", "native_path", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "manifest", "error", F.sha2("content", 256).alias("new_hash"), "content_hash"))

    def _outcomes(self, mine: DataFrame, state: DataFrame, at, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Read, hash and redact these files, write the objects of those that changed; one row for each with its decision.

        What ships is read for the second time, and the hash that counts is that of the bytes that ship.
        """
        hashed = mine.join(self._contents(mine).select("native_path", "content_hash"), "native_path", "left")
        decided = kept(changes.decide(hashed, state, at).withColumn("decision", F.when(F.col("content_hash").isNull(), "failed").otherwise(F.col("decision"))))
        ship = self._contents(decided.where("decision = 'shipped'").select("native_path", "path")).where("content IS NOT NULL")
        objects = self._redacted(ship.select("native_path", "content_hash", F.make_valid_utf8(F.col("content").cast("string")).alias("text")), kept)
        self._write(objects)
        made = objects.groupBy("native_path").agg(F.max("new_hash").alias("new_hash"), F.max("error").alias("error"), F.max("content_hash").alias("shipped_hash"))
        old = state.where(F.col("source_id") == self.source.source_id).select("native_path", "output_hash")
        out = decided.join(made, "native_path", "left").join(old, "native_path", "left")
        broken = F.col("error").isNotNull()
        out = out.withColumn("reason", F.when(F.col("content_hash").isNull(), "it can't be read").when(broken, F.when(F.startswith("error", F.lit("manifest: ")), F.col("error")).otherwise(F.concat(F.lit("redaction failed: "), F.col("error")))))
        out = out.withColumn("decision", F.when(broken, "failed").otherwise(F.col("decision"))).withColumn("output_hash", F.coalesce("new_hash", "output_hash"))
        out = out.withColumn("content_hash", F.coalesce("shipped_hash", "content_hash"))
        return kept(out.select(*changes.KEY, "size", "mtime_ns", "content_hash", "output_hash", "decision", "reason", "attempts"))

    def _write(self, objects: DataFrame) -> None:
        whole = objects.where("error IS NULL")
        if whole.limit(1).count():
            tables.write_objects(whole.select("key", "source_id", "content", "manifest"), self.object_path)

    def _derived(self, staged: DataFrame, state: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Ship enriched transcripts whose output is new; the state's rows of those that shipped."""
        read = self._contents(staged).where("content IS NOT NULL")
        lines = derived.transcript_lines(read.select("native_path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")))
        made = kept(derived.enriched_lines(lines, self.store(self.spark)))
        old = state.where(F.col("source_id") == self.source.source_id).select("native_path", "output_hash", "source_hash")
        new = kept(derived.changed(derived.output_hashes(made), old))
        texts = derived.payloads(made.join(new.select("conv"), "conv", "left_semi")).withColumn("native_path", F.concat("conv", F.lit(derived.SUFFIX)))
        objects = self._redacted(texts.select("native_path", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), "text"), kept)
        self._write(objects)
        shipped = objects.where("error IS NULL").select("native_path", F.col("content_hash").alias("source_hash"))
        rows = new.select(F.concat("conv", F.lit(derived.SUFFIX)).alias("native_path"), "output_hash").join(shipped, "native_path")
        return kept(rows.select(F.lit(self.source.source_id).alias("source_id"), "native_path", "source_hash", "output_hash", F.lit(False).alias("parked"), F.lit(0).alias("attempts")))

    def stream(self, checkpoint: str, on_tick: Callable[[dict[str, int]], None] = lambda counts: None, every: str | None = None):
        """Start ticking: with ``every`` ('15 minutes') on and on, else once. Returns the streaming query.

        After a tick that its budget cut short, the next one comes after ``delay`` seconds, not with the clock.
        """
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = clock.writeStream.option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)

        def ticks(_batch: DataFrame, _n: int) -> None:
            on_tick(self.tick())
            while every and self.delay < self.tick_seconds:
                time.sleep(self.delay)
                on_tick(self.tick())

        return writer.foreachBatch(ticks).start()


def next_delay(truncated: bool, failed: bool, shipped: int, tick_seconds: float) -> float:
    """Seconds to the next tick: a short one after a run that stopped at its budget with progress and no error."""
    return CATCH_UP_SECONDS if truncated and not failed and shipped else tick_seconds


def paused(flag: DataFrame, now) -> bool:
    """Is a pause on? No row: no. A row whose end is missing or can't be read: yes. flag: until (string)."""
    row = flag.select(F.coalesce(F.try_to_timestamp("until") > now, F.lit(True)).alias("on")).first()
    return bool(row and row["on"])
