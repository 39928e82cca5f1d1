"""Enriched transcripts: each native line beside what a store knows of its blocks, and a change signal of their own.

Lines become blocks, blocks are aligned with the store's events, and matched blocks get what the transcript lacks. The
output of a conversation is hashed from its lines in order; only one whose hash is new ships, so looking again at what
didn't change costs no upload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.operators import alignment
from driftmark.sources import keyvalue, tables

#: Behind a transcript's path: that of what is derived from it.
SUFFIX = ".enriched.jsonl"
_LINE = "role string, message struct<content array<struct<type string, text string, name string, input string>>>"
#: Blocks of a line, at most; more than any line of bounded size has.
_PLACES = 1 << 24


def conversation_id(path: Column) -> Column:
    """The base name of a transcript without its ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl$", "")


def transcript_lines(files: DataFrame) -> DataFrame:
    """(conv, line_no, body) of (native_path, content): trimmed lines, blank ones left out; conv is the path."""
    lines = files.select(F.col("native_path").alias("conv"), F.posexplode(F.split("content", "\n")).alias("line_no", "body"))
    return lines.withColumn("body", F.regexp_replace("body", r"^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$", "")).where("body <> ''")


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with ``valid`` (a JSON object of the shape that transcripts have) and ``line`` (null where it has no events)."""
    body = F.col("body")
    message, content = F.get_json_object(body, "$.message"), F.get_json_object(body, "$.message.content")
    shaped = (body.startswith("{") & F.coalesce(message.startswith("{"), F.lit(True)) & F.coalesce(content.startswith("["), F.lit(True))) | (body == "null")
    out = lines.withColumn("valid", F.try_parse_json(body).isNotNull() & shaped)
    line = F.when(F.col("valid"), F.from_json(body, _LINE))
    return out.withColumn("line", F.when((F.coalesce(line["role"], F.lit("")) != "") & (F.size(line["message"]["content"]) > 0), line))


def blocks_of(lines: DataFrame) -> DataFrame:
    """Blocks of parsed lines, as alignment.align takes them, with the place in their line (at)."""
    rows = lines.where("line IS NOT NULL").select("conv", "line_no", F.col("line.role").alias("role"), F.posexplode("line.message.content").alias("at", "b"))
    return rows.select("conv", "line_no", "at", (F.col("line_no").cast("long") * _PLACES + F.col("at")).alias("seq"), "role", F.coalesce("b.type", F.lit("")).alias("type"), F.coalesce("b.text", F.lit("")).alias("text"), "b.name", "b.input")


def additions(event: str = "") -> Column:
    """What a store's event knows and a transcript doesn't, as a JSON object of what isn't empty."""
    of = lambda c: F.nullif(F.col(event + c), F.lit(""))
    names = [("event_id", "bubbleId"), ("tool_call_id", "tool_call_id"), ("name", "tool_name"), ("status", "status"), ("result", "result"), ("created_at", "createdAt"), ("request_id", "requestId"), ("checkpoint_id", "checkpointId")]
    turn = F.nullif(F.col(event + "turn_ms"), F.lit(0).cast("long"))
    return F.to_json(F.struct(*[of(c).alias(n) for c, n in names], turn.alias("turnDurationMs"), of("model_name").alias("modelName")))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def enriched_lines(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv, line_no, line): each line of (conv, line_no, body) with what the store's rows (key, value) add to its blocks.

    conv is a path, the store's conversation its base name. A line is an object: ``native``, the line as it is, and ``_enrich``, one entry for each
    block (null where nothing matched), left out where no block matched; a line that isn't JSON is a text, ``native_invalid``. Conversations without an
    event in the store have no output.
    """
    events = keyvalue.events(rows).withColumnRenamed("conv", "stored")
    named = lines.select("conv").distinct().withColumn("stored", conversation_id(F.col("conv")))
    # events and blocks are each read several times, so they are written once
    stored = tables.written(named.join(events, "stored").drop("stored"), "enrich-events")
    found = tables.written(parsed(lines.join(stored.select("conv").distinct(), "conv", "left_semi")), "enrich-lines")
    blocks = tables.written(blocks_of(found), "enrich-blocks")
    matched = alignment.align(blocks.drop("line_no", "at"), stored).where("outcome = 'match'").select("conv", "seq", "pos")
    extra = matched.join(stored, ["conv", "pos"]).select("conv", "seq", additions().alias("extra"))
    each = blocks.select("conv", "line_no", "at", "seq").join(extra, ["conv", "seq"], "left")
    by_line = each.groupBy("conv", "line_no").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("extra", F.lit("null")).alias("x")))).alias("xs"), F.count("extra").alias("n"))
    told = F.concat(F.lit(',"_enrich":['), F.array_join(F.transform("xs", lambda x: x["x"]), ","), F.lit("]"))
    out = found.join(by_line, ["conv", "line_no"], "left")
    whole = F.concat(F.lit('{"native":'), "body", F.when(F.col("n") > 0, told).otherwise(F.lit("")), F.lit("}"))
    return out.select("conv", "line_no", F.when(F.col("valid"), whole).otherwise(F.concat(F.lit('{"native_invalid":'), _quoted(F.col("body")), F.lit("}"))).alias("line"))


def output_hashes(lines: DataFrame) -> DataFrame:
    """(conv, output_hash): SHA-256 over the digests of a conversation's lines in order."""
    digests = F.array_sort(F.collect_list(F.struct("line_no", F.sha2(F.col("line").cast("binary"), 256).alias("d"))))
    return lines.groupBy("conv").agg(F.sha2(F.array_join(F.transform(digests, lambda x: x["d"]), "\n").cast("binary"), 256).alias("output_hash"))


def changed(hashes: DataFrame, state: DataFrame) -> DataFrame:
    """Those of (conv, output_hash) whose output never shipped or is another now. state: native_path, output_hash, source_hash."""
    old = state.where("source_hash IS NOT NULL").select(F.col("native_path"), F.col("output_hash").alias("shipped"))
    same = (F.concat(hashes["conv"], F.lit(SUFFIX)) == old["native_path"]) & (hashes["output_hash"] == old["shipped"])
    return hashes.join(old, same, "left_anti")


def payloads(lines: DataFrame) -> DataFrame:
    """(conv, text): lines in order, each with its end; a transcript's size is bounded before it is read."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("conv").agg(F.array_join(F.transform(rows, lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("text"))
