"""Status reads: layered configuration, uploads by family, tickets, metadata, messages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRINTABLE = "^[ -~]{0,128}$"
MESSAGE_BYTES = 400


def family_of(source_id: Column, family: Column) -> Column:
    return F.coalesce(F.nullif(family, F.lit("")), source_id)


def status(files: DataFrame) -> DataFrame:
    """Files, bytes and pending bytes by family, and for all with family null. files: family, size, pending."""
    out = files.rollup("family").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.coalesce(F.sum(F.when(F.col("pending"), F.col("size"))), F.lit(0)).alias("pending_bytes"), F.grouping("family").alias("_all"))
    return out.withColumn("is_total", F.col("_all") == 1).drop("_all")


def first_seen(rows: DataFrame, key: str, order: str, collecting: Column) -> DataFrame:
    """Keys numbered by their first row, with all and collecting rows."""
    per = rows.groupBy(key).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("n"), F.count_if(collecting).alias("collecting"))
    return per.withColumn("place", F.row_number().over(Window.orderBy("_first", key))).drop("_first")


def upload_by_family(probes: DataFrame, uploads: DataFrame) -> DataFrame:
    """By family, uploads of its sources summed; sources without any count as 0. probes: source_id, family; uploads: source_id, bytes, at."""
    probes = probes.select("source_id", family_of(F.col("source_id"), F.col("family")).alias("family")).distinct()
    return probes.join(uploads, "source_id", "left").groupBy("family").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("at").alias("last_at"), F.countDistinct("source_id").alias("sources"))


def effective_switches(layers: DataFrame) -> DataFrame:
    """The switch of each source by layer rank: the highest layer that sets it, unless a local layer switched it off.

    layers: source_id, layer, rank, local (boolean), enabled (null: not set). A source that no layer sets is on, by 'derived'.
    """
    set_ = F.col("enabled").isNotNull()
    per = layers.groupBy("source_id").agg(F.bool_or(F.col("local") & ~F.col("enabled")).alias("_veto"), F.max_by(F.struct("enabled", "layer"), F.when(set_, F.col("rank"))).alias("_top"), F.max_by("layer", F.when(F.col("local") & ~F.col("enabled"), F.col("rank"))).alias("_by"))
    veto = F.coalesce(F.col("_veto"), F.lit(False))
    return per.select("source_id", F.when(veto, False).otherwise(F.coalesce("_top.enabled", F.lit(True))).alias("enabled"), F.when(veto, F.col("_by")).otherwise(F.coalesce("_top.layer", F.lit("derived"))).alias("set_by"))


def match_tickets(prepared: DataFrame, tickets: DataFrame, batch: str) -> DataFrame:
    """Prepared objects with ``authorized``: exactly one ticket of the same key and length; a repeated ticket fails its whole batch.

    prepared: batch, object_id, key, size. tickets: batch, object_id, key, size.
    """
    per = tickets.groupBy(batch, "object_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("key", "size")).alias("_t"))
    bad = per.where("_n > 1").select(batch).distinct().withColumn("_bad", F.lit(True))
    out = prepared.join(per, [batch, "object_id"], "left").join(bad, batch, "left")
    fits = F.col("_t").eqNullSafe(F.struct("key", "size"))
    return out.withColumn("authorized", fits & F.col("_bad").isNull()).drop("_n", "_t", "_bad")


def metadata(fields: dict[str, Column]) -> Column:
    """Map of the fields that are set and printable."""
    entries = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(entries, lambda k, v: v.isNotNull() & v.rlike(PRINTABLE))


def message_tail(text: Column, most: int = MESSAGE_BYTES) -> Column:
    """The longest end of a message of at most ``most`` bytes; characters stay whole.

    A text is cut once, by bytes; what the cut left of a character, three bytes at most that aren't its first, goes.
    """
    end = F.substring(text.cast("binary"), -most, most)
    inner = lambda n: F.substring(end, n, 1).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    skipped = F.when(~inner(1), 0).when(~inner(2), 1).when(~inner(3), 2).otherwise(3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(end, skipped + 1, F.lit(most)).cast("string"))


def stalls(ticks: DataFrame, key: str, ts: str, limit_seconds: int) -> DataFrame:
    """Gaps between neighbouring ticks of a key that are longer than the limit: when it began, seconds, and how often that doubled."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1_000_000
    found = ticks.select(key, before.alias("since"), F.floor(gap).alias("seconds")).where(F.col("seconds") > limit_seconds)
    return found.withColumn("doublings", F.floor(F.log2(F.col("seconds") / limit_seconds)))


def jwt_claim(token: Column, claim: str) -> Column:
    """A claim of a token's second part; null if it isn't base64 or JSON."""
    part = F.translate(F.get(F.split(token, r"\."), F.lit(1)), "-_", "+/")
    body = F.try_to_binary(F.rpad(part, (F.ceil(F.length(part) / 4) * 4).cast("int"), "="), F.lit("base64"))
    return F.get_json_object(F.make_valid_utf8(body.cast("string")), "$." + claim)


def drop_fields(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows with the named JSON fields gone at any depth from a text column, and ``dropped``, how many.

    Texts without such a field, or that aren't JSON, stay byte for byte. Spark has no recursive delete, hence a map.
    """

    def strip(v):
        if isinstance(v, list):
            done = [strip(x) for x in v]
            return [x for x, _ in done], sum(n for _, n in done)
        if isinstance(v, dict):
            done = {k: strip(x) for k, x in v.items() if k not in names}
            return {k: x for k, (x, _) in done.items()}, len(v) - len(done) + sum(n for _, n in done.values())
        return v, 0

    def one(text: str | None) -> tuple[str | None, int]:
        if text is None or not any(n in text for n in names):
            return text, 0
        try:
            value, n = strip(json.loads(text))
        except (ValueError, RecursionError):
            return text, 0
        return (json.dumps(value, ensure_ascii=False, separators=(",", ":")), n) if n else (text, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [one(t) for t in b.column(column).to_pylist()]
            arrays = [pa.array([t for t, _ in done], pa.string()) if n == column else c for n, c in zip(b.schema.names, b.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([n for _, n in done], pa.int64())], [*b.schema.names, "dropped"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(run, ", ".join([*fields, "dropped long"]))
