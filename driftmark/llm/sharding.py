"""Sharding by extendible hashing: only a bucket over its byte limit splits, on the next bit of the hash.

The directory is computed from byte sums of hash prefixes, level by level for all
buckets at once; documents then look their shard up in it. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import key_join, materialize, numbered, with_copies

HASH_BITS = 60
#: Bits that a round below the first looks at.
STEP = 6
#: Bytes that a shard holds at most, unless one document alone is larger.
SHARD_BYTES = 1 << 20
#: Look-up cells for each shard, at most, on average.
CELLS = 4


def text_mark(text: Column) -> Column:
    """What tells rows of one id apart: the md5 of the text (null: of the empty one)."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def hash_bits(doc_id: Column, mark: Column, copy: Column) -> Column:
    """The first 60 bits of the md5 of id (null: 'null'), text_mark and the number among equal rows, as a long.

    So rows of one id, or without one, part like any others, and so do equal rows.
    """
    whole = F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("null")), mark, copy.cast("string"))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """Buckets (depth, prefix, bytes, docs): the shortest prefixes whose documents fit in ``limit`` bytes.

    sized: columns h (60 bits), bytes. A prefix of all 60 bits that is too large stays:
    its documents have one hash and no further bit could part them.
    """
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    done, depth, todo = None, 0, sized
    # the first round ends where buckets hold about eight shards: above that nearly none fits, and its table is small;
    # the rounds below look at a few bits each, so that a document's bytes are added up on few levels
    step = max(STEP, math.ceil(math.log2(max(1, total) / limit + 1)) - 3)
    while True:
        deep = min(HASH_BITS, depth + step)
        # sums of the deepest prefixes of this round, then of every level above them
        fine = todo.groupBy(F.shiftright("h", HASH_BITS - deep).alias("g")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        fine = materialize(fine, "shard-fine")
        levels = fine.select("g", "bytes", "docs", F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(g, {deep} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        fits = (F.col("bytes") <= limit) | (F.col("docs") == 1) | (F.col("depth") == HASH_BITS)
        # a bucket is a shard if it fits and its parent, one bit shorter, does not
        parents = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), fits.alias("parent_fits"))
        kids = sums.withColumn("up", F.shiftright("prefix", 1)).join(parents, ["depth", "up"], "left")
        marked = materialize(kids.withColumn("fits", fits).select("depth", "prefix", "bytes", "docs", "fits", F.coalesce("parent_fits", F.lit(False)).alias("parent_fits")), "shard-levels")
        leaves = marked.where("fits AND NOT parent_fits").select("depth", "prefix", "bytes", "docs")
        done = leaves if done is None else done.unionByName(leaves)
        big = marked.where((F.col("depth") == deep) & ~F.col("fits")).select("prefix")
        if deep == HASH_BITS or not (n := big.count()):
            return done
        big = big.withColumnRenamed("prefix", "_g")
        todo = key_join(todo.withColumn("_g", F.shiftright("h", HASH_BITS - deep)), big, "_g", "left_semi", n).drop("_g")
        depth, step = deep, STEP


def assign_shards(sized: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Each row of ``sized`` (any columns, with h and bytes) with shard, shard_depth, shard_bytes, shard_docs.

    shard is the bucket's prefix as 0s and 1s ('' if all fits in one shard).
    """
    leaves = materialize(directory(sized, limit), "shard-directory")
    # shards are disjoint ranges of hashes: both sides meet in cells of one depth, and the range decides within a cell
    depths = {r["depth"]: r["count"] for r in leaves.groupBy("depth").count().collect()}
    cells = lambda deep: sum(n << max(0, deep - d) for d, n in depths.items())
    deep = max((d for d in range(HASH_BITS + 1) if cells(d) <= CELLS * sum(depths.values())), default=0)
    name = F.expr("lpad(conv(cast(prefix AS string), 10, 2), depth, '0')")
    low = F.expr(f"shiftleft(prefix, {HASH_BITS} - depth)")
    look = leaves.select(F.col("depth").alias("shard_depth"), F.when(F.col("depth") == 0, "").otherwise(name).alias("shard"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), low.alias("_low"), F.expr(f"shiftleft(prefix + 1, {HASH_BITS} - depth)").alias("_high"))
    look = look.withColumn("_cell", F.explode(F.sequence(F.shiftright("_low", HASH_BITS - deep), F.shiftright(F.col("_high") - 1, HASH_BITS - deep))))
    look = materialize(look, "shard-cells")
    found = key_join(sized.withColumn("_cell", F.shiftright("h", HASH_BITS - deep)), look, "_cell", "inner")
    return found.where("h >= _low AND h < _high").drop("_cell", "_low", "_high")


def shard(docs: DataFrame, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, bytes (UTF-8; null text: 0), shard, shard_depth, shard_bytes, shard_docs.

    Every row gets one shard. A shard is over the limit only if it holds a single document. Rows of one id and rows without
    one are spread by their texts, equal rows by their number. An empty table gives an empty result.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), text_mark(F.col(text)).alias("_mark"))
    sized = with_copies(sized, "shard-counted").withColumn("h", hash_bits(F.col("doc_id"), F.col("_mark"), F.col("_copy")))
    return assign_shards(materialize(sized.select("doc_id", "bytes", "h"), "shard-sized"), limit).drop("h")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the rows of ``docs`` as Parquet, one folder for each shard; its name replaces any column ``shard``.

    Readers must take the column ``shard`` as text, as names are digits with zeros in front. Where all fits in one shard its name is empty, and its folder that of Hive's default partition. An empty table writes nothing
    but the schema.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "shard"]).alias("_doc"), F.col(doc_id).alias("_id"), text_mark(F.col(text)).alias("_mark"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    rows = numbered(rows, ["_id", "_mark"], "shard-rows").withColumn("h", hash_bits(F.col("_id"), F.col("_mark"), F.col("_copy")))
    out = assign_shards(materialize(rows.select("_doc", "bytes", "h"), "shard-written"), limit).select("_doc.*", "shard")
    out.repartition("shard").write.partitionBy("shard").parquet(path)
