"""Best-fit packing under conflicts.

Bins are kept by the room they have left. A piece looks in the bins with just enough
room first, and goes on to the next larger room until a bin fits that holds neither its
source nor its duplicate cluster; bins know both as bitmaps. Pieces come largest first.
"""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, with_copies, word_count

#: Words of a bin, and pieces packed together by one task at a time.
CAPACITY, GROUP_PIECES = 2_048, 2_048


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each piece (size, source bit, cluster bit), taken in the order given; bits are 0 where nothing conflicts."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left, oldest first
    filled = 0  # bit r is set if some bin has room r
    seen: list[tuple[int, int]] = []
    out = []
    for size, source, cluster in pieces:
        found, above = -1, filled >> size << size
        while above:
            room = (above & -above).bit_length() - 1
            for b in rooms[room]:
                if not (seen[b][0] & source or seen[b][1] & cluster):
                    found = b
                    break
            if found >= 0:
                rooms[room].remove(found)
                if not rooms[room]:
                    filled ^= 1 << room
                break
            above &= above - 1
        if found < 0:
            found, room = len(seen), capacity
            seen.append((0, 0))
        seen[found] = (seen[found][0] | source, seen[found][1] | cluster)
        out.append(found)
        left = room - size
        insort(rooms[left], found)
        filled |= 1 << left
    return out


def _bits(values: list, repeated_only: bool) -> list[int]:
    """A bit for each value; 0 for null and, if wished, for values that occur once and so can't conflict."""
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    known = {v: 1 << k for k, v in enumerate(v for v, n in count.items() if v is not None and (n > 1 or not repeated_only))}
    return [known.get(v, 0) for v in values]


def pack(items: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack ``items`` (item long, size long, source string, cluster long) into bins of ``capacity``.

    Returns item, source, piece, start, size, bin, bin_room: every item whole, cut into pieces of at most
    ``capacity``; no bin has more than ``capacity``, two pieces of one source, or two of one
    cluster. Null source or cluster conflicts with nothing; size null or 0 gives one piece of
    size 0. Repeated rows are items of their own, numbered as copies of each other. Pieces are dealt to groups of about
    ``group_pieces`` by a hash of all they are and the copy's number: a hot source, an id that recurs and rows without one are
    spread like any other. In a group, ties of size go by item (null first), piece, source, cluster and copy. So the bins depend on the
    rows alone, not on their order or on how they lie in files. An empty table gives an empty result.
    """
    sized = items.select("item", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long").alias("_n"), "source", "cluster")
    sized = with_copies(sized, "pack-items")
    last = F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("int")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("piece") * F.lit(capacity).cast("long"))
    cut = cut.withColumn("size", F.least(F.col("_n") - F.col("start"), F.lit(capacity)).cast("int")).drop("_n")
    cut = materialize(cut, "pack-pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    salt = F.pmod(F.xxhash64("item", "piece", "source", "cluster", "size", "_copy"), F.lit(groups))

    def one(table: pa.Table) -> pa.Table:
        ties = ("item", "piece", "source", "cluster", "_copy")
        table = table.take(pc.sort_indices(table, [("size", "descending"), *((c, "ascending") for c in ties)], null_placement="at_start"))
        col = {c: table.column(c).to_pylist() for c in ("size", "source", "cluster")}
        bins = best_fit(list(zip(col["size"], _bits(col["source"], False), _bits(col["cluster"], True), strict=True)), capacity)
        group, used = table.column("grp")[0].as_py(), {}
        for b, n in zip(bins, col["size"], strict=True):
            used[b] = used.get(b, 0) + n
        ids = pa.array([(group << 24) + b for b in bins], pa.int64())
        room = pa.array([capacity - used[b] for b in bins], pa.int32())
        return pa.table({c: table.column(c) for c in ("item", "source", "piece", "start", "size")} | {"bin": ids, "bin_room": room})

    return cut.withColumn("grp", salt).groupBy("grp").applyInArrow(one, "item long, source string, piece int, start long, size int, bin long, bin_room int")


def document_items(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None) -> DataFrame:
    """Items of documents: words as size; the cluster, unless given, is a hash of the whole text (null: none).

    So only exact copies conflict by default; hand in near_dedup's component_id to keep near copies apart too.
    """
    cluster = F.when(F.col(text).isNotNull(), F.xxhash64(text)) if cluster is None else cluster
    return docs.select(F.col(doc_id).cast("long").alias("item"), word_count(F.col(text)).alias("size"), F.col(source).alias("source"), cluster.alias("cluster"))
