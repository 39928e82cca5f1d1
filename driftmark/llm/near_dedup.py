"""Near-duplicate detection: one-permutation MinHash, optimal densification, banded buckets, star edges.

1. A document's set is its distinct five-word shingles as 64-bit hashes. Documents of one set form
   a class and go on as one, so copies cost nothing further.
2. The hash range is cut into bins; the least hash in a bin is its minimum, and an empty bin borrows
   that of a full one found by a random walk of its own (optimal densification). Bands of minima name buckets.
3. Every bucket gives star-shaped edges, from each member to its smallest one: as many edges as
   members. Their components hold every pair that shares a bucket.
4. Two classes are linked if they share a bucket and their full sets confirm it. A component that fits in one block is
   compared at once. In larger ones the star edges are confirmed first; what they already join need not meet again, so only
   blocks of different joined groups are compared. Only a spanning forest of the links leaves a block.
5. Components of the confirmed links, by alternating large and small stars.

With 26 bands of 5 bins, a pair at similarity 0.85 misses all buckets with probability below 3e-7; with 40 of 4,
one at 0.8 with probability below 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, key_join, materialize, worker_cache

SHINGLE_WORDS, PERCENT = 5, 85
BANDS, BAND_BINS = 26, 5
#: Bands and bins for a limit of 80 %.
LOOSE_BANDS = (40, 4)
#: A block holds about so many shingles, and documents, at most; components of more blocks than this are compared by bucket.
BLOCK_SHINGLES, BLOCK_DOCS, WHOLE_BLOCKS = 1_000_000, 1_024, 26
#: Star edges of a class in a large component that are confirmed before its blocks meet.
STAR_EDGES = 2
#: Words whose hashes a worker remembers; it forgets all when there are more.
REMEMBERED = 100_000

_WEIGHTS = np.array([xxhash.xxh64_intdigest(b"shingle %d" % k) | 1 for k in range(SHINGLE_WORDS)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (xor-shift and multiply, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a whole text; of fewer words, one for all; of none, none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z fall, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.array([hashes[x] for x in words], np.uint64)
    n = len(w) - SHINGLE_WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        total += w[k : k + n] * _WEIGHTS[k]
    return np.unique(_mix(total))


def bin_edges(bins: int) -> np.ndarray:
    """Where the bins of the hash range begin."""
    return np.array([(k << 64) // bins for k in range(bins)], dtype=np.uint64)


def band_hashes(found: np.ndarray, bands: int = BANDS, band_bins: int = BAND_BINS, edges: np.ndarray | None = None) -> np.ndarray:
    """One hash for each band of a non-empty sorted set, as signed 64-bit numbers; edges, if given, are the bins'."""
    bins = bands * band_bins
    first = np.searchsorted(found, bin_edges(bins) if edges is None else edges)
    full = np.append(first[1:], len(found)) > first
    minima = found[np.minimum(first, len(found) - 1)]
    empty, step = np.flatnonzero(~full), 0
    while len(empty):
        step += 1
        walk = empty.astype(np.uint64) + np.uint64(step << 32)
        donor = (_mix(walk * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64)
        ok = full[donor]
        minima[empty[ok]] = minima[donor[ok]]
        empty = empty[~ok]
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in minima.reshape(bands, band_bins).T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _hashes() -> dict:
    return worker_cache().setdefault("words", _WordHashes())


def _marks(bands: int, band_bins: int):
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, edges = _hashes(), bin_edges(bands * band_bins)
        for b in batches:
            sizes, sets, hashed = [], [], []
            for text in b.column("text").to_pylist():
                found = shingles(text, known)
                sizes.append(len(found))
                sets.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                hashed.append(band_hashes(found, bands, band_bins, edges) if len(found) else np.empty(0, np.int64))
            flat = pa.array(np.concatenate(hashed) if hashed else np.empty(0, np.int64))
            ends = pa.array(np.cumsum([0, *map(len, hashed)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "n_shingles", "same", "bands"])

    return marks


def _full_sets(bands: int, band_bins: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, edges = _hashes(), bin_edges(bands * band_bins)
        for b in batches:
            sets = [shingles(t, known) for t in b.column("text").to_pylist()]
            hashed = [band_hashes(x, bands, band_bins, edges).tobytes() if len(x) else b"" for x in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(hashed, pa.binary())], ["rep", "found", "hashed"])

    return full


#: Pairs of rare shingles that are counted at a time.
_CODES = 500_000


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections of two of the sets."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    many = np.diff(np.append(starts, len(every)))
    out = np.zeros(m * m, np.int64)
    for d in np.unique(many[(many >= 2) & (many <= 24)]):  # rare shingles: count their pairs
        rows = owner[starts[many == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        step = max(1, _CODES // len(i))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            codes = (some[:, i] * m + some[:, j]).ravel()
            if len(codes) * 8 < m * m:
                np.add.at(out, codes, 1)
            else:
                out += np.bincount(codes, minlength=m * m)
    out = out.reshape(m, m)
    out = out + out.T
    common = np.flatnonzero(many > 24)  # common ones: matrix products, some columns at a time
    for at in range(0, len(common), 2_048):
        part = common[at : at + 2_048]
        has = np.zeros((m, len(part)), np.float32)
        for k, c in enumerate(part):
            has[owner[starts[c] : starts[c] + many[c]], k] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its component."""
    root = np.full(len(linked), -1)
    for k in range(len(linked)):
        if root[k] >= 0:
            continue
        root[k], new = k, np.array([k])
        while len(new):
            new = np.flatnonzero(linked[new].any(axis=0) & (root < 0))
            root[new] = k
    return root


def _block_links(percent: int):
    def confirm(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        ids = table.column("rep").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("found")]
        bands = np.stack([np.frombuffer(x.as_py(), np.int64) for x in table.column("hashed")])
        size = np.array([len(s) for s in sets])
        both = intersections(sets)
        i, j = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
        meet = np.zeros(len(i), bool)
        for column in bands.T:
            meet |= column[i] == column[j]
        linked = np.zeros(both.shape, bool)
        linked[i[meet], j[meet]] = linked[j[meet], i[meet]] = True
        root = roots(linked)
        other = np.flatnonzero(ids != ids[root])
        return pa.table({"a": ids[other], "b": ids[root[other]]})

    return confirm


def _confirmed_pairs(percent: int):
    """Of rows (a, b, found_a, found_b), the pairs whose full sets are alike enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("found_a"), batch.column("found_b"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for each node of the edges (a, b): component is the smallest node that it reaches.

    Alternating large and small stars; each half-round is written to the shared folder.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = materialize(edges, label), None
    while True:
        both = edges.union(edges.select("b", "a"))
        # each node's least neighbour is written first: joined by itself, a node of many neighbours can be split or broadcast
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), label)
        large = key_join(both.where("b > a"), low, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, label)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), label)
        small = key_join(large, low, "a", "inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).distinct()
        edges = materialize(small, label)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def _blocks_of(shingles: str, docs: str) -> Column:
    return F.greatest(F.col(shingles) / BLOCK_SHINGLES, F.col(docs) / BLOCK_DOCS)


def _tagged(members: DataFrame, groups: DataFrame) -> DataFrame:
    """members (bucket, center, rep, n_shingles) with their component and its size in blocks. groups: node, component."""
    tagged = members.join(groups, members["rep"] == groups["node"], "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    tagged = materialize(tagged, "near-tagged")
    each = tagged.select("component", "rep", "n_shingles").distinct()
    sizes = each.groupBy("component").agg(F.sum("n_shingles").alias("s"), F.count(F.lit(1)).alias("c"))
    sizes = materialize(sizes.select("component", F.ceil(_blocks_of("s", "c")).cast("int").alias("blocks")), "near-sizes")
    return tagged.join(sizes, "component")


def _block_pairs(reps: DataFrame) -> DataFrame:
    """(kind, unit, i, j, rep): pairs of blocks that are compared. reps: kind, unit, rep, n_shingles, root.

    Classes of one root are linked already. A root that fills a block or more gets blocks of its own, which don't meet
    each other; all smaller ones of a unit share blocks, which meet all.
    """
    unit = ["kind", "unit"]
    roots_ = reps.groupBy(*unit, "root").agg(F.sum("n_shingles").alias("s"), F.count(F.lit(1)).alias("c")).withColumn("w", _blocks_of("s", "c"))
    roots_ = materialize(roots_, "near-roots")
    mixed = roots_.where("w < 1").groupBy(*unit).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    mixed = mixed.select(*unit, F.ceil(_blocks_of("s", "c")).cast("int").alias("mixed"))
    large = roots_.where("w >= 1").select(*unit, "root", F.ceil("w").cast("int").alias("n"))
    by = Window.partitionBy(*unit)
    before = F.coalesce(F.sum("n").over(by.orderBy("root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = large.select(*unit, "root", "n", before.alias("before"), F.sum("n").over(by).alias("all"))
    totals = mixed.join(large.groupBy(*unit).agg(F.max("all").alias("all")), unit, "full")
    totals = materialize(totals.select(*unit, F.coalesce("mixed", F.lit(0)).alias("mixed"), F.coalesce("all", F.lit(0)).cast("int").alias("all")), "near-totals")
    large = materialize(large.drop("all"), "near-large")
    out = key_join(key_join(reps, totals, unit, "inner"), large, [*unit, "root"], "left")
    spread = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    first = (F.col("mixed") + F.col("before")).cast("int")
    out = out.withColumn("own", F.when(F.col("n").isNull(), spread(F.greatest("mixed", F.lit(1)))).otherwise(first + spread(F.greatest("n", F.lit(1)))))
    every = F.sequence(F.lit(0), F.col("mixed") + F.col("all") - 1)
    others = F.when(F.col("n").isNotNull(), F.filter(every, lambda k: (k < first) | (k >= first + F.col("n"))))
    others = others.when(F.col("mixed") + F.col("all") == 1, F.array(F.lit(0))).otherwise(F.array_remove(every, F.col("own")))
    out = out.withColumn("other", F.explode(others))
    return out.select(*unit, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, bands: tuple[int, int] = (BANDS, BAND_BINS)) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Linked are documents that share a bucket and have 100 * intersection >= percent * union of their sets; component_id
    is the smallest id that links reach, kept says that it is the document's own. Null and wordless texts have no
    shingles and no links. Rows without an id are never linked: component_id is null and kept true. Rows of one id are one
    node, linked through any of their texts; each row is returned. bands: how many, and of how many bins each; a
    lower percent needs more or shorter ones.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with bounded_batches(docs.sparkSession):
        marks = materialize(docs.mapInArrow(_marks(*bands), "doc_id long, n_shingles long, same binary, bands array<long>"), "near-marks")
    known = marks.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
    classes = materialize(classes, "near-classes")
    rows = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("center"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    # buckets of the same members count once
    buckets = buckets.where("n > 1").groupBy("n", "center", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "center")
    buckets = materialize(buckets, "near-buckets")
    members = materialize(key_join(rows, buckets, "bucket", "inner"), "near-members")
    stars = members.where("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    tagged = materialize(_tagged(members, components(stars, "near-candidates")), "near-units")
    whole = tagged.where("blocks = 1").select(F.lit("c").alias("kind"), F.col("component").alias("unit"), F.lit(0).alias("i"), F.lit(0).alias("j"), "rep").distinct()
    large, links = tagged.where("blocks > 1"), None

    def sets_of(reps: DataFrame) -> DataFrame:
        ids = materialize(reps.select(F.col("rep").alias("doc_id")).distinct(), "near-ids")
        return key_join(docs, ids, "doc_id", "left_semi").mapInArrow(_full_sets(*bands), "rep long, found binary, hashed binary").where(F.octet_length("found") > 0).distinct()

    def compared(units: DataFrame, sets: DataFrame) -> DataFrame:
        return materialize(units.join(sets, "rep").groupBy("kind", "unit", "i", "j").applyInArrow(_block_links(percent), "a long, b long"), "near-found")

    with bounded_batches(docs.sparkSession):
        found = compared(whole, sets_of(whole))
        if large.limit(1).count():
            full = materialize(sets_of(large), "near-full")  # read several times
            a, b = (full.select(F.col("rep").alias(n), F.col("found").alias("found_" + n)) for n in "ab")
            # the smallest centers are those that most classes share; the star edges beyond them are left to the blocks
            centers = F.slice(F.array_sort(F.collect_set("center")), 1, STAR_EDGES)
            pairs = large.where("rep <> center").groupBy(F.col("rep").alias("a")).agg(centers.alias("b")).select("a", F.explode("b").alias("b"))
            links = materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "found_a", "found_b").mapInArrow(_confirmed_pairs(percent), "a long, b long"), "near-stars")
            joined = components(links, "near-joined").select(F.col("node").alias("rep"), F.col("component").alias("root"))
            by_bucket = F.col("blocks") > WHOLE_BLOCKS
            units = large.select(F.when(by_bucket, "b").otherwise("c").alias("kind"), F.when(by_bucket, F.col("bucket")).otherwise(F.col("component")).alias("unit"), "rep", "n_shingles").distinct()
            units = materialize(units.join(joined, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "near-large-units")
            found = found.unionByName(compared(materialize(_block_pairs(units), "near-blocks"), full))
    links = found if links is None else found.unionByName(links)
    linked = components(links, "near-links")
    # classes of one document without links need no look-up
    named = classes.join(linked, classes["rep"] == linked["node"], "left").withColumn("to", F.coalesce("component", "rep"))
    named = materialize(named.where("copies > 1 OR to <> rep").select("same", "to"), "near-named")
    out = key_join(marks.select("doc_id", "n_shingles", "same"), named, "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("to", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
