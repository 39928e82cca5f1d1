"""Centroid clustering by the filtering algorithm on kd-trees, in exact integers.

1. Tasks pack their vectors into blocks and build a kd-tree over each: a node has the count, the sum and the bounding box
   of its vectors. The trees are written once; every round reads them.
2. A round sends the centroids down each tree. At a node, the centroid nearest to the middle of the box stays, with all
   those that are not strictly farther from every point of the box; a node with one centroid left is assigned as a whole, by
   its count and sum. What reaches a leaf with several is settled vector by vector.
3. Sums by centroid and component are added up by Spark; only the centroids themselves come to the driver.

Everything is in 64-bit integers, so results don't depend on how vectors are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, key_join, materialize

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Vectors of a tree, and of a leaf, at most.
BLOCK, LEAF = 2_048, 16


def scaled(embedding: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """The vector as integers floor(scale * x); null if it hasn't that many components, all of them finite numbers."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.when((F.size(embedding) == dimensions) & finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _largest(dimensions: int) -> int:
    """Components up to this size keep all sums of squares and products within 64 bits."""
    return math.isqrt((1 << 60) // dimensions) // 2


class Tree:
    """A balanced kd-tree: at level v, node j has the vectors from n*j >> v up to n*(j+1) >> v; box and sum by level."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None):
        self.n = len(points)
        self.depth = max(0, math.ceil(math.log2(self.n / LEAF)))
        self.order = np.arange(self.n) if order is None else order
        if order is None:
            for level in range(self.depth):
                for j in range(1 << level):
                    start, middle, end = (self.n * k >> (level + 1) for k in (2 * j, 2 * j + 1, 2 * j + 2))
                    own = self.order[start:end]
                    widest = np.argmax(np.ptp(points[own], axis=0))
                    self.order[start:end] = own[np.argpartition(points[own, widest], middle - start)]
            points = points[self.order]
        self.points = points
        starts = self.starts(self.depth)
        self.low, self.high, self.sums = ([f.reduceat(points, starts, axis=0)] for f in (np.minimum, np.maximum, np.add))
        for _ in range(self.depth):
            for f, levels in ((np.minimum, self.low), (np.maximum, self.high), (np.add, self.sums)):
                levels.insert(0, f(levels[0][::2], levels[0][1::2]))

    def starts(self, level: int) -> np.ndarray:
        return self.n * np.arange(1 << level) >> level

    def ends(self, level: int) -> np.ndarray:
        return self.n * np.arange(1, (1 << level) + 1) >> level

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, nodes, centroid of each) for nodes assigned as a whole; at last (-1, vectors, centroid of each) for the rest.

        Of several nearest centroids a vector gets the first.
        """
        square = (centroids * centroids).sum(axis=1)
        nodes, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        for level in range(self.depth + 1):
            low, high = self.low[level][nodes], self.high[level][nodes]
            from_middle = square - (low + high) @ centroids.T
            nearest = np.where(alive, from_middle, np.iinfo(np.int64).max).argmin(axis=1)
            for s in np.unique(nearest):
                some, d = np.flatnonzero(nearest == s), centroids - centroids[s]
                # the least that another centroid is farther than s, by the corner of the box that is best for it
                farther = square - square[s] - 2 * (high[some] @ np.maximum(d, 0).T + low[some] @ np.minimum(d, 0).T)
                alive[some] &= farther <= 0
            one = alive.sum(axis=1) == 1
            if one.any():
                yield level, nodes[one], alive[one].argmax(axis=1)
            nodes, alive = nodes[~one], alive[~one]
            if level < self.depth:
                nodes, alive = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([alive, alive])
        if len(nodes):
            starts, sizes = self.starts(self.depth)[nodes], (self.ends(self.depth) - self.starts(self.depth))[nodes]
            rows = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            far = np.where(np.repeat(alive, sizes, axis=0), square - 2 * (self.points[rows] @ centroids.T), np.iinfo(np.int64).max)
            yield -1, rows, far.argmin(axis=1)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of the vectors of each centroid."""
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for level, found, to in self.filtered(centroids):
            np.add.at(counts, to, 1 if level < 0 else (self.ends(level) - self.starts(level))[found])
            np.add.at(sums, to, self.points[found] if level < 0 else self.sums[level][found])
        return counts, sums

    def assigned(self, centroids: np.ndarray) -> np.ndarray:
        """The centroid of each vector, in the tree's order."""
        out = np.empty(self.n, np.int64)
        for level, found, to in self.filtered(centroids):
            if level < 0:
                out[found] = to
            else:
                starts, ends = self.starts(level), self.ends(level)
                for j, c in zip(found, to, strict=True):
                    out[starts[j] : ends[j]] = c
        return out


def _planted(dimensions: int):
    """Arrow map from (vec_id, v) to trees: ids and vectors in the tree's order."""
    most = _largest(dimensions)

    def block(ids: list, points: list) -> pa.RecordBatch:
        points = np.concatenate(points)
        if np.abs(points).max() > most:
            raise ValueError(f"a component is beyond {most}: distances would not fit 64 bits")
        tree = Tree(points)
        ids = pa.concat_arrays(ids).take(pa.array(tree.order))
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([ids, pa.array([tree.points.astype("<i4").tobytes()], pa.binary())], ["ids", "points"])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids.append(part.column("vec_id"))
                points.append(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
                n += part.num_rows
                if n >= BLOCK:
                    yield block(ids, points)
                    ids, points, n = [], [], 0
        if n:
            yield block(ids, points)

    return plant


def _trees(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids = batch.column("ids").slice(k, 1).flatten()
            points = np.frombuffer(batch.column("points")[k].as_buffer(), "<i4").reshape(-1, dimensions).astype(np.int64)
            yield ids, Tree(points, np.arange(len(points)))


def _summed(centroids: np.ndarray):
    """Arrow map from trees to (cluster, part, total): a task's sums of each component, and its counts as the part after them."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimensions = centroids.shape
        out = np.zeros((k, dimensions + 1), np.int64)
        for _, tree in _trees(batches, dimensions):
            counts, sums = tree.totals(centroids)
            out += np.column_stack([sums, counts])
        cluster, part = np.indices(out.shape)
        some = out.ravel() != 0
        yield pa.RecordBatch.from_arrays([pa.array(cluster.ravel()[some].astype(np.int32)), pa.array(part.ravel()[some].astype(np.int32)), pa.array(out.ravel()[some])], ["cluster", "part", "total"])

    return summed


def _nearest(centroids: np.ndarray):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, centroids.shape[1]):
            to = tree.assigned(centroids)
            off = tree.points - centroids[to]
            yield pa.RecordBatch.from_arrays([ids, pa.array(to.astype(np.int32)), pa.array((off * off).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return nearest


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of ``seed:vec_id``, in its order; of equal ids, the smaller vector first.

    Vectors without an id are none of them; fewer vectors give fewer centroids.
    """
    by = F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where("vec_id IS NOT NULL").select(by.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def fit(trees: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after so many rounds; those of one without vectors stay. Ends early where a round changes nothing."""
    for _ in range(rounds):
        sums = trees.mapInArrow(_summed(centroids), "cluster int, part int, total long").groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        fresh, totals = centroids.copy(), {(r["cluster"], r["part"]): int(r["total"]) for r in sums.collect()}
        for c in range(len(centroids)):
            count = totals.get((c, centroids.shape[1]), 0)
            if count:
                fresh[c] = [totals.get((c, d), 0) // count for d in range(centroids.shape[1])]
        if (fresh == centroids).all():
            break
        centroids = fresh
    return centroids


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """One row for each kept vector of (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of ``dimensions`` finite components; others, null ones and empty ones have no row. Of several nearest
    centroids the first counts. Repeated rows are vectors of their own; one without an id is clustered, but never a first
    centroid. Other columns don't matter. An empty table, or one without ids, gives no rows. Components whose sums of
    squares would not fit 64 bits are an error.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), dimensions, scale).alias("v")).where("v IS NOT NULL")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], OUT)
    with bounded_batches(spark):
        trees = materialize(vectors.mapInArrow(_planted(dimensions), "ids array<long>, points binary"), "cluster-trees")
        centroids = fit(trees, centroids, rounds)
        found = materialize(trees.mapInArrow(_nearest(centroids), "vec_id long, cluster int, distance long"), "cluster-found")
    # one row for each centroid, so it may pass through the driver
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    each = spark.createDataFrame([(c, total, sum(sums.values()), digest(c)) for c, total in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return key_join(found, each, "cluster", "inner", rows=len(sums)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
