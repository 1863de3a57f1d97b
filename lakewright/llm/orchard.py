"""Centroid clustering of vectors; the nearest centroid is found by Orchard's search.

Every centroid has a list of the others, the nearest first. A vector starts
at some centroid and goes down its list; where it meets a closer centroid it
goes on in that one's list. What is farther from the best centroid than twice the
vector's distance cannot be closer, so there the search ends. All is done in
whole numbers, so results do not depend on the order of the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakewright.session import cut_lineage

from .common import pack_longs, unpack_longs, unzstd, zstd
from .pivots import usable

#: Vectors in a block, the unit of a search.
BLOCK = 8192
#: Components beyond this take no part: squared distances of 64 of them would not fit a long.
MOST = 1 << 27


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every centroid the others by distance, and a quarter of these squared distances, rounded up."""
    square = (centroids ** 2).sum(axis=1)
    apart = square[:, None] + square[None, :] - 2 * (centroids @ centroids.T)
    np.fill_diagonal(apart, -1)
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, axis=1) + 3 >> 2


def nearest(rows: np.ndarray, centroids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of every row (ties: the smaller number), the squared distance, and how many distances were computed.

    start: where each row's search begins. All rows take their steps side by side.
    """
    lists, quarters = neighbour_lists(centroids)
    n, most = len(rows), lists.shape[1]
    best = start.astype(np.int64)
    near = ((rows - centroids[best]) ** 2).sum(axis=1)
    visited = np.zeros((n, len(centroids)), bool)
    visited[np.arange(n), best] = True
    place, active, computed = np.zeros(n, np.int64), np.arange(n), n
    while len(active):
        active = active[place[active] < most]
        # Strictly beyond twice the distance; squares are compared, exactly.
        active = active[quarters[best[active], place[active]] <= near[active]]
        other = lists[best[active], place[active]]
        new = ~visited[active, other]
        place[active] += 1
        at, other = active[new], other[new]
        visited[at, other] = True
        computed += len(at)
        found = ((rows[at] - centroids[other]) ** 2).sum(axis=1)
        closer = (found < near[at]) | ((found == near[at]) & (other < best[at]))
        at, other = at[closer], other[closer]
        near[at], best[at], place[at] = found[closer], other, 0
    return best, near, computed


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def kept_vectors(vectors: DataFrame, width: int, scale: int, key: str, vector: str) -> DataFrame:
    """`id` (may be null), `v` (whole numbers): vectors of `width` components, none null or non-finite, or too large."""
    x = F.col(vector)
    small = F.forall(x, lambda c: F.abs(c.cast("double")) * scale < MOST)
    return vectors.where(usable(x) & (F.size(x) == width) & small).select(F.col(key).cast("long").alias("id"), whole_numbers(x, scale).alias("v"))


def first_centroids(rows: DataFrame, k: int, width: int, seed: int) -> np.ndarray:
    """The `k` vectors whose ids have the smallest digests, in their order; rows of one id by their components. Rows without an id are none."""
    found = (rows.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
             .orderBy("h", "v").limit(k).collect())
    return np.array([r.v for r in found], np.int64).reshape(len(found), width)


_BLOCKS = "ids binary, missing binary, data binary, clusters binary, distances binary, n array<long>, sums array<long>, inertia array<decimal(38,0)>"


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """Packed rows, not assigned yet."""
    def task(batches):
        ids, held = [], []
        for batch in batches:
            for own in range(0, batch.num_rows, BLOCK):
                part = batch.slice(own, BLOCK)
                ids.append(part.column("id"))
                held.append(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                if sum(map(len, held)) >= BLOCK:
                    yield packed(ids, held)
                    ids, held = [], []
        if held:
            yield packed(ids, held)

    def packed(ids, held):
        ids, data = pa.chunked_array(ids).combine_chunks(), np.concatenate(held)
        return pa.record_batch({
            "ids": pa.array([pack_longs(ids.fill_null(0).to_numpy(zero_copy_only=False))], pa.binary()),
            "missing": pa.array([zstd(ids.is_null().to_numpy(zero_copy_only=False))], pa.binary()),
            "data": pa.array([zstd(data.astype("<i4"))], pa.binary()), "clusters": pa.array([zstd(np.zeros(len(data), "<i4"))], pa.binary())})

    return rows.mapInArrow(task, "ids binary, missing binary, data binary, clusters binary")


def _assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The blocks with each vector's cluster and squared distance, and per cluster number, sum and inertia of its vectors."""
    k, width = centroids.shape

    def task(batches):
        for batch in batches:
            for ids, missing, data, clusters in zip(*(batch.column(c).to_pylist() for c in ("ids", "missing", "data", "clusters"))):
                rows = unzstd(data, "<i4").reshape(-1, width).astype(np.int64)
                best, near, _ = nearest(rows, centroids, unzstd(clusters, "<i4"))
                n, sums = np.bincount(best, minlength=k), np.zeros((k, width), np.int64)
                np.add.at(sums, best, rows)
                # A block's inertia may not fit a long.
                high, low = np.zeros(k, np.int64), np.zeros(k, np.int64)
                np.add.at(high, best, near >> 32)
                np.add.at(low, best, near & 0xFFFFFFFF)
                inertia = [(h << 32) + x for h, x in zip(high.tolist(), low.tolist())]
                yield pa.record_batch({
                    "ids": pa.array([ids], pa.binary()), "missing": pa.array([missing], pa.binary()), "data": pa.array([data], pa.binary()),
                    "clusters": pa.array([zstd(best.astype("<i4"))], pa.binary()), "distances": pa.array([pack_longs(near)], pa.binary()),
                    "n": pa.array([n.tolist()], pa.list_(pa.int64())), "sums": pa.array([sums.ravel().tolist()], pa.list_(pa.int64())),
                    "inertia": pa.array([inertia], pa.list_(pa.decimal128(38, 0)))})

    return cut_lineage(blocks.mapInArrow(task, _BLOCKS), "assigned")


def _totals(blocks: DataFrame, column: str) -> list[int]:
    """The blocks' arrays added up, place by place: one number for each centroid, or for each of its components."""
    found = (blocks.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect())
    return [int(r.x) for r in sorted(found, key=lambda r: r.at)]


def moved(centroids: np.ndarray, n: list[int], sums: list[int]) -> np.ndarray:
    """Every centroid with vectors at the floor of their mean; the others stay."""
    k, width = centroids.shape
    return np.array([[sums[c * width + j] // n[c] for j in range(width)] if n[c] else centroids[c].tolist() for c in range(k)], np.int64).reshape(k, width)


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1, key: str = "vec_id",
              vector: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `width` components, none null or non-finite; a component counts as floor(scale * x) and has to be
    below MOST. Centroids start as the vectors whose ids' digests are smallest (all, if fewer than `k`) and move `rounds` times.
    A null id stays null and starts no centroid; repeated ids and rows count each; other columns are not read.
    Without a vector that can start a centroid the result is empty. Centroids and their sums, k * width numbers, are all that the driver sees.
    """
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, width, scale, key, vector)
    centroids = first_centroids(rows, k, width, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        blocks = None
        found = spark.createDataFrame([], schema)
    else:
        blocks = cut_lineage(_blocks(rows, width), "vectors")
        for _ in range(rounds):
            blocks = _assigned(blocks, centroids)
            centroids = moved(centroids, _totals(blocks, "n"), _totals(blocks, "sums"))
        blocks = _assigned(blocks, centroids)
        found = blocks.select("ids", "missing", "clusters", "distances").mapInArrow(_opened, schema)
    inertia = _totals(blocks, "inertia") if blocks is not None else []
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(c, i, sum(inertia), d) for c, (i, d) in enumerate(zip(inertia, digests))],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _opened(batches):
    for batch in batches:
        for ids, missing, clusters, distances in zip(*(batch.column(c).to_pylist() for c in ("ids", "missing", "clusters", "distances"))):
            yield pa.record_batch([
                pa.array(unpack_longs(ids), pa.int64(), mask=unzstd(missing, bool)),
                pa.array(unzstd(clusters, "<i4"), pa.int32()), pa.array(unpack_longs(distances), pa.int64())], names=["vec_id", "cluster", "distance"])
