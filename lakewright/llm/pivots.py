"""Exact top-k inner products by pivot elimination.

Vectors are lifted by one component so that all have the same length; then
the largest inner product is the nearest neighbour, and the triangle
inequality over many pivots bounds every distance from below.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.session import cut_lineage

from .common import longs

CANDIDATES, QUERIES = 8192, 256
PIVOTS = 32
#: Rows from which pivots are chosen, the first by a hash of their ids. Only how much is eliminated depends on them.
PIVOT_SAMPLE = 2_000
#: Candidates evaluated between two looks at the bounds.
STEP = 1024


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def scaled(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def choose_pivots(rows: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those chosen."""
    if not len(rows):
        return rows
    chosen, far = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(rows)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """`block`, `width`, `ids`, `data`: packed rows of equally long vectors."""
    def task(batches):
        from pyspark import TaskContext
        number, held = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            for doc, vector in zip(longs(batch.column("id")).tolist(), batch.column("v").to_pylist()):
                own = held.setdefault(len(vector), [])
                own.append((doc, vector))
                if len(own) == size:
                    yield packed(number, held.pop(len(vector)))
                    number += 1
        for own in held.values():
            yield packed(number, own)
            number += 1

    def packed(number, own):
        data = np.array([v for _, v in own], np.float64).reshape(len(own), len(own[0][1]))
        return pa.record_batch({
            "block": pa.array([number], pa.int64()), "width": pa.array([data.shape[1]], pa.int32()),
            "ids": pa.array([np.array([i for i, _ in own], np.int64).tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

    return rows.mapInArrow(task, "block long, width int, ids binary, data binary")


def lifted_distances(rows: np.ndarray, pivots: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """(rows, pivots): distances after lifting; a query's own lift is 0, so its length is its own."""
    square = (rows ** 2).sum(axis=1)
    inner = rows @ pivots.T
    if query:
        return np.sqrt(np.maximum(square[:, None] + longest - 2 * inner, 0))
    lift = np.sqrt(np.maximum(longest - square, 0))[:, None] * np.sqrt(np.maximum(longest - (pivots ** 2).sum(axis=1), 0))
    return np.sqrt(np.maximum(2 * longest - 2 * (inner + lift), 0))


def best_of_block(query: np.ndarray, query_id: int, upper: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """The k best (score, id) of a block: candidates in the order of their bounds until none can be among them."""
    order = np.argsort(-upper, kind="stable")
    scores, found = np.empty(0), np.empty(0, np.int64)
    for at in range(0, len(order), STEP):
        if len(scores) >= k and upper[order[at]] < scores[k - 1]:
            break
        part = order[at:at + STEP]
        part = part[ids[part] != query_id]
        scores, found = np.concatenate([scores, rows[part] @ query]), np.concatenate([found, ids[part]])
        best = np.lexsort((found, -scores))[:k]
        scores, found = scores[best], found[best]
    return scores, found


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, key: str = "vec_id",
                       vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of each query, ties to the smaller id.

    Components count as floor(scale * x). Queries are the rows whose id is
    divisible by `every`; candidates are all rows with another id. Rows with
    a null id, a null vector, or null or non-finite components take no part;
    only vectors of equal length are compared. Rows with one id are candidates each,
    but one query. The query blocks go to every block of candidates,
    which stays where it is.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), scaled(F.col(vector), scale).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest = rows.agg(F.max(square)).first()[0] or 0.0
    sample = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()]
    widths = {len(v) for v in sample}
    by_width = {n: [v for v in sample if len(v) == n] for n in widths}
    pivots = {n: choose_pivots(np.array(own, np.float64).reshape(len(own), n), PIVOTS) for n, own in by_width.items()}

    candidates = cut_lineage(_blocks(rows, CANDIDATES), "candidates")
    queries = cut_lineage(_blocks(rows.where(F.col("id") % every == 0).dropDuplicates(["id"]), QUERIES), "queries")
    wanted = candidates.select(F.col("block").alias("to"), "width").join(queries.withColumnRenamed("block", "q"), "width")
    dealt = candidates.select(F.col("block").alias("to"), F.lit(-1).cast("long").alias("q"), "width", "ids", "data").unionByName(
        wanted.select("to", "q", "width", "ids", "data"))

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                data = np.frombuffer(row["data"], np.float64).reshape(len(ids), row["width"])
                own = pivots.get(row["width"], np.zeros((0, row["width"])))
                if row["q"] == -1:
                    block_ids, block = ids, data
                    near = np.ascontiguousarray(lifted_distances(block, own, longest, query=False).T)  # a row for each pivot
                    continue
                theirs = lifted_distances(data, own, longest, query=True)
                found = [_of_query(q, i, d, near, block_ids, block) for q, i, d in zip(data, ids, theirs)]
                sizes = [len(s) for s, _ in found]
                yield pa.record_batch({
                    "query_id": np.repeat(ids, sizes), "vec_id": np.concatenate([f for _, f in found]),
                    "score": np.concatenate([s for s, _ in found]).astype(np.int64)})

    def _of_query(query, query_id, distances, near, ids, block):
        apart = np.zeros(len(block))
        for p in range(len(distances)):
            np.maximum(apart, np.abs(near[p] - distances[p]), out=apart)
        # Rounding in the distances must not cut off a candidate; scores are whole numbers.
        apart = np.maximum(apart - 1e-6 * (1 + apart), 0)
        upper = np.floor(((query ** 2).sum() + longest - apart ** 2) / 2 + 1e-3 * (1 + longest * 1e-9))
        return best_of_block(query, query_id, upper, ids, block, k)

    found = dealt.repartition("to").sortWithinPartitions("to", "q").mapInArrow(task, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
