"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakewright.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """`node`, `root` (the smallest node reachable) for every node that has an edge.

    edges: two long columns, in either direction, with repeats. Each round
    joins neighbours with the smallest one of their node, so a hub's rows
    are spread by adaptive execution; rounds grow with the logarithm of the
    longest path. Rows with a null and loops take no part.
    """
    a, b = (F.col(c) for c in edges.columns)
    pairs = _stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where(a.isNotNull() & b.isNotNull() & (a != b)))
    mark = _mark(pairs)
    while True:
        pairs = _stored(_small_star(_large_star(pairs)))
        before, mark = mark, _mark(pairs)
        if mark == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stored(pairs: DataFrame) -> DataFrame:
    return cut_lineage(pairs.distinct(), "stars")


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    onward = (pairs.join(least, "u").where(F.col("v") != F.col("m"))
              .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return onward.unionByName(least.select("u", F.col("m").alias("v")))
