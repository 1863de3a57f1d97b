"""Lineage: everything downstream of a node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


class LineageCycle(ValueError):
    """The lineage does not end."""


def downstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth) reachable from `start` (column `node`), which has depth 0.

    Depth is the longest path, so building in order of depth builds a node
    after everything it reads. One join per level; each frontier is cut from
    its lineage, so plans stay small and a lost executor costs one level. A path
    of more edges than there are parents passes a node twice.
    """
    links = cut_lineage(edges.select(F.col("parent").alias("node"), "child").distinct(), "links")
    parents = links.select("node").distinct().count()
    frontier = cut_lineage(start.select("node").distinct())
    levels = []
    while not frontier.isEmpty():
        if len(levels) > parents:
            raise LineageCycle("the lineage is cyclic")
        levels.append(frontier.withColumn("depth", F.lit(len(levels))))
        frontier = cut_lineage(
            links.join(frontier, "node").select(F.col("child").alias("node")).distinct())
    reached = reduce(DataFrame.unionByName, levels) if levels else start.select("node").withColumn("depth", F.lit(0))
    return reached.groupBy("node").agg(F.max("depth").alias("depth"))
