"""File inventories: comparison, mirroring, lifecycle tiers, retention."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import days_before
from .keys import absent


def compare_inventories(left: DataFrame, right: DataFrame, on: str = "path") -> DataFrame:
    """Every path of either side and where it occurs."""
    a = left.select(on).distinct().withColumn("_l", F.lit(True))
    b = right.select(on).distinct().withColumn("_r", F.lit(True))
    return a.join(b, on, "full_outer").select(
        on, F.col("_l").isNotNull().alias("in_left"), F.col("_r").isNotNull().alias("in_right"))


def mirror_plan(source: DataFrame, target: DataFrame, skip_same_size: bool = False) -> DataFrame:
    """(path, action): upload everything the source has, delete what only the target has.

    `skip_same_size` leaves out uploads whose size agrees on both sides.
    """
    a = source.groupBy("path").agg(F.max("size").alias("_ls"), F.lit(True).alias("_l"))
    b = target.groupBy("path").agg(F.max("size").alias("_rs"), F.lit(True).alias("_r"))
    both = a.join(b, "path", "full_outer")
    action = F.when(F.col("_l").isNull(), "delete")
    if skip_same_size:
        action = action.when(F.col("_r").isNotNull() & (F.col("_ls") == F.col("_rs")), "skip")
    return both.select("path", action.otherwise("upload").alias("action"))


def parents_of(path: Column, sep: str = "/") -> Column:
    """All folders above a path, outermost first; empty for a top-level file."""
    parts = F.split(path, rf"\Q{sep}\E")
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), sep)),
    ).otherwise(F.array().cast("array<string>"))


def missing_dirs(source: DataFrame, existing: DataFrame) -> DataFrame:
    """Folders to create before uploading; create them in order of `depth`."""
    folders = source.select(F.explode(parents_of(F.col("path"))).alias("path")).distinct()
    return absent(folders, existing, ["path"]).withColumn(
        "depth", F.size(F.split("path", "/")))


def lifecycle(inventory: DataFrame, policy: Mapping[str, int | None], now: Column) -> DataFrame:
    """(path, tier) of objects older than a threshold of `policy` (`cool`, `archive`, `delete`, in days).

    Strictly more than N calendar days. Base objects age from their last
    modification, snapshots and versions (`kind`) from their creation. Without
    any threshold nothing moves.
    """
    born = F.when(F.col("kind") == "base", F.col("modified")).otherwise(F.col("created"))
    age = F.datediff(now.cast("date"), born.cast("date"))
    tier = F.lit(None).cast("string")
    for name in ("cool", "archive", "delete"):
        days = policy.get(name)
        if days is not None:
            tier = F.when(age > days, name).otherwise(tier)
    return inventory.withColumn("tier", tier).where(F.col("tier").isNotNull())


def retain(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows of the last `days` days; a range filter the scan can prune by."""
    return df.where(F.col(ts) >= days_before(now, days))
