"""Sorted name lists whose size in one task stays bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .keys import absent
from .ranking import positions

#: Names in one row.
PART_NAMES = 10_000


def name_lists(df: DataFrame, by: Sequence[str], name: str, out: str, part_names: int = PART_NAMES) -> DataFrame:
    """Sorted arrays of the distinct names of each group, `part_names` in each row.

    Repeats are removed first. The rows of a group follow each other in column
    `part`, from 0: all names of one come before those of the next.
    """
    by = list(by)
    placed = positions(df.select(*by, name).distinct(), by, [name], "_at")
    part = F.floor((F.col("_at") - 1) / part_names).cast("bigint")
    return (placed.withColumn("part", part).groupBy(*by, "part")
            .agg(F.array_sort(F.collect_list(name)).alias(out)))


def sorted_names(df: DataFrame, by: Sequence[str], name: str, sep: str = ", ", out: str = "names") -> DataFrame:
    return (
        name_lists(df, by, name, "_names")
        .select(*by, "part", F.array_join("_names", sep).alias(out))
    )


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct rows of `a` whose `on` columns do not occur in `b`; NULL matches NULL."""
    return absent(a.select(*on).distinct(), b, on, null_safe=True)
