"""Which keys of one side the other side does not have."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F


def absent(keys: DataFrame, known: DataFrame, on: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of `keys` without a match in `known`.

    For sides that were aggregated to one row per key first. The optimizer
    moves an anti join below such an aggregate, and would then shuffle all rows
    of a hot key instead of one; an outer join with a test for NULL stays above.
    """
    marks = known.select(*[F.col(c).alias(f"_m_{c}") for c in on]).distinct().withColumn("_known", F.lit(True))
    match = reduce(and_, [
        F.col(c).eqNullSafe(F.col(f"_m_{c}")) if null_safe else F.col(c) == F.col(f"_m_{c}") for c in on])
    return keys.join(marks, match, "left").where(F.col("_known").isNull()).select(*keys.columns)
