"""Ordered history per key, safe for keys that hold most of the rows.

A plain `lag` over a key sends all rows of that key to one task. Here rows are
dealt to ranges of key and order together, so a range is as large as any other
whatever the keys are. Inside a range the window runs as usual; the one row
before it comes from a summary with one row per range, added to the range as a
marker row if it has the same key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

PART, AT = "_part", "_at"


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
              forward: bool = False) -> DataFrame:
    """Add `value` of the previous (or, `forward`, the next) row of the key as `out`.

    `order` must be total within a key. NULL means there is no such row, so
    pass a struct when values may be NULL.
    """
    keys, order = list(keys), list(order)
    shift, edge, along = (F.lead, F.min_by, F.col(PART).desc()) if forward else (F.lag, F.max_by, F.col(PART))
    valued = df.withColumn("_value", value)
    # Ranges of keys and order together: a key with most of the rows is cut wherever it has to be.
    ranged = cut_lineage(valued.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")
    place = F.struct(*keys, *order)
    # The row next to a range's edge, one per range.
    ends = ranged.groupBy(PART).agg(edge(F.struct(*keys, "_value"), place).alias(AT))
    across = ends.withColumn(AT, F.lag(AT).over(Window.orderBy(along)))
    own = ranged.groupBy(PART).agg((F.max_by if forward else F.min_by)(F.struct(*keys), place).alias("_first"))
    markers = across.join(own, PART).where(
        reduce(and_, [F.col(f"{AT}.{k}").eqNullSafe(F.col(f"_first.{k}")) for k in keys])).select(
        PART, *[F.col(f"{AT}.{k}").alias(k) for k in keys], F.col(f"{AT}._value").alias("_value"),
        F.lit(1 if forward else -1).alias("_side"))
    inside = Window.partitionBy(PART, *keys).orderBy("_side", *order)
    return (
        ranged.withColumn("_side", F.lit(0)).unionByName(markers, allowMissingColumns=True)
        .withColumn(out, shift("_value").over(inside))
        .where(F.col("_side") == 0)
        .select(*df.columns, out))


def scd2(
    df: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Version history: a row per change of the tracked columns.

    `order[0]` is the effective time, the rest breaks ties.
    """
    state = F.struct(*tracked)
    seen = neighbour(df, keys, order, state, "_before")
    versions = seen.where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state))
    dated = neighbour(
        versions.select(*dict.fromkeys([*keys, *tracked, *order])),
        keys, order, F.struct(F.col(order[0]).alias("at")), "_next", forward=True)
    return dated.select(
        *dict.fromkeys([*keys, *tracked]),
        *[c for c in order[1:] if c not in keys],
        F.col(order[0]).alias("valid_from"),
        F.col("_next.at").alias("valid_to"),
        F.col("_next").isNull().alias("is_current"),
    )


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by `order`. An aggregate, so hot keys shrink before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def replace(target: DataFrame, latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`target` with the rows of `latest` (one per key) in place of its own; NULL equals NULL in a key."""
    marks = latest.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return target.join(marks, same, "left_anti").unionByName(latest, allowMissingColumns=True)


def merge(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert: rows of `updates` replace rows of `target` with the same key; columns that either side lacks are NULL there."""
    return replace(target, dedupe(updates, keys, order), keys)
