"""Positions in an order without a single-task window, and the layout built on value buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..session import cut_lineage

PART = "_part"


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add the position of each row (from 1) in its group, by `order`, which must be total within a group.

    Rows are dealt to ranges of group and order together, so a large group is
    cut wherever it has to be; a position is the one inside the range plus the
    group's rows in the ranges before, of which there is one count per range.
    """
    by, order = list(by), list(order)
    ranged = cut_lineage(df.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*by, PART).agg(F.count("*").alias("_n")).select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col(PART).alias("_at"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(PART, *by).orderBy(*order)))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col(PART) == F.col("_at"))
    return own.join(counts, same).select(*df.columns, (F.col("_own") + F.col("_before")).cast("bigint").alias(out))


def dense_ranks(df: DataFrame, column: str) -> DataFrame:
    """(`value`, `rank` from 0, `n` distinct values), one row per non-NULL value of `column`."""
    present = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
    values = cut_lineage(present.distinct(), "values")
    total = F.lit(values.count()).cast("bigint")
    return positions(values, [], ["value"], "_at").select("value", (F.col("_at") - 1).alias("rank"), total.alias("n"))


def interleave(buckets: Sequence[Column], bits: int) -> Column:
    """Morton code of non-negative integers below 2**bits."""
    width = len(buckets)
    pieces = [
        F.shiftleft(F.shiftright(b, bit).bitwiseAND(F.lit(1).cast("bigint")), bit * width + i)
        for bit in range(bits)
        for i, b in enumerate(buckets)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), pieces)


def z_values(df: DataFrame, columns: Sequence[str], bits: int = 8, out: str = "z") -> DataFrame:
    """Position of each row on the Z-curve through exact equal-count buckets of `columns`.

    NULL sorts into bucket 0.
    """
    result = df
    for i, column in enumerate(columns):
        ranks = dense_ranks(df, column).select(
            F.col("value").alias(f"_v{i}"),
            F.floor(F.col("rank") * (1 << bits) / F.col("n")).cast("bigint").alias(f"_b{i}"))
        result = result.join(ranks, F.col(column) == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    buckets = [F.coalesce(F.col(f"_b{i}"), F.lit(0).cast("bigint")) for i in range(len(columns))]
    return result.withColumn(out, interleave(buckets, bits)).select(*df.columns, out)


def _number(df: DataFrame, column: str) -> Column:
    """A number in the order of the column; of text the first seven bytes count."""
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, NumericType):
        return value.cast("double")
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    head = F.rpad(F.hex(F.substring(value.cast("string").cast("binary"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("double")


def _bucket(number: Column, cuts: Sequence[float], low: int, high: int) -> Column:
    """How many cut points lie below, by a tree of comparisons."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(number <= cuts[middle], _bucket(number, cuts, low, middle)).otherwise(_bucket(number, cuts, middle + 1, high))


def approximate_buckets(df: DataFrame, columns: Sequence[str], bits: int) -> list[Column]:
    """Bucket numbers below 2**bits of about equal size, from cut points of all columns found in one pass; NULL is in bucket 0."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [_number(df, c) for c in columns]
    found = df.agg(*[F.percentile_approx(n, shares).alias(f"_c{i}") for i, n in enumerate(numbers)]).first()
    cuts = [sorted(set(c or [])) for c in found]
    return [F.coalesce(_bucket(n, c, 0, len(c)), F.lit(0)).cast("bigint") if c else F.lit(0).cast("bigint")
            for n, c in zip([F.coalesce(n, F.lit(float("-inf"))) for n in numbers], cuts)]


def cluster(df: DataFrame, columns: Sequence[str], target_files: int, bits: int = 6) -> DataFrame:
    """Rows laid out along the Z-curve in `target_files` ranges; one pass for cut points, one shuffle.

    The hash behind the Z-value lets rows of one hot position spread over several files.
    """
    return (
        df.withColumn("_z", interleave(approximate_buckets(df, columns, bits), bits))
        .repartitionByRange(target_files, "_z", F.xxhash64(*df.columns))
        .sortWithinPartitions("_z", *columns)
        .drop("_z")
    )
