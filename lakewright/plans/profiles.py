"""Stored profiles of tables, folded from their partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sinks.store import TableStore
from .models import hashable

PARTITION = "_partition"
#: Types that have neither an order nor a text that can be read back.
BOUNDLESS = ("array", "map", "struct", "binary", "variant", "interval")


class Profiles:
    """Profiles of tables in a store, one stored row a column and partition.

    A row has counts, bounds and a sketch of the distinct values, so partitions
    fold into the profile of the whole table without its rows: a partition that
    is added or replaced is the only one that is read. Counts and bounds are
    exact; distinct counts have the sketch's relative error of about
    1.04 / sqrt(2 ** `precision`). A sketch has 2 ** `precision` bytes.
    """

    def __init__(self, store: TableStore, name: str = "profiles", precision: int = 14) -> None:
        self.store, self.name, self.precision = store, name, precision

    def add(self, table: str, rows: DataFrame, partition: str, columns: Sequence[str] | None = None) -> None:
        """Profile the partitions in `rows`, in one pass; each replaces its earlier profile.

        `partition` names the column of plain names that says where a row
        belongs. Rows of one partition are aggregated before they are shuffled.
        """
        names = [c for c in (columns or rows.columns) if c != partition]
        types = dict(rows.dtypes)
        picks = []
        for i, c in enumerate(names):
            column, kind = F.col(f"`{c}`"), types[c]
            bounded = not kind.startswith(BOUNDLESS)
            # Sketches take whole numbers, text and bytes; a digest stands for any other value.
            value = column if kind in ("int", "bigint", "string") else F.xxhash64(hashable(c, kind))
            picks += [
                F.count(column).alias(f"_n{i}"),
                F.hll_sketch_agg(F.when(column.isNotNull(), value), F.lit(self.precision)).alias(f"_d{i}"),
                (F.min(column).cast("string") if bounded else F.lit(None).cast("string")).alias(f"_a{i}"),
                (F.max(column).cast("string") if bounded else F.lit(None).cast("string")).alias(f"_z{i}")]
        profile = rows.groupBy(F.col(partition).cast("string").alias("_p")).agg(F.count("*").alias("_rows"), *picks)
        self.store.append(self.name, profile.select(
            F.concat(F.lit(f"{table}."), F.col("_p")).alias(PARTITION),
            F.inline(F.array(*[
                F.struct(
                    F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.lit(types[c]).alias("type"),
                    F.lit(i).alias("position"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("present"),
                    F.col(f"_d{i}").alias("sketch"), F.col(f"_a{i}").alias("low"), F.col(f"_z{i}").alias("high"))
                for i, c in enumerate(names)]))), PARTITION)

    def drop(self, table: str, partitions: DataFrame) -> None:
        """Forget partitions that their table has lost; `partitions` has one column of names."""
        self.store.drop_ingest(self.name, partitions.select(
            F.concat(F.lit(f"{table}."), F.col(partitions.columns[0]).cast("string")).alias(PARTITION)), PARTITION)

    def document(self) -> DataFrame:
        """(table_name, column_name, type, partitions, rows, nulls, distinct_values, min_value, max_value).

        A column that partitions hold with two types has a row for each.
        """
        stored = self.store.read_appended(self.name, PARTITION)
        # As many types as the declarations use; bounds compare as values, not as texts.
        kinds = sorted(r[0] for r in stored.select("type").distinct().collect() if not r[0].startswith(BOUNDLESS))
        folded = stored.groupBy("table_name", "column_name", "type").agg(
            F.count("*").alias("partitions"), F.sum("rows").alias("rows"), F.sum(F.col("rows") - F.col("present")).alias("nulls"),
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"),
            *[pick(side, F.when(F.col("type") == kind, F.expr(f"cast({side} as {kind})"))).alias(f"_{side}{i}")
              for i, kind in enumerate(kinds) for side, pick in (("low", F.min_by), ("high", F.max_by))])

        def bound(side: str) -> Column:
            return F.coalesce(F.lit(None).cast("string"), *[
                F.when(F.col("type") == kind, F.col(f"_{side}{i}")) for i, kind in enumerate(kinds)])
        return folded.select(
            "table_name", "column_name", "type", "partitions", "rows", "nulls", "distinct_values",
            bound("low").alias("min_value"), bound("high").alias("max_value"))
