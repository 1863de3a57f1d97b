"""Derived tables: registry, rebuild in dependency order, documentation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.graph import downstream
from ..sinks.store import TableStore

Inputs = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Model:
    name: str
    inputs: tuple[str, ...]
    build: Callable[[Inputs], DataFrame]
    kind: str = "models"


class ModelRegistry:
    """Models and snapshots by name. Inputs are other models or source tables."""

    def __init__(self) -> None:
        self.models: dict[str, Model] = {}

    def model(self, name: str, inputs: Sequence[str], kind: str = "models"):
        def add(build: Callable[[Inputs], DataFrame]):
            if name in self.models:
                raise ValueError(f"model {name} is registered already")
            self.models[name] = Model(name, tuple(inputs), build, kind)
            return build
        return add

    def edges(self, spark: SparkSession) -> DataFrame:
        rows = [(i, m.name) for m in self.models.values() for i in m.inputs]
        return spark.createDataFrame(rows, "parent string, child string")

    def read(self, store: TableStore, name: str) -> DataFrame:
        area = self.models[name].kind if name in self.models else "source"
        return store.read(f"{area}/{name}")

    def materialise(self, store: TableStore, name: str) -> int:
        """Build one model from the stored state of its inputs and commit it as a new version."""
        model = self.models[name]
        built = model.build({i: self.read(store, i) for i in model.inputs})
        return store.write(f"{model.kind}/{name}", built)

    def propagate(self, spark: SparkSession, store: TableStore, source: str, table: str) -> list[str]:
        """Rebuild everything downstream of a source table, parents first, snapshots after models."""
        start = spark.createDataFrame([(f"{source}/{table}",)], "node string")
        order = downstream(self.edges(spark), start).where("depth > 0")
        # As many rows as there are registered models.
        names = sorted((r.depth, self.models[r.node].kind == "snapshots", r.node) for r in order.collect())
        for _, _, name in names:
            self.materialise(store, name)
        return [name for _, _, name in names]


#: Types of at most 64 bits a value.
NARROW = ("boolean", "tinyint", "smallint", "int", "bigint", "date", "timestamp", "timestamp_ntz")


def hashable(column: str, kind: str) -> Column:
    """The column, or its text where it holds maps, which have no hash."""
    return F.col(f"`{column}`").cast("string") if "map<" in kind else F.col(f"`{column}`")


def document_table(df: DataFrame, table: str, columns: Sequence[str] | None = None,
                   exact: bool = False) -> DataFrame:
    """(table_name, column_name, type, rows, nulls, distinct_values, min_value, max_value) per column; lists have no bounds.

    One pass over the table with approximate distinct counts; `exact` counts
    the distinct values in a second aggregation over (column, 128-bit digest of the value).
    """
    names = list(columns or df.columns)
    types = dict(df.dtypes)
    picks = []
    for i, c in enumerate(names):
        picks += [
            F.count(c).alias(f"_n{i}"),
            *[(f(c).cast("string") if not types[c].startswith(("array", "map")) else F.lit(None).cast("string")).alias(f"_{at}{i}")
              for f, at in ((F.min, "a"), (F.max, "z"))]]
        if not exact:
            picks.append(F.approx_count_distinct(c).alias(f"_d{i}"))
    profile = df.agg(F.count("*").alias("_rows"), *picks)
    per_column = profile.select(F.inline(F.array(*[
        F.struct(
            F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.lit(types[c]).alias("type"),
            F.col("_rows").alias("rows"), (F.col("_rows") - F.col(f"_n{i}")).alias("nulls"),
            *([] if exact else [F.col(f"_d{i}").alias("distinct_values")]),
            F.col(f"_a{i}").alias("min_value"), F.col(f"_z{i}").alias("max_value"))
        for i, c in enumerate(names)])))
    if not exact:
        return per_column
    # Two 64-bit hashes stand for a value, so that no text is shuffled; one is enough where it takes a value of 64 bits.
    values = df.select(F.explode(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(
            F.lit(c).alias("column_name"), F.xxhash64(F.lit(1), hashable(c, types[c])).alias("a"),
            (F.lit(0).cast("bigint") if types[c] in NARROW else F.xxhash64(F.lit(2), hashable(c, types[c]))).alias("b")))
        for c in names])).alias("p")).where("p is not null")
    counts = (
        values.select("p.*").distinct()
        .groupBy("column_name").agg(F.count("*").alias("distinct_values")))
    return per_column.join(counts, "column_name", "left").select(
        "table_name", "column_name", "type", "rows", "nulls",
        F.coalesce("distinct_values", F.lit(0).cast("bigint")).alias("distinct_values"), "min_value", "max_value")


def document_tables(specs: Mapping[str, Mapping[str, str]], tables: Mapping[str, DataFrame], exact: bool = False) -> DataFrame:
    """Profiles of all tables with the declared type beside the actual one."""
    out = None
    for name, df in tables.items():
        declared = specs.get(name, {})
        pairs = [x for c, t in declared.items() for x in (F.lit(c), F.lit(t))]
        wanted = F.try_element_at(F.create_map(*pairs), F.col("column_name")) if pairs else F.lit(None).cast("string")
        doc = document_table(df, name, exact=exact).withColumn("declared_type", wanted)
        out = doc if out is None else out.unionByName(doc)
    return out
