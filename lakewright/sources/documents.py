"""Nested JSON documents: reading, addressing, projecting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STEPS = "steps array<struct<op: string, urn: string>>"
RESOURCES = (
    "deployment struct<resources: array<struct<urn: string, type: string, "
    "dependencies: array<string>, property_dependencies: map<string, array<string>>>>>"
)


@dataclass(frozen=True)
class Field:
    """An output: where it lies, for which environments, and whether a document without it is wrong."""
    name: str
    path: str
    environments: tuple[str, ...] | None = None
    required: bool = False


def read_json_docs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per document; documents may span lines."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def parse_docs(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Documents held as text, opened to the fields of `schema`."""
    return df.withColumn("_doc", F.from_json(column, schema)).select(
        *[c for c in df.columns if c != column], "_doc.*")


def project_outputs(docs: DataFrame, fields: Sequence[Field], doc: str = "doc", env: str = "env",
                    on_missing: str = "raise") -> DataFrame:
    """Nested outputs as one flat row per environment document, by fields that the caller declares.

    A field of other environments is NULL, as is one that is not there. `on_missing` is
    `raise` or `report` (column `problem`) for missing required ones. Paths that share a
    first step are looked up in that subtree, which is taken out once.
    """
    roots = list(dict.fromkeys(_steps(f.path)[0] for f in fields))
    keep = [c for c in docs.columns if c != doc]
    opened = docs.withColumn("_parsed", F.try_parse_json(doc)).select(
        *keep, *[F.try_variant_get("_parsed", f"$.{r}", "variant").alias(f"_r{i}") for i, r in enumerate(roots)])

    def value(field: Field, kind: str) -> Column:
        first, rest = _steps(field.path)
        return F.try_variant_get(f"_r{roots.index(first)}", "$" + rest, kind)

    def meant(field: Field) -> Column:
        return F.lit(True) if field.environments is None else F.col(env).isin(*field.environments)

    absent = F.array_compact(F.array(*[
        F.when(meant(f) & value(f, "variant").isNull(), F.lit(f.path)) for f in fields if f.required]).cast("array<string>"))
    problem = F.when(F.size(absent) > 0, F.concat(F.lit("missing "), F.array_join(absent, ", ")))
    out = opened.select(*keep, *[F.when(meant(f), value(f, "string")).alias(f.name) for f in fields], problem.alias("problem"))
    if on_missing == "report":
        return out
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem"))).otherwise(F.col(fields[0].name))
    return out.withColumn(fields[0].name, checked.cast("string")).drop("problem")


def _steps(path: str) -> tuple[str, str]:
    """The first step of `$.a.b.c`, and the rest with its dots."""
    first, dot, rest = path.removeprefix("$.").partition(".")
    return first, dot + rest


def filter_steps(docs: DataFrame, op: str, kind: str, steps: str = "steps") -> DataFrame:
    """`--target <urn>` for each step with this operation whose urn contains `kind`; repeats stay."""
    keep = [c for c in docs.columns if c != steps]
    return (
        docs.select(*keep, F.explode(steps).alias("step"))
        .where((F.col("step.op") == op) & F.col("step.urn").contains(kind))
        .select(*keep, F.format_string("--target %s", "step.urn").alias("target"))
    )
