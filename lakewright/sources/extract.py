"""Scheduled pulls from external systems into the landing area."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from .layout import Layout


def extract_jdbc(spark: SparkSession, options: Mapping[str, str], partition_column: str | None = None,
                 lower: str | None = None, upper: str | None = None, partitions: int = 1) -> DataFrame:
    """A relational table, read in `partitions` parallel ranges of `partition_column`."""
    reader = spark.read.format("jdbc").options(**options)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(lower),
                                upperBound=str(upper), numPartitions=str(partitions))
    return reader.load()


def extract_files(spark: SparkSession, path: str, fmt: str, schema: str | None = None, **options: str) -> DataFrame:
    """Files of another store; a declared schema avoids a pass for inference."""
    reader = spark.read.format(fmt).options(recursiveFileLookup="true", **options)
    return (reader.schema(schema) if schema else reader).load(path)


def land(df: DataFrame, layout: Layout, source: str, table: str, run: str) -> str:
    """Write one extraction as text files below `raw/<source>/<table>/`; the run id keeps it repeatable."""
    path = layout.path("raw", source, table, run)
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.mode("overwrite").option(
        "header", "true").csv(path)
    return path
