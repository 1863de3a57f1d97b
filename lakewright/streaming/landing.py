"""Landing folder as a stream, and ingestion driven by it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.landing import FILE_COLUMNS


def file_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """(path, file_name, folder_path, size) of each non-empty file once, as it appears; content is not read.

    A file that was moved before its batch was read (a batch that comes again) is left out.
    """
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        reader.schema(FILE_COLUMNS).load(root)
        .where(F.col("length") > 0)
        .select(
            F.col("path"),
            F.substring_index("path", "/", -1).alias("file_name"),
            F.regexp_replace("path", "/[^/]*$", "").alias("folder_path"),
            F.col("length").alias("size"))
    )


def row_stream(spark: SparkSession, root: str, columns: Sequence[str], max_files: int | None = None) -> DataFrame:
    """Rows of landed CSV files as text columns plus `file_path`."""
    reader = (
        spark.readStream.schema(", ".join(f"`{c}` string" for c in columns))
        .option("header", "true").option("recursiveFileLookup", "true"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(root).select(*columns, F.col("_metadata.file_path").alias("file_path"))


def ingest_stream(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                  available_now: bool = True, interval: str = "30 seconds") -> StreamingQuery:
    """One query, so one run at a time; `handle(batch, batch_id)` must be repeatable.

    Outputs keyed by `batch_id` (or by ingest id) make a replayed batch replace itself.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (
        source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start())
