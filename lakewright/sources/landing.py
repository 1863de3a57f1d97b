"""Landing area: discovery, path parsing, pre-processing, staging, archiving."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from ..constants import LANDING_PREFIX
from ..functions.text import strip_slashes
from ..session import cut_lineage

HEADER_BYTES = 1 << 20

# The schema the binary file source insists on.
FILE_COLUMNS = StructType([
    StructField("path", StringType(), False), StructField("modificationTime", TimestampType(), False),
    StructField("length", LongType(), False), StructField("content", BinaryType(), True)])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, size) of the files below `root`, none where there is no such folder; content is never read.

    Spark lists no empty files here; `list_tree` does.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "path string, modified timestamp, size bigint")
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    )


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to `root`, size) of all files, empty ones too.

    Level by level: tasks list the folders of a level, each its own children
    only, and the next level is what they found. So no task walks a whole tree.
    """
    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        from ._files import frame, open_uri

        files, base = open_uri(root)
        for batch in batches:
            for folder in batch["path"]:
                found = files.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
                yield frame(path=[i.path[len(base) + 1:] for i in found], size=[i.size or 0 for i in found],
                            is_dir=[i.type == fs.FileType.Directory for i in found])

    levels, folders = [], spark.createDataFrame([("",)], "path string")
    while True:
        level = cut_lineage(folders.mapInPandas(children, "path string, size bigint, is_dir boolean"), "tree")
        levels.append(level.where(~F.col("is_dir")).select("path", "size"))
        folders = level.where("is_dir").select("path").repartition(F.col("path"))
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def nonempty_below(listing: DataFrame, prefix: str = LANDING_PREFIX) -> DataFrame:
    """Files worth ingesting: not empty, and below the landing prefix."""
    return listing.where((F.col("size") > 0) & F.col("path").startswith(prefix))


def landing_files(spark: SparkSession, root: str, prefix: str = LANDING_PREFIX) -> DataFrame:
    """Non-empty files below `root`/`prefix`, with paths relative to `root`. Nothing outside the prefix is listed."""
    base = root.rstrip("/") + "/"
    relative = F.substr(F.col("path"), F.locate(base, F.col("path")) + len(base))
    return nonempty_below(list_files(spark, base + prefix).withColumn("path", relative), prefix)


def parse_landing_path(df: DataFrame, column: str = "path", has_file: bool = True) -> DataFrame:
    """Add source, table_name, file_name and `path_ok`.

    A leading `raw/` and outer slashes go; what is left must be source and
    table (and a file, with `has_file`). Any other depth is not ok and leaves
    the three columns NULL.
    """
    parts = F.split(strip_slashes(F.regexp_replace(F.col(column), "^/*raw/", "")), "/")
    ok = (F.size(parts) == (3 if has_file else 2)) & ~F.array_contains(parts, "")

    def part(i: int) -> Column:
        return F.when(ok, F.get(parts, F.lit(i)))

    out = df.withColumns({"source": part(0), "table_name": part(1)})
    if has_file:
        out = out.withColumn("file_name", part(2))
    return out.withColumn("path_ok", ok)


def new_files(listing: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files not recorded yet for their source."""
    return listing.join(known.select(*keys).distinct(), list(keys), "left_anti")


# --- pre-processing -----------------------------------------------------------

Hook = Callable[[DataFrame], DataFrame]


class HookRegistry:
    """Optional transformation per (source, table), applied to raw rows before staging."""

    def __init__(self) -> None:
        self._hooks: dict[tuple[str, str], Hook] = {}

    def register(self, source: str, table: str) -> Callable[[Hook], Hook]:
        def add(hook: Hook) -> Hook:
            if (source, table) in self._hooks:
                raise ValueError(f"a pre-process hook for {source}.{table} exists already")
            self._hooks[(source, table)] = hook
            return hook
        return add

    def apply(self, df: DataFrame, source: str, table: str) -> DataFrame:
        hook = self._hooks.get((source, table))
        return hook(df) if hook else df


# --- staging ------------------------------------------------------------------

def read_raw_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """CSV files with a header as text columns plus `file_name` and `file_path`.

    The header itself is checked by `read_headers` and `compare_schema`; the
    reader would silently skip a column it does not know.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (
        spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true")
        .option("enforceSchema", "false").csv(paths)
        .select(*columns, decoded(F.col("_metadata.file_name")).alias("file_name"),
                F.col("_metadata.file_path").alias("file_path"))
    )


def decoded(name: Column) -> Column:
    """File names in metadata columns are percent-encoded; a plus sign is itself."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def literal_path(path: str) -> str:
    """A path the reader takes as it is, without wildcards."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def read_headers(files: DataFrame) -> DataFrame:
    """(path, column_name, column_type, position) from the first line of each file in `path`.

    Text in another encoding gives names that no declaration has, and so does a
    first line of more than HEADER_BYTES; neither keeps other files from being read.

    Tasks open the files and read up to the first line end; listing by size
    has spread the files over the tasks already.
    """
    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        from ._files import frame, open_uri

        def names(path: str) -> list[str]:
            files, name = open_uri(path)
            text = b""
            with files.open_input_stream(name) as stream:
                while b"\n" not in text and len(text) < HEADER_BYTES and (block := stream.read(8192)):
                    text += block
            return next(csv.reader([text.split(b"\n", 1)[0].decode("utf-8-sig", "replace").rstrip("\r")]), [])

        for batch in batches:
            yield frame(path=batch["path"], names=[names(p) for p in batch["path"]])

    heads = files.select("path").mapInPandas(first_lines, "path string, names array<string>")
    return heads.select("path", F.posexplode("names").alias("position", "column_name")).select(
        "path", "column_name", F.lit("string").alias("column_type"), "position")


def rows_read(staged: DataFrame, by: str = "_ingest_id") -> DataFrame:
    return staged.groupBy(by).agg(F.count("*").alias("rows_read"))


# --- archiving ----------------------------------------------------------------

def archive_plan(files: DataFrame, archive_root: str, prefix: str = LANDING_PREFIX, keep: Sequence[str] = ()) -> DataFrame:
    """(src, dst, `keep`): every landed file to the same place below the archive."""
    below = F.regexp_replace("path", f"^/*{prefix}", "")
    return files.select(F.col("path").alias("src"),
                        F.concat(F.lit(archive_root.rstrip("/") + "/"), below).alias("dst"), *keep)


def move_files(plan: DataFrame) -> DataFrame:
    """Carry out an archive plan in the tasks; (src, dst, status).

    A file that is already at its destination counts as moved, so a retried
    task or a repeated run changes nothing.
    """
    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        from ._files import frame, open_uri

        def one(src: str, dst: str) -> str:
            files, source = open_uri(src)
            _, target = open_uri(dst)
            there, gone = (files.get_file_info([target, source])[i].type for i in (0, 1))
            if gone == fs.FileType.NotFound:
                return "moved" if there != fs.FileType.NotFound else "lost"
            files.create_dir(target.rsplit("/", 1)[0], recursive=True)
            files.move(source, target)
            return "moved"

        for batch in batches:
            yield frame(src=batch["src"], dst=batch["dst"],
                        status=[one(s, d) for s, d in zip(batch["src"], batch["dst"])])

    return plan.select("src", "dst").mapInPandas(move, "src string, dst string, status string")


def content_digests(files: DataFrame) -> DataFrame:
    """(path, digest): the SHA-256 of each file's bytes, read by the tasks in blocks; NULL for a file that is gone."""
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from ._files import frame, open_uri

        def one(path: str) -> str | None:
            files, name = open_uri(path)
            digest = hashlib.sha256()
            try:
                with files.open_input_stream(name, compression=None) as stream:
                    while block := stream.read(1 << 20):
                        digest.update(block)
            except FileNotFoundError:
                return None
            return digest.hexdigest()

        for batch in batches:
            yield frame(path=batch["path"], digest=[one(p) for p in batch["path"]])

    return files.select("path").mapInPandas(hashed, "path string, digest string")
