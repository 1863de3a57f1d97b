"""Lake tables on plain parquet.

Append tables keep one partition directory per ingest id and overwrite it
dynamically, so a repeated append replaces itself. Their schema lies beside
them and grows with the columns that appends bring.

Versioned tables are a list of directories; a small numbered commit file holds
the list, the schema and the number of buckets, and makes a version current.
Readers always see one whole version. A merge spreads rows over buckets of the
key and rewrites only the buckets its updates fall into; the new version shares
all other directories with the old one. Folders of a version have names of
their own, so a second writer never touches what a first one wrote.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField,
    StructType)

from ..operators.history import dedupe, replace
from ..operators.ranking import cluster
from ..session import cut_lineage

INGEST_ID = "_ingest_id"
BUCKET = "_bucket"
PLAIN_ID = re.compile(r"[A-Za-z0-9_.-]+")


class CommitConflict(RuntimeError):
    """Another writer committed the same version first."""


class SchemaConflict(ValueError):
    """A column comes with a type that the table's type does not hold."""


_WIDTHS = ((ByteType, ShortType, IntegerType, LongType), (FloatType, DoubleType))


def _holds(kept: DataType, new: DataType) -> bool:
    """Whether every value of `new` is one of `kept`."""
    if isinstance(kept, DecimalType) and isinstance(new, DecimalType):
        return kept.scale >= new.scale and kept.precision - kept.scale >= new.precision - new.scale
    return kept == new or any(
        type(kept) in kinds and type(new) in kinds and kinds.index(type(new)) <= kinds.index(type(kept)) for kinds in _WIDTHS)


def grown(kept: StructType | None, new: StructType) -> StructType:
    """The table's columns, then those that only `new` has; narrower types are widened, wider ones refused."""
    if kept is None:
        return StructType([StructField(f.name, f.dataType) for f in new])
    known = {f.name: f.dataType for f in kept}
    for field in new:
        if field.name in known and not _holds(known[field.name], field.dataType):
            raise SchemaConflict(
                f"column {field.name}: {field.dataType.simpleString()} does not fit {known[field.name].simpleString()}")
    return StructType([*kept, *(StructField(f.name, f.dataType) for f in new if f.name not in known)])


def fitted(df: DataFrame, schema: StructType) -> DataFrame:
    """`df` with exactly the columns of `schema`; missing ones are NULL."""
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


class TableStore:
    """Tables below one folder. There is one writer per table, as there is one ingestion at a time.

    `buckets` sizes merges: a table of T bytes rewrites T / `buckets` per bucket
    that an update touches. It counts for tables that have no buckets yet; a
    table keeps the number that it was first merged with.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    # -- paths ------------------------------------------------------------

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, table: str) -> bool:
        target, fs = self._hadoop(self.path(table))
        return fs.exists(target)

    # -- append tables ----------------------------------------------------

    def append(self, table: str, df: DataFrame, ingest_id: str = INGEST_ID, gather: bool = True) -> None:
        """Write the partitions named by `ingest_id`; a retry replaces them.

        `gather` collects each id into few files and splits an id that is too
        large for one task. Rows that share one id need no such shuffle.
        """
        kept = self._append_schema(table)
        schema = grown(kept, StructType([f for f in df.schema if f.name != ingest_id]))
        whole = StructType([*schema, StructField(ingest_id, StringType())])
        rows = fitted(df, whole)
        rows = rows.hint("rebalance", F.col(ingest_id)) if gather else rows
        if kept != schema:
            self._note(f"{self.path(table)}/_schema", self._newest(f"{self.path(table)}/_schema") + 1, schema.jsonValue())
        (
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(ingest_id).parquet(f"{self.path(table)}/data")
        )

    def _append_schema(self, table: str) -> StructType | None:
        folder = f"{self.path(table)}/_schema"
        newest = self._newest(folder)
        return StructType.fromJson(self._noted(folder, newest)) if newest else None

    def read_appended(self, table: str, ingest_id: str = INGEST_ID) -> DataFrame:
        """All partitions; columns that an append lacks are NULL. Ids are text even where they look like numbers or dates."""
        schema = self._append_schema(table)
        return self.spark.read.schema(StructType([*schema, StructField(ingest_id, StringType())])).parquet(
            f"{self.path(table)}/data")

    def read_batches(self, table: str, ids: DataFrame, ingest_id: str = INGEST_ID) -> DataFrame:
        """Partitions named in `ids`, and no others. Their names pass through the driver, which lists all partitions anyway."""
        named = [row[0] for row in ids.select(ingest_id).distinct().collect()]
        return self.read_appended(table, ingest_id).where(F.col(ingest_id).isin(named))

    def has_appended(self, table: str) -> bool:
        target, fs = self._hadoop(f"{self.path(table)}/data")
        return fs.exists(target) and any("=" in s.getPath().getName() for s in fs.listStatus(target))

    def drop_ingest(self, table: str, ids: DataFrame, ingest_id: str = INGEST_ID) -> None:
        """Remove whole partitions; ids arrive one by one, so their number does not matter."""
        for row in ids.select(ingest_id).distinct().toLocalIterator():
            if not PLAIN_ID.fullmatch(row[0]):
                raise ValueError(f"ingest id '{row[0]}' is not a plain name")
            target, fs = self._hadoop(f"{self.path(table)}/data/{ingest_id}={row[0]}")
            fs.delete(target, True)

    # -- versioned tables -------------------------------------------------

    def version(self, table: str) -> int:
        """Current version, 0 before the first commit."""
        return self._newest(f"{self.path(table)}/_commits")

    def _commit_of(self, table: str, version: int) -> dict:
        """`parts` (directories, as many as buckets at most), `schema`, `buckets` (None before a merge)."""
        return self._noted(f"{self.path(table)}/_commits", version)

    def _parts(self, table: str, version: int) -> list[str]:
        return self._commit_of(table, version)["parts"]

    def _read_parts(self, table: str, parts: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path(table)}/{p}" for p in parts])

    def read(self, table: str) -> DataFrame:
        commit = self._commit_of(table, self.version(table))
        return self._read_parts(table, commit["parts"], StructType.fromJson(commit["schema"]))

    def write(self, table: str, df: DataFrame) -> int:
        """Replace the content; the previous version stays readable until it is vacuumed."""
        version = self.version(table) + 1
        name = _folder_name(version)
        df.write.parquet(f"{self.path(table)}/{name}")
        self._commit(table, version, [name], grown(None, df.schema), None)
        return version

    def _bucket_of(self, keys: Sequence[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(self, table: str, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> int:
        """Upsert by key; NULL equals NULL in a key. Repeating a merge gives the same table.

        Columns that only the updates have are added, and are NULL in other
        rows; columns that the updates lack become NULL in the rows they
        replace. The first merge into a table that has no buckets yet rewrites it.
        """
        old = self.version(table)
        commit = self._commit_of(table, old) if old else {"parts": [], "schema": None, "buckets": None}
        schema = grown(StructType.fromJson(commit["schema"]) if old else None, updates.schema)
        buckets = commit["buckets"] or self.buckets
        bucketed = {int(p.rsplit("=", 1)[1]): p for p in commit["parts"]} if commit["buckets"] else {}
        plain = [] if commit["buckets"] else commit["parts"]
        # Typed like the table, so that equal keys hash alike, and written once for the passes over it.
        latest = cut_lineage(fitted(dedupe(updates, keys, order), schema).withColumn(BUCKET, self._bucket_of(keys, buckets)), "updates")
        touched = {r[0] for r in latest.select(BUCKET).distinct().collect()}
        rewritten = plain + [p for b, p in bucketed.items() if b in touched]
        merged = latest
        if rewritten:
            kept = replace(self._read_parts(table, rewritten, schema), latest.drop(BUCKET), keys)
            merged = kept.withColumn(BUCKET, self._bucket_of(keys, buckets))
        version = old + 1
        name = _folder_name(version)
        folder = f"{self.path(table)}/{name}"
        merged.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(folder)
        untouched = [p for b, p in bucketed.items() if b not in touched]
        self._commit(table, version, untouched + [f"{name}/{d}" for d in self._folders(folder)], schema, buckets)
        return version

    def read_touched(self, table: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """The buckets of a merged table that the keys of `rows` fall into, and no others."""
        commit = self._commit_of(table, self.version(table))
        schema = StructType.fromJson(commit["schema"])
        if not commit["buckets"]:
            return self._read_parts(table, commit["parts"], schema)
        typed = fitted(rows, StructType([f for f in schema if f.name in keys]))
        touched = {r[0] for r in typed.select(self._bucket_of(keys, commit["buckets"])).distinct().collect()}
        parts = [p for p in commit["parts"] if int(p.rsplit("=", 1)[1]) in touched]
        return self._read_parts(table, parts, schema) if parts else self.spark.createDataFrame([], schema)

    def show_as(self, table: str, view: str) -> None:
        """Make the catalogue's `view` show exactly the current version; repeat it after a commit."""
        commit = self._commit_of(table, self.version(table))
        paths = ",".join(commit["parts"])
        self.spark.sql(f"DROP TABLE IF EXISTS {view}")  # an external table: its files stay
        self.spark.catalog.createTable(view, path=f"{self.path(table)}/{{{paths}}}", source="parquet",
                                       schema=StructType.fromJson(commit["schema"]))

    def _folders(self, path: str) -> list[str]:
        target, fs = self._hadoop(path)
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(target)) if n.startswith(f"{BUCKET}="))

    def optimize(self, table: str, columns: Sequence[str], target_files: int) -> int:
        """Rewrite the current version clustered by `columns`; a table that has buckets keeps them, each clustered by itself.

        `target_files` counts for tables without buckets.
        """
        old = self.version(table)
        commit = self._commit_of(table, old)
        if not commit["buckets"]:
            return self.write(table, cluster(self.read(table), columns, target_files))
        # The directory names the bucket, so the keys of the merge need not be known.
        bucket = F.regexp_extract(F.col("_metadata.file_path"), f"/{BUCKET}=(\\d+)/", 1).cast("int")
        rows = self.read(table).withColumn(BUCKET, bucket)
        name = _folder_name(old + 1)
        folder = f"{self.path(table)}/{name}"
        (rows.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, *columns)
         .write.partitionBy(BUCKET).parquet(folder))
        self._commit(table, old + 1, [f"{name}/{d}" for d in self._folders(folder)],
                     StructType.fromJson(commit["schema"]), commit["buckets"])
        return old + 1

    def vacuum(self, table: str, keep: int = 2) -> None:
        """Drop what only versions before the last `keep` use; not while readers use them."""
        current = self.version(table)
        first = max(1, current - keep + 1)
        needed = {p for v in range(first, current + 1) for p in self._parts(table, v)}
        for old in range(1, first):
            commit, fs = self._hadoop(f"{self.path(table)}/_commits/{old:08d}")
            if not fs.exists(commit):
                continue
            for part in self._parts(table, old):
                if part not in needed:
                    target, fs = self._hadoop(f"{self.path(table)}/{part}")
                    fs.delete(target, True)
            fs.delete(commit, False)

    def _commit(self, table: str, version: int, parts: list[str], schema: StructType, buckets: int | None) -> None:
        self._note(f"{self.path(table)}/_commits", version,
                   {"parts": parts, "schema": schema.jsonValue(), "buckets": buckets})

    # -- small numbered files ------------------------------------------------

    def _newest(self, folder: str) -> int:
        target, fs = self._hadoop(folder)
        if not fs.exists(target):
            return 0
        names = (s.getPath().getName() for s in fs.listStatus(target))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _noted(self, folder: str, number: int):
        target, fs = self._hadoop(f"{folder}/{number:08d}")
        stream = fs.open(target)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _note(self, folder: str, number: int, content) -> None:
        target, fs = self._hadoop(f"{folder}/{number:08d}")
        draft, _ = self._hadoop(f"{folder}/_draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise CommitConflict(f"{target} exists already")


def _folder_name(version: int) -> str:
    return f"v={version:08d}-{uuid.uuid4().hex[:12]}"
