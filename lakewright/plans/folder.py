"""Ingestion of what lies in the landing folder, once or as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import ABANDONED, RUN_LIMIT_MINUTES
from ..operators import ledger
from ..session import cut_lineage, time_limit
from ..sources import landing
from ..sources.layout import Layout
from ..streaming.landing import file_stream, ingest_stream
from .ingest import KEYS, Ingestion


class LostFiles(RuntimeError):
    """A file is neither in the landing area nor in the archive."""


def landed(spark: SparkSession, root: str, source: str, table: str, increment: int = 0) -> DataFrame:
    """Entry keys and path of the landed files of one table."""
    files = landing.parse_landing_path(landing.landing_files(spark, root, f"raw/{source}/{table}/"))
    return files.where(F.col("path_ok") & (F.col("source") == source) & (F.col("table_name") == table)).select(
        "source", "table_name", "file_name", F.lit(increment).alias("increment"), "path")


#: The landings of one file name have increments this far apart; review rows count up from the one they came with.
LANDING_STEP = 100


def _is_landing(increment: int) -> Column:
    return (F.col("increment") >= increment) & ((F.col("increment") - increment) % LANDING_STEP == 0)


def pending(job: Ingestion, files: DataFrame, increment: int = 0) -> DataFrame:
    """`files` (entry keys, path), and the entries that an earlier run left open."""
    spec = job.spec
    if job.ledger.transitions() is None:
        return files
    open_entries = ledger.requeue(job.ledger.entries(spec.source, spec.table)).where(_is_landing(increment))
    waiting = open_entries.select(*KEYS).join(files.select(*KEYS), KEYS, "left_anti")
    return files.unionByName(waiting.withColumn(
        "path", F.concat(F.lit(f"raw/{spec.source}/{spec.table}/"), F.col("file_name"))))


def tell_landings(job: Ingestion, root: str, files: DataFrame, increment: int = 0) -> DataFrame:
    """`files` (entry keys, path) with `digest`, `taken` and the increment that the ledger calls for.

    A name that is new, or whose file never left the landing folder, is taken
    as before. A file that lands under the name of one that ended before is
    told by its bytes: content that the name has had is not taken again, and
    gets the keys of the entry that had it; other content is the next landing.
    While the earlier file is still on its way the new one waits where it is.
    """
    spec = job.spec
    base = files.where(F.col("increment") == increment)
    digests = landing.content_digests(base.select(F.concat(F.lit(root.rstrip("/") + "/"), F.col("path")).alias("path")))
    base = base.withColumn("_at", F.concat(F.lit(root.rstrip("/") + "/"), F.col("path"))).join(
        digests.withColumnRenamed("path", "_at"), "_at", "left").drop("_at")
    others = files.where(F.col("increment") != increment).withColumns({"digest": F.lit(None).cast("string"), "taken": F.lit(True)})
    if job.ledger.transitions() is None:
        return cut_lineage(base.withColumn("taken", F.lit(True)).unionByName(others), "landings")
    entries = job.ledger.entries(spec.source, spec.table).where(_is_landing(increment))
    named = ["source", "table_name", "file_name"]
    last = entries.groupBy(*named).agg(F.max_by(F.struct(F.col("increment").alias("at"), "stage"), "increment").alias("_last"))
    content = job.ledger.content(spec.source, spec.table)
    had = base.select(*named, "digest").limit(0) if content is None else content.where("taken").join(
        entries.where("stage <> 'NEW'").select(*KEYS), KEYS, "left_semi")
    had = (had if content is not None else had.withColumn("increment", F.lit(0))).groupBy(*named, "digest").agg(
        F.max("increment").alias("_had"))
    stage, ended = F.col("_last.stage"), F.col("_last.stage").isin("COMPLETED", ABANDONED)
    told = base.join(last, named, "left").join(had, [*named, "digest"], "left").where(
        F.col("digest").isNull() | stage.isNull() | ended | (stage == "NEW"))
    again = F.col("digest").isNotNull() & F.coalesce(ended, F.lit(False)) & F.col("_had").isNotNull()
    told = told.select(
        *named, (F.when(again, F.col("_had"))
                 .when(F.col("digest").isNotNull() & ended, F.col("_last.at") + LANDING_STEP)
                 .when(stage == "NEW", F.col("_last.at")).otherwise(F.col("increment"))).cast("int").alias("increment"),
        "path", "digest", (~again).alias("taken"))
    return cut_lineage(told.unionByName(others), "landings")


def ingest_folder(job: Ingestion, root: str, now: Column, run_id: str, increment: int = 0,
                  stop_after: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Ingest the landed files of the job's table, or those of `files`, and resume entries an earlier run left open.

    A file that lands again with content that its name has had goes to the
    archive and into `job.ledger.content` as not taken; no row of it is read.
    With new content it is a landing of its own, archived in a folder of its own.
    """
    spark, spec, layout = job.spark, job.spec, Layout(root)
    told = tell_landings(job, root, landed(spark, root, spec.source, spec.table, increment) if files is None else files, increment)
    raw_dir, archive_dir = (layout.path(c, spec.source, spec.table) for c in ("raw", "archive"))

    def archive(batch: DataFrame) -> None:
        plan = landing.archive_plan(batch, layout.path("archive"), keep=("increment",))
        apart = F.regexp_replace("dst", F.lit("/([^/]*)$"), F.concat(F.lit("/landing="), F.col("increment"), F.lit("/$1")))
        plan = plan.withColumn("dst", F.when(F.col("increment") == increment, F.col("dst")).otherwise(apart))
        moved = cut_lineage(landing.move_files(
            plan.withColumn("src", F.concat(F.lit(root.rstrip("/") + "/"), F.col("src")))), "moved")
        lost = moved.where(F.col("status") == "lost").take(5)
        if lost:
            raise LostFiles(", ".join(r.src for r in lost))

    noted = told.where("digest is not null")
    if not noted.isEmpty():
        job.ledger.note_content(noted, now, run_id)
    repeated = told.where("not taken")
    if not repeated.isEmpty():
        archive(repeated)
    files = pending(job, told.where("taken").drop("digest", "taken"), increment)

    def headers(_: DataFrame) -> DataFrame:
        found = landing.read_headers(landing.list_files(spark, raw_dir).where("size > 0"))
        return found.withColumn("file_name", F.substring_index("path", "/", -1))

    def read_rows(entries: DataFrame) -> DataFrame:
        # Exactly the pending files. The reader lists its files on the driver, whoever names them.
        names = [r.file_name if r.increment == increment else f"landing={r.increment}/{r.file_name}"
                 for r in entries.select("file_name", "increment").distinct().collect()]
        rows = landing.read_raw_csv(spark, [landing.literal_path(f"{archive_dir}/{name}") for name in names], spec.names)
        number = F.regexp_extract("file_path", "/landing=([0-9]+)/[^/]*$", 1).try_cast("int")
        return rows.select(
            F.lit(spec.source).alias("source"), F.lit(spec.table).alias("table_name"),
            "file_name", F.coalesce(number, F.lit(increment)).alias("increment"), *spec.names)

    return job.run(files, read_rows, now, run_id, archive, headers, stop_after)


def arrived(batch: DataFrame, source: str, table: str, increment: int = 0) -> DataFrame:
    """Entry keys and path of the files of one table in a batch of `file_stream`."""
    folder = f"raw/{source}/{table}"
    return batch.where(F.col("folder_path").endswith(f"/{folder}")).select(
        F.lit(source).alias("source"), F.lit(table).alias("table_name"), "file_name", F.lit(increment).alias("increment"),
        F.concat(F.lit(f"{folder}/"), F.col("file_name")).alias("path")).distinct()


def ingest_on_arrival(jobs: list[Ingestion], root: str, checkpoint: str, now: Callable[[], Column],
                      max_files: int | None = None, available_now: bool = True,
                      minutes: float = RUN_LIMIT_MINUTES) -> StreamingQuery:
    """Ingest files as they land: one stream, one run at a time, the files of a batch and a table together.

    A batch whose runs take longer than `minutes` is cancelled and ends the
    stream; nothing is tried again by itself. The next start gets the same
    batch, and the ledger says what of it is done: completed entries stay as
    they are, open ones go on, also those whose files were moved already.
    """
    spark = jobs[0].spark

    def handle(batch: DataFrame, batch_id: int) -> None:
        with time_limit(spark, minutes * 60):
            # Once, before any file is moved.
            files = cut_lineage(batch.select("file_name", "folder_path"), "arrivals")
            for job in jobs:
                mine = cut_lineage(pending(job, arrived(files, job.spec.source, job.spec.table)), "pending")
                if not mine.isEmpty():
                    ingest_folder(job, root, now(), f"arrival-{batch_id}", files=mine)

    return ingest_stream(file_stream(spark, f"{root}/raw", max_files), handle, checkpoint, available_now)
