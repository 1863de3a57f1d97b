"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# AQE picks the join strategy from measured sizes and splits skewed partitions,
# so no operator here carries an unconditional broadcast hint.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

#: Spark removes a query's shuffles when it ends, not when the driver collects its garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of an Arrow batch on its way to Python. Spark's own limits are rows, 10,000, and 256 MB, which a batch of long texts or of pairs of sets reaches.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def build_session(app: str = "lakewright", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application: tasks import it wherever the driver was started."""
    small_batches(spark)
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    name = f"{package.name}-{context.applicationId}.zip"
    if not any(name in str(path) for path in context._python_includes):
        archive = Path(tempfile.mkdtemp(prefix=package.name), name)  # read by the driver's own file server only
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
    return spark


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that tasks send to Python, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    Only a local run that names none gets one made here; on a cluster each
    executor would write to its own disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lakewright-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Scratch paths handed out and not removed yet, in order, by application.
_handed_out: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new, never reused path below the shared folder."""
    path = f"{_scratch_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    _handed_out.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lakewright/{spark.sparkContext.applicationId}"


def scratch_mark(spark: SparkSession) -> int:
    """To be given to `release_scratch` later on."""
    return len(_handed_out.get(spark.sparkContext.applicationId, []))


def release_scratch(spark: SparkSession, mark: int = 0, keep: DataFrame | None = None) -> None:
    """Remove the scratch tables written since `mark`, but those that `keep` reads; other frames on them must not be used any more."""
    paths = _handed_out.get(spark.sparkContext.applicationId, [])
    read = [] if keep is None else keep.inputFiles()
    left = []
    for path in paths[mark:]:
        name = path.rpartition("/")[2]
        if any(f"/{name}/" in file for file in read):
            left.append(path)
        else:
            _remove(spark, path)
    paths[mark:] = left


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application wrote below the shared folder; its frames must not be used any more."""
    _remove(spark, _scratch_root(spark))
    _handed_out.pop(spark.sparkContext.applicationId, None)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame, purpose: str = "step") -> DataFrame:
    """The rows as a written table in the shared folder.

    Later plans start from its files, whose sizes are known, and a lost
    executor costs nothing that was computed before. The shuffles that led here go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    before = spark.conf.get(FREES_SHUFFLES, "false")
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREES_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


class RunTimeout(RuntimeError):
    """Work took longer than it may."""


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancel the Spark jobs that this thread starts within the block once `seconds` are over, and raise `RunTimeout`."""
    context, tag = spark.sparkContext, f"limit-{uuid.uuid4().hex}"
    over, ended = threading.Event(), threading.Event()

    def watch() -> None:
        if not ended.wait(seconds):
            over.set()
            # Again and again: the block may be between two jobs.
            while not ended.wait(0.2):
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as error:
        if over.is_set():
            raise RunTimeout(f"cancelled after {seconds:g} seconds") from error
        raise
    finally:
        ended.set()
        watcher.join()
        context.removeJobTag(tag)
