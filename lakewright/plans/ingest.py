"""Resumable ingestion of a batch of files.

All files of a batch move through a stage together. Each step works on the
entries whose current stage calls for it, does its work, and then appends the
transition, which is the commit. Staged rows lie in one partition per staging
attempt; the ledger records which attempt counts, so rows of an attempt that
died are never read. A later run continues where the ledger says the entries
are, and repeating a step replaces its output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import ABANDONED, ENTRY_KEYS
from ..operators import ledger, quality
from ..operators.lists import union_distinct
from ..operators.ranking import cluster
from ..session import cut_lineage
from ..sinks.store import INGEST_ID, CommitConflict, TableStore
from ..sources.landing import HookRegistry
from .models import ModelRegistry
from .specs import TableSpec

KEYS = list(ENTRY_KEYS)
LEDGER = "orchestration/import_file"
TEST_LOG = "orchestration/test_results"
CONTENT = "orchestration/content"
APPEND = "_append"
BATCH = "_batch"
ROW = "_row"
FOLD_ATTEMPTS = 4

# Rows of the given entries: entry keys plus the declared columns as text.
ReadRows = Callable[[DataFrame], DataFrame]


def ingest_id() -> Column:
    """Plain, stable id of an entry."""
    return F.concat(F.lit("e"), ledger.entry_hash().cast("string"))


def attempt(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex[:12]}"


class Ledger:
    """The ledger table: appended transitions over a clustered base."""

    def __init__(self, store: TableStore) -> None:
        self.store = store

    def transitions(self, source: str | None = None, table: str | None = None) -> DataFrame | None:
        """All transitions, or those of one table: the filter reaches the files, which are clustered by it."""
        parts = []
        if self.store.version(LEDGER):
            parts.append(self.store.read(LEDGER))
        if self.store.has_appended(LEDGER):
            parts.append(self.store.read_appended(LEDGER, APPEND).drop(APPEND))
        if source is not None:
            parts = [p.where((F.col("source") == source) & (F.col("table_name") == table)) for p in parts]
        if len(parts) == 2:
            # A compaction that died half-way leaves rows on both sides.
            return union_distinct(*parts)
        return parts[0] if parts else None

    def entries(self, source: str | None = None, table: str | None = None) -> DataFrame:
        return ledger.latest_stage(self.transitions(source, table), seq=None, carry=("rows_read", BATCH))

    def append(self, rows: DataFrame, name: str) -> None:
        marked = rows if BATCH in rows.columns else rows.withColumn(BATCH, F.lit(None).cast("string"))
        self.store.append(
            LEDGER, marked.select(*ledger.LOG_COLUMNS, BATCH, F.lit(attempt(name)).alias(APPEND)), APPEND, gather=False)

    def note_content(self, files: DataFrame, now: Column, name: str) -> None:
        """Record what landed: entry keys, `digest`, and whether the content was `taken` or had been before."""
        self.store.append(CONTENT, files.select(
            *KEYS, "digest", "taken", now.alias("ts"), F.lit(attempt(name)).alias(APPEND)), APPEND, gather=False)

    def content(self, source: str, table: str) -> DataFrame | None:
        """Landed contents of a table: entry keys, `digest`, `taken`, `ts`."""
        if not self.store.has_appended(CONTENT):
            return None
        return self.store.read_appended(CONTENT, APPEND).drop(APPEND).where(
            (F.col("source") == source) & (F.col("table_name") == table))

    def compact(self, target_files: int = 8) -> None:
        """Fold appended transitions into the base, clustered by source and table; versions before the last two go.

        A run of another table that folds at the same time may commit first:
        then its version is the base, and what it folded is not folded again.
        """
        for left in reversed(range(FOLD_ATTEMPTS)):
            if not self.store.has_appended(LEDGER):
                return
            folded = cut_lineage(self.store.read_appended(LEDGER, APPEND).select(APPEND).distinct(), "folded")
            try:
                self.store.write(LEDGER, cluster(self.transitions(), ["source", "table_name"], target_files))
            except CommitConflict:
                if not left:
                    raise
                continue
            self.store.drop_ingest(LEDGER, folded, APPEND)
            self.store.vacuum(LEDGER)
            return


class Ingestion:
    """Ingestion of one declared table."""

    def __init__(self, spark: SparkSession, store: TableStore, spec: TableSpec,
                 parents: Mapping[str, DataFrame] | None = None, hooks: HookRegistry | None = None,
                 models: ModelRegistry | None = None) -> None:
        self.spark, self.store, self.spec, self.models = spark, store, spec, models
        self.hooks = hooks or HookRegistry()
        self.ledger = Ledger(store)
        self.tests = spec.build_tests(parents, scope=(INGEST_ID,))
        #: Ids of abandoned entries whose rows lie in the partitions of this run; None if there are none.
        self._given_up: DataFrame | None = None
        name = f"{spec.source}/{spec.table}"
        self.staging, self.review, self.main = (f"{area}/{name}" for area in ("staging", "review", "source"))

    # -- one run ----------------------------------------------------------

    def run(self, files: DataFrame, read_rows: ReadRows, now: Column, run_id: str,
            archive: Callable[[DataFrame], None] | None = None,
            headers: Callable[[DataFrame], DataFrame] | None = None,
            stop_after: str | None = None) -> DataFrame:
        """Take `files` (entry keys, plus whatever `archive` and `headers` need) to COMPLETED.

        A run that ends folds the ledger, raises if an entry stopped on its way, and
        rebuilds the models downstream of the table. A declaration that does
        not hold what the table has already is refused before any work.

        Returns the entries of the batch. `stop_after` ends the run after a
        stage, as a crash would.
        """
        self._check_table()
        batch = cut_lineage(files, "batch")
        self._register(batch, now, run_id)
        state = self._current(batch)
        # At most one name per stage.
        present = {row.stage for row in state.select("stage").distinct().collect()}
        steps = {
            "NEW": ("ARCHIVED", lambda e: self._archive(e, batch, archive, headers)),
            "ARCHIVED": ("STAGED", lambda e: self._stage(e, read_rows, run_id)),
            "STAGED": ("CLEANED", lambda e: self._clean(e, now, run_id)),
            "CLEANED": ("INSERTED", self._insert),
            "INSERTED": ("COMPLETED", self._tidy),
        }
        for stage, (reached, step) in steps.items():
            if stop_after == stage:
                break
            if stage not in present:
                continue
            moved = step(state.where(F.col("stage") == stage)).withColumn("stage", F.lit(reached))
            self.ledger.append(
                ledger.advance(moved, F.lit(reached), now, F.col("rows_read"), keep=(BATCH,)), f"{run_id}-{reached}")
            state = state.where(F.col("stage") != stage).unionByName(moved)
            present.add(reached)
        entries = cut_lineage(self._batch_entries(batch), "entries")
        if stop_after is None:
            self._finish(entries)
        return entries

    def _check_table(self) -> None:
        if self.store.version(self.main) if self.spec.load == "merge" else self.store.has_appended(self.main):
            problems = quality.table_problems(self.spec.columns, self.main_table().dtypes)
            if problems:
                raise quality.SchemaMismatch(f"{self.spec.source}.{self.spec.table}: " + "; ".join(problems))

    def _finish(self, entries: DataFrame) -> None:
        self.ledger.compact()
        # Files whose header does not fit wait at NEW; review rows wait for `retry_review`.
        ledger.assert_completed(entries.where(~F.col("stage").isin("NEW", ABANDONED) & F.col(BATCH).isNotNull()))
        if self.models is not None:
            self.models.propagate(self.spark, self.store, self.spec.source, self.spec.table)

    def _register(self, batch: DataFrame, now: Column, run_id: str) -> None:
        known = self.ledger.transitions(self.spec.source, self.spec.table)
        if known is None:
            known = batch.select(*KEYS).limit(0)
        self.ledger.append(ledger.find_or_create(known, batch, now), f"{run_id}-NEW")

    def _batch_entries(self, batch: DataFrame) -> DataFrame:
        return self._entries().join(batch.select(*KEYS).distinct(), KEYS, "left_semi")

    def _entries(self) -> DataFrame:
        return self.ledger.entries(self.spec.source, self.spec.table)

    def _current(self, batch: DataFrame) -> DataFrame:
        """Entries of the batch as the ledger has them, as a written table.

        Entries that were staged together move on together, so open ones that
        share a staging attempt with the batch are part of it.
        """
        known = cut_lineage(self._entries(), "entries")
        mine = known.join(batch.select(*KEYS).distinct(), KEYS, "left_semi")
        attempts = mine.where(F.col(BATCH).isNotNull() & ~F.col("stage").isin("COMPLETED", ABANDONED)).select(
            BATCH, "stage").distinct()
        gone = known.where(F.col("stage") == ABANDONED).join(attempts.select(BATCH).distinct(), BATCH, "left_semi").select(
            ingest_id().alias(INGEST_ID))
        self._given_up = None if gone.isEmpty() else gone
        others = known.join(attempts, [BATCH, "stage"], "left_semi").join(
            mine.select(*KEYS), KEYS, "left_anti")
        everyone = mine.unionByName(others).select(*KEYS, "stage", "rows_read", BATCH)
        # Entries of review rows wait at STAGED, without an attempt, until `retry_review`.
        everyone = everyone.where((F.col("stage") != "STAGED") | F.col(BATCH).isNotNull())
        return cut_lineage(everyone.withColumn(INGEST_ID, ingest_id()), "state")

    # -- steps: each gets the entries at its stage, returns those that moved on --

    def _archive(self, entries, batch, archive, headers) -> DataFrame:
        """Files whose header does not fit stay at NEW until the declaration or the file changes."""
        if headers is not None:
            wrong = quality.compare_schema(
                headers(batch), [(c, "string") for c, _ in self.spec.columns], "file_name")
            entries = cut_lineage(
                entries.join(wrong.select("file_name").distinct(), "file_name", "left_anti"), "accepted")
        if archive is not None:
            archive(batch.join(entries.select(*KEYS), KEYS, "left_semi"))
        return entries

    def _stage(self, entries, read_rows, run_id) -> DataFrame:
        """Typed rows into one partition; `_row` numbers them for the steps that follow."""
        name = attempt(run_id)
        rows = self.hooks.apply(read_rows(entries), self.spec.source, self.spec.table)
        # Ids come with the entries: hashing is per file, not per row.
        rows = rows.join(entries.select(*KEYS, INGEST_ID), KEYS)
        typed = quality.cast_columns(rows, self.spec.columns, [INGEST_ID, *KEYS])
        # Numbered in the task that writes: no shuffle may follow the numbering.
        self.store.append(self.staging, typed.withColumns(
            {ROW: F.monotonically_increasing_id(), BATCH: F.lit(name)}), BATCH, gather=False)
        staged = entries.withColumn(BATCH, F.lit(name))
        counts = self._read(self.staging, self.spark.range(1).select(F.lit(name).alias(BATCH))).groupBy(
            INGEST_ID).agg(F.count("*").alias("_rows"))
        return cut_lineage(
            staged.join(counts, INGEST_ID, "left")
            .withColumn("rows_read", F.coalesce("_rows", F.lit(0).cast("bigint"))).drop("_rows"), "staged")

    def _clean(self, entries, now, run_id) -> DataFrame:
        """Failing rows go to review under an entry of their own; the rest continues.

        Only failing rows are written: clean rows are the staged rows without them.
        """
        failing = quality.quarantine(quality.tag_failures(self._read(self.staging, entries), self.tests), KEYS)[1]
        self.store.append(self.review, failing.withColumn("increment", F.col("increment") + 1), BATCH)
        review = self._read(self.review, entries)
        hits = review.select(INGEST_ID, F.explode(quality.FAILED).alias("test")).groupBy(INGEST_ID, "test").agg(
            F.count("*").alias("_n"))
        grid = entries.select(INGEST_ID, BATCH, F.explode(F.array(*[F.lit(t.name) for t in self.tests])).alias("test"))
        self.store.append(TEST_LOG, grid.join(hits, [INGEST_ID, "test"], "left").select(
            INGEST_ID, "test", F.coalesce("_n", F.lit(0)).alias("failing_rows"), BATCH), BATCH, gather=False)
        # Entries of review rows; those of a repeated step are known already.
        quarantined = review.groupBy(*KEYS).agg(F.count("*").alias("rows_read"))
        self.ledger.append(ledger.advance(quarantined, F.lit("STAGED"), now, F.col("rows_read")), f"{run_id}-review")
        return entries

    def _insert(self, entries) -> DataFrame:
        rows = self._clean_rows(entries)
        if self.spec.load == "merge":
            rest = [c for c in self.spec.names if c not in self.spec.keys]
            # Of a key in several files the last file counts.
            self.store.merge(self.main, rows.select(*self.spec.names, "file_name", INGEST_ID),
                             self.spec.keys, ["file_name", *rest])
        else:
            self.store.append(self.main, rows.select(*self.spec.names, INGEST_ID, BATCH), BATCH)
        return entries

    def _tidy(self, entries) -> DataFrame:
        self.store.drop_ingest(self.staging, entries, BATCH)
        return entries

    def _read(self, area: str, ids: DataFrame) -> DataFrame:
        """Rows of the partitions that `ids` names, without those of abandoned entries."""
        if self.store.has_appended(area):
            rows = self.store.read_batches(area, ids, BATCH)
            return rows if self._given_up is None else rows.join(self._given_up, INGEST_ID, "left_anti")
        # Nothing was ever written: no staged rows, or no failing ones.
        columns = ", ".join(f"`{c}` {t}" for c, t in [
            (INGEST_ID, "string"), ("source", "string"), ("table_name", "string"), ("file_name", "string"),
            ("increment", "int"), *self.spec.columns, (ROW, "bigint"),
            *([(quality.FAILED, "array<string>")] if area == self.review else []), (BATCH, "string")])
        return self.spark.createDataFrame([], columns)

    def _clean_rows(self, entries: DataFrame) -> DataFrame:
        failing = self._read(self.review, entries).select(BATCH, ROW)
        return self._read(self.staging, entries).join(failing, [BATCH, ROW], "left_anti")

    def retry_review(self, entries: DataFrame, fix: Callable[[DataFrame], DataFrame], now: Column,
                     run_id: str) -> DataFrame:
        """Stage the repaired review rows of `entries` (entry keys) again and take them to COMPLETED.

        Rows that still fail go back to review under the next increment.
        """
        given_up = self._entries().where(F.col("stage") == ABANDONED).select(*KEYS)
        keys = cut_lineage(entries.select(*KEYS).distinct().join(given_up, KEYS, "left_anti"), "review")
        name = attempt(run_id)
        rows = self.store.read_appended(self.review, BATCH).join(keys, KEYS, "left_semi")
        fixed = fix(rows.drop(ROW, BATCH, quality.FAILED)).withColumn(INGEST_ID, ingest_id())
        self.store.append(self.staging, fixed.select(INGEST_ID, *KEYS, *self.spec.names).withColumns(
            {ROW: F.monotonically_increasing_id(), BATCH: F.lit(name)}), BATCH, gather=False)
        counts = self._read(self.staging, self.spark.range(1).select(F.lit(name).alias(BATCH))).groupBy(*KEYS).agg(
            F.count("*").alias("rows_read"))
        self.ledger.append(ledger.advance(
            counts.withColumn(BATCH, F.lit(name)), F.lit("STAGED"), now, F.col("rows_read"), keep=(BATCH,)),
            f"{run_id}-STAGED")
        return self.run(keys, lambda _: rows, now, run_id)

    def abandon(self, targets: DataFrame, now: Column, run_id: str) -> DataFrame:
        """Give up the open entries named by `targets` (row_hash, increment); returns their keys.

        One staging partition holds the rows of many entries. The ledger row is
        the tombstone: from the next run on the entry's rows are not read any
        more, and they go with the partition, at once if none of its entries is
        open, else when the last one is completed.
        """
        gone = cut_lineage(ledger.abandon(self._entries(), targets, now), "abandoned")
        self.ledger.append(gone, f"{run_id}-{ABANDONED}")
        entries = cut_lineage(self._entries().where(F.col(BATCH).isNotNull()), "entries")
        alive = ledger.incomplete(entries).select(BATCH).distinct()
        dead = entries.join(gone.select(*KEYS), KEYS, "left_semi").select(BATCH).distinct().join(alive, BATCH, "left_anti")
        self.store.drop_ingest(self.staging, dead, BATCH)
        return gone.select(*KEYS)

    # -- results ----------------------------------------------------------

    def main_table(self) -> DataFrame:
        return self.store.read(self.main) if self.spec.load == "merge" else self.store.read_appended(self.main, BATCH)

    def summary(self, batch_entries: DataFrame) -> DataFrame:
        """(file_name, rows_read, rows_clean, rows_review, stage) per ingested file."""
        review = self._entries().select(
            "source", "table_name", "file_name",
            (F.col("increment") - 1).alias("increment"), F.col("rows_read").alias("_review"))
        lost = F.coalesce("_review", F.lit(0).cast("bigint"))
        return batch_entries.join(review, KEYS, "left").select(
            "file_name", "rows_read", (F.col("rows_read") - lost).alias("rows_clean"),
            lost.alias("rows_review"), "stage")
