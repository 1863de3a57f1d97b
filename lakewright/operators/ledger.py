"""Ingestion ledger: an append-only log of stage transitions and the views over it.

A transition is (source, table_name, file_name, increment, ts, stage,
rows_read) plus a sequence column that breaks ties of `ts`. Updating the
ledger means appending rows, so it needs no row-level rewrite.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import ABANDONED, ENTRY_KEYS, STAGES
from ..functions.text import row_hash
from .history import neighbour
from .keys import absent

KEYS = list(ENTRY_KEYS)
LOG_COLUMNS = [*KEYS, "ts", "stage", "rows_read"]


def stage_ordinal(stage: Column) -> Column:
    """1 for NEW up to 6 for COMPLETED; NULL for a stage outside the order."""
    return reduce(
        lambda acc, item: acc.when(stage == item[1], item[0]),
        enumerate(STAGES[1:], start=2),
        F.when(stage == STAGES[0], 1),
    )


def next_stage(stage: Column) -> Column:
    return reduce(
        lambda acc, pair: acc.when(stage == pair[0], pair[1]),
        zip(STAGES[1:], STAGES[2:]),
        F.when(stage == STAGES[0], STAGES[1]),
    )


def entry_hash() -> Column:
    return row_hash(*[F.col(k) for k in KEYS])


def latest_stage(transitions: DataFrame, seq: str | None = "event_id",
                 carry: tuple[str, ...] = ("rows_read",)) -> DataFrame:
    """One row per entry: current stage, completion time, first and last transition.

    Columns of `carry` keep their last value that is not NULL. Without a
    sequence column the stage order breaks ties of `ts`.
    """
    tie = F.col(seq) if seq else F.coalesce(stage_ordinal(F.col("stage")), F.lit(99))
    at = F.struct(F.col("ts"), tie.alias("tie"))
    return (
        transitions.groupBy(*KEYS)
        .agg(
            F.max_by("stage", at).alias("stage"),
            *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in carry],
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.max(F.when(F.col("stage") == "COMPLETED", F.col("ts"))).alias("date_completed"),
        )
    )


def incomplete(entries: DataFrame) -> DataFrame:
    """Entries that never completed and were not given up."""
    return entries.where(F.col("date_completed").isNull() & (F.col("stage") != ABANDONED))


def dashboard(entries: DataFrame, source=None, table=None, stage=None, name_contains=None,
              since=None, until=None) -> DataFrame:
    """Entries by the chosen filters; a filter that is not given does not restrict."""
    tests = [
        (source, lambda v: F.col("source") == v),
        (table, lambda v: F.col("table_name") == v),
        (stage, lambda v: F.col("stage") == v),
        (name_contains, lambda v: F.col("file_name").contains(v)),
        (since, lambda v: F.col("last_ts") >= F.lit(v)),
        (until, lambda v: F.col("last_ts") < F.lit(v)),
    ]
    return reduce(lambda df, t: df if t[0] is None else df.where(t[1](t[0])), tests, entries)


def known_sources(transitions: DataFrame) -> DataFrame:
    return transitions.select("source").distinct()


def tables_of(transitions: DataFrame, source: str) -> DataFrame:
    return transitions.where(F.col("source") == source).select("table_name").distinct()


def oldest_incomplete(entries: DataFrame, k: int) -> DataFrame:
    return incomplete(entries).orderBy("first_ts", *KEYS).limit(k)


def requeue(entries: DataFrame, k: int | None = None) -> DataFrame:
    """The four keys of every open entry (or the k oldest), for another run."""
    batch = incomplete(entries) if k is None else oldest_incomplete(entries, k)
    return batch.select(*KEYS, "stage", "first_ts")


def stage_summary(entries: DataFrame, rollup: bool = False) -> DataFrame:
    """Entries, rows and oldest open entry per source, table and stage."""
    by = ["source", "table_name", "stage"]
    grouped = entries.rollup(*by) if rollup else entries.groupBy(*by)
    return grouped.agg(
        F.count("*").alias("entries"),
        F.sum("rows_read").alias("rows"),
        F.min(F.when(F.col("date_completed").isNull(), F.col("first_ts"))).alias("oldest_open"),
    )


def find_or_create(transitions: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """NEW transitions for files that have no entry yet. Of the ledger only what the files name is looked at."""
    wanted = files.select(*KEYS).distinct()
    return absent(wanted, transitions.join(wanted, KEYS, "left_semi"), KEYS).select(
        *KEYS, now.alias("ts"), F.lit("NEW").alias("stage"), F.lit(None).cast("bigint").alias("rows_read"))


def advance(entries: DataFrame, stage: Column, now: Column, rows_read: Column | None = None,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """Transition rows that move `entries` to `stage`."""
    count = rows_read if rows_read is not None else F.lit(None).cast("bigint")
    return entries.select(
        *KEYS, now.alias("ts"), stage.alias("stage"), count.cast("bigint").alias("rows_read"), *keep)


def advance_all(entries: DataFrame, now: Column) -> DataFrame:
    """Move every open entry one stage on."""
    return advance(incomplete(entries), next_stage(F.col("stage")), now, F.col("rows_read"))


def entries_at(entries: DataFrame, stage: str) -> DataFrame:
    """Entries whose next step is the one after `stage`."""
    return entries.where(F.col("stage") == stage)


def resume_plan(entries: DataFrame) -> DataFrame:
    """Open entries with the step they continue at."""
    return incomplete(entries).select(*KEYS, "stage", next_stage(F.col("stage")).alias("next_stage"))


def abandon(entries: DataFrame, targets: DataFrame, now: Column) -> DataFrame:
    """ABANDONED transitions for open entries named by (row_hash, increment)."""
    wanted = targets.select("row_hash", "increment").distinct()
    hashed = incomplete(entries).withColumn("row_hash", entry_hash())
    return advance(hashed.join(wanted, ["row_hash", "increment"], "left_semi"), F.lit(ABANDONED), now)


def illegal_transitions(transitions: DataFrame, seq: str = "event_id") -> DataFrame:
    """Transitions that do not move exactly one stage on from the one before."""
    seen = neighbour(transitions, KEYS, ["ts", seq], F.struct("stage"), "_before")
    before = F.coalesce(stage_ordinal(F.col("_before.stage")), F.lit(0))
    return (
        seen.withColumn("previous_stage", F.col("_before.stage"))
        .where(~F.coalesce(stage_ordinal(F.col("stage")), F.lit(0)).eqNullSafe(before + 1))
        .select(*KEYS, seq, "ts", "previous_stage", "stage")
    )


def unfinished(entries: DataFrame) -> DataFrame:
    """Entries whose last stage is not COMPLETED, with the message a run fails with."""
    return entries.where(F.col("stage") != "COMPLETED").select(
        *KEYS, "stage",
        F.concat(F.lit("ingestion of "), F.col("file_name"), F.lit(" stopped at stage "), F.col("stage"))
        .alias("message"),
    )


class IncompleteRun(RuntimeError):
    """A run ended before COMPLETED."""


def assert_completed(entries: DataFrame) -> None:
    late = unfinished(entries).select("message").take(1)
    if late:
        raise IncompleteRun(late[0].message)


def unknown_tables(entries: DataFrame, declared: DataFrame) -> DataFrame:
    """(source, table_name) pairs in the ledger that no declaration covers."""
    pairs = entries.groupBy("source", "table_name").agg(F.count("*").alias("entries"))
    return absent(pairs, declared, ["source", "table_name"]).select(
        "source", "table_name", "entries",
        F.concat(F.lit("table '"), F.col("table_name"), F.lit("' is not declared for source '"),
                 F.col("source"), F.lit("'")).alias("message"),
    )


def check_params(calls: DataFrame) -> DataFrame:
    """Typed ingestion parameters plus the list of what is wrong with them.

    Source and table may come from `file_path`; see `parse_landing_path`.
    """
    number = F.expr("try_cast(increment as int)")
    missing = [
        F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(f"{c} missing"))
        for c in ("source", "table_name", "file_name")
    ]
    bad_number = F.when(F.col("increment").isNull(), F.lit("increment missing")).when(
        number.isNull(), F.lit("increment not an integer"))
    return calls.withColumn("errors", F.array_compact(F.array(*missing, bad_number))).withColumn("increment", number)
