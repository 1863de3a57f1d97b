"""Stateful streams: failure alerts and the current stage of ledger entries."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..constants import ALERT_WINDOW, ENTRY_KEYS, RUN_LIMIT_MINUTES
from ..operators.alerts import failures_per_window

VERSION = "_batch_id"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def failure_counts_stream(runs: DataFrame, failed: Column, ts: str = "ts", size: str = ALERT_WINDOW,
                          step: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Failures per window of a stream. Rows later than `delay` behind the newest one are dropped."""
    timed = runs.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return failures_per_window(timed, failed, ts, size, step)


_STATE = "stage string, at long, seq long, rows_read long, rows_at long, rows_seq long, first long, last long, overdue boolean, increment long"


class StageTimer(StatefulProcessor):
    """The open entries of a ledger: one value and at most one timer for each, both gone once it is completed."""

    def __init__(self, minutes: int) -> None:
        self.limit = minutes * 60_000

    def init(self, handle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        held = self.entry.get() if self.entry.exists() else None
        state = list(held) if held else [None] * 8 + [False, None if pd.isna(key[3]) else int(key[3])]
        completed = None
        for frame in rows:
            for stage, at, seq, read in zip(frame["stage"], frame["at"], frame["seq"], frame["rows_read"]):
                if stage is None:
                    continue  # a heartbeat moves the watermark only
                at, seq = int(at), int(seq)
                if state[1] is None or (at, seq) > (state[1], state[2]):
                    state[:3] = stage, at, seq
                if not pd.isna(read) and (state[4] is None or (at, seq) > (state[4], state[5])):
                    state[3:6] = int(read), at, seq
                state[6] = at if state[6] is None else min(state[6], at)
                state[7] = at if state[7] is None else max(state[7], at)
                if stage == "COMPLETED":
                    completed = at if completed is None else max(completed, at)
        if state[1] is None:
            return
        if completed is None:
            # Moments are whole milliseconds: the timer is due only after the limit, never at it.
            if not state[8] and (held is None or held[6] != state[6]):
                self._forget_timer()
                self.handle.registerTimer(state[6] // 1000 + self.limit + 1)
            self.entry.update(tuple(state))
        else:
            self._forget_timer()
            self.entry.clear()
        yield self._row(key, state, completed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.entry.exists():
            state = list(self.entry.get())
            state[8] = True
            self.entry.update(tuple(state))
            yield self._row(key, state, None)

    def _forget_timer(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _row(self, key, state, completed) -> pd.DataFrame:
        # A timer's key comes without its numbers.
        row = [*key[:3], state[9], state[0], state[3], state[6], state[7], completed, completed is None and state[8]]
        return pd.DataFrame([row], columns=[*ENTRY_KEYS, "stage", "rows_read", "first", "last", "completed", "overdue"], dtype=object)

    def close(self) -> None:
        pass


def stage_state(transitions: DataFrame, seq: str = "event_id", minutes: int = RUN_LIMIT_MINUTES, delay: str = "1 hour") -> DataFrame:
    """A stream of changed entries: stage, rows_read, first_ts, last_ts, date_completed, overdue.

    `overdue` is raised by a timer, once, when the watermark (the newest `ts` less `delay`) has passed the first transition by
    more than `minutes` and the entry is still open. A completed entry leaves no state; a transition that comes in a
    later batch begins it anew. Rows without a stage are heartbeats: they move the watermark.
    Needs `write_updates`, which sets the state store that timers need.
    """
    timed = transitions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    schema = transitions.select(*ENTRY_KEYS).schema
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    found = (timed.select(*ENTRY_KEYS, "stage", F.unix_micros("ts").alias("at"), F.col(seq).cast("long").alias("seq"), F.col("rows_read").cast("long"), "ts")
             .groupBy(*ENTRY_KEYS).transformWithStateInPandas(
                 StageTimer(minutes), f"{keys}, stage string, rows_read long, first long, last long, completed long, overdue boolean", "Update", "EventTime"))
    moment = {a: F.timestamp_micros(b).cast("timestamp_ntz").alias(a) for a, b in (("first_ts", "first"), ("last_ts", "last"), ("date_completed", "completed"))}
    return found.select(*ENTRY_KEYS, "stage", "rows_read", *moment.values(), "overdue")


def write_updates(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write changed rows of an aggregation per micro-batch; a replayed batch replaces its files."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{VERSION}={batch_id}")

    result.sparkSession.conf.set(PROVIDER, ROCKS)
    return (
        result.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_updates(spark: SparkSession, path: str, keys: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Latest version of each key, of one batch the last by `then`; unlike append mode this includes windows still open."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, VERSION)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(VERSION, *then)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
