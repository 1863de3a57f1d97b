"""Stored version histories that grow load by load."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.history import dedupe, scd2
from ..session import cut_lineage
from ..sinks.store import TableStore

LOAD = "_load"


class LateRows(ValueError):
    """Rows without a time, or not later than what was loaded before."""


class Snapshot:
    """The history of a table as stored tables that grow load by load.

    `<table>/heads` has the last version of every key, open or ended by a
    deletion, in key buckets; `<table>/past` has all versions that were
    followed by another, one partition a load. A load compares with heads
    alone, rewrites the buckets of the keys that changed and adds one partition
    of past versions; the past is never read again. The commit of the heads
    makes a load visible: a partition of the past counts once the heads have
    its number. What a load that died has left is replaced by the next one.

    Loads come in order of time: `<table>/loads` notes up to which time each
    went, and rows that are not later are refused before anything is written.

    `carried` columns come with a version and are not compared; `extend` orders
    by them among equal times. NULL equals NULL in keys and states. Only this
    class may write these tables, one load at a time.
    """

    def __init__(self, store: TableStore, table: str, keys: Sequence[str], tracked: Sequence[str],
                 carried: Sequence[str] = ()) -> None:
        self.store, self.spark = store, store.spark
        self.heads, self.past, self.loads = f"{table}/heads", f"{table}/past", f"{table}/loads"
        self.keys, self.tracked = list(keys), list(tracked)
        self.carried = [c for c in carried if c not in self.keys]
        self.plain = list(dict.fromkeys([*self.keys, *self.tracked, *self.carried]))
        self.columns = [*self.plain, "valid_from", "valid_to", "is_current"]

    # -- reading ----------------------------------------------------------

    def history(self) -> DataFrame:
        """All versions of all keys."""
        heads = self.store.read(self.heads).select(*self.columns)
        if not self.store.has_appended(self.past):
            return heads
        return heads.unionByName(self._committed(self.past).select(*self.columns))

    def current(self) -> DataFrame:
        """The open versions."""
        return self.store.read(self.heads).where("is_current").select(*self.columns)

    def loaded_until(self) -> str | None:
        """The time up to which rows are loaded, as text; None before the first load."""
        if not self.store.version(self.heads):
            return None
        return self._committed(self.loads).agg(F.max("until").cast("string")).first()[0]

    # -- loading ----------------------------------------------------------

    def load(self, rows: DataFrame, at: str) -> int:
        """The whole state of the table at a time; keys that are not in it any more end there.

        Of rows with one key the one with the largest state counts. The same
        time again is the same load again and changes nothing. Returns the version of the heads.
        """
        time, until = F.lit(at).cast("timestamp_ntz"), self.loaded_until()
        rest = [c for c in self.plain if c not in self.keys]
        today = dedupe(rows.select(*self.plain), self.keys, rest or self.keys)
        opened = [time.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current")]
        if until is None:
            return self._commit(today.select(*self.plain, *opened), None, time)
        earlier, again = self.spark.range(1).select(
            time < F.lit(until).cast("timestamp_ntz"), time == F.lit(until).cast("timestamp_ntz")).first()
        if earlier:
            raise LateRows(f"{at} is before {until}, up to which rows are loaded")
        if again:
            return self.store.version(self.heads)
        old = self.store.read(self.heads).select(*self.columns, F.lit(True).alias("_there")).alias("h")
        new = today.withColumn("_there", F.lit(True)).alias("n")
        is_open, stays = F.coalesce("h.is_current", F.lit(False)), F.coalesce("n._there", F.lit(False))
        # Unchanged keys, and those that ended before, go no further than the join.
        changed = cut_lineage(
            old.join(new, self._same("h", "n", self.keys), "full_outer")
            .where((is_open | stays) & ~(is_open & stays & self._same("h", "n", self.tracked)))
            .select(F.when(F.col("h._there"), F.struct(*[F.col(f"h.{c}") for c in self.columns])).alias("h"),
                    F.when(stays, F.struct(*[F.col(f"n.{c}") for c in self.plain])).alias("n")),
            "changed")
        ended = [*[F.col(f"h.{c}").alias(c) for c in [*self.plain, "valid_from"]],
                 F.when(F.col("h.is_current"), time).otherwise(F.col("h.valid_to")).alias("valid_to"),
                 F.lit(False).alias("is_current")]
        heads = changed.where("n is not null").select("n.*", *opened).unionByName(
            changed.where("n is null").select(*ended))
        return self._commit(heads, changed.where("n is not null and h is not null").select(*ended), time)

    def extend(self, changes: DataFrame, time: str) -> int:
        """New rows of a log of states, any number a key.

        Loads in order of time give the history that `scd2` gives for all rows
        at once. A key may hold most of the rows. Returns the version of the heads.
        """
        order, until = [time, *self.carried], self.loaded_until()
        needed = list(dict.fromkeys([*self.plain, time]))
        rows = changes.select(*needed).withColumn(time, F.col(time).cast("timestamp_ntz"))
        late = F.col(time).isNull() if until is None else (
            F.col(time).isNull() | (F.col(time) <= F.lit(until).cast("timestamp_ntz")))
        refused, last = rows.agg(F.count_if(late), F.max(time).cast("string")).first()
        if refused:
            raise LateRows(f"{refused} rows have no time, or none after {until}")
        if last is None and until is not None:
            return self.store.version(self.heads)
        if until is None:
            versions = self._versions(rows, order)
            return self._commit(versions.where("is_current"), versions.where("not is_current"),
                                F.lit(last).cast("timestamp_ntz"))
        # A hot key is one row of `met`; only the buckets of these keys are read.
        met = cut_lineage(rows.select(*self.keys).distinct(), "met")
        known = cut_lineage(
            self.store.read_touched(self.heads, met, self.keys).alias("h")
            .join(met.alias("m"), self._same("h", "m", self.keys), "left_semi").select(*self.columns), "known")
        # An open version takes part as the row that opened it; one that ended stays as it is.
        as_row = known.where("is_current").withColumn(time, F.col("valid_from")).select(*needed)
        versions = self._versions(rows.unionByName(as_row), order)
        opened_by = [*self.keys, "valid_from", *self.carried]
        heads = versions.where("is_current").alias("v").join(
            known.where("is_current").alias("k"), self._same("v", "k", opened_by), "left_anti")
        past = versions.where("not is_current").unionByName(known.where("not is_current"))
        return self._commit(heads, past, F.lit(last).cast("timestamp_ntz"))

    def vacuum(self, keep: int = 2) -> None:
        """Drop what only older versions of the heads use."""
        self.store.vacuum(self.heads, keep)

    # -- parts --------------------------------------------------------------

    def _versions(self, rows: DataFrame, order: Sequence[str]) -> DataFrame:
        return cut_lineage(scd2(rows, self.keys, self.tracked, order).select(*self.columns), "versions")

    def _committed(self, table: str) -> DataFrame:
        return self.store.read_appended(table, LOAD).where(F.col(LOAD) <= _number(self.store.version(self.heads)))

    @staticmethod
    def _same(a: str, b: str, columns: Sequence[str]) -> Column:
        return reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(True))

    def _commit(self, heads: DataFrame, past: DataFrame | None, until: Column) -> int:
        """Everything under the number that the heads are about to get, the heads last."""
        number = _number(self.store.version(self.heads) + 1)
        one = self.spark.range(1)
        if self.store.has_appended(self.past):
            self.store.drop_ingest(self.past, one.select(F.lit(number).alias(LOAD)), LOAD)
        if past is not None:
            self.store.append(self.past, past.withColumn(LOAD, F.lit(number)), LOAD, gather=False)
        self.store.append(self.loads, one.select(until.alias("until"), F.lit(number).alias(LOAD)), LOAD, gather=False)
        return self.store.merge(self.heads, heads, self.keys, ["valid_from"])


def _number(version: int) -> str:
    return f"{version:08d}"
