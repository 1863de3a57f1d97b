from datetime import datetime, timedelta
import random

import pytest
from pyspark.sql import functions as F

from lakewright.operators.history import scd2
from lakewright.plans.snapshots import LateRows, Snapshot
from lakewright.sinks.store import TableStore

START = datetime(2024, 1, 1)


@pytest.fixture
def snapshot(spark, tmp_path):
    return Snapshot(TableStore(spark, str(tmp_path / "lake"), buckets=8), "t", ["k"], ["v"], ["id"])


def rows(df):
    return sorted(map(repr, df.collect()))


def log(spark, seed=1, n=400):
    """A third of the rows has one key; some keys and states are NULL."""
    rng = random.Random(seed)
    return spark.createDataFrame(
        [("hot" if i % 3 == 0 else rng.choice([None, *"abcdefgh"]), START + timedelta(hours=rng.randint(0, 300)), i,
          rng.choice(["x", "y", None])) for i in range(n)], "k string, ts timestamp_ntz, id int, v string")


def between(df, first, last):
    return df.where((F.col("ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ts") < F.lit(last).cast("timestamp_ntz")))


def test_loads_in_order_equal_the_one_shot_history(spark, snapshot):
    changes = log(spark).cache()
    for first, last in [("2024-01-01", "2024-01-04"), ("2024-01-04", "2024-01-05"), ("2024-01-05", "2024-02-01")]:
        snapshot.extend(between(changes, first, last), "ts")
    whole = scd2(changes, ["k"], ["v"], ["ts", "id"])
    assert rows(snapshot.history().select(*whole.columns)) == rows(whole)
    assert snapshot.current().groupBy("k").count().where("count > 1").isEmpty()


def test_late_rows_and_rows_without_time_are_refused_before_anything_is_written(spark, snapshot):
    changes = log(spark).cache()
    snapshot.extend(between(changes, "2024-01-01", "2024-01-05"), "ts")
    before, version = rows(snapshot.history()), snapshot.store.version(snapshot.heads)
    with pytest.raises(LateRows):
        snapshot.extend(changes, "ts")
    with pytest.raises(LateRows):
        snapshot.extend(spark.createDataFrame([("a", None, 1, "x")], changes.schema), "ts")
    assert snapshot.extend(changes.limit(0), "ts") == version
    assert rows(snapshot.history()) == before


def test_empty_first_load(spark, snapshot):
    snapshot.extend(log(spark).limit(0), "ts")
    assert snapshot.history().count() == 0
    snapshot.extend(log(spark), "ts")
    assert snapshot.history().count() == scd2(log(spark), ["k"], ["v"], ["ts", "id"]).count()


def test_keys_end_and_come_back(spark, snapshot):
    def state(*pairs):
        return spark.createDataFrame([(k, v, 0) for k, v in pairs], "k string, v string, id int")
    snapshot.load(state(("a", "x"), ("b", None), (None, "n")), "2024-01-01 00:00:00")
    snapshot.load(state(("a", "y"), (None, "n")), "2024-01-02 00:00:00")
    version = snapshot.load(state(("a", "y"), (None, "n")), "2024-01-03 00:00:00")
    assert snapshot.load(state(("z", "z")), "2024-01-03 00:00:00") == version  # the same load again
    snapshot.load(state(("a", "y"), ("a", "w"), ("b", None), (None, "n")), "2024-01-04 00:00:00")
    with pytest.raises(LateRows):
        snapshot.load(state(("a", "y")), "2024-01-02 00:00:00")
    day = lambda n: START + timedelta(days=n - 1)
    assert rows(snapshot.history().select("k", "v", "valid_from", "valid_to", "is_current")) == rows(spark.createDataFrame(
        [("a", "x", day(1), day(2), False), ("a", "y", day(2), None, True), ("b", None, day(1), day(2), False),
         ("b", None, day(4), None, True), (None, "n", day(1), None, True)],
        "k string, v string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"))


def test_a_state_after_its_key_ended_is_a_version_of_its_own(spark, snapshot):
    snapshot.load(spark.createDataFrame([("a", "x", 0), ("b", "x", 0)], "k string, v string, id int"), "2024-01-01 00:00:00")
    snapshot.load(spark.createDataFrame([("b", "x", 0)], "k string, v string, id int"), "2024-01-02 00:00:00")
    snapshot.extend(spark.createDataFrame(
        [("a", START + timedelta(days=4), 1, "x"), ("b", START + timedelta(days=4), 2, "x")],
        "k string, ts timestamp_ntz, id int, v string"), "ts")
    got = snapshot.history().orderBy("k", "valid_from").select("k", "is_current").collect()
    assert [tuple(r) for r in got] == [("a", False), ("a", True), ("b", True)]


def test_a_load_rewrites_only_the_buckets_of_changed_keys(spark, snapshot):
    def state(changed):
        return spark.range(200).select(
            F.col("id").cast("string").alias("k"), F.when(F.col("id") == changed, "new").otherwise("old").alias("v"),
            F.lit(0).alias("id"))
    snapshot.load(state(-1), "2024-01-01 00:00:00")
    before = set(snapshot.store.read(snapshot.heads).inputFiles())
    snapshot.load(state(7), "2024-01-02 00:00:00")
    after = set(snapshot.store.read(snapshot.heads).inputFiles())
    assert len(before - after) == 1 and len(after - before) == 1
    assert len(before & after) == len(before) - 1
    met = spark.createDataFrame([("7",)], "k string")
    assert len(snapshot.store.read_touched(snapshot.heads, met, ["k"]).inputFiles()) == 1


@pytest.mark.parametrize("dies_at", ["append", "merge"])
def test_a_load_that_died_is_not_seen_and_replaced(spark, snapshot, monkeypatch, dies_at):
    changes = log(spark).cache()
    first, rest = between(changes, "2024-01-01", "2024-01-05"), between(changes, "2024-01-05", "2024-02-01")
    snapshot.extend(first, "ts")
    before = rows(snapshot.history())

    def die(*args, **kwargs):
        raise RuntimeError("lost")
    with monkeypatch.context() as patched:
        patched.setattr(snapshot.store, dies_at, die)
        with pytest.raises(RuntimeError):
            snapshot.extend(rest.where("k = 'hot'"), "ts")
    assert rows(snapshot.history()) == before
    snapshot.extend(rest, "ts")
    whole = scd2(changes, ["k"], ["v"], ["ts", "id"])
    assert rows(snapshot.history().select(*whole.columns)) == rows(whole)
