import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from lakewright.operators.history import dedupe, merge, neighbour, scd2

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belongs to one key; some keys are NULL; many times repeat."""
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rng.randint(0, 40)}")
        rows.append((key, START + timedelta(hours=rng.randint(0, 900)), i, rng.choice(["a", "b", None])))
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, v string").cache()


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("parts", [1, 4, 23])
def test_neighbour_equals_plain_window(spark, skewed, forward, parts):
    value = F.struct("v", "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        ours = neighbour(skewed, ["k"], ["ts", "id"], value, "n", forward).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = skewed.withColumn("n", (F.lead if forward else F.lag)(value).over(w))
    assert sorted(map(str, ours)) == sorted(map(str, plain.collect()))


def test_null_key_can_be_hot(spark):
    df = spark.createDataFrame([(None, START, i) for i in range(50)], "k string, ts timestamp_ntz, id int")
    out = neighbour(df, ["k"], ["ts", "id"], F.struct("id"), "n")
    assert [r.n.id for r in out.orderBy("id").collect()[1:]] == list(range(49))


def test_empty_history(spark, skewed):
    assert neighbour(skewed.limit(0), ["k"], ["ts", "id"], F.struct("v"), "n").count() == 0


def test_scd2_intervals_do_not_overlap(skewed):
    known = skewed.where("k is not null")
    versions = scd2(known, ["k"], ["v"], ["ts", "id"])
    frame = versions.toPandas().sort_values(["k", "valid_from", "id"])
    assert (frame.groupby("k")["is_current"].sum() == 1).all()
    for _, group in frame.groupby("k"):
        following = group["valid_from"].shift(-1).dropna().tolist()
        assert group["valid_to"].iloc[:-1].tolist() == following
        state = group["v"].where(group["v"].notna(), "none")
        assert (state.iloc[1:].values != state.iloc[:-1].values).all()


def test_merge_twice_is_merge_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    once = merge(target, updates, ["k"], ["v"])
    twice = merge(once, updates, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_dedupe_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "b"), (2, 1, None)], "k int, n int, v string")
    out = dedupe(df, ["k"], ["n"])
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, 2, "b"), (2, 1, None)]
    assert isinstance(out.toPandas(), pd.DataFrame)
