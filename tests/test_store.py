import pytest
from pyspark.sql import functions as F

from lakewright.session import cut_lineage, scratch_path, shared_dir
from lakewright.sinks.store import CommitConflict, SchemaConflict, TableStore


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "lake"))


def test_scratch_lies_in_the_named_folder(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert scratch_path(spark, "x").startswith(f"{named}/lakewright/{spark.sparkContext.applicationId}/x-")
    kept = cut_lineage(spark.range(3))
    assert kept.count() == 3 and kept.inputFiles()[0].startswith(f"file://{named}")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_append_twice_is_append_once(spark, store):
    def part(i, n):
        return spark.range(n).select(F.col("id"), F.lit(i).alias("_ingest_id"))
    store.append("t", part("001", 2))
    store.append("t", part("2", 3))
    store.append("t", part("001", 2))
    out = store.read_appended("t")
    assert out.count() == 5
    assert {r._ingest_id for r in out.collect()} == {"001", "2"}


def test_hot_ingest_id_is_written_whole(spark, store):
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("_ingest_id"))
    store.append("t", df)
    assert store.read_appended("t").where("_ingest_id = 'hot'").count() == 3000


def test_drop_ingest(spark, store):
    store.append("t", spark.createDataFrame([(1, "a"), (2, "b")], "v int, _ingest_id string"))
    store.drop_ingest("t", spark.createDataFrame([("a",), ("gone",)], "_ingest_id string"))
    assert rows(store.read_appended("t")) == [(2, "b")]
    with pytest.raises(ValueError):
        store.drop_ingest("t", spark.createDataFrame([("../x",)], "_ingest_id string"))


def test_read_batches_prunes(spark, store):
    store.append("t", spark.createDataFrame([(i, f"p{i}") for i in range(4)], "v int, _ingest_id string"))
    ids = spark.createDataFrame([("p1",), ("p3",)], "_ingest_id string")
    assert rows(store.read_batches("t", ids)) == [(1, "p1"), (3, "p3")]
    plan = store.read_batches("t", ids)._jdf.queryExecution().toString()
    assert "PartitionFilters: [_ingest_id" in plan


def test_versions(spark, store):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (3, "z")], "k int, v string")
    store.write("t", a)
    before = store.read("t")
    store.merge("t", b, ["k"], ["v"])
    once = rows(store.read("t"))
    store.merge("t", b, ["k"], ["v"])
    assert rows(store.read("t")) == once == [(1, "a"), (2, "x"), (3, "z")]
    assert rows(before) == [(1, "a"), (2, "b")]  # an open reader keeps its version
    assert store.version("t") == 3
    store.vacuum("t", keep=1)
    assert rows(store.read("t")) == once


def test_merge_into_nothing(spark, store):
    store.merge("t", spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"], ["v"])
    assert rows(store.read("t")) == [(1, "b")]


def test_unfinished_version_is_invisible(spark, store):
    store.write("t", spark.range(3))
    spark.range(99).write.parquet(f"{store.path('t')}/v=00000002")  # died before its commit
    assert store.read("t").count() == 3
    store.write("t", spark.range(4))
    assert store.read("t").count() == 4
    with pytest.raises(CommitConflict):
        store._commit("t", 2, [], spark.range(1).schema, None)


def test_optimize_keeps_rows(spark, store):
    store.write("t", spark.range(500).select("id", (F.col("id") % 7).alias("n")))
    store.optimize("t", ["n", "id"], 4)
    assert store.read("t").count() == 500


def test_optimize_keeps_the_buckets(spark, store):
    store.merge("t", spark.range(1000).selectExpr("id", "cast(id % 7 as string) v"), ["id"], ["v"])
    store.merge("t", spark.createDataFrame([(5, "new")], "id bigint, v string"), ["id"], ["v"])
    store.optimize("t", ["v", "id"], 4)
    before = set(store._parts("t", 3))
    store.merge("t", spark.createDataFrame([(5, "newer"), (2000, "new")], "id bigint, v string"), ["id"], ["v"])
    after = set(store._parts("t", 4))
    assert len(before) == len(after) == 16 and len(after - before) <= 2
    assert store.read("t").count() == 1001 and store.read("t").where("v = 'newer'").count() == 1
    assert store.read("t").columns == ["id", "v"]


def test_merge_rewrites_touched_buckets_only(spark, store):
    store.merge("t", spark.range(1000).selectExpr("id", "'old' v"), ["id"], ["v"])
    before = set(store._parts("t", 1))
    store.merge("t", spark.createDataFrame([(5, "new"), (2000, "new")], "id bigint, v string"), ["id"], ["v"])
    after = set(store._parts("t", 2))
    assert len(before) == len(after) == 16 and len(after - before) <= 2
    table = store.read("t")
    assert table.columns == ["id", "v"]
    assert table.count() == 1001 and table.where("v = 'new'").count() == 2
    store.vacuum("t", keep=1)
    assert store.read("t").count() == 1001
    assert store.version("t") == 2


def test_bucket_count_stays_with_the_table(spark, tmp_path):
    root = str(tmp_path / "lake")
    new = spark.range(200).selectExpr("id k", "'new' v")
    TableStore(spark, root, 4).merge("t", spark.range(200).selectExpr("id k", "'old' v"), ["k"], ["v"])
    other = TableStore(spark, root, 7)
    for part in (0, 1):
        other.merge("t", new.where(f"k % 2 = {part}"), ["k"], ["v"])
    assert rows(other.read("t")) == [(i, "new") for i in range(200)]
    assert other._commit_of("t", 3)["buckets"] == 4


def test_merge_adds_columns_and_refuses_wider_types(spark, store):
    store.merge("t", spark.createDataFrame([(i, "a") for i in range(40)], "k bigint, v string"), ["k"], ["v"])
    store.merge("t", spark.createDataFrame([(3, "b", 1.5)], "k int, v string, w double"), ["k"], ["v"])
    table = store.read("t")
    assert table.dtypes == [("k", "bigint"), ("v", "string"), ("w", "double")] and table.count() == 40
    assert rows(table.where("w is not null")) == [(3, "b", 1.5)]
    with pytest.raises(SchemaConflict):
        store.merge("t", spark.createDataFrame([("3", "b")], "k string, v string"), ["k"], ["v"])


def test_append_adds_columns(spark, store):
    store.append("t", spark.createDataFrame([(1, "a")], "v int, _ingest_id string"))
    store.append("t", spark.createDataFrame([(2, "x", "b")], "v int, w string, _ingest_id string"))
    store.append("t", spark.createDataFrame([(3, "c")], "v int, _ingest_id string"))
    assert sorted(map(tuple, store.read_appended("t").select("v", "w").collect()), key=str) == [(1, None), (2, "x"), (3, None)]
    with pytest.raises(SchemaConflict):
        store.append("t", spark.createDataFrame([(1.5, "d")], "v double, _ingest_id string"))


def test_null_in_a_key_merges_once(spark, store):
    updates = spark.createDataFrame([(1, None, "x"), (1, 2, "y")], "a int, b int, v string")
    for _ in range(3):
        store.merge("t", updates, ["a", "b"], ["v"])
    assert store.read("t").count() == 2


def test_catalogue_shows_the_current_version_only(spark, store):
    spark.sql("create database if not exists shown")
    try:
        for n in (10, 4):
            store.write("t", spark.range(n))
            store.show_as("t", "shown.t")
        assert spark.table("shown.t").count() == 4
        for v in ("a", "b"):
            store.merge("m", spark.createDataFrame([(i, v) for i in range(10)], "k int, v string"), ["k"], ["v"])
            store.show_as("m", "shown.m")
        table = spark.table("shown.m")
        assert table.columns == ["k", "v"] and rows(table) == [(i, "b") for i in range(10)]
    finally:
        spark.sql("drop database shown cascade")
    assert store.read("m").count() == 10
