import random

from pyspark.sql import functions as F

from lakewright.operators.lists import name_lists
from lakewright.operators.ranking import cluster, dense_ranks, interleave, positions, z_values


def test_dense_ranks_are_exact(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(600)] + ["aaa"] * 300
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    expected = {w: i for i, w in enumerate(sorted(set(words)))}
    found = dense_ranks(df, "w").collect()
    assert {r.value: r["rank"] for r in found} == expected
    assert {r.n for r in found} == {len(expected)}


def test_positions_in_a_hot_group(spark):
    df = spark.createDataFrame([("hot" if i % 3 else None, i) for i in range(900)], "g string, n int")
    found = positions(df, ["g"], ["n"], "p").collect()
    for group in ("hot", None):
        assert [r.p for r in sorted((r for r in found if r.g == group), key=lambda r: r.n)] == list(
            range(1, 1 + sum(1 for r in found if r.g == group)))


def test_interleave(spark):
    df = spark.createDataFrame([(5, 3)], "a bigint, b bigint")
    z = df.select(interleave([F.col("a"), F.col("b")], 3).alias("z")).first().z
    assert z == 0b011011  # bits of b and a alternate: b=011, a=101


def test_clustering_narrows_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"s{rng.randint(0, 99)}", rng.randint(0, 999), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "source string, n int, id int")
    path = str(tmp_path / "t")
    cluster(df, ["source", "n"], 8).write.parquet(path)
    laid = spark.read.parquet(path)
    assert laid.count() == 6000
    per_file = laid.groupBy(F.input_file_name().alias("f")).agg(
        F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("rows")).collect()
    assert sum(r.b - r.a < 900 for r in per_file) >= len(per_file) // 2
    # A third of the rows share one value and still spread over several files.
    hot = laid.where("source = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(hot) > 1


def test_null_values_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1), ("a", None), ("b", 2)], "s string, n int")
    assert z_values(df, ["s", "n"], 2).count() == 3


def test_large_group_comes_in_parts_in_order(spark):
    df = spark.createDataFrame([("g", f"n{i % 500:03d}") for i in range(2000)] + [(None, "x")], "g string, n string")
    rows = name_lists(df, ["g"], "n", "names", part_names=50).collect()
    parts = sorted((r for r in rows if r.g == "g"), key=lambda r: r.part)
    assert [r.part for r in parts] == list(range(10)) and {len(r.names) for r in parts} == {50}
    assert [n for r in parts for n in r.names] == [f"n{i:03d}" for i in range(500)]
    assert [(r.part, r.names) for r in rows if r.g is None] == [(0, ["x"])]
