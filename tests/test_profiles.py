import shutil

import pytest
from pyspark.sql import functions as F

from lakewright.plans.models import document_table
from lakewright.plans.profiles import Profiles
from lakewright.sinks.store import TableStore

COLUMNS = ["table_name", "column_name", "type", "rows", "nulls", "min_value", "max_value"]


@pytest.fixture
def profiles(spark, tmp_path):
    return Profiles(TableStore(spark, str(tmp_path / "lake")))


def table(spark, first, last, day):
    return spark.range(first, last).select(
        F.lit(day).alias("day"), F.col("id"), (F.col("id") % 7).cast("int").alias("few"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), F.col("id") % 50)).alias("text"),
        (F.col("id") / 3).alias("ratio"), (F.col("id") * 1.25).cast("decimal(38,2)").alias("price"),
        F.array("id").alias("list"), F.create_map(F.lit("n"), F.col("id") % 5).alias("pairs"), F.lit(None).cast("date").alias("none"))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_partitions_fold_to_the_profile_of_the_whole(spark, profiles):
    whole = table(spark, 0, 900, "1").unionByName(table(spark, 900, 2100, "2"))
    profiles.add("t", whole, "day")
    got = profiles.document()
    plain = document_table(whole.drop("day"), "t", exact=True)
    assert rows(got.select(COLUMNS)) == rows(plain.select(COLUMNS))
    counted = {r.column_name: r.distinct_values for r in plain.collect()}
    for row in got.collect():
        assert row.partitions == 2
        assert abs(row.distinct_values - counted[row.column_name]) <= 0.05 * counted[row.column_name]


def test_adding_a_partition_reads_only_it(spark, profiles, tmp_path):
    old = str(tmp_path / "old")
    table(spark, 0, 900, "1").write.parquet(old)
    profiles.add("t", spark.read.parquet(old), "day")
    shutil.move(old, str(tmp_path / "elsewhere"))  # nothing can read it any more
    profiles.add("t", table(spark, 900, 1000, "2"), "day")
    assert {r.rows for r in profiles.document().collect()} == {1000}


def test_a_partition_that_comes_again_replaces_itself_and_one_that_goes_is_forgotten(spark, profiles):
    profiles.add("t", table(spark, 0, 10, "1"), "day")
    profiles.add("t", table(spark, 5, 40, "2"), "day")
    profiles.add("t", table(spark, 0, 20, "1"), "day")
    profiles.add("u", table(spark, 0, 3, "1"), "day")
    assert {(r.table_name, r.rows) for r in profiles.document().collect()} == {("t", 55), ("u", 3)}
    profiles.drop("t", spark.createDataFrame([("2",)], "day string"))
    bounds = {r.column_name: (r.min_value, r.max_value) for r in profiles.document().where("table_name = 't'").collect()}
    assert bounds["id"] == ("0", "19")  # as numbers: as texts 9 would be the largest
    assert bounds["none"] == bounds["list"] == (None, None)


def test_no_rows(spark, profiles):
    profiles.add("t", table(spark, 0, 5, "1").limit(0), "day")
    profiles.add("t", table(spark, 0, 5, "1"), "day")
    assert {r.rows for r in profiles.document().collect()} == {5}


def test_exact_counts_go_by_value_and_kind(spark):
    df = spark.createDataFrame([(1, "1", 1.0, [1]), (1, "01", 1.5, [1]), (None, None, None, None), (2, "", 1.0, [])],
                               "a int, b string, c double, d array<int>")
    counted = {r.column_name: r.distinct_values for r in document_table(df, "t", exact=True).collect()}
    assert counted == {"a": 2, "b": 3, "c": 2, "d": 2}
