from pyspark.sql import functions as F

from lakewright.operators import quality
from lakewright.session import cut_lineage


def test_rows_are_not_shuffled_for_few_failing_keys(spark):
    rows = cut_lineage(spark.range(60_000).select(
        F.when(F.col("id") == 7, 8).otherwise(F.col("id")).alias("k"), (F.col("id") % 50).alias("p"), F.lit("x" * 50).alias("text")))
    parents = spark.range(49).select(F.col("id").alias("p"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        tested = quality.tag_failures(rows, [quality.unique("k"), quality.relationships("p", parents, "p")])
        plan = tested._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        failed = {r.k: r["_failed_tests"] for r in tested.where(F.size("_failed_tests") > 0).collect() if r.p != 49}
        assert failed == {8: ["unique_k"]}
        assert tested.where(F.array_contains("_failed_tests", "relationships_p")).count() == 1200
        assert tested.count() == 60_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
