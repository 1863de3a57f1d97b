"""Failure alerts over time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import ALERT_WINDOW


def _beyond(count: Column, op: str, threshold: int) -> Column:
    tests = {">": count > threshold, ">=": count >= threshold, "=": count == threshold,
             "<": count < threshold, "<=": count <= threshold}
    return tests[op]


def failures_per_window(runs: DataFrame, failed: Column, ts: str = "ts", size: str = ALERT_WINDOW,
                        step: str | None = None) -> DataFrame:
    """Total of failed runs per window. Works on batches and on streams."""
    span = F.window(ts, size, step) if step else F.window(ts, size)
    return runs.groupBy(span.alias("w")).agg(F.count_if(failed).alias("failed")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "failed")


def failure_alert(runs: DataFrame, failed: Column, ts: str = "ts", size: str = ALERT_WINDOW,
                  step: str | None = None, op: str = ">", threshold: int = 0, spine: bool = False) -> DataFrame:
    """Windows whose failures pass the threshold; `spine` adds windows without any run."""
    counts = failures_per_window(runs, failed, ts, size, step)
    if spine:
        grid = _spine(counts, step or size)
        counts = grid.join(counts, "window_start", "left").select(
            "window_start",
            (F.col("window_start") + F.expr(f"interval {size}")).alias("window_end"),
            F.coalesce("failed", F.lit(0).cast("bigint")).alias("failed"))
    return counts.where(_beyond(F.col("failed"), op, threshold))


#: Windows that one row stands for before they are spread.
SPINE_ROWS = 10_000


def _spine(counts: DataFrame, step: str) -> DataFrame:
    """Every `window_start` from the first to the last; spread in runs, so that one odd time does not fill a task."""
    seconds = F.expr(f"unix_seconds(timestamp_seconds(0) + interval {step})")

    def unix(column: str) -> Column:
        return F.unix_seconds(F.col(column).cast("timestamp"))

    ends = counts.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b")).where(F.col("a").isNotNull())
    spans = ends.withColumn("s", seconds).withColumn("n", F.floor((unix("b") - unix("a")) / F.col("s")))
    runs = spans.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / SPINE_ROWS))))
    first = F.col("run") * SPINE_ROWS
    steps = runs.repartition("run").withColumn("i", F.explode(F.sequence(first, F.least(first + SPINE_ROWS - 1, F.col("n")))))
    return steps.select((F.col("a") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("i") * F.col("s"))).alias("window_start"))
