from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lakewright.operators.alerts import failures_per_window
from lakewright.streaming import landing, state


def write_runs(spark, path, part, rows):
    spark.createDataFrame(rows, "ts timestamp, ok boolean").coalesce(1).write.parquet(f"{path}/part={part}")


def test_alert_windows_over_several_batches(spark, tmp_path):
    """Update mode keeps the trailing windows that append mode would hold back."""
    start = datetime(2024, 1, 1)
    runs = [(start + timedelta(minutes=7 * i), i % 4 != 0) for i in range(60)]
    source = str(tmp_path / "runs")
    for part in range(3):
        write_runs(spark, source, part, runs[part * 20:(part + 1) * 20])
        stream = spark.readStream.schema("ts timestamp, ok boolean").parquet(f"{source}/part=*")
        counts = state.failure_counts_stream(stream, ~F.col("ok"))
        state.write_updates(counts, str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    streamed = state.read_updates(spark, str(tmp_path / "out"), ["window_start", "window_end"])
    batch = failures_per_window(spark.createDataFrame(runs, "ts timestamp, ok boolean"), ~F.col("ok"))
    assert sorted(map(tuple, streamed.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_file_stream_sees_each_file_once(spark, tmp_path):
    folder = tmp_path / "raw" / "a" / "t"
    folder.mkdir(parents=True)
    for i in range(5):
        (folder / f"{i}.csv").write_text("x\n" * i)
    seen = []

    def collect(batch, batch_id):
        seen.append(sorted(r.file_name for r in batch.collect()))

    for _ in range(2):
        files = landing.file_stream(spark, str(tmp_path / "raw"), max_files=2)
        landing.ingest_stream(files, collect, str(tmp_path / "offsets")).awaitTermination()
    names = [n for batch in seen for n in batch]
    assert sorted(names) == ["1.csv", "2.csv", "3.csv", "4.csv"]  # the empty file never shows
    assert len(seen) >= 2


def test_overdue_rows_come_from_timers_and_completed_entries_leave_no_state(spark, tmp_path):
    """One row for each change; the timer speaks once, of entries that are still open."""
    schema = "event_id long, source string, table_name string, file_name string, increment int, ts timestamp, stage string, rows_read long"
    start = datetime(2024, 1, 1)

    def at(minutes, event, name, stage, rows=None):
        return (event, "s", "t", name, 0, start + timedelta(minutes=minutes), stage, rows)

    batches = [
        [at(0, 1, "open.csv", "NEW"), at(0, 2, "done.csv", "NEW", 5), at(3, 3, "done.csv", "COMPLETED"), at(1, 4, "slow.csv", "NEW")],
        [at(15, 5, "slow.csv", "STAGED", 7), (None, None, None, None, None, start + timedelta(minutes=95), None, None)],
        [at(96, 6, "open.csv", "STAGED"), (None, None, None, None, None, start + timedelta(minutes=300), None, None)],
        [at(301, 7, "slow.csv", "COMPLETED"), at(302, 8, "open.csv", "COMPLETED")]]
    source, out, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    seen = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/part={n}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/part=*")
        state.write_updates(state.stage_state(stream, minutes=20), out, offsets).awaitTermination()
        latest = state.read_updates(spark, out, ["source", "table_name", "file_name", "increment"], ["overdue"]).collect()
        seen.append({r.file_name: (r.stage, r.rows_read, r.date_completed is not None, r.overdue) for r in latest})
    assert seen[0] == {"open.csv": ("NEW", None, False, False), "done.csv": ("COMPLETED", 5, True, False), "slow.csv": ("NEW", None, False, False)}
    assert seen[1]["slow.csv"] == ("STAGED", 7, False, True) and seen[1]["open.csv"][3] and not seen[1]["done.csv"][3]
    assert seen[2]["open.csv"] == ("STAGED", None, False, True)
    assert seen[3] == {n: ("COMPLETED", r, True, False) for n, r in (("open.csv", None), ("done.csv", 5), ("slow.csv", 7))}
    held = spark.read.format("statestore").option("stateVarName", "entry").load(offsets)
    assert held.count() == 0
