from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lakewright.operators import ledger
from lakewright.plans.folder import LostFiles, ingest_folder, ingest_on_arrival
from lakewright.plans.ingest import LEDGER, Ingestion
from lakewright.plans.specs import ORDERS, UnknownTable, from_dict, get_spec
from lakewright.sinks.store import TableStore
from lakewright.sources.landing import HookRegistry

SPECS = from_dict(ORDERS)
SPEC = SPECS[("sales", "orders")]
HEADER = ",".join(SPEC.names)
GOOD = [f"{HEADER}\n1,10,F,5.50,2020-01-01,HIGH\n2,11,O,6.00,2020-01-02,LOW\n",
        f"{HEADER}\n2,10,P,7.25,2020-02-01,LOW\n3,11,F,bad,2020-02-02,LOW\n4,99,F,1.00,2020-02-03,LOW\n4,10,F,2.00,2020-02-03,LOW\n"]


def land(root, name, text, table="orders", area="raw"):
    folder = root / area / "sales" / table
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def make_job(spark, root, hooks=None, spec=SPEC):
    parents = {"customer": spark.createDataFrame([(10,), (11,)], "c_custkey bigint")}
    return Ingestion(spark, TableStore(spark, str(root / "lake")), spec, parents, hooks)


@pytest.fixture(scope="module", autouse=True)
def light(spark):
    """A handful of rows: compiling plans would take most of the time."""
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false",
                "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def root(tmp_path):
    for i, text in enumerate(GOOD):
        land(tmp_path, f"file +[{i}].csv", text)
    return tmp_path


def main_rows(job):
    return sorted(tuple(map(str, r)) for r in job.main_table().select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").collect())


EXPECTED = [("1", "10", "F", "5.50"), ("2", "10", "P", "7.25")]


def check_finished(job, entries):
    assert {(r.file_name, r.stage, r.rows_read) for r in entries.collect()} == {
        ("file +[0].csv", "COMPLETED", 2), ("file +[1].csv", "COMPLETED", 4)}
    assert main_rows(job) == EXPECTED
    summary = {r.file_name: (r.rows_clean, r.rows_review) for r in job.summary(entries).collect()}
    assert summary == {"file +[0].csv": (2, 0), "file +[1].csv": (1, 3)}
    review = {(r.o_orderkey, tuple(r._failed_tests)) for r in job.store.read_appended(job.review, "_batch").collect()}
    assert review == {(3, ("not_null_o_totalprice",)), (4, ("unique_o_orderkey", "relationships_o_custkey")),
                      (4, ("unique_o_orderkey",))}


def test_folder_end_to_end(spark, root, now):
    job = make_job(spark, root)
    entries = ingest_folder(job, str(root), now(), "run")
    check_finished(job, entries)
    ledger.assert_completed(entries)
    assert not list((root / "raw/sales/orders").glob("*.csv"))
    assert len(list((root / "archive/sales/orders").glob("*.csv"))) == 2
    assert not job.store.has_appended(job.staging)


@pytest.mark.parametrize("stage", ["NEW", "ARCHIVED", "STAGED", "CLEANED", "INSERTED"])
def test_crash_after_each_stage(spark, root, now, stage):
    job = make_job(spark, root)
    partial = ingest_folder(job, str(root), now("2024-02-01 00:00:00"), "first", stop_after=stage)
    assert {r.stage for r in partial.select("stage").collect()} == {stage}
    with pytest.raises(ledger.IncompleteRun):
        ledger.assert_completed(partial)
    check_finished(job, ingest_folder(job, str(root), now("2024-02-01 01:00:00"), "second"))


@pytest.mark.parametrize("step", ["_stage", "_clean", "_insert", "_tidy"])
def test_crash_before_the_ledger_row(spark, root, now, step, monkeypatch):
    """The work of a step is done, its transition is not: the step runs again."""
    job = make_job(spark, root)
    original = getattr(Ingestion, step)

    def dies(self, *args):
        original(self, *args)
        raise RuntimeError("lost")

    monkeypatch.setattr(Ingestion, step, dies)
    with pytest.raises(RuntimeError, match="lost"):
        ingest_folder(job, str(root), now("2024-02-01 00:00:00"), "first")
    monkeypatch.undo()
    check_finished(job, ingest_folder(job, str(root), now("2024-02-01 01:00:00"), "second"))


def test_running_again_changes_nothing(spark, root, now):
    job = make_job(spark, root)
    ingest_folder(job, str(root), now(), "run")
    count = job.ledger.transitions().count()
    ingest_folder(job, str(root), now(), "again")
    assert job.ledger.transitions().count() == count
    assert main_rows(job) == EXPECTED


def test_ledger_compaction(spark, root, now):
    job = make_job(spark, root)
    entries = ingest_folder(job, str(root), now(), "run")
    before = sorted(map(str, job.ledger.entries().collect()))
    job.ledger.compact(2)
    assert not job.store.has_appended(LEDGER)
    assert sorted(map(str, job.ledger.entries().collect())) == before
    job.ledger.compact(2)
    check_finished(job, job.ledger.entries().where("increment = 0"))
    assert entries.columns


def test_folding_keeps_two_versions_and_survives_another_writer(spark, root, now, monkeypatch):
    from lakewright.sinks.store import CommitConflict
    job = make_job(spark, root)
    ingest_folder(job, str(root), now(), "first", stop_after="ARCHIVED")
    before = job.ledger.entries().count()
    write, tries = TableStore.write, []

    def beaten(self, table, df):
        tries.append(table)
        if len(tries) == 1:
            write(self, table, df)  # the other writer's fold of the same rows
            raise CommitConflict("first")
        return write(self, table, df)

    monkeypatch.setattr(TableStore, "write", beaten)
    job.ledger.compact(1)
    monkeypatch.undo()
    assert len(tries) == 2 and job.ledger.entries().count() == before and not job.store.has_appended(LEDGER)
    assert job.ledger.transitions().count() == job.ledger.transitions().distinct().count()
    for n in range(3):
        job.ledger.append(ledger.advance(job.ledger.entries(), F.lit("STAGED"), now(f"2024-02-0{n + 2} 00:00:00")), f"n{n}")
        job.ledger.compact(1)
    assert len(list((root / "lake" / LEDGER / "_commits").glob("0*"))) == 2
    assert len(list((root / "lake" / LEDGER).glob("v=*"))) == 2
    assert job.ledger.entries().count() == before


def test_header_mismatch_stops_the_file(spark, root, now):
    land(root, "wide.csv", HEADER + ",o_comment\n9,10,F,1.00,2020-01-01,LOW,hello\n")
    land(root, "narrow.csv", "o_custkey,o_orderkey,o_orderstatus,o_totalprice,o_orderdate\n10,8,F,1.00,2020-01-01\n")
    land(root, "swapped.csv", HEADER.replace("o_orderkey,o_custkey", "o_custkey,o_orderkey") + "\n10,8,F,1.00,2020-01-01,LOW\n")
    job = make_job(spark, root)
    entries = {r.file_name: r.stage for r in ingest_folder(job, str(root), now(), "run").collect()}
    assert entries == {"file +[0].csv": "COMPLETED", "file +[1].csv": "COMPLETED", "wide.csv": "NEW", "narrow.csv": "NEW",
                       "swapped.csv": "NEW"}
    assert (root / "raw/sales/orders/wide.csv").exists()


def test_file_without_rows(spark, tmp_path, now):
    land(tmp_path, "bare.csv", HEADER + "\n")
    job = make_job(spark, tmp_path)
    entries = ingest_folder(job, str(tmp_path), now(), "run")
    assert [(r.stage, r.rows_read) for r in entries.collect()] == [("COMPLETED", 0)]


def test_zero_byte_wrong_depth_and_other_tables_are_ignored(spark, root, now):
    land(root, "empty.csv", "")
    land(root, "x.csv", "a\n1\n", table="orders/deep")
    land(root, "y.csv", "a\n1\n", table="other")
    entries = ingest_folder(make_job(spark, root), str(root), now(), "run")
    assert {r.file_name for r in entries.collect()} == {"file +[0].csv", "file +[1].csv"}


def test_lost_file_is_an_error(spark, root, now):
    job = make_job(spark, root)
    ingest_folder(job, str(root), now(), "first", stop_after="NEW")
    (root / "raw/sales/orders/file +[0].csv").unlink()
    with pytest.raises(LostFiles):
        ingest_folder(job, str(root), now(), "second")


def test_hook_runs_before_staging(spark, root, now):
    hooks = HookRegistry()
    hooks.register("sales", "orders")(lambda raw: raw.withColumn(
        "o_totalprice", F.when(F.col("o_totalprice") == "bad", "3.00").otherwise(F.col("o_totalprice"))))
    job = make_job(spark, root, hooks)
    ingest_folder(job, str(root), now(), "run")
    assert ("3", "11", "F", "3.00") in main_rows(job)
    with pytest.raises(ValueError):
        hooks.register("sales", "orders")(lambda raw: raw)


def test_append_load_keeps_every_row(spark, root, now):
    body = {**ORDERS["tables"]["orders"], "load": "append"}
    spec = from_dict({"source": "sales", "tables": {"orders": body}})[("sales", "orders")]
    job = make_job(spark, root, spec=spec)
    ingest_folder(job, str(root), now(), "first", stop_after="INSERTED")
    land(root, "file 2.csv", f"{HEADER}\n7,10,F,1.00,2020-01-01,LOW\n")
    ingest_folder(job, str(root), now(), "second")
    assert [r[0] for r in main_rows(job)] == ["1", "2", "2", "7"]


def test_review_rows_can_be_repaired(spark, root, now):
    job = make_job(spark, root)
    ingest_folder(job, str(root), now("2024-02-01 00:00:00"), "run")
    waiting = job.ledger.entries().where("increment = 1")
    assert {(r.stage, r.rows_read) for r in waiting.collect()} == {("STAGED", 3)}
    fixed = job.retry_review(
        waiting, lambda rows: rows.withColumn("o_totalprice", F.coalesce("o_totalprice", F.lit(3).cast("decimal(18,2)"))),
        now("2024-02-02 00:00:00"), "repair")
    assert {(r.increment, r.stage) for r in fixed.collect()} == {(1, "COMPLETED")}
    assert ("3", "11", "F", "3.00") in main_rows(job)
    assert {(r.stage, r.rows_read) for r in job.ledger.entries().where("increment = 2").collect()} == {("STAGED", 2)}


def test_files_arriving_as_a_stream(spark, root, now, tmp_path):
    job = make_job(spark, root)
    for _ in range(2):
        ingest_on_arrival([job], str(root), str(tmp_path / "offsets"), now).awaitTermination()
        land(root, "late.csv", f"{HEADER}\n5,10,O,9.00,2020-03-01,LOW\n")
    ingest_on_arrival([job], str(root), str(tmp_path / "offsets"), now).awaitTermination()
    assert main_rows(job) == [*EXPECTED, ("5", "10", "O", "9.00")]


def test_a_batch_that_comes_again_goes_on_where_it_stopped(spark, root, now, tmp_path, monkeypatch):
    """Its files are in the archive by then, so the stream does not find them in their old place."""
    job, offsets = make_job(spark, root), str(tmp_path / "offsets")
    original = Ingestion._clean

    def dies(self, *args):
        original(self, *args)
        raise RuntimeError("lost")

    monkeypatch.setattr(Ingestion, "_clean", dies)
    with pytest.raises(Exception, match="lost"):
        ingest_on_arrival([job], str(root), offsets, now).awaitTermination()
    monkeypatch.undo()
    assert not list((root / "raw/sales/orders").glob("*.csv"))
    ingest_on_arrival([job], str(root), offsets, lambda: now("2024-02-01 01:00:00")).awaitTermination()
    check_finished(job, job.ledger.entries().where("increment = 0"))


def test_a_batch_that_takes_too_long_is_cancelled_and_ends_the_stream(spark, root, now, tmp_path):
    job, offsets = make_job(spark, root), str(tmp_path / "offsets")

    @F.udf("boolean")
    def slow(_):
        import time
        time.sleep(120)
        return True

    job.hooks = HookRegistry()
    job.hooks.register("sales", "orders")(lambda raw: raw.where(slow("o_orderkey")))
    with pytest.raises(Exception, match="cancelled after"):
        ingest_on_arrival([job], str(root), offsets, now, minutes=0.3).awaitTermination()
    job.hooks = HookRegistry()
    ingest_on_arrival([job], str(root), offsets, lambda: now("2024-02-01 01:00:00")).awaitTermination()
    check_finished(job, job.ledger.entries().where("increment = 0"))


@pytest.mark.parametrize("stage", ["STAGED", "CLEANED"])
def test_rows_of_an_abandoned_entry_are_neither_read_nor_kept(spark, root, now, stage):
    """Both files lie in one staging partition."""
    job = make_job(spark, root)
    ingest_folder(job, str(root), now(), "first", stop_after=stage)
    hashed = job.ledger.entries().withColumn("row_hash", ledger.entry_hash())
    second = hashed.where("file_name = 'file +[1].csv' and increment = 0")
    assert job.abandon(second, now("2024-02-01 01:00:00"), "gone").count() == 1
    assert job.store.has_appended(job.staging)
    ingest_folder(job, str(root), now("2024-02-01 02:00:00"), "second")
    assert {r.file_name: r.stage for r in job.ledger.entries().where("increment = 0").collect()} == {
        "file +[0].csv": "COMPLETED", "file +[1].csv": "ABANDONED"}
    assert main_rows(job) == [("1", "10", "F", "5.50"), ("2", "11", "O", "6.00")]
    assert not job.store.has_appended(job.staging)


def test_abandoning_all_entries_drops_their_staging_at_once(spark, root, now):
    job = make_job(spark, root)
    ingest_folder(job, str(root), now(), "first", stop_after="STAGED")
    hashed = job.ledger.entries().withColumn("row_hash", ledger.entry_hash())
    assert job.abandon(hashed, now("2024-02-01 01:00:00"), "gone").count() == 2
    assert not job.store.has_appended(job.staging)
    assert job.abandon(hashed, now("2024-02-01 01:30:00"), "again").count() == 0


def test_an_abandoned_review_entry_is_not_taken_through_again(spark, root, now):
    job = make_job(spark, root)
    ingest_folder(job, str(root), now(), "run")
    waiting = job.ledger.entries().where("increment = 1")
    job.abandon(waiting.withColumn("row_hash", ledger.entry_hash()), now("2024-02-01 01:00:00"), "gone")
    job.retry_review(waiting, lambda rows: rows, now("2024-02-02 00:00:00"), "repair")
    assert [r.stage for r in job.ledger.entries().where("increment = 1").collect()] == ["ABANDONED"]
    assert main_rows(job) == EXPECTED


def test_specs():
    with pytest.raises(UnknownTable, match="'beta'.*'sales'"):
        get_spec(SPECS, "sales", "beta")
    with pytest.raises(ValueError, match="needs keys"):
        from_dict({"source": "s", "tables": {"t": {"load": "merge", "columns": []}}})


def test_one_call_leaves_a_folded_ledger_and_rebuilt_models(spark, root, now):
    from lakewright.plans.models import ModelRegistry
    registry = ModelRegistry()
    registry.model("gold/statuses", ["sales/orders"])(lambda t: t["sales/orders"].groupBy("o_orderstatus").count())
    job = make_job(spark, root)
    job.models = registry
    check_finished(job, ingest_folder(job, str(root), now(), "run"))
    assert not job.store.has_appended(LEDGER) and job.store.version(LEDGER) == 1
    assert {r.o_orderstatus for r in registry.read(job.store, "gold/statuses").collect()} == {"F", "P"}


def test_a_declaration_that_the_table_outgrew_is_refused(spark, root, now):
    from lakewright.operators.quality import SchemaMismatch
    ingest_folder(make_job(spark, root), str(root), now(), "run")
    columns = tuple((c, "string" if c == "o_custkey" else k) for c, k in SPEC.columns)
    with pytest.raises(SchemaMismatch, match="o_custkey: string does not fit bigint"):
        ingest_folder(make_job(spark, root, spec=replace(SPEC, columns=columns)), str(root), now(), "again")


def test_a_file_in_another_encoding_does_not_stop_the_others(spark, root, now):
    (root / "raw/sales/orders/odd.csv").write_bytes("o_orderkeyé,x\n1,2\n".encode("latin-1"))
    entries = {r.file_name: r.stage for r in ingest_folder(make_job(spark, root), str(root), now(), "run").collect()}
    assert entries == {"file +[0].csv": "COMPLETED", "file +[1].csv": "COMPLETED", "odd.csv": "NEW"}


def test_declarations_are_checked_whole():
    from lakewright.plans.specs import declaration_problems
    assert declaration_problems(ORDERS) == []
    wrong = {"source": "s", "tables": {"t": {"columns": [{"name": "a", "type": "blob"}, {"name": "a", "type": "int", "size": 3}],
                                             "keys": ["b"], "load": "swap"}, "u": {}}}
    assert declaration_problems(wrong) == [
        "t: load is neither append nor merge", "t: column a is declared more than once", "t: key b is not a column",
        "t.a: unknown type blob", "t.a: unknown word size", "u: no columns"]
