import pytest
from pyspark.sql import functions as F

from lakewright.plans.folder import ingest_folder
from lakewright.sources.landing import content_digests

from .test_ingest import GOOD, HEADER, land, light, main_rows, make_job  # noqa: F401

NAME = "a.csv"


def content(job):
    return sorted((r.file_name, r.increment, r.taken) for r in job.ledger.content("sales", "orders").collect())


def stages(job):
    return sorted((r.increment, r.stage) for r in job.ledger.entries("sales", "orders").collect())


def test_the_same_content_is_archived_and_reported_and_not_read(spark, tmp_path, now):
    job = make_job(spark, tmp_path)
    land(tmp_path, NAME, GOOD[0])
    ingest_folder(job, str(tmp_path), now(), "r1")
    before = main_rows(job)
    land(tmp_path, NAME, GOOD[0])
    assert ingest_folder(job, str(tmp_path), now("2024-02-02 00:00:00"), "r2").isEmpty()
    assert main_rows(job) == before and not list((tmp_path / "raw").rglob("*.csv"))
    assert (tmp_path / "archive/sales/orders" / NAME).read_text() == GOOD[0]
    assert content(job) == [(NAME, 0, False), (NAME, 0, True)]


@pytest.mark.parametrize("dies_after", [None, "NEW", "ARCHIVED", "STAGED", "CLEANED", "INSERTED"])
def test_new_content_is_a_landing_of_its_own(spark, tmp_path, now, dies_after):
    job = make_job(spark, tmp_path)
    land(tmp_path, NAME, GOOD[0])
    ingest_folder(job, str(tmp_path), now(), "r1")
    new = f"{HEADER}\n7,10,F,1.00,2020-03-01,HIGH\n8,10,F,bad,2020-03-01,HIGH\n"
    land(tmp_path, NAME, new)
    if dies_after:
        ingest_folder(job, str(tmp_path), now("2024-02-02 00:00:00"), "r2", stop_after=dies_after)
    ingest_folder(job, str(tmp_path), now("2024-02-03 00:00:00"), "r3")
    assert ("7", "10", "F", "1.00") in main_rows(job) and ("1", "10", "F", "5.50") in main_rows(job)
    assert stages(job) == [(0, "COMPLETED"), (100, "COMPLETED"), (101, "STAGED")]
    archive = tmp_path / "archive/sales/orders"
    assert (archive / NAME).read_text() == GOOD[0] and (archive / "landing=100" / NAME).read_text() == new
    # Either content once more is known; a third one is the next landing.
    land(tmp_path, NAME, GOOD[0])
    ingest_folder(job, str(tmp_path), now("2024-02-04 00:00:00"), "r4")
    assert stages(job) == [(0, "COMPLETED"), (100, "COMPLETED"), (101, "STAGED")]
    if dies_after is None:
        land(tmp_path, NAME, GOOD[0].replace("5.50", "5.75"))
        ingest_folder(job, str(tmp_path), now("2024-02-05 00:00:00"), "r5")
        assert (200, "COMPLETED") in stages(job) and ("1", "10", "F", "5.75") in main_rows(job)


def test_a_file_waits_while_its_name_is_on_its_way(spark, tmp_path, now):
    job = make_job(spark, tmp_path)
    land(tmp_path, NAME, GOOD[0])
    ingest_folder(job, str(tmp_path), now(), "r1", stop_after="STAGED")
    new = f"{HEADER}\n7,10,F,1.00,2020-03-01,HIGH\n"
    land(tmp_path, NAME, new)
    ingest_folder(job, str(tmp_path), now("2024-02-02 00:00:00"), "r2")
    assert stages(job) == [(0, "COMPLETED")] and (tmp_path / "raw/sales/orders" / NAME).read_text() == new
    ingest_folder(job, str(tmp_path), now("2024-02-03 00:00:00"), "r3")
    assert stages(job) == [(0, "COMPLETED"), (100, "COMPLETED")]


def test_digests(spark, tmp_path):
    land(tmp_path, NAME, "")
    path = str(tmp_path / "raw/sales/orders" / NAME)
    got = content_digests(spark.createDataFrame([(path,), (path + "x",)], "path string")).orderBy("path").collect()
    assert got[0].digest == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" and got[1].digest is None
