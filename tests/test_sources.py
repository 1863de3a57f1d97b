import os

import pytest
from pyspark.sql import functions as F

from lakewright.constants import ENTRY_KEYS
from lakewright.operators.inventory import mirror_plan
from lakewright.plans import sync
from lakewright.sinks.mirror import apply_mirror
from lakewright.sinks.publish import publish
from lakewright.sinks.store import TableStore
from lakewright.sources import documents, extract, landing, layout, listing


@pytest.fixture
def root(tmp_path):
    for path, text in {"raw/a/t/1.csv": "x,y\n1,2\n", "raw/a/t/2.csv": "x\n3\n", "raw/a/t/zero.csv": "",
                       "raw/a/deep/t/3.csv": "x\n", "other/a/t/4.csv": "x\n"}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    return str(tmp_path)


def test_landing_files(spark, root):
    """Zero-byte files and other prefixes are left out; content is not read."""
    files = landing.landing_files(spark, root)
    assert {r.path for r in files.collect()} == {"raw/a/t/1.csv", "raw/a/t/2.csv", "raw/a/deep/t/3.csv"}
    assert "content" not in files.select("path")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("path, ok, parts", [
    ("raw/a/t/f.csv", True, ("a", "t", "f.csv")), ("/raw/a/t/f.csv/", True, ("a", "t", "f.csv")),
    ("a/t/f", True, ("a", "t", "f")), ("draw/a/f", True, ("draw", "a", "f")), ("raw/a/f", False, None),
    ("raw/a/b/t/f", False, None), ("raw//t/f", False, None), ("", False, None)])
def test_parse_landing_path(spark, path, ok, parts):
    row = landing.parse_landing_path(spark.createDataFrame([(path,)], "path string")).first()
    assert row.path_ok is ok
    assert (row.source, row.table_name, row.file_name) == (parts or (None, None, None))


def test_folder_form_of_a_path(spark):
    df = spark.createDataFrame([("/random_example/alpha",)], "path string")
    row = landing.parse_landing_path(df, has_file=False).first()
    assert (row.source, row.table_name, row.path_ok) == ("random_example", "alpha", True)


def test_read_headers_takes_first_lines_only(spark, root):
    found = landing.read_headers(landing.list_files(spark, f"{root}/raw/a/t").where("size > 0"))
    assert {(os.path.basename(r.path), r.column_name, r.position) for r in found.collect()} == {
        ("1.csv", "x", 0), ("1.csv", "y", 1), ("2.csv", "x", 0)}


def test_long_and_quoted_headers(spark, tmp_path):
    names = [f"column {i}" for i in range(3000)]
    (tmp_path / "wide.csv").write_bytes(("\ufeff" + ",".join(f'"{n}"' for n in names) + "\r\n1\r\n").encode())
    (tmp_path / "bare.csv").write_text("only")
    found = landing.read_headers(landing.list_files(spark, str(tmp_path))).collect()
    assert [r.column_name for r in found if r.path.endswith("wide.csv")] == names
    assert [r.column_name for r in found if r.path.endswith("bare.csv")] == ["only"]


def test_move_files_twice(spark, root):
    files = landing.landing_files(spark, root).select(F.concat(F.lit(f"{root}/"), "path").alias("path"))
    plan = files.select(F.col("path").alias("src"), F.replace("path", F.lit("/raw/"), F.lit("/archive/")).alias("dst"))
    plan = spark.createDataFrame(plan.collect())
    for _ in range(2):
        assert {r.status for r in landing.move_files(plan).collect()} == {"moved"}
    assert os.path.exists(f"{root}/archive/a/t/1.csv") and not os.path.exists(f"{root}/raw/a/t/1.csv")
    gone = plan.withColumn("dst", F.lit(f"{root}/nowhere/x"))
    assert {r.status for r in landing.move_files(gone).collect()} == {"lost"}


def test_archive_plan_strips_the_landing_prefix(spark):
    row = landing.archive_plan(spark.createDataFrame([("raw/a/t/raw/1",)], "path string"), "archive/").first()
    assert row.dst == "archive/a/t/raw/1"


def test_unpack_reverses_pack(spark):
    rows = [("s1", f"t{i}", "Folder") for i in range(40)] + [("s2", "x|y", "Folder"), ("s2", "z", "Folder")]
    items = spark.createDataFrame(rows + rows[:5], "schema string, name string, type string")
    for max_items in (10_000, 7):
        packed = listing.pack_listing(items, "/mnt/source", max_items)
        assert {(r.schema, r.name) for r in listing.unpack_listing(packed).collect()} == {r[:2] for r in rows}
    assert packed.where("schema = 's1'").count() > 1


def test_layout(spark):
    assert layout.Layout("/lake/").path("raw", "a", "t") == "/lake/raw/a/t"
    with pytest.raises(ValueError):
        layout.Layout().path("attic")
    names = spark.createDataFrame([("source",), ("raw",), ("utilities",), ("attic",)], "c string")
    access = {r.c: (r.r, r.w) for r in names.select(
        "c", layout.readers(F.col("c")).alias("r"), layout.writers(F.col("c")).alias("w")).collect()}
    assert access == {
        "source": ("analytics,engineering", "engineering"), "raw": ("engineering", "engineering"),
        "utilities": ("analytics,engineering", "analytics,engineering"), "attic": (None, None)}


def test_documents(spark, tmp_path):
    (tmp_path / "plan.json").write_text('{\n "steps": [{"op": "create", "urn": "a::x"},\n {"op": "create", "urn": "a::x"},'
                                        ' {"op": "same", "urn": "a::x"}, {"op": "create", "urn": "b"}]}')
    plans = documents.read_json_docs(spark, str(tmp_path), documents.STEPS)
    targets = documents.filter_steps(plans, "create", "::x")
    assert [r.target for r in targets.collect()] == ["--target a::x"] * 2


def test_required_outputs_raise(spark):
    fields = [documents.Field("id", "$.a.id", required=True), documents.Field("place", "$.b.c", ("x",), required=True)]
    docs = spark.createDataFrame([('{"a":{"id":"1"}}', "x")], "doc string, env string")
    assert documents.project_outputs(docs, fields, on_missing="report").first().problem == "missing $.b.c"
    with pytest.raises(Exception, match="b.c"):
        documents.project_outputs(docs, fields).collect()
    fine = spark.createDataFrame([('{"a":{"id":"1"}}', "y"), ('{"a":{"id":"2"},"b":{"c":"3"}}', "x")], docs.schema)
    assert [tuple(r) for r in documents.project_outputs(fine, fields).orderBy("id").collect()] == [("y", "1", None), ("x", "2", "3")]


def test_catalog_sync_is_repeatable(spark, tmp_path):
    lake = layout.Layout(str(tmp_path))
    spark.range(3).write.parquet(lake.path("models", "Gold", "Sales"))
    spark.range(2).write.parquet(lake.path("models", "Gold", "costs"))
    stored = spark.createDataFrame([("Gold", "Sales"), ("Gold", "costs")], "schema string, name string")
    assert sync.sync_catalog(spark, stored, "models", lake) == 2
    assert sync.sync_catalog(spark, stored, "models", lake) == 0
    assert spark.table("gold.sales").count() == 3


def test_catalog_sync_follows_versions(spark, tmp_path):
    lake = layout.Layout(str(tmp_path))
    store = TableStore(spark, lake.path("source"))
    stored = spark.createDataFrame([("Shop", "Carts")], "schema string, name string")
    for n, created in ((10, 1), (4, 0)):
        store.write("Shop/Carts", spark.range(n))
        assert sync.sync_catalog(spark, stored, "source", lake) == created
        assert spark.table("shop.carts").count() == n


def test_scheduled_chain_retries_its_listing(spark):
    calls = []

    def listing():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("no answer")
        return spark.sql("select 'nowhere' schema, 'b' name, 'Folder' type, timestamp_ntz'2024-01-02 00:00:00' modified union all "
                         "select 'nowhere', 'a', 'Folder', timestamp_ntz'2024-01-02 00:00:00'")

    now = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    found = sync.scheduled_sync(spark, listing, now, seconds=0).collect()
    assert [(r.schema, r.tables) for r in found] == [("nowhere", "a, b")] and len(calls) == 2


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("listing failed")
        return "done"

    assert sync.with_retries(flaky, seconds=0) == "done"
    with pytest.raises(OSError):
        sync.with_retries(lambda: (_ for _ in ()).throw(OSError()), attempts=2, seconds=0)


def test_known_files_are_not_fetched_twice(spark):
    columns = "source string, path string"
    seen = spark.createDataFrame([("s", "1")], columns)
    remote = spark.createDataFrame([("s", "1"), ("s", "2"), ("r", "1")], columns)
    fresh = landing.new_files(remote, seen, ["source", "path"])
    assert {tuple(r) for r in fresh.collect()} == {("s", "2"), ("r", "1")}
    recorded = seen.unionByName(fresh)
    assert landing.new_files(remote, recorded, ["source", "path"]).isEmpty()


def test_publish_and_extract_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for fmt in ("parquet", "json", "orc"):
        publish(df, str(tmp_path / fmt), fmt, columns=["v", "k"])
        back = extract.extract_files(spark, str(tmp_path / fmt), fmt, "k int, v string")
        assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]
    publish(df, str(tmp_path / "csv"), "csv", columns=["v", "k"], options={"header": "true"})
    first = next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv")
    assert first.read_text().startswith("v,k\n")


def test_landing_an_extraction_is_repeatable(spark, tmp_path):
    for _ in range(2):
        path = extract.land(spark.range(5), layout.Layout(str(tmp_path)), "erp", "part", "run1")
    assert spark.read.csv(path, header=True).count() == 5
    assert ENTRY_KEYS[0] == "source"


def test_mirror_is_carried_out(spark, root, tmp_path):
    share = tmp_path / "share"
    (share / "old").mkdir(parents=True)
    (share / "old" / "x").write_text("gone")
    (share / "raw").mkdir()

    plan = mirror_plan(landing.list_tree(spark, f"{root}/raw"), landing.list_tree(spark, str(share)))
    plan = spark.createDataFrame(plan.collect())
    for _ in range(2):
        done = {r.path: r.status for r in apply_mirror(plan, f"{root}/raw", str(share)).collect()}
    assert done == {"a/t/1.csv": "uploaded", "a/t/2.csv": "uploaded", "a/t/zero.csv": "uploaded",
                    "a/deep/t/3.csv": "uploaded", "old/x": "deleted"}
    assert (share / "a/t/1.csv").read_text() == "x,y\n1,2\n"
    assert not (share / "old" / "x").exists()
