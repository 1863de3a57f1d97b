import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lakewright.functions import maps, text
from lakewright.operators import inventory, ledger, quality, records
from lakewright.operators.alerts import failure_alert
from lakewright.operators.graph import LineageCycle, downstream
from lakewright.plans.models import ModelRegistry, document_tables
from lakewright.sinks.store import TableStore

LIGHT = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def deep_merge(low, high):
    out = dict(low)
    for k, v in high.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def leaves(tree, path=()):
    for k, v in tree.items():
        if isinstance(v, dict):
            yield from leaves(v, (*path, k))
        else:
            yield ".".join((*path, k)), v


trees = st.recursive(st.text("xyz", min_size=1, max_size=3),
                     lambda inner: st.dictionaries(st.sampled_from("abc"), inner, min_size=1, max_size=3), max_leaves=6)
layers = st.lists(st.dictionaries(st.sampled_from("abc"), trees, min_size=1, max_size=3), min_size=1, max_size=3)


@LIGHT
@given(layers)
def test_layers_equal_a_deep_merge(spark, stack):
    merged = {}
    for layer in stack:
        merged = deep_merge(merged, layer)
    rows = [(i, path, v) for i, layer in enumerate(stack) for path, v in leaves(layer)]
    df = spark.createDataFrame(rows, "layer int, path string, value string")
    found = {r.path: r.value for r in records.resolve_layers(df).collect()}
    assert found == dict(leaves(merged))


def test_maps(spark):
    df = spark.sql("select map('a','1','n',null) m, map('a','2','b','3') d, cast(null as map<string,string>) e")
    row = df.select(
        maps.canonical_map(maps.merge_maps(F.col("d"), F.col("m"))).alias("merged"),
        maps.canonical_map(maps.merge_maps(F.col("e"), F.col("d"))).alias("empty"),
        maps.with_defaults(F.col("m"), F.col("d"), "n", F.lit("x")).alias("null_wins"),
        maps.with_defaults(F.col("m"), F.col("d"), "b", F.lit("x")).alias("default"),
        maps.with_defaults(F.col("m"), F.col("d"), "z", F.lit("x")).alias("argument")).first()
    assert tuple(row) == ("a=1;b=3;n=null", "a=2;b=3", None, "3", "x")


@LIGHT
@given(st.lists(st.integers(0, 10**7), min_size=1, max_size=40))
def test_timespan_reads_back(spark, minutes):
    df = spark.createDataFrame([(m,) for m in minutes], "m bigint")
    for m, shown in df.select("m", text.format_timespan(F.col("m")).alias("s")).collect():
        days, clock = shown.split(".")
        h, mm, ss = clock.split(":")
        assert (len(h), len(mm), ss) == (2, 2, "00")
        assert int(days) * 1440 + int(h) * 60 + int(mm) == m


def test_hashes(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    cols = [F.col("x"), F.col("y")]
    assert df.select(text.hash_concat(*cols)).distinct().count() == 1
    assert df.select(text.hash_concat(*cols, safe=True)).distinct().count() == 2
    assert df.where(text.row_hash(*cols) < 0).isEmpty()


def test_alnum_keeps_other_scripts(spark):
    assert spark.range(1).select(text.alnum_only(F.lit("a-é_β 1!"))).first()[0] == "aéβ1"


def test_lifecycle_thresholds(spark):
    df = spark.createDataFrame(
        [(f"{kind}{d}", kind, d) for kind in ("base", "snapshot") for d in (1, 2, 10, 11, 30, 31)],
        "path string, kind string, d int").selectExpr(
        "path", "kind", "timestamp_ntz'2024-03-01' - make_dt_interval(if(kind = 'base', d, 0)) modified",
        "timestamp_ntz'2024-03-01' - make_dt_interval(if(kind = 'base', 99, d)) created")
    now = F.lit("2024-03-01").cast("timestamp_ntz")
    tiers = {r.path: r.tier for r in inventory.lifecycle(df, {"cool": 1, "archive": 10, "delete": 30}, now).collect()}
    for kind in ("base", "snapshot"):
        assert [tiers.get(f"{kind}{d}") for d in (1, 2, 10, 11, 30, 31)] == [
            None, "cool", "cool", "archive", "archive", "delete"]
    only = inventory.lifecycle(df, {"cool": None, "archive": None, "delete": 30}, now)
    assert {r.tier for r in only.collect()} == {"delete"}
    assert inventory.lifecycle(df, {"cool": None}, now).isEmpty()


def test_mirror(spark):
    a = spark.createDataFrame([("d/e/x", 1), ("y", 2)], "path string, size int")
    b = spark.createDataFrame([("y", 2), ("old", 3)], "path string, size int")
    plan = {r.path: r.action for r in inventory.mirror_plan(a, b).collect()}
    assert plan == {"d/e/x": "upload", "y": "upload", "old": "delete"}
    assert {r.path: r.action for r in inventory.mirror_plan(a, b, skip_same_size=True).collect()}["y"] == "skip"
    dirs = inventory.missing_dirs(a, spark.createDataFrame([("d",)], "path string"))
    assert {(r.path, r.depth) for r in dirs.collect()} == {("d/e", 2)}


def test_lineage_depth_is_the_longest_path(spark):
    edges = spark.createDataFrame([("s", "a"), ("a", "b"), ("s", "b"), ("b", "c"), ("q", "z")], "parent string, child string")
    start = spark.createDataFrame([("s",)], "node string")
    assert {r.node: r.depth for r in downstream(edges, start).collect()} == {"s": 0, "a": 1, "b": 2, "c": 3}
    loop = edges.union(spark.createDataFrame([("c", "a")], edges.schema))
    with pytest.raises(LineageCycle):
        downstream(loop, start)


def test_long_lineage_is_no_cycle(spark):
    chain = spark.range(12).selectExpr("cast(id as string) parent", "cast(id + 1 as string) child")
    start = spark.createDataFrame([("0",)], "node string")
    assert {r.node: r.depth for r in downstream(chain, start).collect()} == {str(i): i for i in range(13)}


def test_propagate_builds_parents_first(spark, tmp_path):
    registry, store = ModelRegistry(), TableStore(spark, str(tmp_path))
    store.write("source/sales/orders", spark.range(4))
    registry.model("silver/double", ["sales/orders"])(lambda t: t["sales/orders"].selectExpr("id * 2 as id"))
    registry.model("gold/both", ["silver/double", "sales/orders"])(
        lambda t: t["silver/double"].union(t["sales/orders"]))
    registry.model("history/orders", ["sales/orders"], kind="snapshots")(lambda t: t["sales/orders"])
    with pytest.raises(ValueError):
        registry.model("gold/both", [])(lambda t: None)
    assert registry.propagate(spark, store, "sales", "orders") == ["silver/double", "history/orders", "gold/both"]
    assert registry.read(store, "gold/both").count() == 8
    assert store.version("snapshots/history/orders") == 1


def test_documentation(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k int, v string")
    doc = {r.column_name: r for r in document_tables({"t": {"k": "bigint"}}, {"t": df}).collect()}
    assert (doc["k"].declared_type, doc["k"].type, doc["k"].distinct_values) == ("bigint", "int", 2)
    assert (doc["v"].nulls, doc["v"].min_value, doc["v"].max_value) == (1, "a", "b")


def test_quality_counts_add_up(spark):
    rng = random.Random(5)
    rows = [(i if rng.random() > 0.1 else 7, None if rng.random() < 0.3 else rng.randint(0, 9), "hot" if i % 3 else "x")
            for i in range(900)]
    df = spark.createDataFrame(rows, "k int, p int, v string")
    parent = spark.createDataFrame([(i,) for i in range(5)], "id int")
    checks = [quality.unique("k"), quality.not_null("p"), quality.relationships("p", parent, "id"),
              quality.accepted_values("v", ["hot"]), quality.expression("p < 9", "p")]
    tested, results = quality.run_tests(df, checks)
    clean, review, _ = quality.quarantine(tested, ["v"])
    assert clean.count() + review.count() == df.count()
    counts = {r.test: r.failing_rows for r in results.collect()}
    for check in checks:
        assert counts[check.name] == quality.failing_rows(df, check).count()
    keys = [r[0] for r in rows]
    assert counts["unique_k"] == sum(keys.count(k) > 1 for k in keys)
    assert counts["relationships_p"] == sum(r[1] is not None and r[1] > 4 for r in rows)
    assert counts["expression_p"] == sum(r[1] == 9 for r in rows)


def test_guard_message(spark):
    entries = spark.createDataFrame([("s", "t", "f.csv", 0, "STAGED")],
                                    "source string, table_name string, file_name string, increment int, stage string")
    with pytest.raises(ledger.IncompleteRun, match="f.csv stopped at stage STAGED"):
        ledger.assert_completed(entries)


def test_zero_failures_do_not_alert(spark):
    runs = spark.sql("select timestamp'2024-01-01 00:01:00' ts, false bad union all select timestamp'2024-01-01 01:00:00', true")
    assert failure_alert(runs, F.col("bad")).count() == 1
    assert failure_alert(runs, F.col("bad"), op=">=").count() == 2
    assert failure_alert(runs, F.col("bad"), op=">=", spine=True).count() == 5


def test_one_odd_time_does_not_fill_the_spine_of_a_task(spark):
    runs = spark.createDataFrame([(False, "2024-01-01 00:00:00"), (True, "2044-01-01 00:10:00")], "bad boolean, t string").select(
        "bad", F.col("t").cast("timestamp_ntz").alias("ts"))
    found = failure_alert(runs, F.col("bad"), op=">=", spine=True)
    assert found.count() == 20 * 365 * 96 + 5 * 96 + 1 and found.where("failed = 1").count() == 1


@pytest.mark.parametrize("logs", [True, False, None])
@pytest.mark.parametrize("metrics", [True, False, None])
@pytest.mark.parametrize("type_on", [True, False])
def test_logs_and_metrics_are_routed_apart(spark, logs, metrics, type_on):
    rows = spark.createDataFrame([("t", "r", "log", "a"), ("t", "r", "metric", "a"), ("t", "r", "log", "b")],
                                 "resource_type string, resource_id string, kind string, category string")
    types = spark.createDataFrame([("t", type_on)], "resource_type string, enabled boolean")
    resources = spark.createDataFrame(
        [("r", logs, metrics, "a", None)],
        "resource_id string, logs_enabled boolean, metrics_enabled boolean, log_categories string, metric_categories string")
    found = {(r.kind, r.category) for r in records.route_logs(rows, types, resources).collect()}
    used = type_on or bool(logs) or bool(metrics)
    assert found == ({("log", "a")} if used and logs is not False else set()) | (
        {("metric", "a")} if used and metrics is not False else set())


def test_rules_leave_records_of_another_kind_alone(spark):
    schema = "urn string, type string, dependencies array<string>, property_dependencies map<string, array<string>>"
    df = spark.createDataFrame([
        ("u:a/x:link", "a/x:link", ["a/1", "x:link"], {"to": ["a/2"], "by": ["a/3"]}),
        ("u:a/x:link", "a/y:folder", ["a/1"], {"to": ["a/2"]}), ("u:a/x:link", "z:a/x:link", ["a/1"], {"to": ["a/2"]})], schema)
    rules = [records.Rename("a/", "b/"), records.Rename("a/", "b/", "x:link", ("to",)), records.Rename("x:link", "x:alias", "x:link")]
    first, second, third = sorted(records.rewrite_resources(df, rules, "a/").collect(), key=lambda r: r.type)
    assert (first.type, first.urn, first.property_dependencies) == ("b/x:alias", "u:b/x:alias", {"to": ["b/2"], "by": ["a/3"]})
    assert (second.type, second.urn, second.property_dependencies) == ("b/y:folder", "u:b/x:link", {"to": ["a/2"]})
    assert (third.type, third.urn, third.property_dependencies) == ("z:a/x:link", "u:a/x:link", {"to": ["a/2"]})
    assert [r.dependencies for r in (first, second, third)] == [["b/1", "x:alias"], ["b/1"], ["b/1"]]
