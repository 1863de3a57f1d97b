"""Queries that run whole jobs: ingestion, stores, published results, streams.

They write below the shared scratch folder and return what they wrote.
"""

from pyspark.sql import functions as F

from ..operators import quality
from ..operators.ledger import latest_stage
from ..plans.folder import ingest_on_arrival
from ..plans.ingest import Ingestion
from ..plans.models import ModelRegistry, document_table
from ..plans.profiles import Profiles
from ..plans.snapshots import Snapshot
from ..plans.specs import ORDERS, from_dict
from ..session import cut_lineage, scratch_path
from ..sinks.publish import publish
from ..sinks.store import TableStore
from ..sources import extract
from ..sources.landing import list_files, move_files, rows_read
from ..sources.layout import Layout
from ..streaming import landing as stream_landing
from ..streaming import state
from .q_ledger import entries
from .q_quality import ROW, SPEC, STAGED, TEST_NAMES, staged, tagged_sql, tests
from .q_records import MERGED, VERSIONS
from .registry import Tables, query

PER_FILE = tagged_sql("s.file_path, s.o_orderkey")


def new_store(t: Tables, purpose: str) -> TableStore:
    return TableStore(t.spark, scratch_path(t.spark, purpose))


# --- the whole ingestion --------------------------------------------------------

def ingest_orders(t: Tables, fail_after: str | None = None):
    raw = t["raw_orders"].select(
        F.lit("sales").alias("source"), F.lit("orders").alias("table_name"),
        F.substring_index("file_path", "/", -1).alias("file_name"), F.lit(0).alias("increment"), *SPEC.names)
    files = raw.select("source", "table_name", "file_name", "increment").distinct()
    spec = from_dict(ORDERS)[("sales", "orders")]
    job = Ingestion(t.spark, new_store(t, "ingest"), spec, {"customer": t["customer"]})
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    if fail_after:
        job.run(files, lambda _: raw, now, "first", stop_after=fail_after)
    return job, job.run(files, lambda _: raw, now, "run")


@query("ingest_orders", f"""
    select regexp_replace(file_path, '^.*/', '') as file_name, count(*) as rows_read,
           count(*) filter (where failed = '') as rows_clean, count(*) filter (where failed <> '') as rows_review,
           'COMPLETED' as stage
    from ({PER_FILE}) x group by file_path""")
def _(t):
    job, batch = ingest_orders(t)
    return job.summary(batch)


@query("ingest_orders_table", f"""
    select {ROW.replace('file_path, ', '')} from (
        select *, row_number() over (partition by o_orderkey
            order by file_path desc, o_custkey desc, o_orderstatus desc, o_totalprice desc, o_orderdate desc,
                     o_orderpriority desc) as rn
        from ({PER_FILE}) x where failed = '') y where rn = 1""")
def _(t):
    job, _ = ingest_orders(t, fail_after="CLEANED")
    return job.main_table().select(*SPEC.names)


# --- stores -----------------------------------------------------------------------

@query("append_to_source", """
    select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as double) as o_totalprice,
           concat('f', cast(o_orderkey % 3 as string)) as _ingest_id from orders""")
def _(t):
    store = new_store(t, "append")
    rows = t["orders"].select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice")).withColumn("_ingest_id", F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")))
    store.append("orders", rows)
    # The retry of one file replaces that file.
    store.append("orders", rows.where(F.col("_ingest_id") == "f1"))
    return store.read_appended("orders")


@query("merge_versions", MERGED)
def _(t):
    store = new_store(t, "merge")
    store.write("orders", t["target_orders"])
    for _ in range(2):
        store.merge("orders", t["order_updates"], ["o_orderkey"], ["o_totalprice"])
    return store.read("orders")


STAGED_BY_ENTRY = """
    select file_name, o_orderkey from (
        select concat('f', cast(o_custkey % 150 as string), '.csv') as file_name, o_orderkey from orders) o"""


@query("tidy_file_table", f"""
    with done as (select file_name from ({entries("ledger")}) e where stage in ('INSERTED', 'COMPLETED'))
    select file_name, o_orderkey from ({STAGED_BY_ENTRY}) s where file_name not in (select file_name from done)""")
def _(t):
    store = new_store(t, "tidy")
    rows = t["orders"].select(
        F.concat(F.lit("f"), (F.col("o_custkey") % 150).cast("string"), F.lit(".csv")).alias("file_name"), "o_orderkey")
    store.append("staging", rows, "file_name")
    done = latest_stage(t["ledger"]).where(F.col("stage").isin("INSERTED", "COMPLETED"))
    store.drop_ingest("staging", done, "file_name")
    return store.read_appended("staging", "file_name").select("file_name", "o_orderkey")


@query("write_dbt_logs", f"""
    with x as ({tagged_sql("s.o_orderkey")}), f as (select distinct file_path from x),
         names as (select unnest({list(TEST_NAMES)}) as test),
         hits as (select file_path, unnest(string_split(failed, ',')) as test from x)
    select 'run1' as run_id, f.file_path, n.test, count(h.test) as failing_rows
    from f cross join names n left join hits h on h.file_path = f.file_path and h.test = n.test
    group by f.file_path, n.test""")
def _(t):
    store = new_store(t, "test-log")
    checks = tests(t)
    counts = quality.failure_counts(quality.tag_failures(staged(t), checks), [c.name for c in checks], ["file_path"])
    store.append("test_results", counts.withColumn("run_id", F.lit("run1")), "run_id")
    return store.read_appended("test_results", "run_id")


# --- models and results --------------------------------------------------------------

REVENUE = """
    select n_name, cast(year(o_orderdate) as int) as order_year,
           cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as gross, count(*) as lines
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
         join nation on c_nationkey = n_nationkey
    group by n_name, year(o_orderdate)"""


def revenue(tables):
    """Gross revenue per nation and year; lines are summed per order before anything joins."""
    per_order = tables["lineitem"].groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("gross"), F.count("*").alias("lines"))
    placed = (
        per_order.join(tables["orders"].select("o_orderkey", "o_custkey", "o_orderdate"),
                       F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", F.year("o_orderdate").alias("order_year"))
        .agg(F.sum("gross").alias("gross"), F.sum("lines").alias("lines")))
    return (
        placed.join(tables["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(tables["nation"].select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "order_year")
        .agg(F.sum("gross").cast("decimal(28,2)").alias("gross"), F.sum("lines").alias("lines")))


@query("materialise_model", REVENUE)
def _(t):
    registry, store = ModelRegistry(), new_store(t, "model")
    names = ("lineitem", "orders", "customer", "nation")
    needed = {
        "lineitem": ["l_orderkey", "l_extendedprice"], "orders": ["o_orderkey", "o_custkey", "o_orderdate"],
        "customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey", "n_name"]}
    for name in names:
        store.write(f"source/{name}", t[name].select(*needed[name]))
    registry.model("gold/revenue", names)(revenue)
    registry.materialise(store, "gold/revenue")
    return registry.read(store, "gold/revenue")


@query("snapshot_changes", VERSIONS)
def _(t):
    snapshot = Snapshot(new_store(t, "history"), "order_status", ["o_custkey"], ["o_orderstatus"], ["o_orderkey"])
    cuts = [None, "1994-06-01", "1996-01-01", None]
    for since, before in zip(cuts, cuts[1:]):
        rows = t["orders"]
        rows = rows if since is None else rows.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
        rows = rows if before is None else rows.where(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz"))
        snapshot.extend(rows, "o_orderdate")
    return snapshot.history()


@query("snapshot_states", """
    with states as (
            select c_custkey, timestamp '2024-01-01 00:00:00' as loaded,
                   case when c_custkey % 5 <> 0 then c_mktsegment end as segment from customer
            union all select c_custkey, timestamp '2024-02-01 00:00:00',
                   case when c_custkey % 5 = 0 or c_custkey % 7 <> 0
                        then case when c_custkey % 3 = 0 then 'MOVED' else c_mktsegment end end from customer
            union all select c_custkey, timestamp '2024-03-01 00:00:00', c_mktsegment from customer),
         seen as (select *, lag(segment) over w as before, row_number() over w as rn
                  from states window w as (partition by c_custkey order by loaded)),
         changes as (select c_custkey, segment, loaded, lead(loaded) over (partition by c_custkey order by loaded) as until
                     from seen where rn = 1 or before is distinct from segment)
    select c_custkey, segment as c_mktsegment, loaded as valid_from, until as valid_to, until is null as is_current
    from changes where segment is not null""")
def _(t):
    snapshot = Snapshot(new_store(t, "history"), "customer", ["c_custkey"], ["c_mktsegment"])
    moved = F.when(F.col("c_custkey") % 3 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    # Customers come, change, leave and come back.
    snapshot.load(t["customer"].where("c_custkey % 5 <> 0"), "2024-01-01 00:00:00")
    snapshot.load(t["customer"].where("c_custkey % 5 = 0 or c_custkey % 7 <> 0").select("c_custkey", moved), "2024-02-01 00:00:00")
    snapshot.load(t["customer"], "2024-03-01 00:00:00")
    return snapshot.history()


#: Tables with a column that deals their rows to partitions, as SQL.
PARTITIONED = {
    "orders": ("cast(year(o_orderdate) as string)", "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"),
    "lineitem": ("l_returnflag", "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
                                 "l_linestatus, l_shipdate"),
    "customer": ("cast(c_nationkey as string)", "c_custkey, c_name, c_acctbal, c_mktsegment"),
}


@query("table_profiles", " union all ".join(
    f"select '{table}' as table_name, '{column}' as column_name, count(distinct {part}) as partitions, count(*) as rows, "
    f"count(*) - count({column}) as nulls, cast(min({column}) as string) as min_value, "
    f"cast(max({column}) as string) as max_value, true as distinct_is_near from {table}"
    for table, (part, columns) in PARTITIONED.items() for column in columns.split(", ")))
def _(t):
    profiles, exact = Profiles(new_store(t, "profiles")), None
    for table, (part, columns) in PARTITIONED.items():
        rows = t[table].select(F.expr(part).alias("_part"), *columns.split(", "))
        profiles.add(table, rows, "_part")
        counts = document_table(rows.drop("_part"), table, exact=True).select(
            "table_name", "column_name", F.col("distinct_values").alias("counted"))
        exact = counts if exact is None else exact.unionByName(counts)
    # Six standard errors of the sketch.
    near = F.abs(F.col("distinct_values") - F.col("counted")) <= 6 * 1.04 / 2 ** (profiles.precision / 2) * F.col("counted")
    return profiles.document().join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", "partitions", "rows", "nulls", "min_value", "max_value", near.alias("distinct_is_near"))


@query("publish_results", REVENUE)
def _(t):
    path = scratch_path(t.spark, "results")
    publish(revenue(t), path, columns=["n_name", "order_year", "gross", "lines"])
    return t.spark.read.parquet(path)


@query("external_extract", """
    select p_partkey, p_name, p_brand, p_size,
           cast(cast(p_retailprice as decimal(18,2)) as double) as p_retailprice from part""")
def _(t):
    schema = "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice decimal(18,2)"
    remote = scratch_path(t.spark, "remote")
    t["part"].selectExpr("p_partkey", "p_name", "p_brand", "p_size", "cast(p_retailprice as decimal(18,2)) p_retailprice"
                         ).write.json(remote)
    pulled = extract.extract_files(t.spark, remote, "json", schema)
    landed = extract.land(pulled, Layout(scratch_path(t.spark, "lake")), "erp", "part", "run1")
    return extract.extract_files(t.spark, landed, "csv", schema, header="true")


# --- streams ---------------------------------------------------------------------------

def landed_months(t: Tables) -> str:
    """The raw orders as CSV files, one folder per month."""
    root = scratch_path(t.spark, "landing")
    month = F.regexp_extract("file_path", r"(\d+)\.csv$", 1)
    t["raw_orders"].withColumn("month", month).drop("file_path").write.partitionBy("month").option(
        "header", "true").csv(f"{root}/raw/sales/orders")
    return root


def file_of(path):
    return F.concat(F.lit("sales/orders/"), F.regexp_extract(path, r"month=(\d+)/", 1), F.lit(".csv"))


@query("stream_landing", "select file_path, count(*) as rows_read from <<staged_orders>> group by file_path")
def _(t):
    root = landed_months(t)
    rows = stream_landing.row_stream(t.spark, f"{root}/raw", SPEC.names)
    out, checkpoint = scratch_path(t.spark, "landed"), scratch_path(t.spark, "offsets")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    seen = t.spark.read.parquet(out).withColumn("file_path", file_of("file_path"))
    return rows_read(seen, "file_path")


@query("stream_ingest", f"""
    select file_path, count(*) as rows_read, count(*) filter (where failed = '') as rows_clean,
           count(*) filter (where failed <> '') as rows_review, 'COMPLETED' as stage, 'archive' as area
    from ({PER_FILE}) x group by file_path""")
def _(t):
    """Files as they land, through ledger, archive, review and main table."""
    root = scratch_path(t.spark, "lake")
    drop_files(t, root)
    job = Ingestion(t.spark, TableStore(t.spark, f"{root}/tables"), from_dict(ORDERS)[("sales", "orders")], {"customer": t["customer"]})
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    ingest_on_arrival([job], root, scratch_path(t.spark, "offsets"), lambda: now).awaitTermination()
    done = job.summary(job.ledger.entries("sales", "orders").where(F.col("increment") == 0))
    kept = list_files(t.spark, f"{root}/archive/sales/orders").select(
        F.substring_index("path", "/", -1).alias("file_name"), F.lit("archive").alias("area"))
    return done.join(kept, "file_name", "left").select(
        F.concat(F.lit("sales/orders/"), "file_name").alias("file_path"), "rows_read", "rows_clean", "rows_review", "stage", "area")


def drop_files(t: Tables, root: str) -> None:
    """The raw orders as landed files, one per month: `raw/sales/orders/<month>.csv`."""
    drafts = scratch_path(t.spark, "drafts")
    t["raw_orders"].withColumn("month", F.regexp_extract("file_path", r"(\d+)\.csv$", 1)).drop("file_path").repartition(
        "month").write.partitionBy("month").option("header", "true").csv(drafts)
    plan = list_files(t.spark, drafts).where(F.col("path").endswith(".csv")).select(
        F.col("path").alias("src"),
        F.concat(F.lit(f"{root}/raw/sales/orders/"), F.regexp_extract("path", r"month=(\d+)/", 1), F.lit(".csv")).alias("dst"))
    cut_lineage(move_files(plan), "landed")


def events_stream(t: Tables):
    """The events table as a stream; one file or a folder of them."""
    return t.spark.readStream.schema(t["events"].schema).parquet(f"{t.folder}/events*.parquet")


@query("stream_failure_alert", """
    select time_bucket(interval '15' minute, ts) as window_start,
           time_bucket(interval '15' minute, ts) + interval '15' minute as window_end,
           count(*) filter (where event_type = 'error') as failed
    from events group by 1, 2 having count(*) filter (where event_type = 'error') > 0""")
def _(t):
    counts = state.failure_counts_stream(events_stream(t), F.col("event_type") == "error")
    out, checkpoint = scratch_path(t.spark, "alerts"), scratch_path(t.spark, "offsets")
    state.write_updates(counts, out, checkpoint).awaitTermination()
    latest = state.read_updates(t.spark, out, ["window_start", "window_end"]).where("failed > 0")
    return latest.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "failed")


@query("stream_stage_state", f"""
    select *, date_completed is null and first_ts + interval '20' minute < cast('2024-02-01 00:00:00' as timestamp) as overdue
    from ({entries("open_ledger")}) e""")
def _(t):
    event = F.col("event_type")
    stage = (
        F.when(event == "signup", "NEW").when(event == "view", "ARCHIVED").when(event == "click", "STAGED")
        .when(event == "purchase", "INSERTED").otherwise("COMPLETED"))
    user = F.col("user_id")
    transitions = events_stream(t).select(
        "event_id", F.concat(F.lit("S"), (user % 5).cast("string")).alias("source"),
        F.concat(F.lit("t"), (user % 7).cast("string")).alias("table_name"),
        F.concat(F.lit("f"), user.cast("string"), F.lit(".csv")).alias("file_name"), F.lit(0).alias("increment"),
        "ts", stage.alias("stage"), F.round("value").cast("bigint").alias("rows_read"))
    kept = transitions.where((F.col("stage") != "COMPLETED") | (F.substring(F.md5("file_name"), 1, 1) < "8"))
    out, checkpoint = scratch_path(t.spark, "stages"), scratch_path(t.spark, "offsets")
    # The clock: nothing happened, and it is 2024-02-01.
    beat = scratch_path(t.spark, "heartbeat")
    t.spark.createDataFrame([("2024-02-01 01:00:00",)], "moment string").select(
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.col("moment").cast(f.dataType).alias("ts") for f in kept.schema]
    ).write.parquet(beat)
    beating = kept.unionByName(t.spark.readStream.schema(kept.schema).parquet(beat))
    state.write_updates(state.stage_state(beating, delay="1 hour"), out, checkpoint).awaitTermination()
    return state.read_updates(t.spark, out, ["source", "table_name", "file_name", "increment"], ["overdue"])
