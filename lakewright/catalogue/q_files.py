"""Landing, listings, inventories, catalogue."""

from pyspark.sql import functions as F

from ..constants import LIFECYCLE_DAYS, LOG_RETENTION_DAYS, RECENT_DAYS
from ..operators import inventory
from ..operators.ranking import z_values
from ..plans import models, sync
from ..sources import landing, layout, listing
from .registry import query


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("landing_new_files", """
    select path, size from (select path, size from <<listing>> union all select path, size from <<target_listing>>) i
    where size > 0 and starts_with(path, 'raw/')""")
def _(t):
    files = t["listing"].select("path", "size").unionByName(t["target_listing"])
    return landing.nonempty_below(files)


@query("parse_landing_path", """
    select path, case when ok then p[1] end as source, case when ok then p[2] end as table_name,
           case when ok then p[3] end as file_name, ok as path_ok
    from (select path, p, len(p) = 3 and not list_contains(p, '') as ok
          from (select path, string_split(trim(regexp_replace(path, '^/*raw/', ''), '/'), '/') as p
                from <<landing_paths>>) a) b""")
def _(t):
    return landing.parse_landing_path(t["landing_paths"])


@query("known_file_antijoin", """
    select path, source, size from <<listing>> l
    where not exists (select 1 from <<known>> k where k.path = l.path and k.source = l.source)""")
def _(t):
    return landing.new_files(t["listing"].select("path", "source", "size"), t["known"], ["source", "path"])


@query("archive_files", """
    select path as src, concat('archive/', regexp_replace(path, '^/*raw/', '')) as dst
    from <<listing>> where size > 0""")
def _(t):
    return landing.archive_plan(landing.nonempty_below(t["listing"]), "archive")


@query("container_path", """
    select path, case when container <> 'nowhere' then concat(container, '/', source, '/', table_name) end as table_path,
           case when container = 'nowhere' then null
                when container in ('utilities', 'source', 'models', 'snapshots', 'orchestration')
                then 'analytics,engineering' else 'engineering' end as readers,
           case when container = 'nowhere' then null when container = 'utilities' then 'analytics,engineering'
                else 'engineering' end as writers
    from (select *, case size % 5 when 0 then 'source' when 1 then 'models' when 2 then 'raw' when 3 then 'utilities'
                    else 'nowhere' end as container from <<listing>>) l""")
def _(t):
    container = (
        F.when(F.col("size") % 5 == 0, "source").when(F.col("size") % 5 == 1, "models")
        .when(F.col("size") % 5 == 2, "raw").when(F.col("size") % 5 == 3, "utilities").otherwise("nowhere"))
    placed = layout.with_access(t["listing"].withColumn("container", container), "container", "source", "table_name")
    return placed.select("path", "table_path", "readers", "writers")


@query("recent_listing", f"""
    select path, modified from <<listing>>
    where modified >= cast('2024-01-20 00:00:00' as timestamp) - interval '{RECENT_DAYS}' day""")
def _(t):
    return listing.recent(t["listing"], at("2024-01-20 00:00:00")).select("path", "modified")


@query("folders_only", "select path, type from <<listing>> where type = 'Folder'")
def _(t):
    return listing.folders(t["listing"]).select("path", "type")


PACKED = """
    select source as schema, concat('/mnt/source/', source, '|',
           string_agg(concat('{"name":"', table_name, '","type":"Folder"}'), ';' order by table_name)) as packed
    from (select distinct source, table_name from <<listing>> where type = 'Folder') f group by source"""


def packed_folders(t):
    items = listing.folders(t["listing"]).select(F.col("source").alias("schema"), F.col("table_name").alias("name"), "type")
    return listing.pack_listing(items, "/mnt/source")


@query("pack_listing", PACKED)
def _(t):
    return packed_folders(t)


@query("unpack_listing", f"""
    with packed as ({PACKED})
    select list_extract(string_split(split_part(packed, '|', 1), '/'), -1) as schema,
           json_extract_string(unnest(string_split(split_part(packed, '|', 2), ';')), '$.name') as name
    from packed""")
def _(t):
    return listing.unpack_listing(packed_folders(t))


STORED = "select distinct source as schema, table_name as name from <<listing>> where type = 'Folder'"
MISSING = f"""
    select schema, name from ({STORED}) s where not exists (
        select 1 from <<catalog_tables>> c where c.db = lower(s.schema) and c.name = lower(s.name))"""
MESSAGES = """
    select schema, string_agg(name, ', ' order by name) as tables,
           concat('schema ', schema, ' has unregistered tables: ', string_agg(name, ', ' order by name),
                  '; run the catalogue sync') as message
    from ({missing}) m group by schema"""


def stored(t):
    return listing.folders(t["listing"]).select(F.col("source").alias("schema"), F.col("table_name").alias("name"))


@query("new_tables", MESSAGES.format(missing=MISSING))
def _(t):
    return sync.alert_texts(sync.new_tables(stored(t), t["catalog_tables"]))


@query("register_tables", f"""
    select lower(schema) as db, lower(name) as name, concat('source/', schema, '/', name) as location
    from ({MISSING}) m""")
def _(t):
    return sync.registrations(sync.new_tables(stored(t), t["catalog_tables"]), "source")


@query("scheduled_sync", MESSAGES.format(missing=MISSING.replace(
    "where type = 'Folder'",
    "where type = 'Folder' and modified >= cast('2024-01-20 00:00:00' as timestamp) - interval '3' day")))
def _(t):
    def listing():
        return t["listing"].select(F.col("source").alias("schema"), F.col("table_name").alias("name"), "type", "modified")

    return sync.scheduled_sync(t.spark, listing, at("2024-01-20 00:00:00"), catalog=lambda _: t["catalog_tables"])


@query("mirror_plan", """
    select coalesce(l.path, r.path) as path, case when l.path is null then 'delete' else 'upload' end as action
    from <<listing>> l full join <<target_listing>> r on l.path = r.path""")
def _(t):
    return inventory.mirror_plan(t["listing"], t["target_listing"])


@query("mirror_full_outer", """
    select coalesce(l.path, r.path) as path, l.path is not null as in_left, r.path is not null as in_right
    from <<listing>> l full join <<target_listing>> r on l.path = r.path""")
def _(t):
    return inventory.compare_inventories(t["listing"], t["target_listing"])


@query("mirror_missing_dirs", """
    with parts as (select string_split(path, '/') as p from <<listing>>),
         dirs as (select distinct array_to_string(p[1:n], '/') as path
                  from (select p, unnest(range(1, len(p))) as n from parts) x),
         existing as (select distinct regexp_replace(path, '/[^/]*$', '') as path from <<target_listing>>)
    select path, cast(len(string_split(path, '/')) as int) as depth from dirs
    where path not in (select path from existing)""")
def _(t):
    existing = t["target_listing"].select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return inventory.missing_dirs(t["listing"], existing)


@query("lifecycle_tier", """
    select path, kind, case when age > 30 then 'delete' when age > 10 then 'archive' else 'cool' end as tier
    from (select path, kind, date_diff('day', cast(case when kind = 'base' then modified else created end as date),
                                       date '2024-02-10') as age from <<objects>>) o
    where age > 1""")
def _(t):
    return inventory.lifecycle(t["objects"], LIFECYCLE_DAYS, at("2024-02-10 00:00:00")).select("path", "kind", "tier")


@query("log_retention", """
    select event_id, ts from events where ts >= cast('2024-02-14 12:00:00' as timestamp) - interval '30' day""")
def _(t):
    return inventory.retain(t["events"], "ts", at("2024-02-14 12:00:00"), LOG_RETENTION_DAYS).select("event_id", "ts")


@query("cluster_layout", """
    with users as (select file_name as v, dense_rank() over (order by file_name) - 1 as r,
                          count(*) over () as n from (select distinct file_name from <<ledger>>) d),
         counts as (select rows_read as v, dense_rank() over (order by rows_read) - 1 as r,
                           count(*) over () as n from (select distinct rows_read from <<ledger>>) d),
         b as (select l.event_id, cast(floor(u.r * 16 / u.n) as bigint) as x, cast(floor(c.r * 16 / c.n) as bigint) as y
               from <<ledger>> l join users u on u.v = l.file_name join counts c on c.v = l.rows_read)
    select event_id, cast(
        (x & 1) | ((y & 1) << 1) | (((x >> 1) & 1) << 2) | (((y >> 1) & 1) << 3)
        | (((x >> 2) & 1) << 4) | (((y >> 2) & 1) << 5) | (((x >> 3) & 1) << 6) | (((y >> 3) & 1) << 7)
        as bigint) as z
    from b""")
def _(t):
    return z_values(t["ledger"].select("event_id", "file_name", "rows_read"), ["file_name", "rows_read"], bits=4).select(
        "event_id", "z")


#: Declared types of all given tables.
DOCUMENT_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
DECLARED = {table: dict(c.split(" ") for c in columns.split(", ")) for table, columns in DOCUMENT_COLUMNS.items()}


def _bound(f: str, column: str, kind: str) -> str:
    return "cast(null as varchar)" if kind.startswith("array") else f"cast({f}({column}) as string)"


@query("table_documentation", " union all ".join(
    f"select '{table}' as table_name, '{column}' as column_name, '{kind}' as type, count(*) as rows, "
    f"count(*) - count({column}) as nulls, count(distinct {column}) as distinct_values, "
    f"{_bound('min', column, kind)} as min_value, {_bound('max', column, kind)} as max_value, '{kind}' as declared_type from {table}"
    for table, columns in DECLARED.items() for column, kind in columns.items()))
def _(t):
    return models.document_tables(DECLARED, {table: t[table] for table in DECLARED}, exact=True)
