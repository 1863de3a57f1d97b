"""Keyed entities, layered settings, routing, references, nested documents, history, lineage, alerts."""

from pyspark.sql import functions as F

from ..functions.maps import canonical_map
from ..operators import records
from ..operators.alerts import failure_alert
from ..operators.graph import downstream
from ..operators.history import dedupe, merge, scd2
from ..sources import documents
from .registry import query

ENTITY = "concat('name=', name, ';nation=', nation)"


def customer_entities(t):
    return records.entities(
        t["customer"], F.col("c_mktsegment"), F.col("c_custkey"),
        {"name": F.col("c_name"), "nation": F.col("c_nationkey")})


def shown(df):
    return df.withColumn("entity", canonical_map(F.col("entity")))


@query("seed_entities", """
    select c_mktsegment as partition_key, cast(c_custkey as string) as row_key,
           concat('name=', c_name, ';nation=', cast(c_nationkey as string)) as entity
    from customer
    union all select '1', '1', '' where (select count(*) from customer) > 0""")
def _(t):
    rows = customer_entities(t)
    # The one-row table: key (1, 1), no attributes.
    one = t["customer"].limit(1).select(
        F.lit("1").alias("partition_key"), F.lit("1").alias("row_key"),
        F.create_map().cast("map<string,string>").alias("entity"))
    return shown(records.entity_upsert(rows, one, ["partition_key", "row_key"], "entity"))


@query("entity_upsert", """
    with old as (select c_mktsegment as partition_key, cast(c_custkey as string) as row_key, c_name as name,
                        cast(c_nationkey as string) as nation, c_custkey from customer where c_custkey % 3 <> 0),
         fresh as (select c_mktsegment as partition_key, cast(c_custkey as string) as row_key,
                          cast(c_nationkey + 100 as string) as nation, c_custkey from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0)
    select coalesce(o.partition_key, n.partition_key) as partition_key, coalesce(o.row_key, n.row_key) as row_key,
           concat_ws(';', case when o.name is not null then concat('name=', o.name) end,
                     concat('nation=', coalesce(n.nation, o.nation)),
                     case when n.row_key is not null then 'touched=yes' end) as entity
    from old o full join fresh n on o.partition_key = n.partition_key and o.row_key = n.row_key""")
def _(t):
    old = records.entities(
        t["customer"].where("c_custkey % 3 <> 0"), F.col("c_mktsegment"), F.col("c_custkey"),
        {"name": F.col("c_name"), "nation": F.col("c_nationkey")})
    fresh = records.entities(
        t["customer"].where("c_custkey % 2 = 0 or c_custkey % 3 = 0"), F.col("c_mktsegment"), F.col("c_custkey"),
        {"nation": F.col("c_nationkey") + 100, "touched": F.lit("yes")})
    return shown(records.entity_upsert(old, fresh, ["partition_key", "row_key"], "entity"))


@query("layered_settings", """
    with s as (select * from <<settings>>)
    select path, value, layer from (
        select *, row_number() over (partition by path order by layer desc) as rn from s) w
    where rn = 1 and not exists (
        select 1 from s o where o.layer > w.layer
           and (starts_with(w.path, concat(o.path, '.')) or starts_with(o.path, concat(w.path, '.'))))""")
def _(t):
    return records.resolve_layers(t["settings"])


@query("layer_precedence", """
    select path, value, layer from (
        select *, row_number() over (partition by path order by layer desc) as rn from <<settings>>) w where rn = 1""")
def _(t):
    return records.layer_winners(t["settings"]).select("path", "value", "layer")


@query("log_routing", """
    select l.event_id, l.ts, l.category, l.resource_type, l.resource_id, l.kind
    from <<log_rows>> l left join <<log_types>> t on l.resource_type = t.resource_type
         left join <<log_resources>> r on l.resource_id = r.resource_id
    where (coalesce(t.enabled, true) or coalesce(r.logs_enabled, false) or coalesce(r.metrics_enabled, false))
      and case when l.kind = 'log'
          then coalesce(r.logs_enabled, true) and (r.log_categories is null or list_contains(string_split(r.log_categories, ';'), l.category))
          else coalesce(r.metrics_enabled, true)
               and (r.metric_categories is null or list_contains(string_split(r.metric_categories, ';'), l.category)) end""")
def _(t):
    return records.route_logs(t["log_rows"], t["log_types"], t["log_resources"])


RESOLVED = """
    from <<references_made>> r left join customer c on r.ref_key = c.c_name"""


@query("reference_lookup", f"""
    select o_orderkey, ref_key, literal_id, coalesce(c.c_custkey, literal_id) as resolved_id,
           case when coalesce(c.c_custkey, literal_id) is null then 'unresolved' else 'resolved' end as status {RESOLVED}""")
def _(t):
    found = records.resolve_reference(t["references_made"], t["customer"], "ref_key", "literal_id", "c_name", "c_custkey")
    return found.withColumn("status", F.when(F.col("resolved_id").isNull(), "unresolved").otherwise("resolved"))


@query("distinct_accounts", """
    select distinct c_nationkey as account from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0""")
def _(t):
    accounts = t["customer"].withColumnRenamed("c_nationkey", "account")
    return records.distinct_where(accounts, "account", (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0))


@query("any_enabled", """
    select user_id, bool_or(event_type = 'error') as enabled,
           bool_or(event_type = 'error' and value > 30) as enabled_extra
    from events group by user_id""")
def _(t):
    return records.any_enabled(t["events"], ["user_id"], F.col("event_type") == "error", F.col("value") > 30)


@query("read_nested_state", """
    with r as (select event_id, unnest(cast(json_extract(doc, '$.deployment.resources') as json[])) as res
               from <<state_docs>>)
    select event_id, json_extract_string(res, '$.urn') as urn, json_extract_string(res, '$.type') as type,
           cast(json_array_length(res, '$.dependencies') as int) as n_dependencies from r""")
def _(t):
    state = documents.parse_docs(t["state_docs"], "doc", documents.RESOURCES)
    return state.select("event_id", F.inline("deployment.resources")).select(
        "event_id", "urn", "type", F.size("dependencies").alias("n_dependencies"))


@query("plan_step_filter", """
    with s as (select event_id, unnest(cast(json_extract(doc, '$.steps') as json[])) as step from <<plan_docs>>)
    select event_id, concat('--target ', json_extract_string(step, '$.urn')) as target from s
    where json_extract_string(step, '$.op') = 'create' and contains(json_extract_string(step, '$.urn'), '::error')""")
def _(t):
    plans = documents.parse_docs(t["plan_docs"], "doc", documents.STEPS)
    return documents.filter_steps(plans, "create", "::error")


RULES = (
    records.Rename("lake:catalog/", "lake:store/"),
    records.Rename("lake:catalog/", "lake:store/", "link:Link", ("target",)),
    records.Rename("link:Link", "alias:Alias", "link:Link"),
)


def swapped(text: str, link: bool = True) -> str:
    text = f"replace({text}, 'lake:catalog/', 'lake:store/')"
    return f"replace({text}, 'link:Link', 'alias:Alias')" if link else text


def joined(path: str) -> str:
    return f"array_to_string(cast(json_extract(res, '{path}') as varchar[]), ',')"


@query("rewrite_nested", f"""
    with r as (select event_id, unnest(cast(json_extract(doc, '$.deployment.resources') as json[])) as res
               from <<state_docs>>),
         f as (select *, json_extract_string(res, '$.urn') as urn, json_extract_string(res, '$.type') as type,
                      {joined('$.property_dependencies.target')} as target from r)
    select event_id,
           case when type = 'lake:catalog/link:Link' then {swapped('urn')}
                when starts_with(type, 'lake') then {swapped('urn', False)} else urn end as urn,
           case when type = 'lake:catalog/link:Link' then {swapped('type')}
                when starts_with(type, 'lake') then {swapped('type', False)} else type end as type,
           {swapped(joined('$.dependencies'))} as dependencies,
           case when type = 'lake:catalog/link:Link' then {swapped('target', False)} else target end as target,
           {joined('$.property_dependencies.keep')} as kept
    from f""")
def _(t):
    state = documents.parse_docs(t["state_docs"], "doc", documents.RESOURCES)
    changed = records.rewrite_resources(state.select("event_id", F.inline("deployment.resources")), RULES, "lake")

    def named(name):
        return F.array_join(F.try_element_at("property_dependencies", F.lit(name)), ",")

    return changed.select("event_id", "urn", "type", F.array_join("dependencies", ",").alias("dependencies"),
                          named("target").alias("target"), named("keep").alias("kept"))


REGIONS = ("north", "south", "east")
OUTPUTS = (
    documents.Field("owner_id", "$.shop.owner.id", required=True),
    documents.Field("owner_mail", "$.shop.owner.mail", ("north", "south")),
    documents.Field("region_code", "$.ledger.region.code", REGIONS, required=True),
    documents.Field("catalogue_link", "$.links.catalogue", REGIONS),
    documents.Field("exchange_link", "$.links.exchange", ("hub",)),
)


@query("project_outputs", f"""
    select event_id, env, {", ".join(
        f"case when {'true' if f.environments is None else 'env in ' + repr((*f.environments, ''))} "
        f"then json_extract_string(doc, '{f.path}') end as {f.name}" for f in OUTPUTS)},
           case when env in {REGIONS} and json_extract(doc, '$.ledger.region.code') is null
                then 'missing $.ledger.region.code' end as problem
    from <<output_docs>>""")
def _(t):
    return documents.project_outputs(t["output_docs"], OUTPUTS, on_missing="report")


@query("dedupe_on_key", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, cast(l_quantity as double) as l_quantity,
           l_returnflag from (
        select *, row_number() over (partition by l_orderkey, l_linenumber
            order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_returnflag desc) as rn
        from <<repeated_updates>>) u where rn = 1""")
def _(t):
    return dedupe(t["repeated_updates"], ["l_orderkey", "l_linenumber"],
                  ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"])


MERGED = """
    select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as double) as o_totalprice from (
        select * from <<target_orders>> where o_orderkey not in (select o_orderkey from <<order_updates>>)
        union all select * from <<order_updates>>) m"""


@query("merge_to_source", MERGED)
def _(t):
    return merge(t["target_orders"], t["order_updates"], ["o_orderkey"], ["o_totalprice"])


VERSIONS = """
    with seen as (select o_custkey, o_orderstatus, o_orderkey, o_orderdate,
                         lag(o_orderstatus) over w as before, row_number() over w as rn
                  from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
         versions as (select * from seen where rn = 1 or before <> o_orderstatus)
    select o_custkey, o_orderstatus, o_orderkey, o_orderdate as valid_from,
           lead(o_orderdate) over w as valid_to, lead(o_orderdate) over w is null as is_current
    from versions window w as (partition by o_custkey order by o_orderdate, o_orderkey)"""


@query("scd2_snapshot", VERSIONS)
def _(t):
    return scd2(t["orders"], ["o_custkey"], ["o_orderstatus"], ["o_orderdate", "o_orderkey"])


@query("propagate", """
    with recursive reached as (
        select 'n0' as node, 0 as depth
        union all select e.child, r.depth + 1 from reached r join <<edges>> e on e.parent = r.node)
    select node, cast(max(depth) as int) as depth from reached group by node""")
def _(t):
    start = t["customer"].where("c_custkey = 0").select(
        F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("node"))
    return downstream(t["edges"], start)


@query("failure_alert", """
    select time_bucket(interval '15' minute, ts) as window_start,
           time_bucket(interval '15' minute, ts) + interval '15' minute as window_end,
           count(*) filter (where event_type = 'error') as failed
    from events group by 1, 2 having count(*) filter (where event_type = 'error') > 0""")
def _(t):
    return failure_alert(t["events"], F.col("event_type") == "error")


@query("failure_alert_spine", """
    with c as (select time_bucket(interval '15' minute, ts) as window_start,
                      count(*) filter (where event_type = 'error') as failed from events group by 1),
         g as (select unnest(generate_series((select min(window_start) from c), (select max(window_start) from c),
                                             interval '15' minute)) as window_start)
    select g.window_start, g.window_start + interval '15' minute as window_end, coalesce(failed, 0) as failed
    from g left join c on g.window_start = c.window_start where coalesce(failed, 0) >= 0""")
def _(t):
    return failure_alert(t["events"], F.col("event_type") == "error", op=">=", spine=True)


@query("failure_alert_sliding", """
    with e as (select unnest([time_bucket(interval '5' minute, ts), time_bucket(interval '5' minute, ts) - interval '5' minute,
                              time_bucket(interval '5' minute, ts) - interval '10' minute]) as window_start, event_type
               from events)
    select window_start, window_start + interval '15' minute as window_end,
           count(*) filter (where event_type = 'error') as failed
    from e group by 1, 2 having count(*) filter (where event_type = 'error') > 1""")
def _(t):
    return failure_alert(t["events"], F.col("event_type") == "error", step="5 minutes", threshold=1)
