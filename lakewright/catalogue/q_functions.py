"""Scalar and list functions."""

from pyspark.sql import functions as F

from ..functions import maps, text
from ..operators.lists import difference, sorted_names, union_distinct
from .registry import query


@query("format_timespan", """
    select o_orderkey, printf('%d.%02d:%02d:00', m // 1440, (m % 1440) // 60, m % 60) as timespan
    from (select o_orderkey, o_orderkey * 7 as m from orders) o""")
def _(t):
    return t["orders"].select("o_orderkey", text.format_timespan(F.col("o_orderkey") * 7).alias("timespan"))


@query("hash_concat", """
    select c_custkey, md5(concat(c_name, c_mktsegment, cast(c_nationkey as string))) as plain,
           md5(concat(cast(length(c_name) as string), ':', c_name,
                      cast(length(c_mktsegment) as string), ':', c_mktsegment)) as framed
    from customer""")
def _(t):
    name, segment, nation = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")
    return t["customer"].select(
        "c_custkey", text.hash_concat(name, segment, nation).alias("plain"),
        text.hash_concat(name, segment, safe=True).alias("framed"))


ROW_HASH = """cast('0x' || substr(md5(concat(
        cast(length(source) as string), ':', source, cast(length(table_name) as string), ':', table_name,
        cast(length(file_name) as string), ':', file_name,
        cast(length(cast(increment as string)) as string), ':', cast(increment as string))), 1, 15) as bigint)"""


@query("row_hash", f"select event_id, {ROW_HASH} as row_hash from <<ledger>>")
def _(t):
    keys = [F.col(c) for c in ("source", "table_name", "file_name", "increment")]
    return t["ledger"].select("event_id", text.row_hash(*keys).alias("row_hash"))


@query("path_functions", """
    select path, list_extract(p, -1) as last_part, list_extract(p, 1) as first_part, trim(path, '/') as stripped,
           upper(source) as upper_source, regexp_replace(path, '/?[^/]*$', '') as parent
    from (select path, source, string_split(trim(path, '/'), '/') as p from <<listing>>) l""")
def _(t):
    path = F.col("path")
    return t["listing"].select(
        "path", text.path_segment(path, -1).alias("last_part"), text.path_segment(path, 1).alias("first_part"),
        text.strip_slashes(path).alias("stripped"), F.upper("source").alias("upper_source"),
        text.parent_path(path).alias("parent"))


@query("email_local_part", """
    select c_custkey, split_part(address, '@', 1) as local_part
    from (select c_custkey, concat(lower(c_mktsegment), '.', cast(c_custkey as string), '@example.com') as address
          from customer) c""")
def _(t):
    address = F.concat(F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    return t["customer"].select("c_custkey", text.email_local_part(address).alias("local_part"))


@query("alnum_only", """
    select page_id, regexp_replace(url, '[^\\p{L}\\p{N}]', '', 'g') as compact from pages
    union all
    select -1 - doc_id, regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g') from documents""")
def _(t):
    pages = t["pages"].select("page_id", text.alnum_only(F.col("url")).alias("compact"))
    documents = t["documents"].select(
        (-1 - F.col("doc_id")).alias("page_id"), text.alnum_only(F.col("text")).alias("compact"))
    return pages.unionByName(documents)


@query("resource_id_segments", """
    select page_id, list_extract(list_filter(string_split(url, '/'), lambda x: x <> ''), 2) as host,
           list_extract(list_filter(string_split(url, '/'), lambda x: x <> ''), 9) as ninth
    from pages""")
def _(t):
    return t["pages"].select(
        "page_id", text.resource_segment(F.col("url"), 2).alias("host"),
        text.resource_segment(F.col("url"), 9).alias("ninth"))


@query("case_title", """
    select p_partkey, lower(p_brand) as low, upper(p_name) as up,
           list_aggregate(list_transform(string_split(p_name, ' '),
               lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), 'string_agg', ' ') as titled
    from part""")
def _(t):
    return t["part"].select(
        "p_partkey", F.lower("p_brand").alias("low"), F.upper("p_name").alias("up"),
        text.title(F.col("p_name")).alias("titled"))


@query("relative_time", """
    select event_id, ts - interval '3' day as three_days_before from events""")
def _(t):
    return t["events"].select("event_id", text.days_before(F.col("ts"), 3).alias("three_days_before"))


@query("string_replace", """
    select event_id, replace(urn, 'urn:stack::', 'urn:lake::') as urn,
           array_to_string(list_transform([urn, event_type], lambda x: replace(x, 'c', 'k')), ',') as items
    from (select event_id, event_type, concat('urn:stack::', event_type, '/index:', cast(user_id as string)) as urn
          from events) e""")
def _(t):
    urn = F.concat(F.lit("urn:stack::"), F.col("event_type"), F.lit("/index:"), F.col("user_id").cast("string"))
    return t["events"].select(
        "event_id", text.replace_in(urn, "urn:stack::", "urn:lake::").alias("urn"),
        F.array_join(text.replace_in_array(F.array(urn, F.col("event_type")), "c", "k"), ",").alias("items"))


@query("json_array_map", """
    select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.none') as absent,
           concat('k=', json_extract_string(props, '$.k'), ';type=', event_type) as merged
    from events""")
def _(t):
    parsed = F.from_json("props", "map<string,string>")
    merged = maps.merge_maps(parsed, F.create_map(F.lit("type"), F.col("event_type")))
    return t["events"].select(
        "event_id", maps.json_get(F.col("props"), "$.k", "bigint").alias("k"),
        maps.json_get(F.col("props"), "$.none", "string").alias("absent"),
        maps.canonical_map(merged).alias("merged"))


@query("prefix_map_keys", """
    select c_custkey, concat('x_nation=', cast(c_nationkey as string), ';x_segment=', c_mktsegment) as settings
    from customer""")
def _(t):
    pairs = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return t["customer"].select("c_custkey", maps.canonical_map(maps.prefix_keys(pairs, "x_")).alias("settings"))


@query("default_fallback", """
    select c_custkey,
           case when has_minutes then own_minutes when has_default then default_minutes else '15' end as minutes,
           concat(case when has_minutes then concat('minutes=', coalesce(own_minutes, 'null'))
                       when has_default then concat('minutes=', default_minutes) else '' end,
                  case when has_minutes or has_default then ';' else '' end, 'nation=', nation) as merged,
           array_to_string(list_concat(['a', c_mktsegment], ['b', c_mktsegment]), ',') as packages,
           array_to_string(list_sort(list_distinct(list_concat(['a', c_mktsegment], ['b', c_mktsegment]))), ',') as files
    from <<customer_settings>>""")
def _(t):
    own = F.map_concat(
        F.create_map(F.lit("nation"), F.col("nation")),
        F.when(F.col("has_minutes"), F.create_map(F.lit("minutes"), F.col("own_minutes"))).otherwise(maps.empty_map()))
    defaults = F.when(
        F.col("has_default"), F.create_map(F.lit("minutes"), F.col("default_minutes"))).otherwise(maps.empty_map())
    a, b = F.array(F.lit("a"), F.col("c_mktsegment")), F.array(F.lit("b"), F.col("c_mktsegment"))
    return t["customer_settings"].select(
        "c_custkey", maps.with_defaults(own, defaults, "minutes", F.lit("15")).alias("minutes"),
        maps.canonical_map(maps.merge_maps(defaults, own)).alias("merged"),
        F.array_join(maps.merge_lists(a, b), ",").alias("packages"),
        F.array_join(F.array_sort(maps.merge_lists(a, b, distinct=True)), ",").alias("files"))


@query("access_list_union", """
    select event_id, array_to_string(list_sort(list_distinct(
               case when event_id % 2 = 0 then list_concat(a, b) else b end)), ',') as allowed
    from (select event_id, [concat('10.0.', cast(user_id % 7 as string)), event_type] as a,
                 ['10.0.1', concat('10.0.', cast(user_id % 3 as string)), '10.0.1'] as b from events) e""")
def _(t):
    user = F.col("user_id")
    a = F.array(F.concat(F.lit("10.0."), (user % 7).cast("string")), F.col("event_type"))
    b = F.array(F.lit("10.0.1"), F.concat(F.lit("10.0."), (user % 3).cast("string")), F.lit("10.0.1"))
    return t["events"].select(
        "event_id", F.array_join(maps.combine_access(F.col("event_id") % 2 == 0, a, b), ",").alias("allowed"))


@query("union_distinct", """
    select source, table_name from <<listing>> union select source, table_name from <<ledger>>""")
def _(t):
    return union_distinct(t["listing"].select("source", "table_name"), t["ledger"].select("source", "table_name"))


@query("set_difference", """
    select source, table_name as name from <<listing>>
    except select db, name from <<catalog_tables>>""")
def _(t):
    stored = t["listing"].withColumnRenamed("table_name", "name")
    return difference(stored, t["catalog_tables"].withColumnRenamed("db", "source"), ["source", "name"])


@query("sorted_names", """
    select c_nationkey, cast(0 as bigint) as part, string_agg(c_mktsegment, ', ' order by c_mktsegment) as names
    from (select distinct c_nationkey, c_mktsegment from customer) c group by c_nationkey""")
def _(t):
    return sorted_names(t["customer"], ["c_nationkey"], "c_mktsegment")
