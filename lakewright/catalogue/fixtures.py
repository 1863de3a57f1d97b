"""Input views over the given tables; the texts mean the same in Spark SQL and in DuckDB."""

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # File inventory.
    "listing": """
        select concat('raw/', source, '/', lang, '/', cast(doc_id as string), '.txt') as path,
               source, lang as table_name, concat(cast(doc_id as string), '.txt') as file_name,
               case when doc_id % 10 = 0 then 'File' else 'Folder' end as type,
               case when doc_id % 17 = 0 then 0 else n_chars end as size,
               cast('2024-01-01 00:00:00' as <<ntz>>) + doc_id * interval '1' hour as modified
        from <<documents>>""",
    "known": "select path, source from <<listing>> where size % 3 = 0",
    # A second store: half of the listing plus files of its own.
    "target_listing": """
        select path, size from <<listing>> where size % 2 = 0
        union all select concat('old/', cast(page_id as string)) as path, page_id as size from <<pages>>""",
    # Landing paths of every shape, most of them proper.
    "landing_paths": """
        select case when doc_id % 13 = 0 then concat('/', path, '/')
                    when doc_id % 11 = 0 then concat('draw/', source, '/', cast(doc_id as string))
                    when doc_id % 7 = 0 then concat('raw/', source)
                    when doc_id % 5 = 0 then concat('raw/', source, '/', lang, '/deep/', cast(doc_id as string))
                    else path end as path
        from (select doc_id, source, lang,
                     concat('raw/', source, '/', lang, '/', cast(doc_id as string), '.txt') as path
              from <<documents>>) d""",
    "catalog_tables": """
        select distinct lower(source) as db, lower(table_name) as name from <<listing>> where table_name <> 'fr'""",
    # Aged objects of all kinds.
    "objects": """
        select path, case when size % 3 = 0 then 'snapshot' when size % 3 = 1 then 'version' else 'base' end as kind,
               modified, modified - interval '5' day as created
        from <<listing>>""",
    # Transition log; ties of ts are broken by event_id.
    "ledger": """
        select event_id, concat('S', cast(user_id % 5 as string)) as source,
               concat('t', cast(user_id % 7 as string)) as table_name,
               concat('f', cast(user_id as string), '.csv') as file_name, cast(0 as int) as increment, ts,
               case event_type when 'signup' then 'NEW' when 'view' then 'ARCHIVED' when 'click' then 'STAGED'
                               when 'purchase' then 'INSERTED' else 'COMPLETED' end as stage,
               cast(round(value) as bigint) as rows_read
        from <<events>>""",
    # A log in which about half of the entries stay open.
    "open_ledger": """
        select * from <<ledger>>
        where stage <> 'COMPLETED' or substr(md5(file_name), 1, 1) < '8'""",
    "incoming": """
        select concat('S', cast(c_custkey % 5 as string)) as source,
               concat('t', cast(c_custkey % 7 as string)) as table_name,
               concat('f', cast(c_custkey as string), '.csv') as file_name, cast(0 as int) as increment
        from <<customer>>""",
    "declared_tables": """
        select distinct source, table_name from <<ledger>>
        where not (source = 'S1' and table_name in ('t2', 't3')) and not (source = 'S4' and table_name = 't6')""",
    # Ingestion calls with missing and broken parameters.
    "calls": """
        select event_id,
               case when event_id % 11 = 0 then null else concat('S', cast(user_id % 5 as string)) end as source,
               case when event_id % 13 = 0 then '' else concat('t', cast(user_id % 7 as string)) end as table_name,
               case when event_id % 17 = 0 then null else concat('f', cast(user_id as string), '.csv') end as file_name,
               case when event_id % 19 = 0 then 'x' when event_id % 23 = 0 then null
                    else cast(event_id % 3 as string) end as increment
        from <<events>>""",
    # Raw text rows with injected faults, one file per month.
    "raw_orders": """
        select concat('sales/orders/', cast(year(o_orderdate) * 100 + month(o_orderdate) as string), '.csv') as file_path,
               case when o_orderkey % 101 = 0 then cast(o_orderkey - 1 as string)
                    else cast(o_orderkey as string) end as o_orderkey,
               case when o_orderkey % 83 = 0 then null
                    when o_orderkey % 211 = 0 then cast(-o_orderkey - 1 as string)
                    else cast(o_custkey as string) end as o_custkey,
               case when o_orderkey % 89 = 0 then 'X' else o_orderstatus end as o_orderstatus,
               case when o_orderkey % 97 = 0 then 'bad'
                    when o_orderkey % 223 = 0 then concat('-', cast(cast(o_totalprice as decimal(18,2)) as string))
                    else cast(cast(o_totalprice as decimal(18,2)) as string) end as o_totalprice,
               cast(cast(o_orderdate as date) as string) as o_orderdate,
               o_orderpriority
        from <<orders>>""",
    "staged_orders": """
        select file_path, try_cast(o_orderkey as bigint) as o_orderkey, try_cast(o_custkey as bigint) as o_custkey,
               o_orderstatus, try_cast(o_totalprice as decimal(18,2)) as o_totalprice,
               try_cast(o_orderdate as date) as o_orderdate, o_orderpriority
        from <<raw_orders>>""",
    # Columns found per file; some files have one too many, one too few, or another type.
    "file_columns": """
        with files as (select file_path, min(o_orderdate) as first_day from <<raw_orders>> group by file_path),
             shaped as (select file_path, cast(substr(first_day, 6, 2) as int) as m from files)
        select file_path, 'o_orderkey' as column_name,
               case when m = 4 then 'string' when m = 6 then 'int' else 'bigint' end as column_type from shaped
        union all select file_path, 'o_custkey', 'bigint' from shaped
        union all select file_path, 'o_orderstatus', 'string' from shaped where m <> 9
        union all select file_path, 'o_totalprice', 'decimal(18,2)' from shaped
        union all select file_path, 'o_orderdate', case when m = 2 then 'timestamp' else 'date' end from shaped
        union all select file_path, 'o_orderpriority', 'string' from shaped
        union all select file_path, 'o_comment', 'string' from shaped where m = 5""",
    # Texts whose narrowest type differs from file to file.
    "order_texts": """
        select concat('sales/orders/', cast(year(o_orderdate) * 100 + month(o_orderdate) as string), '.csv') as file_path,
               case when month(o_orderdate) = 3 and o_orderkey % 50 = 0 then concat('A', cast(o_orderkey as string))
                    else cast(o_orderkey as string) end as o_orderkey,
               case when month(o_orderdate) = 6 then concat(cast(o_custkey as string), '.5')
                    when month(o_orderdate) = 7 then cast(o_custkey * 10000000000 as string)
                    when month(o_orderdate) = 8 then cast(o_custkey % 100 as string)
                    else cast(o_custkey as string) end as o_custkey,
               case when month(o_orderdate) = 9 then null when month(o_orderdate) = 10 then 'true' else o_orderstatus end as o_orderstatus,
               case when month(o_orderdate) = 4 then concat(cast(o_custkey as string), 'e3')
                    when month(o_orderdate) = 5 then concat(cast(cast(o_totalprice as decimal(18,2)) as string), '125')
                    when month(o_orderdate) = 11 then concat('-0', cast(cast(o_totalprice as decimal(18,2)) as string))
                    else cast(cast(o_totalprice as decimal(18,2)) as string) end as o_totalprice,
               case when month(o_orderdate) = 2 and o_orderkey % 3 = 0
                    then concat(cast(cast(o_orderdate as date) as string), ' 10:30:00')
                    when month(o_orderdate) = 12 and o_orderkey % 97 = 0 then '1999-02-30'
                    else cast(cast(o_orderdate as date) as string) end as o_orderdate,
               o_orderpriority
        from <<orders>>""",
    # Nested settings of a customer as a document, some of them broken.
    "settings_documents": """
        select c_custkey,
               case when c_custkey % 101 = 0 then concat('{"name":"', c_name, '"')
                    else concat('{"name":"', c_name, case when c_custkey % 19 = 0 then 'x' else '' end,
                                '","tier":"', c_mktsegment, '",', case when c_custkey % 17 = 0 then '"extra":1,' else '' end,
                                '"limits":{"credit":', cast(cast(c_acctbal as decimal(18,2)) as string),
                                case when c_custkey % 7 = 0 then '' else concat(',"days":', cast(c_custkey % 30 as string)) end,
                                '},"contacts":[{"mail":"a@b","phone":{"code":', cast(c_nationkey - 2 as string), '}},{',
                                case when c_custkey % 13 = 0 then '"mail":null,' else '"mail":"c@d",' end,
                                case when c_custkey % 23 = 0 then '"phone":"12"' else '"phone":{"code":5}' end, '}]}') end as body
        from <<customer>>""",
    # Rules of nested declarations, eight parts an owner; fragments include each other, some of them for ever.
    "nested_declarations": """
        with p as (select p_partkey, p_size, p_partkey % 8 as m, p_partkey - p_partkey % 8 as o from <<part>>)
        select concat('T', cast(o as string)) as owner,
               case m when 0 then 'a' when 1 then 'a.b' when 2 then 'a.b.*' when 3 then 'a.b.x' when 4 then 'i' when 5 then 'n'
                      when 6 then 'n.c' else 'z.q' end as path,
               case when m = 0 then 'map' when m = 1 then 'list' when m = 2 and p_size % 9 = 3 then 'thing'
                    when m = 4 and o % 32 <> 24 then 'include' when m >= 4 then 'int' else 'str' end as type,
               m < 2 as required, case when m = 2 then p_size - 3 end as max_length, case when m = 3 then 0 when m = 5 then p_size end as min_value,
               cast(null as string) as accepted,
               case when m <> 4 or o % 32 = 24 then null when p_size % 11 = 7 then 'nowhere'
                    when o % 32 = 16 and p_size % 2 = 0 then concat('T', cast(o - 8 as string))
                    else concat('T', cast(o + 8 as string)) end as include
        from p""",
    # One declared column per part, some of them broken.
    "declarations": """
        select p_brand as source, p_type as table_name,
               case when p_partkey % 37 = 0 then null when p_partkey % 41 = 0 then ''
                    else concat('c', cast(p_partkey as string)) end as column_name,
               case p_partkey % 9 when 0 then 'str' when 1 then 'int' when 2 then 'bool' when 3 then 'enum'
                    when 4 then 'list' when 5 then 'map' when 6 then 'num'
                    when 7 then (case when p_partkey % 2 = 0 then 'blob' else 'any' end) else 'str' end as type,
               case when p_partkey % 9 = 0 then p_size - 3 when p_partkey % 29 = 0 then p_size end as max_length,
               case when p_partkey % 9 = 1 then 0 when p_partkey % 31 = 0 then 1 end as min_value,
               case when p_partkey % 9 = 3 and p_partkey % 4 <> 1 then 'a;b' end as accepted
        from <<part>>
        union all
        select p_brand, p_type, concat('c', cast(p_partkey as string)), 'any', null, null, null
        from <<part>> where p_partkey % 53 = 5""",
    "target_orders": """
        select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as decimal(18,2)) as o_totalprice
        from <<orders>> where o_orderkey % 3 <> 0""",
    # With the targets, every order is on one side at least.
    "order_updates": """
        select o_orderkey, o_custkey, 'U' as o_orderstatus, cast(o_totalprice as decimal(18,2)) as o_totalprice
        from <<orders>> where o_orderkey % 2 = 0 or o_orderkey % 3 = 0""",
    # Several updates per key.
    "repeated_updates": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
               cast(l_quantity as decimal(18,2)) as l_quantity, l_returnflag
        from <<lineitem>>""",
    # Settings as leaves per layer. Some layers hold a whole subtree as one value.
    "settings": """
        select cast(p_partkey % 3 as int) as layer,
               case when p_partkey % 29 = 0 then concat('g', cast(floor(p_partkey / 100) as int))
                    when p_partkey % 13 = 0 then concat('g', cast(floor(p_partkey / 100) as int), '.s', cast(p_size % 5 as string))
                    else concat('g', cast(floor(p_partkey / 100) as int), '.s', cast(p_size % 5 as string),
                                '.k', cast(p_partkey % 4 as string)) end as path,
               concat('v', cast(max(p_partkey) as string)) as value
        from <<part>> group by 1, 2""",
    # Own and default settings of customers, one row per key, as text.
    "customer_settings": """
        select c_custkey, c_mktsegment, cast(c_nationkey as string) as nation,
               case when c_custkey % 4 = 0 then null else cast(c_custkey % 60 as string) end as own_minutes,
               c_custkey % 3 = 0 as has_minutes, c_custkey % 5 <> 0 as has_default,
               cast(15 + c_nationkey as string) as default_minutes
        from <<customer>>""",
    "log_rows": """
        select event_id, ts, event_type as category, concat('type', cast(user_id % 5 as string)) as resource_type,
               concat('r', cast(user_id as string)) as resource_id,
               case when event_id % 3 = 0 then 'metric' else 'log' end as kind
        from <<events>>""",
    # Switches of types; type4 has none.
    "log_types": """
        select 'type0' as resource_type, true as enabled union all select 'type1', false
        union all select 'type2', true union all select 'type3', false""",
    # Switches of resources: every pair of on, off and unset; every fourth resource has none.
    "log_resources": """
        select concat('r', cast(user_id as string)) as resource_id,
               case user_id % 3 when 1 then true when 2 then false end as logs_enabled,
               case cast(floor(user_id / 3) as bigint) % 3 when 1 then true when 2 then false end as metrics_enabled,
               case when user_id % 5 = 0 then 'error;click' end as log_categories,
               case when user_id % 7 = 0 then 'view' end as metric_categories
        from (select distinct user_id from <<events>>) u where user_id % 4 <> 3""",
    # References by key, by literal id, by both, by neither.
    "references_made": """
        select o_orderkey, case when o_orderkey % 3 = 0 then null
                                when o_orderkey % 7 = 0 then concat('gone', cast(o_custkey as string))
                                else concat('Customer#', lpad(cast(o_custkey as string), 9, '0')) end as ref_key,
               case when o_orderkey % 4 = 0 then o_custkey + 1000000 end as literal_id
        from <<orders>>""",
    # Lineage: a binary tree over the customers.
    "edges": """
        select concat('n', cast(c_custkey as string)) as child,
               concat('n', cast(cast(floor((c_custkey - 1) / 2) as bigint) as string)) as parent
        from <<customer>> where c_custkey > 0""",
    # Plan documents with two steps each.
    "plan_docs": """
        select event_id, concat(
            '{"steps":[{"op":"', case when event_id % 3 = 0 then 'create' when event_id % 3 = 1 then 'update' else 'same' end,
            '","urn":"urn:stack::', event_type, '/index:', cast(user_id as string),
            '"},{"op":"create","urn":"urn:stack::', event_type, '/last:', cast(event_id % 7 as string), '"}]}') as doc
        from <<events>>""",
    # State documents with nested records: folders and links of the lake, and a zone that only mentions them.
    "state_docs": """
        select event_id, concat(
            '{"deployment":{"resources":[{"urn":"urn::lake:catalog/', event_type, ':', cast(user_id as string),
            case when event_id % 2 = 0 then '/folder:Folder","type":"lake:catalog/folder:Folder'
                 else '/link:Link","type":"lake:catalog/link:Link' end,
            '","dependencies":["urn::lake:catalog/x', cast(event_id % 5 as string), '","urn::other/link:Link"],',
            '"property_dependencies":{"target":["lake:catalog/s', cast(user_id % 3 as string), '"],"keep":["lake:catalog/k"]}},',
            '{"urn":"urn::zone/lake:catalog/link:Link/', cast(event_id as string), '","type":"zone:lake:catalog/link:Link",',
            '"dependencies":["lake:catalog/z"],"property_dependencies":{"target":["lake:catalog/t"]}}]}}') as doc
        from <<events>>""",
    # Documents of shops in several regions, parts missing here and there.
    "output_docs": """
        select event_id, case event_id % 5 when 0 then 'north' when 1 then 'south' when 2 then 'east'
                                           when 3 then 'hub' else 'spare' end as env,
               concat('{"shop":{"owner":{"id":"o', cast(user_id % 5 as string), '"', 
                      case when event_id % 4 = 0 then '' else concat(',"mail":"m', cast(user_id as string), '@example.com"') end,
                      '}},"ledger":{', case when event_id % 50 = 0 then '' else concat('"region":{"code":"', event_type, '"}') end,
                      '},"links":{"catalogue":"https://c', cast(user_id as string), '"',
                      case when event_id % 3 = 0 then ',"exchange":"https://x"' else '' end, '}}') as doc
        from <<events>>""",
}
