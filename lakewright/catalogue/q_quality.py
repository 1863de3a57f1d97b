"""Data tests, quarantine, schema checks."""

from pyspark.sql import functions as F

from ..operators import declarations, quality
from ..plans.specs import ORDERS, from_dict
from ..sources.landing import HookRegistry, rows_read
from .registry import query

SPEC = from_dict(ORDERS)[("sales", "orders")]
STAGED = ["file_path", *SPEC.names]


def staged(t):
    return quality.cast_columns(t["raw_orders"], SPEC.columns, ["file_path"])


def tests(t):
    return SPEC.build_tests({"customer": t["customer"]})


# Names of the failing tests per row, in declared order.
def tagged_sql(unique_by: str) -> str:
    return f"""
    select s.*, concat_ws(',',
        case when s.o_orderkey is null then 'not_null_o_orderkey' end,
        case when s.o_orderkey is not null and count(*) over (partition by {unique_by}) > 1 then 'unique_o_orderkey' end,
        case when s.o_custkey is null then 'not_null_o_custkey' end,
        case when s.o_custkey is not null and c.c_custkey is null then 'relationships_o_custkey' end,
        case when s.o_orderstatus not in ('F', 'O', 'P') then 'accepted_values_o_orderstatus' end,
        case when s.o_totalprice is null then 'not_null_o_totalprice' end,
        case when s.o_totalprice < 0 then 'expression_o_totalprice' end) as failed
    from <<staged_orders>> s left join <<customer>> c on s.o_custkey = c.c_custkey"""


TAGGED = tagged_sql("s.o_orderkey")
TEST_NAMES = ("not_null_o_orderkey", "unique_o_orderkey", "not_null_o_custkey", "relationships_o_custkey",
              "accepted_values_o_orderstatus", "not_null_o_totalprice", "expression_o_totalprice")
SHOWN = {"o_totalprice": "double", "o_orderdate": "string"}
ROW = ", ".join(f"cast({c} as {SHOWN[c]}) as {c}" if c in SHOWN else c for c in STAGED)


@query("staged_read", f"select {ROW} from <<staged_orders>>")
def _(t):
    return staged(t)


@query("pre_process_hook", """
    select file_path, try_cast(o_orderkey as bigint) as o_orderkey,
           cast(try_cast(case when o_totalprice <> 'bad' then o_totalprice end as decimal(18,2)) as double) as o_totalprice,
           upper(o_orderpriority) as o_orderpriority
    from <<raw_orders>> where o_orderstatus <> 'X'""")
def _(t):
    hooks = HookRegistry()

    @hooks.register("sales", "orders")
    def tidy(raw):
        return raw.where(F.col("o_orderstatus") != "X").withColumns({
            "o_orderpriority": F.upper("o_orderpriority"),
            "o_totalprice": F.nullif("o_totalprice", F.lit("bad"))})

    raw = hooks.apply(t["raw_orders"], "sales", "orders")
    return quality.cast_columns(raw, SPEC.columns, ["file_path"]).select(
        "file_path", "o_orderkey", "o_totalprice", "o_orderpriority")


@query("rows_read", "select file_path, count(*) as rows_read from <<staged_orders>> group by file_path")
def _(t):
    return rows_read(staged(t), "file_path")


@query("uncastable_report", """
    select file_path, unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderdate']) as column_name,
           unnest([count(*) filter (where o_orderkey is not null and try_cast(o_orderkey as bigint) is null),
                   count(*) filter (where o_custkey is not null and try_cast(o_custkey as bigint) is null),
                   count(*) filter (where o_totalprice is not null and try_cast(o_totalprice as decimal(18,2)) is null),
                   count(*) filter (where o_orderdate is not null and try_cast(o_orderdate as date) is null)]) as rows
    from <<raw_orders>> group by file_path""")
def _(t):
    types = [(c, k) for c, k in SPEC.columns if k != "string"]
    return quality.uncastable(t["raw_orders"], types, ["file_path"])


@query("test_not_null", f"select {ROW} from <<staged_orders>> where o_totalprice is null")
def _(t):
    return quality.failing_rows(staged(t), quality.not_null("o_totalprice"))


@query("test_unique", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey from (
        select *, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem) l where n > 1""")
def _(t):
    rows = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return quality.failing_rows(rows, quality.unique("l_orderkey", "l_linenumber"))


@query("test_accepted_values", f"select {ROW} from <<staged_orders>> where o_orderstatus not in ('F', 'O', 'P')")
def _(t):
    return quality.failing_rows(staged(t), quality.accepted_values("o_orderstatus", ["F", "O", "P"]))


@query("test_expression", "select c_custkey, c_acctbal from customer where not c_acctbal >= 0")
def _(t):
    rows = t["customer"].select("c_custkey", "c_acctbal")
    return quality.failing_rows(rows, quality.expression("c_acctbal >= 0", "balance"))


@query("relationship_test", """
    select o_custkey, count(*) as failing_rows from <<staged_orders>> s
    where o_custkey is not null and not exists (select 1 from <<customer>> c where c.c_custkey = s.o_custkey)
    group by o_custkey""")
def _(t):
    return quality.orphan_keys(staged(t), "o_custkey", t["customer"], "c_custkey")


@query("test_relationships", f"""
    select {ROW} from <<staged_orders>> s
    where o_custkey is not null and not exists (select 1 from <<customer>> c where c.c_custkey = s.o_custkey)""")
def _(t):
    return quality.failing_rows(staged(t), quality.relationships("o_custkey", t["customer"], "c_custkey")).select(*STAGED)


@query("run_tests", f"select {ROW}, failed from ({TAGGED}) x")
def _(t):
    tested, _ = quality.run_tests(staged(t), tests(t))
    return tested.select(*STAGED, F.array_join(quality.FAILED, ",").alias("failed"))


@query("test_failure_counts", f"""
    with x as ({TAGGED}), names as (select unnest({list(TEST_NAMES)}) as test)
    select test, (select count(*) from x where list_contains(string_split(failed, ','), test)) as failing_rows,
           (select count(*) from x where list_contains(string_split(failed, ','), test)) = 0 as success,
           case when (select count(*) from x where list_contains(string_split(failed, ','), test)) > 0
                then concat('got ', cast((select count(*) from x where list_contains(string_split(failed, ','), test))
                     as string), ' failing rows, expected 0') end as error_message
    from names""")
def _(t):
    return quality.run_tests(staged(t), tests(t))[1]


@query("quarantine", f"""
    with x as ({TAGGED})
    select 'clean' as part, {ROW}, '' as failed from x where failed = ''
    union all select 'review', {ROW}, failed from x where failed <> ''""")
def _(t):
    clean, review, _ = quality.quarantine(quality.tag_failures(staged(t), tests(t)))
    return (
        clean.select(F.lit("clean").alias("part"), *STAGED, F.lit("").alias("failed"))
        .unionByName(review.select(F.lit("review").alias("part"), *STAGED,
                                   F.array_join(quality.FAILED, ",").alias("failed"))))


@query("quarantine_entries", f"""
    select file_path, count(*) as rows_read from ({TAGGED}) x where failed <> '' group by file_path""")
def _(t):
    return quality.quarantine(quality.tag_failures(staged(t), tests(t)))[2]


@query("compare_schema", """
    with declared(column_name, want) as (values ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'),
            ('o_orderstatus', 'string'), ('o_totalprice', 'decimal(18,2)'), ('o_orderdate', 'date'),
            ('o_orderpriority', 'string')),
         files as (select distinct file_path from <<file_columns>>)
    select f.file_path, f.column_name,
           case when d.column_name is null then 'not declared'
                else concat('type ', f.column_type, ' does not fit ', d.want) end as problem
    from <<file_columns>> f left join declared d on f.column_name = d.column_name
    where d.column_name is null or (f.column_type <> d.want and not (f.column_type = 'int' and d.want = 'bigint'))
    union all
    select files.file_path, d.column_name, 'missing' from files cross join declared d
    where not exists (select 1 from <<file_columns>> f
                      where f.file_path = files.file_path and f.column_name = d.column_name)""")
def _(t):
    return quality.compare_schema(t["file_columns"], SPEC.columns, "file_path")


def found_sql() -> str:
    """The narrowest type per file and column; texts are tested one by one, then put together."""
    texts = " union all ".join(f"select file_path, '{c}' as column_name, {c} as v from <<order_texts>>" for c in SPEC.names)
    return f"""
        select file_path, column_name,
               case when count(v) = 0 then 'void' when bool_and(lower(v) in ('true', 'false')) then 'boolean'
                    when bool_and(whole and try_cast(v as tinyint) is not null) then 'tinyint'
                    when bool_and(whole and try_cast(v as smallint) is not null) then 'smallint'
                    when bool_and(whole and try_cast(v as int) is not null) then 'int'
                    when bool_and(whole and try_cast(v as bigint) is not null) then 'bigint'
                    when bool_and(fraction) and max(digits) + max(scale) <= 38
                         then concat('decimal(', greatest(max(digits) + max(scale), 1), ',', max(scale), ')')
                    when bool_and(regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?')) then 'double'
                    when bool_and(length(v) = 10 and try_cast(v as date) is not null) then 'date'
                    when bool_and(regexp_matches(v, '^[0-9]{{4}}-') and try_cast(v as timestamp) is not null) then 'timestamp'
                    else 'string' end as column_type,
               max(digits) as digits, max(scale) as scale
        from (select *, regexp_full_match(v, '[+-]?[0-9]+') as whole,
                     regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?') as fraction,
                     case when regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?')
                          then length(regexp_replace(split_part(v, '.', 1), '^[+-]?0*', '')) end as digits,
                     case when regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?')
                          then length(regexp_replace(split_part(v, '.', 2), '0+$', '')) end as scale
              from ({texts}) t) x
        group by file_path, column_name"""


@query("found_schema", f"select file_path, column_name, column_type from ({found_sql()}) f")
def _(t):
    return quality.found_types(t["order_texts"], SPEC.names, "file_path").select("file_path", "column_name", "column_type")


#: The table that the declared orders are loaded into; the day was once declared as text, keys as int.
OLD_TABLE = (("o_orderkey", "bigint"), ("o_custkey", "int"), ("o_totalprice", "decimal(20,2)"), ("o_orderdate", "string"))


@query("compare_schema_table", f"""
    with found as ({found_sql()}),
         declared(column_name, want, kept) as (values ('o_orderkey', 'bigint', null), ('o_custkey', 'bigint', 'int'),
            ('o_orderstatus', 'string', null), ('o_totalprice', 'decimal(18,2)', null), ('o_orderdate', 'date', null),
            ('o_orderpriority', 'string', null)),
         judged as (
            select f.*, d.want, d.kept,
                   column_type in ('void', want) or want = 'string'
                   or (want = 'bigint' and column_type in ('tinyint', 'smallint', 'int'))
                   or (want = 'decimal(18,2)' and digits <= 16 and scale <= 2 and (column_type like '%int' or column_type like 'decimal%')) as fits
            from found f join declared d on f.column_name = d.column_name)
    select file_path, column_name,
           case when not fits then concat('type ', column_type, ' does not fit ', want)
                else concat('type ', want, ' does not fit ', kept, ' of the table') end as problem
    from judged where not fits or kept is not null""")
def _(t):
    found = quality.found_types(t["order_texts"], SPEC.names, "file_path")
    return quality.compare_schema(found, SPEC.columns, "file_path", OLD_TABLE)


@query("check_source_schema", """
    with d as (select * from <<declarations>>)
    select source, table_name, column_name, 'no column name' as problem from d where coalesce(column_name, '') = ''
    union all select source, table_name, column_name, 'unknown type' from d where type is null or type = 'blob'
    union all select source, table_name, column_name, 'negative length' from d where max_length < 0
    union all select source, table_name, column_name, 'length on a type other than str' from d
              where max_length is not null and type <> 'str'
    union all select source, table_name, column_name, 'minimum on a type that is not a number' from d
              where min_value is not null and type not in ('int', 'num')
    union all select source, table_name, column_name, 'enum without values' from d
              where type = 'enum' and coalesce(accepted, '') = ''
    union all select source, table_name, column_name, 'declared more than once' from d
              where coalesce(column_name, '') <> '' group by source, table_name, column_name having count(*) > 1""")
def _(t):
    return quality.check_declarations(t["declarations"])


@query("check_nested_declarations", """
    with recursive r as (select * from <<nested_declarations>>),
         reach(owner, target) as (
            select owner, include from r where include is not null
            union select reach.owner, r.include from reach join r on reach.target = r.owner where r.include is not null),
         endless as (select distinct a.owner from reach a join reach b on a.target = b.owner and b.owner = b.target),
         placed as (select r.owner, r.path, h.type as holder, regexp_replace(r.path, '[.][^.]*$', '') as above,
                           regexp_extract(r.path, '[^.]*$') as name
                    from r left join r h on h.owner = r.owner and h.path = regexp_replace(r.path, '[.][^.]*$', '')
                    where r.path like '%.%')
    select owner, path, 'unknown type' as problem from r where type = 'thing'
    union all select owner, path, 'negative length' from r where max_length < 0
    union all select owner, path, 'length on a type other than str' from r where max_length is not null and type <> 'str'
    union all select owner, path, 'minimum on a type that is not a number' from r where min_value is not null and type <> 'int'
    union all select owner, path, 'its parent is not declared' from placed where holder is null
    union all select owner, path, 'its parent holds no fields' from placed where holder not in ('list', 'map', 'include', 'any')
    union all select owner, path, 'an element of a list has a name' from placed where holder = 'list' and name <> '*'
    union all select owner, path, 'include of an unknown fragment' from r
              where type = 'include' and not exists (select 1 from r o where o.owner = r.include)
    union all select owner, path, 'include never ends' from r where include in (select owner from endless)""")
def _(t):
    rules = t["nested_declarations"].withColumn("accepted", F.split("accepted", ";"))
    return declarations.check_rules(rules)


#: Rules of `settings_documents`: three levels, two of them included.
SETTINGS = [
    ("settings", "name", "str", True, 18, None, None, None),
    ("settings", "tier", "enum", True, None, None, ["BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE"], None),
    ("settings", "limits", "map", True, None, None, None, None),
    ("settings", "limits.credit", "num", False, None, 0, None, None),
    ("settings", "limits.days", "int", True, None, None, None, None),
    ("settings", "contacts", "list", False, None, None, None, None),
    ("settings", "contacts.*", "include", False, None, None, None, "contact"),
    ("contact", "mail", "str", True, None, None, None, None),
    ("contact", "phone", "include", True, None, None, None, "phone"),
    ("phone", "code", "int", True, None, 1, None, None),
]


@query("check_settings", """
    with fine as (select c_custkey, body from <<settings_documents>> where json_valid(body)),
         contacts as (select c_custkey, i, json_extract(body, concat('$.contacts[', i, ']')) as c
                      from fine cross join (values ('0'), ('1')) n(i))
    select c_custkey, '' as path, 'not a document' as problem from <<settings_documents>> where not json_valid(body)
    union all select c_custkey, 'name', 'too long' from fine where length(json_extract_string(body, '$.name')) > 18
    union all select c_custkey, 'tier', 'not an accepted value' from fine
              where json_extract_string(body, '$.tier') not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE')
    union all select c_custkey, 'extra', 'not declared' from fine where json_extract(body, '$.extra') is not null
    union all select c_custkey, 'limits.credit', 'below the minimum' from fine
              where cast(json_extract_string(body, '$.limits.credit') as double) < 0
    union all select c_custkey, 'limits.days', 'missing' from fine where json_extract(body, '$.limits.days') is null
    union all select c_custkey, concat('contacts.', i, '.mail'), 'missing' from contacts where json_extract_string(c, '$.mail') is null
    union all select c_custkey, concat('contacts.', i, '.phone'), 'str instead of map' from contacts where json_type(c, '$.phone') = 'VARCHAR'
    union all select c_custkey, concat('contacts.', i, '.phone.code'), 'below the minimum' from contacts
              where cast(json_extract_string(c, '$.phone.code') as int) < 1""")
def _(t):
    rules = t.spark.createDataFrame(SETTINGS, declarations.RULE)
    return declarations.check_documents(t["settings_documents"], "body", "c_custkey", declarations.resolve(rules, "settings"))
