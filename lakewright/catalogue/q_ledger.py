"""Ledger views and transitions."""

from pyspark.sql import functions as F

from ..operators import ledger
from .q_functions import ROW_HASH
from .registry import query

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def entries(view: str) -> str:
    return f"""
    select source, table_name, file_name, increment,
           arg_max(stage, {{'a': ts, 'b': event_id}}) as stage,
           arg_max(rows_read, {{'a': ts, 'b': event_id}}) as rows_read,
           min(ts) as first_ts, max(ts) as last_ts,
           max(ts) filter (where stage = 'COMPLETED') as date_completed
    from <<{view}>> group by source, table_name, file_name, increment"""


OPEN = entries("open_ledger")
ORDINAL = """case {0} when 'NEW' then 1 when 'ARCHIVED' then 2 when 'STAGED' then 3 when 'CLEANED' then 4
             when 'INSERTED' then 5 when 'COMPLETED' then 6 end"""
NEXT = """case stage when 'NEW' then 'ARCHIVED' when 'ARCHIVED' then 'STAGED' when 'STAGED' then 'CLEANED'
          when 'CLEANED' then 'INSERTED' when 'INSERTED' then 'COMPLETED' end"""
KEYS = "source, table_name, file_name, increment"


def open_entries(t):
    return ledger.latest_stage(t["open_ledger"])


@query("latest_stage", entries("ledger"))
def _(t):
    return ledger.latest_stage(t["ledger"])


@query("set_completed", f"select {KEYS}, date_completed from ({OPEN}) e")
def _(t):
    return open_entries(t).select(*ledger.KEYS, "date_completed")


@query("incomplete_entries", f"select * from ({OPEN}) e where date_completed is null")
def _(t):
    return ledger.incomplete(open_entries(t))


@query("ledger_dashboard", f"""
    select * from ({OPEN}) e where source = 'S1' and contains(file_name, '1')
       and last_ts >= cast('2024-01-29 00:00:00' as timestamp)""")
def _(t):
    since = F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    return ledger.dashboard(open_entries(t), source="S1", name_contains="1", since=since)


@query("known_sources", "select distinct source from <<ledger>>")
def _(t):
    return ledger.known_sources(t["ledger"])


@query("tables_of_source", "select distinct table_name from <<ledger>> where source = 'S2'")
def _(t):
    return ledger.tables_of(t["ledger"], "S2")


@query("oldest_incomplete_topk", f"""
    select * from ({OPEN}) e where date_completed is null order by first_ts, {KEYS} limit 20""")
def _(t):
    return ledger.oldest_incomplete(open_entries(t), 20)


@query("requeue_incomplete", f"""
    select {KEYS}, stage, first_ts from ({OPEN}) e where date_completed is null""")
def _(t):
    return ledger.requeue(open_entries(t))


@query("stage_summary", f"""
    select source, table_name, stage, count(*) as entries, cast(sum(rows_read) as bigint) as rows,
           min(first_ts) filter (where date_completed is null) as oldest_open
    from ({OPEN}) e group by source, table_name, stage""")
def _(t):
    return ledger.stage_summary(open_entries(t))


@query("stage_summary_rollup", f"""
    select source, table_name, stage, count(*) as entries, cast(sum(rows_read) as bigint) as rows,
           min(first_ts) filter (where date_completed is null) as oldest_open
    from ({OPEN}) e group by rollup (source, table_name, stage)""")
def _(t):
    return ledger.stage_summary(open_entries(t), rollup=True)


@query("find_or_create_entry", f"""
    select {KEYS}, cast('{NOW}' as timestamp) as ts, 'NEW' as stage, cast(null as bigint) as rows_read
    from <<incoming>> i where not exists (
        select 1 from <<ledger>> l where l.source = i.source and l.table_name = i.table_name
           and l.file_name = i.file_name and l.increment = i.increment)""")
def _(t):
    return ledger.find_or_create(t["ledger"], t["incoming"], now())


@query("update_status", f"""
    select {KEYS}, cast('{NOW}' as timestamp) as ts, {NEXT} as stage, rows_read
    from ({OPEN}) e where date_completed is null""")
def _(t):
    return ledger.advance_all(open_entries(t), now())


@query("resume_from_stage", f"""
    select {KEYS}, stage, {NEXT} as next_stage from ({OPEN}) e where date_completed is null""")
def _(t):
    return ledger.resume_plan(open_entries(t))


@query("abandon_entry", f"""
    with e as ({OPEN}), hashed as (select *, {ROW_HASH} as row_hash from e)
    select {KEYS}, cast('{NOW}' as timestamp) as ts, 'ABANDONED' as stage, cast(null as bigint) as rows_read
    from hashed where date_completed is null and row_hash % 3 = 0""")
def _(t):
    found = open_entries(t)
    targets = found.select(ledger.entry_hash().alias("row_hash"), "increment").where(F.col("row_hash") % 3 == 0)
    return ledger.abandon(found, targets, now())


@query("transition_check", f"""
    select {KEYS}, event_id, ts, previous_stage, stage
    from (select *, lag(stage) over (partition by {KEYS} order by ts, event_id) as previous_stage from <<ledger>>) l
    where {ORDINAL.format('stage')} <> coalesce({ORDINAL.format('previous_stage')}, 0) + 1""")
def _(t):
    return ledger.illegal_transitions(t["ledger"])


@query("completion_guard", f"""
    select {KEYS}, stage, concat('ingestion of ', file_name, ' stopped at stage ', stage) as message
    from ({OPEN}) e where stage <> 'COMPLETED'""")
def _(t):
    return ledger.unfinished(open_entries(t))


@query("lookup_table_spec", """
    select source, table_name, count(*) as entries,
           concat('table ''', table_name, ''' is not declared for source ''', source, '''') as message
    from <<ledger>> l where not exists (
        select 1 from <<declared_tables>> d where d.source = l.source and d.table_name = l.table_name)
    group by source, table_name""")
def _(t):
    return ledger.unknown_tables(t["ledger"], t["declared_tables"])


@query("validate_parameters", """
    select event_id, source, table_name, file_name, try_cast(increment as int) as increment,
           concat_ws('; ', case when coalesce(source, '') = '' then 'source missing' end,
                     case when coalesce(table_name, '') = '' then 'table_name missing' end,
                     case when coalesce(file_name, '') = '' then 'file_name missing' end,
                     case when increment is null then 'increment missing'
                          when try_cast(increment as int) is null then 'increment not an integer' end) as errors
    from <<calls>>""")
def _(t):
    return ledger.check_params(t["calls"]).withColumn("errors", F.array_join("errors", "; "))
