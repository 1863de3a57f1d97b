"""Nested declarations with includes, and documents checked against them.

A rule is a row: `owner` (a declaration or a fragment), `path` within it
(names joined by dots; `*` stands for any element of a list or any key of a
map), `type`, `required`, `max_length`, `min_value`, `accepted` (values of an
enum), `include` (the fragment whose rules hold below the path). Types are the
words that column declarations use too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .quality import check_declarations

RULE = "owner string, path string, type string, required boolean, max_length int, min_value int, " \
       "accepted array<string>, include string"
HOLDERS = ("list", "map", "include", "any")


class EndlessInclude(ValueError):
    """Fragments that include each other."""


def _up(path: Column) -> Column:
    """The path above; '' for the first level."""
    return F.regexp_replace(path, r"\.?[^.]*$", "")


def _last(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def endless_owners(rules: DataFrame) -> DataFrame:
    """(owner) whose includes never end: they lead into a cycle.

    Owners that include nothing open are taken away until none is left to
    take; one join a level of inclusion, whatever the number of paths.
    """
    edges = cut_lineage(rules.where("include is not null").select("owner", "include").distinct(), "includes")
    left = edges.count()
    while left:
        edges = cut_lineage(
            edges.join(edges.select(F.col("owner").alias("include")).distinct(), "include", "left_semi"), "includes")
        count = edges.count()
        if count == left:
            break
        left = count
    return edges.select("owner").distinct()


def check_rules(rules: DataFrame) -> DataFrame:
    """(owner, path, problem): everything that is wrong with declarations, at every depth."""
    single = check_declarations(rules.select(
        F.col("owner").alias("source"), F.lit("").alias("table_name"), F.col("path").alias("column_name"), "type",
        "max_length", "min_value", F.array_join("accepted", ";").alias("accepted"))).select(
        F.col("source").alias("owner"), F.col("column_name").alias("path"), "problem")
    named = rules.where("path <> ''").select("owner", "path", "type", "include", _up(F.col("path")).alias("above"))
    holders = rules.groupBy(F.col("owner").alias("o"), F.col("path").alias("p")).agg(F.first("type").alias("holder"))
    held = named.join(holders, (F.col("owner") == F.col("o")) & (F.col("above") == F.col("p")), "left").select(
        "owner", "path",
        F.when(F.col("above") == "", None)
        .when(F.col("holder").isNull(), "its parent is not declared")
        .when(F.col("holder") == "include", "its parent is an include")
        .when(~F.col("holder").isin(*HOLDERS), "its parent holds no fields")
        .when((F.col("holder") == "list") & (_last(F.col("path")) != "*"), "an element of a list has a name").alias("problem"))
    owners = rules.select(F.col("owner").alias("include")).distinct()
    nowhere = rules.where("type = 'include'").join(owners, "include", "left_anti").select(
        "owner", "path", F.lit("include of an unknown fragment").alias("problem"))
    endless = rules.join(endless_owners(rules).withColumnRenamed("owner", "include"), "include", "left_semi").select(
        "owner", "path", F.lit("include never ends").alias("problem"))
    return reduce(DataFrame.unionByName, [single, held.where("problem is not null"), nowhere, endless])


def resolve(rules: DataFrame, root: str) -> DataFrame:
    """The rules of `root` with the rules of fragments in place of includes; one join a level of inclusion."""
    reach = rules.where(F.col("owner") == root)
    if not endless_owners(rules).where(F.col("owner") == root).isEmpty():
        raise EndlessInclude(f"the includes of '{root}' never end")
    fragments = rules.select(F.col("owner").alias("_from"), *[F.col(c).alias(f"_{c}") for c in rules.columns if c != "owner"])
    done = []
    while True:
        reach = cut_lineage(reach, "rules")
        includes = reach.where("type = 'include'")
        # The place of an include is a map of the fragment's fields.
        done.append(reach.withColumn("type", F.when(F.col("type") == "include", "map").otherwise(F.col("type"))))
        if includes.isEmpty():
            break
        reach = includes.select("owner", F.col("path").alias("_at"), F.col("include").alias("_from")).join(fragments, "_from").select(
            "owner", F.concat_ws(".", "_at", "_path").alias("path"),
            *[F.col(f"_{c}").alias(c) for c in rules.columns if c not in ("owner", "path")])
    return reduce(DataFrame.unionByName, done).drop("include")


def check_documents(documents: DataFrame, body: str, by: str, rules: DataFrame) -> DataFrame:
    """(`by`, path, problem) of JSON texts against resolved rules.

    Documents are walked level by level, as deep as the rules go; a level is
    one join with the rules, and only what holds fields goes on to the next.
    NULL counts as absent. `by` has to be unique.
    """
    path = F.col("path")
    needs = rules.where("required").groupBy(_up(path).alias("rule")).agg(F.collect_set(_last(path)).alias("needs"))
    known = cut_lineage(
        rules.withColumnRenamed("path", "rule").join(needs, "rule", "left").select(
            "rule", "type", "max_length", "min_value", "accepted", "needs", _up(F.col("rule")).alias("above"),
            _last(F.col("rule")).alias("name")), "rules")
    depth = known.agg(F.max(F.size(F.split("rule", r"\.")))).first()[0] or 0
    # The required names of the first level, as the declaration lists them.
    top = needs.where("rule = ''").first()
    first = F.array(*[F.lit(n) for n in sorted(top["needs"])]) if top else F.lit(None).cast("array<string>")
    # Documents are dealt to all tasks by their keys: a few small files may hold very many of them.
    parsed = documents.select(by, body).repartition(F.col(by)).select(by, F.col(body).alias("v"), F.try_parse_json(F.col(body)).alias("_parsed"))
    fine = F.coalesce(F.schema_of_variant("_parsed").startswith("OBJECT"), F.lit(False))
    nodes = cut_lineage(parsed.select(
        by, F.lit("").alias("path"), F.lit("").alias("rule"), F.lit("map").alias("type"), first.alias("needs"),
        F.when(fine, F.col("v").cast("string")).alias("v")), "nodes")
    found = [nodes.where("v is null").select(by, "path", F.lit("not a document").alias("problem"))]
    nodes = nodes.where("v is not null")
    for _ in range(depth):
        # A value is opened once a level: its fields or elements, and the names that it lacks, come out as rows together.
        opened = nodes.withColumn("v", F.parse_json("v")).select(
            by, "path", "rule", F.when(F.col("type") == "map", F.col("needs")).alias("needs"),
            F.expr("map_filter(cast(case when type = 'map' then v end as map<string,variant>), (k, w) -> not is_variant_null(w))").alias("fields"),
            F.expr("cast(case when type = 'list' then v end as array<variant>)").alias("elements"))
        none = F.lit(None).cast("variant")
        absent = F.filter(F.array_except("needs", F.map_keys("fields")), lambda n: n != "*")
        entries = [
            F.transform(F.map_entries("fields"), lambda e: _entry(e["key"], e["key"], e["value"], False)),
            F.transform(absent, lambda n: _entry(n, n, none, True)),
            F.transform("elements", lambda v, i: _entry(i.cast("string"), F.lit("*"), v, False))]
        empty = F.array().cast("array<struct<key string, name string, value variant, absent boolean>>")
        kids = opened.select(
            by, F.col("path").alias("_above"), F.col("rule").alias("_in"),
            F.explode(F.concat(*[F.coalesce(e, empty) for e in entries])).alias("e")).select(
            by, "_in", F.concat_ws(".", F.nullif(F.col("_above"), F.lit("")), "e.key").alias("path"), F.col("e.name").alias("_name"),
            F.col("e.value").alias("v"), F.col("e.absent").alias("_absent"))
        named, anyone = known.alias("n"), known.where("name = '*'").alias("a")
        ruled = (
            kids.join(named, (F.col("_in") == F.col("n.above")) & (F.col("_name") == F.col("n.name")), "left")
            .join(anyone, (F.col("_in") == F.col("a.above")) & F.col("n.rule").isNull(), "left")
            .select(by, "path", "v", "_absent", *[F.coalesce(f"n.{c}", f"a.{c}").alias(c)
                                                  for c in ("rule", "type", "max_length", "min_value", "accepted", "needs")]))
        # Each step uses what the one before found for a value, so that it is looked at once.
        seen = (
            ruled.withColumn("_json", F.to_json("v")).withColumn("_kind", _kind(F.col("v"), F.col("_json")))
            .withColumn("_text", F.when(F.col("_kind").isin("map", "list"), F.col("_json")).otherwise(F.expr("try_variant_get(v, '$', 'string')"))))
        judged = cut_lineage(seen.select(
            by, "path", "rule", "type", "needs", F.when(F.col("_absent"), F.lit("missing")).otherwise(_problem()).alias("problem"),
            F.when(F.col("type").isin("list", "map"), F.col("_json")).alias("v")), "nodes")
        found.append(judged.where("problem is not null").select(by, "path", "problem"))
        nodes = judged.where("problem is null and v is not null").drop("problem")
    return reduce(DataFrame.unionByName, found)


def _entry(key: Column, name: Column, value: Column, absent: bool) -> Column:
    return F.struct(key.alias("key"), name.alias("name"), value.alias("value"), F.lit(absent).alias("absent"))


def _kind(v: Column, json: Column) -> Column:
    """The word for a value with that JSON text, whose first character tells all but the kinds of numbers."""
    first = F.substring(json, 1, 1)
    return (
        F.when(first == "{", "map").when(first == "[", "list").when(first == '"', "str").when(json.isin("true", "false"), "bool")
        .when(json == "null", "null").when(F.schema_of_variant(v) == "BIGINT", "int").otherwise("num"))


def _problem() -> Column:
    """What is wrong with a value `v` of a `_kind` and `_text` under its rule, first things first."""
    wanted, kind, text = F.col("type"), F.col("_kind"), F.col("_text")
    number = F.expr("try_variant_get(v, '$', 'double')")
    alike = (
        F.when(wanted == "any", True).when(wanted == "enum", kind.isin("str", "int", "num", "bool"))
        .when(wanted == "ip", (kind == "str") & text.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*)(/[0-9]{1,3})?$"))
        .when(wanted.isin("num", "double", "float") | wanted.startswith("decimal"), kind.isin("int", "num"))
        .when(wanted.isin("tinyint", "smallint", "int", "bigint"), kind == "int")
        .when(wanted.isin("string", "date", "timestamp", "timestamp_ntz", "binary"), kind == "str")
        .when(wanted == "boolean", kind == "bool").otherwise(kind == wanted))
    return (
        F.when(F.col("rule").isNull(), F.lit("not declared")).when(kind == "null", F.lit(None))
        .when(~alike, F.concat(kind, F.lit(" instead of "), wanted))
        .when(F.length(text) > F.col("max_length"), F.lit("too long"))
        .when(number < F.col("min_value"), F.lit("below the minimum"))
        .when((wanted == "enum") & ~F.array_contains("accepted", text), F.lit("not an accepted value")))
