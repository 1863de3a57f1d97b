"""Record merges: keyed entities, layered settings, log routing, references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maps import merge_maps
from .inventory import parents_of


def entity_upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Overlay new payload maps on existing ones, top level only; unknown keys are inserted.

    Keys must be unique on both sides.
    """
    keys = list(keys)
    old = existing.select(*keys, F.col(payload).alias("_old"))
    fresh = new.select(*keys, F.col(payload).alias("_new"))
    return old.join(fresh, keys, "full_outer").select(
        *keys, merge_maps(F.col("_old"), F.col("_new")).alias(payload))


def entities(df: DataFrame, partition_key: Column, row_key: Column, attributes: Mapping[str, Column]) -> DataFrame:
    """Rows as keyed entities with an attribute map; NULL attributes are left out."""
    pairs = [x for name, col in attributes.items() for x in (F.lit(name), col.cast("string"))]
    return df.select(
        partition_key.cast("string").alias("partition_key"), row_key.cast("string").alias("row_key"),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("entity"))


def resolve_layers(settings: DataFrame, sep: str = ".") -> DataFrame:
    """Effective (path, value, layer) of settings given as leaves per layer; the highest layer wins.

    Maps merge per key; a scalar or list replaces a whole subtree, and a
    subtree replaces a scalar. So a leaf also falls to any higher layer that
    has a leaf above or below its path.
    """
    leaves = settings.groupBy("path").agg(
        F.max("layer").alias("layer"), F.max_by("value", "layer").alias("value"))
    exploded = leaves.select("path", "layer", F.explode(parents_of(F.col("path"), sep)).alias("_prefix"))
    # Highest layer with a leaf somewhere below a prefix.
    below = exploded.groupBy(F.col("_prefix").alias("path")).agg(F.max("layer").alias("_below"))
    # Leaves with an ancestor that is itself a leaf of a higher layer.
    roofs = leaves.select(F.col("path").alias("_prefix"), F.col("layer").alias("_roof"))
    covered = exploded.join(roofs, "_prefix").where(F.col("_roof") > F.col("layer")).select("path").distinct()
    return (
        leaves.join(below, "path", "left")
        .where(F.col("_below").isNull() | (F.col("_below") <= F.col("layer")))
        .join(covered, "path", "left_anti")
        .select("path", "value", "layer")
    )


def layer_winners(settings: DataFrame) -> DataFrame:
    """Highest layer per path, without the subtree rule."""
    return settings.groupBy("path").agg(
        F.max("layer").alias("layer"), F.max_by("value", "layer").alias("value"))


def route_logs(records: DataFrame, types: DataFrame, resources: DataFrame) -> DataFrame:
    """Logs and metrics (`kind`: log or metric) that their resource's settings send on.

    types: resource_type, enabled; one row per type, a type without one is on.
    resources: resource_id, logs_enabled, metrics_enabled, log_categories,
    metric_categories (`;`-separated, NULL for all); one row per resource, all may
    be NULL. A resource of a disabled type sends nothing unless its logs or
    metrics are explicitly on. Beyond that each kind is on unless switched off,
    and sends its configured categories.
    """
    joined = records.join(types.select("resource_type", F.col("enabled").alias("_type")), "resource_type", "left").join(
        resources, "resource_id", "left")
    used = (F.coalesce("_type", F.lit(True)) | F.coalesce("logs_enabled", F.lit(False))
            | F.coalesce("metrics_enabled", F.lit(False)))

    def sends(kind: str, enabled: str, categories: str) -> Column:
        chosen = F.col(categories).isNull() | F.array_contains(F.split(categories, ";"), F.col("category"))
        return (F.col("kind") == kind) & F.coalesce(enabled, F.lit(True)) & chosen

    passed = sends("log", "logs_enabled", "log_categories") | sends("metric", "metrics_enabled", "metric_categories")
    return joined.where(used & passed).select(*records.columns)


def resolve_reference(df: DataFrame, lookup: DataFrame, key: str, literal: str,
                      lookup_key: str, lookup_id: str) -> DataFrame:
    """Rows with `resolved_id`, NULL where nothing resolves. A known key wins over a literal id."""
    table = lookup.select(F.col(lookup_key).alias(key), F.col(lookup_id).alias("_found"))
    return df.join(table, key, "left").select(*df.columns, F.coalesce("_found", literal).alias("resolved_id"))


def distinct_where(df: DataFrame, column: str, predicate: Column) -> DataFrame:
    return df.where(predicate).select(column).distinct()


def any_enabled(df: DataFrame, by: Sequence[str], flag: Column, extra: Column | None = None) -> DataFrame:
    """Per group whether any member is enabled, and whether any enabled member meets `extra`."""
    found = [F.coalesce(F.bool_or(flag), F.lit(False)).alias("enabled")]
    if extra is not None:
        found.append(F.coalesce(F.bool_or(flag & extra), F.lit(False)).alias("enabled_extra"))
    return df.groupBy(*by).agg(*found)


@dataclass(frozen=True)
class Rename:
    """`old` becomes `new`: in urn and type of records of `kind` (of any of the prefix, if None), in the
    property dependencies `properties` of those records, and in the dependencies of every record."""
    old: str
    new: str
    kind: str | None = None
    properties: tuple[str, ...] = ()


def rewrite_resources(resources: DataFrame, rules: Sequence[Rename], kind_prefix: str) -> DataFrame:
    """Rewrite type names inside nested resource records (urn, type, dependencies, property_dependencies).

    All rules apply to every record's `dependencies`. Only records whose
    type starts with `kind_prefix` are rewritten themselves, each rule where the record's
    type, before any change, ends with its `kind`; `properties` are left alone by rules that do not name them.
    """
    def meant(rule: Rename) -> Column:
        mine = F.col("type").startswith(kind_prefix)
        return mine if rule.kind is None else mine & F.col("type").endswith(rule.kind)

    def swap(text: Column, rule: Rename) -> Column:
        return F.replace(text, F.lit(rule.old), F.lit(rule.new))

    def own(column: str) -> Column:
        return reduce(lambda text, r: F.when(meant(r), swap(text, r)).otherwise(text), rules, F.col(column))

    def under(properties: Column, rule: Rename) -> Column:
        changed = F.transform_values(properties, lambda k, v: F.when(
            k.isin(*rule.properties), F.transform(v, lambda x: swap(x, rule))).otherwise(v))
        return F.when(meant(rule), changed).otherwise(properties)

    properties = reduce(under, [r for r in rules if r.properties], F.col("property_dependencies"))
    return resources.withColumns({
        "dependencies": F.transform("dependencies", lambda x: reduce(swap, rules, x)),
        "property_dependencies": properties, "urn": own("urn"), "type": own("type")})
