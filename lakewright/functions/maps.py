"""Map, list and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_EMPTY = "map<string,string>"


def empty_map() -> Column:
    return F.create_map().cast(_EMPTY)


def merge_maps(low: Column, high: Column) -> Column:
    """Key by key; `high` wins."""
    low, high = F.coalesce(low, empty_map()), F.coalesce(high, empty_map())
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)


def with_defaults(cfg: Column, defaults: Column, key: str, default: Column | None = None) -> Column:
    """Own setting, else the default set, else the argument.

    A key that exists with a NULL value counts as set.
    """
    fallback = default if default is not None else F.lit(None).cast("string")
    return (
        F.when(F.map_contains_key(cfg, key), F.try_element_at(cfg, F.lit(key)))
        .when(F.map_contains_key(defaults, key), F.try_element_at(defaults, F.lit(key)))
        .otherwise(fallback)
    )


def merge_lists(a: Column, b: Column, distinct: bool = False) -> Column:
    return F.array_union(a, b) if distinct else F.concat(a, b)


def combine_access(enabled: Column, a: Column, b: Column) -> Column:
    """Union of both lists while the first is enabled, else the second alone; sorted, distinct."""
    return F.when(enabled, F.array_sort(F.array_union(a, b))).otherwise(F.array_sort(F.array_distinct(b)))


def prefix_keys(m: Column, prefix: str) -> Column:
    return F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), k))


def json_get(text: Column, path: str, as_type: str) -> Column:
    """Typed value at a JSON path; NULL when text, path or type do not fit."""
    return F.try_variant_get(F.try_parse_json(text), path, as_type)


def canonical_map(m: Column) -> Column:
    """`k=v` pairs in key order, for display and comparison."""
    pairs = F.transform(
        F.array_sort(F.map_keys(m)),
        lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at(m, k), F.lit("null"))),
    )
    return F.array_join(pairs, ";")
