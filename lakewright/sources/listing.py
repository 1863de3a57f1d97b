"""Folder listings and their packed text form `path|json;json`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import RECENT_DAYS
from ..functions.text import days_before, path_segment
from ..operators.lists import PART_NAMES, name_lists


def recent(listing: DataFrame, now: Column, days: int = RECENT_DAYS) -> DataFrame:
    return listing.where(F.col("modified") >= days_before(now, days))


def folders(listing: DataFrame) -> DataFrame:
    return listing.where(F.col("type") == "Folder")


def pack_listing(items: DataFrame, container: str, max_items: int = PART_NAMES) -> DataFrame:
    """(schema, packed) of folders given as (schema, name, type).

    A schema without folders yields nothing; a very large one yields several
    packed rows, which `unpack_listing` reads like one.
    """
    as_json = items.select("schema", F.to_json(F.struct("name", "type")).alias("item"))
    return name_lists(as_json, ["schema"], "item", "items", max_items).select(
        "schema",
        F.concat(F.lit(f"{container.rstrip('/')}/"), F.col("schema"), F.lit("|"),
                 F.array_join("items", ";")).alias("packed"))


def unpack_listing(packed: DataFrame) -> DataFrame:
    """(schema, name) of a packed listing; the schema is the last segment of the path."""
    split = packed.select(
        path_segment(F.substring_index("packed", "|", 1), -1).alias("schema"),
        F.explode(F.split(F.expr("substr(packed, instr(packed, '|') + 1)"), ";")).alias("item"))
    return split.select("schema", F.from_json("item", "name string, type string")["name"].alias("name"))
