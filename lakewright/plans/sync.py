"""Catalogue sync: which stored tables the catalogue lacks, and registering them."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import LISTING_ATTEMPTS, RECENT_DAYS, RETRY_SECONDS
from ..operators.keys import absent
from ..operators.lists import name_lists
from ..session import cut_lineage
from ..sinks.store import TableStore
from ..sources.layout import Layout
from ..sources.listing import folders, recent

Result = TypeVar("Result")


def new_tables(storage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stored (schema, name) pairs missing from the catalogue (db, name); case does not matter."""
    known = catalog.select(F.lower("db").alias("_db"), F.lower("name").alias("_name"))
    stored = storage.select("schema", "name").distinct().withColumns(
        {"_db": F.lower("schema"), "_name": F.lower("name")})
    return absent(stored, known, ["_db", "_name"]).select("schema", "name")


def alert_texts(missing: DataFrame) -> DataFrame:
    """(schema, tables, message) per schema with missing tables."""
    return name_lists(missing, ["schema"], "name", "names").select(
        "schema", F.array_join("names", ", ").alias("tables"),
        F.concat(F.lit("schema "), F.col("schema"), F.lit(" has unregistered tables: "),
                 F.array_join("names", ", "), F.lit("; run the catalogue sync")).alias("message"))


def sync(listing: DataFrame, catalog: DataFrame, now: Column, days: int = RECENT_DAYS) -> DataFrame:
    """The scheduled chain: recent folders that the catalogue does not know."""
    return alert_texts(new_tables(folders(recent(listing, now, days)), catalog))


def registrations(missing: DataFrame, container: str, layout: Layout | None = None) -> DataFrame:
    """(db, name, location) of tables to create: lower-case names, locations as stored."""
    root = (layout or Layout()).path(container)
    return missing.select(
        F.lower("schema").alias("db"), F.lower("name").alias("name"),
        F.concat(F.lit(root + "/"), F.col("schema"), F.lit("/"), F.col("name")).alias("location"))


def catalog_tables(spark: SparkSession, schemas: DataFrame) -> DataFrame:
    """(db, name) of what the session catalogue holds for the given schemas; one statement per schema."""
    empty = spark.createDataFrame([], "db string, name string")
    names = [r.db for r in schemas.select(F.lower("schema").alias("db")).distinct().collect()]
    found = [spark.sql(f"SHOW TABLES IN `{db}`").where(~F.col("isTemporary")).select(
        F.col("namespace").alias("db"), F.col("tableName").alias("name")) for db in names if spark.catalog.databaseExists(db)]
    return reduce(DataFrame.unionByName, found, empty)


def sync_catalog(spark: SparkSession, storage: DataFrame, container: str, layout: Layout) -> int:
    """Register stored tables the catalogue lacks; safe to repeat. Returns how many were created.

    Tables of a `TableStore` show their current version; those that are
    registered already are brought to it. Names stream through the driver.
    """
    store = TableStore(spark, layout.path(container))
    missing = new_tables(storage, catalog_tables(spark, storage)).withColumn("_new", F.lit(True))
    created = 0
    for row in storage.select("schema", "name").distinct().join(missing, ["schema", "name"], "left").toLocalIterator():
        table, db, name = f"{row.schema}/{row.name}", row.schema.lower(), row.name.lower()
        if row._new:
            spark.sql("CREATE DATABASE IF NOT EXISTS IDENTIFIER(:db)", args={"db": db})
            created += 1
        if store.version(table):
            store.show_as(table, f"{db}.{name}")
        elif row._new:
            spark.catalog.createTable(f"{db}.{name}", path=store.path(table), source="parquet")
    return created


def with_retries(job: Callable[[], Result], attempts: int = LISTING_ATTEMPTS, seconds: float = RETRY_SECONDS) -> Result:
    """Run a job again after a failure, with a pause in between. The job has to run its own action: a frame fails only when it is used."""
    for attempt in range(1, attempts + 1):
        try:
            return job()
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(seconds)


def scheduled_sync(spark: SparkSession, listing: Callable[[], DataFrame], now: Column, days: int = RECENT_DAYS,
                   attempts: int = LISTING_ATTEMPTS, seconds: float = RETRY_SECONDS,
                   catalog: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The scheduled chain as one job: the listing with retries, its recent folders, and which of them the catalogue lacks.

    `catalog` gives (db, name) of what is registered for the folders it gets; by default the session catalogue.
    """
    def listed() -> DataFrame:
        return cut_lineage(folders(recent(listing(), now, days)), "listing")

    storage = with_retries(listed, attempts, seconds)
    known = catalog(storage) if catalog else catalog_tables(spark, storage)
    return alert_texts(new_tables(storage, known))
