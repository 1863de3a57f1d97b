"""Query registry. `<<name>>` in SQL text stands for a table or an input view."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .fixtures import BASE_TABLES, VIEWS

_NAME = re.compile(r"<<(\w+)>>")


class Tables:
    """Given tables and input views of one data folder, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        def resolve(match: re.Match) -> str:
            name = match.group(1)
            if name == "ntz":
                return "timestamp_ntz"
            if name in BASE_TABLES:
                return f"parquet.`{self.folder}/{name}.parquet`"
            return f"({_NAME.sub(resolve, VIEWS[name])})"
        return self.spark.sql(_NAME.sub(resolve, text))


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def plain_types(df: DataFrame) -> DataFrame:
    """Results in types every client shows alike: decimals as doubles, dates as text."""
    shown = {"decimal": "double", "date": "string"}
    return df.select(*[
        F.col(c).cast(shown[kind.split("(")[0]]).alias(c) if kind.split("(")[0] in shown else F.col(c)
        for c, kind in df.dtypes])


def query(name: str, oracle: str | None = None):
    def add(run: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered already")
        QUERIES[name] = Query(lambda tables: plain_types(run(tables)), oracle)
        return run
    return add


def query_functions() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        return lambda spark, folder: q.run(Tables(spark, folder))
    return {name: bind(q) for name, q in QUERIES.items()}


def _oracle_sql(text: str) -> str:
    """The text with its input views as leading CTEs."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in _NAME.findall(body):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    def plain(body: str) -> str:
        return _NAME.sub(lambda m: "timestamp" if m.group(1) == "ntz" else m.group(1), body)

    visit(text)
    ctes = ", ".join(f"{name} as ({plain(VIEWS[name])})" for name in needed)
    body = plain(text).strip()
    own = re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)
    if own:
        rest = body[own.end():]
        head = "with recursive " if own.group(1) else "with "
        return head + (f"{ctes}, {rest}" if ctes else rest)
    return f"with {ctes} {body}" if ctes else body


def oracle_texts() -> dict[str, str]:
    return {name: _oracle_sql(q.oracle) for name, q in QUERIES.items() if q.oracle}
