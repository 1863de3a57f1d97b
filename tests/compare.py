"""Run registered queries beside their SQL in DuckDB: `python tests/compare.py [folder] [keys...]`."""

import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lakewright.catalogue import QUERIES, oracle_texts  # noqa: E402
from lakewright.catalogue.fixtures import BASE_TABLES  # noqa: E402
from lakewright.catalogue.registry import Tables  # noqa: E402
from lakewright.session import build_session  # noqa: E402


def duck(folder: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE"}


def compare(tables: Tables, con, name: str) -> str | None:
    """None when both agree, else what differs."""
    df = QUERIES[name].run(tables)
    rows = [tuple(r) for r in df.collect()]
    text = oracle_texts().get(name)
    if text is None:
        return None if rows else "no rows"
    result = con.execute(text)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    for column, kind in df.dtypes:
        want = KINDS.get(kind, kind.upper())
        if kinds[column].upper() != want:
            return f"type of {column}: {want} != {kinds[column]}"
    ours, theirs = canonical(df.columns, rows), canonical(columns, expected)
    if ours == theirs:
        return None if ours else "both empty"
    a, b = set(ours), set(theirs)
    return f"{len(ours)} rows != {len(theirs)}; only ours {list(a - b)[:2]}; only theirs {list(b - a)[:2]}"


def main(folder: str, names: list[str]) -> int:
    spark = build_session(master=os.environ.get("TEST_MASTER", "local[8]"), **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    tables, con, bad = Tables(spark, folder), duck(folder), 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            problem = compare(tables, con, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} of {len(names or QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) else 0)
