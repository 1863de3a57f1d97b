"""Declared tables: columns, tests, keys and load mode."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import quality


class UnknownTable(KeyError):
    """No declaration for a table."""


@dataclass(frozen=True)
class TableSpec:
    source: str
    table: str
    columns: tuple[tuple[str, str], ...]
    tests: tuple[tuple[str, object], ...] = ()
    keys: tuple[str, ...] = ()
    load: str = "append"

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.columns]

    def build_tests(self, parents: Mapping[str, DataFrame] | None = None,
                    scope: Sequence[str] = ()) -> list[quality.Test]:
        """Column tests as declared; `scope` narrows uniqueness, for example to one file.

        Relationship tests need their parent in `parents`.
        """
        parents = parents or {}
        built = []
        for column, test in self.tests:
            if test == "not_null":
                built.append(quality.not_null(column))
            elif test == "unique":
                built.append(quality.unique(column, scope=scope))
            elif "accepted_values" in test:
                built.append(quality.accepted_values(column, test["accepted_values"]))
            elif "expression" in test:
                built.append(quality.expression(test["expression"], test.get("name", column), (column,)))
            elif "relationships" in test:
                to = test["relationships"]
                built.append(quality.relationships(column, parents[to["to"]], to["field"]))
            else:
                raise ValueError(f"unknown test {test!r} on {column}")
        return built


#: What a table and a column may declare. The rules of a column (`required` to `enum`) become tests of its rows;
#: a column that is only an `include` stands for the columns of that fragment.
TABLE_WORDS = ("columns", "keys", "load")
COLUMN_WORDS = ("name", "type", "tests", "description", "required", "min", "max_length", "enum", "include")
NUMBER = re.compile(r"(tinyint|smallint|int|bigint|float|double|decimal\(.*\))")


class EndlessFragment(ValueError):
    """Fragments of columns that include each other."""


def included(columns: Sequence[Mapping], fragments: Mapping[str, Sequence[Mapping]], within: tuple[str, ...] = ()) -> list[Mapping]:
    """The columns with those of fragments in place of includes, at any depth; an unknown fragment stays as it is."""
    out: list[Mapping] = []
    for column in columns:
        name = column.get("include")
        if name in within:
            raise EndlessFragment(" includes ".join([*within[within.index(name):], name]))
        if name in fragments:
            out += included(fragments[name], fragments, (*within, name))
        else:
            out.append(column)
    return out


def rule_tests(column: Mapping) -> list:
    """The tests that a column's rules stand for."""
    name, tests = column["name"], []
    if column.get("required") and "not_null" not in column.get("tests", ()):
        tests.append("not_null")
    if "min" in column:
        tests.append({"expression": f"`{name}` >= {column['min']}", "name": f"min_{name}"})
    if "max_length" in column:
        tests.append({"expression": f"length(`{name}`) <= {column['max_length']}", "name": f"max_length_{name}"})
    if "enum" in column:
        tests.append({"accepted_values": list(column["enum"])})
    return tests


def rule_problems(column: Mapping) -> list[str]:
    """What is wrong with the rules of one column."""
    kind = str(column.get("type", ""))
    return [text for wrong, text in (
        ("required" in column and not isinstance(column["required"], bool), "required is neither true nor false"),
        ("min" in column and not (isinstance(column["min"], int | float) and not isinstance(column["min"], bool)), "minimum is not a number"),
        ("min" in column and not NUMBER.fullmatch(kind), "minimum on a type that is not a number"),
        ("max_length" in column and not (isinstance(column["max_length"], int) and column["max_length"] >= 0), "length is not a whole number from 0"),
        ("max_length" in column and kind != "string", "length on a type other than string"),
        ("enum" in column and not column["enum"], "enum without values")) if wrong]


def declaration_problems(declared: Mapping) -> list[str]:
    """Everything that is wrong with a source's declaration, before any of it is used."""
    problems = [f"no {word}" for word in ("source", "tables") if not declared.get(word)]
    fragments = declared.get("fragments") or {}
    for table, body in (declared.get("tables") or {}).items():
        try:
            columns = included(body.get("columns") or [], fragments)
        except EndlessFragment as endless:
            problems.append(f"{table}: include never ends: {endless}")
            continue
        problems += [f"{table}: include of an unknown fragment {c['include']}" for c in columns if "include" in c]
        columns = [c for c in columns if "include" not in c]
        names = [c.get("name") for c in columns]
        problems += [f"{table}: unknown word {w}" for w in body if w not in TABLE_WORDS]
        problems += [f"{table}: no columns"] * (not columns)
        problems += [f"{table}: load is neither append nor merge"] * (body.get("load", "append") not in ("append", "merge"))
        problems += [f"{table}: load by merge needs keys"] * (body.get("load") == "merge" and not body.get("keys"))
        problems += [f"{table}: column {n} is declared more than once" for n in sorted({str(n) for n in names if names.count(n) > 1})]
        problems += [f"{table}: key {k} is not a column" for k in body.get("keys", ()) if k not in names]
        for column in columns:
            name = column.get("name") or "?"
            problems += [f"{table}.{name}: unknown word {w}" for w in column if w not in COLUMN_WORDS]
            problems += [f"{table}.{name}: no name"] * (name == "?")
            problems += [f"{table}.{name}: {p}" for p in rule_problems(column)]
            if not re.fullmatch(quality.COLUMN_TYPE, str(column.get("type", ""))):
                problems.append(f"{table}.{name}: unknown type {column.get('type')}")
    return problems


def from_dict(declared: Mapping) -> dict[tuple[str, str], TableSpec]:
    """Specs of one source: {"source": ..., "fragments": {name: columns}, "tables": {name: {columns, keys, load}}}."""
    problems = declaration_problems(declared)
    if problems:
        raise ValueError("; ".join(problems))
    specs = {}
    for table, body in declared["tables"].items():
        columns = included(body["columns"], declared.get("fragments") or {})
        specs[(declared["source"], table)] = TableSpec(
            source=declared["source"],
            table=table,
            columns=tuple((c["name"], c["type"]) for c in columns),
            tests=tuple((c["name"], t) for c in columns for t in [*c.get("tests", []), *rule_tests(c)]),
            keys=tuple(body.get("keys", ())),
            load=body.get("load", "append"),
        )
    return specs


def get_spec(specs: Mapping[tuple[str, str], TableSpec], source: str, table: str) -> TableSpec:
    try:
        return specs[(source, table)]
    except KeyError:
        raise UnknownTable(f"table '{table}' is not declared for source '{source}'") from None


ORDERS = {
    "source": "sales",
    "tables": {
        "orders": {
            "load": "merge",
            "keys": ["o_orderkey"],
            "columns": [
                {"name": "o_orderkey", "type": "bigint", "tests": ["not_null", "unique"]},
                {"name": "o_custkey", "type": "bigint",
                 "tests": ["not_null", {"relationships": {"to": "customer", "field": "c_custkey"}}]},
                {"name": "o_orderstatus", "type": "string", "tests": [{"accepted_values": ["F", "O", "P"]}]},
                {"name": "o_totalprice", "type": "decimal(18,2)",
                 "tests": ["not_null", {"expression": "o_totalprice >= 0"}]},
                {"name": "o_orderdate", "type": "date"},
                {"name": "o_orderpriority", "type": "string"},
            ],
        },
    },
}
