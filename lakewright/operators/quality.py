"""Data tests over staged rows, quarantine, and checks of declared schemas."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import DECLARED_TYPES
from ..session import cut_lineage
from .keys import absent

FAILED = "_failed_tests"


@dataclass(frozen=True)
class Test:
    """A named test: a row predicate, or a verdict per key that is joined in."""

    __test__ = False  # not a pytest class

    name: str
    columns: tuple[str, ...]
    failing: Column | None = None
    kind: str = "row"
    parent: DataFrame | None = field(default=None, compare=False)
    parent_column: str | None = None


def not_null(column: str) -> Test:
    return Test(f"not_null_{column}", (column,), F.col(column).isNull())


def accepted_values(column: str, values: Sequence) -> Test:
    """NULL passes; `not_null` is the test for that."""
    return Test(f"accepted_values_{column}", (column,),
                F.col(column).isNotNull() & ~F.col(column).isin(list(values)))


def expression(sql: str, name: str, columns: Sequence[str] = ()) -> Test:
    """Rows for which the predicate is false fail; an unknown result passes."""
    return Test(f"expression_{name}", tuple(columns), ~F.coalesce(F.expr(sql), F.lit(True)))


def unique(*columns: str, scope: Sequence[str] = ()) -> Test:
    """Every row of a key that occurs more than once fails; keys with NULL pass.

    `scope` names columns within whose values the key has to be unique.
    """
    return Test("unique_" + "_".join(columns), (*scope, *columns), kind="unique")


def relationships(column: str, parent: DataFrame, parent_column: str) -> Test:
    """Rows whose key has no parent fail; NULL passes."""
    return Test(f"relationships_{column}", (column,), kind="relationships",
                parent=parent, parent_column=parent_column)


def _bad_keys(df: DataFrame, test: Test) -> DataFrame:
    """Failing keys of a unique or relationship test, one row each.

    Keys are aggregated before they are shuffled or joined, so a key that holds
    a large share of the rows counts as one row per input partition.
    """
    present = df.dropna(subset=list(test.columns)).groupBy(*test.columns).agg(F.count("*").alias("_n"))
    if test.kind == "unique":
        return present.where(F.col("_n") > 1).select(*test.columns)
    parents = test.parent.select(F.col(test.parent_column).alias(test.columns[0]))
    return absent(present.select(*test.columns), parents, test.columns)


def failing_rows(df: DataFrame, test: Test) -> DataFrame:
    """The rows of `df` that fail one test."""
    if test.failing is not None:
        return df.where(test.failing)
    return df.join(_bad_keys(df, test), list(test.columns), "left_semi")


def orphan_keys(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child keys without a parent and the rows that carry them."""
    present = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("failing_rows"))
    return absent(present, parent.select(F.col(parent_column).alias(column)), [column])


def tag_failures(staged: DataFrame, tests: Sequence[Test]) -> DataFrame:
    """Add `_failed_tests`, the names of the tests each row fails.

    Row tests are columns of one projection; each key test adds one join with
    its failing keys, which are few unless the file is broken. They are written
    first: their size is known then, and where it is small the rows
    are neither shuffled nor sorted, so a task holds keys and no rows.
    """
    rows, flags = staged, []
    for i, test in enumerate(tests):
        if test.failing is not None:
            flags.append(F.when(test.failing, F.lit(test.name)))
            continue
        marks = cut_lineage(_bad_keys(staged, test), "failing_keys").select(
            *[F.col(c).alias(f"_k{i}_{c}") for c in test.columns], F.lit(True).alias(f"_bad{i}"))
        match = [rows[c] == marks[f"_k{i}_{c}"] for c in test.columns]
        rows = rows.join(marks, match, "left")
        flags.append(F.when(F.col(f"_bad{i}"), F.lit(test.name)))
    return rows.withColumn(FAILED, F.array_compact(F.array(*flags))).select(*staged.columns, FAILED)


def failure_counts(tested: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(`test`, `failing_rows`) for every test, also those nothing fails; one pass over the rows."""
    counted = tested.groupBy(*by).agg(*[
        F.count_if(F.array_contains(FAILED, name)).alias(f"_t{i}") for i, name in enumerate(names)])
    pairs = F.array(*[
        F.struct(F.lit(name).alias("test"), F.col(f"_t{i}").alias("failing_rows"))
        for i, name in enumerate(names)])
    return counted.select(*by, F.inline(pairs))


def run_tests(staged: DataFrame, tests: Sequence[Test]) -> tuple[DataFrame, DataFrame]:
    """(rows with `_failed_tests`, result per test with `success` and `error_message`)."""
    tested = tag_failures(staged, tests)
    results = failure_counts(tested, [t.name for t in tests]).select(
        "test", "failing_rows",
        (F.col("failing_rows") == 0).alias("success"),
        F.when(F.col("failing_rows") > 0,
               F.concat(F.lit("got "), F.col("failing_rows").cast("string"),
                        F.lit(" failing rows, expected 0"))).alias("error_message"),
    )
    return tested, results


def quarantine(tested: DataFrame, entry: Sequence[str] = ("file_path",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean rows, review rows, entries that get a ledger row of their own with their row count)."""
    failed = F.size(FAILED) > 0
    review = tested.where(failed)
    return (
        tested.where(~failed).drop(FAILED),
        review,
        review.groupBy(*entry).agg(F.count("*").alias("rows_read")),
    )


# --- casts -------------------------------------------------------------------

def cast_columns(raw: DataFrame, types: Sequence[tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """Text columns to their declared types; what does not fit becomes NULL."""
    return raw.select(*keep, *[F.expr(f"try_cast(`{c}` as {t})").alias(c) for c, t in types])


def uncastable(raw: DataFrame, types: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Per column the number of values that are present and do not fit the declared type."""
    lost = raw.groupBy(*by).agg(*[
        F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as {t})").isNull()).alias(f"_c{i}")
        for i, (c, t) in enumerate(types)])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_c{i}").alias("rows")) for i, (c, _) in enumerate(types)])
    return lost.select(*by, F.inline(pairs))


# --- schemas -----------------------------------------------------------------

# Type changes that lose nothing; every other change of type is an error.
WIDER = {
    "tinyint": ("smallint", "int", "bigint", "float", "double", "string"),
    "smallint": ("int", "bigint", "float", "double", "string"),
    "int": ("bigint", "double", "string"),
    "bigint": ("string",),
    "float": ("double", "string"),
    "double": ("string",),
    "boolean": ("string",),
    "date": ("timestamp", "string"),
    "timestamp": ("string",),
}


def widens(old: Column, new: Column) -> Column:
    pairs = [(a, b) for a, targets in WIDER.items() for b in targets]
    return reduce(or_, [(old == a) & (new == b) for a, b in pairs])


#: Texts that are numbers, days and times, without their range.
WHOLE, FRACTION = r"^[+-]?[0-9]+$", r"^[+-]?[0-9]+([.][0-9]+)?$"
FLOATING = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DAY, TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?$"


def found_types(raw: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """(`by`, column_name, column_type, digits, scale): the narrowest type that holds all texts of a column, per file.

    One aggregate over a lattice of types: tinyint, smallint, int, bigint,
    decimal(p,s), double; date, timestamp; boolean; string, which holds
    everything; void, where all values are NULL. `digits` before and `scale`
    behind the point are the most that any number needs. Every value is a row
    of its own, whose types are bits of one number: the code for a row
    stays short, whatever the number of columns.
    """
    values = raw.select(by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("_v")) for c in columns])))
    v = F.col("_v")
    # Whole numbers are fractions, and those are floating; the other forms exclude each other.
    form = (
        F.when(v.rlike(WHOLE), "whole").when(v.rlike(FRACTION), "fraction").when(v.rlike(FLOATING), "floating")
        .when(F.lower(v).isin("true", "false"), "boolean").when(v.rlike(DAY), "day").when(v.rlike(TIME), "time"))
    formed = values.withColumn("_form", form).withColumn(
        "_n", F.when(F.col("_form") == "whole", v.try_cast("bigint")))
    form, n = F.col("_form"), F.col("_n")
    number = _held("decimal", "double")
    held = (
        F.when(v.isNull(), None).when(form == "whole", F.when(n.between(-2**7, 2**7 - 1), number + _held("tinyint", "smallint", "int", "bigint"))
               .when(n.between(-2**15, 2**15 - 1), number + _held("smallint", "int", "bigint"))
               .when(n.between(-2**31, 2**31 - 1), number + _held("int", "bigint"))
               .when(n.isNotNull(), number + _held("bigint")).otherwise(number))
        .when(form == "fraction", number).when(form == "floating", _held("double")).when(form == "boolean", _held("boolean"))
        .when((form == "day") & v.try_cast("date").isNotNull(), _held("date", "timestamp"))
        .when((form == "time") & v.try_cast("timestamp_ntz").isNotNull(), _held("timestamp")).otherwise(0))
    exact = form.isin("whole", "fraction")
    before = F.length(F.regexp_replace(F.split_part(v, F.lit("."), F.lit(1)), "^[+-]?0*", ""))
    behind = F.when(form == "whole", 0).otherwise(F.length(F.regexp_replace(F.split_part(v, F.lit("."), F.lit(2)), "0+$", "")))
    # bit_and leaves NULL out, so a type holds a column if it holds every value that is there.
    seen = formed.groupBy(by, "column_name").agg(
        F.bit_and(held).alias("_held"), F.max(F.when(exact, before)).alias("digits"), F.max(F.when(exact, behind)).alias("scale"))
    digits = F.greatest(F.col("digits") + F.col("scale"), F.lit(1))
    held, kind = F.col("_held"), F.when(F.col("_held").isNull(), F.lit("void"))
    for name in ("boolean", "tinyint", "smallint", "int", "bigint"):
        kind = kind.when(held.bitwiseAND(_held(name)) > 0, F.lit(name))
    kind = (
        kind.when((held.bitwiseAND(_held("decimal")) > 0) & (digits <= 38), F.format_string("decimal(%d,%d)", digits, F.col("scale")))
        .when(held.bitwiseAND(_held("double")) > 0, F.lit("double")).when(held.bitwiseAND(_held("date")) > 0, F.lit("date"))
        .when(held.bitwiseAND(_held("timestamp")) > 0, F.lit("timestamp")).otherwise(F.lit("string")))
    numeric = kind.rlike("int$|^decimal")
    return seen.select(by, "column_name", kind.alias("column_type"),
                       F.when(numeric, F.col("digits")).alias("digits"), F.when(numeric, F.col("scale")).alias("scale"))


#: Types that hold a text, a bit each.
_BITS = ("boolean", "tinyint", "smallint", "int", "bigint", "decimal", "double", "date", "timestamp")


def _held(*kinds: str) -> Column:
    return F.lit(sum(1 << _BITS.index(k) for k in kinds))


def fits(found: Column, digits: Column, scale: Column, wanted: Column) -> Column:
    """Whether every value of a found type is one of the wanted type; numbers go by the digits they need."""
    precision = F.regexp_extract(wanted, r"^decimal\((\d+)", 1).try_cast("int")
    places = F.regexp_extract(wanted, r",\s*(\d+)\)$", 1).try_cast("int")
    return (
        F.when((found == "void") | (found == wanted) | (wanted == "string"), True)
        .when(wanted.startswith("decimal") & digits.isNotNull(), (digits <= precision - places) & (scale <= places))
        # A double keeps 15 digits of any number.
        .when((wanted == "double") & digits.isNotNull(), digits + scale <= 15)
        .when((found == "timestamp") & (wanted == "timestamp_ntz"), True)
        .when((found == "date") & (wanted == "timestamp_ntz"), True)
        .otherwise(widens(found, wanted)))


def compare_schema(found: DataFrame, declared: Sequence[tuple[str, str]], by: str,
                   table: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Differences between columns found per file (`by`, column_name, column_type) and a declaration.

    An undeclared column stops ingestion until the declaration is updated. A
    type may widen towards the declared one and must not narrow. With a column
    `position` (from 0) the order has to agree too. Every file is compared as a
    whole: it loses no column to a reader that skips what it does not know.

    `found` may come from `found_types`; then numbers go by the digits that
    their values need. `table` is the schema of the existing table: a declared
    type that does not fit it is a problem of every file that has the column.
    """
    wanted = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).alias("t")) for c, t in declared])
    names = F.array(*[F.lit(c) for c, _ in declared])
    declared_type = F.get(F.filter(wanted, lambda w: w["c"] == F.col("column_name")), F.lit(0))["t"]
    declared_at = F.array_position(names, F.col("column_name")) - 1
    moved = F.col("position") != declared_at if "position" in found.columns else F.lit(False)
    sized = [c for c in ("digits", "scale") if c in found.columns]
    typed = found.select(
        by, "column_name", "column_type", *sized, declared_type.alias("_want"), moved.alias("_moved"))
    kind, want = F.col("column_type"), F.col("_want")
    same = fits(kind, F.col("digits"), F.col("scale"), want) if sized else (kind == want) | widens(kind, want)
    refused = unlike_table(declared, table)
    kept = F.try_element_at(F.create_map(*[F.lit(x) for pair in refused.items() for x in pair]), F.col("column_name")) if refused else F.lit(None)
    problem = (
        F.when(want.isNull(), F.lit("not declared"))
        .when(~same, F.concat(F.lit("type "), kind, F.lit(" does not fit "), want))
        .when(kept.isNotNull(), F.concat(F.lit("type "), want, F.lit(" does not fit "), kept, F.lit(" of the table")))
        .when(F.col("_moved"), F.lit("out of order"))
    )
    present = typed.select(by, "column_name", problem.alias("problem")).where(F.col("problem").isNotNull())
    # Declared names seen per file: at most one flag per declared column, whatever the file holds.
    seen = found.groupBy(by).agg(*[
        F.bool_or(F.col("column_name") == c).alias(f"_s{i}") for i, (c, _) in enumerate(declared)])
    absent = seen.select(by, F.explode(F.array_compact(F.array(*[
        F.when(~F.col(f"_s{i}"), F.get(names, F.lit(i))) for i in range(len(declared))]))).alias("column_name"))
    return present.unionByName(absent.select(by, "column_name", F.lit("missing").alias("problem")))


class SchemaMismatch(ValueError):
    """A declaration does not hold what its table has."""


def table_problems(declared: Sequence[tuple[str, str]], existing: Sequence[tuple[str, str]]) -> list[str]:
    """What keeps a declaration from being loaded into a table: a declared type that is not the table's and does not widen to it.

    Columns that only one side has are no problem: the table takes new ones, and keeps old ones as NULL.
    """
    known = dict(declared)
    return [f"column {name}: {known[name]} does not fit {kept}" for name, kept in unlike_table(declared, existing).items()]


def unlike_table(declared: Sequence[tuple[str, str]], existing: Sequence[tuple[str, str]]) -> dict[str, str]:
    """Declared columns whose type does not fit the table's, with the table's type."""
    known = dict(existing)
    return {name: known[name] for name, kind in declared
            if name in known and kind != known[name] and known[name] not in WIDER.get(kind, ())
            and not _within(kind, known[name])}


def _within(kind: str, wider: str) -> bool:
    """Whether one decimal type holds another."""
    sizes = [re.fullmatch(r"decimal\((\d+), ?(\d+)\)", t) for t in (kind, wider)]
    if None in sizes:
        return False
    (p, s), (q, t) = [(int(m[1]), int(m[2])) for m in sizes]
    return t >= s and q - t >= p - s


#: Column types of table declarations; settings declarations use the words of DECLARED_TYPES.
COLUMN_TYPE = (r"(tinyint|smallint|int|bigint|float|double|boolean|string|binary|date|timestamp|timestamp_ntz"
               r"|decimal\(\d+, ?\d+\)|(array|map|struct)<.+>)")


def check_declarations(spec_rows: DataFrame) -> DataFrame:
    """All problems of declared columns (source, table_name, column_name, type, max_length, min_value, accepted)."""
    kind = F.col("type")
    nameless = F.col("column_name").isNull() | (F.col("column_name") == "")
    rules = [
        F.when(nameless, "no column name"),
        F.when(kind.isNull() | ~(kind.isin(*DECLARED_TYPES) | kind.rlike(f"^{COLUMN_TYPE}$")), "unknown type"),
        F.when(F.col("max_length") < 0, "negative length"),
        F.when(F.col("max_length").isNotNull() & ~kind.isin("str", "string"), "length on a type other than str"),
        F.when(F.col("min_value").isNotNull() & ~kind.rlike(r"^(num|int|tinyint|smallint|bigint|float|double|decimal\(.*)$"), "minimum on a type that is not a number"),
        F.when((kind == "enum") & (F.coalesce(F.col("accepted"), F.lit("")) == ""), "enum without values"),
    ]
    by = ["source", "table_name", "column_name"]
    single = spec_rows.select(*by, F.explode(F.array_compact(F.array(*rules))).alias("problem"))
    repeated = (
        spec_rows.where(~nameless).groupBy(*by).count().where(F.col("count") > 1)
        .select(*by, F.lit("declared more than once").alias("problem"))
    )
    return single.unionByName(repeated)
