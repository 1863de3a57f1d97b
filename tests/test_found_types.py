import pytest

from lakewright.operators.quality import compare_schema, found_types, table_problems

CASES = [
    (["1", "-128", None], "tinyint"), (["1", "128"], "smallint"), (["40000"], "int"), (["3000000000"], "bigint"),
    (["99999999999999999999"], "decimal(20,0)"), (["1.50", "007"], "decimal(2,1)"), (["0.00"], "decimal(1,0)"),
    (["1e3", "2.5"], "double"), (["9" * 39], "double"), (["2024-02-29"], "date"), (["2023-02-29"], "string"),
    (["2024-02-29", "2024-02-29 10:00"], "timestamp"), (["2024-02-29T25:00:00"], "string"), (["TRUE", "false"], "boolean"),
    (["true", "1"], "string"), ([None, None], "void"), ([""], "string"), ([" 1"], "string"), (["NaN"], "string"), (["1", "x"], "string")]


def test_narrowest_type(spark):
    rows = [(f"f{i:02d}", v) for i, (values, _) in enumerate(CASES) for v in values]
    got = found_types(spark.createDataFrame(rows, "file string, a string"), ["a"], "file")
    assert [r.column_type for r in got.orderBy("file").collect()] == [kind for _, kind in CASES]


def test_no_rows(spark):
    assert found_types(spark.createDataFrame([], "file string, a string"), ["a"], "file").count() == 0


@pytest.mark.parametrize("values, wanted, fits", [
    (["12.5"], "decimal(3,1)", True), (["12.5"], "decimal(2,1)", False), (["12.55"], "decimal(9,1)", False),
    (["5"], "decimal(3,2)", True), (["50"], "decimal(3,2)", False), (["5"], "bigint", True), (["3000000000"], "int", False),
    (["3000000000"], "double", True), (["9007199254740993"], "double", False), (["2024-01-01"], "timestamp_ntz", True),
    (["2024-01-01 01:00:00"], "date", False), ([None], "date", True), (["x"], "string", True), (["1.5"], "bigint", False)])
def test_found_types_against_a_declaration(spark, values, wanted, fits):
    found = found_types(spark.createDataFrame([("f", v) for v in values], "file string, a string"), ["a"], "file")
    assert compare_schema(found, [("a", wanted)], "file").isEmpty() == fits


def test_declared_types_against_the_table(spark):
    found = found_types(spark.createDataFrame([("f", "1", "2", "3")], "file string, a string, b string, c string"), ["a", "b", "c"], "file")
    declared = [("a", "bigint"), ("b", "decimal(10,2)"), ("c", "int")]
    table = [("a", "int"), ("b", "decimal(12,2)"), ("z", "int")]
    got = compare_schema(found, declared, "file", table).collect()
    assert [tuple(r) for r in got] == [("f", "a", "type bigint does not fit int of the table")]
    assert table_problems(declared, table) == ["column a: bigint does not fit int"]


def test_a_value_is_matched_once_whatever_the_number_of_columns(spark):
    names = [f"c{i}" for i in range(6)]
    raw = spark.createDataFrame([("f", *"123456")], "file string, " + ", ".join(f"{c} string" for c in names))

    def matches(columns):
        return found_types(raw, columns, "file")._jdf.queryExecution().optimizedPlan().toString().lower().count("rlike")

    assert matches(names) == matches(names[:1])
    assert [(r.column_name, r.column_type) for r in found_types(raw, names, "file").orderBy("column_name").collect()] == [(c, "tinyint") for c in names]


def test_forms_with_an_edge(spark):
    cases = [(["+5", "-0"], "tinyint"), (["5\n"], "tinyint"), (["9223372036854775808"], "decimal(19,0)"), (["-32768"], "smallint"), (["32768"], "int"),
             (["-2147483649"], "bigint"), ([".5"], "double"), (["5."], "double"), (["true", None], "boolean"), (["2024-01-01 10:30:00.1234567"], "string"),
             (["10000000000000000000000000000000000000000.5"], "double"), (["2024-01-01", "1"], "string")]
    rows = [(f"f{i:02d}", v) for i, (values, _) in enumerate(cases) for v in values]
    got = found_types(spark.createDataFrame(rows, "file string, a string"), ["a"], "file").orderBy("file").collect()
    assert [r.column_type for r in got] == [kind for _, kind in cases]
