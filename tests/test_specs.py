import pytest

from lakewright.operators.quality import FAILED, run_tests
from lakewright.plans.specs import declaration_problems, from_dict

DECLARED = {
    "source": "s",
    "fragments": {
        "audit": [{"name": "by", "type": "string", "required": True, "max_length": 3}, {"include": "times"}],
        "times": [{"name": "at", "type": "date"}]},
    "tables": {"t": {"columns": [
        {"name": "id", "type": "bigint", "required": True, "min": 1, "tests": ["unique", {"expression": "id < 100"}]},
        {"name": "kind", "type": "string", "enum": ["a", "b"]}, {"include": "audit"}]}}}


def test_rules_and_fragments_become_columns_and_tests(spark):
    spec = from_dict(DECLARED)[("s", "t")]
    assert spec.columns == (("id", "bigint"), ("kind", "string"), ("by", "string"), ("at", "date"))
    rows = spark.createDataFrame(
        [(1, "a", "me", None), (0, "b", "me", None), (2, "c", "long", None), (None, None, None, None), (100, "a", "x", None)],
        "id bigint, kind string, by string, at date")
    tagged, results = run_tests(rows, spec.build_tests())
    failed = {r.id: sorted(r[FAILED]) for r in tagged.collect()}
    assert failed == {
        1: [], 0: ["expression_min_id"], 2: ["accepted_values_kind", "expression_max_length_by"],
        None: ["not_null_by", "not_null_id"], 100: ["expression_id"]}
    assert results.count() == len(spec.tests)


@pytest.mark.parametrize("change, problem", [
    ({"min": "x"}, "t.c: minimum is not a number"), ({"min": True}, "t.c: minimum is not a number"),
    ({"max_length": 3}, "t.c: length on a type other than string"), ({"enum": []}, "t.c: enum without values"),
    ({"required": "yes"}, "t.c: required is neither true nor false"),
    ({"type": "string", "min": 1}, "t.c: minimum on a type that is not a number"),
    ({"type": "string", "max_length": -1}, "t.c: length is not a whole number from 0")])
def test_broken_rules(change, problem):
    column = {"name": "c", "type": "int", **change}
    assert declaration_problems({"source": "s", "tables": {"t": {"columns": [column]}}}) == [problem]


def test_broken_includes():
    def problems(fragments):
        return declaration_problems({"source": "s", "fragments": fragments, "tables": {"t": {
            "columns": [{"name": "c", "type": "int"}, {"include": "a"}]}}})
    assert problems({}) == ["t: include of an unknown fragment a"]
    assert problems({"a": [{"include": "b"}], "b": [{"include": "a"}]}) == ["t: include never ends: a includes b includes a"]
    assert problems({"a": [{"include": "a"}]}) == ["t: include never ends: a includes a"]
    assert problems({"a": [{"name": "c", "type": "int"}]}) == ["t: column c is declared more than once"]
    assert problems({"a": []}) == []
