import json

import pytest

from lakewright.operators import declarations
from lakewright.operators.declarations import RULE, EndlessInclude, check_documents, check_rules, endless_owners, resolve
from lakewright.session import cut_lineage


def rule(owner, path, kind, required=False, max_length=None, min_value=None, accepted=None, include=None):
    return (owner, path, kind, required, max_length, min_value, accepted, include)


RULES = [
    rule("root", "name", "str", True, max_length=5), rule("root", "size", "int", min_value=1), rule("root", "tier", "enum", accepted=["a", "b"]),
    rule("root", "net", "map", True), rule("root", "net.ip", "ip", True), rule("root", "net.open", "bool"),
    rule("root", "people", "list"), rule("root", "people.*", "include", include="person"),
    rule("root", "tags", "map"), rule("root", "tags.*", "num"), rule("root", "free", "any"), rule("root", "none", "null"),
    rule("person", "mail", "str", True), rule("person", "phone", "include", include="phone"),
    rule("phone", "code", "int", True, min_value=1), rule("phone", "numbers", "list"), rule("phone", "numbers.*", "str", max_length=3)]


def problems(df):
    return sorted((r.path, r.problem) for r in df.collect())


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, RULE)


GOOD = {"name": "n", "size": 1, "tier": "a", "net": {"ip": "10.0.0.1/8", "open": True}, "free": {"x": [1, {"y": 2}]}, "none": None,
        "people": [{"mail": "m", "phone": {"code": 4, "numbers": ["123", "4"]}}, {"mail": "m"}], "tags": {"x": 1, "y.z": 2.5}}


def judged(spark, rules, *bodies):
    docs = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    return check_documents(docs, "body", "id", resolve(rules, "root"))


def test_resolved_paths(rules):
    paths = {r.path: r.type for r in resolve(rules, "root").collect()}
    assert paths["people.*"] == paths["people.*.phone"] == "map"
    assert paths["people.*.phone.numbers.*"] == "str"
    assert "include" not in paths.values() and len(paths) == 17


def test_a_good_document_has_no_problem(spark, rules):
    assert problems(judged(spark, rules, json.dumps(GOOD), json.dumps({"name": "n", "net": {"ip": "::1"}, "people": [], "tags": {}}))) == []


def test_every_rule_at_every_depth(spark, rules):
    bad = {"name": "sixsix", "size": 0, "tier": "c", "net": {"ip": "here", "open": "yes", "extra": 1}, "none": 1, "more": {"x": 1},
           "people": [{"phone": {"code": 0, "numbers": ["1234", 5]}}, "who", {"mail": None, "phone": {}}], "tags": {"x": "1", "y": [1]}}
    assert problems(judged(spark, rules, json.dumps(bad))) == sorted([
        ("name", "too long"), ("size", "below the minimum"), ("tier", "not an accepted value"), ("net.ip", "str instead of ip"),
        ("net.open", "str instead of bool"), ("net.extra", "not declared"), ("none", "int instead of null"), ("more", "not declared"),
        ("people.0.mail", "missing"), ("people.0.phone.code", "below the minimum"), ("people.0.phone.numbers.0", "too long"),
        ("people.0.phone.numbers.1", "int instead of str"), ("people.1", "str instead of map"), ("people.2.mail", "missing"),
        ("people.2.phone.code", "missing"), ("tags.x", "str instead of num"), ("tags.y", "list instead of num")])


def test_what_is_not_a_document(spark, rules):
    got = judged(spark, rules, None, "", "{", "[1]", "null", "7", "{}")
    assert sorted((r.id, r.path, r.problem) for r in got.collect()) == [
        *[(i, "", "not a document") for i in range(6)], (6, "name", "missing"), (6, "net", "missing")]


def test_empty_tables(spark, rules):
    assert problems(judged(spark, rules)) == []
    none = spark.createDataFrame([], RULE)
    assert check_rules(none).isEmpty() and resolve(none, "root").isEmpty()
    docs = spark.createDataFrame([(1, '{"a": 1}')], "id int, body string")
    assert problems(check_documents(docs, "body", "id", resolve(none, "root"))) == []


def test_cycles_are_found_and_refused(spark):
    looped = spark.createDataFrame([
        rule("a", "x", "include", include="b"), rule("b", "y", "include", include="c"), rule("c", "z", "include", include="b"),
        rule("d", "w", "include", include="e"), rule("e", "v", "int"), rule("f", "self", "include", include="f")], RULE)
    assert sorted(r.owner for r in endless_owners(looped).collect()) == ["a", "b", "c", "f"]
    assert problems(check_rules(looped)) == sorted((p, "include never ends") for p in ("x", "y", "z", "self"))
    with pytest.raises(EndlessInclude):
        resolve(looped, "a")
    assert {r.path: r.type for r in resolve(looped, "d").collect()} == {"w": "map", "w.v": "int"}


def test_broken_rules(spark):
    rules = spark.createDataFrame([
        rule("r", "a", "int"), rule("r", "a.b", "int"), rule("r", "c.d", "str"), rule("r", "l", "list"), rule("r", "l.first", "int"),
        rule("r", "i", "include", include="gone"), rule("r", "j", "include"), rule("r", "e", "enum"), rule("r", "t", "thing"),
        rule("r", "twice", "int"), rule("r", "twice", "str"), rule("r", "n", "str", min_value=1), rule("r", "k", "int", max_length=-1)], RULE)
    assert problems(check_rules(rules)) == sorted([
        ("a.b", "its parent holds no fields"), ("c.d", "its parent is not declared"), ("l.first", "an element of a list has a name"),
        ("i", "include of an unknown fragment"), ("j", "include of an unknown fragment"), ("e", "enum without values"), ("t", "unknown type"),
        ("twice", "declared more than once"), ("n", "minimum on a type that is not a number"), ("k", "negative length"),
        ("k", "length on a type other than str")])


def test_documents_of_one_file_are_dealt_and_values_looked_at_once(spark, rules, monkeypatch):
    plans = []

    def stored(df, purpose="step"):
        plans.append((purpose, df._jdf.queryExecution().optimizedPlan().toString()))
        return cut_lineage(df, purpose)

    monkeypatch.setattr(declarations, "cut_lineage", stored)
    docs = spark.createDataFrame([(i, json.dumps(GOOD if i % 2 else {"name": "n"})) for i in range(40)], "id int, body string").coalesce(1)
    found = check_documents(docs, "body", "id", resolve(rules, "root"))
    assert {(r.path, r.problem) for r in found.collect()} == {("net", "missing")}
    nodes = [plan for purpose, plan in plans if purpose == "nodes"]
    assert "RepartitionByExpression [id" in nodes[0]
    assert all(plan.count("schema_of_variant") <= 2 for plan in nodes)
