"""Filter trees, relation filters, storage aggregates, reports and validation."""

import datetime as dt

import pytest
from conftest import rows

from tillwright.operators import tables
from tillwright.operators.query import find_all, flatten_struct_columns, storage_aggregate
from tillwright.plans.reports import ReportError, execute_report


@pytest.fixture
def rel(cat):
    sp = cat.spark
    cat.register("users", sp.createDataFrame([("u1", "John", 30.0), ("u2", "Jane", 25.0), ("u3", "Jack", 40.0)],
                                             "id string, name string, age double"), order_key=("id",))
    cat.register("tags", sp.createDataFrame([("t1", "tech"), ("t2", "food")], "id string, name string"),
                 order_key=("id",))
    posts = sp.createDataFrame([
        ("p1", "Tech News", "u1", ["t1"]), ("p2", "Tech Review", "u1", ["t1", "t2"]),
        ("p3", "Tech Tips", "u2", ["t1"]), ("p4", "Cooking Recipe", "u2", ["t2"])],
        "id string, title string, authorId string, tagIds array<string>")
    cat.register("posts", posts, order_key=("id",), relations={"authorId": ("users", False), "tagIds": ("tags", True)})
    return cat


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filter_tree_edge_cases(rel):
    assert ids(find_all(rel, "users", {})) == ["u1", "u2", "u3"]
    assert ids(find_all(rel, "users", {"and": []})) == ["u1", "u2", "u3"]
    assert ids(find_all(rel, "users", {"or": []})) == []
    # siblings of and/or are ignored
    assert ids(find_all(rel, "users", {"or": [{"name": {"eq": "Jane"}}], "age": {"gt": 100}})) == ["u2"]
    # two operators in one object: only the first in chain order (gt) applies
    assert ids(find_all(rel, "users", {"age": {"lt": 26, "gt": 29}})) == ["u1", "u3"]
    assert ids(find_all(rel, "users", {"age": {"nin": [30]}})) == ["u2", "u3"]
    assert ids(find_all(rel, "users", {"name": {"gt": 1}})) == []


def test_relation_filters(rel):
    assert ids(find_all(rel, "posts", {"authorId": {"name": {"eq": "John"}}})) == ["p1", "p2"]
    assert ids(find_all(rel, "posts", {"tagIds": {"name": {"eq": "food"}}})) == ["p2", "p4"]
    assert ids(find_all(rel, "users", {"posts": {"some": True}})) == ["u1", "u2"]
    assert ids(find_all(rel, "users", {"posts": {"none": True}})) == ["u3"]
    assert ids(find_all(rel, "users", {"posts": {"every": {"title": {"contains": "Tech"}}}})) == ["u1", "u3"]
    assert ids(find_all(rel, "users", {"or": [{"posts": {"some": {"title": {"startsWith": "Cook"}}}},
                                              {"age": {"gte": 40}}]})) == ["u2", "u3"]


def test_date_operators(cat):
    df = cat.spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 6, 1)),
                                    ("c", None)], "id string, at timestamp")
    cat.register("d", df, order_key=("id",))
    assert ids(find_all(cat, "d", {"at": {"between": ["2024-01-01", "2024-01-31"]}})) == ["a"]
    assert ids(find_all(cat, "d", {"at": {"after": "2024-01-01"}})) == ["b"]
    assert ids(find_all(cat, "d", {"id": {"before": "2024-01-01"}})) == []


def _users(cat):
    df = cat.spark.createDataFrame([("1", "John", 30.0, "US", 100.0), ("2", "Jane", 40.0, "US", 80.0),
                                    ("3", "Jack", 25.0, "UK", 90.0)],
                                   "id string, name string, age double, country string, score double")
    cat.register("users", df, order_key=("id",))


def test_storage_aggregate(cat):
    _users(cat)
    out = storage_aggregate(cat, "users", {"groupBy": ["country"], "select": {
        "country": True, "_count": True, "age": {"avg": True, "max": True}, "score": {"sum": True}}})
    got = {r["country"]: (r["_count"], r["age"]["avg"], r["age"]["max"], r["score"]["sum"]) for r in out.collect()}
    assert got == {"US": (2, 35.0, 40.0, 180.0), "UK": (1, 25.0, 25.0, 90.0)}
    hv = storage_aggregate(cat, "users", {"groupBy": ["country"], "select": {"country": True, "age": {"avg": True}},
                                          "having": {"age": {"avg": {"gt": 30}}}})
    assert [r["country"] for r in hv.collect()] == ["US"]
    dropped = storage_aggregate(cat, "users", {"groupBy": ["country"], "select": {"country": True},
                                               "having": {"age": {"avg": {"gt": 0}}}})
    assert dropped.count() == 0  # having on an un-aggregated field drops every group


def test_storage_aggregate_empty_is_zero(cat):
    cat.register("users", cat.spark.createDataFrame([], "id string, age double"), order_key=("id",))
    out = flatten_struct_columns(storage_aggregate(cat, "users", {"select": {
        "_count": True, "age": {"sum": True, "avg": True}}}))
    assert rows(out, "_count", "age_sum", "age_avg") == [(0, 0.0, 0.0)]


def test_reports(cat):
    prof = cat.spark.createDataFrame([("p1", ("test@example.com", "Test User"))],
                                     "id string, profile struct<email:string,name:string>")
    cat.register("profiles", prof, order_key=("id",))
    r = execute_report(cat, {"id": "r", "collection": "profiles", "columns": [
        {"field": "profile.email", "label": "Email"}, {"field": "profile.name", "label": "Name"}]})
    assert r.data.columns == ["profile.email", "profile.name"]
    assert r.metadata()["rowCount"] == 1 and r.metadata()["truncated"] is False
    cat.register("many", cat.spark.range(10).withColumnRenamed("id", "k"), order_key=("k",))
    r2 = execute_report(cat, {"id": "r2", "collection": "many", "limit": 3})
    assert r2.metadata()["truncated"] is True and [x["k"] for x in r2.data.collect()] == [0, 1, 2]
    with pytest.raises(ReportError):
        execute_report(cat, {"id": "r3", "collection": "nope"})
    with pytest.raises(ReportError):
        execute_report(cat, {"id": "r4", "collection": "many", "status": "archived"})


def test_validation_message(spark):
    schema = {"type": "object", "properties": {"id": {"type": "string", "nullable": True}, "name": {"type": "string"},
                                               "value": {"type": "number", "minimum": 1}},
              "required": ["name", "value"], "additionalProperties": False}
    df = spark.createDataFrame([(None, "test", -1.0), ("x", "ok", 2.0)], "id string, name string, value double")
    ok, bad = tables.split_valid(df, schema)
    assert ok.count() == 1
    assert [r["error"] for r in bad.collect()] == ["data/value must be >= 1"]


def test_insert_replace_patch_delete(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, v string, x double")
    batch = spark.createDataFrame([(2, "dup", 0.0, 1), (3, "new", 3.0, 2), (3, "again", 3.0, 3)],
                                  "k long, v string, x double, ord int")
    out, rej = tables.insert(t, batch, "k", order_key=("ord",))
    assert sorted((r["k"], r["reason"]) for r in rej.collect()) == [(2, "already exists"), (3, "duplicate key in batch")]
    assert out.count() == 3
    rep, unknown = tables.replace(t, spark.createDataFrame([(1, "A", 9.0), (7, "?", 0.0)], t.schema), "k")
    assert sorted((r["k"], r["v"]) for r in rep.collect()) == [(1, "A"), (2, "b")]
    assert [r["k"] for r in unknown.collect()] == [7]
    pt = tables.patch(t, spark.createDataFrame([(2, None)], "k long, x double"), "k")
    assert sorted((r["k"], r["v"], r["x"]) for r in pt.collect()) == [(1, "a", 1.0), (2, "b", None)]
    rem, report = tables.delete(t, spark.createDataFrame([(1,), (5,)], "k long"), "k")
    assert [r["k"] for r in rem.collect()] == [2]
    assert sorted((r["k"], r["existed"]) for r in report.collect()) == [(1, True), (5, False)]


def test_validation_keywords(spark):
    schema = {"type": "object", "required": ["code"], "additionalProperties": False, "properties": {
        "code": {"type": "string", "minLength": 3, "maxLength": 5, "pattern": "^[A-Z]+$"},
        "kind": {"type": "string", "enum": ["a", "b"]},
        "n": {"type": "integer", "exclusiveMinimum": 0, "maximum": 10},
        "tags": {"type": "array", "items": {"type": "string"}},
        "nums": {"type": "array", "items": {"type": "string"}}}}
    df = spark.createDataFrame([
        ("ABC", "a", 5.0, ["x"], [], None),       # valid (empty array has no wrong item)
        ("AB", "a", 5.0, None, None, None),       # too short
        ("ABCDEF", "a", 5.0, None, None, None),   # too long
        ("abc", "a", 5.0, None, None, None),      # pattern
        ("ABC", "c", 5.0, None, None, None),      # enum
        ("ABC", "a", 2.5, None, None, None),      # integer
        ("ABC", "a", 0.0, None, None, None),      # exclusiveMinimum
        ("ABC", "a", 11.0, None, None, None),     # maximum
        (None, "a", 1.0, None, None, None),       # required
        ("ABC", "a", 1.0, None, [1], None),       # items type
        ("ABC", "a", 1.0, None, None, "extra"),   # additional property
    ], "code string, kind string, n double, tags array<string>, nums array<int>, other string")
    got = [r["error"] for r in tables.validate(df, schema).collect()]
    assert got == [None,
                   "data/code must NOT have fewer than 3 characters",
                   "data/code must NOT have more than 5 characters",
                   'data/code must match pattern "^[A-Z]+$"',
                   "data/kind must be equal to one of the allowed values",
                   "data/n must be integer",
                   "data/n must be > 0",
                   "data/n must be <= 10",
                   "data must have required property 'code'",
                   "data/nums/0 must be string",
                   "data must NOT have additional properties"]
