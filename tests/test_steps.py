"""Transform steps on the literal fixtures of the original tests."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillwright.operators.steps import run_step
from tillwright.plans.pipeline import PipelineError, run_pipeline


def reg(cat, name, data, schema, order=("ord",), id_col="id"):
    df = cat.spark.createDataFrame(data, schema)
    cat.register(name, df, order_key=order if "ord" in df.columns else (), id_col=id_col)


def test_filter_eq(cat):
    reg(cat, "users", [("1", "Alice", 25, "active", 1), ("2", "Bob", 35, "inactive", 2),
                       ("3", "Charlie", 45, "active", 3)], "id string, name string, age int, status string, ord int")
    out = run_step(cat, "filter", {"source": "users", "output": "o",
                                   "conditions": [{"field": "status", "operator": "eq", "value": "active"}]})
    assert out.df.count() == 2


def test_filter_empty_or_keeps_all_and_ne_null(cat):
    reg(cat, "t", [("1", None, 1), ("2", "x", 2), ("3", "y", 3)], "id string, v string, ord int")
    assert run_step(cat, "filter", {"source": "t", "output": "o", "conditions": [],
                                    "conditionLogic": "or"}).df.count() == 3
    ne = run_step(cat, "filter", {"source": "t", "output": "o2",
                                  "conditions": [{"field": "v", "operator": "ne", "value": "x"}]})
    assert rows(ne.df, "id") == [("1",), ("3",)]  # NULL ne "x" is true
    nin = run_step(cat, "filter", {"source": "t", "output": "o3",
                                   "conditions": [{"field": "v", "operator": "notIn", "value": ["y"]}]})
    assert rows(nin.df, "id") == [("1",), ("2",)]
    typed = run_step(cat, "filter", {"source": "t", "output": "o4",
                                     "conditions": [{"field": "ord", "operator": "eq", "value": "1"}]})
    assert typed.df.count() == 0  # "1" never equals 1
    gt_text = run_step(cat, "filter", {"source": "t", "output": "o5",
                                       "conditions": [{"field": "v", "operator": "gt", "value": 0}]})
    assert gt_text.df.count() == 0


def test_map_price_with_tax(cat):
    reg(cat, "products", [("p1", "Widget", 100, 1), ("p2", "Gadget", 200, 2)], "id string, name string, price int, ord int")
    out = run_step(cat, "map", {"source": "products", "output": "o", "mappings": [
        {"target": "priceWithTax", "expression": {"type": "math", "operator": "*",
                                                  "left": {"type": "field", "path": "price"},
                                                  "right": {"type": "literal", "value": 1.2}}}]})
    got = dict(rows(out.df, "id", "priceWithTax"))
    assert got["p1"] == pytest.approx(120)
    assert "name" not in out.df.columns  # only id (and the order key) survive without includeOriginal


def test_aggregate_and_global(cat):
    reg(cat, "sales", [("s1", "North", 100, 1), ("s2", "North", 150, 2), ("s3", "South", 200, 3)],
        "id string, region string, amount int, ord int")
    g = run_step(cat, "aggregate", {"source": "sales", "output": "g", "groupBy": ["region"], "aggregations": [
        {"field": "amount", "function": "sum", "as": "total"}, {"field": "*", "function": "count", "as": "n"}]})
    assert rows(g.df, "region", "total", "n") == [("North", 250.0, 2), ("South", 200.0, 1)]
    t = run_step(cat, "aggregate", {"source": "sales", "output": "t", "groupBy": [], "aggregations": [
        {"field": "amount", "function": "sum", "as": "total"}, {"field": "amount", "function": "avg", "as": "avg"}]})
    assert rows(t.df, "total", "avg") == [(450.0, 150.0)]


def test_aggregate_empty_global_has_no_row(cat):
    reg(cat, "e", [], "id string, amount int, ord int")
    t = run_step(cat, "aggregate", {"source": "e", "output": "t", "groupBy": [], "aggregations": [
        {"field": "*", "function": "count", "as": "n"}]})
    assert t.df.count() == 0


def test_first_last_collect_skip_nulls(cat):
    reg(cat, "v", [("a", "k", None, 1), ("b", "k", "x", 2), ("c", "k", "y", 3), ("d", "k", None, 4)],
        "id string, g string, v string, ord int")
    out = run_step(cat, "aggregate", {"source": "v", "output": "o", "groupBy": ["g"], "aggregations": [
        {"field": "v", "function": "first", "as": "f"}, {"field": "v", "function": "last", "as": "l"},
        {"field": "v", "function": "collect", "as": "c"}, {"field": "v", "function": "sum", "as": "s"}]})
    r = out.df.first()
    assert (r["f"], r["l"], list(r["c"]), r["s"]) == ("x", "y", ["x", "y"], None)


def test_join_inner_left_and_collisions(cat):
    reg(cat, "orders", [("o1", "c1", 100, 1), ("o2", "c1", 200, 2), ("o3", "c3", 150, 3)],
        "id string, customerId string, amount int, ord int")
    reg(cat, "customers", [("c1", "Alice", 1), ("c2", "Bob", 2)], "id string, name string, ord int")
    on = [{"leftField": "customerId", "rightField": "id"}]
    inner = run_step(cat, "join", {"left": "orders", "right": "customers", "on": on, "type": "inner", "output": "i"})
    left = run_step(cat, "join", {"left": "orders", "right": "customers", "on": on, "type": "left", "output": "l"})
    assert inner.df.count() == 2 and left.df.count() == 3
    assert {"left_id", "right_id", "name", "amount"} <= set(left.df.columns)
    # collision: right's "ord" overwrites left's only where a right row matched
    got = dict(rows(left.df, "left_id", "ord"))
    assert got == {"o1": 1, "o2": 1, "o3": 3}


def test_join_null_keys_match(cat):
    reg(cat, "a", [("a1", None, 1), ("a2", "k", 2)], "id string, k string, ord int")
    reg(cat, "b", [("b1", None, 1)], "id string, k string, ord int")
    out = run_step(cat, "join", {"left": "a", "right": "b", "on": [{"leftField": "k", "rightField": "k"}],
                                 "type": "inner", "output": "o"})
    assert rows(out.df, "left_id", "right_id") == [("a1", "b1")]


def test_full_and_right_join_with_prefix(cat):
    reg(cat, "a", [("a1", 1, 1), ("a2", 2, 2)], "id string, k int, ord int")
    reg(cat, "b", [("b2", 2, 1), ("b3", 3, 2)], "id string, k int, ord int")
    full = run_step(cat, "join", {"left": "a", "right": "b", "on": [{"leftField": "k", "rightField": "k"}],
                                  "type": "full", "output": "f", "prefix": {"left": "l_", "right": "r_"}})
    assert rows(full.df, "l_id", "r_id") == [("a1", None), ("a2", "b2"), (None, "b3")]
    right = run_step(cat, "join", {"left": "a", "right": "b", "on": [{"leftField": "k", "rightField": "k"}],
                                   "type": "right", "output": "r"})
    assert right.df.count() == 2


def test_lookup_single_and_many(cat):
    reg(cat, "orders", [("o1", "p1", 2, 1), ("o2", "p2", 1, 2), ("o3", "p9", 1, 3)],
        "id string, productId string, quantity int, ord int")
    reg(cat, "products", [("p1", "Widget", 100, 1), ("p2", "Gadget", 200, 2)], "id string, name string, price int, ord int")
    reg(cat, "tags", [("t1", "p1", "new", 1), ("t2", "p1", "sale", 2)], "id string, productId string, tag string, ord int")
    one = run_step(cat, "lookup", {"source": "orders", "from": "products", "localField": "productId",
                                   "foreignField": "id", "as": "product", "output": "o"})
    got = {r["id"]: (r["product"]["name"] if r["product"] else None) for r in one.df.collect()}
    assert got == {"o1": "Widget", "o2": "Gadget", "o3": None}
    many = run_step(cat, "lookup", {"source": "orders", "from": "tags", "localField": "productId",
                                    "foreignField": "productId", "as": "tags", "multiple": True, "output": "m"})
    got = {r["id"]: [t["tag"] for t in r["tags"]] for r in many.df.collect()}
    assert got == {"o1": ["new", "sale"], "o2": [], "o3": []}


def test_deduplicate_first_last(cat):
    reg(cat, "events", [("e1", "u1", "click", 1, 1), ("e2", "u1", "click", 2, 2), ("e3", "u2", "click", 3, 3)],
        "id string, userId string, type string, timestamp int, ord int")
    first = run_step(cat, "deduplicate", {"source": "events", "output": "f", "keys": ["userId"], "keep": "first"})
    last = run_step(cat, "deduplicate", {"source": "events", "output": "l", "keys": ["userId"], "keep": "last",
                                         "orderBy": {"field": "timestamp", "direction": "asc"}})
    assert rows(first.df, "id") == [("e1",), ("e3",)]
    assert rows(last.df, "id") == [("e2",), ("e3",)]


def test_deduplicate_last_null_order_wins(cat):
    reg(cat, "t", [("a", "k", 5, 1), ("b", "k", None, 2), ("c", "k", 9, 3)], "id string, g string, v int, ord int")
    last = run_step(cat, "deduplicate", {"source": "t", "output": "l", "keys": ["g"], "keep": "last",
                                         "orderBy": {"field": "v", "direction": "asc"}})
    assert rows(last.df, "id") == [("b",)]  # nulls sort last, so the null row is last


def test_union_all_and_distinct(cat):
    reg(cat, "pending", [("o1", "pending", 1), ("o2", "pending", 2)], "id string, status string, ord int")
    reg(cat, "done", [("o3", "completed", 1), ("o1", "completed", 2)], "id string, status string, ord int")
    u = run_step(cat, "union", {"sources": ["pending", "done"], "mode": "all", "output": "u"})
    assert u.df.count() == 4
    d = run_step(cat, "union", {"sources": ["pending", "done"], "mode": "distinct", "distinctKeys": ["id"],
                                "output": "d"})
    assert rows(d.df, "id", "status") == [("o1", "pending"), ("o2", "pending"), ("o3", "completed")]
    nokeys = run_step(cat, "union", {"sources": ["pending", "done"], "mode": "distinct", "output": "n"})
    assert nokeys.df.count() == 4  # distinct without keys behaves as all


def test_sort_limit_offset_and_nulls(cat):
    reg(cat, "items", [("i1", "Charlie", 75, 1), ("i2", "Alice", 90, 2), ("i3", "Bob", 85, 3),
                       ("i4", None, None, 4)], "id string, name string, score int, ord int")
    run_step(cat, "sort", {"source": "items", "output": "s", "orderBy": [{"field": "name", "direction": "asc"}]})
    top = run_step(cat, "limit", {"source": "s", "output": "t", "limit": 10})
    assert [r["name"] for r in top.df.collect()] == ["Alice", "Bob", "Charlie", None]
    run_step(cat, "sort", {"source": "items", "output": "d", "orderBy": [{"field": "score", "direction": "desc"}]})
    d = run_step(cat, "limit", {"source": "d", "output": "dl", "limit": 10})
    assert [r["score"] for r in d.df.collect()] == [90, 85, 75, None]  # nulls last in desc too
    reg(cat, "records", [(f"r{i}", i, i) for i in range(1, 21)], "id string, value int, ord int")
    page = run_step(cat, "limit", {"source": "records", "output": "p", "limit": 3, "offset": 5})
    assert [r["value"] for r in page.df.collect()] == [6, 7, 8]


def test_pivot_and_unpivot(cat):
    reg(cat, "sales_data", [("1", "North", "Q1", 100, 1), ("2", "North", "Q2", 150, 2), ("3", "South", "Q1", 200, 3),
                            ("4", "South", "Q2", 250, 4), ("5", "West", None, 5, 5)],
        "id string, region string, quarter string, amount int, ord int")
    p = run_step(cat, "pivot", {"source": "sales_data", "output": "p", "groupBy": ["region"],
                                "pivotField": "quarter", "valueField": "amount", "aggregation": "sum"})
    got = {r["region"]: (r["Q1"], r["Q2"], r["null"]) for r in p.df.collect()}
    assert got["North"] == (100.0, 150.0, None) and got["West"] == (None, None, 5.0)
    c = run_step(cat, "pivot", {"source": "sales_data", "output": "c", "groupBy": ["region"],
                                "pivotField": "quarter", "valueField": "amount", "aggregation": "count"})
    assert {r["region"]: r["Q1"] for r in c.df.collect()}["West"] is None  # no rows -> NULL, not 0
    reg(cat, "wide", [("A", "A", 100, 150, 1), ("B", "B", 200, None, 2)], "id string, product string, jan int, feb int, ord int")
    u = run_step(cat, "unpivot", {"source": "wide", "output": "u", "idFields": ["product"],
                                  "unpivotFields": ["jan", "feb"], "nameField": "month", "valueField": "v"})
    assert u.df.count() == 4  # NULL values are kept


def test_flatten(cat):
    reg(cat, "t", [("a", None, 1), ("b", [], 2), ("c", ["x"], 3), ("d", ["y", "z"], 4)],
        "id string, tags array<string>, ord int")
    f = run_step(cat, "flatten", {"source": "t", "output": "f", "field": "tags"})
    assert rows(f.df, "id", "tags", "pos") == [("c", "x", 0), ("d", "y", 0), ("d", "z", 1)]
    k = run_step(cat, "flatten", {"source": "t", "output": "k", "field": "tags", "as": "tag", "preserveEmpty": True})
    assert k.df.count() == 5 and "tags" in k.df.columns


def test_sales_report_pipeline(cat):
    reg(cat, "customers", [("c1", "Alice", "North", 1), ("c2", "Bob", "South", 2), ("c3", "Charlie", "North", 3)],
        "id string, name string, region string, ord int")
    reg(cat, "orders", [("o1", "c1", 100, "completed", 1), ("o2", "c1", 150, "completed", 2),
                        ("o3", "c2", 200, "pending", 3), ("o4", "c3", 75, "completed", 4)],
        "id string, customerId string, amount int, status string, ord int")
    steps = [
        {"id": "a", "type": "filter", "config": {"source": "orders", "output": "_temp_c", "conditions": [
            {"field": "status", "operator": "eq", "value": "completed"}]}},
        {"id": "b", "type": "join", "dependsOn": ["a"], "config": {
            "left": "_temp_c", "right": "customers", "type": "inner", "output": "_temp_j",
            "on": [{"leftField": "customerId", "rightField": "id"}]}},
        {"id": "c", "type": "aggregate", "dependsOn": ["b"], "config": {
            "source": "_temp_j", "output": "report", "groupBy": ["region"], "aggregations": [
                {"field": "amount", "function": "sum", "as": "totalSales"},
                {"field": "*", "function": "count", "as": "orderCount"}],
            "having": [{"field": "totalSales", "operator": "gt", "value": 300}]}},
    ]
    run = run_pipeline(cat, {"id": "p", "name": "sales", "steps": steps}, observe=True)
    assert run.status == "completed"
    assert rows(run.outputs["report"], "region", "totalSales", "orderCount") == [("North", 325.0, 3)]
    assert not cat.has("_temp_c")  # temp collections are cleared after the run


def test_pipeline_failure_and_skip(cat):
    reg(cat, "t", [("1", 1, 1)], "id string, v int, ord int")
    steps = [
        {"id": "bad", "type": "filter", "config": {"source": "missing", "output": "x", "conditions": []}},
        {"id": "dep", "type": "filter", "dependsOn": ["bad"], "config": {"source": "t", "output": "y", "conditions": []}},
        {"id": "ok", "type": "filter", "config": {"source": "t", "output": "z", "conditions": []}},
    ]
    run = run_pipeline(cat, {"id": "p", "name": "p", "steps": steps}, continue_on_error=True)
    assert [s.status for s in run.steps] == ["failed", "skipped", "completed"]
    assert run.status == "failed"
    with pytest.raises(PipelineError):
        run_pipeline(cat, {"id": "p", "name": "p", "status": "inactive", "steps": steps})


def test_order_sensitive_step_requires_key(cat):
    cat.register("noorder", cat.spark.range(3).withColumn("g", F.lit(1)))
    with pytest.raises(Exception, match="order"):
        run_step(cat, "deduplicate", {"source": "noorder", "output": "o", "keys": ["g"], "keep": "first"})


def test_join_on_mismatched_key_types_plans_no_join(cat):
    reg(cat, "a", [("a1", 1, 1)], "id string, k int, ord int")
    reg(cat, "b", [("b1", "1", 1)], "id string, k string, ord int")
    on = [{"leftField": "k", "rightField": "k"}]
    left = run_step(cat, "join", {"left": "a", "right": "b", "on": on, "type": "left", "output": "l"})
    full = run_step(cat, "join", {"left": "a", "right": "b", "on": on, "type": "full", "output": "f"})
    inner = run_step(cat, "join", {"left": "a", "right": "b", "on": on, "type": "inner", "output": "i"})
    assert rows(left.df, "left_id", "right_id") == [("a1", None)]
    assert rows(full.df, "left_id", "right_id") == [("a1", None), (None, "b1")]
    assert inner.df.count() == 0
    assert "NestedLoop" not in full.df._jdf.queryExecution().executedPlan().toString()


def test_dedupe_descending_text_key_without_window(cat):
    reg(cat, "t", [("a", "k", "x", 1), ("b", "k", "z", 2), ("c", "k", "z", 3), ("d", "m", None, 4)],
        "id string, g string, s string, ord int")
    first = run_step(cat, "deduplicate", {"source": "t", "output": "f", "keys": ["g"], "keep": "first",
                                          "orderBy": {"field": "s", "direction": "desc"}})
    last = run_step(cat, "deduplicate", {"source": "t", "output": "l", "keys": ["g"], "keep": "last",
                                         "orderBy": {"field": "s", "direction": "desc"}})
    assert rows(first.df, "id") == [("b",), ("d",)]
    assert rows(last.df, "id") == [("a",), ("d",)]
    assert "Window" not in first.df._jdf.queryExecution().executedPlan().toString()


def test_step_input_and_output_rows(cat):
    reg(cat, "a", [("a1", 1, 1), ("a2", 2, 2), ("a3", 3, 3)], "id string, k int, ord int")
    reg(cat, "b", [("b1", 1, 1)], "id string, k int, ord int")
    steps = [
        {"id": "j", "type": "join", "config": {"left": "a", "right": "b", "type": "left", "output": "j",
                                               "on": [{"leftField": "k", "rightField": "k"}]}},
        {"id": "u", "type": "union", "config": {"sources": ["a", "b", "a"], "mode": "all", "output": "u"}},
    ]
    run = run_pipeline(cat, {"id": "p", "name": "p", "steps": steps}, observe=True)
    run.outputs["j"].write.format("noop").mode("overwrite").save()
    run.outputs["u"].write.format("noop").mode("overwrite").save()
    j, u = run.steps
    assert (j.input_rows(), j.output_rows()) == (4, 3)
    assert (u.input_rows(), u.output_rows()) == (7, 7)


def test_sort_and_dedupe_with_unicode_collation(cat):
    reg(cat, "names", [("1", "b", "g", 1), ("2", "A", "g", 2), ("3", "a", "g", 3), ("4", "B", "g", 4),
                       ("5", "C", "g", 5)], "id string, name string, g string, ord int")
    run_step(cat, "sort", {"source": "names", "output": "s",
                           "orderBy": [{"field": "name", "direction": "asc", "collation": "UNICODE"}]})
    out = run_step(cat, "limit", {"source": "s", "output": "l", "limit": 10})
    assert [r["name"] for r in out.df.collect()] == ["a", "A", "b", "B", "C"]  # like localeCompare
    first = run_step(cat, "deduplicate", {"source": "names", "output": "d", "keys": ["g"], "keep": "last",
                                          "orderBy": {"field": "name", "direction": "asc", "collation": "UNICODE"}})
    assert [r["name"] for r in first.df.collect()] == ["C"]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_join_deals_out_keys_with_many_rows_on_both_sides(cat, monkeypatch, how):
    """No task makes all pairs of a key, NULL keys included; rows without partner stay as the kind of join says."""
    from tillwright.operators import steps

    monkeypatch.setattr(steps, "PAIRS", (100, 400), raising=False)
    keys = {"a": {None: 60, 1: 90, 2: 3, 3: 40, 5: 2}, "b": {None: 70, 1: 50, 2: 4, 4: 30, 5: 300}}
    made = {t: [(f"{t}{k}-{i}", k, i) for k, n in ks.items() for i in range(n)] for t, ks in keys.items()}
    for t, data in made.items():
        reg(cat, t, data, "id string, k int, ord int")
    step = {"id": "j", "type": "join", "config": {"left": "a", "right": "b", "type": how, "output": "j", "on": [{"leftField": "k", "rightField": "k"}]}}
    run = run_pipeline(cat, {"id": "p", "name": "p", "steps": [step]}, observe=True)
    got = [tuple(r) for r in run.outputs["j"].select("left_id", "right_id", F.spark_partition_id()).collect()]
    want = [(a, b) for a, k, _ in made["a"] for b, m, _ in made["b"] if k == m]
    want += [(a, None) for a, k, _ in made["a"] if k not in keys["b"]] if how in ("left", "full") else []
    want += [(None, b) for b, k, _ in made["b"] if k not in keys["a"]] if how in ("right", "full") else []
    assert sorted(map(repr, [r[:2] for r in got])) == sorted(map(repr, want))
    tasks = [p for _, _, p in got]
    assert max(map(tasks.count, set(tasks))) < len(want) / 6  # the largest key has nearly half of them
    assert (run.steps[0].input_rows(), run.steps[0].output_rows()) == (len(made["a"]) + len(made["b"]), len(want))
