"""Templates, campaigns, rule routing and streaming steps."""

import pytest
from pyspark.sql import functions as F

from tillwright.operators.audience import (CampaignError, extract_variables, preview, render_column,
                                           render_constant, run_campaign)
from tillwright.operators.rules import WorkflowError, route
from tillwright.streaming.incremental import StreamingStepError, stream_steps


def test_render_and_extract(spark):
    df = spark.createDataFrame([({"appName": "MyApp", "name": "John"},), ({"name": "Jane"},)],
                               "v map<string,string>")
    subj = render_constant("Welcome to {{appName}}", F.col("v"))
    body = render_constant("Hello {{name}}, welcome to {{appName}}!", F.col("v"))
    got = [(r["s"], r["b"]) for r in df.select(subj.alias("s"), body.alias("b")).collect()]
    assert got[0] == ("Welcome to MyApp", "Hello John, welcome to MyApp!")
    assert got[1] == ("Welcome to {{appName}}", "Hello Jane, welcome to {{appName}}!")
    t = spark.createDataFrame([("Hello {{name}}, your code is {{code}}", {"name": "{{code}}"})],
                              "t string, v map<string,string>")
    assert t.select(render_column(F.col("t"), F.col("v")).alias("r")).first()["r"] == \
        "Hello {{code}}, your code is {{code}}"  # inserted values are not substituted again
    ev = spark.createDataFrame([("Hi {{a}} {{b}}", "{{b}} and {{c}}")], "s string, b string")
    assert ev.select(extract_variables(F.col("s"), F.col("b")).alias("v")).first()["v"] == ["a", "b", "c"]


def test_campaign_preview_and_run(cat):
    users = cat.spark.createDataFrame([("u1", "a@x.com", "Ann"), ("u2", None, "Bob"), ("u3", "c@x.com", "Cy")],
                                      "id string, email string, name string")
    cat.register("users", users, order_key=("id",))
    camp = {"id": "c", "status": "draft", "entityConfig": {"collection": "users", "recipientField": "email"},
            "variableMappings": {"name": "name"}}
    rec, stats = preview(cat, camp)
    s = stats.first()
    assert (s["total"], s["recipients"], s["skipped"]) == (3, 2, 1)
    msgs, st = run_campaign(cat, camp, {"id": "t", "subject": "", "body": "Hi {{name}}"})
    assert sorted(r["body"] for r in msgs.collect()) == ["Hi Ann", "Hi Cy"]
    assert st.first()["status"] == "completed"
    with pytest.raises(CampaignError):
        run_campaign(cat, {**camp, "status": "completed"}, {"id": "t", "body": "x"})


def cmp(left, op, right):
    return {"type": "compare", "left": left, "operator": op, "right": right}


def f(p):
    return {"type": "field", "path": p}


def c(v):
    return {"type": "constant", "value": v}


def test_routing_and_coercion(cat):
    ctx = cat.spark.createDataFrame([("1", "12", 5.0, None), ("2", "x", 50.0, "vip"), ("3", "", 0.0, None)],
                                    "id string, n string, amount double, tag string")
    cat.register("ctx", ctx, order_key=("id",))
    cat.register("limits", cat.spark.createDataFrame([(10.0,), (20.0,)], "cap double"))
    wf = {"steps": [
        {"id": "a", "type": "condition", "condition": cmp(f("n"), ">", c(10)), "onTrue": "big", "onFalse": "b"},
        {"id": "b", "type": "condition",
         "condition": {"type": "exists", "collection": "limits",
                       "filter": {"field": "cap", "operator": ">", "value": f("amount")}},
         "onTrue": "set", "onFalse": "nolimit"},
        {"id": "set", "type": "action", "next": "c2",
         "action": {"type": "setContext", "values": {"tag": c("capped")}}},
        {"id": "c2", "type": "condition", "condition": cmp(f("tag"), "==", c("capped")),
         "onTrue": "done", "onFalse": "nolimit"},
        {"id": "big", "type": "end", "status": "completed"},
        {"id": "done", "type": "end"},
        {"id": "nolimit", "type": "end", "status": "failed", "reason": "no cap"},
    ]}
    out = {r["id"]: (r["outcome"], r["status"], list(r["path"]), r["tag"]) for r in route(cat, ctx, wf).collect()}
    assert out["1"] == ("big", "completed", ["a", "big"], None)  # Number("12") > 10
    assert out["2"] == ("nolimit", "failed", ["a", "b", "nolimit"], "vip")
    assert out["3"] == ("done", "completed", ["a", "b", "set", "c2", "done"], "capped")  # "" -> 0 < caps
    cyc = {"steps": [{"id": "x", "type": "condition", "condition": cmp(c(1), "==", c(1)), "onTrue": "x",
                      "onFalse": None}]}
    with pytest.raises(WorkflowError):
        route(cat, ctx, cyc)


def test_streaming_rejects_order_sensitive_steps(cat):
    cat.register("s", cat.spark.readStream.format("rate").load())
    with pytest.raises(StreamingStepError):
        stream_steps(cat, "s", [{"id": "x", "type": "sort", "config": {"source": "s", "output": "o",
                                                                      "orderBy": [{"field": "value"}]}}])


def test_exists_not_equal_reduces_to_aggregate(cat):
    ctx = cat.spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    cat.register("same", cat.spark.createDataFrame([("a",), ("a",)], "v string"))
    wf = {"steps": [{"id": "x", "type": "condition",
                     "condition": {"type": "exists", "collection": "same",
                                   "filter": {"field": "v", "operator": "!=", "value": {"type": "field", "path": "v"}}},
                     "onTrue": "yes", "onFalse": "no"},
                    {"id": "yes", "type": "end"}, {"id": "no", "type": "end"}]}
    out = route(cat, ctx, wf)
    assert {r["id"]: r["outcome"] for r in out.collect()} == {"1": "no", "2": "yes"}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_graph_of_forty_diamonds(spark, cat):
    """Branches that meet again do not multiply: each step is compiled once."""
    steps = []
    for i in range(40):
        compare = {"type": "compare", "operator": ">", "left": {"type": "context", "path": "x"}, "right": {"type": "constant", "value": i}}
        steps += [{"id": f"c{i}", "type": "condition", "condition": compare, "onTrue": f"y{i}", "onFalse": f"n{i}"},
                  {"id": f"y{i}", "type": "action", "action": {"type": "setContext", "values": {"last": {"type": "constant", "value": f"over {i}"}}}, "next": f"c{i + 1}"},
                  {"id": f"n{i}", "type": "action", "action": {"type": "createEntity", "collection": "log", "data": {"at": {"type": "context", "path": "last"}}}, "next": f"c{i + 1}"}]
    steps.append({"id": "c40", "type": "end", "status": "completed"})
    ctx = spark.createDataFrame([(1, 3), (2, 100), (3, None)], "id long, x long")
    out = {r["id"]: r for r in route(cat, ctx, {"steps": steps, "startStepId": "c0"}).collect()}
    assert [(out[i]["outcome"], out[i]["status"], out[i]["last"], len(out[i]["path"]), len(out[i]["actions"])) for i in (1, 2, 3)] == [
        ("c40", "completed", "over 2", 81, 37), ("c40", "completed", "over 39", 81, 0), ("c40", "completed", None, 81, 40)]


def test_exists_with_substrings_against_context_values(spark, cat):
    """Every value by brute force: short and empty ones, trigrams that are common, rare or in no text."""
    import random

    rng = random.Random(8)
    texts = ["".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in range(200)] + [None, "", "äöü straße"]
    values = ["", "a", "z", "ab", "zz", "abc", "ße", "straß", *("".join(rng.choices("abcd", k=rng.randint(3, 6))) for _ in range(60)), "abcz", None]
    cat.register("names", spark.createDataFrame([(t,) for t in texts], "name string"))
    ctx = spark.createDataFrame(list(enumerate(values)), "id long, v string").unionByName(spark.createDataFrame([(1000 + i, "abc") for i in range(50)], "id long, v string"))
    tests = {"contains": lambda t, v: v in t, "startsWith": str.startswith, "endsWith": str.endswith}
    for op, holds in tests.items():
        cond = {"type": "exists", "collection": "names", "filter": {"field": "name", "operator": op, "value": {"type": "context", "path": "v"}}}
        wf = {"steps": [{"id": "c", "type": "condition", "condition": cond, "onTrue": "y", "onFalse": "n"}, {"id": "y", "type": "end"}, {"id": "n", "type": "end"}]}
        got = {r["id"]: r["outcome"] == "y" for r in route(cat, ctx, wf).collect()}
        plain = ["null" if t is None else t for t in texts]
        want = {i: any(holds(t, "null" if v is None else v) for t in plain) for i, v in enumerate(values)}
        assert {i: got[i] for i in want} == want, op
        assert len({got[1000 + i] for i in range(50)}) == 1 and len(got) == len(values) + 50
