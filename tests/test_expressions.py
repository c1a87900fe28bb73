"""Field-mapping expressions: literal cases from the original tests plus the
documented JavaScript differences (rounding, overflow months, Sunday weeks)."""

import datetime as dt
import math

import pytest

from tillwright.functions.expressions import compile_expr


def ev(spark, row: dict, schema: str, expr: dict):
    df = spark.createDataFrame([tuple(row.values())], schema)
    return df.select(compile_expr(df.schema, expr).col.alias("v")).first()["v"]


def s(op, path="text", **kw):
    return {"type": "string", "operation": op, "path": path, **kw}


def test_string_operations(spark):
    assert ev(spark, {"text": "Hello World"}, "text string", s("substring", start=0, end=5)) == "Hello"
    assert ev(spark, {"text": "Hello World"}, "text string", s("substring", start=5, end=0)) == "Hello"
    assert ev(spark, {"text": "foo bar foo"}, "text string", s("replace", pattern="foo", replacement="baz")) == "baz bar baz"
    assert ev(spark, {"text": "ab cd"}, "text string", s("replace", pattern="(\\w+) (\\w+)", replacement="$2 $1")) == "cd ab"
    assert ev(spark, {"text": "Hello"}, "text string", s("length")) == 5
    assert ev(spark, {"text": "\t x \n"}, "text string", s("trim")) == "x"
    assert ev(spark, {"text": "a.b.c"}, "text string", s("split", separator=".")) == ["a", "b", "c"]
    assert ev(spark, {"text": "abcdef"}, "text string", s("padStart", padLength=3, padChar="0")) == "abcdef"
    assert ev(spark, {"text": "7"}, "text string", s("padStart", padLength=3, padChar="0")) == "007"
    assert ev(spark, {"text": 5}, "text int", s("upper")) is None
    assert ev(spark, {"text": 5}, "text int", s("length")) == 0


def m(op, left, right=None):
    e = {"type": "math", "operator": op, "left": left}
    if right is not None:
        e["right"] = right
    return e


def lit(v):
    return {"type": "literal", "value": v}


def test_math_rules(spark):
    assert ev(spark, {"x": 1}, "x int", m("round", lit(-2.5))) == -2.0  # Math.round
    assert ev(spark, {"x": 1}, "x int", m("round", lit(2.5))) == 3.0
    assert math.isnan(ev(spark, {"x": 1}, "x int", m("/", lit(1), lit(0))))
    assert math.isnan(ev(spark, {"x": 1}, "x int", m("%", lit(1), lit(0))))
    assert ev(spark, {"x": -7}, "x int", m("%", {"type": "field", "path": "x"}, lit(3))) == -1.0
    assert ev(spark, {"x": " 12 "}, "x string", m("+", {"type": "field", "path": "x"}, lit(1))) == 13.0
    assert ev(spark, {"x": ""}, "x string", m("+", {"type": "field", "path": "x"}, lit(1))) == 1.0
    assert math.isnan(ev(spark, {"x": "abc"}, "x string", m("+", {"type": "field", "path": "x"}, lit(1))))
    assert ev(spark, {"x": True}, "x boolean", m("+", {"type": "field", "path": "x"}, lit(1))) == 2.0


def test_concat_template_coalesce_conditional(spark):
    schema = "a string, n double, b boolean, z string"
    row = {"a": "x", "n": 3.0, "b": True, "z": None}
    assert ev(spark, row, schema, {"type": "concat", "separator": "-", "values": [
        {"type": "field", "path": "a"}, {"type": "field", "path": "z"}, {"type": "field", "path": "n"},
        {"type": "field", "path": "b"}]}) == "x--3-true"
    assert ev(spark, row, schema, {"type": "template", "template": "{{a}}/{{ missing }}/{{n}}"}) == "x//3"
    assert ev(spark, row, schema, {"type": "coalesce", "values": [{"type": "field", "path": "z"}, lit("d")]}) == "d"
    cond = {"type": "conditional", "condition": {"field": "n", "operator": "gt", "value": 2},
            "then": lit("big"), "else": lit("small")}
    assert ev(spark, row, schema, cond) == "big"
    nin = {"type": "conditional", "condition": {"field": "z", "operator": "notIn", "value": ["q"]},
           "then": lit(1), "else": lit(0)}
    assert ev(spark, row, schema, nin) == 1.0  # NULL notIn [...] is true


def d(op, **kw):
    return {"type": "date", "operation": op, "field": "t", **kw}


def test_dates(spark):
    sch = "t timestamp"
    t = dt.datetime(2024, 1, 15, 10, 30)
    assert ev(spark, {"t": t}, sch, d("format", format="YYYY-MM-DD")) == "2024-01-15"
    assert ev(spark, {"t": t}, sch, d("format", format="DD/MM/YYYY HH:mm:ss")) == "15/01/2024 10:30:00"
    assert ev(spark, {"t": dt.datetime(2024, 1, 15)}, sch, d("add", amount=5, unit="day")) == dt.datetime(2024, 1, 20)
    # month overflow like Date.setMonth: Jan 31 + 1 month = Mar 2 (2024 is a leap year)
    assert ev(spark, {"t": dt.datetime(2024, 1, 31, 8)}, sch, d("add", amount=1, unit="month")) == dt.datetime(2024, 3, 2, 8)
    assert ev(spark, {"t": dt.datetime(2024, 2, 29)}, sch, d("add", amount=1, unit="year")) == dt.datetime(2025, 3, 1)
    # weeks start on Sunday
    assert ev(spark, {"t": dt.datetime(2024, 1, 17, 12)}, sch, d("startOf", unit="week")) == dt.datetime(2024, 1, 14)
    assert ev(spark, {"t": dt.datetime(2024, 1, 17, 12)}, sch, d("endOf", unit="week")) == \
        dt.datetime(2024, 1, 20, 23, 59, 59, 999000)
    assert ev(spark, {"t": dt.datetime(2024, 2, 10)}, sch, d("endOf", unit="month")) == \
        dt.datetime(2024, 2, 29, 23, 59, 59, 999000)
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31), dt.datetime(2024, 3, 1))], "t timestamp, u timestamp")
    got = df.select(compile_expr(df.schema, d("diff", compareTo="u", unit="month")).col.alias("m"),
                    compile_expr(df.schema, d("diff", compareTo="u", unit="day")).col.alias("d")).first()
    assert (got["m"], got["d"]) == (2, 30)
    assert ev(spark, {"t": "2024-01-15T10:00:00Z"}, "t string", {"type": "date", "operation": "parse", "field": "t"}) \
        == dt.datetime(2024, 1, 15, 10)
    assert ev(spark, {"t": "not a date"}, "t string", {"type": "date", "operation": "parse", "field": "t"}) is None


def a(op, **kw):
    return {"type": "array", "operation": op, "path": "xs", **kw}


def test_arrays(spark):
    sch = "xs array<string>"
    row = {"xs": ["a", None, "c", "d"]}
    assert ev(spark, row, sch, a("length")) == 4
    assert ev(spark, row, sch, a("first")) == "a"
    assert ev(spark, row, sch, a("last")) == "d"
    assert ev(spark, row, sch, a("at", index=2)) == "c"
    assert ev(spark, row, sch, a("at", index=-1)) is None
    assert ev(spark, row, sch, a("join", separator="|")) == "a||c|d"
    assert ev(spark, row, sch, a("includes", value="c")) is True
    assert ev(spark, row, sch, a("slice", start=1, end=-1)) == [None, "c"]
    assert ev(spark, {"xs": "no"}, "xs string", a("length")) == 0


def test_unknown_expression_type(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        compile_expr(df.schema, {"type": "nope"})
