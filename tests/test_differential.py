"""Randomised differential tests: native Spark expressions against small
pure-Python models of the original's JavaScript semantics."""

import calendar
import datetime as dt
import random

from pyspark.sql import functions as F

from tillwright.functions import dates
from tillwright.functions.expressions import compile_expr
from tillwright.functions.values import number_text


def js_add_months(t: dt.datetime, n: int) -> dt.datetime:
    """Date.setMonth(getMonth() + n): day overflow rolls into the next month."""
    y, m = divmod(t.month - 1 + n, 12)
    y += t.year
    first = dt.datetime(y, m + 1, 1, t.hour, t.minute, t.second, t.microsecond)
    return first + dt.timedelta(days=t.day - 1)


def js_start_of_week(t: dt.datetime) -> dt.datetime:
    d = dt.datetime(t.year, t.month, t.day)
    return d - dt.timedelta(days=(d.weekday() + 1) % 7)  # Sunday = 0


def js_end_of_month(t: dt.datetime) -> dt.datetime:
    last = calendar.monthrange(t.year, t.month)[1]
    return dt.datetime(t.year, t.month, last, 23, 59, 59, 999000)


def js_number_text(x: float) -> str:
    if x == int(x) and abs(x) < 1e20:
        return str(int(x))
    return repr(x)


def js_substring(s: str, start: int, end: int | None) -> str:
    n = len(s)
    a = min(max(start, 0), n)
    b = n if end is None else min(max(end, 0), n)
    lo, hi = min(a, b), max(a, b)
    return s[lo:hi]


def test_calendar_functions_match_model(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(400):
        t = dt.datetime(rnd.randint(1990, 2030), rnd.randint(1, 12), rnd.randint(1, 28),
                        rnd.randint(0, 23), rnd.randint(0, 59), rnd.randint(0, 59))
        # days 29-31 where they exist, to exercise the overflow
        last = calendar.monthrange(t.year, t.month)[1]
        t = t.replace(day=rnd.randint(max(1, last - 3), last)) if rnd.random() < 0.5 else t
        rows.append((t, rnd.randint(-30, 30)))
    df = spark.createDataFrame(rows, "t timestamp, n int")
    got = df.select("t", "n", *[dates.add(F.col("t"), k, "month").alias(f"m{k}") for k in (1, -1, 13)],
                    dates.add(F.col("t"), 2, "year").alias("y2"),
                    dates.start_of(F.col("t"), "week").alias("sw"),
                    dates.end_of(F.col("t"), "month").alias("em")).collect()
    for r in got:
        t = r["t"]
        assert r["m1"] == js_add_months(t, 1)
        assert r["m-1"] == js_add_months(t, -1)
        assert r["m13"] == js_add_months(t, 13)
        assert r["y2"] == js_add_months(t, 24)
        assert r["sw"] == js_start_of_week(t)
        assert r["em"] == js_end_of_month(t)


def test_number_text_matches_model(spark):
    rnd = random.Random(3)
    vals = [0.0, -0.0, 1.0, -7.0, 1e15, 123456789.125, 0.1, 0.3, 2.5e-3, -1234.5678]
    vals += [round(rnd.uniform(-1e7, 1e7), rnd.randint(0, 6)) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["s"] for r in df.select(number_text(F.col("x")).alias("s")).collect()]
    assert got == [js_number_text(v) for v in vals]


def test_substring_and_slice_match_model(spark):
    rnd = random.Random(7)
    cases = [("".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 12))),
              rnd.randint(-3, 14), rnd.choice([None, rnd.randint(-3, 14)])) for _ in range(120)]
    df = spark.createDataFrame([(s,) for s, _, _ in cases], "s string")
    for i, (s, a, b) in enumerate(cases):
        spec = {"type": "string", "operation": "substring", "path": "s", "start": a}
        if b is not None:
            spec["end"] = b
        got = df.select(compile_expr(df.schema, spec).col.alias("v")).collect()[i]["v"]
        assert got == js_substring(s, a, b), (s, a, b)
    arr = spark.createDataFrame([([1, 2, 3, 4, 5],)], "xs array<int>")
    for a, b in [(0, None), (1, 3), (-2, None), (1, -1), (4, 2), (-10, 2), (2, 100)]:
        spec = {"type": "array", "operation": "slice", "path": "xs", "start": a}
        if b is not None:
            spec["end"] = b
        got = arr.select(compile_expr(arr.schema, spec).col.alias("v")).first()["v"]
        assert got == [1, 2, 3, 4, 5][a:b], (a, b)


def _model(x, op, v):
    """The original's step predicate on a typed cell (None = NULL/missing)."""
    isnum = lambda a: isinstance(a, (int, float)) and not isinstance(a, bool)
    if op == "eq":
        return (x is None and v is None) or (x is not None and type(x) is not bool and (
            (isinstance(x, str) and isinstance(v, str) and x == v) or (isnum(x) and isnum(v) and x == v)))
    if op == "ne":
        return not _model(x, "eq", v)
    if op in ("gt", "gte", "lt", "lte"):
        if not (isnum(x) and isnum(v)):
            return False
        return {"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[op]
    if op == "in":
        return any(_model(x, "eq", e) for e in v)
    if op == "notIn":
        return not any(_model(x, "eq", e) for e in v)
    if op in ("contains", "startsWith", "endsWith"):
        if not (isinstance(x, str) and isinstance(v, str)):
            return False
        return {"contains": v in x, "startsWith": x.startswith(v), "endsWith": x.endswith(v)}[op]
    if op == "exists":
        return x is not None
    if op == "isNull":
        return x is None
    raise ValueError(op)


def test_filter_predicates_match_model(cat):
    from tillwright.operators.steps import run_step

    rnd = random.Random(23)
    texts = [None, "", "ab", "abc", "b", "xa"]
    nums = [None, -1.5, 0.0, 2.0, 3.0]
    rows = [(str(i), rnd.choice(texts), rnd.choice(nums), i) for i in range(60)]
    cat.register("t", cat.spark.createDataFrame(rows, "id string, s string, d double, ord int"), order_key=("ord",))
    values = [None, "ab", "a", "", 2, 2.0, 0, -1.5, "2"]
    ops = ["eq", "ne", "gt", "gte", "lt", "lte", "in", "notIn", "contains", "startsWith", "endsWith",
           "exists", "isNull"]
    for trial in range(40):
        conds = []
        for _ in range(rnd.randint(1, 3)):
            op = rnd.choice(ops)
            v = rnd.sample(values, 3) if op in ("in", "notIn") else rnd.choice(values)
            conds.append({"field": rnd.choice(["s", "d"]), "operator": op, "value": v})
        logic = rnd.choice(["and", "or"])
        out = run_step(cat, "filter", {"source": "t", "output": f"o{trial}", "conditions": conds,
                                       "conditionLogic": logic})
        got = sorted(r["id"] for r in out.df.collect())
        col = {"s": 1, "d": 2}
        agg = all if logic == "and" else any
        want = sorted(r[0] for r in rows if agg(_model(r[col[c["field"]]], c["operator"], c["value"]) for c in conds))
        assert got == want, (conds, logic)


_CHAIN = ["eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "contains", "startsWith", "endsWith"]


def _op_model(x, op: dict) -> bool:
    isnum = lambda a: isinstance(a, (int, float)) and not isinstance(a, bool)
    for k in _CHAIN:  # first operator in chain order wins
        if k in op:
            v = op[k]
            if k in ("eq", "ne", "in", "contains", "startsWith", "endsWith"):
                base = {"eq": "eq", "ne": "ne", "in": "in", "contains": "contains",
                        "startsWith": "startsWith", "endsWith": "endsWith"}[k]
                return _model(x, base, v)
            if k == "nin":
                return _model(x, "notIn", v)
            return isnum(x) and isnum(v) and {"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[k]
    return False


def _tree_model(row: dict, flt: dict) -> bool:
    if "and" in flt:
        return all(_tree_model(row, f) for f in flt["and"])
    if "or" in flt:
        return any(_tree_model(row, f) for f in flt["or"])
    return all(_op_model(row.get(k), op) for k, op in flt.items())


def test_filter_trees_match_model(cat):
    from tillwright.operators.query import find_all

    rnd = random.Random(29)
    rows = [{"id": str(i), "s": rnd.choice([None, "ab", "abc", "b"]), "d": rnd.choice([None, 0.0, 1.5, 3.0])}
            for i in range(50)]
    cat.register("t", cat.spark.createDataFrame([(r["id"], r["s"], r["d"]) for r in rows],
                                                "id string, s string, d double"), order_key=("id",))

    def leaf():
        field = rnd.choice(["s", "d"])
        ops = {}
        for _ in range(rnd.choice([1, 1, 1, 2])):
            k = rnd.choice(_CHAIN)
            ops[k] = rnd.sample(["ab", 1.5, None, "b"], 2) if k in ("in", "nin") else rnd.choice(["ab", "a", 1.5, 0, None])
        return {field: ops}

    def tree(depth):
        r = rnd.random()
        if depth == 0 or r < 0.4:
            return leaf()
        kids = [tree(depth - 1) for _ in range(rnd.randint(0, 3))]
        return {"and": kids} if r < 0.7 else {"or": kids}

    for _ in range(40):
        flt = tree(3)
        got = sorted(r["id"] for r in find_all(cat, "t", flt).collect())
        want = sorted(r["id"] for r in rows if _tree_model(r, flt))
        assert got == want, flt


def _js_number(x):
    if x is None:
        return float("nan")  # typed NULL counts as missing
    if isinstance(x, bool):
        return 1.0 if x else 0.0
    if isinstance(x, (int, float)):
        return float(x)
    t = x.strip()
    if t == "":
        return 0.0
    try:
        return float(t)
    except ValueError:
        return float("nan")


def _js_string(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return js_number_text(x)
    return str(x)


def _compare_model(op, a, b):
    import math

    if op in (">", ">=", "<", "<="):
        x, y = _js_number(a), _js_number(b)
        if math.isnan(x) or math.isnan(y):
            return False
        return {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]
    sa, sb = _js_string(a), _js_string(b)
    return {"contains": sb in sa, "startsWith": sa.startswith(sb), "endsWith": sa.endswith(sb)}[op]


def test_workflow_compare_coercion_matches_model(cat):
    from tillwright.operators.rules import route

    rnd = random.Random(31)
    rows = [(str(i), rnd.choice([None, "", " 12 ", "abc", "3.5", "-1"]), rnd.choice([None, 0.0, 3.5, 12.0, -2.0]))
            for i in range(40)]
    ctx = cat.spark.createDataFrame(rows, "id string, s string, d double")
    for op in (">", ">=", "<", "<=", "contains", "startsWith", "endsWith"):
        for left, right in (("s", "d"), ("d", "s"), ("s", None)):
            const = rnd.choice(["1", 3.5, "", 12])
            rv = {"type": "field", "path": right} if right else {"type": "constant", "value": const}
            wf = {"steps": [{"id": "c", "type": "condition",
                             "condition": {"type": "compare", "left": {"type": "field", "path": left},
                                           "operator": op, "right": rv},
                             "onTrue": "y", "onFalse": "n"},
                            {"id": "y", "type": "end"}, {"id": "n", "type": "end"}]}
            got = {r["id"]: r["outcome"] == "y" for r in route(cat, ctx, wf).collect()}
            col = {"s": 1, "d": 2}
            for r in rows:
                b = r[col[right]] if right else const
                assert got[r[0]] == _compare_model(op, r[col[left]], b), (op, left, right, r, b)
