"""Registered queries for the transform steps and expressions.

Each query builds a pipeline over the whole test tables and returns the
lazy result; the matching SQL (DuckDB dialect) states the same semantics
independently.  Money sums are rounded to cents on both sides, averages to
six places, so float summation order cannot change the compared values.
The test tables hold no NULLs, so null-sensitive queries first make some
with a ``conditional`` mapping (SQL: ``CASE ... THEN NULL``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline import run_pipeline
from ..sources.catalog import test_catalog


def run_steps(spark, sf_dir, steps, output, tables=None):
    cat = test_catalog(spark, sf_dir, tables) if tables else test_catalog(spark, sf_dir)
    run = run_pipeline(cat, {"id": output, "name": output, "steps": steps})
    if run.status != "completed":
        raise RuntimeError(run.error)
    return cat.get(output)


def step(i, type_, **cfg):
    return {"id": f"s{i}", "type": type_, "config": cfg}


def fld(path):
    return {"type": "field", "path": path}


def lit(v):
    return {"type": "literal", "value": v}


def cond(field, op, value=None):
    c = {"field": field, "operator": op}
    if value is not None or op in ("eq", "ne"):
        c["value"] = value
    return c


def nulled(field, value):
    """``field`` with ``value`` replaced by NULL (the test tables have none)."""
    return {"type": "conditional", "condition": cond(field, "eq", value),
            "then": lit(None), "else": fld(field)}


def mp(target, expression):
    return {"target": target, "expression": expression}


def _round(df, **cols):
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(f"`{c}`")
                       for c, n in [(c, cols.get(c)) for c in df.columns]])


# -- sales_by_nation: filter -> join -> join -> aggregate (P3 J1 J2 A1 A2 A4) ----

def sales_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [
        step(1, "filter", source="orders", output="_temp_done",
             conditions=[cond("o_orderstatus", "eq", "F")]),
        step(2, "join", left="_temp_done", right="customer", type="inner", output="_temp_oc",
             on=[{"leftField": "o_custkey", "rightField": "c_custkey"}]),
        step(3, "join", left="_temp_oc", right="nation", type="inner", output="_temp_ocn",
             on=[{"leftField": "c_nationkey", "rightField": "n_nationkey"}]),
        step(4, "aggregate", source="_temp_ocn", output="sales", groupBy=["n_name"],
             aggregations=[{"field": "o_totalprice", "function": "sum", "as": "total_sales"},
                           {"field": "*", "function": "count", "as": "order_count"},
                           {"field": "o_totalprice", "function": "avg", "as": "avg_sale"}]),
    ]
    df = run_steps(spark, sf_dir, steps, "sales", ["orders", "customer", "nation"])
    return _round(df, total_sales=2, avg_sale=6)


SALES_BY_NATION_SQL = """
SELECT n.n_name,
       round(sum(o.o_totalprice), 2) AS total_sales,
       count(*) AS order_count,
       round(avg(o.o_totalprice), 6) AS avg_sale
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus = 'F'
GROUP BY n.n_name
"""


# -- filters (P3-P9) -------------------------------------------------------------

def filter_and_or(spark, sf_dir):
    steps = [
        step(1, "filter", source="part", output="_temp_any", conditionLogic="or",
             conditions=[cond("p_size", "gte", 45), cond("p_brand", "in", ["Brand#1", "Brand#2"]),
                         cond("p_name", "contains", "ring")]),
        step(2, "filter", source="_temp_any", output="out",
             conditions=[cond("p_retailprice", "lt", 1500), cond("p_type", "ne", "PROMO")]),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["part"])


FILTER_AND_OR_SQL = """
SELECT * FROM part
WHERE (p_size >= 45 OR p_brand IN ('Brand#1', 'Brand#2') OR contains(p_name, 'ring'))
  AND p_retailprice < 1500 AND p_type IS DISTINCT FROM 'PROMO'
"""

_PRIO_MAP = [mp("prio", nulled("o_orderpriority", "5-LOW")), mp("total", fld("o_totalprice"))]
_PRIO_SQL = """(SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS prio,
        o_totalprice AS total FROM orders)"""


def filter_null_safe_ne(spark, sf_dir):
    steps = [
        step(1, "map", source="orders", output="_temp_m", mappings=_PRIO_MAP),
        step(2, "filter", source="_temp_m", output="out", conditions=[cond("prio", "ne", "1-URGENT")]),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["orders"])


FILTER_NULL_SAFE_NE_SQL = f"""
SELECT o_orderkey, prio, total FROM {_PRIO_SQL} m WHERE prio IS DISTINCT FROM '1-URGENT'
"""


def filter_in_notin(spark, sf_dir):
    steps = [
        step(1, "map", source="orders", output="_temp_m", mappings=_PRIO_MAP),
        step(2, "filter", source="_temp_m", output="_temp_f",
             conditions=[cond("prio", "notIn", ["1-URGENT"]),
                         cond("prio", "in", [None, "2-HIGH", "3-MEDIUM"])]),
        step(3, "aggregate", source="_temp_f", output="out", groupBy=["prio"],
             aggregations=[{"field": "*", "function": "count", "as": "n"},
                           {"field": "total", "function": "max", "as": "max_total"}]),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["orders"])


FILTER_IN_NOTIN_SQL = f"""
SELECT prio, count(*) AS n, max(total) AS max_total FROM {_PRIO_SQL} m
WHERE (prio IS NULL OR prio NOT IN ('1-URGENT')) AND (prio IS NULL OR prio IN ('2-HIGH', '3-MEDIUM'))
GROUP BY prio
"""


def filter_regex(spark, sf_dir):
    steps = [step(1, "filter", source="events", output="out",
                  conditions=[cond("props", "regex", r'"k": 1[0-9]\}'),
                              cond("event_type", "in", ["click", "view", "purchase"])])]
    return run_steps(spark, sf_dir, steps, "out", ["events"])


FILTER_REGEX_SQL = r"""
SELECT * FROM events
WHERE regexp_matches(props, '"k": 1[0-9]\}') AND event_type IN ('click', 'view', 'purchase')
"""


def filter_strings(spark, sf_dir):
    steps = [step(1, "filter", source="part", output="out", conditionLogic="or",
                  conditions=[cond("p_name", "startsWith", "small"), cond("p_name", "endsWith", "gear"),
                              cond("p_type", "contains", "OM"), cond("p_size", "contains", "1")])]
    return run_steps(spark, sf_dir, steps, "out", ["part"])


FILTER_STRINGS_SQL = """
SELECT * FROM part
WHERE starts_with(p_name, 'small') OR ends_with(p_name, 'gear') OR contains(p_type, 'OM')
"""


# -- map expressions (P1, E1-E25) ------------------------------------------------

def _math(op, left, right=None):
    e = {"type": "math", "operator": op, "left": left}
    if right is not None:
        e["right"] = right
    return e


def map_math(spark, sf_dir):
    net = _math("*", fld("l_extendedprice"), _math("-", lit(1), fld("l_discount")))
    steps = [step(1, "map", source="lineitem", output="out", mappings=[
        mp("net", net),
        mp("gross", _math("*", net, _math("+", lit(1), fld("l_tax")))),
        mp("qty_mod", _math("%", fld("l_quantity"), lit(7))),
        mp("hundreds", _math("round", _math("/", fld("l_extendedprice"), lit(100)))),
        mp("disc_floor", _math("floor", _math("*", fld("l_discount"), lit(33)))),
        mp("disc_ceil", _math("ceil", _math("*", fld("l_discount"), lit(33)))),
        mp("tax_gap", _math("abs", _math("-", fld("l_tax"), lit(0.04)))),
        mp("unit_price", _math("/", fld("l_extendedprice"), fld("l_quantity"))),
    ])]
    df = run_steps(spark, sf_dir, steps, "out", ["lineitem"])
    return df.drop("flag_num")


MAP_MATH_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
       l_extendedprice * (1 - l_discount) AS net,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross,
       l_quantity % 7 AS qty_mod,
       floor(l_extendedprice / 100 + 0.5) AS hundreds,
       floor(l_discount * 33) AS disc_floor,
       ceil(l_discount * 33) AS disc_ceil,
       abs(l_tax - 0.04) AS tax_gap,
       CASE WHEN l_quantity = 0 THEN 'NaN'::DOUBLE ELSE l_extendedprice / l_quantity END AS unit_price
FROM lineitem
"""


def _str(op, path, **kw):
    return {"type": "string", "operation": op, "path": path, **kw}


def map_strings(spark, sf_dir):
    steps = [step(1, "map", source="part", output="out", mappings=[
        mp("up", _str("upper", "p_name")),
        mp("lo", _str("lower", "p_brand")),
        mp("len", _str("length", "p_name")),
        mp("words", _str("split", "p_name", separator=" ")),
        mp("head", _str("substring", "p_name", start=0, end=4)),
        mp("tail", _str("substring", "p_name", start=6, end=2)),
        mp("masked", _str("replace", "p_name", pattern="[aeiou]", replacement="*")),
        mp("swapped", _str("replace", "p_name", pattern="(\\w+) (\\w+)", replacement="$2-$1")),
        mp("brand_pad", _str("padStart", "p_brand", padLength=9, padChar="_")),
        mp("type_pad", _str("padEnd", "p_type", padLength=7, padChar=".")),
        mp("trimmed", _str("trim", "p_name")),
        mp("size_len", _str("length", "p_size")),
    ])]
    return run_steps(spark, sf_dir, steps, "out", ["part"])


MAP_STRINGS_SQL = """
SELECT p_partkey,
       upper(p_name) AS up, lower(p_brand) AS lo, length(p_name) AS len,
       string_split(p_name, ' ') AS words,
       substring(p_name, 1, 4) AS head,
       substring(p_name, 3, 4) AS tail,
       regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked,
       regexp_replace(p_name, '(\\w+) (\\w+)', '\\2-\\1', 'g') AS swapped,
       CASE WHEN length(p_brand) < 9 THEN lpad(p_brand, 9, '_') ELSE p_brand END AS brand_pad,
       CASE WHEN length(p_type) < 7 THEN rpad(p_type, 7, '.') ELSE p_type END AS type_pad,
       trim(p_name) AS trimmed,
       0::BIGINT AS size_len
FROM part
"""

_JS_BAL = ("CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) "
           "ELSE CAST(c_acctbal AS VARCHAR) END")


def map_concat_template(spark, sf_dir):
    steps = [step(1, "map", source="customer", output="out", mappings=[
        mp("label", {"type": "concat", "separator": " | ",
                     "values": [fld("c_name"), fld("c_mktsegment"), fld("c_acctbal"), fld("c_nationkey"),
                                fld("no_such_field")]}),
        mp("msg", {"type": "template",
                   "template": "{{c_name}} ({{ c_mktsegment }}) owes {{c_acctbal}} in nation {{c_nationkey}}{{nope}}."}),
    ])]
    return run_steps(spark, sf_dir, steps, "out", ["customer"])


MAP_CONCAT_TEMPLATE_SQL = f"""
SELECT c_custkey,
       c_name || ' | ' || c_mktsegment || ' | ' || {_JS_BAL} || ' | ' || CAST(c_nationkey AS VARCHAR) || ' | ' AS label,
       c_name || ' (' || c_mktsegment || ') owes ' || {_JS_BAL} || ' in nation ' || CAST(c_nationkey AS VARCHAR) || '.' AS msg
FROM customer
"""


def map_conditional(spark, sf_dir):
    steps = [step(1, "map", source="orders", output="out", mappings=[
        mp("size_class", {"type": "conditional", "condition": cond("o_totalprice", "gt", 200000),
                          "then": lit("big"), "else": lit("small")}),
        mp("prio_or_none", {"type": "coalesce", "values": [nulled("o_orderpriority", "5-LOW"), lit("none")]}),
        mp("state", {"type": "conditional", "condition": cond("o_orderstatus", "in", ["F", "O"]),
                     "then": lit("closed"), "else": fld("o_orderstatus")}),
        mp("weird", {"type": "conditional", "condition": cond("o_orderstatus", "gt", 1),
                     "then": lit("never"), "else": lit("always")}),
    ])]
    return run_steps(spark, sf_dir, steps, "out", ["orders"])


MAP_CONDITIONAL_SQL = """
SELECT o_orderkey,
       CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size_class,
       coalesce(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END, 'none') AS prio_or_none,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN 'closed' ELSE o_orderstatus END AS state,
       'always' AS weird
FROM orders
"""


def _date(op, field=None, **kw):
    e = {"type": "date", "operation": op, **kw}
    if field:
        e["field"] = field
    return e


def map_dates(spark, sf_dir):
    steps = [
        step(1, "map", source="orders", output="_temp_d1", mappings=[
            mp("fmt", _date("format", "o_orderdate", format="YYYY/MM/DD (YYYY)")),
            mp("plus1m", _date("add", "o_orderdate", amount=1, unit="month")),
            mp("minus1y", _date("add", "o_orderdate", amount=-1, unit="year")),
            mp("plus45d", _date("add", "o_orderdate", amount=45, unit="day")),
            mp("wk", _date("startOf", "o_orderdate", unit="week")),
            mp("wk_end", _date("endOf", "o_orderdate", unit="week")),
            mp("eom", _date("endOf", "o_orderdate", unit="month")),
            mp("soy", _date("startOf", "o_orderdate", unit="year")),
            mp("orderdate", fld("o_orderdate")),
        ]),
        step(2, "map", source="_temp_d1", output="out", includeOriginal=True, mappings=[
            mp("days_to_plus1m", _date("diff", "orderdate", compareTo="plus1m", unit="day")),
            mp("months_to_plus1m", _date("diff", "orderdate", compareTo="plus1m", unit="month")),
            mp("weeks_to_plus45d", _date("diff", "orderdate", compareTo="plus45d", unit="week")),
            mp("years_back", _date("diff", "orderdate", compareTo="minus1y", unit="year")),
        ]),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["orders"]).drop("orderdate")


MAP_DATES_SQL = """
WITH d AS (
  SELECT o_orderkey, o_orderdate AS d,
         date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER))
           + (o_orderdate - date_trunc('day', o_orderdate)) AS plus1m,
         date_trunc('month', o_orderdate) - INTERVAL 12 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER))
           + (o_orderdate - date_trunc('day', o_orderdate)) AS minus1y,
         o_orderdate + INTERVAL 45 DAY AS plus45d
  FROM orders)
SELECT o_orderkey,
       strftime(d, '%Y/%m/%d (YYYY)') AS fmt,
       plus1m, minus1y, plus45d,
       date_trunc('day', d) - to_days(CAST(dayofweek(d) AS INTEGER)) AS wk,
       date_trunc('day', d) - to_days(CAST(dayofweek(d) AS INTEGER)) + INTERVAL 7 DAY - INTERVAL 1 MILLISECOND AS wk_end,
       date_trunc('month', d) + INTERVAL 1 MONTH - INTERVAL 1 MILLISECOND AS eom,
       date_trunc('year', d) AS soy,
       CAST(floor((epoch_ms(plus1m) - epoch_ms(d)) / 86400000) AS BIGINT) AS days_to_plus1m,
       (year(plus1m) - year(d)) * 12 + month(plus1m) - month(d) AS months_to_plus1m,
       CAST(floor((epoch_ms(plus45d) - epoch_ms(d)) / 604800000) AS BIGINT) AS weeks_to_plus45d,
       year(minus1y) - year(d) AS years_back
FROM d
"""


def map_event_times(spark, sf_dir):
    steps = [
        step(1, "map", source="events", output="_temp_e1", mappings=[
            mp("stamp", _date("format", "ts", format="YYYY-MM-DD HH:mm:ss")),
            mp("later", _date("add", "ts", amount=90, unit="minute")),
            mp("hour_start", _date("startOf", "ts", unit="hour")),
            mp("day_end", _date("endOf", "ts", unit="day")),
            mp("sec_end", _date("endOf", "ts", unit="second")),
            mp("t", fld("ts")),
        ]),
        step(2, "map", source="_temp_e1", output="out", includeOriginal=True, mappings=[
            mp("mins", _date("diff", "t", compareTo="later", unit="minute")),
            mp("secs_left", _date("diff", "t", compareTo="day_end", unit="second")),
            mp("hours_back", _date("diff", "t", compareTo="hour_start", unit="hour")),
        ]),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["events"]).drop("t")


MAP_EVENT_TIMES_SQL = """
SELECT event_id,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
       ts + INTERVAL 90 MINUTE AS later,
       date_trunc('hour', ts) AS hour_start,
       date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS day_end,
       date_trunc('second', ts) + INTERVAL 999 MILLISECOND AS sec_end,
       CAST(90 AS BIGINT) AS mins,
       CAST(floor((epoch_ms(date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND) - floor(epoch_us(ts) / 1000)) / 1000) AS BIGINT) AS secs_left,
       CAST(floor((epoch_ms(date_trunc('hour', ts)) - floor(epoch_us(ts) / 1000)) / 3600000) AS BIGINT) AS hours_back
FROM events
"""


def _arr(op, path, **kw):
    return {"type": "array", "operation": op, "path": path, **kw}


def map_arrays(spark, sf_dir):
    steps = [
        step(1, "map", source="pages", output="_temp_p", mappings=[
            mp("parts", _str("split", "url", separator="/"))]),
        step(2, "map", source="_temp_p", output="out", mappings=[
            mp("n", _arr("length", "parts")),
            mp("first", _arr("first", "parts")),
            mp("last", _arr("last", "parts")),
            mp("third", _arr("at", "parts", index=2)),
            mp("neg", _arr("at", "parts", index=-1)),
            mp("middle", _arr("slice", "parts", start=1, end=-1)),
            mp("tail2", _arr("slice", "parts", start=-2)),
            mp("joined", _arr("join", "parts", separator="|")),
            mp("has_en", _arr("includes", "parts", value="en")),
            mp("not_array", _arr("length", "page_id")),
        ]),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["pages"])


MAP_ARRAYS_SQL = """
WITH p AS (SELECT page_id, string_split(url, '/') AS parts FROM pages)
SELECT page_id,
       len(parts) AS n,
       parts[1] AS first,
       parts[len(parts)] AS last,
       parts[3] AS third,
       CAST(NULL AS VARCHAR) AS neg,
       parts[2:len(parts) - 1] AS middle,
       parts[greatest(len(parts) - 1, 1):] AS tail2,
       array_to_string(parts, '|') AS joined,
       list_contains(parts, 'en') AS has_en,
       0::BIGINT AS not_array
FROM p
"""


# -- joins and lookups (J1-J3) ------------------------------------------------------

def join_left_collision(spark, sf_dir):
    steps = [
        step(1, "map", source="customer", output="_temp_c", mappings=[
            mp("name", fld("c_name")), mp("nation", fld("c_nationkey")), mp("bal", fld("c_acctbal"))]),
        step(2, "map", source="supplier", output="_temp_s", mappings=[
            mp("name", fld("s_name")), mp("nation", fld("s_nationkey")), mp("bal", fld("s_acctbal"))]),
        step(3, "join", left="_temp_c", right="_temp_s", type="left", output="out",
             on=[{"leftField": "nation", "rightField": "nation"}]),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["customer", "supplier"])


JOIN_LEFT_COLLISION_SQL = """
WITH c AS (SELECT c_custkey, c_name AS name, c_nationkey AS nation, c_acctbal AS bal FROM customer),
     s AS (SELECT s_suppkey, s_name AS name, s_nationkey AS nation, s_acctbal AS bal FROM supplier)
SELECT CASE WHEN s.s_suppkey IS NOT NULL THEN s.name ELSE c.name END AS name,
       CASE WHEN s.s_suppkey IS NOT NULL THEN s.nation ELSE c.nation END AS nation,
       CASE WHEN s.s_suppkey IS NOT NULL THEN s.bal ELSE c.bal END AS bal,
       c.c_custkey AS left_id, s.s_suppkey AS right_id
FROM c LEFT JOIN s ON c.nation IS NOT DISTINCT FROM s.nation
"""


def join_full(spark, sf_dir):
    steps = [
        step(1, "join", left="supplier", right="customer", type="full", output="out",
             on=[{"leftField": "s_nationkey", "rightField": "c_nationkey"}]),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["customer", "supplier"])


JOIN_FULL_SQL = """
WITH s AS (SELECT * FROM supplier), c AS (SELECT * FROM customer)
SELECT s.s_name, s.s_nationkey, s.s_acctbal, s.s_suppkey AS left_id,
       c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment, c.c_custkey AS right_id
FROM s FULL OUTER JOIN c ON s.s_nationkey IS NOT DISTINCT FROM c.c_nationkey
"""


def join_right_prefix(spark, sf_dir):
    steps = [
        step(1, "join", left="orders", right="customer", type="right", output="out",
             on=[{"leftField": "o_custkey", "rightField": "c_custkey"}],
             prefix={"left": "ord_", "right": "cus_"},
             select={"left": ["o_totalprice", "o_orderstatus"], "right": ["c_name", "c_mktsegment"]}),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["orders", "customer"])


JOIN_RIGHT_PREFIX_SQL = """
SELECT o.o_totalprice AS ord_o_totalprice, o.o_orderstatus AS ord_o_orderstatus, o.o_orderkey AS ord_id,
       c.c_name AS cus_c_name, c.c_mktsegment AS cus_c_mktsegment, c.c_custkey AS cus_id
FROM orders o RIGHT JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey
"""


def join_null_keys(spark, sf_dir):
    steps = [
        step(1, "map", source="orders", output="_temp_m", mappings=_PRIO_MAP),
        step(2, "aggregate", source="_temp_m", output="_temp_g", groupBy=["prio"],
             aggregations=[{"field": "*", "function": "count", "as": "n"},
                           {"field": "total", "function": "avg", "as": "avg_total"}]),
        step(3, "join", left="_temp_m", right="_temp_g", type="inner", output="out",
             on=[{"leftField": "prio", "rightField": "prio"}]),
    ]
    return _round(run_steps(spark, sf_dir, steps, "out", ["orders"]), avg_total=6)


JOIN_NULL_KEYS_SQL = f"""
WITH m AS {_PRIO_SQL},
     g AS (SELECT prio, count(*) AS n, avg(total) AS avg_total FROM m GROUP BY prio)
SELECT g.prio AS prio, m.total, m.o_orderkey AS left_id, g.n, round(g.avg_total, 6) AS avg_total
FROM m JOIN g ON m.prio IS NOT DISTINCT FROM g.prio
"""


def lookup_single(spark, sf_dir):
    steps = [step(1, "lookup", source="customer", **{"from": "orders"}, localField="c_custkey",
                  foreignField="o_custkey", **{"as": "first_order"}, output="out")]
    df = run_steps(spark, sf_dir, steps, "out", ["customer", "orders"])
    return df.select("c_custkey", "c_name", F.col("first_order.o_orderkey").alias("first_orderkey"),
                     F.col("first_order.o_totalprice").alias("first_total"))


LOOKUP_SINGLE_SQL = """
SELECT c.c_custkey, c.c_name, f.k AS first_orderkey, f.t AS first_total
FROM customer c LEFT JOIN (
  SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS k, arg_min(o_totalprice, o_orderkey) AS t
  FROM orders GROUP BY o_custkey) f ON c.c_custkey = f.o_custkey
"""


def lookup_many(spark, sf_dir):
    steps = [step(1, "lookup", source="customer", **{"from": "orders"}, localField="c_custkey",
                  foreignField="o_custkey", **{"as": "orders"}, multiple=True, output="out")]
    df = run_steps(spark, sf_dir, steps, "out", ["customer", "orders"])
    return df.select("c_custkey", F.size("orders").cast("long").alias("n_orders"),
                     F.transform("orders", lambda o: o["o_orderkey"]).alias("order_keys"),
                     F.round(F.aggregate("orders", F.lit(0.0), lambda acc, o: acc + o["o_totalprice"]), 2)
                     .alias("order_total"))


LOOKUP_MANY_SQL = """
SELECT c.c_custkey, coalesce(len(l.keys), 0) AS n_orders, coalesce(l.keys, []::BIGINT[]) AS order_keys,
       round(coalesce(l.total, 0.0), 2) AS order_total
FROM customer c LEFT JOIN (
  SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys, sum(o_totalprice) AS total
  FROM orders GROUP BY o_custkey) l ON c.c_custkey = l.o_custkey
"""


# -- aggregates (A1-A7) ---------------------------------------------------------------

def agg_all_functions(spark, sf_dir):
    steps = [step(1, "aggregate", source="lineitem", output="out", groupBy=["l_returnflag", "l_linestatus"],
                  aggregations=[
                      {"field": "l_quantity", "function": "sum", "as": "sum_qty"},
                      {"field": "l_extendedprice", "function": "avg", "as": "avg_price"},
                      {"field": "l_discount", "function": "min", "as": "min_disc"},
                      {"field": "l_tax", "function": "max", "as": "max_tax"},
                      {"field": "*", "function": "count", "as": "n"},
                      {"field": "l_orderkey", "function": "countDistinct", "as": "n_orders"},
                      {"field": "l_shipdate", "function": "sum", "as": "date_sum"},
                      {"field": "l_returnflag", "function": "min", "as": "text_min"},
                      {"field": "l_partkey", "function": "first", "as": "first_part"},
                      {"field": "l_partkey", "function": "last", "as": "last_part"},
                  ])]
    return _round(run_steps(spark, sf_dir, steps, "out", ["lineitem"]), sum_qty=2, avg_price=6)


_LI_ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"

AGG_ALL_FUNCTIONS_SQL = f"""
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price,
       min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(*) AS n,
       count(DISTINCT l_orderkey) AS n_orders, NULL::DOUBLE AS date_sum, NULL::DOUBLE AS text_min,
       arg_min(l_partkey, ({_LI_ORDER})) AS first_part, arg_max(l_partkey, ({_LI_ORDER})) AS last_part
FROM lineitem GROUP BY l_returnflag, l_linestatus
"""


def agg_having(spark, sf_dir):
    steps = [step(1, "aggregate", source="lineitem", output="out", groupBy=["l_suppkey"],
                  aggregations=[{"field": "l_quantity", "function": "sum", "as": "qty"},
                                {"field": "*", "function": "count", "as": "n"}],
                  having=[cond("qty", "gt", 15000), cond("n", "gte", 600), cond("l_suppkey", "ne", 7)])]
    return run_steps(spark, sf_dir, steps, "out", ["lineitem"])


AGG_HAVING_SQL = """
SELECT l_suppkey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY l_suppkey
HAVING sum(l_quantity) > 15000 AND count(*) >= 600 AND l_suppkey IS DISTINCT FROM 7
"""


def agg_first_last_collect(spark, sf_dir):
    steps = [step(1, "aggregate", source="conversations", output="out", groupBy=["conv_id"],
                  aggregations=[{"field": "role", "function": "first", "as": "first_role"},
                                {"field": "role", "function": "last", "as": "last_role"},
                                {"field": "role", "function": "collect", "as": "roles"},
                                {"field": "turn", "function": "collect", "as": "turns"},
                                {"field": "*", "function": "count", "as": "n_turns"}])]
    return run_steps(spark, sf_dir, steps, "out", ["conversations"])


AGG_FIRST_LAST_COLLECT_SQL = """
SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role,
       list(role ORDER BY turn) AS roles, list(turn ORDER BY turn) AS turns, count(*) AS n_turns
FROM conversations GROUP BY conv_id
"""


def agg_global(spark, sf_dir):
    steps = [step(1, "aggregate", source="events", output="out", groupBy=[],
                  aggregations=[{"field": "*", "function": "count", "as": "n"},
                                {"field": "value", "function": "sum", "as": "total"},
                                {"field": "user_id", "function": "countDistinct", "as": "users"},
                                {"field": "event_type", "function": "first", "as": "first_type"},
                                {"field": "event_type", "function": "last", "as": "last_type"}])]
    return _round(run_steps(spark, sf_dir, steps, "out", ["events"]), total=2)


AGG_GLOBAL_SQL = """
SELECT count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users,
       arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type
FROM events
"""


def agg_global_empty(spark, sf_dir):
    steps = [
        step(1, "filter", source="events", output="_temp_none", conditions=[cond("value", "gt", 1e12)]),
        step(2, "aggregate", source="_temp_none", output="out", groupBy=[],
             aggregations=[{"field": "*", "function": "count", "as": "n"},
                           {"field": "value", "function": "sum", "as": "total"}]),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["events"])


AGG_GLOBAL_EMPTY_SQL = """
SELECT count(*) AS n, sum(value) AS total FROM events WHERE value > 1e12 HAVING count(*) > 0
"""


# -- pivot / unpivot (A14 A15) -----------------------------------------------------------

def pivot_sum(spark, sf_dir):
    steps = [step(1, "pivot", source="lineitem", output="out", groupBy=["l_returnflag"],
                  pivotField="l_linestatus", valueField="l_quantity", aggregation="sum")]
    return run_steps(spark, sf_dir, steps, "out", ["lineitem"])


PIVOT_SUM_SQL = """
SELECT l_returnflag,
       CASE WHEN count(*) FILTER (WHERE l_linestatus = 'F') > 0 THEN sum(l_quantity) FILTER (WHERE l_linestatus = 'F') END AS "F",
       CASE WHEN count(*) FILTER (WHERE l_linestatus = 'O') > 0 THEN sum(l_quantity) FILTER (WHERE l_linestatus = 'O') END AS "O"
FROM lineitem GROUP BY l_returnflag
"""


def pivot_count(spark, sf_dir):
    steps = [step(1, "pivot", source="orders", output="out", groupBy=["o_orderpriority"],
                  pivotField="o_orderstatus", valueField="o_orderkey", aggregation="count",
                  values=["F", "O", "P", "X"])]
    return run_steps(spark, sf_dir, steps, "out", ["orders"])


PIVOT_COUNT_SQL = """
SELECT o_orderpriority,
       CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN count(*) FILTER (WHERE o_orderstatus = 'F') END AS "F",
       CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN count(*) FILTER (WHERE o_orderstatus = 'O') END AS "O",
       CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN count(*) FILTER (WHERE o_orderstatus = 'P') END AS "P",
       CAST(NULL AS BIGINT) AS "X"
FROM orders GROUP BY o_orderpriority
"""


def unpivot(spark, sf_dir):
    steps = [step(1, "unpivot", source="part", output="out", idFields=["p_partkey"],
                  unpivotFields=["p_size", "p_retailprice"], nameField="attr", valueField="val")]
    return run_steps(spark, sf_dir, steps, "out", ["part"])


UNPIVOT_SQL = """
SELECT p_partkey, 'p_size' AS attr, CAST(p_size AS DOUBLE) AS val FROM part
UNION ALL
SELECT p_partkey, 'p_retailprice' AS attr, p_retailprice AS val FROM part
"""


# -- sort / limit / dedupe / union / flatten (O D U X) --------------------------------------

def sort_limit_nulls(spark, sf_dir):
    steps = [
        step(1, "map", source="orders", output="_temp_m", mappings=_PRIO_MAP),
        step(2, "sort", source="_temp_m", output="_temp_s",
             orderBy=[{"field": "prio", "direction": "desc", "nulls": "first"},
                      {"field": "total", "direction": "desc"}]),
        step(3, "limit", source="_temp_s", output="out", limit=15),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["orders"])


SORT_LIMIT_NULLS_SQL = f"""
SELECT o_orderkey, prio, total FROM {_PRIO_SQL} m
ORDER BY prio DESC NULLS FIRST, total DESC NULLS LAST, o_orderkey LIMIT 15
"""


def limit_offset(spark, sf_dir):
    steps = [
        step(1, "sort", source="orders", output="_temp_s", orderBy=[{"field": "o_totalprice", "direction": "desc"}]),
        step(2, "limit", source="_temp_s", output="out", limit=25, offset=10),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["orders"])


LIMIT_OFFSET_SQL = """
SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10
"""


def limit_distributed(spark, sf_dir):
    """A slice of all line items, from sorted ranges instead of one top-k."""
    steps = [
        step(1, "sort", source="lineitem", output="_temp_s", orderBy=[{"field": "l_extendedprice", "direction": "desc"}, {"field": "l_shipdate"}]),
        step(2, "limit", source="_temp_s", output="out", limit=20_000, offset=15_000, distributed=True),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["lineitem"]).select("l_orderkey", "l_linenumber", "l_extendedprice")


LIMIT_DISTRIBUTED_SQL = """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_shipdate, l_orderkey, l_linenumber LIMIT 20000 OFFSET 15000
"""


def dedupe_first(spark, sf_dir):
    steps = [step(1, "deduplicate", source="events", output="out", keys=["user_id"], keep="first",
                  orderBy={"field": "ts", "direction": "asc"})]
    return run_steps(spark, sf_dir, steps, "out", ["events"])


DEDUPE_FIRST_SQL = """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1
"""


def dedupe_last(spark, sf_dir):
    steps = [step(1, "deduplicate", source="events", output="out", keys=["event_type", "user_id"], keep="last",
                  orderBy={"field": "value", "direction": "asc"})]
    return run_steps(spark, sf_dir, steps, "out", ["events"])


DEDUPE_LAST_SQL = """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
"""


def dedupe_text_desc(spark, sf_dir):
    steps = [step(1, "deduplicate", source="events", output="out", keys=["user_id"], keep="first",
                  orderBy={"field": "event_type", "direction": "desc"})]
    return run_steps(spark, sf_dir, steps, "out", ["events"])


DEDUPE_TEXT_DESC_SQL = """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, event_id) AS rn FROM events)
WHERE rn = 1
"""


def union_all(spark, sf_dir):
    steps = [
        step(1, "filter", source="orders", output="_temp_f", conditions=[cond("o_orderstatus", "eq", "F")]),
        step(2, "filter", source="orders", output="_temp_p", conditions=[cond("o_orderstatus", "eq", "P")]),
        step(3, "union", sources=["_temp_f", "_temp_p"], mode="all", output="out"),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["orders"])


UNION_ALL_SQL = """
SELECT * FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT * FROM orders WHERE o_orderstatus = 'P'
"""


def union_distinct(spark, sf_dir):
    """The first order of every customer, and the customers that have none."""
    steps = [
        step(1, "map", source="orders", output="_temp_o", mappings=[mp("key", fld("o_custkey")), mp("amount", fld("o_totalprice"))]),
        step(2, "map", source="customer", output="_temp_c", mappings=[mp("key", fld("c_custkey")), mp("amount", fld("c_acctbal"))]),
        step(3, "union", sources=["_temp_o", "_temp_c"], mode="distinct", distinctKeys=["key"], output="out"),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["customer", "orders"])


UNION_DISTINCT_SQL = """
WITH u AS (
  SELECT o_orderkey, NULL::BIGINT AS c_custkey, o_custkey AS key, o_totalprice AS amount, 0 AS src, o_orderkey AS ord FROM orders
  UNION ALL
  SELECT NULL::BIGINT, c_custkey, c_custkey, c_acctbal, 1, c_custkey FROM customer)
SELECT o_orderkey, c_custkey, key, amount FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY src, ord) AS rn FROM u) WHERE rn = 1
"""


def flatten(spark, sf_dir):
    steps = [step(1, "flatten", source="embeddings", output="out", field="embedding")]
    return run_steps(spark, sf_dir, steps, "out", ["embeddings"])


FLATTEN_SQL = """
SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(embedding) AS embedding
FROM embeddings
"""


def flatten_words(spark, sf_dir):
    """Whole-document word split then flatten (keeps empty docs with NULL)."""
    steps = [
        step(1, "map", source="documents", output="_temp_w", mappings=[
            mp("words", _str("split", "text", separator=" ")), mp("source", fld("source"))]),
        step(2, "flatten", source="_temp_w", output="out", field="words", **{"as": "ch"}, preserveEmpty=True),
    ]
    df = run_steps(spark, sf_dir, steps, "out", ["documents"])
    return df.drop("words")


FLATTEN_WORDS_SQL = """
SELECT doc_id, source, CAST(generate_subscripts(string_split(text, ' '), 1) - 1 AS INTEGER) AS pos,
       unnest(string_split(text, ' ')) AS ch
FROM documents
"""


QUERIES = {
    "sales_by_nation": sales_by_nation,
    "filter_and_or": filter_and_or,
    "filter_null_safe_ne": filter_null_safe_ne,
    "filter_in_notin": filter_in_notin,
    "filter_regex": filter_regex,
    "filter_strings": filter_strings,
    "map_math": map_math,
    "map_strings": map_strings,
    "map_concat_template": map_concat_template,
    "map_conditional": map_conditional,
    "map_dates": map_dates,
    "map_event_times": map_event_times,
    "map_arrays": map_arrays,
    "join_left_collision": join_left_collision,
    "join_full": join_full,
    "join_right_prefix": join_right_prefix,
    "join_null_keys": join_null_keys,
    "lookup_single": lookup_single,
    "lookup_many": lookup_many,
    "agg_all_functions": agg_all_functions,
    "agg_having": agg_having,
    "agg_first_last_collect": agg_first_last_collect,
    "agg_global": agg_global,
    "agg_global_empty": agg_global_empty,
    "pivot_sum": pivot_sum,
    "pivot_count": pivot_count,
    "unpivot": unpivot,
    "sort_limit_nulls": sort_limit_nulls,
    "limit_offset": limit_offset,
    "limit_distributed": limit_distributed,
    "dedupe_first": dedupe_first,
    "dedupe_last": dedupe_last,
    "dedupe_text_desc": dedupe_text_desc,
    "union_all": union_all,
    "union_distinct": union_distinct,
    "flatten": flatten,
    "flatten_words": flatten_words,
}

ORACLE = {k: globals()[k.upper() + "_SQL"] for k in QUERIES}
