"""Registered queries for filter trees, relation filters, storage aggregates,
reports and the execution-log query."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators.query import find_all, flatten_struct_columns, storage_aggregate
from ..plans.reports import execute_report, list_executions
from ..sources.catalog import test_catalog


def _cat(spark, sf_dir, *tables):
    return test_catalog(spark, sf_dir, tables)


# -- filter trees (P10-P12) ------------------------------------------------------------

def storage_filter_tree(spark, sf_dir):
    cat = _cat(spark, sf_dir, "orders")
    flt = {"or": [
        {"and": [{"o_orderstatus": {"eq": "F"}}, {"o_totalprice": {"gt": 450000}}]},
        {"o_orderpriority": {"in": ["1-URGENT", "2-HIGH"]}, "o_totalprice": {"lt": 20000}},
        # two operators in one object: only the first in chain order (gt) applies
        {"o_orderstatus": {"eq": "P"}, "o_totalprice": {"lte": 5000, "gt": 498000}},
        {"or": []},  # an empty or is false
    ]}
    return find_all(cat, "orders", flt)


STORAGE_FILTER_TREE_SQL = """
SELECT * FROM orders
WHERE (o_orderstatus = 'F' AND o_totalprice > 450000)
   OR (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice < 20000)
   OR (o_orderstatus = 'P' AND o_totalprice > 498000)
"""


def date_between(spark, sf_dir):
    cat = _cat(spark, sf_dir, "orders")
    flt = {"and": [
        {"o_orderdate": {"between": ["1996-01-01T00:00:00Z", "1996-12-31T00:00:00Z"]}},
        {"or": [{"o_orderdate": {"before": "1996-03-01T00:00:00Z"}},
                {"o_orderdate": {"after": "1996-11-01T00:00:00Z"}}]},
        {"o_orderpriority": {"nin": ["5-LOW"]}},
        {"or": [{"o_orderstatus": {"before": "2000-01-01"}},  # text never matches a date operator
                {"and": []}]},  # an empty and is true
    ]}
    return find_all(cat, "orders", flt)


DATE_BETWEEN_SQL = """
SELECT * FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
  AND (o_orderdate < TIMESTAMP '1996-03-01' OR o_orderdate > TIMESTAMP '1996-11-01')
  AND o_orderpriority NOT IN ('5-LOW')
"""


# -- relation filters (J4-J8) ------------------------------------------------------------

def rel_forward(spark, sf_dir):
    cat = _cat(spark, sf_dir, "orders", "customer", "nation", "region")
    flt = {"o_totalprice": {"gt": 100000},
           "o_custkey": {"c_mktsegment": {"eq": "BUILDING"},
                         "c_nationkey": {"n_regionkey": {"r_name": {"eq": "ASIA"}}}}}
    return find_all(cat, "orders", flt)


REL_FORWARD_SQL = """
SELECT * FROM orders o
WHERE o.o_totalprice > 100000 AND EXISTS (
  SELECT 1 FROM customer c
  WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING' AND EXISTS (
    SELECT 1 FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
    WHERE n.n_nationkey = c.c_nationkey AND r.r_name = 'ASIA'))
"""


def _baskets(cat):
    li = cat.get("lineitem")
    baskets = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("part_ids"))
    cat.register("baskets", baskets, order_key=("l_orderkey",), id_col="l_orderkey",
                 relations={"part_ids": ("part", True)})
    return cat


def rel_array_fk(spark, sf_dir):
    """Orders (as baskets of part keys) holding at least one large promo part."""
    cat = _baskets(_cat(spark, sf_dir, "lineitem", "part"))
    return find_all(cat, "baskets", {"part_ids": {"p_type": {"eq": "PROMO"}, "p_size": {"gte": 48}}})


REL_ARRAY_FK_SQL = """
WITH b AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS part_ids FROM lineitem GROUP BY l_orderkey)
SELECT * FROM b WHERE EXISTS (
  SELECT 1 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  WHERE l.l_orderkey = b.l_orderkey AND p.p_type = 'PROMO' AND p.p_size >= 48)
"""


def rel_some(spark, sf_dir):
    cat = _cat(spark, sf_dir, "customer", "orders")
    return find_all(cat, "customer", {"orders": {"some": {"o_orderstatus": {"eq": "P"},
                                                          "o_totalprice": {"gt": 450000}}}})


REL_SOME_SQL = """
SELECT * FROM customer c WHERE EXISTS (
  SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 450000)
"""


def rel_none(spark, sf_dir):
    cat = _cat(spark, sf_dir, "customer", "orders")
    return find_all(cat, "customer", {"orders": {"none": {"o_orderpriority": {"eq": "1-URGENT"}}}})


REL_NONE_SQL = """
SELECT * FROM customer c WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
"""


def rel_every(spark, sf_dir):
    cat = _cat(spark, sf_dir, "customer", "orders")
    return find_all(cat, "customer", {"orders": {"every": {"o_totalprice": {"gt": 60000}}}})


REL_EVERY_SQL = """
SELECT * FROM customer c WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND NOT coalesce(o.o_totalprice > 60000, false))
"""


def rel_or_tree(spark, sf_dir):
    cat = _cat(spark, sf_dir, "customer", "orders", "nation")
    flt = {"or": [
        {"orders": {"some": {"o_totalprice": {"gt": 495000}}}},
        {"c_nationkey": {"n_name": {"eq": "NATION_7"}}},
        {"c_acctbal": {"lt": -900}},
        {"and": [{"c_mktsegment": {"eq": "FURNITURE"}}, {"orders": {"every": {"o_orderstatus": {"ne": "P"}}}}]},
    ]}
    return find_all(cat, "customer", flt)


REL_OR_TREE_SQL = """
SELECT * FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 495000)
   OR EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_name = 'NATION_7')
   OR c.c_acctbal < -900
   OR (c.c_mktsegment = 'FURNITURE'
       AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'))
"""


# -- storage aggregates (A8-A13) ---------------------------------------------------------

def storage_agg(spark, sf_dir):
    cat = _cat(spark, sf_dir, "orders")
    df = storage_aggregate(cat, "orders", {
        "filter": {"o_orderstatus": {"ne": "P"}},
        "groupBy": ["o_orderpriority"],
        "select": {"o_orderpriority": True, "_count": True, "o_custkey": True,
                   "o_totalprice": {"sum": True, "avg": True, "max": True},
                   "o_orderstatus": {"min": True}},
        "having": {"_count": {"gt": 1900}, "o_totalprice": {"avg": {"gt": 240000}, "min": {"gt": 1e9}}},
    })
    df = flatten_struct_columns(df)
    return df.select(*[F.round(c, 2).alias(c) if c in ("o_totalprice_sum", "o_totalprice_avg") else c
                       for c in df.columns])


STORAGE_AGG_SQL = """
SELECT o_orderpriority, count(*) AS _count, arg_min(o_custkey, o_orderkey) AS o_custkey,
       round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 2) AS o_totalprice_avg,
       max(o_totalprice) AS o_totalprice_max, 0.0::DOUBLE AS o_orderstatus_min
FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'
GROUP BY o_orderpriority
HAVING count(*) > 1900 AND avg(o_totalprice) > 240000
"""


def storage_agg_empty_zero(spark, sf_dir):
    cat = _cat(spark, sf_dir, "orders")
    df = storage_aggregate(cat, "orders", {
        "filter": {"o_totalprice": {"lt": 0}},
        "select": {"_count": True, "o_totalprice": {"sum": True, "avg": True, "min": True}, "o_custkey": True},
    })
    return flatten_struct_columns(df)


STORAGE_AGG_EMPTY_ZERO_SQL = """
SELECT count(*) AS _count, coalesce(sum(o_totalprice), 0.0) AS o_totalprice_sum,
       coalesce(avg(o_totalprice), 0.0) AS o_totalprice_avg, coalesce(min(o_totalprice), 0.0) AS o_totalprice_min,
       arg_min(o_custkey, o_orderkey) AS o_custkey
FROM orders WHERE o_totalprice < 0
"""


# -- reports (R6 R7) and the execution log (R9) --------------------------------------------

def report_execute(spark, sf_dir):
    """Top-of-table report: filter, first 200 rows in table order, dotted projection."""
    cat = _cat(spark, sf_dir, "customer")
    rep = {"id": "r1", "collection": "customer", "limit": 200,
           "filter": {"c_mktsegment": {"in": ["AUTOMOBILE", "MACHINERY"]}, "c_acctbal": {"gt": 1000}},
           "columns": [{"field": "c_custkey", "label": "Key"}, {"field": "c_name", "label": "Name"},
                       {"field": "c_acctbal", "label": "Balance", "format": "currency"},
                       {"field": "c_missing.deep", "label": "Missing"}]}
    return execute_report(cat, rep).data


REPORT_EXECUTE_SQL = """
SELECT c_custkey, c_name, c_acctbal, NULL AS "c_missing.deep" FROM customer
WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') AND c_acctbal > 1000
ORDER BY c_custkey LIMIT 200
"""


def report_aggregate(spark, sf_dir):
    cat = _cat(spark, sf_dir, "customer")
    rep = {"id": "r2", "collection": "customer", "limit": 5, "filter": {"c_acctbal": {"lt": 0}},
           "aggregation": {"filter": {"c_acctbal": {"gte": 0}}, "groupBy": ["c_mktsegment"],
                           "select": {"c_mktsegment": True, "_count": True, "c_acctbal": {"avg": True, "max": True}},
                           "having": {"_count": {"gte": 1}}}}
    df = flatten_struct_columns(execute_report(cat, rep).data)
    return df.select("c_mktsegment", "_count", F.round("c_acctbal_avg", 4).alias("c_acctbal_avg"), "c_acctbal_max")


REPORT_AGGREGATE_SQL = """
SELECT c_mktsegment, count(*) AS _count, round(avg(c_acctbal), 4) AS c_acctbal_avg, max(c_acctbal) AS c_acctbal_max
FROM customer WHERE c_acctbal >= 0 GROUP BY c_mktsegment
"""


def execution_log(spark, sf_dir):
    """Events as an execution log: status set and an exclusive time window."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("workflowId"),
        F.col("event_type").alias("status"), F.col("ts").alias("startedAt"))
    return list_executions(log, status=["error", "purchase"],
                           started_after=dt.datetime(2024, 1, 5), started_before=dt.datetime(2024, 1, 20))


EXECUTION_LOG_SQL = """
SELECT event_id AS id, user_id AS "workflowId", event_type AS status, ts AS "startedAt" FROM events
WHERE event_type IN ('error', 'purchase') AND ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'
"""


QUERIES = {
    "storage_filter_tree": storage_filter_tree,
    "date_between": date_between,
    "rel_forward": rel_forward,
    "rel_array_fk": rel_array_fk,
    "rel_some": rel_some,
    "rel_none": rel_none,
    "rel_every": rel_every,
    "rel_or_tree": rel_or_tree,
    "storage_agg": storage_agg,
    "storage_agg_empty_zero": storage_agg_empty_zero,
    "report_execute": report_execute,
    "report_aggregate": report_aggregate,
    "execution_log": execution_log,
}

ORACLE = {k: globals()[k.upper() + "_SQL"] for k in QUERIES}
