"""Registered queries: audiences and messages, rule routing, execution
statistics, keyed-table maintenance and schema validation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import tables
from ..operators.audience import extract_variables as extract_vars
from ..operators.audience import preview, render_column, run_campaign
from ..operators.history import history_stats
from ..operators.pricing.codes import record_usage, usage_counts, usage_of
from ..operators.rules import route
from ..sources.catalog import test_catalog

SENT_AT = dt.datetime(2024, 2, 1)


def _contacts(spark, sf_dir):
    cat = test_catalog(spark, sf_dir, ("customer",))
    c = cat.get("customer")
    email = F.when(F.col("c_acctbal") > 0,
                   F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")))
    cat.register("contacts", c.withColumn("email", email), order_key=("c_custkey",), id_col="c_custkey")
    return cat


_CONTACTS_SQL = """contacts AS (
  SELECT *, CASE WHEN c_acctbal > 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS email
  FROM customer)"""

CAMPAIGN = {"id": "cmp1", "status": "active", "templateId": "t1",
            "entityConfig": {"collection": "contacts", "recipientField": "email",
                             "filter": {"c_mktsegment": {"in": ["BUILDING", "MACHINERY"]}}},
            "variableMappings": {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}}
TEMPLATE = {"id": "t1", "subject": "Hello {{name}}",
            "body": "Dear {{name}}, your balance is {{balance}} in {{segment}}. Code: {{code}}"}


def campaign_preview(spark, sf_dir):
    _, stats = preview(_contacts(spark, sf_dir), CAMPAIGN)
    return stats


CAMPAIGN_PREVIEW_SQL = f"""
WITH {_CONTACTS_SQL}
SELECT count(*) AS total, count(email) AS recipients, count(*) FILTER (WHERE email IS NULL) AS skipped
FROM contacts WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
"""

_JS_BAL = ("CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) "
           "ELSE CAST(c_acctbal AS VARCHAR) END")


def render_messages(spark, sf_dir):
    msgs, _ = run_campaign(_contacts(spark, sf_dir), CAMPAIGN, TEMPLATE, sent_at=SENT_AT)
    return msgs


RENDER_MESSAGES_SQL = f"""
WITH {_CONTACTS_SQL}
SELECT 't1' AS "templateId", email AS recipient, 'Hello ' || c_name AS subject,
       'Dear ' || c_name || ', your balance is ' || {_JS_BAL} || ' in ' || c_mktsegment || '. Code: {{{{code}}}}' AS body,
       'sent' AS status, TIMESTAMP '2024-02-01' AS "createdAt"
FROM contacts WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND email IS NOT NULL
"""


def extract_variables(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    t = c.select("c_custkey", "c_name",
                 F.concat(F.lit("{{greeting}} "), F.col("c_name")).alias("subject"),
                 F.concat(F.lit("Dear {{name}}, your {{segment_"), F.lower("c_mktsegment"),
                          F.lit("}} offer: {{code}} ({{name}})")).alias("body"))
    variables = F.create_map(F.lit("name"), F.col("c_name"))
    return t.select("c_custkey", extract_vars(F.col("subject"), F.col("body")).alias("variables"),
                    render_column(F.col("body"), variables).alias("rendered"))


EXTRACT_VARIABLES_SQL = r"""
WITH t AS (
  SELECT c_custkey, c_name, '{{greeting}} ' || c_name AS subject,
         'Dear {{name}}, your {{segment_' || lower(c_mktsegment) || '}} offer: {{code}} ({{name}})' AS body
  FROM customer),
v AS (SELECT *, regexp_extract_all(subject || ' ' || body, '\{\{(\w+)\}\}', 1) AS l FROM t)
SELECT c_custkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS variables,
       replace(body, '{{name}}', c_name) AS rendered
FROM v
"""

WORKFLOW = {
    "id": "wf1", "startStepId": "s_big",
    "steps": [
        {"id": "s_big", "type": "condition",
         "condition": {"type": "compare", "left": {"type": "field", "path": "o_totalprice"}, "operator": ">",
                       "right": {"type": "constant", "value": 300000}},
         "onTrue": "s_urgent", "onFalse": "s_pending"},
        {"id": "s_urgent", "type": "condition",
         "condition": {"type": "and", "conditions": [
             {"type": "compare", "left": {"type": "field", "path": "o_orderpriority"}, "operator": "startsWith",
              "right": {"type": "constant", "value": "1"}},
             {"type": "exists", "collection": "lineitem",
              "filter": {"field": "l_orderkey", "operator": "==", "value": {"type": "field", "path": "o_orderkey"}}}]},
         "onTrue": "a_gold", "onFalse": "end_big"},
        {"id": "a_gold", "type": "action", "next": "end_vip",
         "action": {"type": "setContext", "values": {"tier": {"type": "constant", "value": "gold"},
                                                     "was": {"type": "field", "path": "o_orderpriority"}}}},
        {"id": "s_pending", "type": "condition",
         "condition": {"type": "compare", "left": {"type": "field", "path": "o_orderstatus"}, "operator": "==",
                       "right": {"type": "constant", "value": "P"}},
         "onTrue": "s_bigger", "onFalse": None},
        {"id": "s_bigger", "type": "condition",
         "condition": {"type": "exists", "collection": "orders",
                       "filter": {"field": "o_totalprice", "operator": ">",
                                  "value": {"type": "field", "path": "o_totalprice"}}},
         "onTrue": "end_review", "onFalse": "end_top"},
        {"id": "end_vip", "type": "end", "status": "completed"},
        {"id": "end_big", "type": "end"},
        {"id": "end_review", "type": "end", "status": "failed", "reason": "manual review"},
        {"id": "end_top", "type": "end", "status": "completed", "reason": "largest pending"},
    ],
}


def route_orders(spark, sf_dir):
    cat = test_catalog(spark, sf_dir, ("orders", "lineitem"))
    out = route(cat, cat.get("orders"), WORKFLOW)
    return out.select("o_orderkey", "outcome", "status", "reason", "path", "tier", "was")


ROUTE_ORDERS_SQL = """
WITH o AS (
  SELECT o.*, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS has_lines,
         o.o_totalprice < (SELECT max(o_totalprice) FROM orders) AS has_bigger
  FROM orders o),
r AS (
  SELECT o_orderkey, o_orderpriority,
    CASE WHEN o_totalprice > 300000 THEN (CASE WHEN starts_with(o_orderpriority, '1') AND has_lines THEN 1 ELSE 2 END)
         WHEN o_orderstatus = 'P' THEN (CASE WHEN has_bigger THEN 3 ELSE 4 END) ELSE 5 END AS k
  FROM o)
SELECT o_orderkey,
  CASE k WHEN 1 THEN 'end_vip' WHEN 2 THEN 'end_big' WHEN 3 THEN 'end_review' WHEN 4 THEN 'end_top' END AS outcome,
  CASE k WHEN 3 THEN 'failed' ELSE 'completed' END AS status,
  CASE k WHEN 3 THEN 'manual review' WHEN 4 THEN 'largest pending' END AS reason,
  CASE k WHEN 1 THEN ['s_big', 's_urgent', 'a_gold', 'end_vip'] WHEN 2 THEN ['s_big', 's_urgent', 'end_big']
         WHEN 3 THEN ['s_big', 's_pending', 's_bigger', 'end_review'] WHEN 4 THEN ['s_big', 's_pending', 's_bigger', 'end_top']
         ELSE ['s_big', 's_pending'] END AS path,
  CASE k WHEN 1 THEN 'gold' END AS tier,
  CASE k WHEN 1 THEN o_orderpriority END AS was
FROM r
"""


def _executions(spark, sf_dir):
    """Conversations as executions: a turn is an entry of the history of its conversation."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    status = F.element_at(F.array(*map(F.lit, ("started", "completed", "started", "failed", "started", "skipped", "completed"))), (F.col("turn") % 7 + 1).cast("int"))
    entry = F.struct("turn", F.concat(F.lit("s"), (F.col("turn") % 4).cast("string")).alias("stepId"), F.col("role").alias("stepType"), status.alias("status"),
                     F.timestamp_seconds(F.col("turn") * 60 + F.coalesce(F.length("text"), F.lit(0)) % 50).alias("timestamp"), F.length("text").cast("double").alias("durationMs"))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("history"))


def execution_stats(spark, sf_dir):
    """What each execution's history tells."""
    e = history_stats(_executions(spark, sf_dir))
    return e.select("conv_id", "entries", "started", "completed", "failed", "skipped", "retries", "totalMs", "longestGapMs", "currentStep", "lastStatus")


def execution_step_times(spark, sf_dir):
    """Time of every step of every execution."""
    return history_stats(_executions(spark, sf_dir)).select("conv_id", F.explode("stepMs").alias("step", "ms"))


_HISTORY_SQL = """
WITH e AS (
  SELECT conv_id, turn, 's' || CAST(turn % 4 AS VARCHAR) AS step, role,
         (['started', 'completed', 'started', 'failed', 'started', 'skipped', 'completed'])[turn % 7 + 1] AS status,
         (turn * 60 + coalesce(length(text), 0) % 50) * 1000.0::DOUBLE AS at_ms, CAST(length(text) AS DOUBLE) AS ms
  FROM conversations),
f AS (
  SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS gap,
         max(CASE WHEN status IN ('completed', 'failed', 'skipped') THEN turn END) OVER (PARTITION BY conv_id, step) AS closed
  FROM e)
"""

EXECUTION_STATS_SQL = _HISTORY_SQL + """
SELECT conv_id, count(*) AS entries, count(*) FILTER (status = 'started') AS started, count(*) FILTER (status = 'completed') AS completed,
       count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
       count(*) FILTER (status = 'started') - count(DISTINCT step) FILTER (status = 'started') AS retries,
       coalesce(sum(ms), 0.0) AS "totalMs", max(gap) AS "longestGapMs",
       arg_max(step, turn) FILTER (status = 'started' AND (closed IS NULL OR closed < turn)) AS "currentStep", arg_max(status, turn) AS "lastStatus"
FROM f GROUP BY conv_id
"""

EXECUTION_STEP_TIMES_SQL = _HISTORY_SQL + "SELECT conv_id, step, coalesce(sum(ms), 0.0) AS ms FROM e GROUP BY conv_id, step"


def _ledger(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.concat(F.lit("d"), (F.col("o_orderkey") % 20).cast("string")).alias("discountId"),
                    F.when(F.col("o_orderkey") % 11 > 0, F.col("o_custkey") % 50).alias("customerId"), F.col("o_orderkey").alias("orderId"))


def discount_usage(spark, sf_dir):
    """Uses of every discount by every customer, from a ledger of all orders."""
    return usage_counts(_ledger(spark, sf_dir))


DISCOUNT_USAGE_SQL = """
WITH u AS (SELECT 'd' || CAST(o_orderkey % 20 AS VARCHAR) AS "discountId", CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 50 END AS "customerId" FROM orders)
SELECT *, CAST(sum(uses) OVER (PARTITION BY "discountId") AS BIGINT) AS "discountUses"
FROM (SELECT "discountId", "customerId", count(*) AS uses FROM u GROUP BY 1, 2)
"""


def discount_current_usage(spark, sf_dir):
    """Discounts of all nations' numbers after the ledger, those without a use and the rows of two of them included."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    d = n.select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").cast("long").alias("currentUsage"))
    ledger = _ledger(spark, sf_dir)
    listed = usage_of(ledger, d.where("currentUsage in (3, 4)")).groupBy(F.col("discountId").alias("id")).agg(F.sum("orderId").alias("orders"))
    return record_usage(d, ledger).join(listed, "id", "left")


DISCOUNT_CURRENT_USAGE_SQL = """
SELECT 'd' || CAST(n_nationkey AS VARCHAR) AS id, CAST(n_nationkey + (SELECT count(*) FROM orders WHERE o_orderkey % 20 = n_nationkey) AS BIGINT) AS "currentUsage",
       CASE WHEN n_nationkey IN (3, 4) THEN (SELECT CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey % 20 = n_nationkey) END AS orders
FROM nation
"""

CUSTOMER_SCHEMA = {
    "type": "object",
    "properties": {
        "c_custkey": {"type": "integer"},
        "c_name": {"type": "string", "pattern": "^Customer#[0-9]{9}$"},
        "c_nationkey": {"type": "integer", "maximum": 20},
        "c_acctbal": {"type": "number", "minimum": 0, "maximum": 9000},
        "c_mktsegment": {"type": "string", "enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]},
    },
    "required": ["c_name", "c_acctbal"],
    "additionalProperties": False,
}


def validate_rows(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    checked = tables.validate(c, CUSTOMER_SCHEMA)
    return checked.where(F.size("errors") > 0).select(
        "c_custkey", "error", F.size("errors").cast("long").alias("n_errors"))


VALIDATE_ROWS_SQL = """
WITH v AS (
  SELECT c_custkey,
    CASE WHEN c_nationkey > 20 THEN 'data/c_nationkey must be <= 20' END AS e1,
    CASE WHEN c_acctbal < 0 THEN 'data/c_acctbal must be >= 0' END AS e2,
    CASE WHEN c_acctbal > 9000 THEN 'data/c_acctbal must be <= 9000' END AS e3,
    CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')
         THEN 'data/c_mktsegment must be equal to one of the allowed values' END AS e4
  FROM customer)
SELECT c_custkey, coalesce(e1, e2, e3, e4) AS error,
       CAST((e1 IS NOT NULL)::INT + (e2 IS NOT NULL)::INT + (e3 IS NOT NULL)::INT + (e4 IS NOT NULL)::INT AS BIGINT) AS n_errors
FROM v WHERE coalesce(e1, e2, e3, e4) IS NOT NULL
"""


def _replacement_batch(c):
    fix = c.where(F.col("c_acctbal") < 0).withColumn("c_acctbal", F.lit(0.0)).withColumn("c_name", F.upper("c_name"))
    unknown = c.where(F.col("c_acctbal") > 9900).withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return fix.unionByName(unknown)


def upsert(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    out, _ = tables.replace(c, _replacement_batch(c), "c_custkey")
    return out


UPSERT_SQL = """
WITH b AS (
  SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, 0.0::DOUBLE AS c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0
  UNION ALL
  SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 9900)
SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM b)
UNION ALL
SELECT * FROM b WHERE c_custkey IN (SELECT c_custkey FROM customer)
"""


def patch_rows(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    upd = c.where(F.col("c_acctbal") < 0).select(
        "c_custkey", F.lit("DEBTOR").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return tables.patch(c, upd, "c_custkey")


PATCH_ROWS_SQL = """
SELECT c_custkey, c_name, c_nationkey,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE c_mktsegment END AS c_mktsegment
FROM customer
"""


def delete_keys(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).select(
        F.col("o_custkey").alias("c_custkey"))
    keys = keys.unionByName(keys.select((F.col("c_custkey") + 1_000_000).alias("c_custkey")))
    remaining, _ = tables.delete(c, keys, "c_custkey")
    return remaining


DELETE_KEYS_SQL = """
SELECT * FROM customer c WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'P')
"""


def insert_rejects(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    batch = s.select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_name").alias("c_name"),
                     F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"),
                     F.lit("SUPPLIER").alias("c_mktsegment"), F.col("s_suppkey").alias("ord"))
    again = batch.where(F.col("c_acctbal") > 5000).withColumn("ord", F.col("ord") + 100_000)
    batch = batch.unionByName(again)
    _, rejected = tables.insert(c, batch, "c_custkey", order_key=("ord",))
    return rejected.select("c_custkey", "ord", "reason")


INSERT_REJECTS_SQL = """
WITH b AS (
  SELECT s_suppkey * 20 AS c_custkey, s_suppkey AS ord, s_acctbal FROM supplier
  UNION ALL
  SELECT s_suppkey * 20, s_suppkey + 100000, s_acctbal FROM supplier WHERE s_acctbal > 5000),
r AS (
  SELECT c_custkey, ord,
         CASE WHEN c_custkey IN (SELECT c_custkey FROM customer) THEN 'already exists'
              WHEN ord <> min(ord) OVER (PARTITION BY c_custkey) THEN 'duplicate key in batch' END AS reason
  FROM b)
SELECT c_custkey, ord, reason FROM r WHERE reason IS NOT NULL
"""


def lookup_by_keys(spark, sf_dir):
    """Point lookups in bulk: the customers named by the keys of urgent pending orders."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).select(
        F.col("o_custkey").alias("c_custkey"))
    return tables.find_by_ids(c, keys, "c_custkey")


LOOKUP_BY_KEYS_SQL = """
SELECT * FROM customer WHERE c_custkey IN (
  SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
"""


QUERIES = {
    "lookup_by_keys": lookup_by_keys,
    "campaign_preview": campaign_preview,
    "render_messages": render_messages,
    "extract_variables": extract_variables,
    "route_orders": route_orders,
    "execution_stats": execution_stats,
    "execution_step_times": execution_step_times,
    "discount_usage": discount_usage,
    "discount_current_usage": discount_current_usage,
    "validate_rows": validate_rows,
    "upsert": upsert,
    "patch_rows": patch_rows,
    "delete_keys": delete_keys,
    "insert_rejects": insert_rejects,
}

ORACLE = {k: globals()[k.upper() + "_SQL"] for k in QUERIES}
