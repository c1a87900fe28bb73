"""More registered queries: previews, bulk sends, code redemption and format
checks, membership commands, lookup-then-flatten with empty groups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators.audience import bulk_send
from ..operators.mdm.ingest import apply_links, merge_goldens
from ..operators.pricing.codes import format_check, redeem
from ..plans.pipeline import preview_step
from ..plans.reports import preview_report
from ..sources.catalog import test_catalog
from .suite_mdm import mdm_sources
from .suite_transform import run_steps, step

SENT_AT = dt.datetime(2024, 3, 1)


# -- R4 / R7 previews ------------------------------------------------------------------

def preview_map_step(spark, sf_dir):
    """First 25 rows (table order) of a map step's output - the preview is the feature."""
    cat = test_catalog(spark, sf_dir, ("orders",))
    head, _ = preview_step(cat, {"type": "map", "config": {"source": "orders", "output": "x", "mappings": [
        {"target": "doubled", "expression": {"type": "math", "operator": "*",
                                             "left": {"type": "field", "path": "o_totalprice"},
                                             "right": {"type": "literal", "value": 2}}},
        {"target": "status", "expression": {"type": "string", "operation": "lower", "path": "o_orderstatus"}}]}},
        limit=25)
    return head


PREVIEW_MAP_STEP_SQL = """
SELECT o_orderkey, o_totalprice * 2 AS doubled, lower(o_orderstatus) AS status
FROM orders ORDER BY o_orderkey LIMIT 25
"""


def preview_step_count(spark, sf_dir):
    cat = test_catalog(spark, sf_dir, ("lineitem",))
    _, count = preview_step(cat, {"type": "filter", "config": {"source": "lineitem", "output": "x", "conditions": [
        {"field": "l_returnflag", "operator": "eq", "value": "R"}]}})
    return count


PREVIEW_STEP_COUNT_SQL = "SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'R'"


def report_preview(spark, sf_dir):
    cat = test_catalog(spark, sf_dir, ("orders", "customer"))
    r = preview_report(cat, {"collection": "orders", "limit": 40, "status": "archived",
                             "filter": {"o_custkey": {"c_mktsegment": {"eq": "HOUSEHOLD"}},
                                        "o_orderstatus": {"ne": "F"}},
                             "columns": [{"field": "o_orderkey"}, {"field": "o_totalprice"}]})
    return r.data


REPORT_PREVIEW_SQL = """
SELECT o_orderkey, o_totalprice FROM orders o
WHERE o_orderstatus IS DISTINCT FROM 'F'
  AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'HOUSEHOLD')
ORDER BY o_orderkey LIMIT 40
"""


# -- T7 bulk send ----------------------------------------------------------------------------

def bulk_messages(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rec = c.where(F.col("c_mktsegment") == "FURNITURE").select(
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("recipient"))
    tpl = {"id": "promo", "subject": "{{season}} offers",
           "body": "Hi, our {{season}} sale ends {{date}}. {{unknown}}"}
    return bulk_send(rec, tpl, {"season": "Spring", "date": "2024-04-01"}, sent_at=SENT_AT)


BULK_MESSAGES_SQL = """
SELECT 'promo' AS "templateId", lower(replace(c_name, '#', '.')) || '@example.com' AS recipient,
       'Spring offers' AS subject, 'Hi, our Spring sale ends 2024-04-01. {{unknown}}' AS body,
       'pending' AS status, TIMESTAMP '2024-03-01' AS "createdAt"
FROM customer WHERE c_mktsegment = 'FURNITURE'
"""


# -- C12 / C14 codes ---------------------------------------------------------------------------

def code_format(spark, sf_dir):
    """Format check of codes derived from customer names (digits mapped onto
    the alphanumeric set, raw digits for one segment so some fail)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    core = F.substring("c_name", 11, 8)
    mapped = F.translate(core, "0123456789", "ABCDEFGHJK")
    code = F.concat(F.lit("SUM-"), F.when(F.col("c_mktsegment") == "BUILDING", core)
                    .when(F.col("c_acctbal") < 0, F.lower(mapped)).otherwise(mapped))
    return c.select("c_custkey", code.alias("code"), format_check(code, 8, prefix="SUM-").alias("valid"))


CODE_FORMAT_SQL = """
WITH t AS (
  SELECT c_custkey, substr(c_name, 11, 8) AS core, c_mktsegment, c_acctbal FROM customer),
k AS (
  SELECT c_custkey, 'SUM-' || CASE WHEN c_mktsegment = 'BUILDING' THEN core
                               WHEN c_acctbal < 0 THEN lower(translate(core, '0123456789', 'ABCDEFGHJK'))
                               ELSE translate(core, '0123456789', 'ABCDEFGHJK') END AS code
  FROM t)
SELECT c_custkey, code,
       starts_with(code, 'SUM-') AND length(code) = 12
       AND regexp_matches(upper(substr(code, 5, 8)), '^[ABCDEFGHJKLMNPQRSTUVWXYZ23456789]{8}$') AS valid
FROM k
"""


def code_redeem(spark, sf_dir):
    """Redeem per-customer codes with the customer's urgent orders: the first
    order by date then id wins, later ones and codes already used are rejected."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    codes = c.select(F.concat(F.lit("VIP-"), F.col("c_custkey").cast("string")).alias("code"),
                     F.when(F.col("c_acctbal") < 0, F.col("c_custkey").cast("string")).alias("usedBy"))
    red = o.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.concat(F.lit("VIP-"), F.col("o_custkey").cast("string")).alias("code"),
        F.col("o_custkey").cast("string").alias("customerId"), F.col("o_orderkey").alias("orderId"),
        F.col("o_orderdate").alias("at"))
    red = red.unionByName(o.where(F.col("o_orderpriority") == "2-HIGH").select(
        F.concat(F.lit("NOPE-"), F.col("o_custkey").cast("string")).alias("code"),
        F.col("o_custkey").cast("string").alias("customerId"), F.col("o_orderkey").alias("orderId"),
        F.col("o_orderdate").alias("at")))
    accepted, rejected = redeem(codes, red)
    return accepted.select("code", "orderId", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("code", "orderId", F.col("reason").alias("outcome")))


CODE_REDEEM_SQL = """
WITH codes AS (
  SELECT 'VIP-' || CAST(c_custkey AS VARCHAR) AS code, c_acctbal < 0 AS used FROM customer),
r AS (
  SELECT 'VIP-' || CAST(o_custkey AS VARCHAR) AS code, o_orderkey AS "orderId", o_orderdate AS at
  FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT 'NOPE-' || CAST(o_custkey AS VARCHAR), o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '2-HIGH'),
j AS (
  SELECT r.*, codes.used,
         row_number() OVER (PARTITION BY r.code ORDER BY r.at, r."orderId") AS rn
  FROM r LEFT JOIN codes ON r.code = codes.code)
SELECT code, "orderId",
       CASE WHEN used IS NULL THEN 'Unknown code' WHEN used THEN 'Code already used'
            WHEN rn = 1 THEN 'accepted' ELSE 'Code already used' END AS outcome
FROM j
"""


# -- M26 / M27 membership commands ---------------------------------------------------------------

def _members(spark, sf_dir):
    src = mdm_sources(spark, sf_dir)
    return (src.withColumn("goldenRecordId", F.concat(F.lit("g-"), F.col("sourceId")))
            .withColumn("matchScore", F.lit(1.0)))


def mdm_link_unlink(spark, sf_dir):
    """Unlink the erp records of customers with a negative balance; link every
    web record to the golden of the next customer key."""
    m = _members(spark, sf_dir)
    unlink = m.where((F.col("sourceSystem") == "erp") & (F.col("data.balance") < 0)).select(
        F.col("id").alias("sourceRecordId"), F.lit(None).cast("string").alias("goldenRecordId"))
    link = m.where(F.col("sourceSystem") == "web").select(
        F.col("id").alias("sourceRecordId"),
        F.concat(F.lit("g-"), (F.col("sourceId").cast("long") + 1).cast("string")).alias("goldenRecordId"))
    out = apply_links(m, unlink.unionByName(link))
    return out.select("id", "goldenRecordId", "matchScore")


_MEMBERS_SQL = """
src AS (
  SELECT 'crm-' || c_custkey AS id, 'crm' AS sys, c_custkey AS k, c_acctbal AS balance FROM customer
  UNION ALL SELECT 'erp-' || c_custkey, 'erp', c_custkey, round(c_acctbal) FROM customer
  UNION ALL SELECT 'web-' || c_custkey, 'web', c_custkey, c_acctbal + 3 FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
"""

MDM_LINK_UNLINK_SQL = f"""
WITH {_MEMBERS_SQL}
SELECT id,
  CASE WHEN sys = 'erp' AND balance < 0 THEN NULL
       WHEN sys = 'web' THEN 'g-' || CAST(k + 1 AS VARCHAR)
       ELSE 'g-' || CAST(k AS VARCHAR) END AS "goldenRecordId",
  CASE WHEN sys = 'erp' AND balance < 0 THEN NULL ELSE 1.0::DOUBLE END AS "matchScore"
FROM src
"""


def mdm_merge_goldens(spark, sf_dir):
    """Merge the golden of every customer with a balance over 8000 into the golden of the next key."""
    m = _members(spark, sf_dir)
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_acctbal") > 8000)
    mapping = keys.select(F.concat(F.lit("g-"), F.col("c_custkey").cast("string")).alias("fromId"),
                          F.concat(F.lit("g-"), (F.col("c_custkey") + 1).cast("string")).alias("toId"))
    return merge_goldens(m, mapping).select("id", "goldenRecordId")


MDM_MERGE_GOLDENS_SQL = f"""
WITH RECURSIVE {_MEMBERS_SQL},
walk AS (  -- a chain of merges goes on to its last record
  SELECT k, k AS x FROM src
  UNION
  SELECT walk.k, walk.x + 1 FROM walk JOIN customer c ON c.c_custkey = walk.x AND c.c_acctbal > 8000)
SELECT id, 'g-' || CAST((SELECT max(x) FROM walk WHERE walk.k = src.k) AS VARCHAR) AS "goldenRecordId" FROM src
"""


# -- J3 + X0: lookup many, then flatten keeping empty groups -----------------------------------------

def lookup_flatten(spark, sf_dir):
    """Every customer with each of its orders, customers without one too."""
    steps = [
        step(1, "lookup", source="customer", **{"from": "orders"}, localField="c_custkey",
             foreignField="o_custkey", **{"as": "rich"}, multiple=True, output="_temp_l"),
        step(2, "flatten", source="_temp_l", field="rich", **{"as": "one"}, preserveEmpty=True, output="out"),
    ]
    df = run_steps(spark, sf_dir, steps, "out", ["customer", "orders"])
    return df.select("c_custkey", "c_name", "pos", F.col("one.o_orderkey").alias("o_orderkey"),
                     F.size("rich").cast("long").alias("n_rich"))


LOOKUP_FLATTEN_SQL = """
WITH g AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY o_custkey)
SELECT n.c_custkey, n.c_name, CAST(u.pos AS INTEGER) AS pos, u.o_orderkey, coalesce(len(g.ks), 0) AS n_rich
FROM customer n LEFT JOIN g ON g.o_custkey = n.c_custkey
LEFT JOIN LATERAL (SELECT unnest(range(len(g.ks))) AS pos, unnest(g.ks) AS o_orderkey) u ON true
"""


# -- whole document texts, labels and benchmark ------------------------------------------------

def map_document_text(spark, sf_dir):
    """String and array expressions over the whole text of every document."""
    steps = [
        step(1, "map", source="documents", output="_temp_w", includeOriginal=True, mappings=[
            {"target": "words", "expression": {"type": "string", "operation": "split", "path": "text", "separator": " "}},
            {"target": "chars", "expression": {"type": "string", "operation": "length", "path": "text"}}]),
        step(2, "map", source="_temp_w", output="out", mappings=[
            {"target": "chars", "expression": {"type": "field", "path": "chars"}},
            {"target": "n_words", "expression": {"type": "array", "operation": "length", "path": "words"}},
            {"target": "first_word", "expression": {"type": "array", "operation": "first", "path": "words"}},
            {"target": "last_word", "expression": {"type": "array", "operation": "last", "path": "words"}},
            {"target": "lang_up", "expression": {"type": "string", "operation": "upper", "path": "lang"}},
            {"target": "chars_match", "expression": {"type": "conditional",
                                                     "condition": {"field": "n_chars", "operator": "eq", "value": 0},
                                                     "then": {"type": "literal", "value": "empty"},
                                                     "else": {"type": "field", "path": "source"}}}]),
    ]
    return run_steps(spark, sf_dir, steps, "out", ["documents"])


MAP_DOCUMENT_TEXT_SQL = """
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words,
       string_split(text, ' ')[1] AS first_word, string_split(text, ' ')[-1] AS last_word,
       upper(lang) AS lang_up, CASE WHEN n_chars = 0 THEN 'empty' ELSE source END AS chars_match
FROM documents
"""


def rel_document_labels(spark, sf_dir):
    """English and French documents whose every label is non-toxic (vacuously
    true without labels), via the labels -> documents relation."""
    cat = test_catalog(spark, sf_dir, ("documents", "labels"))
    from ..operators.query import find_all

    df = find_all(cat, "documents", {"labels": {"every": {"toxic": {"eq": 0}}}, "lang": {"in": ["en", "fr"]}})
    return df.select("doc_id", "lang", "source", "n_chars")


REL_DOCUMENT_LABELS_SQL = """
SELECT doc_id, lang, source, n_chars FROM documents d
WHERE lang IN ('en', 'fr')
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND NOT coalesce(l.toxic = 0, false))
"""


def lookup_benchmark(spark, sf_dir):
    steps = [step(1, "lookup", source="documents", **{"from": "benchmark"}, localField="doc_id",
                  foreignField="item_id", **{"as": "bench"}, output="out")]
    df = run_steps(spark, sf_dir, steps, "out", ["documents", "benchmark"])
    return df.select("doc_id", "lang", F.col("bench.item_id").alias("item_id"), F.col("bench.text").alias("bench_text"))


LOOKUP_BENCHMARK_SQL = """
SELECT d.doc_id, d.lang, b.item_id, b.text AS bench_text
FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id
"""


QUERIES = {
    "map_document_text": map_document_text,
    "rel_document_labels": rel_document_labels,
    "lookup_benchmark": lookup_benchmark,
    "preview_map_step": preview_map_step,
    "preview_step_count": preview_step_count,
    "report_preview": report_preview,
    "bulk_messages": bulk_messages,
    "code_format": code_format,
    "code_redeem": code_redeem,
    "mdm_link_unlink": mdm_link_unlink,
    "mdm_merge_goldens": mdm_merge_goldens,
    "lookup_flatten": lookup_flatten,
}

ORACLE = {k: globals()[k.upper() + "_SQL"] for k in QUERIES}
