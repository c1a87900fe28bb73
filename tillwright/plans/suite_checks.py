"""Queries that hold operators to SQL on rows the other queries do not have:
NULL and empty values, every workflow comparison, actions, parent-path and
default survivorship rules, listings, run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.mdm.ingest import members_of, unmatched_sources
from ..operators.mdm.match import find_all_matches, score_given_pairs
from ..operators.mdm.merge import merge_golden
from ..operators.rules import action_rows, actions_of, route
from ..plans.pipeline import run_pipeline
from ..sources.catalog import test_catalog
from ..sources.sinks import runs_frame
from .suite_mdm import _RULE_COLS, _SQL_NAME, INGEST_TS, MATCH_CONFIG, SOURCES_SQL, SURVIVORSHIP_CONFIG, _sql_scores, _sql_total, mdm_sources
from .suite_transform import step


# -- P8 ------------------------------------------------------------------------------------

def filter_exists_isnull(spark, sf_dir):
    """Events without a value, and errors with one."""
    cat = test_catalog(spark, sf_dir, ("events",))
    ev = cat.get("events").select("event_id", "event_type", F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("value"))
    cat.register("ev", ev, order_key=("event_id",), id_col="event_id")
    run_pipeline(cat, {"id": "p", "name": "p", "steps": [
        step(1, "filter", source="ev", output="none", conditions=[{"field": "value", "operator": "isNull"}]),
        step(2, "filter", source="ev", output="some", conditions=[{"field": "value", "operator": "exists"}, {"field": "event_type", "operator": "eq", "value": "error"}])]})
    return cat.get("none").withColumn("kind", F.lit("none")).unionByName(cat.get("some").withColumn("kind", F.lit("some")))


FILTER_EXISTS_ISNULL_SQL = """
SELECT event_id, event_type, CAST(NULL AS DOUBLE) AS value, 'none' AS kind FROM events WHERE event_id % 7 = 0 OR value IS NULL
UNION ALL
SELECT event_id, event_type, value, 'some' FROM events WHERE event_id % 7 > 0 AND value IS NOT NULL AND event_type = 'error'
"""


# -- E11 -----------------------------------------------------------------------------------

def map_date_parse(spark, sf_dir):
    """Dates read from text, some of it empty or no date."""
    cat = test_catalog(spark, sf_dir, ("orders",))
    text = F.when(F.col("o_orderkey") % 10 == 0, "").when(F.col("o_orderkey") % 10 == 1, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    cat.register("texts", cat.get("orders").select("o_orderkey", text.alias("day")), order_key=("o_orderkey",), id_col="o_orderkey")
    run_pipeline(cat, {"id": "p", "name": "p", "steps": [step(1, "map", source="texts", output="out", mappings=[
        {"target": "o_orderkey", "expression": {"type": "field", "path": "o_orderkey"}}, {"target": "at", "expression": {"type": "date", "operation": "parse", "field": "day"}}])]})
    return cat.get("out").select("o_orderkey", "at")


MAP_DATE_PARSE_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS at FROM orders"


# -- P14, P15, J9, W3, W4 -----------------------------------------------------------------

def _cmp(path, op, value):
    right = value if isinstance(value, dict) else {"type": "constant", "value": value}
    return {"type": "compare", "left": {"type": "field", "path": path}, "operator": op, "right": right}


PART_WORKFLOW = {"startStepId": "c1", "steps": [
    {"id": "c1", "type": "condition", "onTrue": "c2", "onFalse": "c3", "condition": {"type": "or", "conditions": [
        _cmp("p_name", "contains", "ring"), {"type": "not", "condition": _cmp("p_size", ">=", 10)}]}},
    {"id": "c2", "type": "condition", "onTrue": "end_a", "onFalse": "c4", "condition": {"type": "and", "conditions": [
        _cmp("p_brand", "!=", "Brand#12"), _cmp("p_brand", "matches", "^Brand#1[0-9]$")]}},
    {"id": "c3", "type": "condition", "onTrue": "new", "onFalse": "c4", "condition": {"type": "or", "conditions": [
        _cmp("p_type", "endsWith", "OMY"), _cmp("p_retailprice", "<", 920), _cmp("p_size", "<=", 11)]}},
    {"id": "new", "type": "action", "next": "tell", "action": {"type": "createEntity", "collection": "watched", "data": {
        "part": {"type": "field", "path": "p_partkey"}, "brand": {"type": "field", "path": "p_brand"}}}},
    {"id": "tell", "type": "action", "next": "end_c", "action": {"type": "sendMessage", "data": {"to": {"type": "field", "path": "p_name"}}}},
    {"id": "c4", "type": "condition", "onTrue": "c5", "onFalse": "end_d", "condition": {"type": "exists", "collection": "nation", "filter": {
        "field": "n_name", "operator": "contains", "value": {"type": "field", "path": "digits"}}}},
    {"id": "c5", "type": "condition", "onTrue": "end_e", "onFalse": "end_f", "condition": {"type": "exists", "collection": "nation", "filter": {
        "field": "n_name", "operator": "endsWith", "value": {"type": "field", "path": "digits"}}}},
    *({"id": f"end_{x}", "type": "end"} for x in "abcdef"),
]}


def _routed_parts(spark, sf_dir):
    cat = test_catalog(spark, sf_dir, ("part", "nation"))
    contexts = cat.get("part").withColumn("digits", F.concat(F.lit("_"), (F.col("p_size") % 9).cast("string")))
    return route(cat, contexts, PART_WORKFLOW)


def route_parts(spark, sf_dir):
    """Every comparison, ``or`` and ``not``, branches that meet again, substring lookups."""
    return _routed_parts(spark, sf_dir).select("p_partkey", "outcome", "path", F.size("actions").cast("long").alias("n_actions"))


_PARTS_SQL = """
WITH p AS (
  SELECT *, contains(p_name, 'ring') OR NOT p_size >= 10 AS k1, p_brand <> 'Brand#12' AND regexp_matches(p_brand, '^Brand#1[0-9]$') AS k2,
         p_type LIKE '%OMY' OR p_retailprice < 920 OR p_size <= 11 AS k3,
         EXISTS (SELECT 1 FROM nation WHERE contains(n_name, '_' || CAST(p_size % 9 AS VARCHAR))) AS k4,
         EXISTS (SELECT 1 FROM nation WHERE suffix(n_name, '_' || CAST(p_size % 9 AS VARCHAR))) AS k5
  FROM part)
"""

ROUTE_PARTS_SQL = _PARTS_SQL + """
SELECT p_partkey,
  CASE WHEN k1 AND k2 THEN 'end_a' WHEN NOT k1 AND k3 THEN 'end_c' WHEN NOT k4 THEN 'end_d' WHEN k5 THEN 'end_e' ELSE 'end_f' END AS outcome,
  CASE WHEN k1 AND k2 THEN ['c1', 'c2', 'end_a'] WHEN NOT k1 AND k3 THEN ['c1', 'c3', 'new', 'tell', 'end_c']
       ELSE list_concat(['c1', CASE WHEN k1 THEN 'c2' ELSE 'c3' END, 'c4'], CASE WHEN NOT k4 THEN ['end_d'] WHEN k5 THEN ['c5', 'end_e'] ELSE ['c5', 'end_f'] END) END AS path,
  CAST(CASE WHEN NOT k1 AND k3 THEN 2 ELSE 0 END AS BIGINT) AS n_actions
FROM p
"""


def workflow_actions(spark, sf_dir):
    """What the workflow's actions write: typed rows of the new entities, with the message of each."""
    acts = actions_of(_routed_parts(spark, sf_dir), "p_partkey")
    new = action_rows(acts, "createEntity", "watched", "part bigint, brand string")
    sent = acts.where("type = 'sendMessage'").select("p_partkey", F.get_json_object("payload", "$.to").alias("to"))
    return new.join(sent, new["part"] == sent["p_partkey"]).select("part", "brand", "to")


WORKFLOW_ACTIONS_SQL = _PARTS_SQL + """SELECT p_partkey AS part, p_brand AS brand, p_name AS "to" FROM p WHERE NOT k1 AND k3"""


# -- M8: NULL values on either side -----------------------------------------------------------

def _with_nulls(src, every: int):
    """A field in turn is NULL, by customer key."""
    k = F.col("sourceId").cast("long")
    data = F.col("data")
    fields = ("name", "nation", "segment", "balance", "since")
    for i, f in enumerate(fields):
        data = data.withField(f, F.when(k % every != i, F.col(f"data.{f}")))
    return src.withColumn("data", data)


def mdm_null_scores(spark, sf_dir):
    """Scores of records that lack fields: two NULLs are alike, one is not."""
    src = mdm_sources(spark, sf_dir)
    crm, erp = _with_nulls(src.where("sourceSystem = 'crm'"), 5), _with_nulls(src.where("sourceSystem = 'erp'"), 7)
    pairs = crm.select(F.col("id").alias("sourceRecordId"), "sourceId").join(erp.select(F.col("id").alias("targetRecordId"), "sourceId"), "sourceId").drop("sourceId")
    scored = score_given_pairs(pairs, crm, erp, MATCH_CONFIG, "source")
    return scored.select("sourceRecordId", *[F.round(F.col("ruleScores")[i]["score"], 6).alias(n) for i, n in enumerate(_RULE_COLS)])


def _mdm_null_scores_sql():
    fields = ("name", "nation", "segment", "balance", "since")
    null = lambda every: ", ".join(f"CASE WHEN CAST(sourceId AS BIGINT) % {every} <> {i} THEN {f} END AS {f}" for i, f in enumerate(fields))
    of = {"s_name": "name", "s_nation": "nation", "s_segment": "segment", "s_balance": "balance", "s_fuzzy": "name", "s_phonetic": "name", "s_since": "since"}
    sc = _sql_scores("a", "b")
    cols = ", ".join(f"round(CASE WHEN a.{f} IS NULL AND b.{f} IS NULL THEN 1.0::DOUBLE WHEN a.{f} IS NULL OR b.{f} IS NULL THEN 0.0::DOUBLE ELSE {sc[n]} END, 6) AS {n}" for n, f in of.items())
    return f"""
WITH {SOURCES_SQL},
a AS (SELECT id, sourceId, {null(5)} FROM src WHERE sourceSystem = 'crm'), b AS (SELECT id, sourceId, {null(7)} FROM src WHERE sourceSystem = 'erp')
SELECT a.id AS "sourceRecordId", {cols} FROM a JOIN b USING (sourceId)"""


# -- M10, M12: matches among golden and source records -------------------------------------------

def mdm_all_matches(spark, sf_dir):
    """Golden and source records that match the records of one system."""
    src = mdm_sources(spark, sf_dir)
    crm = src.where("sourceSystem = 'crm'").withColumn("goldenRecordId", F.concat(F.lit("g-"), F.col("sourceId")))
    goldens = merge_golden(crm, SURVIVORSHIP_CONFIG, batch_ts=INGEST_TS)
    found = find_all_matches(src.where("sourceSystem = 'web'"), goldens, src, MATCH_CONFIG)
    return found.select("sourceRecordId", "matchedRecordId", "matchedRecordType", F.round("score", 6).alias("score"))


def _mdm_all_matches_sql():
    total = _sql_total(_sql_scores("a", "b"))
    return f"""
WITH {SOURCES_SQL},
b AS (SELECT *, 'source' AS kind FROM src UNION ALL SELECT * REPLACE ('g-' || sourceId AS id), 'golden' FROM src WHERE sourceSystem = 'crm')
SELECT a.id AS "sourceRecordId", b.id AS "matchedRecordId", kind AS "matchedRecordType", round({total}, 6) AS score
FROM src a JOIN b ON a.sourceSystem = 'web' AND a.id <> b.id AND {_SQL_NAME.format('a')} = {_SQL_NAME.format('b')} WHERE {total} >= 0.7"""


# -- M13: listings -------------------------------------------------------------------------------

def mdm_listings(spark, sf_dir):
    """Members of every tenth golden record, and the records without one."""
    src = mdm_sources(spark, sf_dir)
    k = F.col("sourceId").cast("long")
    linked = src.withColumn("goldenRecordId", F.when(k % 3 > 0, F.concat(F.lit("g-"), F.col("sourceId"))).when(k % 2 == 0, F.lit("")))
    wanted = linked.where((k % 10 == 0) & (k % 3 > 0)).select(F.col("goldenRecordId").alias("id")).distinct()
    return (members_of(linked, wanted).select("id", F.lit("member").alias("kind"))
            .unionByName(unmatched_sources(linked, "customer").select("id", F.lit("unmatched").alias("kind"))))


MDM_LISTINGS_SQL = f"""
WITH {SOURCES_SQL}
SELECT id, CASE WHEN CAST(sourceId AS BIGINT) % 3 = 0 THEN 'unmatched' ELSE 'member' END AS kind FROM src
WHERE CAST(sourceId AS BIGINT) % 3 = 0 OR CAST(sourceId AS BIGINT) % 10 = 0
"""


# -- M14, M20-M22: empty values, manual values, rules of parents, defaults -----------------------------

RULES = {"defaultStrategy": "mostRecent", "rules": [
    {"field": "contact", "strategy": "sourceRanking", "sourceRanking": ["erp", "crm"]}, {"field": "balance", "strategy": "highestConfidence", "defaultValue": -1.0},
    {"field": "note", "strategy": "manual"}, {"field": "", "strategy": "longestValue"}]}


def mdm_rules(spark, sf_dir):
    """Records with empty names and missing balances, notes kept by hand on some golden records."""
    src = mdm_sources(spark, sf_dir)
    k = F.col("sourceId").cast("long")
    data = F.struct(
        F.when((k % 4 == 0) & (F.col("sourceSystem") == "erp"), "").otherwise(F.col("data.name")).alias("name"),
        F.struct(F.when((k % 5 > 0) | (F.col("sourceSystem") != "erp"), F.col("data.segment")).alias("segment"), F.col("data.nation").alias("nation")).alias("contact"),
        F.when(k % 6 > 0, F.col("data.balance")).alias("balance"), F.concat(F.lit("note of "), F.col("id")).alias("note"))
    members = src.withColumn("data", data).withColumn("goldenRecordId", F.concat(F.lit("g-"), F.col("sourceId")))
    by_hand = members.where(k % 7 == 0).select(F.col("goldenRecordId").alias("id"), F.struct(F.lit("by hand").alias("note")).alias("data"),
                                               F.lit(INGEST_TS).cast("timestamp").alias("createdAt")).distinct()
    full = members.limit(0).select(F.col("goldenRecordId").alias("id"), "data", F.col("ingestedAt").alias("createdAt"))
    existing = by_hand.select("id", F.struct(*[(F.col("data.note") if f.name == "note" else F.lit(None).cast(f.dataType)).alias(f.name) for f in full.schema["data"].dataType]).alias("data"), "createdAt")
    g = merge_golden(members, RULES, existing=existing, batch_ts=INGEST_TS)
    return g.select("id", "data.name", "data.contact.segment", "data.contact.nation", "data.balance", "data.note")


MDM_RULES_SQL = f"""
WITH {SOURCES_SQL},
m AS (
  SELECT 'g-' || sourceId AS gid, id, CAST(sourceId AS BIGINT) AS k, confidence, CASE WHEN CAST(sourceId AS BIGINT) % 4 = 0 AND sourceSystem = 'erp' THEN '' ELSE name END AS name,
         CASE WHEN CAST(sourceId AS BIGINT) % 5 > 0 OR sourceSystem <> 'erp' THEN segment END AS segment, nation,
         CASE WHEN CAST(sourceId AS BIGINT) % 6 > 0 THEN balance END AS balance, 'note of ' || id AS note,
         CASE sourceSystem WHEN 'erp' THEN 1 WHEN 'crm' THEN 2 ELSE 3 END AS rank
  FROM src)
SELECT gid AS id, first(name ORDER BY length(name) DESC, id) FILTER (name <> '') AS name, first(segment ORDER BY rank, id) FILTER (segment IS NOT NULL) AS segment,
       first(nation ORDER BY rank, id) AS nation, coalesce(first(balance ORDER BY confidence DESC, id) FILTER (balance IS NOT NULL), -1.0) AS balance,
       CASE WHEN any_value(k) % 7 = 0 THEN 'by hand' ELSE first(note ORDER BY id) END AS note
FROM m GROUP BY gid
"""


# -- R2, R3: what a run records ----------------------------------------------------------------------

def run_steps_recorded(spark, sf_dir):
    """Status and rows of each step of a run, one of which fails."""
    cat = test_catalog(spark, sf_dir, ("orders",))
    run = run_pipeline(cat, {"id": "p", "name": "p", "steps": [
        step(1, "filter", source="orders", output="open", conditions=[{"field": "o_orderstatus", "operator": "eq", "value": "O"}]),
        step(2, "join", left="open", right="open", on=[], output="bad"),
        step(3, "aggregate", source="open", output="by", groupBy=["o_orderpriority"], aggregations=[{"field": "o_orderkey", "function": "count", "as": "n"}])]}, continue_on_error=True, observe=True)
    cat.get("by").collect()  # five rows: what the steps observe is known once they ran
    steps = runs_frame(spark, [run]).select("status", F.explode("steps").alias("s"))
    return steps.select(F.col("status").alias("run_status"), "s.stepId", "s.status", "s.outputRows")


RUN_STEPS_RECORDED_SQL = """
SELECT 'failed' AS run_status, 's1' AS "stepId", 'completed' AS status, count(*) AS "outputRows" FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'failed', 's2', 'failed', NULL
UNION ALL SELECT 'failed', 's3', 'completed', count(DISTINCT o_orderpriority) FROM orders WHERE o_orderstatus = 'O'
"""


QUERIES = {f.__name__: f for f in (
    filter_exists_isnull, map_date_parse, route_parts, workflow_actions, mdm_null_scores, mdm_all_matches, mdm_listings, mdm_rules, run_steps_recorded)}

ORACLE = {
    "filter_exists_isnull": FILTER_EXISTS_ISNULL_SQL, "map_date_parse": MAP_DATE_PARSE_SQL, "route_parts": ROUTE_PARTS_SQL, "workflow_actions": WORKFLOW_ACTIONS_SQL,
    "mdm_null_scores": _mdm_null_scores_sql(), "mdm_all_matches": _mdm_all_matches_sql(), "mdm_listings": MDM_LISTINGS_SQL, "mdm_rules": MDM_RULES_SQL,
    "run_steps_recorded": RUN_STEPS_RECORDED_SQL}
