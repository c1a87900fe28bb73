"""Registered streaming queries: stateless steps on a stream of ``events``
(checked against SQL), and incremental ingest-and-match over source records
derived from ``customer`` (rows-only: the result depends on micro-batch
boundaries by definition)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators.mdm.merge import merge_golden
from ..session import checkpoint_dir
from ..sources.catalog import Catalog, TEST_TABLE_KEYS
from ..streaming.incremental import ingest_stream, read_state, run_to_table, stream_steps
from .suite_mdm import _SQL_NAME, INGEST_TS, MATCH_CONFIG, SOURCES_SQL, SURVIVORSHIP_CONFIG, _sql_scores, _sql_total, mdm_sources


def stream_events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # glob: the file source lists a folder
    cat = Catalog(spark)
    cat.register("events", stream, order_key=("event_id",), id_col="event_id")
    cat.register("customer", spark.read.parquet(f"{sf_dir}/customer.parquet"),
                 order_key=TEST_TABLE_KEYS["customer"][0], id_col="c_custkey")
    steps = [
        {"id": "f", "type": "filter", "config": {"source": "events", "output": "e1", "conditions": [
            {"field": "event_type", "operator": "in", "value": ["purchase", "click"]},
            {"field": "value", "operator": "gte", "value": 10}]}},
        {"id": "m", "type": "map", "config": {"source": "e1", "output": "e2", "includeOriginal": True, "mappings": [
            {"target": "label", "expression": {"type": "template", "template": "{{event_type}}#{{user_id}}"}},
            {"target": "doubled", "expression": {"type": "math", "operator": "*",
                                                 "left": {"type": "field", "path": "value"},
                                                 "right": {"type": "literal", "value": 2}}}]}},
        {"id": "l", "type": "lookup", "config": {"source": "e2", "from": "customer", "localField": "user_id",
                                                 "foreignField": "c_custkey", "as": "cust", "output": "e3"}},
    ]
    out = stream_steps(cat, "events", steps)
    flat = out.select("event_id", "event_type", "label", "doubled", F.col("cust.c_name").alias("c_name"))
    return run_to_table(flat, f"stream_events_{uuid.uuid4().hex[:8]}")


STREAM_EVENTS_SQL = """
SELECT e.event_id, e.event_type, e.event_type || '#' || CAST(e.user_id AS VARCHAR) AS label,
       e.value * 2 AS doubled, c.c_name
FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
WHERE e.event_type IN ('purchase', 'click') AND e.value >= 10
"""


def stream_ingest(spark, sf_dir):
    src = mdm_sources(spark, sf_dir)
    crm = (src.where("sourceSystem = 'crm'").withColumn("goldenRecordId", F.concat(F.lit("g-"), F.col("sourceId")))
           .withColumn("matchScore", F.lit(1.0)))
    goldens = merge_golden(crm, SURVIVORSHIP_CONFIG, batch_ts=INGEST_TS)
    stage = os.path.join(checkpoint_dir(spark), f"stream-stage-{uuid.uuid4().hex[:8]}")
    stream = spark.readStream.schema(src.schema).option("recursiveFileLookup", "true").parquet
    root = None
    for system in ("erp", "web"):  # two arrivals, each a run of the same stream
        src.where(F.col("sourceSystem") == system).write.parquet(f"{stage}/{system}")
        q, root = ingest_stream(spark, stream(stage), MATCH_CONFIG, SURVIVORSHIP_CONFIG, state_dir=root, golden_seed=goldens, member_seed=crm)
        q.awaitTermination()
        if q.exception():
            raise RuntimeError(str(q.exception()))
    members = read_state(spark, root, "members")
    return members.where("sourceSystem <> 'crm'").select("id", "goldenRecordId", F.round("matchScore", 6).alias("matchScore"))


QUERIES = {
    "stream_events": stream_events,
    "stream_ingest": stream_ingest,
}

def _stream_ingest_sql():
    """Two batches, the second against golden records that hold the matched records of the first."""
    sc = _sql_total(_sql_scores("a", "b"))
    same = f"{_SQL_NAME.format('a')} = {_SQL_NAME.format('b')}"
    cols = "id, entityType, sourceSystem, sourceId, name, nation, segment, balance, since, confidence, upd"
    best = lambda batch, golden: f"""SELECT a.id, b.gid, {sc} AS score FROM {batch} a JOIN {golden} b ON {same} WHERE {sc} >= 0.7
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {sc} DESC, b.gid) = 1"""  # noqa: E731
    return f"""
WITH {SOURCES_SQL},
crm AS (SELECT *, 'g-' || sourceId AS gid FROM src WHERE sourceSystem = 'crm'), erp AS (SELECT * FROM src WHERE sourceSystem = 'erp'), web AS (SELECT * FROM src WHERE sourceSystem = 'web'),
first AS ({best("erp", "crm")}),
m AS (SELECT {cols}, gid FROM crm
      UNION ALL SELECT {", ".join("e." + c for c in cols.split(", "))}, coalesce(first.gid, 'golden-' || e.id) FROM erp e LEFT JOIN first USING (id)),
nations AS (
  SELECT gid, first(nation ORDER BY n DESC, lead) AS nation FROM (SELECT gid, nation, count(*) AS n, min(id) AS lead FROM m GROUP BY gid, nation) GROUP BY gid),
golden AS (
  SELECT gid, first(name ORDER BY length(name) DESC, id) AS name, first(segment ORDER BY CASE sourceSystem WHEN 'erp' THEN 1 WHEN 'crm' THEN 2 ELSE 3 END, id) AS segment,
         first(balance ORDER BY confidence DESC, id) AS balance, first(since ORDER BY upd DESC, id) AS since, any_value(nations.nation) AS nation
  FROM m JOIN nations USING (gid) GROUP BY gid),
second AS ({best("web", "golden")})
SELECT id, coalesce(first.gid, 'golden-' || id) AS "goldenRecordId", round(coalesce(score, 1.0), 6) AS "matchScore" FROM erp LEFT JOIN first USING (id)
UNION ALL SELECT id, coalesce(second.gid, 'golden-' || id), round(coalesce(score, 1.0), 6) FROM web LEFT JOIN second USING (id)
"""


ORACLE = {
    "stream_events": STREAM_EVENTS_SQL,
    "stream_ingest": _stream_ingest_sql(),
}
