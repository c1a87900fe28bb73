"""Batch ingest-and-match and manual membership commands.

The original ingests one record at a time against the golden records as
they are at that moment, so its result depends on arrival order.  The batch
definition here: every new record is matched against the golden table *as
of the batch start* (best score wins, ties -> first golden by id); records
without a match are matched among themselves and each connected component
becomes one new golden record.  Affected golden records are re-merged over
all their members.  Iterations of the component search cut their lineage
with ``checkpoint()`` in the session's shared checkpoint folder and stop at
a round limit with an error instead of a partial answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import checkpoint_dir, written
from ..components import components
from ..tables import last_per_key
from .commands import resolve_redirects
from .match import candidate_pairs, find_matches, score
from .merge import merge_golden

def normalise_sources(df: DataFrame, batch_ts) -> DataFrame:
    """Envelope defaults: confidence 1.0, sourceUpdatedAt / ingestedAt = batch time."""
    ts = F.lit(batch_ts).cast("timestamp")
    cols = set(df.columns)
    out = df
    out = out.withColumn("confidence", F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in cols else F.lit(1.0))
    out = out.withColumn("sourceUpdatedAt", F.coalesce(F.col("sourceUpdatedAt"), ts) if "sourceUpdatedAt" in cols else ts)
    out = out.withColumn("ingestedAt", ts)
    if "id" not in cols:
        out = out.withColumn("id", F.concat_ws(":", F.col("sourceSystem"), F.col("sourceId").cast("string")))
    return out


def connected_components(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` with component = smallest id reachable over undirected edges
    ``(a, b)``, however long the chains are (see ``operators/components.py``)."""
    und = written(edges.select("a", "b"), "edges")
    if und.isEmpty():  # no edge: every node is its own component, no iteration needed
        return nodes.select(F.col("id"), F.col("id").alias("component"))
    roots = components(und, "a", "b", written)
    named = roots.join(roots.groupBy("root").agg(F.min("node").alias("component")), "root").select(F.col("node").alias("id"), "component")
    return nodes.select("id").join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@dataclass
class IngestResult:
    sources: DataFrame   # the new records, linked (goldenRecordId, matchScore)
    goldens: DataFrame   # affected golden records, re-merged


def ingest_batch(spark: SparkSession, new_sources: DataFrame, goldens: DataFrame, members: DataFrame,
                 match_config: dict, survivorship_config: dict, batch_ts, **match_kw) -> IngestResult:
    checkpoint_dir(spark)  # the lineage cuts below need the shared folder
    new = normalise_sources(new_sources, batch_ts)
    if "goldenRecordId" in new.columns:
        new = new.drop("goldenRecordId", "matchScore")
    thr_matches = find_matches(new, goldens, match_config, "golden", **match_kw)
    best = thr_matches.groupBy("sourceRecordId").agg(
        F.min_by(F.struct("matchedRecordId", "score"),
                 F.struct((-F.col("score")).alias("s"), F.col("matchedRecordId").alias("g"))).alias("b"))
    best = best.select(F.col("sourceRecordId").alias("__sid"), F.col("b.matchedRecordId").alias("goldenRecordId"),
                       F.col("b.score").alias("matchScore"))
    # one pass of matching, written once (lineage cut, reused by both branches)
    assigned = new.join(best, new["id"] == best["__sid"], "left").drop("__sid").checkpoint(eager=True)
    matched = assigned.where(F.col("goldenRecordId").isNotNull())
    unmatched = assigned.where(F.col("goldenRecordId").isNull()).drop("goldenRecordId", "matchScore")
    if unmatched.isEmpty():  # cheap: ``assigned`` is already materialised
        linked = matched
    else:
        pairs = candidate_pairs(unmatched, unmatched, match_config, exclude_self=True, **match_kw)
        edges = score(pairs, match_config, "source").where("isMatch").select(
            F.col("sourceRecordId").alias("a"), F.col("matchedRecordId").alias("b"))
        comps = connected_components(spark, unmatched.select("id"), edges)
        fresh = (unmatched.join(comps, "id")
                 .withColumn("goldenRecordId", F.concat(F.lit("golden-"), F.col("component").cast("string")))
                 .withColumn("matchScore", F.lit(1.0)).drop("component"))
        linked = matched.unionByName(fresh).checkpoint(eager=True)
    affected = linked.select("goldenRecordId").distinct()
    old_members = members.join(affected, "goldenRecordId", "left_semi")
    all_members = old_members.unionByName(linked.select(*old_members.columns))
    merged = merge_golden(all_members, survivorship_config,
                          existing=goldens.join(affected.withColumnRenamed("goldenRecordId", "id"), "id", "left_semi"),
                          batch_ts=batch_ts)
    return IngestResult(linked, merged)


def apply_links(members: DataFrame, commands: DataFrame) -> DataFrame:
    """Manual link / unlink: ``commands(sourceRecordId, goldenRecordId | NULL)``.
    Link sets the golden id with score 1.0; unlink clears it.  Of commands that
    repeat a record one counts (``tables.last_per_key``)."""
    c = last_per_key(commands.select("sourceRecordId", "goldenRecordId"), "sourceRecordId").select(F.col("sourceRecordId").alias("__sid"), F.col("goldenRecordId").alias("__gid"))
    j = members.join(c, members["id"] == c["__sid"], "left")
    hit = F.col("__sid").isNotNull()
    return (j.withColumn("goldenRecordId", F.when(hit, F.col("__gid")).otherwise(F.col("goldenRecordId")))
            .withColumn("matchScore", F.when(hit & F.col("__gid").isNotNull(), F.lit(1.0))
                        .when(hit, F.lit(None)).otherwise(F.col("matchScore")))
            .drop("__sid", "__gid"))


def merge_goldens(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """Merge golden records at once: ``mapping(fromId, toId)`` re-points members of
    ``fromId`` to the end of its chain (merge the golden records there again
    afterwards).  Ids that lead into a cycle stay as they are; see
    ``commands.resolve_redirects`` for the list of them, and ``commands.apply_commands``
    for merges in order of time."""
    ends, _ = resolve_redirects(mapping)
    mp = ends.select(F.col("fromId").alias("__from"), F.col("toId").alias("__to"))
    j = members.join(mp, members["goldenRecordId"] == mp["__from"], "left")
    return j.withColumn("goldenRecordId", F.coalesce(F.col("__to"), F.col("goldenRecordId"))).drop("__from", "__to")


# -- listings and manual records (M13, M13c) --------------------------------------------

def members_of(sources: DataFrame, golden_ids: DataFrame) -> DataFrame:
    """Source records linked to the given golden ids (``golden_ids(id)``)."""
    return sources.join(golden_ids.select(F.col("id").alias("goldenRecordId")), "goldenRecordId", "left_semi")


def unmatched_sources(sources: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Records without a golden record (NULL or empty id)."""
    out = sources.where(F.col("goldenRecordId").isNull() | (F.col("goldenRecordId") == ""))
    return out.where(F.col("entityType") == entity_type) if entity_type else out


def manual_goldens(rows: DataFrame, created_at=None) -> DataFrame:
    """Golden records entered by hand: ``rows(id, entityType, data)`` with no
    sources, confidence 1.0 and no review flag."""
    ts = F.lit(created_at).cast("timestamp") if created_at is not None else F.current_timestamp()
    src_t = "array<struct<sourceSystem:string,contributedFields:array<string>,sourceRecords:bigint,lastUpdatedAt:timestamp>>"
    return rows.select("id", "entityType", "data", F.array().cast(src_t).alias("sources"),
                       F.lit(1.0).alias("confidence"), F.lit(False).alias("needsReview"),
                       ts.alias("createdAt"), ts.alias("updatedAt"), ts.alias("lastMergedAt"))
