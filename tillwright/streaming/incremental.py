"""Incremental variants on Structured Streaming.

* ``stream_steps`` runs the stateless pipeline steps (filter, map, flatten,
  unpivot, lookup against a static table) on a streaming DataFrame with the
  very same compiled columns as the batch pipeline.  Steps that need the
  whole input or its order (sort, limit, deduplicate, pivot, aggregate,
  union, join of two streams) are rejected up front.
* ``ingest_stream`` is incremental ingest-and-match: every micro-batch runs
  the batch ``ingest_batch`` against the golden table as of that batch and
  writes a delta (re-merged goldens, new links) under a state folder;
  snapshots compact the deltas now and then.  Versions are keyed by the batch
  id, so a retried batch rewrites the same version (idempotent), and the
  state folder must be shared storage (by default a folder under the
  session's ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mdm.ingest import ingest_batch
from ..operators.steps import run_step
from ..session import checkpoint_dir
from ..sources.catalog import Catalog

STREAMABLE = ("filter", "map", "flatten", "unpivot", "lookup")


class StreamingStepError(ValueError):
    pass


def stream_steps(cat: Catalog, source: str, steps: list[dict]) -> DataFrame:
    """Apply stateless steps to the streaming table ``source``; returns the
    last step's streaming DataFrame."""
    last = None
    for s in steps:
        if s["type"] not in STREAMABLE:
            raise StreamingStepError(
                f"step {s.get('id')!r} ({s['type']}) needs the whole input or its order; "
                "run it on the batch table instead")
        if s["type"] == "lookup" and cat.get(s["config"]["from"]).isStreaming:
            raise StreamingStepError("lookup must read a static table")
        last = run_step(cat, s["type"], s["config"])
    if last is None:
        return cat.get(source)
    return last.df


def run_to_table(df: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Drive a streaming DataFrame over all available input into a Parquet table
    of the shared folder, written by the tasks, and return it as a batch DataFrame."""
    spark = df.sparkSession
    base = os.path.join(checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex[:8]}")
    out = path or os.path.join(base, "rows")
    q = (df.writeStream.format("parquet").option("path", out).outputMode("append")
         .option("checkpointLocation", checkpoint or os.path.join(base, "checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(df.schema).parquet(out)


def _version_path(root: str, table: str, version: int, snapshot: bool = False) -> str:
    return os.path.join(root, table, f"{'s' if snapshot else 'd'}{version:010d}")


def _committed(spark: SparkSession, root: str, table: str) -> list[tuple[int, bool, str]]:
    """Committed versions ``(version, is_snapshot, path)`` in version order."""
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(os.path.join(root, table))
    fs = base.getFileSystem(hconf)
    if not fs.exists(base):
        return []
    out = []
    for st in fs.listStatus(base):
        name = st.getPath().getName()
        if name[:1] in ("s", "d") and name[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append((int(name[1:]), name[0] == "s", os.path.join(root, table, name)))
    return sorted(out)


def read_state(spark: SparkSession, root: str, table: str, key: str = "id") -> DataFrame:
    """Current rows: the latest snapshot plus later deltas, newest version of
    each key wins (a hash aggregate; no full rewrite per micro-batch)."""
    versions = _committed(spark, root, table)
    if not versions:
        raise FileNotFoundError(f"no committed version of {table} under {root}")
    snaps = [v for v in versions if v[1]]
    start = snaps[-1][0] if snaps else -1
    live = [v for v in versions if (v[1] and v[0] == start) or (not v[1] and v[0] > start)]
    frames = [spark.read.parquet(path).withColumn("__ver", F.lit(ver)) for ver, _, path in live]
    allv = frames[0]
    for f in frames[1:]:
        allv = allv.unionByName(f)
    if len(frames) == 1:
        return allv.drop("__ver")
    cols = [c for c in allv.columns if c != "__ver"]
    return (allv.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols]), F.col("__ver")).alias("__r"))
            .select("__r.*"))


def ingest_stream(spark: SparkSession, sources: DataFrame, match_config: dict, survivorship_config: dict,
                  state_dir: str | None = None, golden_seed: DataFrame | None = None,
                  member_seed: DataFrame | None = None, query_name: str | None = None,
                  available_now: bool = True, compact_every: int = 20):
    """Start incremental ingest-and-match over the streaming ``sources``.

    Each micro-batch writes only the re-merged golden records and the new
    links as a delta version keyed by the batch id (a retried batch rewrites
    the same delta); every ``compact_every`` batches a snapshot replaces the
    chain of deltas.  Returns ``(query, state_dir)``; read with ``read_state``.
    """
    root = state_dir or os.path.join(checkpoint_dir(spark), f"mdm-state-{uuid.uuid4().hex[:8]}")
    if golden_seed is not None and not _committed(spark, root, "goldens"):
        golden_seed.write.mode("overwrite").parquet(_version_path(root, "goldens", 0, snapshot=True))
        member_seed.write.mode("overwrite").parquet(_version_path(root, "members", 0, snapshot=True))

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.persist()  # read the micro-batch once, not once per action
        try:
            _ingest(df, epoch)
        finally:
            df.unpersist()

    def _ingest(df: DataFrame, epoch: int) -> None:
        probe = df.agg(F.count(F.lit(1)).alias("n"),
                       (F.max("ingestedAt") if "ingestedAt" in df.columns else F.lit(None)).alias("ts")).first()
        if probe["n"] == 0:
            return
        sp = df.sparkSession
        goldens = read_state(sp, root, "goldens")
        members = read_state(sp, root, "members")
        ts = probe["ts"]
        res = ingest_batch(sp, df.drop("ingestedAt") if "ingestedAt" in df.columns else df, goldens, members,
                           match_config, survivorship_config, ts)
        version = epoch + 1
        res.goldens.select(*goldens.columns).write.mode("overwrite").parquet(_version_path(root, "goldens", version))
        res.sources.select(*members.columns).write.mode("overwrite").parquet(_version_path(root, "members", version))
        if version % compact_every == 0:
            for table in ("goldens", "members"):
                read_state(sp, root, table).write.mode("overwrite").parquet(
                    _version_path(root, table, version, snapshot=True))

    writer = sources.writeStream.foreachBatch(batch).option(
        "checkpointLocation", os.path.join(root, "_checkpoint"))
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(), root
