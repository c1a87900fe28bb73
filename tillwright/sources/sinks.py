"""Sinks: overwrite / append outputs, message log, pipeline run history.

``write_table`` refuses to overwrite a path the plan is still reading (the
original computes a step's rows before clearing its output collection, so
``source == output`` is legal there): such a plan is first materialised with
a reliable checkpoint in the shared checkpoint folder, then written.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import last_per_key
from ..session import checkpoint_dir


def _norm(path: str) -> str:
    p = path[len("file:"):] if path.startswith("file:") else path
    return os.path.normpath(p)


def _roots(df: DataFrame) -> list[str]:
    """Root paths of the files that a plan scans: metadata of its relations, not the list of files."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    out = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            out += [paths.apply(k).toString() for k in range(paths.size())]
    return out


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: list[str] | None = None, id_col: str | None = None) -> None:
    """Write a step's output; with ``id_col`` rows without an id get a UUID."""
    if id_col:
        given = F.col(id_col) if id_col in df.columns else F.lit(None).cast("string")
        df = df.withColumn(id_col, F.coalesce(given, F.expr("uuid()")))
    target = _norm(path)
    reads_target = any(_norm(f).startswith(target + os.sep) or _norm(f) == target or target.startswith(_norm(f) + os.sep) for f in _roots(df))
    if reads_target and mode == "overwrite":
        checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)  # cut the read of ``path`` before replacing it
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


# -- sent-message log (S11) ----------------------------------------------------------

def query_log(log: DataFrame, recipient=None, template_id=None, status=None) -> DataFrame:
    out = log
    if recipient is not None:
        out = out.where(F.col("recipient") == recipient)
    if template_id is not None:
        out = out.where(F.col("templateId") == template_id)
    if status is not None:
        out = out.where(F.col("status").isin([status] if isinstance(status, str) else list(status)))
    return out


def update_status(log: DataFrame, updates: DataFrame, at=None) -> DataFrame:
    """``updates(id, status, error?, at?)`` -> log with new status, ``updatedAt`` and error.
    Of updates that repeat an id one counts: the last by ``at``, without it see ``tables.last_per_key``."""
    updates = last_per_key(updates, "id", ("at",) if "at" in updates.columns else ())
    ts = F.lit(at).cast("timestamp") if at is not None else F.current_timestamp()
    u = updates.select(F.col("id").alias("__id"), F.col("status").alias("__st"),
                       (F.col("error") if "error" in updates.columns else F.lit(None).cast("string")).alias("__err"))
    j = log.join(u, log["id"] == u["__id"], "left")
    hit = F.col("__id").isNotNull()
    base = j.withColumn("status", F.when(hit, F.col("__st")).otherwise(F.col("status")))
    if "updatedAt" in log.columns:
        base = base.withColumn("updatedAt", F.when(hit, ts).otherwise(F.col("updatedAt")))
    else:
        base = base.withColumn("updatedAt", F.when(hit, ts))
    if "error" in log.columns:
        base = base.withColumn("error", F.when(hit, F.col("__err")).otherwise(F.col("error")))
    else:
        base = base.withColumn("error", F.when(hit, F.col("__err")))
    return base.drop("__id", "__st", "__err")


# -- pipeline run history (R3) ----------------------------------------------------------

RUN_SCHEMA = T.StructType([
    T.StructField("runId", T.StringType()), T.StructField("pipelineId", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("startedAt", T.TimestampType()),
    T.StructField("steps", T.ArrayType(T.StructType([
        T.StructField("stepId", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("output", T.StringType()), T.StructField("error", T.StringType()),
        T.StructField("durationMs", T.DoubleType()), T.StructField("outputRows", T.LongType())]))),
])


def runs_frame(spark: SparkSession, runs: list, started_at=None) -> DataFrame:
    """Run records (one row per pipeline run; a handful of rows of metadata)."""
    ts = started_at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rows = [(r.run_id, r.pipeline_id, r.status, r.error, ts,
             [(s.step_id, s.status, s.output, s.error, float(s.duration_ms), s.output_rows()) for s in r.steps])
            for r in runs]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def runs_of(history: DataFrame, pipeline_id: str) -> DataFrame:
    return history.where(F.col("pipelineId") == pipeline_id)
