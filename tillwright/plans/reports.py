"""Reports: filter -> first N rows -> projection, or a storage aggregate.

``execute_report`` returns the lazy data and a ``ReportResult`` whose
metadata (row count, truncated flag) needs one small job: ``limit(n + 1)``
tells whether more rows exist without counting the whole table.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import sort_columns
from ..functions.values import resolve
from ..operators.query import FilterCompiler, storage_aggregate
from ..sources.catalog import Catalog

DEFAULT_LIMIT = 1000


class ReportError(ValueError):
    pass


@dataclass
class ReportResult:
    report_id: str
    data: DataFrame
    limit: int | None
    _probe: DataFrame | None = None
    started: float = field(default_factory=time.time)

    def metadata(self) -> dict:
        """``rowCount``, ``truncated``, ``durationMs`` (runs one bounded job)."""
        if self._probe is None:
            n = self.data.count()
            truncated = False
        else:
            n_probe = self._probe.count()
            truncated = n_probe > self.limit
            n = min(n_probe, self.limit)
        return {"reportId": self.report_id, "rowCount": n, "truncated": truncated,
                "durationMs": (time.time() - self.started) * 1000}


def _project(df: DataFrame, columns: list[dict]) -> DataFrame:
    """Output key is the dotted path itself (``label`` is metadata only)."""
    return df.select(*[resolve(df.schema, c["field"]).col.alias(c["field"]) for c in columns])


def execute_report(cat: Catalog, report: dict) -> ReportResult:
    if report.get("status") == "archived":
        raise ReportError(f"Report {report.get('id')} is archived")
    table = report["collection"]
    if not cat.has(table):
        raise ReportError(f"Collection {table!r} not found")
    rid = report.get("id", "preview")
    agg = report.get("aggregation")
    if agg:
        # report-level filter and limit do not apply to aggregate reports; a
        # report without groupBy is exactly one row and ignores having
        opts = dict(agg)
        if not opts.get("groupBy"):
            opts.pop("having", None)
        return ReportResult(rid, storage_aggregate(cat, table, opts), None)
    info = cat.info(table)
    df = FilterCompiler(cat).apply(table, report.get("filter"))
    limit = int(report.get("limit") or DEFAULT_LIMIT)
    if info.order_key:
        df = df.orderBy(*sort_columns(df, info.order_key))
    probe = df.limit(limit + 1)
    data = df.limit(limit)  # limit before projection, as in the original
    columns = report.get("columns") or []
    if columns:
        data = _project(data, columns)
    return ReportResult(rid, data, limit, probe)


def preview_report(cat: Catalog, report: dict) -> ReportResult:
    r = dict(report)
    r["id"] = "preview"
    r.pop("status", None)
    return execute_report(cat, r)


# -- execution-log query (R9) ------------------------------------------------------

def list_executions(log: DataFrame, workflow_id=None, status=None, started_after=None,
                    started_before=None, workflow_col="workflowId", status_col="status",
                    started_col="startedAt") -> DataFrame:
    """Filter an execution log; time bounds are exclusive."""
    out = log
    if workflow_id is not None:
        out = out.where(F.col(workflow_col) == F.lit(workflow_id))
    if status is not None:
        statuses = [status] if isinstance(status, str) else list(status)
        out = out.where(F.col(status_col).isin(statuses))
    if started_after is not None:
        out = out.where(F.col(started_col) > F.lit(started_after))
    if started_before is not None:
        out = out.where(F.col(started_col) < F.lit(started_before))
    return out
