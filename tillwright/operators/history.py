"""Aggregates over the history that a workflow execution carries.

An execution's ``history`` is an array of entries in the order they were written
(``stepId``, ``stepType``, ``status``: started / completed / failed / skipped,
``timestamp``, ``durationMs``).  Everything is a fold over that array inside
its row: no explode and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSED = ("completed", "failed", "skipped")


def _count(entries: Column, status: str) -> Column:
    return F.size(F.filter(entries, lambda e: e["status"] == status)).cast("long")


def _duration(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + F.coalesce(e["durationMs"].cast("double"), F.lit(0.0)))


def history_stats(executions: DataFrame, history: str = "history") -> DataFrame:
    """``executions`` with, for each:

    * ``entries``, ``started``, ``completed``, ``failed``, ``skipped``: numbers of entries;
    * ``retries``: starts of a step that had started before;
    * ``totalMs`` and ``stepMs`` (by step): durations;
    * ``longestGapMs``: longest time between neighbouring entries (NULL below two);
    * ``currentStep``: the step started last that no later entry closes (NULL if none);
    * ``lastStatus``: of the last entry.

    A NULL or empty history counts nothing; NULL durations count 0.
    """
    h = F.coalesce(F.col(history), F.array().cast(executions.schema[history].dataType))
    starts = F.filter(h, lambda e: e["status"] == "started")
    placed = F.transform(h, lambda e, i: F.struct(i.alias("i"), e["stepId"].alias("stepId"), e["status"].alias("status")))
    closed = lambda s: F.exists(placed, lambda x: (x["i"] > s["i"]) & x["stepId"].eqNullSafe(s["stepId"]) & x["status"].isin(*CLOSED))
    open_ = F.filter(placed, lambda s: (s["status"] == "started") & ~closed(s))
    steps = F.array_distinct(F.filter(F.transform(h, lambda e: e["stepId"]), lambda x: x.isNotNull()))
    by_step = F.map_from_entries(F.transform(steps, lambda s: F.struct(s, _duration(F.filter(h, lambda e: e["stepId"] == s)))))
    gaps = F.transform(F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda e, i: (F.unix_micros(e["timestamp"]) - F.unix_micros(F.get(h, i)["timestamp"])) / 1000)
    return executions.withColumns({
        "entries": F.size(h).cast("long"), **{s: _count(h, s) for s in ("started", *CLOSED)},
        "retries": (F.size(starts) - F.size(F.array_distinct(F.transform(starts, lambda e: e["stepId"])))).cast("long"),
        "totalMs": _duration(h), "stepMs": by_step, "longestGapMs": F.array_max(gaps),
        "currentStep": F.get(F.reverse(open_), F.lit(0))["stepId"],
        "lastStatus": F.get(F.reverse(h), F.lit(0))["status"]})
