"""Pipeline runs: an ordered list of steps compiled into lazy DataFrames.

The original materialises every intermediate collection; here each step only
binds a new lazy DataFrame to its output name, so a whole pipeline is one
Catalyst plan per requested output and runs as a single job when a sink or an
action asks for it.  Per-step row counts come from ``DataFrame.observe``
(filled by that same job, no extra pass).
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ordering import sort_columns
from ..operators.steps import run_step
from ..sources.catalog import Catalog

TEMP_PREFIXES = ("_temp_", "_preview_")


class PipelineError(ValueError):
    pass


@dataclass
class StepResult:
    step_id: str
    status: str  # completed | failed | skipped
    output: str | None = None
    error: str | None = None
    duration_ms: float = 0.0
    observation: Observation | None = None
    input_observations: list = field(default_factory=list)

    def output_rows(self) -> int | None:
        """Rows written by the step, once an action has run the output."""
        return _observed(self.observation)

    def input_rows(self) -> int | None:
        """Rows read by the step (left + right for a join, the source for a
        lookup, the sum for a union), once an action has run the output."""
        counts = [_observed(o) for o in self.input_observations]
        return None if not counts or any(c is None for c in counts) else sum(counts)


def _observed(obs: Observation | None) -> int | None:
    if obs is None:
        return None
    try:
        return int(obs.get.get("rows", 0))
    except Exception:  # noqa: BLE001 - not yet executed
        return None


def _inputs(step: dict) -> list[str]:
    cfg = step["config"]
    if step["type"] == "join":
        return [cfg["left"], cfg["right"]]
    if step["type"] == "union":
        return list(cfg["sources"])
    return [cfg["source"]]


@dataclass
class PipelineRun:
    run_id: str
    pipeline_id: str
    status: str
    steps: list[StepResult]
    outputs: dict[str, DataFrame]
    error: str | None = None


def validate(pipeline: dict) -> None:
    if not pipeline.get("name") and not pipeline.get("id"):
        raise PipelineError("Pipeline name is required")
    steps = pipeline.get("steps")
    if not steps:
        raise PipelineError("Pipeline must have at least one step")
    for s in steps:
        cfg = s.get("config") or {}
        if not cfg.get("output"):
            raise PipelineError(f"Step {s.get('id')} has no output")
        if s.get("type") in ("join",):
            if not cfg.get("left") or not cfg.get("right"):
                raise PipelineError(f"Step {s.get('id')} needs left and right")
        elif s.get("type") == "union":
            if not cfg.get("sources"):
                raise PipelineError(f"Step {s.get('id')} needs sources")
        elif not cfg.get("source"):
            raise PipelineError(f"Step {s.get('id')} has no source")


def run_pipeline(cat: Catalog, pipeline: dict, continue_on_error: bool = False,
                 observe: bool = False) -> PipelineRun:
    """Run steps in array order; a step whose ``dependsOn`` did not all
    complete is skipped; the first failure stops the run unless
    ``continue_on_error`` (the run is then still marked failed)."""
    if pipeline.get("status", "active") != "active":
        raise PipelineError(f"Pipeline {pipeline.get('id')} is not active")
    validate(pipeline)
    results: list[StepResult] = []
    done: set[str] = set()
    failed = False
    error = None
    for step in pipeline["steps"]:
        sid = step.get("id") or str(len(results))
        deps = step.get("dependsOn") or []
        if any(d not in done for d in deps):
            results.append(StepResult(sid, "skipped"))
            continue
        t0 = time.perf_counter()
        saved, in_obs = {}, []
        try:
            if observe:
                # count each input inside the same plan (restored right after)
                for name in dict.fromkeys(_inputs(step)):
                    src = cat.info(name)
                    o = Observation(f"in_{sid}_{uuid.uuid4().hex[:8]}")
                    saved[name] = src
                    cat.put(src.with_df(src.df.observe(o, F.count(F.lit(1)).alias("rows")), name=name))
                    in_obs.append(o)
                if step["type"] == "union":  # a source listed twice counts twice
                    by_name = dict(zip(dict.fromkeys(_inputs(step)), in_obs))
                    in_obs = [by_name[n] for n in _inputs(step)]
            info = run_step(cat, step["type"], step["config"])
            for name, src in saved.items():
                if name != info.name:
                    cat.put(src)
            obs = None
            if observe:
                obs = Observation(f"step_{sid}_{uuid.uuid4().hex[:8]}")
                info.df = info.df.observe(obs, F.count(F.lit(1)).alias("rows"))
                cat.put(info)
            results.append(StepResult(sid, "completed", info.name, None,
                                      (time.perf_counter() - t0) * 1000, obs, in_obs))
            done.add(sid)
        except Exception as exc:  # noqa: BLE001 - recorded per step
            for name, src in saved.items():
                cat.put(src)
            failed = True
            error = f"{type(exc).__name__}: {exc}"
            results.append(StepResult(sid, "failed", step["config"].get("output"), error,
                                      (time.perf_counter() - t0) * 1000))
            if not continue_on_error:
                break
    outputs = {r.output: cat.get(r.output) for r in results
               if r.status == "completed" and cat.has(r.output) and not r.output.startswith(TEMP_PREFIXES)}
    cat.drop_prefixed(*TEMP_PREFIXES)
    return PipelineRun(uuid.uuid4().hex, pipeline.get("id", ""), "failed" if failed else "completed",
                       results, outputs, error)


def preview_step(cat: Catalog, step: dict, limit: int = 10) -> tuple[DataFrame | None, DataFrame | None]:
    """First ``limit`` rows of one step's output and a one-row count frame;
    ``(None, None)`` when the step cannot be built."""
    try:
        cfg = dict(step["config"])
        cfg["output"] = "_preview_" + uuid.uuid4().hex[:8]
        info = run_step(cat, step["type"], cfg)
        df = info.df
        cat.drop_prefixed("_preview_")
        # first rows in table order when the output has one (a bounded top-k)
        head = df.orderBy(*sort_columns(df, info.order_key)).limit(limit) if info.order_key else df.limit(limit)
        return head, df.agg(F.count(F.lit(1)).alias("count"))
    except Exception:  # noqa: BLE001 - preview reports emptiness
        cat.drop_prefixed("_preview_")
        return None, None
