"""Rule routing over a table of contexts (one row = one workflow context).

A workflow graph of ``condition`` / ``action`` / ``end`` steps runs in its
topological levels: a state column says at which step a row is, and each level
moves the rows that are at one of its steps.  So a step is compiled once,
however many branches lead to it.  ``setContext`` actions rewrite context
columns for the rows at them.  Entity and message actions are emitted as rows
(``actions`` array), to be applied in bulk with the table operators.

Conditions coerce like the original: ordering operators compare
``Number(x)`` (NaN -> false), string operators compare ``String(x)`` (NULL
prints as ``"undefined"``).  ``exists`` over another table is a correlated
EXISTS (semi / existence join) for ``==``; ordered comparisons against a
context value reduce to one min / max aggregate of the other table, so no
row-by-row theta join is needed, and ``!=`` to a count, a least and a largest
value.  ``contains`` looks the distinct context values up in a trigram index of
the other table (an equi join on the rarest trigram of each, then a comparison),
``startsWith`` and ``endsWith`` in its prefixes and suffixes of the lengths
asked for; only ``matches`` against a context value, where the pattern differs
from row to row, needs a table of proven small size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import TypedCol, family, js_number, js_text, literal, resolve
from ..session import written
from ..sources.catalog import Catalog

EXISTS_BROADCAST_ROWS = 100_000


class WorkflowError(ValueError):
    pass


END = "\x00end"  # where a step without a next one leads


def _path(p: str) -> str:
    return p.replace("[", ".").replace("]", "")


def _next(step: dict) -> list[str]:
    keys = {"condition": ("onTrue", "onFalse"), "action": ("next",)}.get(step["type"], ())
    return [step[k] for k in keys if step.get(k)]


def _sets(step: dict) -> list[str]:
    act = step.get("action") or {}
    return list(act.get("values") or {}) if step["type"] == "action" and act["type"] == "setContext" else []


def _levels(steps: dict, start: str) -> tuple[list[list[str]], dict[str, set[str]]]:
    """Steps that ``start`` leads to, in levels (after all that lead to them), and the context paths that may be set before each."""
    found, stack = set(), [start] if start in steps else []
    while stack:
        sid = stack.pop()
        if sid not in found:
            found.add(sid)
            stack += [t for t in _next(steps[sid]) if t in steps]
    waits = {s: 0 for s in found}
    for s in found:
        for t in set(_next(steps[s])) & found:
            waits[t] += 1
    levels, before, now = [], {s: set() for s in found}, [s for s in found if not waits[s]]
    while now:
        levels.append(sorted(now))
        after = []
        for s in levels[-1]:
            for t in set(_next(steps[s])) & found:
                before[t] |= before[s] | {_path(k) for k in _sets(steps[s])}
                waits[t] -= 1
                if not waits[t]:
                    after.append(t)
        now = after
    if sum(map(len, levels)) < len(found):
        raise WorkflowError(f"cycle through steps {sorted(s for s in found if waits[s])}")
    return levels, before


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def substrings_found(values: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``values(v)`` that some of ``texts(text)`` contains.

    Values of three characters and more meet the texts that hold their rarest
    trigram; a trigram that no text holds rules a value out.  Shorter values are
    looked up among the runs of one and two characters.
    """
    held = written(texts.where("text is not null").distinct().withColumn("t", F.monotonically_increasing_id()), "texts")
    v = F.col("v")
    short = held.select(F.explode(F.concat(F.array(F.lit("")), _grams(F.col("text"), 1), _grams(F.col("text"), 2))).alias("v")).distinct()
    small = values.where(F.length(v) < 3).join(short, "v", "left_semi")
    index = written(held.select("t", F.explode(_grams(F.col("text"), 3)).alias("gram")), "trigrams")
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = values.where(F.length(v) >= 3).select("v", F.explode(_grams(v, 3)).alias("gram")).join(often, "gram", "left")
    rare = asked.groupBy("v").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    near = rare.join(index, "gram").select("v", "t").join(held, "t")
    return near.where(F.col("text").contains(v)).select("v").distinct().unionByName(small)


def edges_found(values: DataFrame, texts: DataFrame, start: bool) -> DataFrame:
    """The ``values(v)`` that some of ``texts(text)`` starts (ends) with, by its prefixes (suffixes) of the lengths asked for."""
    lengths = values.agg(F.array_sort(F.collect_set(F.length("v"))).alias("ns"))
    text, n = F.col("text"), F.col("n")
    each = texts.where("text is not null").distinct().withColumn("l", F.length("text"))
    wanted = lengths.select(F.explode("ns").alias("n"))
    longest = wanted.agg(F.max("n")).scalar()
    cut = each.select("text", "l", F.explode(F.sequence(F.lit(0), F.least("l", longest))).alias("n")).join(F.broadcast(wanted), "n")
    edge = F.substring(text, F.lit(1), n) if start else F.substring(text, F.col("l") - n + 1, n)
    return values.join(cut.select(edge.alias("v")).distinct(), "v", "left_semi")


class RuleCompiler:
    def __init__(self, cat: Catalog, contexts: DataFrame):
        self.cat = cat
        self.df = contexts
        self.cur = contexts  # the contexts with state columns and what was looked up

    # -- values ------------------------------------------------------------------
    def value(self, src: dict, ctx: dict[str, TypedCol]) -> TypedCol:
        if src["type"] == "constant":
            return literal(src.get("value"))
        p = _path(src["path"])
        if p in ctx:
            return ctx[p]
        return resolve(self.df.schema, p)

    @staticmethod
    def _text(tc: TypedCol) -> Column:
        return js_text(tc, null_as="undefined") if tc.missing else F.coalesce(js_text(tc), F.lit("null"))

    @staticmethod
    def _strict_eq(a: TypedCol, b: TypedCol) -> Column:
        if a.missing or b.missing:
            other = b if a.missing else a
            return other.col.isNull() if not (a.missing and b.missing) else F.lit(True)
        if family(a.dtype) != family(b.dtype) or family(a.dtype) in ("array", "object", "date"):
            return F.lit(False)
        return a.col.eqNullSafe(b.col)

    def compare(self, op: str, a: TypedCol, b: TypedCol) -> Column:
        if op == "==":
            return self._strict_eq(a, b)
        if op == "!=":
            return ~self._strict_eq(a, b)
        if op in (">", ">=", "<", "<="):
            x, y = js_number(a), js_number(b)
            cmp = {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]
            return F.coalesce(cmp & ~F.isnan(x) & ~F.isnan(y), F.lit(False))
        sa, sb = self._text(a), self._text(b)
        if op == "contains":
            return F.coalesce(sa.contains(sb), F.lit(False))
        if op == "startsWith":
            return F.coalesce(sa.startswith(sb), F.lit(False))
        if op == "endsWith":
            return F.coalesce(sa.endswith(sb), F.lit(False))
        if op == "matches":
            return F.coalesce(F.rlike(sa, sb), F.lit(False))
        return F.lit(False)

    # -- conditions ----------------------------------------------------------------
    def condition(self, c: dict, ctx: dict[str, TypedCol]) -> Column:
        t = c["type"]
        if t == "compare":
            return self.compare(c["operator"], self.value(c["left"], ctx), self.value(c["right"], ctx))
        if t == "and":
            parts = [self.condition(x, ctx) for x in c.get("conditions") or []]
            return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
        if t == "or":
            parts = [self.condition(x, ctx) for x in c.get("conditions") or []]
            return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
        if t == "not":
            return ~self.condition(c["condition"], ctx)
        if t == "exists":
            return self.exists(c, ctx)
        return F.lit(False)

    def exists(self, c: dict, ctx: dict[str, TypedCol]) -> Column:
        if not self.cat.has(c["collection"]):
            return F.lit(False)
        other = self.cat.get(c["collection"])
        flt = c["filter"]
        field = resolve(other.schema, _path(flt["field"]))
        if field.missing:
            return F.lit(False)
        val = self.value(flt["value"], ctx)
        op = flt["operator"]
        if flt["value"]["type"] == "constant":
            hit = other.where(self.compare(op, field, val)).limit(1)
            return F.coalesce(hit.select(F.lit(True)).scalar(), F.lit(False))
        outer = TypedCol(val.col.outer(), val.dtype)
        if op in (">", ">=", "<", "<="):
            num = js_number(field)
            agg = F.max(F.when(~F.isnan(num), num)) if op in (">", ">=") else F.min(F.when(~F.isnan(num), num))
            bound = other.agg(agg.alias("b")).select("b").scalar()
            v = js_number(val)
            cmp = {">": bound > v, ">=": bound >= v, "<": bound < v, "<=": bound <= v}[op]
            return F.coalesce(cmp & ~F.isnan(v), F.lit(False))
        if op == "!=":
            # some row differs from v  <=>  not every row equals v: one-row aggregate
            comparable = family(field.dtype) == family(val.dtype) and family(field.dtype) not in ("array", "object", "date")
            stats = other.agg(F.count(F.lit(1)).alias("n"), F.count(field.col).alias("nn"),
                              F.min(field.col).alias("lo") if comparable else F.lit(None).alias("lo"),
                              F.max(field.col).alias("hi") if comparable else F.lit(None).alias("hi"))
            n = stats.select("n").scalar()
            nn = stats.select("nn").scalar()
            if val.missing:
                return F.coalesce(nn > 0, F.lit(False))
            if not comparable:
                return F.coalesce(n > 0, F.lit(False))
            lo, hi = stats.select("lo").scalar(), stats.select("hi").scalar()
            all_equal = val.col.isNotNull() & (nn == n) & (lo == val.col) & (hi == val.col)
            all_null = val.col.isNull() & (nn == 0)
            return F.coalesce((n > 0) & ~(all_equal | all_null), F.lit(False))
        if op == "==":
            return other.where(self.compare(op, field, outer)).exists()
        if op in ("contains", "startsWith", "endsWith"):
            return self._looked_up(op, other.select(self._text(field).alias("text")), self._text(val))
        # a pattern per row has no equi form: only a collection of proven small size may be broadcast for it
        rows = other.limit(EXISTS_BROADCAST_ROWS + 1).count()
        if rows > EXISTS_BROADCAST_ROWS:
            raise WorkflowError(
                f"exists with {op!r} against a context value needs a collection of at most "
                f"{EXISTS_BROADCAST_ROWS} rows; {c['collection']!r} is larger")
        return F.broadcast(other).where(self.compare(op, field, outer)).exists()

    def _looked_up(self, op: str, texts: DataFrame, value: Column) -> Column:
        """Whether some text contains (starts, ends with) the row's value: by the distinct values, joined back."""
        name = f"__exists{len(self.cur.columns)}"
        values = written(self.cur.select(value.alias("v")).distinct(), "values")
        found = (substrings_found(values, texts) if op == "contains" else edges_found(values, texts, op == "startsWith")).select(F.col("v").alias("__v"), F.lit(True).alias(name))
        self.cur = self.cur.join(found, value == F.col("__v"), "left").drop("__v")
        return F.coalesce(F.col(name), F.lit(False))

    # -- graph -----------------------------------------------------------------------
    def route(self, workflow: dict) -> DataFrame:
        steps = {s["id"]: s for s in workflow["steps"]}
        start = workflow.get("startStepId") or workflow["steps"][0]["id"]
        levels, set_before = _levels(steps, start)
        paths = sorted({_path(k) for level in levels for sid in level for k in _sets(steps[sid])})
        slot = {p: f"__ctx{i}" for i, p in enumerate(paths)}
        nowhere = F.lit(None).cast("string")
        self.cur = self.df.withColumns({
            "__at": F.lit(start), "__status": nowhere, "__reason": nowhere, "__outcome": nowhere, "__path": F.array().cast("array<string>"),
            "__actions": F.array().cast(T.ArrayType(self.ACTION)), **{c: self._base(p) for p, c in slot.items()}})
        if start not in steps:
            self.cur = self.cur.withColumns({"__status": F.lit("failed"), "__reason": F.lit(f"Step {start} not found")})
        for level in levels:
            self._advance(steps, level, slot, set_before)
        out = self.cur
        cols = [F.col(f"`{c}`") for c in self.df.columns if c not in slot]
        return out.select(*cols, *[F.col(c).alias(p) for p, c in slot.items()], F.col("__outcome").alias("outcome"), F.col("__status").alias("status"),
                          F.col("__reason").alias("reason"), F.col("__path").alias("path"), F.col("__actions").alias("actions"))

    def _advance(self, steps, level, slot, set_before) -> None:
        """Move the rows that are at a step of this level."""
        types = {f.name: f.dataType for f in self.cur.schema}
        at, done = F.col("__at"), F.lit(END)
        target, outcome, status, reason, actions = ({} for _ in range(5))
        sets: dict[str, dict] = {}
        for sid in level:
            step = steps[sid]
            ctx = {p: TypedCol(F.col(slot[p]), types[slot[p]]) for p in set_before[sid]}
            kind = step["type"]
            if kind == "condition":
                cond = self.condition(step["condition"], ctx)
                target[sid] = F.when(cond, F.lit(step.get("onTrue") or END)).otherwise(F.lit(step.get("onFalse") or END))
                continue
            if kind == "action":
                act = step["action"]
                if act["type"] == "setContext":
                    for k, v in (act.get("values") or {}).items():  # all values are those before the step
                        sets.setdefault(_path(k), {})[sid] = self.value(v, ctx).col
                else:
                    actions[sid] = self._emit(sid, act, ctx)
                target[sid] = F.lit(step.get("next") or END)
                continue
            ended = kind == "end"
            target[sid] = F.lit(None).cast("string")
            outcome[sid] = F.lit(sid)
            status[sid] = F.lit((step.get("status") or "completed") if ended else "failed")
            reason[sid] = F.lit(step.get("reason") if ended else f"unsupported step type {kind}").cast("string")
        here = at.isin(*level)

        def pick(by: dict, default: Column) -> Column:
            out = default
            for sid, col in by.items():
                out = F.when(at == sid, col).otherwise(out)
            return out

        cols = {"__to": pick(target, F.lit(None).cast("string")), "__outcome": pick(outcome, F.col("__outcome")), "__status": pick(status, F.col("__status")),
                "__reason": pick(reason, F.col("__reason")), "__path": F.when(here, F.concat("__path", F.array(at))).otherwise(F.col("__path"))}
        if actions:
            cols["__actions"] = pick({sid: F.concat("__actions", F.array(a)) for sid, a in actions.items()}, F.col("__actions"))
        cols |= {slot[p]: pick(by, F.col(slot[p])) for p, by in sets.items()}
        to = F.col("__to")
        known = to.isin(*steps)
        moved = self.cur.withColumns(cols)
        self.cur = moved.withColumns({
            "__at": F.when(here, F.when(known, to)).otherwise(at),
            "__status": F.when(here & (to == done), F.lit("completed")).when(here & to.isNotNull() & ~known, F.lit("failed")).otherwise(F.col("__status")),
            "__reason": F.when(here & to.isNotNull() & ~known & (to != done), F.concat(F.lit("Step "), to, F.lit(" not found"))).otherwise(F.col("__reason")),
        }).drop("__to")

    ACTION = T.StructType([T.StructField("step", T.StringType()), T.StructField("type", T.StringType()),
                           T.StructField("collection", T.StringType()), T.StructField("payload", T.StringType())])

    def _emit(self, sid, act, ctx) -> Column:
        data = act.get("data") or act.get("values") or {}
        payload = F.to_json(F.struct(*[self.value(v, ctx).col.alias(k) for k, v in data.items()])) if data \
            else F.lit(None).cast("string")
        return F.struct(F.lit(sid).alias("step"), F.lit(act["type"]).alias("type"),
                        F.lit(act.get("collection")).cast("string").alias("collection"), payload.alias("payload"))

    def _base(self, path: str) -> Column:
        tc = resolve(self.df.schema, path)
        return tc.col


def route(cat: Catalog, contexts: DataFrame, workflow: dict) -> DataFrame:
    """Contexts with ``outcome`` (end step id), ``status``, ``reason``,
    ``path`` (visited step ids), ``actions`` and the rewritten context columns."""
    return RuleCompiler(cat, contexts).route(workflow)


def actions_of(routed: DataFrame, key: str) -> DataFrame:
    """One row per emitted action: ``(key, step, type, collection, payload)``."""
    return routed.select(F.col(key), F.explode("actions").alias("a")).select(
        key, "a.step", "a.type", "a.collection", "a.payload")


def action_rows(actions: DataFrame, action_type: str, collection: str, schema) -> DataFrame:
    """Typed rows of one action kind for one table (payload JSON parsed with
    ``schema``), ready for the bulk insert / patch / delete operators."""
    sel = actions.where((F.col("type") == action_type) & (F.col("collection") == collection))
    return sel.select(F.from_json("payload", schema).alias("r")).select("r.*")
