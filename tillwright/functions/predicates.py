"""Row predicates of the transform steps (filter conditions, ``having`` and
``conditional`` expressions).

Every predicate is compiled to a *two-valued* ``Column`` (never NULL), so
``or`` and ``not`` give the same answer as the original boolean evaluation.
Type mismatches are decided at plan time from the schema: the original
compares strictly (``"1"`` never equals ``1``) and only orders numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import TypedCol, family, literal, resolve, two_valued, value_family



def TRUE() -> Column:  # noqa: N802 - constant-like
    return F.lit(True)


def FALSE() -> Column:  # noqa: N802 - constant-like
    return F.lit(False)


STEP_OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "notIn", "contains",
                  "startsWith", "endsWith", "exists", "isNull", "regex")
EXPRESSION_OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "notIn", "exists", "isNull")


def _same_family(tc: TypedCol, v) -> bool:
    vf = value_family(v)
    cf = family(tc.dtype)
    return vf == cf


def strict_eq(tc: TypedCol, v) -> Column:
    """``x === v`` over a typed column (NULL matches a null constant)."""
    if v is None:
        return tc.col.isNull()
    if isinstance(v, float) and math.isnan(v):
        return FALSE()
    if isinstance(v, (list, dict)):
        return FALSE()  # object identity: a constant array / object never equals a stored one
    if not _same_family(tc, v):
        return FALSE()
    # Spark orders NaN equal to itself only, so ``<=>`` against a number is
    # already false for NaN, as in the original.
    return tc.col.eqNullSafe(literal(v).col)


def numeric_cmp(tc: TypedCol, op: str, v, bare: bool = False) -> Column:
    if value_family(v) != "number" or family(tc.dtype) != "number":
        return FALSE()
    c = tc.col
    lit = F.lit(v)
    cmp = {"gt": c > lit, "gte": c >= lit, "lt": c < lit, "lte": c <= lit}[op]
    if op in ("gt", "gte") and isinstance(tc.dtype, (T.FloatType, T.DoubleType)):
        # Spark sorts NaN above every number; ``c <= inf`` drops NaN and, unlike
        # isnan(), still translates into a parquet filter (also inside OR trees)
        cmp = cmp & (c <= F.lit(float("inf")))
    if isinstance(v, float) and math.isnan(v):
        return FALSE()
    return cmp if bare else two_valued(cmp)


def membership(tc: TypedCol, values, bare: bool = False) -> Column:
    """``values.includes(x)`` with strict typing; NULL is found by a null entry.
    ``bare`` keeps a plain IN (NULL for NULL input) so it can be pushed down."""
    if not isinstance(values, (list, tuple)):
        return FALSE()
    same = [v for v in values if v is not None and _same_family(tc, v)
            and not (isinstance(v, float) and math.isnan(v))]
    out = FALSE()
    if same:
        isin = tc.col.isin(*[literal(v).col for v in same])
        out = isin if bare else two_valued(isin)
    if any(v is None for v in values):
        out = out | tc.col.isNull()
    return out


def string_test(tc: TypedCol, op: str, v, bare: bool = False) -> Column:
    if family(tc.dtype) != "string" or not isinstance(v, str):
        return FALSE()
    c = tc.col
    if op == "contains":
        e = c.contains(v)
    elif op == "startsWith":
        e = c.startswith(v)
    elif op == "endsWith":
        e = c.endswith(v)
    elif op == "regex":
        e = c.rlike(v)
    else:
        raise ValueError(op)
    return e if bare else two_valued(e)


def condition(schema: T.StructType, cond: dict, allowed=STEP_OPERATORS,
              bare: bool = False) -> Column:
    """Compile ``{field, operator, value}`` to a two-valued ``Column``.

    ``bare=True`` leaves comparisons unwrapped (NULL instead of false) for
    places where the two coincide - a top-level ``where`` conjunct or a
    ``when`` branch - so that Catalyst can push them into the parquet scan.
    """
    op = cond.get("operator")
    tc = resolve(schema, cond["field"])
    v = cond.get("value")
    if op not in allowed:
        return FALSE()
    if op == "eq":
        return strict_eq(tc, v)
    if op == "ne":
        return ~strict_eq(tc, v)
    if op in ("gt", "gte", "lt", "lte"):
        return numeric_cmp(tc, op, v, bare)
    if op == "in":
        return membership(tc, v, bare)
    if op == "notIn":
        if not isinstance(v, (list, tuple)):
            return FALSE()
        return ~membership(tc, v)
    if op in ("contains", "startsWith", "endsWith", "regex"):
        return string_test(tc, op, v, bare)
    if op == "exists":
        return FALSE() if tc.missing else tc.col.isNotNull()
    if op == "isNull":
        return TRUE() if tc.missing else tc.col.isNull()
    return FALSE()


def conditions(schema: T.StructType, conds: list, logic: str = "and",
               allowed=STEP_OPERATORS, bare: bool = True) -> Column:
    """Conjunction / disjunction of conditions; an empty list keeps every row.

    Used as a row filter, NULL and false both drop the row, so neither
    ``and`` nor ``or`` needs the two-valued wrapping (only negations do,
    and those are built two-valued inside ``condition``).
    """
    if not conds:
        return TRUE()
    cols = [condition(schema, c, allowed, bare) for c in conds]
    out = cols[0]
    for c in cols[1:]:
        out = (out & c) if logic != "or" else (out | c)
    return out


def expression_condition(schema: T.StructType, cond: dict, bare: bool = False) -> Column:
    return condition(schema, cond, EXPRESSION_OPERATORS, bare)
