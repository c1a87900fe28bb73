"""Aggregate functions of the transform model as native aggregate columns.

All of them are ordinary hash aggregates (partial aggregation map-side), so a
group holding a third of the table is combined in pieces, never in one task.
``first`` / ``last`` / ``collect`` follow the table's order key; they never
use ``F.first`` (non-deterministic after a shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import order_struct, require
from .values import TypedCol, family, resolve

FUNCTIONS = ("sum", "avg", "count", "min", "max", "first", "last", "collect", "countDistinct")


def agg_column(df: DataFrame, field: str, fn: str, order_key=(), rows_filter: Column | None = None) -> Column:
    """One aggregate over ``field``; ``rows_filter`` restricts the rows (pivot)."""
    keep = rows_filter if rows_filter is not None else F.lit(True)

    if fn == "count":
        return F.count(F.when(keep, F.lit(1)))
    if field == "*":
        tc = TypedCol(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)
    else:
        tc = resolve(df.schema, field)
    v = tc.col
    present = keep & v.isNotNull() if not tc.missing else F.lit(False)
    if fn == "countDistinct":
        if tc.missing:
            return F.lit(0).cast("long")
        return F.count_distinct(F.when(present, v))
    if fn in ("sum", "avg", "min", "max"):
        if family(tc.dtype) != "number":
            return F.lit(None).cast("double")
        x = F.when(present, v.cast("double"))
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn](x)
    if fn in ("first", "last"):
        if tc.missing:
            return F.lit(None)
        key = order_struct(df, require(order_key, f"aggregate {fn!r}"))
        if key is None:
            raise ValueError("order key must be numeric, boolean, time or ascending text")
        k = F.when(present, key)  # min_by / max_by skip NULL orderings
        return F.min_by(v, k) if fn == "first" else F.max_by(v, k)
    if fn == "collect":
        if tc.missing:
            return F.array()
        key = order_struct(df, require(order_key, "aggregate 'collect'"))
        pairs = F.collect_list(F.when(present, F.struct(key.alias("k"), v.alias("v"))))
        return F.transform(F.sort_array(pairs), lambda p: p["v"])
    raise ValueError(f"unknown aggregate function {fn!r}")
