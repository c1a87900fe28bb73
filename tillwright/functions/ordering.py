"""Order keys: the explicit stand-in for insertion order.

An order term is a column name (ascending, nulls last) or a dict
``{"field", "direction", "nulls"}`` as in the sort step.  Two renderings:

* ``sort_columns`` - Spark sort expressions for ``orderBy`` / windows;
* ``order_struct`` - one orderable struct whose *ascending* order is the
  wanted order, so ``min_by`` / ``max_by`` can pick a first / last row in
  a hash aggregate (partial aggregation map-side, skew-proof) instead of a
  window over a whole group.  Descending strings cannot be encoded this
  way; callers fall back to a window then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import family, resolve


class OrderError(ValueError):
    pass


def norm_term(t) -> dict:
    if isinstance(t, str):
        return {"field": t, "direction": "asc", "nulls": "last"}
    d = dict(t)
    d.setdefault("direction", "asc")
    d["nulls"] = d.get("nulls") or "last"
    return d


def term_column(df: DataFrame, t: dict) -> Column:
    """The term's column; text terms with a ``collation`` (e.g. ``UNICODE``,
    which orders like ``localeCompare``: a < A < b) compare under it."""
    tc = resolve(df.schema, t["field"])
    if t.get("collation") and family(tc.dtype) == "string":
        return F.collate(tc.col, t["collation"])
    return tc.col


def sort_columns(df: DataFrame, terms) -> list[Column]:
    out = []
    for t in map(norm_term, terms):
        c = term_column(df, t)
        first = t["nulls"] == "first"
        if t["direction"] == "desc":
            out.append(c.desc_nulls_first() if first else c.desc_nulls_last())
        else:
            out.append(c.asc_nulls_first() if first else c.asc_nulls_last())
    return out


def _ascending_form(c: Column, dtype: T.DataType, desc: bool) -> Column | None:
    if not desc:
        return c
    fam = family(dtype)
    if fam == "number":
        return -c.cast("double") if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)) else -c.cast("long")
    if fam == "boolean":
        return ~c
    if fam == "date":
        return -F.unix_micros(c.cast("timestamp"))
    return None


def order_struct(df: DataFrame, terms, reverse: bool = False) -> Column | None:
    """Struct key sorting like ``terms``; ``reverse`` flips every term,
    null placement included.  ``None`` when a term cannot be encoded."""
    parts = []
    for i, t in enumerate(map(norm_term, terms)):
        if t.get("collation"):
            return None  # collated text is compared by the narrowing path
        tc = resolve(df.schema, t["field"])
        desc = (t["direction"] == "desc") != reverse
        nulls_first = (t["nulls"] == "first") != reverse
        v = _ascending_form(tc.col, tc.dtype, desc)
        if v is None:
            return None
        flag = F.when(tc.col.isNull(), F.lit(0 if nulls_first else 1)).otherwise(F.lit(1 if nulls_first else 0))
        parts += [flag.alias(f"n{i}"), v.alias(f"v{i}")]
    if not parts:
        return None
    return F.struct(*parts)


def require(order_key, what: str):
    if not order_key:
        raise OrderError(
            f"{what} depends on row order; give the table an order key "
            "(Catalog.register(..., order_key=...)) or the step an 'orderKey'"
        )
    return order_key
