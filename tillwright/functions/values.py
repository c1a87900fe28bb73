"""Typed column references and JavaScript-like value helpers.

Operators compile declarative specs against a known schema, so every
compiled piece is a ``TypedCol`` (a ``Column`` plus its Spark type).  The
type decides the original model's dynamic-typing rules at plan time: a
numeric comparison on a string column is a constant ``false``, a string
operation on a number is ``NULL``, and so on.  Nothing here runs Python per
row; all helpers are native Spark expressions.
"""

from __future__ import annotations

import datetime as _dt
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)
TIMELIKE = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass(frozen=True)
class TypedCol:
    col: Column
    dtype: T.DataType

    @property
    def missing(self) -> bool:
        return isinstance(self.dtype, T.NullType)


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, NUMERIC):
        return "number"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, TIMELIKE):
        return "date"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    if isinstance(dtype, T.NullType):
        return "null"
    return "other"


def value_family(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (_dt.datetime, _dt.date)):
        return "date"
    if isinstance(v, (list, tuple)):
        return "array"
    if isinstance(v, dict):
        return "object"
    return "other"


def missing() -> TypedCol:
    return TypedCol(F.lit(None), T.NullType())


def literal(v) -> TypedCol:
    """A constant with a Spark type chosen like the JSON value it stands for."""
    if v is None:
        return missing()
    if isinstance(v, bool):
        return TypedCol(F.lit(v), T.BooleanType())
    if isinstance(v, int):
        return TypedCol(F.lit(v).cast("long"), T.LongType())
    if isinstance(v, float):
        return TypedCol(F.lit(v).cast("double"), T.DoubleType())
    if isinstance(v, str):
        return TypedCol(F.lit(v), T.StringType())
    if isinstance(v, _dt.datetime):
        return TypedCol(F.lit(v).cast("timestamp"), T.TimestampType())
    if isinstance(v, (list, tuple)):
        parts = [literal(x) for x in v]
        fams = {family(p.dtype) for p in parts} - {"null"}
        if fams == {"number"}:
            parts = [TypedCol(p.col.cast("double"), T.DoubleType()) for p in parts]
        elif len(fams) > 1:
            parts = [TypedCol(js_text(p), T.StringType()) for p in parts]
        if not parts:
            return TypedCol(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
        elem = next((p.dtype for p in parts if not p.missing), T.StringType())
        arr = F.array(*[p.col.cast(elem) for p in parts])
        return TypedCol(arr, T.ArrayType(elem))
    if isinstance(v, dict):
        parts = {k: literal(x) for k, x in v.items()}
        st = F.struct(*[p.col.alias(k) for k, p in parts.items()])
        return TypedCol(st, T.StructType([T.StructField(k, p.dtype) for k, p in parts.items()]))
    raise TypeError(f"unsupported literal {v!r}")


def _field_type(dtype: T.DataType, name: str):
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            if f.name == name:
                return f.dataType
    return None


def resolve(schema: T.StructType, path: str) -> TypedCol:
    """Nested ``a.b.c`` access; numeric parts index arrays; missing -> NULL.

    A top-level column whose own name contains dots (``profile.email`` as
    produced by a report projection) is found first.
    """
    if path in schema.fieldNames():
        return TypedCol(F.col(f"`{path}`"), schema[path].dataType)
    parts = path.split(".")
    dtype: T.DataType = schema
    col: Column | None = None
    for part in parts:
        if isinstance(dtype, T.ArrayType) and part.isdigit():
            col = F.try_element_at(col, F.lit(int(part) + 1))
            dtype = dtype.elementType
            continue
        if isinstance(dtype, T.MapType):
            col = F.try_element_at(col, F.lit(part))
            dtype = dtype.valueType
            continue
        nxt = _field_type(dtype, part)
        if nxt is None:
            return missing()
        col = F.col(f"`{part}`") if col is None else col.getField(part)
        dtype = nxt
    return TypedCol(col, dtype)


def number_text(c: Column) -> Column:
    """``String(x)`` of a JavaScript number held in a double column.

    Integral values print without ``.0``; plain decimals between 1e-6 and
    1e20 print in positional form, as JavaScript does.  Outside that range
    Spark's scientific form is kept (documented difference).
    """
    x = c.cast("double")
    ax = F.abs(x)
    dec = F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return (
        F.when(x.isNull(), F.lit(None))
        .when(F.isnan(x), F.lit("NaN"))
        .when(x == float("inf"), F.lit("Infinity"))
        .when(x == float("-inf"), F.lit("-Infinity"))
        .when((x == F.floor(x)) & (ax < 1e20), x.try_cast("decimal(38,0)").cast("string"))
        .when((ax >= 1e-6) & (ax < 1e20), dec)
        .otherwise(F.lower(x.cast("string")))
    )


ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def js_text(tc: TypedCol, null_as: str | None = None) -> Column:
    """Text of a value as the original model prints it into strings.

    strings as-is, numbers as JavaScript numbers, booleans ``true/false``,
    timestamps ISO-8601 UTC with milliseconds, arrays / objects as JSON
    (nulls kept).  NULL stays NULL unless ``null_as`` is given.
    """
    fam = family(tc.dtype)
    c = tc.col
    if fam == "string":
        out = c
    elif fam == "number":
        if isinstance(tc.dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
            out = number_text(c)
        else:
            out = c.cast("string")
    elif fam == "boolean":
        out = c.cast("string")
    elif fam == "date":
        out = F.date_format(c.cast("timestamp"), ISO_MS)
    elif fam in ("array", "object"):
        out = F.to_json(c, {"ignoreNullFields": "false"})
    elif fam == "null":
        out = F.lit(None).cast("string")
    else:
        out = c.cast("string")
    if null_as is not None:
        out = F.coalesce(out, F.lit(null_as))
    return out


def js_number(tc: TypedCol) -> Column:
    """``Number(x)`` as a double column.

    numbers as-is, booleans 1/0, blank strings 0, numeric text parsed,
    other text NaN, timestamps epoch milliseconds.  Typed NULL counts as a
    missing value and gives NaN (see the null contract in the README).
    """
    fam = family(tc.dtype)
    c = tc.col
    nan = F.lit(float("nan"))
    if fam == "number":
        return F.coalesce(c.cast("double"), nan)
    if fam == "boolean":
        return F.coalesce(c.cast("double"), nan)
    if fam == "string":
        t = F.trim(c)
        return (F.when(c.isNull(), nan).when(t == "", F.lit(0.0))
                .otherwise(F.coalesce(t.try_cast("double"), nan)))
    if fam == "date":
        return F.coalesce(F.unix_millis(c.cast("timestamp")).cast("double"), nan)
    return nan


def is_nan_literal(v) -> bool:
    return isinstance(v, float) and math.isnan(v)


def two_valued(c: Column) -> Column:
    """NULL becomes false, so ``or`` / ``not`` behave like plain booleans."""
    return F.coalesce(c, F.lit(False))
