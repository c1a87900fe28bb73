"""Field-mapping expressions compiled to native ``Column`` expressions.

``compile_expr(schema, spec)`` returns a ``TypedCol``.  Specs are the plain
dicts of the transform model, e.g.::

    {"type": "math", "operator": "*",
     "left": {"type": "field", "path": "price"},
     "right": {"type": "literal", "value": 1.2}}
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dates
from .predicates import expression_condition
from .values import TypedCol, family, js_number, js_text, literal, missing, resolve

NAN = float("nan")


class ExpressionError(ValueError):
    pass


def compile_expr(schema: T.StructType, e: dict) -> TypedCol:
    t = e.get("type")
    fn = _COMPILERS.get(t)
    if fn is None:
        raise ExpressionError(f"unknown expression type {t!r}")
    return fn(schema, e)


def _field(schema, e):
    return resolve(schema, e["path"])


def _literal(schema, e):
    return literal(e.get("value"))


def _concat(schema, e):
    parts = [js_text(compile_expr(schema, v), null_as="") for v in e.get("values", [])]
    if not parts:
        return TypedCol(F.lit(""), T.StringType())
    return TypedCol(F.concat_ws(e.get("separator") or "", *parts), T.StringType())


_TEMPLATE_RE = re.compile(r"\{\{([^}]+)\}\}")


def template_parts(template: str):
    """Split ``"..{{path}}.."`` into literal text and paths (on the driver)."""
    pos = 0
    for m in _TEMPLATE_RE.finditer(template):
        if m.start() > pos:
            yield False, template[pos:m.start()]
        yield True, m.group(1).strip()
        pos = m.end()
    if pos < len(template):
        yield False, template[pos:]


def _template(schema, e):
    pieces = []
    for is_path, text in template_parts(e["template"]):
        if is_path:
            pieces.append(js_text(resolve(schema, text), null_as=""))
        else:
            pieces.append(F.lit(text))
    return TypedCol(F.concat(*pieces) if pieces else F.lit(""), T.StringType())


def _math(schema, e):
    op = e["operator"]
    left = js_number(compile_expr(schema, e["left"]))
    nan = F.lit(NAN)
    if op in ("round", "floor", "ceil", "abs"):
        if op == "round":
            out = F.floor(left + F.lit(0.5)).cast("double")  # Math.round: half up toward +inf
        elif op == "floor":
            out = F.floor(left).cast("double")
        elif op == "ceil":
            out = F.ceil(left).cast("double")
        else:
            out = F.abs(left)
        # floor/ceil of NaN / infinity stay as they are
        out = F.when(F.isnan(left) | (F.abs(left) == float("inf")), left).otherwise(out)
        return TypedCol(out, T.DoubleType())
    if "right" not in e or e["right"] is None:
        raise ExpressionError(f"Binary operator {op} requires right operand")
    right = js_number(compile_expr(schema, e["right"]))
    if op == "+":
        out = left + right
    elif op == "-":
        out = left - right
    elif op == "*":
        out = left * right
    elif op == "/":
        out = F.when(right == 0, nan).otherwise(F.try_divide(left, right))
    elif op == "%":
        out = F.when((right == 0) | F.isnan(right) | F.isnan(left), nan).otherwise(F.try_mod(left, right))
    else:
        raise ExpressionError(f"Unknown math operator: {op}")
    return TypedCol(out, T.DoubleType())


def _common(parts: list[TypedCol]) -> list[TypedCol]:
    """Cast branches of coalesce / conditional to one type."""
    real = [p for p in parts if not p.missing]
    if not real:
        return parts
    fams = {family(p.dtype) for p in real}
    if len(fams) == 1:
        fam = fams.pop()
        if fam == "number":
            return [TypedCol(p.col.cast("double"), T.DoubleType()) for p in parts]
        dtype = real[0].dtype
        if all(p.dtype == dtype for p in real):
            return [TypedCol(p.col.cast(dtype) if p.missing else p.col, dtype) for p in parts]
    return [TypedCol(js_text(p), T.StringType()) for p in parts]


def _coalesce(schema, e):
    parts = _common([compile_expr(schema, v) for v in e.get("values", [])])
    if not parts:
        return missing()
    dtype = next((p.dtype for p in parts if not p.missing), T.NullType())
    return TypedCol(F.coalesce(*[p.col for p in parts]), dtype)


def _conditional(schema, e):
    cond = expression_condition(schema, e["condition"], bare=True)
    a, b = _common([compile_expr(schema, e["then"]), compile_expr(schema, e["else"])])
    dtype = a.dtype if not a.missing else b.dtype
    return TypedCol(F.when(cond, a.col).otherwise(b.col), dtype)


def _as_timestamp(tc: TypedCol):
    fam = family(tc.dtype)
    if fam == "date":
        return tc.col.cast("timestamp")
    if fam == "string":
        return F.try_to_timestamp(tc.col)
    if fam == "number":  # new Date(String(n)) parses a year-like number only; treat as invalid
        return F.lit(None).cast("timestamp")
    return F.lit(None).cast("timestamp")


def _date(schema, e):
    op = e["operation"]
    now = F.current_timestamp()
    src = resolve(schema, e["field"]) if e.get("field") else None
    ts = _as_timestamp(src) if src is not None else now
    unit = e.get("unit") or "day"
    # wall-clock (NTZ) inputs give wall-clock outputs, so results never shift
    # with the reader's time zone
    ntz = src is not None and isinstance(src.dtype, T.TimestampNTZType)

    def out(c):
        return TypedCol(c.cast("timestamp_ntz"), T.TimestampNTZType()) if ntz else TypedCol(c, T.TimestampType())

    if op == "now":
        return TypedCol(now, T.TimestampType())
    if op == "format":
        return TypedCol(dates.format_ts(ts, e.get("format") or "YYYY-MM-DD"), T.StringType())
    if op == "parse":
        if not e.get("field"):
            return TypedCol(F.lit(None).cast("timestamp"), T.TimestampType())
        tc = resolve(schema, e["field"])
        if family(tc.dtype) == "string":
            return TypedCol(F.try_to_timestamp(F.nullif(tc.col, F.lit(""))), T.TimestampType())
        return out(_as_timestamp(tc))
    if op == "add":
        return out(dates.add(ts, e.get("amount") or 0, unit))
    if op == "diff":
        other = _as_timestamp(resolve(schema, e["compareTo"])) if e.get("compareTo") else now
        return TypedCol(dates.diff(ts, other, unit), T.LongType())
    if op == "startOf":
        return out(dates.start_of(ts, unit))
    if op == "endOf":
        return out(dates.end_of(ts, unit))
    return missing()


def _array(schema, e):
    op = e["operation"]
    tc = resolve(schema, e["path"])
    if not isinstance(tc.dtype, T.ArrayType):
        if op == "length":
            return TypedCol(F.lit(0).cast("long"), T.LongType())
        return missing()
    a = tc.col
    elem = tc.dtype.elementType
    if op == "length":
        return TypedCol(F.coalesce(F.size(a), F.lit(0)).cast("long"), T.LongType())
    if op == "first":
        return TypedCol(F.try_element_at(a, F.lit(1)), elem)
    if op == "last":
        return TypedCol(F.when(F.size(a) > 0, F.try_element_at(a, F.lit(-1))), elem)
    if op == "at":
        i = int(e.get("index") or 0)
        if i < 0:
            return TypedCol(F.lit(None).cast(elem), elem)
        return TypedCol(F.try_element_at(a, F.lit(i + 1)), elem)
    if op == "join":
        sep = e.get("separator")
        sep = "," if sep is None else sep
        texts = F.transform(a, lambda x: js_text(TypedCol(x, elem), null_as=""))
        return TypedCol(F.array_join(texts, sep), T.StringType())
    if op == "includes":
        v = e.get("value")
        from .predicates import strict_eq

        return TypedCol(F.exists(a, lambda x: strict_eq(TypedCol(x, elem), v)), T.BooleanType())
    if op == "slice":
        n = F.size(a)
        start = int(e.get("start") or 0)
        s = F.greatest(n + start, F.lit(0)) if start < 0 else F.least(F.lit(start), n)
        end = e.get("end")
        if end is None:
            en = n
        else:
            end = int(end)
            en = F.greatest(n + end, F.lit(0)) if end < 0 else F.least(F.lit(end), n)
        length = F.greatest(en - s, F.lit(0))
        return TypedCol(F.slice(a, s + 1, length), tc.dtype)
    return missing()


_WS = r"[\s\p{Z}\x{FEFF}]"


def js_replacement(rep: str) -> str:
    """A JavaScript replacement string in Java's ``$n`` / ``\\`` syntax."""
    out = []
    i = 0
    while i < len(rep):
        ch = rep[i]
        if ch == "$" and i + 1 < len(rep):
            nxt = rep[i + 1]
            if nxt == "$":
                out.append(r"\$")
                i += 2
                continue
            if nxt == "&":
                out.append("$0")
                i += 2
                continue
            if nxt.isdigit():
                out.append("$" + nxt)
                i += 2
                continue
            out.append(r"\$")
            i += 1
            continue
        if ch == "$":
            out.append(r"\$")
        elif ch == "\\":
            out.append("\\\\")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def _string(schema, e):
    op = e["operation"]
    tc = resolve(schema, e["path"])
    if family(tc.dtype) != "string":
        if op == "length":
            return TypedCol(F.lit(0).cast("long"), T.LongType())
        return missing()
    s = tc.col
    S = T.StringType()
    if op == "upper":
        return TypedCol(F.upper(s), S)
    if op == "lower":
        return TypedCol(F.lower(s), S)
    if op == "trim":
        return TypedCol(F.regexp_replace(s, f"^{_WS}+|{_WS}+$", ""), S)
    if op == "length":
        return TypedCol(F.coalesce(F.length(s), F.lit(0)).cast("long"), T.LongType())
    if op == "split":
        sep = e.get("separator")
        sep = "," if sep is None else sep
        pattern = re.escape(sep) if sep else ""
        return TypedCol(F.split(s, pattern if sep else "", -1), T.ArrayType(S))
    if op == "substring":
        start = max(int(e.get("start") or 0), 0)
        end = e.get("end")
        if end is None:
            lo, hi = start, None
        else:
            end = max(int(end), 0)
            lo, hi = min(start, end), max(start, end)
        if hi is None:
            return TypedCol(F.substr(s, F.lit(lo + 1)), S)
        return TypedCol(F.substring(s, lo + 1, hi - lo), S)
    if op == "replace":
        pat = e.get("pattern") or ""
        rep = js_replacement(e.get("replacement") or "")
        return TypedCol(F.regexp_replace(s, F.lit(pat), F.lit(rep)), S)
    if op in ("padStart", "padEnd"):
        n = int(e.get("padLength") or 0)
        ch = e.get("padChar")
        ch = " " if ch is None else ch
        if ch == "":
            return TypedCol(s, S)
        padded = F.lpad(s, n, ch) if op == "padStart" else F.rpad(s, n, ch)
        return TypedCol(F.when(F.length(s) < n, padded).otherwise(s), S)
    return missing()


_COMPILERS = {
    "field": _field,
    "literal": _literal,
    "concat": _concat,
    "template": _template,
    "math": _math,
    "coalesce": _coalesce,
    "conditional": _conditional,
    "date": _date,
    "array": _array,
    "string": _string,
}
