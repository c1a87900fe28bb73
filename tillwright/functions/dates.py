"""Calendar functions with the original model's rules, as native expressions.

All timestamps are UTC (the session time zone is pinned).  Weeks start on
Sunday; adding months overflows like ``Date.setMonth`` (Jan 31 + 1 month is
early March), where Spark's ``add_months`` would clamp.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_MICROS = {
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 7 * 86_400_000_000,
}
UNITS = ("second", "minute", "hour", "day", "week", "month", "year")


def _micros_of_day(ts: Column) -> Column:
    return F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))


def add(ts: Column, amount: int, unit: str) -> Column:
    if unit in UNIT_MICROS:
        return F.timestamp_micros(F.unix_micros(ts) + F.lit(int(amount) * UNIT_MICROS[unit]))
    months = int(amount) * (12 if unit == "year" else 1)
    if unit not in ("month", "year"):
        raise ValueError(f"unknown unit {unit!r}")
    # first of the month + n months, then the original day offset: days past
    # the end of the target month spill into the next one.
    day0 = F.add_months(F.trunc(ts, "MM"), months)
    day = F.date_add(day0, F.dayofmonth(ts) - 1)
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + _micros_of_day(ts))


def diff(a: Column, b: Column, unit: str) -> Column:
    """``b - a`` in whole units; floor for fixed units, calendar for month/year."""
    if unit in UNIT_MICROS:
        ms = 1000
        d = (F.unix_millis(b) - F.unix_millis(a)).cast("double")
        return F.floor(d / F.lit(UNIT_MICROS[unit] // ms)).cast("long")
    if unit == "month":
        return ((F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))).cast("long")
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("long")
    raise ValueError(f"unknown unit {unit!r}")


def start_of(ts: Column, unit: str) -> Column:
    if unit in ("second", "minute", "hour", "day", "month", "year"):
        return F.date_trunc(unit, ts)
    if unit == "week":
        d = F.date_sub(F.to_date(ts), F.dayofweek(ts) - 1)  # dayofweek: 1 = Sunday
        return d.cast("timestamp")
    raise ValueError(f"unknown unit {unit!r}")


def end_of(ts: Column, unit: str) -> Column:
    start = start_of(ts, unit)
    nxt = add(start, 1, unit)
    return F.timestamp_micros(F.unix_micros(nxt) - F.lit(1000))


def format_ts(ts: Column, fmt: str) -> Column:
    """``YYYY MM DD HH mm ss`` tokens; only the first occurrence of each is
    replaced (``String.replace`` with a string pattern)."""
    # segments: list of (is_token, text)
    segs: list[tuple[bool, str]] = [(False, fmt)]
    for tok in ("YYYY", "MM", "DD", "HH", "mm", "ss"):
        for i, (is_tok, text) in enumerate(segs):
            if is_tok:
                continue
            pos = text.find(tok)
            if pos >= 0:
                segs[i:i + 1] = [(False, text[:pos]), (True, tok), (False, text[pos + len(tok):])]
                break
    pieces = []
    for is_tok, text in segs:
        if not is_tok:
            if text:
                pieces.append(F.lit(text))
        elif text == "YYYY":
            pieces.append(F.year(ts).cast("string"))
        else:
            pat = {"MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}[text]
            pieces.append(F.date_format(ts, pat))
    if not pieces:
        return F.when(ts.isNotNull(), F.lit(""))
    return F.concat(*pieces)
