"""Match-rule scores as native column expressions (no Python per row).

``rule_score(a, b, rule)`` scores two typed values; ``weighted_score``
combines rules into the weighted average.  The phonetic code is the
original's Soundex variant (vowels and H/W/Y do not separate equal codes),
built from ``translate`` and ``regexp_replace`` - Spark's own ``soundex``
differs from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.values import TypedCol, family, js_number, js_text

MATCH_TYPES = ("exact", "exactCaseInsensitive", "normalized", "fuzzy", "phonetic", "numeric", "date")
BINARY_TYPES = ("exact", "exactCaseInsensitive", "normalized")

# Soundex letter groups (letters, then their digit).
SOUNDEX_LETTERS = "BFPVCGJKQSXZDTLMNR"
SOUNDEX_DIGITS = "111122222222334556"
SOUNDEX_SILENT = "AEIOUHWY"


def text(tc: TypedCol) -> Column:
    """``toString`` of the matching code: NULL -> "", dates ISO, objects JSON."""
    return js_text(tc, null_as="")


def normalize(c: Column) -> Column:
    """lower, trim (JavaScript whitespace), collapse whitespace runs to one space."""
    ws = r"[\s\p{Z}\x{FEFF}]"
    return F.regexp_replace(F.regexp_replace(F.lower(c), f"^{ws}+|{ws}+$", ""), f"{ws}+", " ")


def soundex(c: Column) -> Column:
    s = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    digits = F.translate(s, SOUNDEX_LETTERS + SOUNDEX_SILENT, SOUNDEX_DIGITS)
    collapsed = F.regexp_replace(digits, r"(\d)\1+", "$1")
    first = F.substring(s, 1, 1)
    first_coded = F.translate(first, SOUNDEX_LETTERS, "") == F.lit("")
    rest = F.when(first_coded, F.substring(collapsed, 2, 1_000_000)).otherwise(collapsed)
    code = F.substring(F.concat(first, rest, F.lit("000")), 1, 4)
    return F.when(F.length(s) == 0, F.lit("0000")).otherwise(code)


def soundex_similarity(a: Column, b: Column) -> Column:
    ca, cb = soundex(a), soundex(b)
    same = [(F.substring(ca, i, 1) == F.substring(cb, i, 1)).cast("double") for i in range(1, 5)]
    return F.when(ca == cb, F.lit(1.0)).otherwise(reduce(lambda x, y: x + y, same) / 4.0)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    m = F.greatest(F.length(a), F.length(b))
    return F.when(m == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / m)


def fuzzy_similarity(a: Column, b: Column, rule: dict) -> Column:
    sim, most = levenshtein_similarity(a, b), (rule.get("options") or {}).get("maxDistance")
    return sim if most is None else F.when(F.levenshtein(a, b) <= int(most), sim).otherwise(0.0)


def _timestamp(tc: TypedCol) -> Column:
    fam = family(tc.dtype)
    if fam == "date":
        return tc.col.cast("timestamp")
    if fam == "string":
        return F.try_to_timestamp(tc.col)
    return F.lit(None).cast("timestamp")


def rule_score(a: TypedCol, b: TypedCol, rule: dict) -> Column:
    t = rule["type"]
    opts = rule.get("options") or {}
    if t == "exact":
        fa, fb = family(a.dtype), family(b.dtype)
        if fa != fb or fa in ("date", "array", "object"):
            s = F.lit(0.0)  # different types, or compared by identity
        else:
            s = F.when(a.col == b.col, 1.0).otherwise(0.0)
    elif t == "exactCaseInsensitive":
        s = F.when(F.lower(text(a)) == F.lower(text(b)), 1.0).otherwise(0.0)
    elif t == "normalized":
        s = F.when(normalize(text(a)) == normalize(text(b)), 1.0).otherwise(0.0)
    elif t == "fuzzy":
        s = fuzzy_similarity(text(a), text(b), rule)
    elif t == "phonetic":
        s = soundex_similarity(text(a), text(b))
    elif t == "numeric":
        na, nb = js_number(a), js_number(b)
        tol = float(opts.get("numericTolerance") or 0)
        d = F.abs(na - nb)
        s = (F.when(F.isnan(na) | F.isnan(nb), 0.0).when(na == nb, 1.0)
             .when(d <= tol, 1.0 - d / (tol + 1)).otherwise(0.0))
    elif t == "date":
        da, db = _timestamp(a), _timestamp(b)
        tol = float(opts.get("dateTolerance") or 0)
        days = F.abs(F.unix_millis(da) - F.unix_millis(db)) / 86_400_000.0
        s = (F.when(da.isNull() | db.isNull(), 0.0).when(days == 0, 1.0)
             .when(days <= tol, 1.0 - days / (tol + 1)).otherwise(0.0))
    else:
        s = F.lit(0.0)
    if a.missing and b.missing:
        return F.lit(1.0)
    return (F.when(a.col.isNull(), F.when(b.col.isNull(), 1.0).otherwise(0.0))
            .when(b.col.isNull(), 0.0).otherwise(s)).cast("double")


def feature(tc: TypedCol, rule: dict) -> Column:
    """Per-record prepared value of a rule, computed once per record before
    pairing (pairs outnumber records, so per-pair work stays small)."""
    t = rule["type"]
    if t == "exact":
        return tc.col
    if t == "exactCaseInsensitive":
        return F.lower(text(tc))
    if t == "normalized":
        return normalize(text(tc))
    if t == "fuzzy":
        return text(tc)
    if t == "phonetic":
        return soundex(text(tc))
    if t == "numeric":
        return js_number(tc)
    if t == "date":
        return _timestamp(tc)
    return F.lit(None)


def pair_score(rule: dict, fa: Column, fb: Column, na: Column, nb: Column, comparable: bool = True, known: Column | None = None) -> Column:
    """Score from prepared features ``fa`` / ``fb`` and null flags ``na`` / ``nb``;
    ``known`` is the similarity of a ``fuzzy`` rule where it was computed before (NULL elsewhere)."""
    t = rule["type"]
    opts = rule.get("options") or {}
    if t == "exact":
        s = F.when(fa == fb, 1.0).otherwise(0.0) if comparable else F.lit(0.0)
    elif t in ("exactCaseInsensitive", "normalized"):
        s = F.when(fa == fb, 1.0).otherwise(0.0)
    elif t == "fuzzy":
        s = fuzzy_similarity(fa, fb, rule)
        if known is not None:
            s = F.coalesce(known, s)
    elif t == "phonetic":
        same = [(F.substring(fa, i, 1) == F.substring(fb, i, 1)).cast("double") for i in range(1, 5)]
        s = F.when(fa == fb, F.lit(1.0)).otherwise(reduce(lambda x, y: x + y, same) / 4.0)
    elif t == "numeric":
        tol = float(opts.get("numericTolerance") or 0)
        d = F.abs(fa - fb)
        s = (F.when(F.isnan(fa) | F.isnan(fb), 0.0).when(fa == fb, 1.0)
             .when(d <= tol, 1.0 - d / (tol + 1)).otherwise(0.0))
    elif t == "date":
        tol = float(opts.get("dateTolerance") or 0)
        days = F.abs(F.unix_millis(fa) - F.unix_millis(fb)) / 86_400_000.0
        s = (F.when(fa.isNull() | fb.isNull(), 0.0).when(days == 0, 1.0)
             .when(days <= tol, 1.0 - days / (tol + 1)).otherwise(0.0))
    else:
        s = F.lit(0.0)
    return F.when(na, F.when(nb, 1.0).otherwise(0.0)).when(nb, 0.0).otherwise(s).cast("double")


def comparable_exact(a: TypedCol, b: TypedCol) -> bool:
    fa, fb = family(a.dtype), family(b.dtype)
    return fa == fb and fa not in ("date", "array", "object")


def weighted_score(scores: list[tuple[Column, float]]) -> Column:
    total = sum(w for _, w in scores)
    if total <= 0:
        return F.lit(0.0)
    return reduce(lambda x, y: x + y, [s * float(w) for s, w in scores]) / float(total)
