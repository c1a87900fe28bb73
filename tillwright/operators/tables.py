"""Keyed-table maintenance in bulk: insert, replace, patch, delete, lookups,
schema validation.

Single-record calls of the original become batch operators that return
``(accepted, rejected)`` frames instead of throwing on the first bad row.
All of them are joins / aggregates on the key: anti and semi joins for
existence, one hash aggregate for duplicates within a batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import order_struct
from ..functions.values import family

# JSON Schema type names and the Spark type families they accept.
JSON_TYPES = {
    "string": ("string",),
    "number": ("number",),
    "integer": ("number",),
    "boolean": ("boolean",),
    "array": ("array",),
    "object": ("object",),
}


def validate(df: DataFrame, schema: dict, prefix: str = "data") -> DataFrame:
    """Adds ``errors`` (all violations, in check order) and ``error`` (the
    first one, as the original reports it) per row.

    Supported keywords: ``type`` (incl. ``integer``), ``required``, ``enum``,
    ``minimum`` / ``maximum`` / ``exclusiveMinimum`` / ``exclusiveMaximum``,
    ``minLength`` / ``maxLength``, ``pattern``, ``nullable``, array ``items``
    type, ``additionalProperties: false``.
    """
    props = schema.get("properties") or {}
    checks: list[Column] = []
    for name in schema.get("required") or []:
        present = F.col(f"`{name}`").isNotNull() if name in df.columns else F.lit(False)
        checks.append(F.when(~present, F.lit(f"{prefix} must have required property '{name}'")))
    if schema.get("additionalProperties") is False:
        extra = [c for c in df.columns if c not in props]
        if extra:
            any_extra = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in extra])
            checks.append(F.when(any_extra, F.lit(f"{prefix} must NOT have additional properties")))
    for name, spec in props.items():
        if name not in df.columns:
            continue
        c = F.col(f"`{name}`")
        dtype = df.schema[name].dataType
        where = f"{prefix}/{name}"
        typ = spec.get("type")
        if typ:
            ok_fams = JSON_TYPES.get(typ, ())
            if family(dtype) not in ok_fams:
                checks.append(F.when(c.isNotNull(), F.lit(f"{where} must be {typ}")))
            elif typ == "integer":
                checks.append(F.when(c.isNotNull() & (c.cast("double") != F.floor(c.cast("double"))),
                                     F.lit(f"{where} must be integer")))
        if "enum" in spec:
            vals = [v for v in spec["enum"] if v is not None]
            allowed = c.isin(vals) if vals else F.lit(False)
            checks.append(F.when(c.isNotNull() & ~F.coalesce(allowed, F.lit(False)),
                                 F.lit(f"{where} must be equal to one of the allowed values")))
        if family(dtype) == "number":
            for kw, op, sym in (("minimum", lambda a, b: a < b, ">="), ("maximum", lambda a, b: a > b, "<="),
                                ("exclusiveMinimum", lambda a, b: a <= b, ">"),
                                ("exclusiveMaximum", lambda a, b: a >= b, "<")):
                if kw in spec:
                    bound = spec[kw]
                    checks.append(F.when(c.isNotNull() & op(c, F.lit(bound)),
                                         F.lit(f"{where} must be {sym} {_num(bound)}")))
        if family(dtype) == "string":
            if "minLength" in spec:
                n = spec["minLength"]
                checks.append(F.when(F.length(c) < n, F.lit(f"{where} must NOT have fewer than {n} characters")))
            if "maxLength" in spec:
                n = spec["maxLength"]
                checks.append(F.when(F.length(c) > n, F.lit(f"{where} must NOT have more than {n} characters")))
            if "pattern" in spec:
                checks.append(F.when(c.isNotNull() & ~c.rlike(spec["pattern"]),
                                     F.lit(f'{where} must match pattern "{spec["pattern"]}"')))
        if isinstance(dtype, T.ArrayType) and isinstance(spec.get("items"), dict) and spec["items"].get("type"):
            it = spec["items"]["type"]
            if family(dtype.elementType) not in JSON_TYPES.get(it, ()):
                checks.append(F.when(F.size(c) > 0, F.lit(f"{where}/0 must be {it}")))
    errors = F.filter(F.array(*checks), lambda e: e.isNotNull()) if checks else F.array().cast("array<string>")
    return df.withColumn("errors", errors).withColumn("error", F.try_element_at(F.col("errors"), F.lit(1)))


def _num(v) -> str:
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def split_valid(df: DataFrame, schema: dict, prefix: str = "data") -> tuple[DataFrame, DataFrame]:
    checked = validate(df, schema, prefix)
    return (checked.where(F.size("errors") == 0).drop("errors", "error"),
            checked.where(F.size("errors") > 0))


def last_per_key(batch: DataFrame, key: str, order_key=()) -> DataFrame:
    """One row per key: the last in ``order_key`` order (without one, the
    largest row by its columns), as calls in that order would leave it."""
    row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
    best = F.max_by(row, order_struct(batch, order_key)) if order_key else F.max(row)
    return batch.groupBy(F.col(key).alias("__key")).agg(best.alias("__row")).select("__row.*")


def insert(target: DataFrame, batch: DataFrame, key: str, order_key=()) -> tuple[DataFrame, DataFrame]:
    """Append ``batch``: a key already in ``target`` or repeated in the batch
    (after its first occurrence in ``order_key`` order) is rejected.  A row
    without a key gets a UUID if keys are text and is rejected if not."""
    keyless, batch = batch.where(F.col(key).isNull()), batch.where(F.col(key).isNotNull())
    if order_key:
        rank = order_struct(batch, order_key)
        first = batch.groupBy(key).agg(F.min(rank).alias("__first"))
        b = batch.withColumn("__rank", rank).join(first, key)
        dup = F.col("__rank") != F.col("__first")
        b = b.withColumn("__dup", dup).drop("__rank", "__first")
    else:
        counts = batch.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        b = batch.join(counts, key).withColumn("__dup", F.col("__n") > 1).drop("__n")
    existing = target.select(key).distinct().withColumn("__exists", F.lit(True))
    b = b.join(existing, key, "left")
    reason = (F.when(F.col("__exists"), F.lit("already exists"))
              .when(F.col("__dup"), F.lit("duplicate key in batch")))
    b = b.withColumn("reason", reason).drop("__exists", "__dup")
    accepted = b.where(F.col("reason").isNull()).drop("reason")
    rejected = b.where(F.col("reason").isNotNull())
    if isinstance(batch.schema[key].dataType, T.StringType):
        accepted = accepted.unionByName(keyless.withColumn(key, F.uuid()))
    else:
        rejected = rejected.unionByName(keyless.withColumn("reason", F.lit("missing key")))
    return target.unionByName(accepted, allowMissingColumns=True), rejected


def replace(target: DataFrame, batch: DataFrame, key: str, order_key=()) -> tuple[DataFrame, DataFrame]:
    """Full-document replace of existing keys; unknown keys are rejected.  Of
    rows that repeat a key the last one counts (``last_per_key``)."""
    known = last_per_key(batch.join(target.select(key), key, "left_semi"), key, order_key)
    unknown = batch.join(target.select(key), key, "left_anti").withColumn("reason", F.lit("not found"))
    kept = target.join(known.select(key), key, "left_anti")
    return kept.unionByName(known, allowMissingColumns=True), unknown


def patch(target: DataFrame, updates: DataFrame, key: str, keep: tuple[str, ...] = (), order_key=()) -> DataFrame:
    """Shallow merge: columns present in ``updates`` overwrite (NULL included)
    for matched keys; ``keep`` columns (e.g. created time) never change.  Of
    updates that repeat a key the last one counts (``last_per_key``)."""
    updates = last_per_key(updates, key, order_key)
    cols = [c for c in updates.columns if c != key and c not in keep]
    u = updates.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__u_{c}") for c in cols],
                       F.lit(True).alias("__hit"))
    j = target.join(u, target[key] == u["__k"], "left")
    out = [F.when(F.col("__hit"), F.col(f"__u_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
           for c in target.columns]
    return j.select(*out)


def delete(target: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, deleted keys with ``existed``); missing keys are not errors."""
    remaining = target.join(keys.select(key), key, "left_anti")
    report = keys.select(key).distinct().join(
        target.select(key).distinct().withColumn("existed", F.lit(True)), key, "left").fillna(
        {"existed": False})
    return remaining, report


def find_by_ids(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key), key, "left_semi")


def clear(target: DataFrame) -> DataFrame:
    return target.limit(0)
