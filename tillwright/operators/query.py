"""Collection queries: filter trees with relation filters, and the storage
``aggregate`` (group, per-field sum/avg/min/max, ``_count``, having).

A filter tree compiles to one ``Column``.  Relation filters become
correlated ``EXISTS`` sub-queries (``DataFrame.exists`` + ``Column.outer``),
which Catalyst plans as semi / anti joins at the top level and as an
ExistenceJoin inside ``or`` trees: one hash or sort-merge join per
relation, never the per-row re-scan of the original.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..functions.ordering import order_struct, require
from ..functions.values import TypedCol, family, resolve, two_valued
from ..sources.catalog import Catalog, TableInfo

# Operator keys in the order the original tests them.
OPERATOR_KEYS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "contains",
                 "startsWith", "endsWith", "before", "after", "between")
RELATION_KEYS = ("some", "none", "every")
AGG_FUNCTIONS = ("sum", "avg", "min", "max")


class QueryError(ValueError):
    pass


def is_operator(v) -> bool:
    return isinstance(v, dict) and len(v) == 1 and next(iter(v)) in OPERATOR_KEYS


def is_relation_operator(v) -> bool:
    return isinstance(v, dict) and len(v) == 1 and next(iter(v)) in RELATION_KEYS


def _date_value(v):
    if isinstance(v, _dt.datetime):
        return v
    if isinstance(v, _dt.date):
        return _dt.datetime(v.year, v.month, v.day)
    if isinstance(v, str):
        return _dt.datetime.fromisoformat(v.replace("Z", "+00:00")).replace(tzinfo=None)
    raise QueryError(f"not a date: {v!r}")


def operator_predicate(tc: TypedCol, op: dict, bare: bool) -> Column:
    """First operator in chain order wins; unknown operators are false."""
    for key in OPERATOR_KEYS:
        if key not in op:
            continue
        v = op[key]
        if key == "eq":
            return P.strict_eq(tc, v)
        if key == "ne":
            return ~P.strict_eq(tc, v)
        if key in ("gt", "gte", "lt", "lte"):
            return P.numeric_cmp(tc, key, v, bare)
        if key == "in":
            return P.membership(tc, v, bare)
        if key == "nin":
            return ~P.membership(tc, v)
        if key in ("contains", "startsWith", "endsWith"):
            return P.string_test(tc, key, v, bare)
        if family(tc.dtype) != "date":
            return P.FALSE()  # a date stored as text never matches
        c = tc.col.cast("timestamp")
        if key == "before":
            e = c < F.lit(_date_value(v))
        elif key == "after":
            e = c > F.lit(_date_value(v))
        else:
            lo, hi = (_date_value(x) for x in v)
            e = c.between(F.lit(lo), F.lit(hi))
        return e if bare else two_valued(e)
    return P.FALSE()


class FilterCompiler:
    """Compile a filter tree against a catalog table.

    Columns a sub-query refers to in its outer row (the id and foreign keys)
    are first copied under unique names: the analyzer would otherwise resolve
    an outer reference such as ``id`` from a same-named column of the inner
    table.
    """

    def __init__(self, cat: Catalog):
        self.cat = cat
        self._n = 0

    def _framed(self, info: TableInfo, df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        self._n += 1
        keys = [c for c in [info.id_col, *info.relations] if c and c in df.columns]
        amap = {c: f"__o{self._n}_{c}" for c in dict.fromkeys(keys)}
        return df.select("*", *[F.col(f"`{c}`").alias(a) for c, a in amap.items()]), amap

    def filtered(self, info: TableInfo, df: DataFrame, flt: dict | None, bare: bool = True) -> DataFrame:
        if not flt:
            return df
        framed, amap = self._framed(info, df)
        out = framed.where(self._tree(info, framed, flt, bare, amap))
        return out.drop(*amap.values())

    def apply(self, table: str, flt: dict | None) -> DataFrame:
        info = self.cat.info(table)
        return self.filtered(info, info.df, flt)

    # -- tree ------------------------------------------------------------------
    def _tree(self, info: TableInfo, df: DataFrame, flt: dict, bare: bool, amap: dict) -> Column:
        if not isinstance(flt, dict):
            raise QueryError(f"filter must be an object, got {flt!r}")
        if "and" in flt:
            parts = [self._tree(info, df, f, bare, amap) for f in flt["and"]]
            return reduce(lambda a, b: a & b, parts) if parts else P.TRUE()
        if "or" in flt:
            parts = [self._tree(info, df, f, bare, amap) for f in flt["or"]]
            return reduce(lambda a, b: a | b, parts) if parts else P.FALSE()
        parts = [self._field(info, df, k, v, bare, amap) for k, v in flt.items() if v is not None]
        return reduce(lambda a, b: a & b, parts) if parts else P.TRUE()

    def _field(self, info: TableInfo, df: DataFrame, key: str, val, bare: bool, amap: dict) -> Column:
        if is_relation_operator(val):
            rev = self.cat.reverse_relations(info.name).get(key)
            if rev is not None:
                return self._reverse(info, rev, val, amap)
        if isinstance(val, dict) and not is_operator(val) and key in info.relations:
            target, is_array = info.relations[key]
            return self._forward(info, df, key, target, is_array, val, amap)
        if not isinstance(val, dict):
            raise QueryError(f"field {key!r}: expected an operator object, got {val!r}")
        tc = resolve(df.schema, key) if key in df.columns else TypedCol(F.lit(None), T.NullType())
        return operator_predicate(tc, val, bare)

    # -- relations -----------------------------------------------------------------
    def _target_ids(self, target: str, flt: dict, bare: bool = True) -> tuple[DataFrame, str]:
        tinfo = self.cat.info(target)
        if not tinfo.id_col:
            raise QueryError(f"relation target {target!r} has no id column")
        return self.filtered(tinfo, tinfo.df, flt, bare), tinfo.id_col

    def _forward(self, info, df, key, target, is_array, flt, amap) -> Column:
        matched, tid = self._target_ids(target, flt)
        fk = resolve(df.schema, key)
        if fk.missing:
            return P.FALSE()
        outer = F.col(f"`{amap[key]}`").outer()
        if not is_array:
            t_id = resolve(matched.schema, tid)
            if family(t_id.dtype) != family(fk.dtype):
                return P.FALSE()
            inner = matched.select(t_id.col.alias("__tid"))
            return inner.where(F.col("__tid") == outer).exists()
        # array of keys: explode once, semi join the targets, distinct row ids,
        # then a plain correlated equality (an equi ExistenceJoin / semi join)
        if not info.id_col:
            raise QueryError(f"array relation filter on {info.name!r} needs an id column")
        hits = (info.df.select(F.col(info.id_col).alias("__row"), F.explode(F.col(f"`{key}`")).alias("__fk"))
                .join(matched.select(F.col(tid).alias("__fk")), "__fk", "left_semi")
                .select("__row").distinct())
        return hits.where(F.col("__row") == F.col(f"`{amap[info.id_col]}`").outer()).exists()

    def _reverse(self, info: TableInfo, rev, op: dict, amap: dict) -> Column:
        ref_table, fk, is_array = rev
        if not info.id_col:
            raise QueryError(f"reverse relation on {info.name!r} needs an id column")
        rinfo = self.cat.info(ref_table)
        kind, sub = next(iter(op.items()))
        rdf = rinfo.df
        own_id = F.col(f"`{amap[info.id_col]}`").outer()

        def referencing(frame: DataFrame) -> Column:
            if is_array:
                keys = frame.select(F.explode(F.col(f"`{fk}`")).alias("__fk"))
            else:
                keys = frame.select(F.col(f"`{fk}`").alias("__fk"))
            return keys.where(F.col("__fk") == own_id).exists()

        if kind == "some":
            frame = rdf if sub is True else self.filtered(rinfo, rdf, sub, True)
            return referencing(frame)
        if kind == "none":
            frame = rdf if sub is True else self.filtered(rinfo, rdf, sub, True)
            return ~referencing(frame)
        if kind == "every":
            if sub is True:
                return P.TRUE()
            framed, amap2 = self._framed(rinfo, rdf)
            violators = framed.where(~self._tree(rinfo, framed, sub, False, amap2)).drop(*amap2.values())
            return ~referencing(violators)
        return P.FALSE()


def find_all(cat: Catalog, table: str, flt: dict | None = None) -> DataFrame:
    return FilterCompiler(cat).apply(table, flt)


# -- storage aggregate -----------------------------------------------------------------

def _numbers_agg(tc: TypedCol, fn: str) -> Column:
    if family(tc.dtype) != "number":
        return F.lit(0.0)  # no numeric value -> 0
    x = tc.col.cast("double")
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn](x)
    return F.coalesce(agg, F.lit(0.0))


def storage_aggregate(cat: Catalog, table: str, options: dict) -> DataFrame:
    """``{filter, groupBy, select, having}`` -> one row per group, or one row
    overall without ``groupBy`` (even over no rows).  Per-field functions
    come back as a struct column ``field: {sum, avg, ...}``; empty -> 0."""
    info = cat.info(table)
    df = FilterCompiler(cat).apply(table, options.get("filter"))
    groups = list(options.get("groupBy") or [])
    select = options.get("select") or {}
    order = info.order_key
    aggs: list[Column] = []
    post: list[Column] = []
    for field, spec in select.items():
        if field == "_count":
            aggs.append(F.count(F.lit(1)).alias("_count"))
            post.append(F.col("_count"))
            continue
        tc = resolve(df.schema, field)
        if spec is True:
            if field in groups:
                post.append(F.col(f"`__g_{field}`").alias(field))
                continue
            if tc.missing:
                post.append(F.lit(None).alias(field))
                continue
            key = order_struct(df, require(order, "aggregate field value"))
            aggs.append(F.min_by(tc.col, key).alias(field))  # first row of the group
            post.append(F.col(f"`{field}`"))
            continue
        fns = [fn for fn in AGG_FUNCTIONS if spec.get(fn)]
        for fn in fns:
            aggs.append(_numbers_agg(tc, fn).alias(f"__{field}__{fn}"))
        post.append(F.struct(*[F.col(f"`__{field}__{fn}`").alias(fn) for fn in fns]).alias(field))
    if groups:
        gcols = [resolve(df.schema, g).col.alias(f"__g_{g}") for g in groups]
        out = df.groupBy(*gcols).agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
        out = out.select(*post)
        having = options.get("having")
        if having:
            out = out.where(_having(out, select, having))
    else:
        out = df.agg(*(aggs or [F.count(F.lit(1)).alias("__n")])).select(*post)
    return out


def _having(out: DataFrame, select: dict, having: dict) -> Column:
    conds = []
    for field, spec in having.items():
        if field == "_count":
            if "_count" in select:
                conds.append(operator_predicate(TypedCol(F.col("_count"), T.LongType()), spec, True))
            continue
        fsel = select.get(field)
        if not isinstance(fsel, dict):
            return P.FALSE()  # not an aggregated object -> every group is dropped
        for fn, op in spec.items():
            if fsel.get(fn):
                tc = TypedCol(F.col(f"`{field}`").getField(fn), T.DoubleType())
                conds.append(operator_predicate(tc, op, True))
    return reduce(lambda a, b: a & b, conds) if conds else P.TRUE()


def flatten_struct_columns(df: DataFrame, sep: str = "_") -> DataFrame:
    """``age: {sum, avg}`` -> ``age_sum, age_avg`` (for flat sinks / oracles)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            cols += [F.col(f"`{f.name}`").getField(s.name).alias(f"{f.name}{sep}{s.name}")
                     for s in f.dataType.fields]
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


__all__ = ["FilterCompiler", "find_all", "storage_aggregate", "flatten_struct_columns", "operator_predicate"]
