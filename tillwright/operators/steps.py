"""The twelve transform steps as lazy DataFrame operators.

Each step takes the catalog and a plain config dict (the original JSON
shape) and returns a ``TableInfo`` bound to ``config["output"]``.  Rows are not
read here: a chain of steps is one Catalyst plan.  Only metadata is: the names of
a pivot without values, the ranges of a large limit, and the rows a key of a
many-to-many join has.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..functions.aggregates import agg_column
from ..functions.expressions import compile_expr
from ..functions.ordering import norm_term, order_struct, require, sort_columns, term_column
from ..functions.values import TypedCol, family, js_text, resolve
from ..session import written
from ..sources.catalog import Catalog, TableInfo

PIVOT_COLUMNS = 10_000  # widest table a pivot without given values makes
# A join key with more than PAIRS[0] pairs is dealt out in cells of that many pairs, of up to PAIRS[1] if they
# would be more than DEALT[0]; they go to DEALT[1] tasks at most.
PAIRS, DEALT = (1 << 18, 1 << 22), (1_000, 10_000)


class StepError(ValueError):
    pass


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _order_of(cfg: dict, info: TableInfo):
    return tuple(cfg.get("orderKey") or info.order_key)


# -- filter / map -------------------------------------------------------------

def filter_step(cat: Catalog, cfg: dict) -> TableInfo:
    src = cat.info(cfg["source"])
    cond = P.conditions(src.df.schema, cfg.get("conditions") or [], cfg.get("conditionLogic") or "and")
    return src.with_df(src.df.where(cond), name=cfg["output"])


def map_step(cat: Catalog, cfg: dict) -> TableInfo:
    """All mappings see the input row; a later duplicate target wins."""
    src = cat.info(cfg["source"])
    df = src.df
    compiled: dict[str, Column] = {}
    for m in cfg.get("mappings") or []:
        compiled[m["target"]] = compile_expr(df.schema, m["expression"]).col
    if cfg.get("includeOriginal"):
        keep = [_q(c) for c in df.columns if c not in compiled]
    else:
        keep = [_q(c) for c in _keep_for_map(src) if c not in compiled]
    out = df.select(*keep, *[c.alias(n) for n, c in compiled.items()])
    return src.with_df(out, name=cfg["output"])


def _keep_for_map(src: TableInfo) -> list[str]:
    # The original keeps only ``id``; we keep the order key too, so that
    # order-sensitive steps after a map still see the insertion order.
    cols = []
    if src.id_col:
        cols.append(src.id_col)
    for t in src.order_key:
        f = norm_term(t)["field"]
        if f in src.df.columns and f not in cols:
            cols.append(f)
    return cols


# -- aggregate ------------------------------------------------------------------

def aggregate_step(cat: Catalog, cfg: dict) -> TableInfo:
    src = cat.info(cfg["source"])
    df = src.df
    order = _order_of(cfg, src)
    groups = [resolve(df.schema, g).col.alias(g) for g in cfg.get("groupBy") or []]
    aggs = [agg_column(df, a.get("field", "*"), a["function"], order).alias(a["as"])
            for a in cfg.get("aggregations") or []]
    if groups:
        out = df.groupBy(*groups).agg(*aggs) if aggs else df.select(*groups).distinct()
    else:
        # A global group over an empty input yields no row in the original.
        out = (df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
               .where(F.col("__rows") > 0).drop("__rows"))
    having = cfg.get("having") or []
    if having:
        out = out.where(reduce(lambda a, b: a & b,
                               [P.expression_condition(out.schema, h, bare=True) for h in having]))
    return TableInfo(cfg["output"], out, unique=tuple(cfg.get("groupBy") or []))


# -- join ------------------------------------------------------------------------

def _key_match(lt: TypedCol, rt: TypedCol) -> Column:
    if family(lt.dtype) != family(rt.dtype) and not (lt.missing and rt.missing):
        if lt.missing or rt.missing:
            # one side missing everywhere: only NULL keys of the other match
            other = rt if lt.missing else lt
            return other.col.isNull()
        return F.lit(False)
    return lt.col.eqNullSafe(rt.col)


def join_step(cat: Catalog, cfg: dict) -> TableInfo:
    """Multi-key equi join; NULL keys match NULL keys; right overwrites left
    on a name collision when a right row exists."""
    how = cfg.get("type", "inner")
    if how not in ("inner", "left", "right", "full"):
        raise StepError(f"unknown join type {how!r}")
    if not cfg.get("on"):
        raise StepError("a join needs at least one pair of fields in 'on'")
    li, ri = cat.info(cfg["left"]), cat.info(cfg["right"])
    ldf = li.df.select(*[_q(c).alias(f"__l{i}") for i, c in enumerate(li.df.columns)])
    rdf = ri.df.select(*[_q(c).alias(f"__r{i}") for i, c in enumerate(ri.df.columns)],
                       F.lit(True).alias("__rhit"))
    lmap = {c: f"__l{i}" for i, c in enumerate(li.df.columns)}
    rmap = {c: f"__r{i}" for i, c in enumerate(ri.df.columns)}
    conds, keys, impossible = [], [], False
    for on in cfg["on"]:
        lt, rt = resolve(li.df.schema, on["leftField"]), resolve(ri.df.schema, on["rightField"])
        lt = TypedCol(_rebase(lt, li.df.columns, lmap, on["leftField"]), lt.dtype)
        rt = TypedCol(_rebase(rt, ri.df.columns, rmap, on["rightField"]), rt.dtype)
        if family(lt.dtype) != family(rt.dtype) and not lt.missing and not rt.missing:
            impossible = True  # strict typing: 1 never equals "1"
        conds.append(_key_match(lt, rt))
        keys.append((lt, rt))
    if impossible:
        # no pair can match: build the outer rows directly instead of planning
        # a join whose condition is false (a nested loop over both sides)
        lnull = [F.lit(None).cast(f.dataType).alias(f.name) for f in rdf.schema.fields]
        rnull = [F.lit(None).cast(f.dataType).alias(f.name) for f in ldf.schema.fields]
        left_rows = ldf.select("*", *lnull)
        right_rows = rdf.select(*rnull, "*")
        joined = {"inner": left_rows.where(F.lit(False)), "left": left_rows, "right": right_rows,
                  "full": left_rows.unionByName(right_rows)}[how]
    else:
        cond = reduce(lambda a, b: a & b, conds)
        kind = {"full": "full_outer"}.get(how, how)
        # pairs are bounded by the rows of one side if the keys of the other are unique
        many = not any(_unique(i, [on[f] for on in cfg["on"]]) for i, f in ((li, "leftField"), (ri, "rightField")))
        # equal keys are those of one group on either side only if they are of one type
        if many and all(lt.dtype == rt.dtype and not lt.missing and not rt.missing for lt, rt in keys) and not ldf.isStreaming and not rdf.isStreaming:
            joined = _dealt_join(ldf, rdf, [(lt.col, rt.col) for lt, rt in keys], cond, kind)
        else:
            joined = ldf.join(rdf, cond, kind)

    sel = cfg.get("select") or {}
    pre = cfg.get("prefix") or {}
    lp, rp = pre.get("left") or "", pre.get("right") or ""
    out: dict[str, Column] = {}
    lfields = _join_fields(li, sel.get("left"))
    rfields = _join_fields(ri, sel.get("right"))
    for f in lfields:
        out[lp + f] = F.col(lmap[f]) if f in lmap else F.lit(None)
    if li.id_col:
        out[(lp + "id") if lp else "left_id"] = F.col(lmap[li.id_col])
    for f in rfields:
        rc = F.col(rmap[f]) if f in rmap else F.lit(None)
        name = rp + f
        if name in out:
            out[name] = F.when(F.col("__rhit"), rc).otherwise(out[name])
        else:
            out[name] = rc
    if ri.id_col:
        name = (rp + "id") if rp else "right_id"
        rc = F.col(rmap[ri.id_col])
        out[name] = F.when(F.col("__rhit"), rc).otherwise(out[name]) if name in out else rc
    res = joined.select(*[c.alias(n) for n, c in out.items()])
    order = tuple(t for t in li.order_key if norm_term(t)["field"] in res.columns)
    return TableInfo(cfg["output"], res, order if len(order) == len(li.order_key) else ())


def _unique(info: TableInfo, fields: list[str]) -> bool:
    return info.id_col in fields or bool(info.unique) and set(info.unique) <= set(fields)


def _dealt_join(ldf: DataFrame, rdf: DataFrame, keys: list[tuple[Column, Column]], cond: Column, how: str) -> DataFrame:
    """``ldf`` and ``rdf`` joined by ``cond``, NULL-safe equality of ``keys``, where a key may have many rows on both sides.

    The rows out grow with the product of the two counts, which no size of a
    partition shows.  So the rows of each key are counted on both sides, and the
    rows of a hot key are cut in parts by a hash: every part of the left meets every
    part of the right in a cell of bounded size.  Hot keys have rows on both
    sides, so their cells are an inner join for any ``how``; the other keys are joined as they are.
    """
    names = [[f"__{side}k{i}" for i in range(len(keys))] for side in "lr"]
    counts = [df.groupBy(*[k[n].alias(c) for k, c in zip(keys, names[n], strict=True)]).agg(F.count(F.lit(1)).cast("double").alias(f"__{side}n"))
              for n, (df, side) in enumerate(((ldf, "l"), (rdf, "r")))]
    both = counts[0].join(counts[1], reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(*names, strict=True)]))
    hot = written(both.where(F.col("__ln") * F.col("__rn") > PAIRS[0]).withColumn("__hot", F.monotonically_increasing_id()), "hot")
    total = hot.agg(F.sum(F.col("__ln") * F.col("__rn"))).first()[0]
    if not total:
        return ldf.join(rdf, cond, how)
    size = min(max(total / DEALT[0], PAIRS[0]), PAIRS[1])
    tasks = min(math.ceil(total / size), DEALT[1])
    cell, least = ["__hot", "__i", "__j"], lambda c: F.least(F.col(c), F.lit(math.sqrt(size)))
    # a side of few rows is not cut, the other one then in as many parts as there are cells
    hot = hot.withColumns({"__li": F.ceil(F.col("__ln") * least("__rn") / size), "__rj": F.ceil(F.col("__rn") * least("__ln") / size)}).drop("__ln", "__rn")
    cells, cold = [], []
    for n, (df, own, mine, other, all_) in enumerate(((ldf, "__i", "__li", "__j", "__rj"), (rdf, "__j", "__rj", "__i", "__li"))):
        same = reduce(lambda a, b: a & b, [k[n].eqNullSafe(F.col(c)) for k, c in zip(keys, names[n], strict=True)])
        cold.append(df.join(hot.select(*names[n]), same, "left_anti"))
        part = F.pmod(F.xxhash64(*[_q(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]), F.col(mine))
        found = df.join(hot.select(*names[n], "__hot", "__li", "__rj"), same).withColumn(own, part)
        cells.append(found.select(*df.columns, "__hot", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col(all_) - 1)).alias(other)).repartition(tasks, *cell))
    rest = cold[0].join(cold[1], cond, how)
    return rest.unionByName(cells[0].join(cells[1].hint("merge"), cell).select(*rest.columns))


def _rebase(tc: TypedCol, cols, mapping, path: str) -> Column:
    if tc.missing:
        return tc.col
    if path in cols:
        return F.col(mapping[path])
    head, _, rest = path.partition(".")
    c = F.col(mapping[head])
    for part in rest.split("."):
        c = F.try_element_at(c, F.lit(int(part) + 1)) if part.isdigit() else c.getField(part)
    return c


def _join_fields(info: TableInfo, select) -> list[str]:
    if select is None or select == "*":
        return [c for c in info.df.columns if c != info.id_col]
    return list(select)


# -- lookup ----------------------------------------------------------------------

def lookup_step(cat: Catalog, cfg: dict) -> TableInfo:
    """Enrich each source row with the first match (struct) or all matches
    (array, ``[]`` when none).  The looked-up side is aggregated to one row
    per key first, so the join stays 1:1 and the row count equals the source.
    """
    src, frm = cat.info(cfg["source"]), cat.info(cfg["from"])
    as_name = cfg["as"]
    lt = resolve(src.df.schema, cfg["localField"])
    ft = resolve(frm.df.schema, cfg["foreignField"])
    fdf = frm.df
    rec = F.struct(*[_q(c) for c in fdf.columns])
    order = require(_order_of({"orderKey": cfg.get("fromOrderKey")}, frm), "lookup")
    key = order_struct(fdf, order)
    if cfg.get("multiple"):
        agg = F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), rec.alias("r")))),
                          lambda p: p["r"])
    else:
        agg = F.min_by(rec, key)
    comparable = family(lt.dtype) == family(ft.dtype) and not lt.missing and not ft.missing
    if not comparable:
        empty = (F.array().cast(T.ArrayType(fdf.schema)) if cfg.get("multiple")
                 else F.lit(None).cast(fdf.schema))
        out = src.df.withColumn(as_name, empty)
        return src.with_df(out, name=cfg["output"])
    right = fdf.groupBy(ft.col.alias("__fk")).agg(agg.alias("__m"))
    left = src.df.withColumn("__lk", lt.col)
    joined = left.join(right, left["__lk"].eqNullSafe(right["__fk"]), "left")
    m = F.col("__m")
    if cfg.get("multiple"):
        m = F.coalesce(m, F.array().cast(T.ArrayType(fdf.schema)))
    cols = [_q(c) for c in src.df.columns if c != as_name]
    out = joined.select(*cols, m.alias(as_name))
    return src.with_df(out, name=cfg["output"])


# -- union -----------------------------------------------------------------------

def union_step(cat: Catalog, cfg: dict) -> TableInfo:
    infos = [cat.info(s) for s in cfg["sources"]]
    keys = cfg.get("distinctKeys")
    if cfg.get("mode") != "distinct" or not keys:
        dfs = [i.df for i in infos]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
        return TableInfo(cfg["output"], out)
    # first occurrence per key, sources in list order, rows in their order:
    # one hash aggregate with ``min_by`` over (source ordinal, order key)
    keyed = []
    width = max(len(require(i.order_key, "union distinct")) for i in infos)
    for n, info in enumerate(infos):
        k = order_struct(info.df, info.order_key)
        if k is None:
            raise StepError("union distinct needs numeric / time / ascending text order keys")
        fields = []
        for j in range(width):
            if j < len(info.order_key):
                fields += [k[f"n{j}"].alias(f"n{j}"), _rank_value(k[f"v{j}"], info.df, info.order_key[j]).alias(f"v{j}")]
            else:
                fields += [F.lit(0).alias(f"n{j}"), _exact(F.lit(None).cast("double")).alias(f"v{j}")]
        keyed.append(info.df.withColumn("__rank", F.struct(F.lit(n).alias("src"), *fields)))
    allc = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), keyed)
    cols = [c for c in allc.columns if c != "__rank"]
    gk = [resolve(allc.schema, k).col.alias(f"__k{i}") for i, k in enumerate(keys)]
    best = allc.groupBy(*gk).agg(F.min_by(F.struct(*[_q(c) for c in cols]), F.col("__rank")).alias("__r"))
    out = best.select("__r.*")
    return TableInfo(cfg["output"], out)


def _exact(v: Column) -> Column:
    """A number to order by, of any numeric type: as a double, then as a decimal
    that parts what doubles cannot (integers above 2 to the 53rd)."""
    return F.struct(v.cast("double").alias("d"), v.try_cast("decimal(38,9)").alias("x"))


def _rank_value(v: Column, df: DataFrame, term) -> Column:
    tc = resolve(df.schema, norm_term(term)["field"])
    if family(tc.dtype) == "date":
        return _exact(F.unix_micros(v.cast("timestamp")) if norm_term(term)["direction"] == "asc" else v)
    if family(tc.dtype) in ("number", "boolean"):
        return _exact(v.cast("int") if family(tc.dtype) == "boolean" else v)
    return v.cast("string")


# -- deduplicate -------------------------------------------------------------------

def deduplicate_step(cat: Catalog, cfg: dict) -> TableInfo:
    """One row per key; ``first`` / ``last`` in the stable sort by
    ``orderBy`` then insertion order.  NULL keys form one group."""
    src = cat.info(cfg["source"])
    df = src.df
    order = require(_order_of(cfg, src), "deduplicate")
    terms = ([cfg["orderBy"]] if cfg.get("orderBy") else []) + list(order)
    keep = cfg.get("keep", "first")
    gk = [resolve(df.schema, k).col.alias(f"__k{i}") for i, k in enumerate(cfg["keys"])]
    knames = [f"__k{i}" for i in range(len(gk))]
    staged = df.select(*[_q(c) for c in df.columns], *gk)
    eff = [norm_term(t) if keep == "first" else _flip(t) for t in terms]  # "last" = first of the reversed sort
    # a descending text term cannot be folded into an order struct: narrow the
    # group to its best value of that term with a hash aggregate + key join
    # (skew-safe: no window holds a whole group), then continue with the rest
    while eff and order_struct(staged, eff) is None:
        t = eff.pop(0)
        staged = _narrow(staged, knames, t)
    rec = F.struct(*[_q(c) for c in df.columns])
    if eff:
        pick = F.min_by(rec, order_struct(staged, eff))
    else:
        pick = F.min(rec)  # the remaining rows tie on every term; any is first
    out = staged.groupBy(*knames).agg(pick.alias("__r")).select("__r.*")
    return src.with_df(out, name=cfg["output"])


def _narrow(df: DataFrame, knames: list[str], t: dict) -> DataFrame:
    """Keep, per group, only the rows holding the first value of term ``t``."""
    v = term_column(df, t)
    ext = F.max(v) if t["direction"] == "desc" else F.min(v)
    best = df.groupBy(*knames).agg(ext.alias("__best"), F.max(v.isNull().cast("int")).alias("__hasnull"))
    target = (F.when(F.col("__hasnull") == 1, F.lit(None)).otherwise(F.col("__best"))
              if t["nulls"] == "first" else F.col("__best"))
    best = best.select(*[F.col(k).alias(f"__b{k}") for k in knames], target.alias("__target"))
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(best[f"__b{k}"]) for k in knames]) if knames else F.lit(True)
    joined = df.join(best, cond, "inner")
    return joined.where(v.eqNullSafe(F.col("__target"))).drop("__target", *[f"__b{k}" for k in knames])


def _flip(t):
    t = norm_term(t)
    return {**t, "direction": "asc" if t["direction"] == "desc" else "desc",
            "nulls": "first" if t["nulls"] == "last" else "last"}


# -- sort / limit ------------------------------------------------------------------

def sort_step(cat: Catalog, cfg: dict) -> TableInfo:
    """Stable multi-key sort; NULLs last in both directions unless asked.

    The sort is *recorded* as the table's order: Spark rows carry no order,
    so the following ``limit`` (or a sink) applies it - ``sort -> limit``
    becomes one TakeOrderedAndProject instead of a global sort.
    """
    src = cat.info(cfg["source"])
    terms = [norm_term(t) for t in cfg["orderBy"]]
    order = tuple(terms) + tuple(_order_of(cfg, src))
    return src.with_df(src.df, name=cfg["output"], order_key=order)


TOP_ROWS = 100_000  # up to so many rows a limit is one top-k, beyond it the order is dealt in ranges


def limit_step(cat: Catalog, cfg: dict) -> TableInfo:
    """Rows ``offset`` to ``offset + limit`` of the table's order.  A large (or
    ``distributed``) limit is taken from sorted ranges, so no task holds it."""
    src = cat.info(cfg["source"])
    order = require(_order_of(cfg, src), "limit")
    off, limit = int(cfg.get("offset") or 0), int(cfg["limit"])
    if off + limit > TOP_ROWS or cfg.get("distributed"):
        return src.with_df(ordered_slice(src.df, sort_columns(src.df, order), off, limit), name=cfg["output"])
    df = src.df.orderBy(*sort_columns(src.df, order))
    if off:
        df = df.offset(off)
    return src.with_df(df.limit(limit), name=cfg["output"])


def ordered_slice(df: DataFrame, by: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order ``by``.

    Rows are dealt in ranges of the order and numbered inside each (a written
    table); the sizes of the ranges before, one row a range, give the rest.
    """
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    ranged = written(ranged.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)}), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at")
    return ranged.join(F.broadcast(before), "__part").where((place >= offset) & (place < offset + limit)).select(*[_q(c) for c in df.columns])


def materialize_order(info: TableInfo) -> DataFrame:
    """The table sorted by its order key (for sinks that keep order)."""
    if not info.order_key:
        return info.df
    return info.df.orderBy(*sort_columns(info.df, info.order_key))


# -- pivot / unpivot ----------------------------------------------------------------

def pivot_text(tc: TypedCol) -> Column:
    """Column name of a pivot value: text as-is, others JSON, NULL "null"."""
    if family(tc.dtype) == "string":
        return F.coalesce(tc.col, F.lit("null"))
    return js_text(tc, null_as="null")


def pivot_step(cat: Catalog, cfg: dict) -> TableInfo:
    """Values of one field to columns, in two phases: one aggregate per group and
    value, then a spread of those few rows (Spark's own pivot, by a lookup of the
    value).  Without given ``values`` the names come from the first phase; more than
    ``PIVOT_COLUMNS`` of them give one map column ``pivoted`` instead."""
    src = cat.info(cfg["source"])
    df = src.df
    ptc = resolve(df.schema, cfg["pivotField"])
    order = _order_of(cfg, src)
    groups = [resolve(df.schema, g).col.alias(g) for g in cfg.get("groupBy") or []]
    staged = df.withColumn("__p", pivot_text(ptc))
    each = staged.groupBy(*groups, "__p").agg(agg_column(staged, cfg["valueField"], cfg["aggregation"], order).alias("__v"))
    names = cfg.get("values")
    if names is None:
        each = written(each, "pivot")
        names = sorted(r["__p"] for r in each.select("__p").distinct().limit(PIVOT_COLUMNS + 1).collect())
    by = [_q(g) for g in cfg.get("groupBy") or []]
    if len(names) > PIVOT_COLUMNS:
        return TableInfo(cfg["output"], each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__p", "__v"))).alias("pivoted")))
    if not names:  # no rows
        return TableInfo(cfg["output"], each.select(*by).distinct())
    out = each.groupBy(*by).pivot("__p", [str(v) for v in names]).agg(F.first("__v"))
    if not by and each.isEmpty():
        out = out.where(F.lit(False))
    return TableInfo(cfg["output"], out)


def unpivot_step(cat: Catalog, cfg: dict) -> TableInfo:
    """Columns to rows; NULL values are kept."""
    src = cat.info(cfg["source"])
    df = src.df
    ids = [resolve(df.schema, f).col.alias(f) for f in cfg.get("idFields") or []]
    vals = [resolve(df.schema, f) for f in cfg["unpivotFields"]]
    fams = {family(v.dtype) for v in vals if not v.missing}
    if fams == {"number"}:
        vcols = [v.col.cast("double") for v in vals]
    elif len(fams) <= 1 and len({v.dtype for v in vals if not v.missing}) <= 1:
        vcols = [v.col for v in vals]
    else:
        vcols = [js_text(v) for v in vals]
    staged = df.select(*ids, *[c.alias(f"__v{i}") for i, c in enumerate(vcols)])
    name_field, value_field = cfg["nameField"], cfg["valueField"]
    pairs = F.array(*[F.struct(F.lit(f).alias("n"), F.col(f"__v{i}").alias("v"))
                      for i, f in enumerate(cfg["unpivotFields"])])
    out = staged.select(*[_q(c) for c in cfg.get("idFields") or []],
                        F.inline(pairs)).withColumnsRenamed({"n": name_field, "v": value_field})
    return TableInfo(cfg["output"], out)


# -- flatten ---------------------------------------------------------------------------

def flatten_step(cat: Catalog, cfg: dict) -> TableInfo:
    """One row per array element, with its position ``pos``.

    Non-array, NULL and empty arrays are dropped unless ``preserveEmpty``
    (then one row with NULL).  ``pos`` replaces the original's duplicated id.
    """
    src = cat.info(cfg["source"])
    df = src.df
    field = cfg["field"]
    out_name = cfg.get("as") or field
    tc = resolve(df.schema, field)
    keep_cols = [c for c in df.columns if c != out_name]
    if not isinstance(tc.dtype, T.ArrayType):
        if not cfg.get("preserveEmpty"):
            return src.with_df(df.limit(0).select(*[_q(c) for c in keep_cols],
                                                 F.lit(None).alias(out_name), F.lit(None).cast("int").alias("pos")),
                               name=cfg["output"])
        out = df.select(*[_q(c) for c in keep_cols], F.lit(None).alias(out_name),
                        F.lit(None).cast("int").alias("pos"))
        return src.with_df(out, name=cfg["output"])
    gen = F.posexplode_outer(tc.col) if cfg.get("preserveEmpty") else F.posexplode(tc.col)
    out = df.select(*[_q(c) for c in keep_cols], gen.alias("pos", out_name))
    order = tuple(src.order_key) + ("pos",) if src.order_key else ()
    return src.with_df(out, name=cfg["output"], order_key=order)


STEPS = {
    "filter": filter_step,
    "map": map_step,
    "aggregate": aggregate_step,
    "join": join_step,
    "lookup": lookup_step,
    "union": union_step,
    "deduplicate": deduplicate_step,
    "sort": sort_step,
    "limit": limit_step,
    "pivot": pivot_step,
    "unpivot": unpivot_step,
    "flatten": flatten_step,
}


def run_step(cat: Catalog, step_type: str, cfg: dict) -> TableInfo:
    fn = STEPS.get(step_type)
    if fn is None:
        raise StepError(f"unknown step type {step_type!r}")
    info = fn(cat, cfg)
    cat.put(info)
    return info
