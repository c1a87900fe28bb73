"""Survivorship: merge the member source records of each golden record.

One grouped aggregate per golden record picks every field's winner with
``min_by`` over a strategy-specific ordering struct, so partial aggregation
runs map-side and a golden record with millions of members never lands
whole in one task.  ``mostFrequent`` needs value counts and runs as a
two-level aggregate per such field.  Ties go to the first candidate in
member order (``order_by``), as in the original's stable sorts.

A golden row holds no list that grows with its members: ``sources`` is per
source *system* (field list and record count), and a decision names the winning
record and, on demand, the first ``candidates`` values it was chosen from.  The
whole lists are tables: ``candidate_rows`` (one row a golden record, field and
record with a value) and ``contribution_rows`` (one row a member: the fields that
its system gave, so also the ids that a golden record was matched from).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.values import TypedCol, family, js_text, literal

STRATEGIES = ("mostRecent", "mostFrequent", "highestConfidence", "sourceRanking", "longestValue", "manual")
BIG_RANK = 1 << 30


def leaf_fields(dtype: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Leaf paths of the data struct; arrays and timestamps are leaves."""
    out = []
    for f in dtype.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            out += leaf_fields(f.dataType, path)
        else:
            out.append((path, f.dataType))
    return out


def rule_for(field: str, config: dict) -> dict | None:
    """Exact field, then parent paths; the ``""`` rule is the last parent."""
    rules = config.get("rules") or []
    for r in rules:
        if r["field"] == field:
            return r
    parts = field.split(".")
    for i in range(len(parts) - 1, -1, -1):
        parent = ".".join(parts[:i])
        for r in rules:
            if r["field"] == parent:
                return r
    return None


def _data_col(path: str) -> Column:
    c = F.col("data")
    for p in path.split("."):
        c = c.getField(p)
    return c


def _candidate(v: Column, dtype: T.DataType) -> Column:
    if family(dtype) == "string":
        return v.isNotNull() & (v != F.lit(""))
    return v.isNotNull()


def _nest(paths: dict[str, Column]) -> Column:
    """``{"a.b": c1, "a.c": c2, "d": c3}`` -> ``struct(a: struct(b, c), d)``."""
    tree: dict = {}
    for path, c in paths.items():
        node = tree
        parts = path.split(".")
        for p in parts[:-1]:
            node = node.setdefault(p, {})
        node[parts[-1]] = c

    def build(node):
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return build(tree)


def merge_golden(members: DataFrame, config: dict, *, order_by=("ingestedAt", "id"),
                 existing: DataFrame | None = None, batch_ts=None, golden_col: str = "goldenRecordId",
                 candidates: int = 0) -> DataFrame:
    """Golden rows ``(id, entityType, data, sources, confidence, ...)`` for
    every golden id present in ``members``.  With ``candidates`` every decision
    lists that many of its candidates, the first in member order."""
    default_strategy = config.get("defaultStrategy") or "mostRecent"
    default_ranking = config.get("defaultSourceRanking") or []
    data_type = members.schema["data"].dataType
    fields = leaf_fields(data_type)
    now = F.lit(batch_ts).cast("timestamp") if batch_ts is not None else F.current_timestamp()

    m = members.withColumn("__ord", F.struct(*[F.col(c) for c in order_by]))
    rec_of = lambda v: F.struct(v.alias("value"), F.col("sourceSystem").alias("system"), F.col("id").alias("record"))

    aggs: list[Column] = [F.min_by(F.col("entityType"), F.col("__ord")).alias("entityType")]
    frequent: list[tuple[str, T.DataType]] = []
    plan: dict[str, tuple[str, dict | None]] = {}
    for path, dtype in fields:
        rule = rule_for(path, config)
        strategy = (rule or {}).get("strategy") or default_strategy
        ranking = (rule or {}).get("sourceRanking") or default_ranking
        plan[path] = (strategy, rule)
        v = _data_col(path)
        cand = _candidate(v, dtype)
        if strategy == "mostFrequent":
            frequent.append((path, dtype))
            continue
        if strategy == "mostRecent":
            key = F.struct((-F.unix_micros(F.col("sourceUpdatedAt"))).alias("k"), F.col("__ord").alias("o"))
        elif strategy == "highestConfidence":
            key = F.struct((-F.col("confidence")).alias("k"), F.col("__ord").alias("o"))
        elif strategy == "sourceRanking" and ranking:
            pos = F.array_position(F.array(*[F.lit(s) for s in ranking]), F.col("sourceSystem"))
            rank = F.when(pos > 0, pos).otherwise(F.lit(BIG_RANK))
            key = F.struct(rank.alias("k"), F.col("__ord").alias("o"))
        elif strategy == "longestValue":
            key = F.struct((-F.length(js_text(TypedCol(v, dtype)))).alias("k"), F.col("__ord").alias("o"))
        else:  # manual, sourceRanking without a list: first candidate
            key = F.struct(F.lit(0).alias("k"), F.col("__ord").alias("o"))
        aggs.append(F.min_by(rec_of(v), F.when(cand, key)).alias(f"__w_{path}"))

    gold = m.groupBy(F.col(golden_col).alias("id")).agg(*aggs)

    for path, dtype in frequent:
        v = _data_col(path)
        counted = (m.where(_candidate(v, dtype))
                   .groupBy(F.col(golden_col).alias("__gid"), F.to_json(F.struct(v.alias("v"))).alias("__vk"))
                   .agg(F.count(F.lit(1)).alias("__n"), F.min("__ord").alias("__first"),
                        F.min_by(rec_of(v), F.col("__ord")).alias("__rec")))
        best = counted.groupBy("__gid").agg(
            F.min_by("__rec", F.struct((-F.col("__n")).alias("k"), F.col("__first").alias("o"))).alias(f"__w_{path}"))
        gold = gold.join(best, gold["id"] == best["__gid"], "left").drop("__gid")

    if existing is not None:
        ex = existing.select(F.col("id").alias("__eid"), F.col("data").alias("__edata"),
                             F.col("createdAt").alias("__ecreated"))
        gold = gold.join(ex, gold["id"] == ex["__eid"], "left").drop("__eid")

    winners: dict[str, Column] = {}
    systems: dict[str, Column] = {}
    decisions = []
    for path, dtype in fields:
        strategy, rule = plan[path]
        w = F.col(f"`__w_{path}`")
        value, system, record = w.getField("value"), w.getField("system"), w.getField("record")
        if strategy == "manual" and existing is not None:
            ev = F.col("__edata")
            for p in path.split("."):
                ev = ev.getField(p)
            value = F.when(ev.isNotNull(), ev).otherwise(value)
            system = F.when(ev.isNotNull(), F.lit("golden")).otherwise(system)
        if rule is not None and rule.get("defaultValue") is not None:
            d = literal(rule["defaultValue"]).col.cast(dtype)
            system = F.when(value.isNull(), F.lit("default")).otherwise(system)
            value = F.coalesce(value, d)
        winners[path] = value
        systems[path] = system
        decisions.append(F.when(system.isNotNull(), F.struct(
            F.lit(path).alias("field"), js_text(TypedCol(value, dtype)).alias("selectedValue"),
            F.lit(strategy).alias("strategy"), system.alias("sourceSystem"),
            F.when(~system.isin("golden", "default"), record).alias("sourceRecordId"))))

    contrib_pairs = F.filter(F.array(*[F.struct(F.lit(p).alias("field"), s.alias("system"))
                                       for p, s in systems.items()]),
                             lambda x: x["system"].isNotNull() & ~x["system"].isin("golden", "default"))
    created = F.coalesce(F.col("__ecreated"), now) if existing is not None else now
    gold = gold.select(
        "id", "entityType", _nest(winners).alias("data"),
        F.filter(F.array(*decisions), lambda x: x.isNotNull()).alias("mergeDecisions"),
        contrib_pairs.alias("__contrib"),
        F.lit(False).alias("needsReview"), created.alias("createdAt"),
        now.alias("updatedAt"), now.alias("lastMergedAt"))
    if candidates:
        # the rows are sorted by field; even parts of bounded size, as a scan's split may hold any number of members
        even = members.hint("rebalance", F.col("id"))
        gold = _with_candidates(gold, candidate_rows(even, order_by=order_by, golden_col=golden_col), candidates)
    return _with_confidence(gold, m, golden_col)


def candidate_rows(members: DataFrame, *, order_by=("ingestedAt", "id"), golden_col: str = "goldenRecordId") -> DataFrame:
    """Every value a field was chosen from: ``id`` (of the golden record), ``field``, ``sourceSystem``,
    ``sourceRecordId``, ``value`` (as text), ``confidence``, ``updatedAt`` and ``order`` (member order)."""
    fields = [F.when(_candidate(_data_col(p), t), F.struct(F.lit(p).alias("field"), js_text(TypedCol(_data_col(p), t)).alias("value")))
              for p, t in leaf_fields(members.schema["data"].dataType)]
    return (members.where(F.col(golden_col).isNotNull())
            .select(F.col(golden_col).alias("id"), "sourceSystem", F.col("id").alias("sourceRecordId"), "confidence",
                    F.col("sourceUpdatedAt").alias("updatedAt"), F.struct(*[F.col(c) for c in order_by]).alias("order"),
                    F.explode(F.array_compact(F.array(*fields))).alias("f"))
            .select("id", "f.field", "sourceSystem", "sourceRecordId", "f.value", "confidence", "updatedAt", "order"))


def _with_candidates(gold: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` candidates of each decision: a limit a group before the shuffle, so no group is collected."""
    first = Window.partitionBy("id", "field").orderBy("order")
    few = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    item = F.struct("rank", "sourceSystem", "sourceRecordId", "value", "confidence", "updatedAt")
    lists = few.groupBy("id", "field").agg(F.sort_array(F.collect_list(item)).alias("list"))
    lists = lists.groupBy(F.col("id").alias("__cid")).agg(F.map_from_entries(F.collect_list(F.struct("field", "list"))).alias("__lists"))
    found = lambda d: F.coalesce(F.element_at("__lists", d["field"]), F.array().cast(few_type))
    few_type = lists.schema["__lists"].dataType.valueType
    return gold.join(lists, gold["id"] == lists["__cid"], "left").withColumn(
        "mergeDecisions", F.transform("mergeDecisions", lambda d: d.withField("candidates", F.coalesce(found(d), F.array().cast(few_type))))).drop("__cid", "__lists")


def contribution_rows(gold: DataFrame, members: DataFrame, golden_col: str = "goldenRecordId") -> DataFrame:
    """One row a member of each golden record: ``id``, ``sourceRecordId``, ``sourceSystem``,
    ``contributedFields`` (those that its system gave; empty if none) and ``lastUpdatedAt``."""
    given = gold.select(F.col("id").alias("__gid"), F.explode("sources").alias("s")).select("__gid", F.col("s.sourceSystem").alias("__sys"), F.col("s.contributedFields").alias("__f"))
    m = members.join(gold.select(F.col("id").alias(golden_col)), golden_col, "left_semi")
    return (m.join(given, (m[golden_col] == given["__gid"]) & (m["sourceSystem"] == given["__sys"]), "left")
            .select(F.col(golden_col).alias("id"), m["id"].alias("sourceRecordId"), "sourceSystem",
                    F.coalesce("__f", F.array().cast("array<string>")).alias("contributedFields"), F.col("sourceUpdatedAt").alias("lastUpdatedAt")))


def _with_confidence(gold: DataFrame, members: DataFrame, golden_col: str) -> DataFrame:
    """confidence = sum(conf * fields won by the record's system) / sum(fields), else 0.5."""
    per_sys = (gold.select("id", F.explode("__contrib").alias("c"))
               .groupBy("id", F.col("c.system").alias("system"))
               .agg(F.count(F.lit(1)).alias("nfields"), F.sort_array(F.collect_list("c.field")).alias("fields")))
    stats = members.groupBy(F.col(golden_col).alias("id"), F.col("sourceSystem").alias("system")).agg(
        F.sum("confidence").alias("sumconf"), F.count(F.lit(1)).alias("nrec"),
        F.max("sourceUpdatedAt").alias("lastUpdatedAt"))
    joined = per_sys.join(stats, ["id", "system"], "inner")
    conf = joined.groupBy("id").agg(
        (F.sum(F.col("nfields") * F.col("sumconf")) / F.sum(F.col("nfields") * F.col("nrec"))).alias("confidence"),
        F.sort_array(F.collect_list(F.struct(
            F.col("system").alias("sourceSystem"), F.col("fields").alias("contributedFields"),
            F.col("nrec").alias("sourceRecords"), F.col("lastUpdatedAt").alias("lastUpdatedAt")))).alias("sources"))
    out = gold.join(conf, "id", "left").drop("__contrib")
    return out.withColumn("confidence", F.coalesce(F.col("confidence"), F.lit(0.5))).withColumn(
        "sources", F.coalesce(F.col("sources"), F.array().cast(conf.schema["sources"].dataType)))


