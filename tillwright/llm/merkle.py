"""Operator 13: a Merkle manifest of a dataset, with proofs by descent of its DAG.

Every row is a leaf, the sha256 of its length-prefixed columns.  Leaves are
ranked inside their group by one range-partitioned sort and prefix counts of
the ranges, and every 16 consecutive nodes become one node until one is left.
Each level is written as content-addressed records: digest -> children.

A proof is a descent of these records.  Requests (group, rank) start at the
root; on every level the digit of the rank in base 16 picks the child to go on
with, and the children that were not picked become one segment of the path.
Requests that share the upper digits share that part of the descent, so a level
joins one row per node and not one per leaf.  At the leaf the segments are
reversed, which gives the siblings from leaf to root.

Defined results: a null column is ``-``; null group values and null ids come
first; rows equal in id are ordered by leaf digest, and rows equal in all are
leaves of their own; an empty table has no rows and no root; very long texts are
hashed whole; columns that are not named are ignored, whatever they are called.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.llm.common import lower_ascii, small_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 4  # of a digit: 16 children


def leaf(columns: list[Column]) -> Column:
    """Hex sha256 of the columns, each ``-`` if null, else UTF-8 byte count, ``:``, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in ranges of (group, order), and the rows of each group before each range.

    The first has ``_part`` and ``_seen``, the place within range and group; the
    second one row a range and group: ``_part``, the group, ``_before``, ``size``.
    """
    def number(batches):
        part, last, seen = TaskContext.get().partitionId(), number, -1
        for batch in batches:
            out = []
            for g in batch.column("_key").to_pylist():
                last, seen = (last, seen + 1) if g == last else (g, 0)
                out.append(seen)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([part] * len(out), pa.int32()), pa.array(out, pa.int64())], [*batch.schema.names[:-1], "_part", "_seen"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    keyed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_key", F.col(group).cast("string"))
    found = written(keyed.mapInArrow(number, ", ".join([*fields, "_part int", "_seen long"])), label)
    # a group lies in consecutive ranges: its rows in the ranges before each
    each = Window.partitionBy(group)
    before = (found.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"))
              .select("_part", group, (F.sum("_n").over(each.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(each).alias("size")))
    return found, written(before, f"{label}-before")


def placed(found: DataFrame, before: DataFrame, group: str) -> DataFrame:
    """The rows with ``at``, their place (from 0) in their group, and what ``before`` says of the group."""
    there = before.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), *(c for c in before.columns if c not in ("_part", group)))
    joined = found.join(there.hint("merge"), F.col("_part").eqNullSafe(F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("at", F.col("_seen") + F.col("_before")).drop("_part", "_seen", "_p", "_g", "_before")


def levels(nodes: DataFrame, top: int, label: str) -> tuple[DataFrame, DataFrame | None]:
    """The last node of each group (``g``, ``digest``, ``depth``) and the written records (``level`` from 1, ``digest``, ``children``).

    ``nodes``: ``g``, ``at``, ``digest``, ``size``; ``top``: the largest size.  A
    level is a sixteenth of the one below.
    """
    roots = nodes.filter("size = 1").select("g", "digest", F.lit(0).alias("depth"))
    records, level, now = None, 0, nodes
    while top > 1:
        level, top = level + 1, (top + (1 << BITS) - 1) >> BITS
        grouped = (now.filter("size > 1").groupBy("g", F.shiftright("at", BITS).alias("at"), F.shiftright(F.col("size") + ((1 << BITS) - 1), BITS).alias("size"))
                   .agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("run")))
        now = written(grouped.select("g", "at", "size", F.transform("run", lambda x: x["digest"]).alias("children"))
                      .withColumn("digest", F.sha2(F.array_join("children", ""), 256)), f"{label}{level}")
        roots = roots.union(now.filter("size = 1").select("g", "digest", F.lit(level).alias("depth")))
        found = now.select(F.lit(level).alias("level"), "digest", "children").distinct()
        records = found if records is None else records.union(found)
    return roots, records if records is None else written(records, f"{label}-records")


def _segment(children: Column, digit: Column) -> Column:
    """The children that ``digit`` does not pick, as text left and right of it."""
    text = lambda x: F.array_join(x, "")
    return F.struct(text(F.slice(children, F.lit(1), digit)).alias("left"), text(F.slice(children, digit + 2, F.lit(1 << BITS))).alias("right"))


def descend(starts: DataFrame, records: DataFrame | None, requests: DataFrame, depth: int, label: str) -> DataFrame:
    """``requests`` (``g``, ``at``, ``size`` of the group, and more) with ``digest``, ``path`` and what ``starts`` carries.

    ``starts``: ``g``, ``digest``, ``depth``, ``path`` (the segments above them) and
    more; ``depth``: the largest of them.  ``path`` goes from the root down.
    """
    lone = requests.filter("size = 1").join(starts.filter("depth = 0").drop("depth").hint("merge"), "g")
    if depth == 0:
        return lone
    many = requests.filter("size > 1")
    up = lambda c="at": F.shiftright(c, BITS)
    nodes = written(many.select("g", up().alias("at")).distinct(), f"{label}-nodes") if depth > 1 else None
    wanted = [many, nodes]
    for _ in range(2, depth):
        wanted.append(wanted[-1].select("g", up().alias("at")).distinct())
    front = starts.withColumn("at", F.lit(0).cast("long")).filter("depth > 0")
    for level in range(depth, 0, -1):
        opened = (front.filter(F.col("depth") >= level).join(records.filter(F.col("level") == level).drop("level").hint("merge"), "digest")
                  .withColumnRenamed("at", "_up").drop("digest"))
        digit = F.col("at").bitwiseAND((1 << BITS) - 1).cast("int")
        went = (wanted[level - 1].withColumn("_up", up()).join(opened.hint("merge"), ["g", "_up"])
                .withColumn("digest", F.element_at("children", digit + 1))
                .withColumn("path", F.concat("path", F.array(_segment(F.col("children"), digit)))).drop("_up", "children"))
        if level == 1:
            return went.drop("depth").unionByName(lone)
        front = written(went.select(*front.columns).unionByName(front.filter(F.col("depth") < level)), f"{label}{level}")


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path (segments from the leaf up)."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, columns: list[str], *, group: str, order: str, tampered: Column, changed: str) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that follows if ``changed`` is lower-cased where ``tampered``.

    Columns: ``order``, ``leaf``, ``subroot``, ``root``, ``proof`` (siblings from
    leaf to root, joined), ``folded_root``, ``verified``, ``depth``.
    """
    small_batches(docs.sparkSession)
    other = [F.when(tampered, lower_ascii(F.col(c))).otherwise(F.col(c)) if c == changed else F.col(c) for c in columns]
    leaves = written(docs.select(F.col(group).alias("grp"), F.col(order).alias("ord"), leaf([F.col(c) for c in columns]).alias("leaf"),
                                 leaf(other).alias("now")), "leaves")
    found, before = numbered(leaves, "grp", ["ord", "leaf"], "ranked")
    # the groups by their own order; before has a row a range and group
    first = before.filter("_before = 0").select("grp", F.lit(0).alias("all"))
    named = placed(*numbered(first, "all", ["grp"], "groups"), "all").select(F.col("grp").alias("_named"), F.col("at").alias("g"))
    before = before.join(named.hint("merge"), F.col("grp").eqNullSafe(F.col("_named"))).drop("_named")
    rows = written(placed(found, before, "grp").drop("grp"), "placed")
    count, most = rows.agg(F.max("g") + 1, F.max("size")).first()
    if count is None:  # no rows
        text = F.col("leaf")
        return rows.select(F.col("ord").alias(order), text, *(text.alias(c) for c in ("subroot", "root", "proof", "folded_root")),
                           F.lit(0).alias("depth"), F.lit(True).alias("verified"))
    depth = lambda n: 0 if n <= 1 else 1 + depth((n + (1 << BITS) - 1) >> BITS)
    one, no_path = F.lit(0).cast("long").alias("g"), F.array().cast("array<struct<left:string,right:string>>").alias("path")
    last, records = levels(rows.select("g", "at", "size", F.col("leaf").alias("digest")), most, "level")
    last = written(last, "subroots")
    # the subroots are the leaves of one more tree
    heads = last.select(one, F.col("g").alias("at"), F.lit(count).cast("long").alias("size"), F.col("digest").alias("subroot"), F.col("depth").alias("under"))
    top, above = levels(heads.select("g", "at", "size", F.col("subroot").alias("digest")), count, "top")
    root = top.select("digest").first()[0]
    heads = descend(top.withColumn("path", no_path), above, heads, depth(count), "topdown")
    starts = written(heads.select(F.col("at").alias("g"), "subroot", F.col("subroot").alias("digest"), F.col("under").alias("depth"), "path"), "starts")
    found = descend(starts, records, rows, depth(most), "down")
    path = F.reverse("path")
    out = found.select(F.col("ord").alias(order), "leaf", "subroot", F.lit(root).alias("root"),
                       F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").alias("proof"),
                       folded(F.col("now"), path).alias("folded_root"), F.size("path").alias("depth"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
