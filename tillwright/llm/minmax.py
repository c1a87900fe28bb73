"""Operator 6: near-duplicate documents by min-max hashing.

Under each permutation of the shingles both the smallest and the largest value
are kept, so a signature needs half the hash evaluations of plain MinHash.
Bands of ``ROWS`` signature values are the buckets; documents that share a
bucket are candidates, and links are confirmed on the full shingle sets.

Documents with equal sets are one class from the start.  Inside a bucket no
pairs are listed: its smallest class is the hub, every member is compared with
the hub, and components are formed.  A hub is settled then, and a bucket whose
other members are in one component is closed.  Of an open one only the members
outside its largest component are carried on; they become the next hubs (all of
them if there are few, else some chosen by hash, ``GROWTH`` times as many in
every round) and meet the whole bucket again, until each pair of a bucket is
compared or in one component.  So nothing that shares a bucket
is lost, a group of thousands of near copies costs a few comparisons a member,
and the rounds grow with the logarithm of a bucket.

Each class carries an odd sketch of its set: bit i is the parity of the
shingles that fall into cell i.  Bits in which two sketches differ are at most
the shingles in which the sets differ, so a pair with too many of them cannot
be a link and is left out inside the join, before its texts are fetched; all
others are compared on the full sets.
A pair at 80 % shares no bucket with a probability of 3e-6, one at 85 % of 7e-9.

Defined results: a null or empty text, or one without words, has no shingles
and is alone; fewer words than a shingle make one shingle; the smallest id of
a component is its id, null ids come last (a component of null ids only has a
null id, and its rows are kept); rows that repeat an id are kept or dropped
together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import row_key, small_batches, written
from tillwright.llm.shingles import MIX, mixed, shingle_sets
from tillwright.operators.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BANDS = 32
ROWS = 5
HUBS = 8  # hubs of a bucket in the round after the first
GROWTH = 4  # and how many times more in every round after that
WORDS = 16  # longs of an odd sketch
LAST = 2**63 - 1  # stands for a null id


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Band hashes (texts x BANDS) of texts that have shingles."""
    begins = (np.cumsum(counts) - counts).astype(np.int64)
    half = BANDS * ROWS // 2
    both = np.empty((2 * half, len(counts)), np.uint64)
    for j in range(half):
        seed = mixed(np.array([j + 1], np.uint64) * MIX[0])
        permuted = (values ^ seed) * (mixed(seed) | np.uint64(1))
        permuted ^= permuted >> np.uint64(32)
        both[j], both[half + j] = np.minimum.reduceat(permuted, begins), np.maximum.reduceat(permuted, begins)
    out = np.empty((len(counts), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(counts), band, np.uint64)
        for row in range(ROWS):
            h = mixed(h * MIX[0] + both[band + row * BANDS])
        out[:, band] = h
    return out


def odd_sketches(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of 64 * WORDS cells (texts x WORDS longs)."""
    cells = 64 * WORDS
    cell = (mixed(values ^ MIX[1]) % np.uint64(cells)).astype(np.int64)
    hits = np.bincount(np.repeat(np.arange(len(counts)), counts) * cells + cell, minlength=len(counts) * cells)
    return np.packbits((hits & 1).astype(np.uint8)).view(np.int64).reshape(len(counts), WORDS)


def may_link(num: int, den: int) -> Column:
    """Whether classes a and b (sizes ``na``, ``nb``, sketches ``sa``, ``sb``) can be similar enough.

    Never false for a link: with den * intersection >= num * union the sets
    differ in at most (na + nb) * (den - num) / (den + num) shingles.
    """
    near = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    differ = reduce(Column.__add__, [F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(WORDS)])
    return near & (differ * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))


def _sign(width: int):
    def run(batches):
        for batch in batches:
            values, counts = shingle_sets(batch.column("text").cast(pa.string()), width)
            some = counts > 0
            node = np.zeros((len(counts), 2), np.uint64)
            bands = pa.nulls(len(counts), pa.list_(pa.int64()))
            if some.any():
                begins = (np.cumsum(counts) - counts)[some]
                node[some, 0] = np.add.reduceat(mixed(values), begins)
                node[some, 1] = np.add.reduceat(mixed(values ^ MIX[0]), begins)
                signed = signatures(values, counts[some])
                ends = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed.reshape(-1).view(np.int64)))
            raw = node.tobytes()
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("_k1", "_k2", "id")}, "n": pa.array(counts, pa.int64()),
                "odd": pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * WORDS, pa.int32()), pa.array(odd_sketches(values, counts).reshape(-1))),
                "node": pa.array([raw[i * 16:i * 16 + 16] if s else None for i, s in enumerate(some.tolist())], pa.binary()), "bands": bands})
    return run


def _confirm(width: int, num: int, den: int):
    """Pairs whose full sets are similar enough: den * intersection >= num * union."""
    def run(batches):
        for batch in batches:
            sides = []
            for c in ("ta", "tb"):
                coded = batch.column(c).cast(pa.string()).dictionary_encode()
                values, counts = shingle_sets(coded.dictionary, width)
                begins, which = np.cumsum(counts) - counts, coded.indices.to_numpy()
                lens = counts[which]
                upto = np.cumsum(lens)
                at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(begins[which] - (upto - lens), lens)
                sides.append((np.repeat(np.arange(len(which)), lens), values[at], lens))
            (oa, va, na), (ob, vb, nb) = sides
            owner, value = np.concatenate((oa, ob)), np.concatenate((va, vb))
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
            twice = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
            shared = np.bincount(owner[1:][twice], minlength=len(na))
            keep = pa.array(den * shared >= num * (na + nb - shared))
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(keep) for c in ("a", "b")})
    return run


def near_duplicates(docs: DataFrame, width: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``n_links``, ``root`` and the row key.

    ``root`` is the same for all rows of a component, and null for a text without shingles.

    ``n_links`` counts the confirmed links of the document's class that were
    compared; documents with equal sets have the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*row_key(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.col("text").cast("string").alias("text"))
    signed = written(rows.mapInArrow(_sign(width), "_k1 long, _k2 long, id long, n long, odd array<long>, node binary, bands array<long>"), "signed")
    # one row per class: its smallest id, one of its rows, its sketch and bands
    classes = written(signed.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.min(F.struct("_k1", "_k2")).alias("k"),
                                                                 F.min("odd").alias("s"), F.min("bands").alias("bands")), "classes")
    buckets = classes.select("node", F.posexplode("bands").alias("band", "h"))
    shared = buckets.groupBy("band", "h").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("hub")).filter("c > 1")
    members = written(buckets.join(shared.drop("c"), ["band", "h"]), "members")
    wanted = classes.select("node", "k._k1", "k._k2").join(members.select("node").distinct(), "node", "left_semi")
    texts = written(wanted.join(rows.select("_k1", "_k2", "text"), ["_k1", "_k2"]).groupBy("node").agg(F.min("text").alias("text"))
                    if _repeats(signed) else wanted.join(rows.select("_k1", "_k2", "text"), ["_k1", "_k2"]).select("node", "text"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        both = with_a.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        return written(both.select("a", "b", "ta", "tb").mapInArrow(_confirm(width, num, den), "a binary, b binary"), "links")

    sketch = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
    first = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct().join(sketch("b"), "b").join(sketch("a"), "a")
    links = confirmed(first.filter(may_link(num, den)).select("a", "b"))
    all_links = [links]
    roots = components(links, "a", "b", written)
    root_of = lambda df: df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # outsiders: members that are neither the first hub nor in their bucket's largest component, which ``lead`` names
    members = written(members.join(classes.select("node", "n", "s"), "node"), "sketched")
    now = root_of(members.filter("node <> hub").drop("hub"))
    largest = (now.groupBy("band", "h", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("band", "h").agg(F.sum("c").alias("c"), F.max(F.struct("c", "root")).alias("l"))
               .filter("c > l.c").select("band", "h", F.col("l.root").alias("lead")))
    open_, slots = written(now.join(largest, ["band", "h"]).filter("root <> lead").drop("root"), "outsiders"), HUBS
    while True:
        leads = roots.select(F.col("node").alias("lead"), F.col("root").alias("to"))
        now = root_of(open_).join(leads, "lead", "left").withColumn("lead", F.coalesce("to", "lead")).drop("to").filter("root <> lead")
        others = now.groupBy("band", "h").agg(F.count(F.lit(1)).alias("others"))
        now = written(now.join(others, ["band", "h"]), "open")
        # all outsiders of a bucket if they are few, or some of them by hash
        slot = F.when(F.col("others") <= slots, F.xxhash64("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(slots)))
        hubs = written(now.groupBy("band", "h", slot.alias("slot")).agg(F.min(F.struct("node", "n", "root", "s")).alias("x")).select("band", "h", "x.*"), "hubs")
        if hubs.isEmpty():
            break
        open_, slots = now.join(hubs, ["band", "h", "node"], "left_anti").drop("root", "others"), slots * GROWTH
        other = root_of(members).select("band", "h", "hub", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("s").alias("sb"))
        pairs = (hubs.withColumnsRenamed({"node": "a", "n": "na", "root": "ra", "s": "sa"}).join(other, ["band", "h"])
                 .filter("ra <> rb and b <> hub").filter(may_link(num, den)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        new = confirmed(pairs)
        if new.isEmpty():
            continue
        all_links.append(new)
        to_a, to_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        between = written(new.join(to_a, "a", "left").join(to_b, "b", "left")
                          .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct(), "between")
        merged = components(between, "a", "b", written)
        # nodes known before follow their root; nodes linked only now come from ``between``
        old = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = written(old.unionByName(merged.join(roots, "node", "left_anti")), "roots")
    links = reduce(DataFrame.unionByName, all_links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = classes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(smallest, "root").join(degree, "node", "left").select("node", "root", "component_id", "n_links")
    own = F.when(F.col("id") != LAST, F.col("id"))
    comp = F.coalesce("component_id", "id")
    return (signed.select("_k1", "_k2", "id", "n", "node").join(named, "node", "left")
            .select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(comp != LAST, comp).alias("component_id"), (F.col("id") == comp).alias("kept"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root", "_k1", "_k2"))


def _repeats(signed: DataFrame) -> bool:
    """Whether rows repeat both id and text, so that a row key finds several rows."""
    return not signed.groupBy("_k1", "_k2").count().filter("count > 1").isEmpty()
