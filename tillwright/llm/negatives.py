"""Operator 12: hard negatives by Hilbert-ordered blocks with zone maps.

Vectors of integers are sorted along a Hilbert curve through their widest
dimensions and cut into blocks, each a row of a Parquet table with its vectors
as one matrix and, in columns of their own, its zone map: least and largest
value of every dimension and how often each label occurs.  Interval arithmetic
on a zone map bounds the inner product of an anchor with every vector of the
block from below and above:

    sum of a_d * min_d or a_d * max_d, whichever is less (more).

Anchors are read in chunks.  A chunk meets zone maps only; a block is read for
an anchor if its interval meets a window that is still open:

* positives: the block has the anchor's label, and its upper bound reaches the
  k-th best score that the anchor's seed block has given already;
* negatives: the block has another label, its interval meets the score window of
  a positive, and its upper bound reaches the k-th best score inside that window
  of the seed block.

The bounds only leave out blocks that cannot change a result, so the result is
that of comparing every anchor with every row.  How many they leave out hangs on
the data: none where vectors have no direction in common.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; shorter vectors count as filled up with
zeros; repeated rows are rows of their own, also as each other's positives; ties
go to the smaller id; no rows give no rows; other columns are ignored.  Scores
are exact while they fit 64 bits.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.llm.common import small_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 1 << 19  # of a block's matrix, at 8 bytes a component
CHUNK = 16  # blocks whose anchors are read together
AT_ONCE = 512  # anchors scored at once
CURVE_DIMS, CURVE_BITS = 15, 4  # the curve runs through the widest dimensions, 60 bits in all
ZONE = 1024  # zone maps met at a time
PLACE_BITS, SEQ_BITS = 17, 22  # of a row in its block, of a block in its range

BLOCKS = "block long, first long, ids array<long>, labels array<long>, dims int, matrix binary, low binary, high binary, label_of array<long>, label_n array<long>"
PICKS = "block long, u long"
FOUND = "u long, w long, score long, id long, r long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (integers below 2**bits) on the Hilbert curve through its dimensions."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the largest cube to the smallest
        for i in range(n):
            upper = (x[:, i] & q) != 0
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(upper, q - 1, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[:, i] >> b & 1)
    return place


def matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[:len(v)] = v
    return out


def pack(m: np.ndarray) -> bytes:
    """Integers in the least of 2, 4 or 8 bytes that holds all, after a letter that tells."""
    most = int(np.abs(m).max()) if m.size else 0
    kind = "h" if most < 1 << 15 else "i" if most < 1 << 31 else "q"
    return kind.encode() + m.astype(kind).tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, chr(b[0]), offset=1).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers: in doubles while every partial sum is below 2**53."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if d * float(np.abs(a).max()) * float(np.abs(b).max()) < 2 ** 53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``a`` with any vector between ``low`` and ``high`` (a row a block)."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def vectors(df: DataFrame, vec_id: str, label: Column, vector: str, component) -> DataFrame:
    """``id``, ``label``, ``v`` (longs) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (df.filter(F.col(vec_id).isNotNull() & label.isNotNull() & x.isNotNull() & ~bad)
            .select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda c: component(c).cast("long")).alias("v")))


def _on_curve(rows: DataFrame) -> DataFrame:
    """``rows`` with their place on the curve; its cells follow from statistics of all rows."""
    def partial(batches):
        for pdf in batches:
            m = matrix(pdf["v"], max(map(len, pdf["v"]), default=0)).astype(float)
            if m.size:
                yield pd.DataFrame({"d": range(m.shape[1]), "n": len(m), "s": m.sum(0), "q": (m * m).sum(0), "lo": m.min(0), "hi": m.max(0)})

    each = rows.select("v").mapInPandas(partial, "d int, n long, s double, q double, lo double, hi double").groupBy("d").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spread = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2
    wide = each.orderBy(spread.desc(), "d").limit(CURVE_DIMS).collect()
    dims = [r["d"] for r in wide]
    lo, hi = np.array([r["lo"] for r in wide]), np.array([r["hi"] for r in wide])

    def place(batches):
        for pdf in batches:
            if dims:
                m = matrix(pdf["v"], max(max(dims) + 1, *map(len, pdf["v"])))[:, dims]
                cells = ((m - lo) * (1 << CURVE_BITS) / np.maximum(hi - lo + 1, 1)).astype(np.int64)
                pdf["h"] = hilbert(np.clip(cells, 0, (1 << CURVE_BITS) - 1), CURVE_BITS)
            else:
                pdf["h"] = 0
            yield pdf

    return rows.mapInPandas(place, "id long, label long, v array<long>, h long")


def _pack(batches):
    """Sorted rows -> blocks of at most BLOCK_BYTES."""
    part, seq, held = TaskContext.get().partitionId(), 0, []

    def block(rows):
        dims = max(len(v) for _, _, v in rows)
        m = matrix([v for _, _, v in rows], dims)
        labels, n = np.unique([x for _, x, _ in rows], return_counts=True)
        number = (part << SEQ_BITS) + seq
        return (number, number << PLACE_BITS, [i for i, _, _ in rows], [x for _, x, _ in rows], dims, pack(m), pack(m.min(0)), pack(m.max(0)), labels.tolist(), n.tolist())

    names = [c.split()[0] for c in BLOCKS.split(", ")]
    width = 1
    for pdf in batches:
        for row in zip(pdf["id"].tolist(), pdf["label"].tolist(), pdf["v"], strict=True):
            width = max(width, len(row[2]))
            if held and (len(held) + 1) * width * 8 > BLOCK_BYTES:
                yield pd.DataFrame([block(held)], columns=names)
                held, seq, width = [], seq + 1, max(1, len(row[2]))
            held.append(row)
    if held:
        yield pd.DataFrame([block(held)], columns=names)


def blocks(rows: DataFrame) -> DataFrame:
    """The written table of blocks of ``rows`` (``id``, ``label``, ``v``), in the curve's order inside each range of it."""
    found = written(_on_curve(rows), "curve")
    return written(found.repartitionByRange("h", "id").sortWithinPartitions("h", "id").mapInPandas(_pack, BLOCKS), "blocks")


def _anchors(table: DataFrame, every: int) -> DataFrame:
    """One row an anchor: ``u`` (its place among all rows), ``chunk``, ``a_id``, ``a_label``, ``a`` (its vector)."""
    def take(batches):
        for pdf in batches:
            out = []
            for b in pdf.itertuples():
                m = unpack(b.matrix).reshape(len(b.ids), b.dims)
                out += [(b.first + i, b.block // CHUNK, int(b.ids[i]), int(b.labels[i]), pack(m[i]))
                        for i in np.flatnonzero(np.asarray(b.ids) % every == 0).tolist()]
            yield pd.DataFrame(out, columns=["u", "chunk", "a_id", "a_label", "a"])

    return table.mapInPandas(take, "u long, chunk long, a_id long, a_label long, a binary")


def _stack(rows, name: str, dims: int | None = None) -> np.ndarray:
    found = [unpack(r[name]) for r in rows]
    return matrix(found, max([dims or 0, *map(len, found)]))


def _grid(anchors: DataFrame, zones: DataFrame, n_zones: int, choose, schema: str) -> DataFrame:
    """``choose(anchors, their matrix, zone maps, lower and upper bounds)`` for every chunk of anchors and group of zone maps."""
    chunks = anchors.groupBy("chunk").agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
    grid = chunks.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(n_zones - 1)))).join(zones.hint("merge"), "zone")

    def run(batches):
        for pdf in batches:
            for a, z in zip(pdf["anchors"], pdf["maps"], strict=True):
                low, high = _stack(z, "low"), _stack(z, "high")
                lower, upper = bounds(_stack(a, "a"), low, high)
                yield choose(a, z, lower, upper)

    return grid.select("anchors", "maps").mapInPandas(run, schema)


def _members(z, labels: np.ndarray, same: bool) -> np.ndarray:
    """Rows of the blocks with the label of each anchor (a row an anchor), or with others."""
    kinds, which = np.unique(labels, return_inverse=True)
    out = np.zeros((len(kinds), len(z)), np.int64)
    for j, r in enumerate(z):
        n = dict(zip(map(int, r["label_of"]), map(int, r["label_n"]), strict=True))
        mine = np.array([n.get(x, 0) for x in kinds.tolist()], np.int64)
        out[:, j] = mine if same else sum(n.values()) - mine
    return out[which]


def _read(table: DataFrame, picks: DataFrame, anchors: DataFrame, best) -> DataFrame:
    """``best`` of every picked (block, anchor); a block's matrix meets a chunk of anchors at a time."""
    each = (picks.join(anchors.hint("merge"), "u").groupBy("block", "chunk")
            .agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors")))
    joined = each.join(table.hint("merge").select("block", "first", "ids", "labels", "dims", "matrix"), "block")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                m = unpack(row.matrix).reshape(len(row.ids), row.dims)
                ids, labels = np.asarray(row.ids, np.int64), np.asarray(row.labels, np.int64)
                rank = np.argsort(ids, kind="stable")
                for k in range(0, len(row.anchors), AT_ONCE):
                    some = row.anchors[k:k + AT_ONCE]
                    scores = product(_stack(some, "a"), m)
                    out = []
                    for a, s in zip(some, scores, strict=True):
                        out += best(a, s[rank], ids[rank], labels[rank], row.first + rank)
                    yield pd.DataFrame(out, columns=["u", "w", "score", "id", "r"])

    return joined.mapInPandas(run, FOUND)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest, the earlier of equal ones first."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.argsort(-scores[near], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("u", "w").orderBy(F.col("score").desc(), "id", "r")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, *, every: int, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``.

    Each anchor's ``positives`` best other rows of its label; for each of them the
    ``negatives`` best rows of other labels whose score is between ``least`` and
    ``most`` per cent of the positive's.  Columns: ``anchor_id``, ``positive_id``,
    ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.
    """
    small_batches(rows.sparkSession)
    table = blocks(rows)
    anchors = written(_anchors(table, every), "anchors")
    n_zones = max(1, -(-table.count() // ZONE))
    maps = F.struct("block", "low", "high", "label_of", "label_n")
    zones = (table.select(F.pmod(F.xxhash64("block"), F.lit(n_zones)).cast("int").alias("zone"), maps.alias("m"))
             .groupBy("zone").agg(F.collect_list("m").alias("maps")))
    zones = written(zones, "zones")

    def seed(same: bool):
        def choose(a, z, lower, upper):
            n = _members(z, np.array([r["a_label"] for r in a]), same)
            upper = np.where(n > 0, upper.astype(float), -np.inf)
            at = upper.argmax(1)
            has = n[np.arange(len(a)), at] > 0
            return pd.DataFrame({"block": [z[j]["block"] for j in at], "u": [r["u"] for r in a], "bound": upper[np.arange(len(a)), at]})[has]

        return _grid(anchors, zones, n_zones, choose, f"{PICKS}, bound double").groupBy("u").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))

    def near(a, scores, ids, labels, places):
        ok = (labels == a["a_label"]) & (places != a["u"])
        at = np.flatnonzero(ok)
        return [(a["u"], 0, int(scores[i]), int(ids[i]), int(places[i])) for i in at[_top(scores[at], positives)]]

    def kth(found, k, keys, name):
        """The k-th best score of each of ``keys``, where there are as many."""
        return _ranked(found, k).filter(F.col("rank") == k).select(*keys, F.col("score").alias(name))

    # positives
    start = kth(_read(table, seed(True), anchors, near), positives, ["u"], "floor")
    open_ = written(anchors.join(start.hint("merge"), "u", "left"), "positive-floors")

    def same_label(a, z, lower, upper):
        floor = np.array([-np.inf if r["floor"] is None else r["floor"] for r in a], float)
        take = (_members(z, np.array([r["a_label"] for r in a]), True) > 0) & (upper >= floor[:, None])
        return _pairs(a, z, take)

    found = _ranked(_read(table, _grid(open_, zones, n_zones, same_label, PICKS), anchors, near), positives)
    chosen = written(found.select("u", F.col("score").alias("w"), F.col("id").alias("positive_id"), F.col("r").alias("p")), "positives")
    # negatives: one window a positive's score
    windows = chosen.groupBy("u").agg(F.sort_array(F.collect_set("w")).alias("ws"))
    asking = written(anchors.join(windows.hint("merge"), "u"), "windows")

    def within(a, scores, ids, labels, places):
        out, other = [], labels != a["a_label"]
        for w in a["ws"]:
            w = int(w)
            at = np.flatnonzero(other & (scores >= -(-least * w // 100)) & (scores <= most * w // 100))
            out += [(a["u"], w, int(scores[i]), int(ids[i]), int(places[i])) for i in at[_top(scores[at], negatives)]]
        return out

    start = kth(_read(table, seed(False), asking, within), negatives, ["u", "w"], "floor")
    floors = start.groupBy("u").agg(F.collect_list(F.struct("w", "floor")).alias("floors"))
    open_ = written(asking.join(floors.hint("merge"), "u", "left"), "negative-floors")

    def other_labels(a, z, lower, upper):
        take = np.zeros(lower.shape, bool)
        for i, r in enumerate(a):
            floor = {} if r["floors"] is None else {int(f["w"]): int(f["floor"]) for f in r["floors"]}
            for w in map(int, r["ws"]):
                from_, to = -(-least * w // 100), most * w // 100
                if from_ <= to:
                    take[i] |= (upper[i] >= max(from_, floor.get(w, from_))) & (lower[i] <= to)
        return _pairs(a, z, take & (_members(z, np.array([r["a_label"] for r in a]), False) > 0))

    hard = _ranked(_read(table, _grid(open_, zones, n_zones, other_labels, PICKS), asking, within), negatives)
    out = chosen.join(hard.select("u", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).hint("merge"), ["u", "w"])
    return (out.join(anchors.select("u", F.col("a_id").alias("anchor_id")).hint("merge"), "u")
            .select("anchor_id", "positive_id", "rank", "negative_id", F.col("w").alias("positive_score"), "negative_score"))


def _pairs(a, z, take: np.ndarray) -> pd.DataFrame:
    i, j = np.nonzero(take)
    blocks_, us = np.array([r["block"] for r in z], np.int64), np.array([r["u"] for r in a], np.int64)
    return pd.DataFrame({"block": blocks_[j], "u": us[i]})
