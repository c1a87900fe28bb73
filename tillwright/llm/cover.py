"""Operator 4: repeated word windows, found with difference-cover anchors.

A window is ``length`` consecutive words.  Positions whose remainder by the
period ``PERIOD`` lies in the difference cover ``COVER`` are anchors: for any
two positions some shift below the period brings both onto the cover, so two
equal windows share an equal anchor of ``length - PERIOD + 1`` words at the
same place inside them.  Only anchors are hashed at first, about a quarter of
all positions; equal anchors then extend to the windows around them, and those
windows, hashed as a whole (128 bits), must be equal too.

Equal hashes are found by sorting: rows are dealt by ranges of (hash, row), so
that a passage of a third of all documents is shared by many tasks; a task
streams over neighbours, and the two rows at the edges of a range are settled
with those of the next.  The bounds of the ranges come from the rows of about
``BOUND_DOCS`` documents; any bounds give the same result, they only share out
the work.  Texts with an equal copy lose all their words if they
have a window; only one copy of them is extended.

Defined results: a null or empty text has no words and keeps none; a text of
fewer words than a window keeps all; a document is a row by id and text, rows
equal in both are copies of each other; windows of one document may match each
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import SPACE_CLASS, row_key, small_batches, written
from tillwright.llm.shingles import windows, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PERIOD = 21
COVER = (3, 6, 7, 12, 14)  # differences give every remainder by 21

SHARED, EDGE, MARK = 0, 1, 2


BOUND_DOCS, BOUND_ROWS = 2000, 20_000  # documents and rows that the bounds are found with

KEY = ("_k1", "_k2")
ORDER = ("h", "g", *KEY, "pos")


def _ranges(cols: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
    """Number of ``bounds`` (sorted) that are not above each row, columns compared in turn."""
    left, right = (np.searchsorted(bounds[0], cols[0], side) for side in ("left", "right"))
    part = right.astype(np.int32)
    hot = np.flatnonzero(left < right)  # hashes that are bounds themselves: a passage so frequent that it is cut
    if len(hot):
        both = [np.concatenate((b, c[hot])) for b, c in zip(bounds, cols, strict=True)]
        order = np.lexsort(both[::-1])  # stable: a bound before the row that equals it
        before = np.cumsum(order < len(bounds[0]))
        at = np.empty(len(order), np.int64)
        at[order] = before
        part[hot] = at[len(bounds[0]):]
    return part


def _table(cols: list[np.ndarray], bounds: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in zip(ORDER, cols, strict=True)} | {"part": pa.array(_ranges(cols, bounds))})


def _bounds(rows: DataFrame, parts: int) -> list[np.ndarray]:
    """Bounds of ``parts`` ranges of about as many of ``rows`` each, from ``BOUND_ROWS`` of them chosen by hash."""
    some = rows.select(*ORDER).orderBy(F.xxhash64(*KEY, "pos")).limit(BOUND_ROWS).collect()
    some = sorted(tuple(r) for r in some)
    cut = [some[len(some) * k // parts] for k in range(1, parts)] if some else []
    return [np.array([r[i] for r in cut], np.int64) for i in range(len(ORDER))]


def _anchors(width: int, bounds: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            hashes, counts = word_hashes(batch.column("text").cast(pa.string()), lower=False)
            every = windows(hashes, width)
            begins = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(counts)), counts)
            pos = np.arange(len(hashes)) - begins[owner]
            ok = np.isin(pos % PERIOD, COVER) & (pos + width <= counts[owner])
            at, owner, pos = np.flatnonzero(ok), owner[ok], pos[ok]
            k1, k2 = (batch.column(c).to_numpy() for c in KEY)
            yield _table([every[at].view(np.int64), np.zeros(len(at), np.int64), k1[owner], k2[owner], pos], bounds)
    return run


def _extended(length: int, bounds: list[np.ndarray]):
    """Windows that hold a shared anchor at a possible place."""
    def run(batches):
        for batch in batches:
            hashes, counts = word_hashes(batch.column("text").cast(pa.string()), lower=False)
            begins = np.cumsum(counts) - counts
            lists = batch.column("anchors")
            at = lists.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(counts)), np.diff(lists.offsets.to_numpy()))
            start = (at[:, None] - np.arange(PERIOD)[None, :]).reshape(-1)
            doc = np.repeat(doc, PERIOD)
            ok = (start >= 0) & (start + length <= counts[doc])
            place = np.unique(begins[doc[ok]] + start[ok])
            doc = np.searchsorted(begins + counts, place, side="right")
            h, g = windows(hashes, length), windows(hashes ^ np.uint64(0x5851F42D4C957F2D), length)
            k1, k2 = (batch.column(c).to_numpy() for c in KEY)
            yield _table([h[place].view(np.int64), g[place].view(np.int64), k1[doc], k2[doc], place - begins[doc]], bounds)
    return run


ROWS = "h long, g long, _k1 long, _k2 long, pos long"


def _neighbours(batches):
    """Sorted rows -> rows whose hash occurs again; at the edges of a range see ``repeated``."""
    names = ORDER
    carry, open_run, first = None, 0, True  # last row, rows of its run so far, no run has ended yet

    def table(cols, state):
        return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)} | {"state": pa.array(np.full(len(cols[0]), state), pa.int32())})

    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(n).to_numpy() for n in names]
        if carry is not None:
            cols = [np.concatenate((c, x)) for c, x in zip(carry, cols, strict=True)]
        h, g = cols[0], cols[1]
        starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
        sizes = np.diff(np.concatenate((starts, [len(h)])))
        if carry is not None:
            sizes[0] += open_run - 1  # rows of the first run seen before
        run_of = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(h)]))))
        keep = sizes[run_of] > 1
        if carry is not None and open_run > 1:
            keep[0] = False  # given out with the batch before
        if first and len(starts) > 1:
            yield table([c[:1] for c in cols], EDGE if sizes[0] == 1 else MARK)
            first = False
        if keep.any():
            yield table([c[keep] for c in cols], SHARED)
        open_run, carry = int(sizes[-1]), [c[-1:] for c in cols]
    if carry is not None:
        yield table(carry, EDGE if open_run == 1 else MARK)


def repeated(rows: DataFrame, parts: int, store) -> DataFrame:
    """``_k1``, ``_k2``, ``pos`` of the rows whose (h, g) occurs twice or more.

    A run of equal hashes inside a range is settled there.  The first and the
    last run of a range may go on in another: each gives one row, ``EDGE`` if
    it is alone in its range and ``MARK`` if not, and equal ones are counted.
    """
    found = store(rows.repartitionById(parts, "part").sortWithinPartitions(*ORDER).select(*ORDER).mapInArrow(_neighbours, ROWS + ", state int"))
    # at most two rows of a range
    edges = (found.filter(F.col("state") != SHARED).groupBy("h", "g").agg(F.collect_list(F.struct(*KEY, "pos", "state")).alias("rows"))
             .filter(F.size("rows") > 1).select(F.inline("rows")))
    return found.filter(F.col("state") == SHARED).select(*KEY, "pos").unionByName(edges.filter(F.col("state") == EDGE).select(*KEY, "pos"))


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """``doc_id`` with ``n_words``, ``n_removed`` and ``kept`` (words that stay, joined by a space)."""
    spark = docs.sparkSession
    small_batches(spark)
    width = length - PERIOD + 1
    if width < 1:
        raise ValueError(f"windows of at least {PERIOD} words are needed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema, none = ROWS + ", part int", [np.zeros(0, np.int64)] * len(ORDER)
    rows = docs.select("doc_id", *row_key(docs), F.col("text").cast("string").alias("text"))
    few = rows.sample(min(1.0, BOUND_DOCS / max(1, rows.count())), seed=3)
    bounds = _bounds(few.select(*KEY, "text").mapInArrow(_anchors(width, none), schema), parts)
    anchors = repeated(rows.select(*KEY, "text").mapInArrow(_anchors(width, bounds), schema), parts, lambda df: written(df, "anchors"))
    anchors = anchors.groupBy(*KEY).agg(F.collect_set(F.col("pos").cast("int")).alias("anchors"))

    # texts that have an equal copy: one of them, by key, is extended for all
    hashed = rows.select(*KEY, F.md5("text").alias("m")).filter("m is not null")
    copied = hashed.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*KEY)).alias("one")).filter("c > 1")
    copies = written(hashed.join(copied, "m").select(*KEY, (F.struct(*KEY) == F.col("one")).alias("one")).distinct(), "copies")
    anchors = written(anchors.join(copies.filter(~F.col("one")), list(KEY), "left_anti"), "shared-anchors")

    # both joins of the texts take the same columns, so that the texts are dealt out once
    def extended(texts: DataFrame, found: DataFrame, ends: list[np.ndarray]) -> DataFrame:
        joined = texts.join(found.hint("merge"), list(KEY)).select("doc_id", *KEY, "text", "anchors")
        return joined.mapInArrow(_extended(length, ends), schema)

    some = anchors.join(F.broadcast(few.select(*KEY).distinct().limit(2 * BOUND_DOCS)), list(KEY), "left_semi")
    bounds = _bounds(extended(few, some, none), parts)
    starts = repeated(extended(rows, anchors, bounds), parts, lambda df: df)
    gone = starts.groupBy(*KEY).agg(F.collect_set(F.col("pos").cast("int")).alias("starts"))
    gone = gone.join(copies.select(*KEY, F.lit(True).alias("whole")), list(KEY), "full")
    joined = rows.join(gone.hint("merge"), list(KEY), "left")
    return joined.select("doc_id", _removed(length)(F.coalesce("text", F.lit("")), "starts", F.coalesce("whole", F.lit(False))).alias("_r")).select(
        "doc_id", "_r.n_words", "_r.n_removed", "_r.kept")


def _removed(length: int):
    @F.pandas_udf("n_words long, n_removed long, kept string")
    def run(texts: pd.Series, starts: pd.Series, whole: pd.Series) -> pd.DataFrame:
        word = re.compile(f"[^{SPACE_CLASS}]+")
        out = []
        for text, at, copied in zip(texts, starts, whole, strict=True):
            words = word.findall(text)
            n = len(words)
            if copied and n >= length:
                words = []
            elif at is not None and len(at):
                edge = np.zeros(n + 1, np.int32)
                at = np.asarray(at, np.int64)
                edge[at] += 1
                edge[at + length] -= 1
                words = [w for w, gone in zip(words, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not gone]
            out.append((n, n - len(words), " ".join(words)))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return run
