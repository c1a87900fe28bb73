"""Operator 8: line dedup by range-partitioned line hashes.

Every line's key is hashed (128 bits); the hashes are dealt by ranges of
(hash, document) and sorted by document and position inside a range.  A task
streams over the sorted rows and, per hash, counts documents.  Ranges also cut
through the rows of one hash, so a line found in a third of all documents is
shared by many tasks.  A run of one hash that touches the edge of its range
may go on in the next: such runs report their document count, and the few rows
whose verdict hangs on it (of fewer than ``min_docs`` documents) wait for the
sum.  The result is one compressed bitmap per document of the lines that stay,
for documents that lose a line; all other documents stay whole.

A key is the line without white space (space, \\t \\n \\v \\f \\r) at its ends,
A-Z in lower case.  Keys shorter than ``min_chars`` code points stay.

Defined results: a null or empty text is one empty line; a document is a row
by id and text, so rows equal in both count once, or once each with
``each_row``, and share their result; a null id is an id of its own kind, after
the text's hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tillwright.llm.common import SPACE_CHARS, lower_ascii, row_key, small_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DROP, WAIT, MARK = 0, 1, 2
FOUND = "h binary, _k1 long, _k2 long, pos int, n_lines int, state int, part int, n_docs long"
BITMAPS = "_k1 long, _k2 long, n_lines long, n_dropped long, keep binary"


def _stream(min_docs: int):
    """Rows of a range, sorted by hash, document, position -> rows to drop (see module)."""
    def run(batches):
        part = TaskContext.get().partitionId()
        held, docs, now, doc, first = [], 0, None, None, True
        out: list[tuple] = []

        def close(edge: bool):
            """The run of ``now`` is over; at an edge it may go on elsewhere."""
            if now is None or not edge:
                return
            if docs < min_docs:
                out.extend((now, *r, WAIT, part, docs) for r in held)
            else:
                out.append((now, 0, 0, 0, 0, MARK, part, docs))  # no row; a null would turn the keys beside it into floats

        def table():
            return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

        for pdf in batches:
            for h, k1, k2, row, pos, n in zip(*(pdf[c].tolist() for c in ("h", "_k1", "_k2", "row", "pos", "n_lines")), strict=True):
                if h != now:
                    close(first)
                    first = first and now is None
                    held, docs, now, doc = [], 0, h, None
                if (k1, k2, row) != doc:
                    doc, docs = (k1, k2, row), docs + 1
                    if docs == min_docs:
                        out.extend((h, *r, DROP, part, 0) for r in held)
                        held = []
                if docs >= min_docs:
                    out.append((h, k1, k2, pos, n, DROP, part, 0))
                else:
                    held.append((k1, k2, pos, n))
            if out:
                yield table()
                out = []
        close(True)
        if out:
            yield table()

    return run


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, each_row: bool = False) -> DataFrame:
    """Bitmaps of the lines that stay, for documents that lose some; with ``each_row`` every row is a document.

    Columns: the row key ``_k1``, ``_k2`` (see ``common.row_key``),
    ``n_lines``, ``n_dropped``, ``keep`` (zlib; bit i, from the lowest, is line
    i).  ``with_bitmaps`` joins them to documents.
    """
    small_batches(docs.sparkSession)
    # a row's number tells equal rows apart; it holds for this one pass, whose lines are written
    row = F.monotonically_increasing_id() if each_row else F.lit(0).cast("long")
    lines = (docs.select(*row_key(docs), row.alias("row"), F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1).alias("lines"))
             .select("_k1", "_k2", "row", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
             .withColumn("key", lower_ascii(F.btrim("line", F.lit(SPACE_CHARS))))
             .filter(F.length("key") >= max(1, min_chars))
             .select(F.unhex(F.md5("key")).alias("h"), "_k1", "_k2", "row", "pos", "n_lines"))
    # written once: the bounds of the ranges are found by reading the hashes, not the texts, again
    lines = written(lines, "hashed-lines")
    order = ["h", "_k1", "_k2", "row"]
    found = written(lines.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
                    .mapInPandas(_stream(min_docs), FOUND), "lines")
    edge = (found.filter(F.col("state") != DROP).groupBy("h", "part").agg(F.max("n_docs").alias("n"))
            .groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("h"))
    drops = (found.filter(F.col("state") == DROP).select("_k1", "_k2", "pos", "n_lines")
             .unionByName(found.filter(F.col("state") == WAIT).join(edge, "h", "left_semi").select("_k1", "_k2", "pos", "n_lines")))
    each = drops.groupBy("_k1", "_k2").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def bitmaps(batches):
        for pdf in batches:
            keep = []
            for n, gone in zip(pdf["n_lines"].tolist(), pdf["gone"], strict=True):
                stay = np.ones(n, np.uint8)
                stay[np.asarray(gone, np.int64)] = 0
                keep.append(zlib.compress(np.packbits(stay, bitorder="little").tobytes()))
            yield pd.DataFrame({"_k1": pdf["_k1"], "_k2": pdf["_k2"], "n_lines": pdf["n_lines"], "n_dropped": [len(g) for g in pdf["gone"]], "keep": keep})

    return each.mapInPandas(bitmaps, BITMAPS)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``carried``, ``n_lines``, ``n_dropped`` and ``kept`` (the lines that stay, joined)."""
    lost = bitmaps.select("_k1", "_k2", "n_dropped", "keep")
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), *row_key(docs), F.struct(F.lit(0), *carried).alias("_c"))
    joined = plain.join(lost.hint("merge"), ["_k1", "_k2"], "left")  # the same plan at every size
    kept = F.when(F.col("keep").isNull(), F.col("_text")).otherwise(_apply(F.col("_text"), F.col("keep")))
    n = F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"), F.lit(""))) + 1
    return joined.select("doc_id", *(F.col(f"_c.`{c}`") for c in carried), n.cast("long").alias("n_lines"),
                         F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept"))


@F.pandas_udf(StringType())
def _apply(texts: pd.Series, keeps: pd.Series) -> pd.Series:
    out = []
    for text, keep in zip(texts, keeps, strict=True):
        if keep is None:
            out.append(text)
            continue
        lines = text.split("\n")
        stay = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
        out.append("\n".join([x for x, s in zip(lines, stay.tolist(), strict=True) if s]))
    return pd.Series(out, dtype=object)
