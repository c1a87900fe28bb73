"""Operator 7: vector bin packing of examples into training sequences.

A sequence has limits in several dimensions at once: tokens, segments
(examples in it) and loss-bearing tokens.  Bins are filled one after another
by the dot-product heuristic: of the examples that fit, the one whose demand
vector has the largest dot product with the room left (both as shares of the
limits) goes in next.  An example over a limit is cut into full pieces and a
rest; with ``cut`` a rest may be cut again to fill a bin that no whole example
fits, where more than ``slack`` of its tokens would be padding otherwise.

Each Spark task packs the examples it scans (no shuffle): rests wait in a pool
of ``POOL`` examples, which bounds a worker's memory; the last, partly filled
bin of a pool goes on into the next pool.  After every batch a worker gives back
the memory that encoding has left unused.

Defined results: a null or empty text is an example of the end id alone; null
or repeated ids are carried through as they are; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import give_back, small_batches
from tillwright.llm.encode import documents_ids

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Examples packed together by a task.
POOL = 4096
PIECES = ("doc_id string, start long, length long, ids binary, doc_tokens long, loss_tokens long, "
          "sequence_id long, offset long")


def fill_bins(items: list[tuple[int, int]], limits: tuple[int, int, int], cut: bool, slack: float):
    """Place (tokens, loss tokens) demands; yields bins as lists of (item, from, to).

    ``from`` and ``to`` are token positions in the item; a cut item has its
    loss-bearing tokens shared out by length, rounded up.  An item that is over
    a limit by itself is an error.
    """
    max_tokens, max_segments, max_loss = limits
    if max_segments < 1 or any(t > max_tokens or x > max_loss for t, x in items):
        raise ValueError("an item alone is over a limit")
    groups: dict[tuple[int, int], list] = defaultdict(list)
    for i, (tokens, loss) in enumerate(items):
        groups[tokens, loss].append((i, 0))
    kinds = np.array(sorted(groups, reverse=True), np.int64).reshape(-1, 2)
    left = [groups[k] for k in map(tuple, kinds.tolist())]
    count = np.array([len(x) for x in left], np.int64)
    demand = kinds / np.array([max_tokens, max_loss])
    n = int(count.sum())
    while n:
        room, bin_ = [max_tokens, max_segments, max_loss], []
        while room[1] > 0 and n:
            fits = (count > 0) & (kinds[:, 0] <= room[0]) & (kinds[:, 1] <= room[2])
            if fits.any():
                score = demand[:, 0] * (room[0] / max_tokens) + demand[:, 1] * (room[2] / max_loss) + room[1] / max_segments**2
                k = int(np.argmax(np.where(fits, score, -1.0)))
                i, at = left[k].pop()
                count[k] -= 1
                n -= 1
                tokens, loss = kinds[k].tolist()
                bin_.append((i, at, at + tokens))
                room = [room[0] - tokens, room[1] - 1, room[2] - loss]
                continue
            if not cut or room[0] <= slack * max_tokens:
                break
            # no whole example fits: the head of the largest one fills the bin
            k = int(np.argmax(np.where(count > 0, kinds[:, 0], -1)))
            tokens, loss = kinds[k].tolist()
            take = room[0]
            share = -(-loss * take // tokens)
            if take >= tokens or share > room[2]:
                break
            i, at = left[k].pop()
            count[k] -= 1
            bin_.append((i, at, at + take))
            rest = (tokens - take, loss - share)
            same = np.flatnonzero((kinds[:, 0] == rest[0]) & (kinds[:, 1] == rest[1]))
            if len(same):
                left[int(same[0])].append((i, at + take))
                count[int(same[0])] += 1
            else:
                kinds = np.vstack([kinds, rest])
                demand = kinds / np.array([max_tokens, max_loss])
                left.append([(i, at + take)])
                count = np.append(count, 1)
            break
        yield bin_


def pack(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int = 1024, max_segments: int = 256,
         max_loss: int | None = None, loss_from: str | None = None, cut: bool = True, slack: float = 0.01) -> DataFrame:
    """Encode documents and pack them; one row per piece.

    Columns: ``doc_id`` as text, ``start`` (ids of the document before the
    piece), ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``loss_tokens`` (of the piece), ``sequence_id``, ``offset`` (in the
    sequence).  ``loss_from`` names a column with the number of leading tokens
    that bear no loss (a prompt); without it all tokens do.
    """
    small_batches(docs.sparkSession)
    limits = (max_tokens, max_segments, max_loss or max_tokens)

    def run(batches):
        base, number = TaskContext.get().partitionId() << 33, 0
        pool: list[tuple] = []  # (doc_id, ids of the rest, start, tokens of the document, first loss position)
        out: list[tuple] = []

        def add(piece, x, y, sequence, offset):
            key, ids, start, total, quiet = piece
            loss = max(0, start + y - max(start + x, quiet))
            out.append((key, start + x, y - x, ids[x:y].tobytes(), total, loss, sequence, offset))

        def settle(last: bool):
            nonlocal pool, number
            demands = [(len(p[1]), max(0, p[2] + len(p[1]) - max(p[2], p[4]))) for p in pool]
            bins = list(fill_bins(demands, limits, cut, slack))
            keep = [] if last or not bins else bins.pop()
            for b in bins:
                offset = 0
                for i, x, y in b:
                    add(pool[i], x, y, base + number, offset)
                    offset += y - x
                number += 1
            pool = [(pool[i][0], pool[i][1][x:y], pool[i][2] + x, *pool[i][3:]) for i, x, y in keep]

        for pdf in batches:
            quiets = pdf["quiet"].fillna(0).astype("int64").tolist()
            for key, ids, quiet in zip(pdf["doc_id"].tolist(), documents_ids(pdf["text"].tolist(), tokenizer, end_id), quiets, strict=True):
                at, step = 0, min(max_tokens, limits[2])
                while len(ids) - at >= step:
                    add((key, ids, 0, len(ids), quiet), at, at + step, base + number, 0)
                    number, at = number + 1, at + step
                if at < len(ids):
                    pool.append((key, ids[at:], at, len(ids), quiet))
                if len(pool) >= POOL:
                    settle(False)
            give_back()
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
                out = []
        settle(True)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    quiet = F.col(loss_from).cast("long") if loss_from else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       quiet.alias("quiet")).mapInPandas(run, PIECES)
