"""Operator 3: token ids in a binary format of compressed bit or byte planes.

A *segment* holds the ids of consecutive documents.  Its ids are cut into
blocks of a fixed number of ids; a block is transposed into planes (plane p of
a byte shuffle holds byte p of every id, plane p of a bit shuffle bit p), each
plane is compressed with zstandard, and the segment's head stores the index of
all planes of all blocks, so that any block can be read alone.  Segments are
rows of a Parquet table (one binary column beside their numbers), so Spark's
committed writers place them on any file system and a lost task is rewritten.

Layout of a segment, little-endian: 4 bytes magic, u32 ids per block, u32
planes per block, u64 ids, u64 documents, u64 blocks; then zstandard frames,
each after a u64 length: document ids (i64), null marks (u8), document lengths
(u64); then the index (u64 end of every plane of every block); then the planes.

Defined results: a null or empty text has only the end id; a null ``doc_id``
sorts first; rows that repeat an id are kept, ordered by a hash of their text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import sys
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwright.llm.common import small_batches
from tillwright.llm.encode import documents_ids

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"TPL1"
HEAD = "<4sIIQQQ"
BLOCK_IDS = 65_536
SEGMENT_IDS = 1_000_000
SEGMENTS = "shard int, segment int, n_docs long, n_ids long, payload binary"


def split_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, from the lowest byte or bit."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, p]).tobytes() for p in range(4)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, p], bitorder="little").tobytes() for p in range(32)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its planes."""
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(each, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def pack_segment(doc_ids: list, docs: list[np.ndarray], block_ids: int, bits: bool) -> bytes:
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=3).compress
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    heads = [zip_(np.array([0 if pd.isna(d) else int(d) for d in doc_ids], "<i8").tobytes()),
             zip_(np.array([pd.isna(d) for d in doc_ids], np.uint8).tobytes()),
             zip_(np.array([len(d) for d in docs], "<u8").tobytes())]
    n_planes, planes = 32 if bits else 4, []
    blocks = range(0, len(ids), block_ids)
    for at in blocks:
        planes += map(zip_, split_planes(ids[at:at + block_ids], bits))
    index = np.cumsum([len(p) for p in planes], dtype="<u8").tobytes()
    return b"".join([struct.pack(HEAD, MAGIC, block_ids, n_planes, len(ids), len(docs), len(blocks)),
                     *(x for h in heads for x in (struct.pack("<Q", len(h)), h)), index, *planes])


def unpack_segment(payload: bytes, only_block: int | None = None):
    """(document ids, their lengths, ids); with ``only_block`` the ids of that block alone."""
    import zstandard

    unzip = zstandard.ZstdDecompressor().decompress
    magic, block_ids, n_planes, n_ids, n_docs, n_blocks = struct.unpack_from(HEAD, payload)
    if magic != MAGIC:
        raise ValueError("not a segment of token planes")
    at, heads = struct.calcsize(HEAD), []
    for kind in ("<i8", np.uint8, "<u8"):
        (n,) = struct.unpack_from("<Q", payload, at)
        heads.append(np.frombuffer(unzip(payload[at + 8:at + 8 + n]), kind))
        at += 8 + n
    index = np.concatenate(([0], np.frombuffer(payload, "<u8", n_planes * n_blocks, at))).astype(np.int64)
    at += 8 * n_planes * n_blocks
    out = []
    for b in range(n_blocks) if only_block is None else [only_block]:
        ends = index[b * n_planes:(b + 1) * n_planes + 1] + at
        planes = [unzip(payload[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        out.append(join_planes(planes, min(block_ids, n_ids - b * block_ids)))
    doc_ids = [None if no else d for d, no in zip(heads[0].tolist(), heads[1].tolist(), strict=True)]
    return doc_ids, heads[2].astype(np.int64), np.concatenate(out) if out else np.zeros(0, np.uint32)


def segments(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS,
             segment_ids: int = SEGMENT_IDS, bits: bool = False) -> DataFrame:
    """Encode documents in ascending ``doc_id`` order into segments (see module).

    Documents are dealt by ranges of ``doc_id`` and sorted inside a range;
    ``shard`` numbers the ranges and ``segment`` the segments of a range, both
    in the order of ids.  A worker holds one segment and one batch of texts.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        shard, number = TaskContext.get().partitionId(), 0
        keys, arrays, size = [], [], 0

        def flush():
            nonlocal keys, arrays, size, number
            row = (shard, number, len(keys), size, pack_segment(keys, arrays, block_ids, bits))
            keys, arrays, size, number = [], [], 0, number + 1
            return pd.DataFrame([row], columns=["shard", "segment", "n_docs", "n_ids", "payload"])

        for pdf in batches:
            for key, ids in zip(pdf["doc_id"].tolist(), documents_ids(pdf["text"].tolist(), tokenizer, end_id), strict=True):
                keys.append(key)
                arrays.append(ids)
                size += len(ids)
                if size >= segment_ids:
                    yield flush()
        if keys:
            yield flush()

    # rows that share an id (all without one, say) are ranges of their own: by text, then by where they were read
    order = [F.col("doc_id").asc_nulls_first(), "_h", "_p"]
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .withColumns({"_h": F.xxhash64("text"), "_p": F.spark_partition_id()})
            .repartitionByRange(*order).sortWithinPartitions(*order)
            .select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # exact where pandas would make floats of nulls
            .mapInPandas(run, SEGMENTS))


def write_segments(docs: DataFrame, path: str, **options) -> None:
    """Write the segments of ``docs`` as a table at ``path`` (planes are compressed already)."""
    segments(docs, **options).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Read segments back: one row per document with its place and a CRC of its ids.

    ``start`` counts the ids of all documents before it in the whole table:
    the shards' totals (one row a shard) and the segments before it in its own
    shard are added to its place in its segment.
    """
    table = spark.read.schema(SEGMENTS).parquet(path)

    def run(batches):
        for pdf in batches:
            for shard, segment, payload in zip(pdf["shard"], pdf["segment"], pdf["payload"], strict=True):
                doc_ids, lens, ids = unpack_segment(payload)
                ends = np.cumsum(lens)
                begins = ends - lens
                yield pd.DataFrame({
                    "shard": shard, "segment": segment, "doc_id": pd.array(doc_ids, "Int64"), "at": begins, "n_tokens": lens,
                    "ids_crc32": [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]})

    docs = table.select("shard", "segment", "payload").mapInPandas(
        run, "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    places = (table.select("shard", "segment", "n_ids").withColumn("inside", inside)
              .join(before, "shard").select("shard", "segment", (F.col("inside") + F.col("before")).alias("from")))
    return docs.join(places, ["shard", "segment"]).select(
        "doc_id", (F.col("from") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment")
