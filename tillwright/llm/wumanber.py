"""Operator 5: benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the windows of the test items, over words instead of characters:
``window`` consecutive words of an item, or all words of a shorter item.  For
each pattern length a shift table over two-word blocks tells how far the
search may jump, so most positions of a text are never looked at; where the
shift is zero, the patterns whose last block has the same hash are compared
word by word.  Many stretches of a batch of texts are searched in step, as
arrays.

The patterns are dealt into blocks of bounded size (``BLOCK_WORDS`` words of
items, checked by a count); each block is sent to the executors and the texts
pass over one block after another, without a shuffle.

Defined results: a null or empty text, or one without words, has no words and
no hits; an item without words is never found; items that repeat an id count
once, a null item id counts as the text ``null``; an empty table of items
finds nothing; other columns are ignored.
"""

from __future__ import annotations

import pickle
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import lower_ascii, small_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words of items in one block of patterns, about 100 MB of tables.
BLOCK_WORDS = 1_000_000
# Positions of a stretch that is searched in step with the others.
STRETCH = 256
# Characters between words: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Patterns:
    """Windows of equal length with their shift table and suffix buckets."""

    def __init__(self, windows: dict[tuple, set], length: int):
        self.length, self.block = length, min(2, length)
        self.words = np.array(list(windows), np.int64).reshape(-1, length)
        self.items = list(windows.values())
        self.bits = max(10, int(len(windows) * length * 4).bit_length())
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int64)
        for end in range(self.block - 1, length):
            at = self.hashed(self.words[:, end - self.block + 1], self.words[:, end])
            np.minimum.at(self.shift, at, length - 1 - end)
        suffix = self.hashed(self.words[:, length - self.block], self.words[:, length - 1])
        order = np.argsort(suffix, kind="stable")
        self.words, self.items = self.words[order], [self.items[i] for i in order]
        self.bucket = np.searchsorted(suffix[order], np.arange((1 << self.bits) + 1))

    def hashed(self, x, y):
        mixed = (x if self.block == 2 else 0) * 1_000_003 + y
        return ((mixed * 0x9E3779B1) & 0xFFFFFFFF) * 0x85EBCA6B >> 7 & ((1 << self.bits) - 1)

    def ends(self, text: np.ndarray) -> np.ndarray:
        """Positions whose block has shift zero, found by jumping."""
        starts = np.arange(0, len(text), STRETCH)
        stop = np.minimum(starts + STRETCH, len(text))
        at = np.maximum(starts, self.length - 1)
        found = []
        while True:
            on = at < stop
            at, stop = at[on], stop[on]
            if not len(at):
                break
            shift = self.shift[self.hashed(text[at - 1] if self.block == 2 else 0, text[at])]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def matches(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first position, pattern) of every occurrence."""
        out = []
        every = self.ends(text)
        for k in range(0, len(every), 50_000):
            end = every[k:k + 50_000]
            h = self.hashed(text[end - 1] if self.block == 2 else 0, text[end])
            lo, n = self.bucket[h], self.bucket[h + 1] - self.bucket[h]
            first = np.repeat(end - self.length + 1, n)
            which = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            for j in range(self.length):  # compare directly, dropping what differs
                same = text[first + j] == self.words[which, j]
                first, which = first[same], which[same]
            out.append((first, which))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def compiled(items: list[tuple[str, list[str]]], window: int) -> tuple[list[str], list[Patterns]]:
    """Vocabulary and patterns of the items of one block."""
    vocabulary: dict[str, int] = {}
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, words in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        m = min(window, len(ids))
        for i in range(len(ids) - m + 1 if m else 0):
            by_length[m][tuple(ids[i:i + m])].add(item)
    return list(vocabulary), [Patterns(dict(w), m) for m, w in sorted(by_length.items())]


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another, and the number of words of each."""
    clean = pc.ascii_trim(pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN, " "), " ")
    lists = pc.split_pattern(clean, " ")
    counts = np.where(pc.equal(clean, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy())
    words = lists.flatten()
    return words.filter(pc.not_equal(words, "")), counts.astype(np.int64)


def search(texts: pa.Array, vocabulary: pa.Array, patterns: list[Patterns]):
    """Per text: number of words, flat word spans [from, to, ...) that are hit, item ids."""
    words, counts = text_words(texts)
    coded = words.dictionary_encode()
    known = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy().astype(np.int64) + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    text = np.full(len(words) + len(counts), -1, np.int64)  # -1 after each text parts it from the next
    place = np.arange(len(words)) + owner
    text[place] = known[coded.indices.to_numpy()] if len(words) else known[:0]
    ends = np.cumsum(counts + 1)
    begins = ends - counts - 1
    edge, items = np.zeros(len(text) + 1, np.int64), defaultdict(set)
    for p in patterns:
        first, which = p.matches(text)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + p.length, -1)
        docs = np.searchsorted(ends, first, side="right")
        for d, w in set(zip(docs.tolist(), which.tolist(), strict=True)):
            items[d] |= p.items[w]
    hit = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).view(np.int8), [0]))
    turn = np.flatnonzero(np.diff(hit)).reshape(-1, 2)
    whose = np.searchsorted(ends, turn[:, 0], side="right")
    spans = (turn - begins[whose][:, None]).reshape(-1)
    per_text = np.bincount(whose, minlength=len(counts)) * 2
    return counts, np.concatenate(([0], np.cumsum(per_text))), spans, [sorted(items[i]) if i in items else [] for i in range(len(counts))]


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for x, y in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += [x, y]
    return out


def dealt(listed: DataFrame, block_words: int) -> tuple[int, list[list[int]]]:
    """A modulus of the hash ``h``, and its residues in blocks of at most ``block_words`` words (or one row)."""
    total = listed.agg(F.sum(F.size("words"))).first()[0] or 0
    modulus = 1 if total <= block_words else 16 * -(-total // block_words)
    while True:
        sizes = listed.groupBy(F.pmod("h", F.lit(modulus)).alias("r")).agg(F.sum(F.size("words")).alias("n"), F.count(F.lit(1)).alias("c"))
        if modulus >= 2**60 or sizes.filter((F.col("n") > block_words) & (F.col("c") > 1)).isEmpty():
            break
        modulus *= 4
    blocks, room = [], 0
    for r, n in sorted((x.r, x.n) for x in sizes.collect()):
        if not blocks or n > room:
            blocks.append([])
            room = block_words
        blocks[-1].append(r)
        room -= n
    return modulus, blocks or [[0]]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS,
                  item_id: str = "item_id", keep: list[str] = ()) -> DataFrame:
    """Occurrences of item windows in documents.

    Returns ``doc_id``, the columns ``keep``, ``n_words``, ``spans`` (flat word
    positions [from, to, from, to ...) that are hit) and ``items`` (ids as
    text, sorted).
    """
    spark = docs.sparkSession
    small_batches(spark)
    words = F.expr(r"regexp_extract_all(_text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)")
    listed = (items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), lower_ascii(F.col("text")).alias("_text"))
              .select("item", words.alias("words")).filter(F.size("words") > 0))
    # a text over the bound in pieces that hold every window between them
    step = max(1, block_words - window + 1)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step)), lambda at: F.slice("words", at + 1, step + window - 1))
    listed = written(listed.select("item", F.explode(F.when(F.size("words") > block_words, pieces).otherwise(F.array("words"))).alias("words"))
                     .distinct().withColumn("h", F.xxhash64("item", "words")), "items")
    modulus, blocks = dealt(listed, block_words)
    n_blocks = len(blocks)

    out = docs.select("doc_id", *keep, F.col("text").alias("_text"), F.lit(None).cast("array<long>").alias("spans"),
                      F.lit(None).cast("array<string>").alias("items"))
    id_type = out.select("doc_id", *keep).schema
    for b in range(n_blocks):
        block = listed.filter(F.pmod("h", F.lit(modulus)).isin(blocks[b]))
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(compiled([(r.item, r.words) for r in block.collect()], window)))
        last = b == n_blocks - 1
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in id_type] + (["n_words long"] if last else ["_text string"])
        out = out.mapInArrow(_searcher(sent, last, [f.name for f in id_type]), ", ".join([*fields, "spans array<long>", "items array<string>"]))
    return out


def _searcher(sent, last: bool, carried: list[str]):
    def run(batches):
        vocabulary, patterns = pickle.loads(sent.value)
        vocabulary = pa.array(vocabulary, pa.string())
        for batch in batches:
            texts = batch.column("_text").cast(pa.string())
            counts, bounds, spans, items = search(texts, vocabulary, patterns)
            if batch.column("spans").null_count < len(batch):
                lists = [spans[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                both = [_merged(a or [], b) for a, b in zip(batch.column("spans").to_pylist(), lists, strict=True)]
                spans_out = pa.array(both, pa.list_(pa.int64()))
                items = [sorted({*(a or []), *b}) for a, b in zip(batch.column("items").to_pylist(), items, strict=True)]
            else:
                spans_out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(spans, pa.int64()))
            middle = {"n_words": pa.array(counts, pa.int64())} if last else {"_text": texts}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in carried} | middle
                                             | {"spans": spans_out, "items": pa.array(items, pa.list_(pa.string()))})
    return run
