"""Word shingles of a batch of texts as sorted 64-bit hashes (numpy arrays)."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of other than ASCII white space), and words per text."""
    texts = pc.fill_null(texts, "")
    clean = pc.ascii_trim(pc.replace_substring_regex(pc.ascii_lower(texts) if lower else texts, r"[\x09-\x0D\x20]+", " "), " ")
    lists = pc.split_pattern(clean, " ")
    counts = np.where(pc.equal(clean, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy()).astype(np.int64)
    words = lists.flatten()
    coded = words.filter(pc.not_equal(words, "")).dictionary_encode()
    uniq = np.array(coded.dictionary.to_pylist(), dtype=object)
    hashed = pd.util.hash_array(uniq, categorize=False) if len(uniq) else np.zeros(0, np.uint64)
    return hashed[coded.indices.to_numpy()] if len(uniq) else hashed, counts


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of every ``width`` neighbours (across texts too)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * MIX[0] + mixed(hashes[j:j + n] + np.uint64(j))
    return mixed(out)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, and their number.

    A text of fewer words is one shingle, a text without words has none.
    """
    hashes, counts = word_hashes(texts, lower=True)
    begins = np.cumsum(counts) - counts
    spans = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), spans)
    place = np.arange(len(owner)) + np.repeat(begins - (np.cumsum(spans) - spans), spans)
    every = windows(hashes, width)
    values = np.zeros(len(owner), np.uint64)
    full = counts[owner] >= width
    values[full] = every[place[full]]
    for t in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        values[owner == t] = windows(hashes[begins[t]:begins[t] + counts[t]], int(counts[t])) ^ np.uint64(counts[t])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return values[new], np.bincount(owner[new], minlength=len(counts)).astype(np.int64)
