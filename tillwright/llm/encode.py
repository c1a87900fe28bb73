"""Texts to token ids with a public tokenizer, encoding each distinct word once.

The ids are those of ``tokenizers`` on the whole text with
``add_special_tokens=False``.  Speed is gained by cutting a text only where
the tokenizer itself always cuts (at ASCII white space between two visible
characters), by finding the distinct pieces of a batch with Arrow, and by
remembering the ids of words in the Python worker.  Texts with unusual white
space or control characters are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from tillwright.llm.common import worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words remembered by a worker before it starts anew: about 150 MB.
CACHE_WORDS = 700_000

# White space and control characters on which regex engines differ.
_ODD = r"[\x00\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
_RUN = r"[ \t\r\n]{2}|[\t\r]"
# A word of Latin-1 letters with trailing punctuation: two pre-tokens at most.
_SIMPLE = r"^(?P<word> ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<tail>[.,;:!?%$#*&|]*)$"


class Lists:
    """Id lists one after another; list n is ``flat[ends[n]:ends[n + 1]]``."""

    def __init__(self):
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)  # list 0 is empty

    def __len__(self):
        return len(self.ends) - 1

    def extend(self, flat: np.ndarray, lens: np.ndarray) -> None:
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lens)))
        self.flat = np.concatenate((self.flat, flat.astype(np.uint32)))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.ends[which]
        lens = self.ends[which + 1] - begin
        upto = np.cumsum(lens)
        if not len(upto) or not upto[-1]:
            return np.zeros(0, np.uint32), lens
        index = np.repeat(begin - (upto - lens), lens)
        index += np.arange(upto[-1])
        return self.flat[index], lens


class Encoder:
    """``encode(texts)`` -> (all ids one after another, ids per text)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        # Two families split at white space in a way known here; any other
        # tokenizer encodes whole texts.
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.kind = "byte"
        elif (norm or {}).get("type") == "Sequence" and [x["type"] for x in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"] \
                and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            self.kind = "word"
        else:
            self.kind = "whole"
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        chars = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x100)]]
        self.bytes_of = {ord(c): level.pre_tokenize_str(c)[0][0] for c in chars}
        # the same model on pre-tokens that are given, one a line
        self.lines = Tokenizer(self.tok.model)
        self.lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.close = level.pre_tokenize_str("\n")[0][0]
        (self.close_id,) = self.lines.encode(self.close, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.words, self.number = Lists(), {"": 0}

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """Numbers of the id lists of pre-tokens; new ones are encoded."""
        new = [p for p in parts if p not in self.number]
        for at in range(0, len(new), 50_000):
            some = new[at:at + 50_000]
            mapped = "\n".join(some).translate(self.bytes_of).split("\n")
            # a line break's byte, which no word holds, closes each word
            blocks = [mapped[i:i + 200] for i in range(0, len(mapped), 200)]
            closed = ["".join(f"{w}\n{self.close}\n" for w in b) for b in blocks]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.lines.encode_batch_fast(closed, add_special_tokens=False)])
            ends = np.flatnonzero(flat == self.close_id)
            flat, lens = flat[flat != self.close_id], np.diff(np.concatenate(([-1], ends))) - 1
            self.number.update(zip(some, range(len(self.words), len(self.words) + len(some)), strict=True))
            self.words.extend(flat, lens)
        return np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        if self.kind == "word":
            return pc.ascii_split_whitespace(texts)
        run = pc.match_substring_regex(texts, _RUN)
        cut = pc.replace_substring(pc.replace_substring(texts, "\n", "\x00\n\x00"), " ", "\x00 ")
        if pc.any(run).as_py():
            # only boundaries "visible, one space, visible" are sure here
            some = [re.sub(r"(?<=\S) (?=\S)", "\x00 ", t) for t in texts.filter(run).to_pylist()]
            cut = pc.replace_with_mask(cut, run, pa.array(some, pa.string()))
        return pc.split_pattern(cut, "\x00")

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > CACHE_WORDS:
            self.clear()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = np.ones(len(texts), bool) if self.kind == "whole" else pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(whole)
        kept = texts if not len(odd) else pc.replace_with_mask(texts, pa.array(whole), pa.array(["a"] * len(odd), pa.string()))
        lists = self._pieces(kept)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        uniq, which = coded.dictionary, coded.indices.to_numpy().astype(np.int64)

        # the ids of the distinct pieces: word and tail, or encoded alone
        found = pc.extract_regex(uniq, _SIMPLE)
        simple = pc.is_valid(found).to_numpy(zero_copy_only=False)
        numbers = np.zeros((len(uniq), 2), np.int64)
        pairs = found.filter(pa.array(simple))
        for c, name in enumerate(("word", "tail")):
            part = pc.struct_field(pairs, name)
            part = (pc.utf8_lower(part) if self.kind == "word" and name == "word" else part).dictionary_encode()
            numbers[simple, c] = self._numbers(part.dictionary.to_pylist())[part.indices.to_numpy()]
        local = Lists()
        flat, lens = self.words.take(numbers.reshape(-1))
        local.extend(flat, lens.reshape(-1, 2).sum(1))
        slot = np.arange(1, len(uniq) + 1)
        rest = [*uniq.filter(pa.array(~simple)).to_pylist(), *texts.take(pa.array(odd)).to_pylist()]
        alone = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
        slot[~simple] = np.arange(len(local), len(local) + int((~simple).sum()))
        odd_slots = np.arange(len(local) + int((~simple).sum()), len(local) + len(rest))
        local.extend(np.concatenate(alone) if alone else np.zeros(0, np.uint32), np.array([len(a) for a in alone], np.int64))
        which = slot[which]
        which[bounds[odd]] = odd_slots
        flat, lens = local.take(which)
        return flat, np.diff(np.concatenate(([0], np.cumsum(lens)))[bounds])


def encoder(path: str) -> Encoder:
    """The worker's encoder for one tokenizer file."""
    return worker_state(f"encoder:{path}", lambda: Encoder(path))


def documents_ids(texts, path: str, end_id: int | None) -> list[np.ndarray]:
    """Ids of each text (null: empty), with ``end_id`` after it."""
    flat, lens = encoder(path).encode(texts)
    at, out = 0, []
    for n in lens.tolist():
        one = flat[at:at + n]
        out.append(one if end_id is None else np.append(one, np.uint32(end_id)))
        at += n
    return out
