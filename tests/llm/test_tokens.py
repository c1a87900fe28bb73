"""Token planes (operator 3) and vector packing (operator 7) against plain encoding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillwright.llm import packing, planes
from tillwright.llm.encode import Encoder

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "\n", "a", " a ", "a  b", "a\n\nb", "a \nb", "x<|endoftext|>y <|endoftext|>", "don't we're 'tis", "É́ é ﬁ Ωmega ς Σ",
       "a\x1cb", "a\xa0b c", "日本語 テキスト", "a\tb\r\nc", "1234 5.6 7%", "word!! | ### $$$", "İstanbul ǅ ß", "﻿bom", "end \n", "  lead",
       "a\x00b c", "😀 family 👨‍👩‍👧", "ab.cd, ef", "tail...''", "x" * 3000, "Mixed CASE Words;and:glue", "a\x0bb\x0cc", "  sep"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_ids_equal_whole_encoding(path):
    rng = random.Random(7)
    pieces = [w for t in ODD for w in (t, " ", "\n", "Ñandú, ", "the ", "of. ")]
    texts = ODD + ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(300)]
    tok = Tokenizer.from_file(path)
    flat, lens = Encoder(path).encode(texts)
    at = 0
    for text, n in zip(texts, lens.tolist(), strict=True):
        assert flat[at:at + n].tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
        at += n


@pytest.mark.parametrize("bits", [False, True])
def test_segment_round_trip(bits):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 7, 100, 8, 333)]
    keys = [None, "5", "5", "9007199254740993", "-3", "8"]
    payload = planes.pack_segment(keys, docs, block_ids=64, bits=bits)
    got, lens, ids = planes.unpack_segment(payload)
    assert got == [None if k is None else int(k) for k in keys] and lens.tolist() == [len(d) for d in docs]
    whole = np.concatenate(docs)
    assert (ids == whole).all()
    assert (planes.unpack_segment(payload, only_block=2)[2] == whole[128:192]).all()
    assert planes.unpack_segment(planes.pack_segment([], [], 64, bits))[2].tolist() == []


DOCS = [(3, "the end"), (None, "no id"), (1, None), (2, ""), (2, "twice"), (2, "twice"), (9007199254740993, "a b c " * 2000), (7, "x\ny")]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", i, "q") for i, t in rows], "doc_id long, text string, shard string, start long, ids string")


def test_planes_read_back_in_order(spark, tmp_path):
    path = str(tmp_path / "p")
    planes.write_segments(_frame(spark, DOCS), path, tokenizer=WORD, end_id=2, block_ids=100, segment_ids=500)
    got = [tuple(r)[:4] for r in planes.read_documents(spark, path).collect()]
    tok, want, at = Tokenizer.from_file(WORD), [], 0
    for i, t in sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_planes_of_an_empty_table(spark, tmp_path):
    planes.write_segments(_frame(spark, []), str(tmp_path / "e"), tokenizer=WORD, end_id=2)
    assert planes.read_documents(spark, str(tmp_path / "e")).count() == 0


def _check_pieces(rows, docs, limit):
    tok = Tokenizer.from_file(BYTE)
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, bytes(r.ids)))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= limit
    for i, t in docs:
        whole = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(by_doc[str(i)])) == whole
    total = sum(r.length for r in rows)
    return total / (len(by_seq) * limit)


def test_packing_keeps_every_id_once(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["alpha", "Beta,", "gamma.", "δ", "\n"], k=rng.choice([0, 3, 50, 300, 900])))) for i in range(300)]
    docs[5] = (5, None)
    rows = packing.pack(_frame(spark, docs).coalesce(1), BYTE, 0, max_tokens=256).collect()
    assert _check_pieces(rows, docs, 256) > 0.97
    assert packing.pack(_frame(spark, []), BYTE, 0).count() == 0
    assert len(packing.pack(_frame(spark, DOCS), BYTE, 0).collect()) >= len(DOCS)


def test_limits_of_all_dimensions_hold_without_cuts():
    rng = random.Random(5)
    items = [(t, rng.randint(0, min(t, 60))) for t in (rng.randint(1, 100) for _ in range(500))]
    seen = []
    for b in packing.fill_bins(items, (100, 4, 60), cut=False, slack=0.0):
        seen += [i for i, _, _ in b]
        assert len(b) <= 4 and sum(y - x for _, x, y in b) <= 100
        assert sum(items[i][1] for i, _, _ in b) <= 60
    assert sorted(seen) == list(range(500))
    with pytest.raises(ValueError, match="over a limit"):
        list(packing.fill_bins([(101, 0)], (100, 4, 60), cut=True, slack=0.0))


def test_packing_gives_memory_back_after_every_batch(spark, monkeypatch, tmp_path):
    """Workers of an executor share its memory: none keeps what encoding a batch has left unused."""
    calls, real = str(tmp_path / "calls"), packing.give_back

    def counted():
        real()
        with open(calls, "a") as f:
            f.write("x")

    monkeypatch.setattr(packing, "give_back", counted)
    rows = packing.pack(spark.range(4001).selectExpr("id as doc_id", "concat('word', id) as text").coalesce(1), BYTE, 0).collect()
    assert len({r["doc_id"] for r in rows}) == 4001
    with open(calls) as f:
        assert len(f.read()) == 3


def test_packing_under_a_loss_limit(spark):
    """Prompts bear no loss; the rest of each sequence stays under a limit lower than its tokens."""
    docs = [(i, "alpha beta gamma delta " * 10, 30 if i % 2 else 0) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, quiet_tokens long")
    rows = packing.pack(frame.coalesce(1), BYTE, 0, max_tokens=256, max_loss=100, loss_from="quiet_tokens").collect()
    tokens, loss = defaultdict(int), defaultdict(int)
    for r in rows:
        tokens[r.sequence_id] += r.length
        loss[r.sequence_id] += r.loss_tokens
    assert sum(tokens.values()) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    assert max(loss.values()) <= 100 < max(tokens.values()) <= 256
