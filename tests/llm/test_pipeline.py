"""The corpus pipeline and the registered queries on the smallest tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tillwright.llm import queries
from tillwright.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_drop(spark):
    docs = table(spark, SF, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == ids and all(0 < r.length <= 1024 for r in packed)


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_near_dedup_keeps_one_row_of_a_group(spark):
    """Repeated ids, rows loaded twice and groups without ids; texts without words are alone."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, a + " end"), (2, a), (None, b), (None, b), (None, b + " end"), (5, c), (None, c), (7, "alone"), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert len(got) == 6 and sorted(str(i) for i, _ in got) == ["1", "5", "7", "8", "8", "None"]
    assert {i: t[0] for i, t in got if t} == {1: "a", None: "b", 5: "c", 7: "a"}


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def good(text):
    """Stage 1, rule by rule."""
    text, w = text or "", words(text)
    windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    again = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars, n = sum(map(len, w)), len(w)
    return not (n < 50 or 100 * len(again) > 50 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n or 10 * (len(lines) - len(set(lines))) > 3 * len(lines)
                or chars < 2 * n or chars > 20 * n or 10 * len(re.findall("[A-Z]", text)) > 4 * chars or 10 * text.count("!") > 3 * n)


def without_frequent_lines(docs):
    key = lambda x: x.strip(SPACES).translate(LOWER)
    seen = defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            seen[key(x)].add(i)
    return [(i, "\n".join(x for x in t.split("\n") if not key(x) or len(seen[key(x)]) < 10)) for i, t in docs]


def one_of_each(docs):
    sets = {}
    for i, t in docs:
        w = words(t.translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [(i, t) for i, t in docs if top(i) == i]


def without_items(docs, items):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for t in items:
        w = tokens(t)
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    return [(i, t) for i, t in docs if not any(tuple(w[k:k + n]) in windows for w in [tokens(t)] for n in sizes for k in range(len(w) - n + 1))]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(12)
    text = lambda n, p="w": " ".join(f"{p}{rng.randrange(100_000)}" for _ in range(n))
    rows = [(i, text(rng.choice([60, 90, 300]))) for i in range(60)]
    rows += [(100 + i, f"{text(70)}\n Subscribe NOW to our letter\t\n{text(20)}") for i in range(12)] + [(112, text(60) + "\nsubscribe now to our letter")]
    rows += [(120 + i, f"{text(70)}\nonly nine have this line") for i in range(9)]
    base = text(200).split(" ")
    for i in range(15):
        near = list(base)
        near[rng.randrange(200)] = f"n{i}"
        rows.append((200 + i, " ".join(near)))
    rows += [(230 + i, " ".join(base)) for i in range(5)]
    items = [text(25, "q"), text(4, "short"), "", None, "??"]
    rows += [(300, f"{text(60)} {' '.join(items[0].split(' ')[5:15]).upper()}. {text(30)}"), (301, f"{text(60)} {' '.join(items[0].split(' ')[5:14])} {text(30)}"), (302, f"{text(80)} {items[1]}, {text(5)}")]
    rows += [(400, None), (401, ""), (402, "few words"), (403, text(30) + " # $ % " * 30), (404, ("same three words " * 60)), (405, "!" * 40 + text(60)), (406, text(60, "ABCDEFGHIJ")),
             (407, "\n".join(["one line here"] * 30 + [text(60)])), (408, " ".join("x" * 30 + str(k) for k in range(60))), (409, text(20_000))]
    rng.shuffle(rows)
    return rows, items


def frames(spark, path, rows, items):
    # extra columns whose names clash with those of the stages
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", 2) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long, spans int, root string, n_words long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, t, 3) for k, t in enumerate(items)], "item_id long, text string, n int").write.parquet(f"{path}/benchmark.parquet")


def test_run_equals_plain_python(spark, tmp_path, planted):
    rows, items = planted
    frames(spark, tmp_path, rows, items)
    docs = [(i, t) for i, t in rows if good(t)]
    assert {i for i, _ in docs} & {400, 401, 402, 403, 404, 405, 406, 407, 408} == set() and 409 in dict(docs)
    stages = [docs]
    stages.append(without_frequent_lines(stages[-1]))
    stages.append(one_of_each(stages[-1]))
    stages.append(without_items(stages[-1], items))
    assert len(stages[2]) == len(stages[1]) - 19 and len(stages[3]) == len(stages[2]) - 2
    # stage by stage, each on the whole result of the one before
    frame = table(spark, str(tmp_path), "documents")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], stages, strict=True):
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == list(corpus_pipeline.COLUMNS), name
        assert sorted((r.doc_id, r.text, r.n_chars) for r in frame.collect()) == sorted((i, t, len(t)) for i, t in want), name
    pieces = defaultdict(list)
    slots = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
        slots[r.sequence_id].append((r.offset, r.length))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(pieces) == {i for i, _ in stages[-1]}
    for i, t in stages[-1]:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for parts in slots.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_on_nothing(spark, tmp_path):
    frames(spark, tmp_path, [(1, None), (None, "")], [None])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    empty = table(spark, str(tmp_path), "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name
