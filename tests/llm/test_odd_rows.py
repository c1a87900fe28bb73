"""Rows that once ended a query: null scopes, colliding keys, long hosts, words that always occur together."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from tillwright.llm import cover, queries, quotes, urls


def test_null_conversations(spark, tmp_path):
    rows = [(None, 0, "user", "hello there"), (None, 1, "user", "good day"), (5, 0, "user", "hello there"), (5, 1, "bot", "and you"), (6, 0, "user", None), (6, None, "user", "x")]
    spark.createDataFrame([(*r, 1, "h", 2) for r in rows], "conv_id long, turn long, role string, text string, scope int, key string, level int").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op2_quotation_linking(spark, str(tmp_path))
    assert found.schema["conv_id"].dataType.simpleString() == "bigint"
    assert Counter((r.conv_id, r.turn, r.parent_turn, r.root_turn) for r in found.collect()) == Counter(
        [(None, 0, None, 0), (None, 1, None, 1), (5, 0, None, 0), (5, 1, 0, 0), (6, 0, None, 0), (6, None, None, None)])


def test_null_scope_is_one_scope(spark):
    rows = [(None, 1, "one line\nand more"), (None, 2, "> one line\n> and more\nyes"), ("", 1, "one line\nand more"), ("", 2, "> one line\n> and more"), ("=", 3, "> one line\n> and more")]
    found = {(r.scope, r.message_id): (r.parent, r.root, r.depth) for r in quotes.linked(spark.createDataFrame(rows, "scope string, message_id long, text string")).collect()}
    assert found == {(None, 1): (None, 1, 0), (None, 2): (1, 1, 1), ("", 1): (None, 1, 0), ("", 2): (1, 1, 1), ("=", 3): (None, 3, 0)}


def test_conversations_read_in_reply_order(spark):
    rows = [(1, 1, "first"), (1, 2, "apart"), (1, 3, "> first\nanswer"), (1, 4, "> > first\n> answer\nlast"), (1, 5, "> apart\nmore"), (2, 1, "long " * 100_000)]
    read = [(r.scope, r.conversation, r.message_id, r.text) for r in quotes.conversations(spark.createDataFrame(rows, "scope long, message_id long, text string")).collect()]
    assert read == [(1, 1, 1, "first"), (1, 1, 3, "answer"), (1, 1, 4, "last"), (1, 2, 2, "apart"), (1, 2, 5, "more"), (2, 1, 1, ("long " * 100_000).strip(" ") + " ")]


def test_repeats_in_rows_without_id(spark):
    """Many rows without id are rows of their own: only equal texts and passages count."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None, f"row {i} " + " ".join(f"w{i}x{k}" for k in range(36))) for i in range(400)]
    rows += [(None, f"head {passage}"), (None, f"{passage} tail of it"), (7, None)]
    found = Counter((r.doc_id, r.n_words, r.n_removed) for r in cover.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert found == Counter([(None, 38, 0)] * 400 + [(None, 41, 40), (None, 43, 40), (7, 0, 0)])


def test_ranges_follow_the_whole_key():
    """Rows are dealt by all columns, also where one hash is many bounds."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [np.where(rng.random(500) < 0.6, 7, rng.integers(0, 20, 500)), *(rng.integers(0, 4, 500) for _ in range(4))]
    cut = sorted(zip(*(c[:40].tolist() for c in rows), strict=True))
    bounds = [np.array(x) for x in zip(*cut, strict=True)]
    want = [sum(b <= r for b in cut) for r in zip(*(c.tolist() for c in rows), strict=True)]
    assert cover._ranges(rows, bounds).tolist() == want
    assert cover._ranges(rows, [np.zeros(0, np.int64)] * 5).tolist() == [0] * 500


def test_long_hosts(spark):
    host = ".".join(f"a{i}" for i in range(10_000)) + ".example.com"
    rows = [(1, f"http://{host}/en/x"), (2, f"http://{host}/de/x"), (3, None), (4, "http://b.net/es/y")]
    found = {r.page_id: (r.rule, r.verdict, len(r.host)) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert found == {1: ("example.com/en/", "block", len(host)), 2: ("com/", "allow", len(host)), 3: (None, "allow", 0), 4: ("net/es/", "block", 5)}


def test_words_that_always_occur_together(spark):
    """Forty words, each too common to block, block together and as one item."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    together = "/".join(words)
    rows = [(i, f"http://s{i % 9}.net/es/{together}/{i}") for i in range(60)]
    rows += [(1000 + 100 * i + k, f"http://ok.org/{w}/{k}") for i, w in enumerate(words) for k in range(10)]
    # held by no listed rule
    rows += [(300, f"http://other.org/{together}/1"), (301, "http://third.org/es/1")]
    verdict = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string"), min_support=0.2, min_confidence=0.9).collect()}
    assert verdict[300] == verdict[301] == "block"
    assert all(v == "allow" for i, v in verdict.items() if i >= 1000)


def test_mined_rules_are_those_of_brute_force(spark):
    """Labels from outside the list; every verdict by plain counting of token combinations."""
    import itertools
    import random

    rng = random.Random(6)
    names = ["red", "blue", "shop", "news", "win"]
    rows, bad = [], []
    for i in range(400):
        path = sorted(rng.sample(names, rng.randint(1, 3)))
        rows.append((i, f"http://h{rng.randrange(3)}.org/" + "/".join(path)))
        if "shop" in path and "win" in path and rng.random() < 0.97:
            bad.append((i, True))
    marks = spark.createDataFrame([*bad, (0, None)], "page_id long, bad boolean")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    verdict = {r.page_id: r.verdict for r in urls.judged(pages, min_support=0.1, min_confidence=0.9, labels=marks).collect()}
    held = {i: frozenset(t) for i, t in ((r.page_id, r.t) for r in pages.select("page_id", urls.tokens(urls.host(F.col("url")), urls.path(F.col("url"))).alias("t")).collect())}
    positive = {i for i, _ in bad}
    every = sorted(set().union(*held.values()))
    rules = []
    for k in range(1, len(every) + 1):
        for rule in map(frozenset, itertools.combinations(every, k)):
            n = [i for i, t in held.items() if rule <= t]
            hits = sum(i in positive for i in n)
            if hits >= 0.1 * len(positive) and hits >= 0.9 * len(n):
                rules.append(rule)
    want = {i: "block" if any(r <= t for r in rules) else "allow" for i, t in held.items()}
    assert verdict == want and "block" in want.values() and len(rules) > 1


def test_equal_rows_are_documents_of_their_own(spark, tmp_path):
    """A line of ten rows equal in id and text goes; one of nine stays."""
    rows = [(7, "Ten rows\nof 7")] * 9 + [(8, "ten ROWS\tstay"), (8, " ten rows")] + [(None, "no id\nx")] * 10 + [(9, "nine\ny")] * 9
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(7, "of 7", 2, 1)] * 9 + [(8, "ten ROWS\tstay", 1, 0), (8, "", 1, 1)] + [(None, "", 2, 2)] * 10 + [(9, "nine\ny", 2, 0)] * 9
    found = Counter((r.doc_id, r.kept_sha256, r.n_lines, r.n_dropped) for r in queries.op8_line_bitmaps(spark, str(tmp_path)).collect())
    assert found == Counter((i, hashlib.sha256(t.encode()).hexdigest(), n, gone) for i, t, n, gone in kept)
