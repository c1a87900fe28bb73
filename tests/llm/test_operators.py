"""The training-data operators against brute force on small tables with odd rows."""

import random
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest

from tillwright.llm import cover, licences, lines, minmax, quality, quotes, urls, wumanber

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["Alpha", "beta", "Γ", "d.", "e,", "#x", "|", "ZETA", "eta", "ünï", "θ", "\xa0i"]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out = [(1, None), (2, ""), (3, " \n\t"), (None, "no id " + passage), (None, None), (4, "one"), (4, "two words"), (5, "A a"), (5, "A a")]
    for i in range(10, 60):
        text = " ".join(rng.choices([*vocabulary, "\n", "  "], k=rng.choice([3, 40, 200])))
        out.append((i, text + (f"\n{passage}\n" if i % 4 == 0 else "") + "\n Common LINE\t" * (i % 3 == 0)))
    base = rng.choices([f"w{k}" for k in range(400)], k=150)
    for i in range(100, 130):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = f"n{rng.randrange(50)}"
        out.append((i, " ".join(near)))
    out += [(200 + k, " ".join(base)) for k in range(12)]
    out.append((300, " ".join(rng.choices([f"v{k}" for k in range(90)], k=20_000))))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns whose names clash with the operators' own
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, _k1 long, h string, n long")
    return frame.repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def results(frame, *columns):
    return Counter(tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in ("doc_id", *columns)) for r in frame.collect())


def test_repeated_windows(docs, empty, rows):
    seen = Counter(tuple(w[k:k + 35]) for _, t in rows for w in [words(t)] for k in range(len(w) - 34))
    want = Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                gone[k:k + 35] = [True] * 35
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    assert results(cover.remove_repeats(docs), "n_words", "n_removed", "kept") == want
    assert cover.remove_repeats(empty).count() == 0


def test_every_shift_meets_the_cover():
    assert {(a - b) % cover.PERIOD for a in cover.COVER for b in cover.COVER} == set(range(cover.PERIOD))


@pytest.mark.parametrize("block_words", [10**6, 30])
def test_benchmark_windows(spark, docs, empty, rows, block_words):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    items = [(7, " ".join(words(rows[40][1])[:25])), (8, "alpha"), (8, "nowhere at all"), (9, None), (10, "..."), (None, "w1 w2"), (11, "beta eta"), (12, "beta eta")]
    windows = defaultdict(set)
    for item, t in items:
        w = find(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k:k + m])].add("null" if item is None else str(item))
    want = Counter()
    for i, t in rows:
        w = find(t)
        hit, found = [False] * len(w), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    found |= windows[tuple(w[k:k + m])]
                    hit[k:k + m] = [True] * m
        want[i, len(w), sum(hit), tuple(sorted(found))] += 1
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = Counter()
    for r in wumanber.decontaminate(docs, tests, block_words=block_words).collect():
        got[r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), tuple(r["items"])] += 1
    assert got == want
    assert wumanber.decontaminate(empty, tests).count() == 0
    assert all(not r.spans for r in wumanber.decontaminate(docs, tests.limit(0)).collect())


def test_benchmark_blocks_are_bounded(spark, monkeypatch):
    """Repeated rows count once, and a long text comes in pieces."""
    long = [f"t{k}" for k in range(200)]
    items = [(1, "a b c d e f g h i j k l")] * 300 + [(2, " ".join(long))] + [(k, f"u{k} v{k} w{k}") for k in range(3, 60)]
    seen = []
    monkeypatch.setattr(wumanber, "compiled", lambda x, window, made=wumanber.compiled: seen.append(sum(len(w) for _, w in x)) or made(x, window))
    frame = spark.createDataFrame([(k, " ".join(long[k:k + 10])) for k in range(191)], "doc_id long, text string")
    got = wumanber.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), block_words=30)
    assert all(r.spans == [0, 10] and r["items"] == ["2"] for r in got.collect())
    assert len(seen) > 1 and max(seen) <= 30


def test_near_duplicates(docs, empty, rows):
    def shingles(t):
        w = words((t or "").translate(LOWER))
        return frozenset(tuple(w[k:k + 3]) for k in range(len(w) - 2)) or frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        smallest[find(k)] = min(smallest.get(find(k), 10**9), 10**9 if i is None else i)
    want = Counter()
    for k, (i, s) in enumerate(sets):
        c = smallest[find(k)]
        want[i, len(s), None if c == 10**9 else c, (10**9 if i is None else i) == c] += 1
    assert results(minmax.near_duplicates(docs), "n_shingles", "component_id", "kept") == want
    assert minmax.near_duplicates(empty).count() == 0


def test_odd_sketches_never_leave_out_a_link():
    """Bits that differ are at most the shingles that differ, and nearly as many in small sets."""
    rng = np.random.default_rng(5)
    for size, changed in ((1, 0), (3, 1), (100, 0), (100, 8), (100, 60), (5000, 300)):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = a.copy()
        b[:changed] = rng.integers(0, 2**63, changed).astype(np.uint64)
        sketch = minmax.odd_sketches(np.concatenate((a, b)), np.array([size, size]))
        differ = sum(int(x).bit_count() for x in (sketch[0] ^ sketch[1]).view(np.uint64))
        assert differ <= 2 * changed
        assert differ >= changed or size > 1000
    assert not minmax.odd_sketches(np.zeros(0, np.uint64), np.array([0, 0])).any()


@pytest.mark.parametrize("min_docs", [10, 2])
def test_frequent_lines(docs, empty, rows, min_docs):
    key = lambda x: x.strip(SPACES).translate(LOWER)
    seen = Counter(k for i, t in set(rows) for k in {key(x) for x in (t or "").split("\n")})
    want = Counter()
    for i, t in rows:
        each = (t or "").split("\n")
        stay = [x for x in each if not key(x) or seen[key(x)] < min_docs]
        want[i, len(each), len(each) - len(stay), "\n".join(stay)] += 1
    assert results(lines.with_bitmaps(docs, lines.keep_bitmaps(docs, min_docs)), "n_lines", "n_dropped", "kept") == want
    assert lines.with_bitmaps(empty, lines.keep_bitmaps(empty)).count() == 0


def test_quality_features_and_order(docs, empty, rows):
    want = Counter()
    for i, t in rows:
        w, t = words(t), t or ""
        count = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        again = {j for k in range(len(w) - 2) if count[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
        full = [x for x in t.split("\n") if x.strip(SPACES)]
        want[i, len(w), sum(map(len, w)), sum(map(t.count, quality.SYMBOLS)), len(full) - len(set(full)), len(again),
             len(w) < 50 or 100 * len(again) > 50 * len(w)] += 1
    found = quality.judged(docs)
    assert results(found, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert quality.judged(empty).count() == 0 and quality.cascade(empty).count() == 0
    assert quality.cascade(docs).count() == found.filter("kept").count()
    ticks = iter(range(1000))
    measured = quality.measure(docs, clock=lambda: next(ticks))
    assert [m.gain for m in measured] == sorted((m.gain for m in measured), reverse=True)
    assert {r.name for r in quality.ordered(quality.RULES, measured)} == {r.name for r in quality.RULES}


def test_url_rules_and_associations(spark):
    bad = [f"http://m.casino.net/es/{k}" for k in range(30)] + [f"http://x{k}.net/fr/win" for k in range(30)]
    good = [f"https://site{k % 5}.org/en/{k}" for k in range(200)]
    odd = [None, "", "no scheme", "://", "HTTP://WWW.Example.COM/en/a?x#y", "http://example.com/en/", "http://Example.com/EN/", "http://com/", "http://com", "http://notcom/",
           "http://a.net/es", "http://a.net/es/?q", "a://b://c/d", "http://casino.org/es/1", "http://m.casino.org/es/2"]
    pages = spark.createDataFrame([(k % 7 or None, u, "h") for k, u in enumerate([*bad, *good, *odd, *odd])], "page_id long, url string, rule string")

    def rule(u):
        if not u or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
        fits = [(len(h) + len(p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits) if fits else None

    verdict = {}
    for r in urls.judged(pages).collect():
        if r.rule:
            verdict[r.host, r.path] = r.verdict
    want = Counter((h, p, x and x[1]) for h, p, x in (rule(u) for u in [*bad, *good, *odd, *odd]))
    assert Counter((r.host, r.path, r.rule) for r in urls.judged(pages).collect()) == want
    assert all(v == rule(f"x://{h}{p}")[2][2] for (h, p), v in verdict.items())
    assert {r.verdict for r in urls.judged(pages).filter("host like '%.org' and path like '/en/%'").collect()} == {"allow"}
    assert urls.judged(pages.limit(0)).count() == 0
    plan = urls.judged(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_licence_sequences(spark, docs, empty):
    full = ". ".join(s for n, s in licences.SENTENCES if n in ("mit-grant", "mit-notice", "as-is")) + "."
    texts = ["Intro. Released under the MIT License.\nMore text.", f"# {full}", "Licensed under CC BY-NC 4.0. All rights reserved.",
             "Licensed under the Apache License, Version 2.0.\nyou may not use this file except in compliance with the License.", None, "", "nothing"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_unused) for r in licences.scan(frame).collect()}
    assert got == {0: (["MIT"], 0), 1: (["MIT"], 0), 2: (["CC-BY-NC-4.0", "proprietary"], 0), 3: (["Apache-2.0"], 1), 4: ([], 0), 5: ([], 0), 6: ([], 0)}
    assert licences.scan(docs).count() == docs.count() and licences.scan(empty).count() == 0
    assert licences.matched(["a", "b", "c", "a"], [("AB", ("a", "b")), ("A", ("a",))]) == (["AB", "A"], 1)


def test_wrapped_licences(spark):
    """Headers as they stand in files: titles, 70 columns, comment marks, line breaks of all kinds."""
    said = defaultdict(list)
    for name, text in licences.SENTENCES:
        said[name].append(text)
    full = {"MIT": "mit-grant mit-notice as-is", "BSD-3-Clause": "bsd-redistribution bsd-source bsd-binary bsd-names", "GPL-3.0-or-later": "gnu-free GPL-terms later:3",
            "LGPL-2.1-or-later": "gnu-free LGPL-later:2.1", "GPL-2.0-only": "gnu-free GPL-only:2", "MPL-2.0": "mpl-subject mpl-copy", "ISC": "isc-grant isc-as-is",
            "Zlib": "zlib-as-is zlib-liable zlib-grant", "Unlicense": "unlicense-free unlicense-grant", "EPL-2.0": "epl-2"}
    texts, want = [], {}
    for name, ids in full.items():
        ids = ids.split()
        wrapped = [line for x in ids for line in textwrap.wrap(said[x][0] + ("." if said[x][0][-1] != "v" else ". 2.0."), 70, break_on_hyphens=False)]
        for mark, end in (("", "\n"), ("# ", "\n"), (" * ", "\r\n"), (";; ", "\n"), ("dnl ", "\n"), ("// ", "\r"), ("! ", " !\n")):
            want[len(texts)] = (ids, [name], 0)
            texts.append(end.join(mark + x for x in ["Copyright 2020 A. Author", *wrapped, "", "code(here)"]))
    # one hit a place: the line alone is a sentence too; parts with a blank line between are no sentence
    want[len(texts)] = (["ref:MIT"], ["MIT"], 0)
    texts.append("This project is\nlicensed under the MIT License")
    want[len(texts)] = (["ref:Apache-2.0"], ["Apache-2.0"], 0)
    texts.append('/*\n * Licensed under the Apache License, Version 2.0\n * (the "License");\n */')
    want[len(texts)] = ([], [], 0)
    texts.append("# All rights\n#\n# reserved")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.sentence_ids, r.licences, r.n_unused) for r in licences.scan(frame).collect()} == want


def test_versions_are_kept(spark):
    """Licences that differ in a number, tags, and the header of a whole Apache file."""
    said = {"This work is licensed under the GNU General Public License, version 2": "GPL-2.0-only", "Licensed under the GNU General Public License, version 3": "GPL-3.0-only",
            "Licensed under CC BY 3.0": "CC-BY-3.0", "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY-SA 2.5.": "CC-BY-SA-2.5", "// SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
            "# SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1-or-later", "SPDX-License-Identifier: Apache-2.0\nint x;": "Apache-2.0", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
            "Licensed under the Eclipse Public License v2.0": "EPL-2.0", "This project is licensed under the GNU Affero General Public License v3.0": "AGPL-3.0-only", "Released under the zlib License!": "Zlib"}
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
 you may not use this file except in compliance with the License.
 You may obtain a copy of the License at

     http://www.apache.org/licenses/LICENSE-2.0

 Unless required by applicable law or agreed to in writing, software
 distributed under the License is distributed on an "AS IS" BASIS,
 WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
    texts = [*said, apache]
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: [x] for k, x in enumerate([*said.values(), "Apache-2.0"])}


def test_padded_licences(spark):
    """Blanks and marks inside a sentence do not count for its length."""
    padded = [("All" + " " * 9000 + "rights" + " *|" * 900 + " reserved", "proprietary"),
              ("Licensed under the MIT" + "\t" * 5000 + "License.", "MIT")]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(padded)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licences.scan(frame).collect()} == {k: [name] for k, (_, name) in enumerate(padded)}


def test_quotations(spark):
    mails = [("t", 1, "Hello all\nfirst point\n\nsecond point"), ("t", 2, "> first  POINT\nI agree"), ("t", 3, "> > first point\n> I agree\nMe too"),
             ("t", 4, "> second point\nno"), ("t", 5, "> never written\nodd"), ("t", 6, None), (None, 1, "Hello all"), (None, 2, ">Hello all\n"), ("u", 9, "> Hello all\nother")]
    frame = spark.createDataFrame(mails, "scope string, message_id long, text string")
    got = {(r.scope, r.message_id): (r.parent, r.root, r.depth, r.n_quoted, r.own) for r in quotes.linked(frame).collect()}
    assert got["t", 2] == (1, 1, 1, 1, "I agree") and got["t", 3] == (2, 1, 2, 2, "Me too") and got["t", 4] == (1, 1, 1, 1, "no")
    assert got["t", 5] == (None, 5, 0, 1, "odd") and got["t", 6] == (None, 6, 0, 0, "") and got["u", 9] == (None, 9, 0, 1, "other")
    assert got[None, 2] == (1, 1, 1, 1, "")
    runs = {(r.message_id, r.level): r.n_lines for r in quotes.passages(quotes.lines(frame)).collect()}
    assert runs[3, 2] == 1 and runs[3, 1] == 1
    assert quotes.linked(frame.limit(0)).count() == 0
    chain = spark.createDataFrame([("c", k, (f"> line {k - 1}\n" if k else "") + f"line {k}") for k in range(40)], "scope string, message_id long, text string")
    assert {(r.message_id, r.root, r.depth) for r in quotes.linked(chain).collect()} == {(k, 0, k) for k in range(40)}
    plan = quotes.linked(quotes.quoting(spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "conv_id long, turn long, text string")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_repeated_and_nested_quotations(spark):
    """Copies link to the latest earlier one, quotes of quotes to the message that quoted; against plain Python."""
    turns = {"ok": ["ok", "fine", "ok", "> ok", "ok"],
             "two": ["x y\nz", "> x y\n> z\nmid", "other", "> > x y\n> > z\nend"],  # 1 quoted it, 0 wrote it
             "gone": ["x y\nz", "other", "> > x y\n> > Z\nend"],  # nobody left who quoted it
             "part": ["ok\nfoo\nbar", "ok", "> ok\n> foo"],  # in part: the line that only 0 has
             "mixed": ["ok", "a\nb\nc\nd", "> ok\nyes\n> a\n> c\nno"],  # one passage whole, more lines of the other
             "blank": ["a\n\nb", ">\n", "> a\n> \n>b", "> nobody\n> > a\n> > b"],
             "copy": ["first\nturn", "first\nturn", "> first\n> turn\nyes", "first\nturn", "> first\n> turn\nno"]}
    want = {"ok": {3: 2}, "two": {1: 0, 3: 1}, "gone": {2: 0}, "part": {2: 0}, "mixed": {2: 1}, "blank": {2: 0, 3: 2}, "copy": {2: 1, 4: 3}}
    mails = [(s, k, t) for s, x in turns.items() for k, t in enumerate(x)]
    # one large scope, few texts: ranges of rows that a key crosses; and two rows of one id
    rng = random.Random(4)
    said, want["big"] = [], {}
    for k in range(900):
        quote = rng.choice("abc") if k % 2 else None
        want["big"][k] = max((i for i, t in said if quote and t == quote), default=None)
        own = None if quote else rng.choice("ab" if k < 500 else "abc")
        mails.append(("big", k, own or f"> {quote}\n"))
        said.append((k, own))
    mails += [("twice", 1, "p\nq"), ("twice", 1, "r\ns"), ("twice", 2, "> r\n> s"), ("twice", 2, "> r\n> s")]
    want["twice"] = {2: 1}
    frame = spark.createDataFrame(mails, "scope string, message_id long, text string").repartition(6)
    got = [(r.scope, r.message_id, r.parent) for r in quotes.linked(frame).collect()]
    assert Counter(got) == Counter((s, k, want[s].get(k)) for s, k, _ in mails)
    assert {(r.message_id, r.root, r.depth) for r in quotes.linked(frame.filter("scope = 'two'")).collect()} == {(0, 0, 0), (1, 0, 1), (2, 2, 0), (3, 0, 2)}
