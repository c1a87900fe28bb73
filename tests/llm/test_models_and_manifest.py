"""Operators 11 to 13 against brute force, finite differences and odd rows, through their queries too."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwright.llm import bigru, merkle, negatives, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns whose names clash with the operators' own
CLASH = ", g string, at int, leaf string, size long, label int, _key int, _part int, _label string, letters int"
CLASHING = ("x", 1, "y", 2, 3, 4, 5, "z", 6)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        s = i // 16 * 16
        out.append((level[s:i], level[i + 1:s + 16]))
        i //= 16
    return out


def manifest(rows):
    """The contract of op13, row by row: (doc_id, text, lang, source, n_chars) -> its result."""
    leaf = lambda r, text: sha(*map(field, (r[0], r[3], r[2], r[4], text)))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in by[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            h = leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                h = leaf(r, r[1].translate(LOWER))
            for a, b in path:
                h = sha(*a, h, *b)
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], sha(*(x for a, b in path for x in a + b)), h, h == top[-1][0]))
    return out


def same(found, want):
    return sorted(found, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("sources", [1, 3, 40])
def test_manifest(spark, tmp_path, sources):
    rng = random.Random(sources)
    names = [None, "", "Ä", *(f"s{k}" for k in range(sources))]
    # one source holds a third of all rows, one a single row
    rows = [(i, rng.choice(["Plain", "ÉTÉ Lower", "ß", ""]) + str(i), rng.choice(["en", None]), rng.choice(names) if i % 3 else "hot", rng.choice([None, 7])) for i in range(700)]
    rows += [(1000, "alone", "en", "single", 5), (1001, None, None, None, None), (None, "no id", "en", "hot", 1), (None, None, None, "hot", None)]
    rows += [(2000, "twice", "en", "hot", 5)] * 3 + [(2000, "same id", "en", "hot", 5), (3000, "LONG " * 100_000, "en", "s0", 1)]
    frame = spark.createDataFrame([(*r, *CLASHING) for r in rows], DOCS + CLASH).repartition(7)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op13_merkle_descent(spark, str(tmp_path)).collect()]
    assert same(found, manifest(rows))


def test_manifest_of_few_rows(spark):
    flag = F.lit(False)
    for n in (0, 1, 2, 17):
        rows = [(i, f"t{i}", "en", "s", 2) for i in range(n)]
        got = merkle.manifest(spark.createDataFrame(rows, DOCS), ["doc_id", "source", "lang", "n_chars", "text"], group="source", order="doc_id", changed="text", tampered=flag)
        found = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], sha(r["proof"])) for r in got.collect()]
        assert same(found, [r[:5] for r in manifest(rows)])
        assert all(r["verified"] for r in got.collect())


def test_some_requests_descend(spark):
    """A descent of some leaves only gives their proofs."""
    leaves = [sha(str(i)) for i in range(300)]
    nodes = spark.createDataFrame([(0, i, x, 300) for i, x in enumerate(leaves)], "g long, at long, digest string, size long")
    roots, records = merkle.levels(nodes, 300, "t")
    none = F.array().cast("array<struct<left:string,right:string>>")
    asked = nodes.filter("at % 37 = 5").drop("digest")
    found = merkle.descend(roots.withColumn("path", none), records, asked, 3, "d").collect()
    assert sorted(r["at"] for r in found) == list(range(5, 300, 37))
    levels = tree(leaves)
    for r in found:
        assert r["digest"] == leaves[r["at"]]
        assert [(s["left"], s["right"]) for s in reversed(r["path"])] == [("".join(a), "".join(b)) for a, b in siblings(levels, r["at"])]


def hard_negatives(rows, every, positives, negatives_, least, most):
    out = []
    for a, (i, x, v) in enumerate(rows):
        if i % every:
            continue
        dot = [sum(p * q for p, q in zip(v, w, strict=False)) for _, _, w in rows]
        near = sorted((-dot[j], rows[j][0], j) for j in range(len(rows)) if j != a and rows[j][1] == x)[:positives]
        for s, p, _ in near:
            hard = sorted((-dot[j], rows[j][0]) for j in range(len(rows)) if rows[j][1] != x and -least * s <= 100 * dot[j] <= -most * s)[:negatives_]
            out += [(i, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(hard)]
    return out


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = negatives.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_interval_bounds():
    rng = np.random.default_rng(1)
    a, m = rng.integers(-50, 50, (20, 6)), rng.integers(-50, 50, (40, 6))
    lower, upper = negatives.bounds(a, m.min(0)[None], m.max(0)[None])
    scores = negatives.product(a, m)
    assert (lower[:, 0] <= scores.min(1)).all() and (upper[:, 0] >= scores.max(1)).all()
    big = np.array([[2 ** 30, 3]])
    assert negatives.product(big, big)[0, 0] == 2 ** 60 + 9


@pytest.mark.parametrize("size", [256, 4096, 1 << 19])
def test_hard_negatives(spark, monkeypatch, size):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", size)
    monkeypatch.setattr(negatives, "ZONE", 4)
    rng = np.random.default_rng(size)
    # clusters, ties, a vector that many rows share, shorter vectors
    centres = rng.integers(-40, 40, (6, 8))
    rows = [(int(i), int(rng.integers(4)), (centres[rng.integers(6)] + rng.integers(-3, 4, 8)).tolist()) for i in range(300)]
    rows += [(500 + i, i % 2, centres[0].tolist()) for i in range(60)]
    rows += [(600, 1, [1, 2]), (601, 2, []), (602, 3, [0] * 8), (610, 1, centres[1].tolist()), (610, 1, centres[1].tolist())]
    frame = spark.createDataFrame(rows, "id long, label long, v array<long>").repartition(5)
    args = dict(every=10, positives=3, negatives=4, least=30, most=90)
    found = [tuple(r) for r in negatives.mine(frame, **args).collect()]
    assert same(found, hard_negatives(rows, 10, 3, 4, 30, 90))


def test_blocks_are_left_out(spark, monkeypatch):
    """Zone maps of separate clusters rule out most blocks, and the result is whole."""
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 2048)
    read = []
    real = negatives._read

    def counted(table, picks, anchors, best):
        read.append((picks.count(), table.count() * anchors.count()))
        return real(table, picks, anchors, best)

    monkeypatch.setattr(negatives, "_read", counted)
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (20, 8))
    rows = [(i, int(i % 20), (centres[i % 20] + rng.integers(-2, 3, 8)).tolist()) for i in range(2000)]
    found = [tuple(r) for r in negatives.mine(spark.createDataFrame(rows, "id long, label long, v array<long>"), every=100, positives=2, negatives=3, least=30, most=90).collect()]
    assert same(found, hard_negatives(rows, 100, 2, 3, 30, 90))
    positives = read[1]
    assert positives[0] < 0.5 * positives[1]


def test_hard_negative_query(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 0.3, 4).tolist(), int(rng.integers(10))) for i in range(400)]
    bad = [(700, None, 1), (701, [1.0, None], 1), (702, [float("nan")] * 4, 2), (703, [float("inf"), 0.0, 0.0, 0.0], 2), (800, [0.1] * 4, None), (None, [0.2] * 4, 1)]
    spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, label int, u int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plain = [(i, (x + 1) % 10 if i % 7 == 0 else x, [int(np.floor(256 * c)) for c in v]) for i, v, x in rows]
    found = [tuple(r) for r in queries.op12_hilbert_zones(spark, str(tmp_path)).collect()]
    assert same(found, hard_negatives(plain, 100, 5, 10, 30, 90))


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "id long, label long, v array<long>")
    assert negatives.mine(empty, every=10, positives=3, negatives=4, least=30, most=90).collect() == []


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = bigru.start(3, hidden=4)
    cells, lengths, target = rng.integers(0, 5, (3, 6)), np.array([6, 4, 1]), np.array([0, 2, 1])
    _, grad = bigru.gradients(net, cells, lengths, target)
    for name, weights in net.items():
        flat = weights.reshape(-1)
        for i in rng.choice(flat.size, min(12, flat.size), replace=False):
            was = flat[i]
            flat[i] = was + 1e-6
            up = bigru.gradients(net, cells, lengths, target)[0]
            flat[i] = was - 1e-6
            down = bigru.gradients(net, cells, lengths, target)[0]
            flat[i] = was
            assert abs((up - down) / 2e-6 - grad[name].reshape(-1)[i]) < 1e-6


def plain_scores(net, text):
    """Windows one after the other, position by position."""
    h = net["back"].shape[1]

    def walk(codes, way):
        state, out = np.zeros(h), []
        for c in codes:
            x, r = net["byte"][way][c], state @ net["back"][way]
            z, reset = bigru.sigmoid(x[:h] + r[:h]), bigru.sigmoid(x[h:2 * h] + r[h:2 * h])
            new = np.tanh(x[2 * h:] + reset * r[2 * h:])
            state = (1 - z) * new + z * state
            out.append(state)
        return out

    total, data = 0, text.encode()
    for k in range(0, len(data), bigru.WIDTH):
        codes = list(data[k:k + bigru.WIDTH])
        for a, b in zip(walk(codes, 0), walk(codes[::-1], 1)[::-1], strict=True):
            logits = a @ net["out"][0] + b @ net["out"][1] + net["bias"]
            e = np.exp(logits - logits.max())
            total = total + e / e.sum()
    return total / len(data)


def test_every_position_is_read(spark):
    """Pooled probabilities equal a plain walk over all bytes of every text."""
    net = bigru.start(3, hidden=5, seed=2)
    rng = random.Random(4)
    texts = ["a", "é", "x" * bigru.WIDTH, "".join(rng.choices("abc é\n", k=1000)), "".join(rng.choices("xyz", k=97))]
    rows = [(i, t, *CLASHING) for i, t in enumerate(texts)] + [(10, None, *CLASHING), (11, "", *CLASHING), (12, "123 !?", *CLASHING), (None, "abc", *CLASHING), (13, "long " * 200_000, *CLASHING)]
    frame = spark.createDataFrame(rows, "doc_id long, text string" + CLASH).repartition(3)
    found = {r["doc_id"]: r for r in bigru.identify(frame, net, ["p", "q", "r"]).collect()}
    assert len(found) == len(rows)
    for i, t in enumerate(texts):
        want = plain_scores(net, t)
        assert found[i]["lang_pred"] == "pqr"[int(want.argmax())]
        assert abs(found[i]["score"] - want.max()) < 1e-4
        assert sum(found[i]["labelled"].values()) == len(t.encode())
    for i in (10, 11, 12):
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    assert sum(found[13]["labelled"].values()) == 1_000_000


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    net, names = bigru.fitted(rows, "lang", F.lit(True))
    assert names == []
    assert [(r["lang_pred"], r["score"]) for r in bigru.identify(rows, net, names).collect()] == [("und", 0.0)]
    assert bigru.identify(rows.limit(0), net, names).collect() == []


def test_sample_is_bounded(spark):
    """One label and one row hold most of the table; the sample stays in its bounds and has every label."""
    rows = [(i, f"text {i} " * 30, "big") for i in range(3000)] + [(7, "same row " * 40, "big")] * 2000 + [(i, "klein " * 30, "small") for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    windows, labels = bigru.sample(frame, "lang", F.lit(True), size=40)
    assert labels.count("big") <= 20 * bigru.WINDOWS and set(labels) == {"big", "small"}
    assert all(0 < len(w) <= bigru.WIDTH for w in windows)
    assert bigru.sample(frame.repartition(9), "lang", F.lit(True), size=40) == (windows, labels)


def test_held_out_accuracy(spark):
    """Languages of documents that were not learned from; nothing held out is read in training."""
    sf = "/root/testdata/sf0.01"
    found = queries.op11_byte_bigru(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(found) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and len(held) > 100
