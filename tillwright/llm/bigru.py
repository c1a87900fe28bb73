"""Operator 11: language identification with a bidirectional recurrent network.

A gated recurrent network reads the UTF-8 bytes of a text in windows, once
forwards and once backwards.  At every position the two hidden states give a
probability for each language; a document's probabilities are the mean over all
its positions.  The network is trained here, in numpy, by backpropagation
through time over the whole window with Adam on the cross entropy of every
position.

It is fitted on a bounded sample: at most ``SAMPLE`` labelled documents in equal
parts by language, chosen by a hash of the id, of each at most ``WINDOWS``
windows at hashed places.  Scoring reads every byte of every text: tasks slice
the texts of a batch into windows and run many windows in lockstep, so memory is
bounded whatever the length of a text.  Nothing is shuffled.

Defined results: a null text, and one without a letter, is ``und`` with score 0;
rows with a null label or id are not learned from, and a null id is not held
out; repeated rows get equal results; with no labelled rows every text is
``und``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.llm.common import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HIDDEN = 8  # units of each direction
WIDTH = 96  # bytes of a window
SAMPLE, WINDOWS = 4096, 4
EPOCHS, BATCH, RATE = 6, 128, 0.01
AT_ONCE = 1024  # windows in lockstep
UNKNOWN = "und"


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start(classes: int, hidden: int = HIDDEN, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights; the first axis of the recurrent ones is the direction.

    ``byte`` is the input's part of the update, reset and candidate gates (a row a
    byte), ``back`` the hidden state's, ``out`` the hidden state's part of the logits.
    """
    rng = np.random.default_rng(seed)
    return {"byte": rng.normal(0, 0.3, (2, 256, 3 * hidden)), "back": rng.normal(0, hidden ** -0.5, (2, hidden, 3 * hidden)),
            "out": rng.normal(0, hidden ** -0.5, (2, hidden, classes)), "bias": np.zeros(classes)}


def both_ways(cells: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows forwards and each reversed within its length (time first), and the place of each position's backward state."""
    steps = np.arange(cells.shape[1])
    turned = np.where(steps < lengths[:, None], lengths[:, None] - 1 - steps, steps)
    return np.stack([cells.T, np.take_along_axis(cells, turned, 1).T]), turned.T


def forward(net: dict, seq: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (direction, time, window, unit); ``keep`` gets what the backward pass needs."""
    h = net["back"].shape[1]
    byte, back = net["byte"], net["back"]
    state = np.zeros((2, seq.shape[2], h), byte.dtype)
    out = np.empty((2, seq.shape[1], seq.shape[2], h), byte.dtype)
    for t in range(seq.shape[1]):
        x = np.stack([byte[0].take(seq[0, t], 0), byte[1].take(seq[1, t], 0)])
        r = state @ back
        gates = x[:, :, :2 * h] + r[:, :, :2 * h]
        gates *= 0.5
        np.tanh(gates, gates)
        gates += 1
        gates *= 0.5
        z, reset = gates[:, :, :h], gates[:, :, h:]
        new = np.tanh(x[:, :, 2 * h:] + reset * r[:, :, 2 * h:])
        if keep is not None:
            keep.append((state, z, reset, new, r[:, :, 2 * h:]))
        state = new + z * (state - new)
        out[:, t] = state
    return out


def chances(net: dict, states: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Probabilities (time, window, class) of every position."""
    ahead, behind = states[0] @ net["out"][0], states[1] @ net["out"][1]
    logits = ahead + np.take_along_axis(behind, turned[:, :, None], 0) + net["bias"]
    logits -= logits.max(2, keepdims=True)
    np.exp(logits, logits)
    logits /= logits.sum(2, keepdims=True)
    return logits


def gradients(net: dict, cells: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over all positions and its gradients, by backpropagation through time."""
    h = net["back"].shape[1]
    seq, turned = both_ways(cells, lengths)
    keep: list = []
    states = forward(net, seq, keep)
    p = chances(net, states, turned)
    there = (np.arange(cells.shape[1])[:, None] < lengths).astype(p.dtype)
    n = max(1.0, there.sum())
    loss = -float((np.log(np.maximum(np.take_along_axis(p, target[None, :, None], 2)[:, :, 0], 1e-12)) * there).sum() / n)
    d = p.copy()
    np.put_along_axis(d, target[None, :, None], np.take_along_axis(d, target[None, :, None], 2) - 1, 2)
    d *= there[:, :, None] / n
    # the backward direction's states in its own time: turning is its own inverse
    each = np.stack([d, np.take_along_axis(d, turned[:, :, None], 0)])
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    grad["bias"] = d.sum((0, 1))
    grad["out"] = np.einsum("dtbh,dtbk->dhk", states, each)
    into = each @ net["out"].transpose(0, 2, 1)[:, None]
    carry = np.zeros_like(states[:, 0])
    for t in range(cells.shape[1] - 1, -1, -1):
        before, z, reset, new, r = keep[t]
        carry = carry + into[:, t]
        d_new = carry * (1 - z) * (1 - new * new)
        d_z = carry * (before - new) * z * (1 - z)
        d_reset = d_new * r * reset * (1 - reset)
        d_x = np.concatenate([d_z, d_reset, d_new], 2)
        d_r = np.concatenate([d_z, d_reset, d_new * reset], 2)
        grad["back"] += before.transpose(0, 2, 1) @ d_r
        for way in (0, 1):
            np.add.at(grad["byte"][way], seq[way, t], d_x[way])
        carry = carry * z + d_r @ net["back"].transpose(0, 2, 1)
    return loss, grad


def train(windows: list[bytes], classes: list[int], n_classes: int, *, epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights fitted to the windows (Adam, a falling rate, gradients cut to norm 1)."""
    net = start(n_classes, seed=seed)
    rng = np.random.default_rng(seed)
    target, lengths = np.array(classes), np.array([len(w) for w in windows])
    cells = np.zeros((len(windows), WIDTH), np.int64)
    for row, w in zip(cells, windows, strict=True):
        row[:len(w)] = np.frombuffer(w, np.uint8)
    m, v = ({k: np.zeros_like(x) for k, x in net.items()} for _ in range(2))
    step, steps = 0, epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for k in range(0, len(order), BATCH):
            some = order[k:k + BATCH]
            _, grad = gradients(net, cells[some], lengths[some], target[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            rate = RATE * (1 - 0.95 * step / steps)
            for name, g in grad.items():
                g = g * min(1.0, 1 / max(norm, 1e-12))
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.001 * (g * g - v[name])
                net[name] -= rate * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8)
    return net


def pooled(net: dict, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean probabilities of each text (``data[start:end]``), and how many positions are labelled with each class."""
    k = len(net["bias"])
    total, labelled = np.zeros((len(starts), k)), np.zeros((len(starts), k), np.int64)
    pieces = -(-(ends - starts) // WIDTH)
    owner = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = starts[owner] + nth * WIDTH
    length = np.minimum(ends[owner] - at, WIDTH)
    order = np.argsort(length, kind="stable")  # windows of like length run together
    for i in range(0, len(order), AT_ONCE):
        some = order[i:i + AT_ONCE]
        n = length[some]
        steps = np.arange(int(n.max()))
        seq, turned = both_ways(data[np.minimum(at[some, None] + steps, len(data) - 1)], n)
        p = chances(net, forward(net, seq), turned)
        p *= (steps[:, None] < n)[:, :, None]
        np.add.at(total, owner[some], p.sum(0))
        best = p.argmax(2)
        for c in range(k):
            np.add.at(labelled[:, c], owner[some], ((best == c) & (steps[:, None] < n)).sum(0))
    return total / np.maximum(ends - starts, 1)[:, None], labelled


def sample(docs: DataFrame, label: str, learn: Column, *, size: int = SAMPLE) -> tuple[list[bytes], list[str]]:
    """Windows and labels to learn from: at most ``size`` documents, equal parts by label, of the ``size`` most frequent labels."""
    known = docs.filter(learn & F.col(label).isNotNull() & (F.length("text") > 0)).select("doc_id", "text", F.col(label).alias("_label"))
    counts = known.groupBy("_label").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "_label").limit(size).collect()
    if not counts:
        return [], []
    per = max(1, size // len(counts))
    # a hashed part of each label, about three times what is wanted, then the first of them; equal rows count once
    key = F.xxhash64("doc_id", "text")
    parts = docs.sparkSession.createDataFrame([(r["_label"], min(1.0, 3 * per / r["_n"])) for r in counts], f"_label {known.schema['_label'].dataType.simpleString()}, _part double")
    near = (known.withColumn("_key", key).join(F.broadcast(parts), "_label").filter(F.pmod("_key", F.lit(1 << 30)) <= F.col("_part") * (1 << 30))
            .groupBy("_label", "_key").agg(F.min("text").alias("text")))
    first = Window.partitionBy("_label").orderBy("_key")
    room = F.greatest(F.length("text") - WIDTH // 2, F.lit(1))
    cuts = [F.substring(F.col("text"), (F.pmod(F.xxhash64("_key", F.lit(i)), room) + 1).cast("int"), F.lit(WIDTH)) for i in range(WINDOWS)]
    found = (near.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= per)
             .select("_label", "_key", F.explode(F.array_distinct(F.array(*cuts))).alias("cut")).collect())
    found.sort(key=lambda r: (str(r["_label"]), r["_key"], r["cut"]))
    return [r["cut"].encode()[:WIDTH] for r in found], [r["_label"] for r in found]


def identify(docs: DataFrame, net: dict, names: list[str]) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``labelled`` (positions by the language they are labelled with) of every row."""
    small_batches(docs.sparkSession)
    fast = {k: np.ascontiguousarray(v, np.float32) for k, v in net.items()}
    schema = "doc_id long, lang_pred string, score double, labelled map<string,long>"

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            n = batch.num_rows
            text = text.cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64, count=n + 1, offset=text.offset * 8) if n else np.zeros(1, np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            ends = np.where(np.array(batch.column("letters").to_pylist(), bool), offsets[1:], offsets[:-1])
            p, counts = pooled(fast, data, offsets[:-1].copy(), ends) if names else (np.zeros((n, 0)), np.zeros((n, 0)))
            known = (ends > offsets[:-1]) & bool(names)
            best = p.argmax(1) if names else np.zeros(n, int)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]),
                pa.array([float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best.tolist(), known.tolist(), strict=True))], pa.float64()),
                pa.array([[(x, int(c)) for x, c in zip(names, row, strict=True) if c] for row in counts], pa.map_(pa.string(), pa.int64())),
            ], ["doc_id", "lang_pred", "score", "labelled"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), letters.alias("letters")).mapInArrow(run, schema)


def fitted(docs: DataFrame, label: str, learn: Column) -> tuple[dict, list[str]]:
    """A network trained on a sample of the rows where ``learn`` holds, and its languages."""
    windows, labels = sample(docs, label, learn)
    names = sorted(set(labels))
    return (train(windows, [names.index(x) for x in labels], len(names)) if names else start(0)), names
