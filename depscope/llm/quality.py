"""Quality by random indexing and a small neural network.

Every word has a sparse random index vector, derived from its hash. One pass over all documents adds up,
for each word, the index vectors of the words up to two places away: words in similar surroundings get
similar vectors. What all words have in common is taken off, and vectors are scaled to one length. The table has
``ENTRIES`` rows, found by hash, so what a task emits, what is summed and what is broadcast are bounded,
whatever the corpus; in a larger vocabulary, rare words share rows.

A document is pooled from its words' vectors: their mean, their standard deviation, the mean product of
neighbours (high where words repeat or stay in one register), and its length. A network with one
hidden layer, trained with numpy on a bounded sample of labelled documents, scores it; a temperature
fitted on a part of the sample that the network has not seen turns its output into probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.llm.common import held_out, sampled_labels, ship
from depscope.llm.textvec import Words, groups, per_doc

DIM = 32
ENTRIES = 1 << 16
WINDOW = 2
FEATURES = 3 * DIM + 1


def index_vectors() -> np.ndarray:
    """[ENTRIES, DIM]: two places +1 and two places -1 each."""
    rng = np.random.default_rng(20)
    places = rng.random((ENTRIES, DIM)).argsort(1)[:, :4]
    out = np.zeros((ENTRIES, DIM), np.int8)
    rows = np.arange(ENTRIES)[:, None]
    out[rows, places[:, :2]], out[rows, places[:, 2:]] = 1, -1
    return out


def entries(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, doc) of every word of some texts, in order."""
    w = Words(texts, spaced=True)
    return ((w.hashes(w.start, w.end) >> np.uint64(20)) % np.uint64(ENTRIES)).astype(np.uint16), w.doc


def add_contexts(entry: np.ndarray, doc: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` [ENTRIES, DIM + 1] the index vectors around each word, within documents, and a count."""
    n = len(doc)
    if not n:
        return
    # WINDOW gaps after every document keep its neighbours apart.
    at = np.arange(n) + doc.astype(np.int64) * WINDOW + WINDOW
    own = np.zeros((at[-1] + 1 + WINDOW, DIM), np.int16)
    own[at] = index[entry]
    around = np.zeros((n, DIM), np.int16)
    for k in range(1, WINDOW + 1):
        around += own[at - k]
        around += own[at + k]
    order = np.argsort(entry, kind="stable")
    sorted_ = entry[order]
    first = np.flatnonzero(np.diff(sorted_.astype(np.int32), prepend=-1))
    total[sorted_[first], :DIM] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)
    total[:, DIM] += np.bincount(entry, minlength=ENTRIES)


_NAMES = [*[f"v{i}" for i in range(DIM)], "n"]


def _contexts(batches):
    index, total = index_vectors(), np.zeros((ENTRIES, DIM + 1), np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for first, end in groups(texts):
            add_contexts(*entries(texts[first:end]), index, total)
    some = np.flatnonzero(total[:, DIM])
    yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, i]) for i in range(DIM + 1)]], ["entry", *_NAMES])


def centred(total: np.ndarray) -> np.ndarray:
    """Unit vectors of the entries without their common part; zero for entries that never occur."""

    def unit(v):
        length = np.sqrt((v * v).sum(1, keepdims=True))
        return np.divide(v, length, out=np.zeros_like(v), where=length > 0)

    v, n = unit(total[:, :DIM].astype(np.float64)), total[:, DIM:]
    common = (v * n).sum(0) / max(1, n.sum())
    return unit(np.where(v.any(1, keepdims=True), v - common, 0)).astype(np.float32)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """[ENTRIES, DIM] vectors of all entries, from all documents."""
    ship(docs.sparkSession)
    schema = "entry long, " + ", ".join(f"{c} long" for c in _NAMES)
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(_contexts, schema)
    rows = parts.groupBy("entry").agg(*[F.sum(c).alias(c) for c in _NAMES]).toArrow()
    total = np.zeros((ENTRIES, DIM + 1), np.int64)
    total[rows["entry"].to_numpy()] = np.stack([rows[c].to_numpy() for c in _NAMES], 1)
    return centred(total)


def features(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean, standard deviation and product of neighbours of its words' vectors, and length."""
    entry, doc = entries(texts)
    n = len(texts)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(1, words)[:, None]
    v = vectors[entry]
    mean = per_doc(v, doc, n) / some
    spread = np.sqrt(np.maximum(0, per_doc(v * v, doc, n) / some - mean * mean))
    after = np.zeros_like(v)
    after[:-1] = np.where((doc[1:] == doc[:-1])[:, None], v[:-1] * v[1:], 0)
    return np.concatenate([mean, spread, per_doc(after, doc, n) / some, np.log1p(words)[:, None] / 10], 1)


class Network:
    """Standardise, tanh layer, logistic output, temperature."""

    def __init__(self, mean, scale, layers, temperature=1.0, constant=None):
        self.mean, self.scale, self.layers, self.temperature, self.constant = mean, scale, layers, temperature, constant

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, batch: int = 64, seed: int = 3) -> Network:
    """Train by Adam on four fifths of the rows, fit the temperature on the rest."""
    if len(set(y.tolist())) < 2:
        return Network(0, 1, None, constant=float(y[0]) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    held, used = order[:cut], order[cut:]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    d = x.shape[1]
    p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(np.log((y[used].mean() + 0.01) / (1.01 - y[used].mean())))]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
            a, target = z[rows], y[rows]
            h = np.tanh(a @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30)))
            e = (out - target) / len(rows)
            dh = np.outer(e, p[2]) * (1 - h * h)
            grads = [a.T @ dh + decay * p[0], dh.sum(0), h.T @ e + decay * p[2], e.sum()]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p)
    logits, target = net.logits(x[held]), y[held]
    # The log loss is convex in the inverse temperature: a fine and wide grid is enough.
    grid = np.exp(np.linspace(np.log(0.02), np.log(50), 400))
    losses = [np.logaddexp(0, np.where(target == 1, -logits, logits) / g).mean() for g in grid]
    net.temperature = float(grid[int(np.argmin(losses))])
    return net


def _label_features(batches, broadcast):
    vectors = broadcast.value
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for first, end in groups(texts):
            x = features(texts[first:end], vectors).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


def _scores(batches, broadcast):
    vectors, net = broadcast.value
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for first, end in groups(texts):
            # In single precision, as the training rows were.
            x = features(texts[first:end], vectors).astype(np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(net.scores(x))], ["id", "score"])


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", *, sample: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for every row: the probability of label 1.

    Word vectors come from all documents; the network is fitted on at most ``sample`` labelled
    documents outside the held-out fifth, those first by a hash of their id, with each label's
    limit its share of that. Null and blank texts count as empty: they are scored as documents
    without words. Texts are read whole, however long. Rows that repeat an id are scored each for itself; equal texts
    have equal scores. Other columns are not read. An empty table gives no rows. Without labels of both kinds the
    score is a constant: the label if there is one, else 0.5.
    """
    spark = docs.sparkSession
    ship(spark)
    vectors = word_vectors(docs, text_col)
    counts = {r[0]: r[1] for r in labels.filter(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}
    n = max(1, sum(counts.values()))
    chosen = sampled_labels(labels, label_col, id_col, {k: -(-sample * counts.get(k, 0) // n) for k in (0, 1)})
    shared = spark.sparkContext.broadcast(vectors)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = own.join(F.broadcast(chosen), F.col("id") == F.col("__id")).select(F.col("__label").cast("int"), "text")
    got = rows.mapInArrow(lambda b: _label_features(b, shared), "label int, x binary").collect()
    got.sort(key=lambda r: (r["label"], bytes(r["x"])))  # whatever order the tasks ended in
    x = np.array([np.frombuffer(r["x"], "<f4") for r in got], np.float64).reshape(len(got), FEATURES)
    net = fit(x, np.array([r["label"] for r in got]))
    both = spark.sparkContext.broadcast((vectors, net))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lambda b: _scores(b, both), f"id {kind}, score double")
    return out.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
