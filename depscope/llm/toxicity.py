"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence is toxic with probability p = sigmoid(w . x + b), x its hashed features (words, their
first four, five and six bytes, their last four) as far as they are telling; a sentence without
any is no instance. A document is toxic if one of its instances is: P = 1 - prod(1 - p), the
noisy-or. So a long document is not suspect for its length alone. w and b minimise the log loss of P against the documents'
labels, by AdaGrad over a bounded sample of labelled documents; which sentences are to
blame is learned, not given. The same p then locate the offending sentences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depscope.llm.common import held_out, sampled_labels, ship
from depscope.llm.textvec import Words, groups

BITS, VIEWS = 18, 5
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?\n"]] = True


class Sentences:
    """Features of some texts, word by word, with the sentence and document that each belongs to."""

    def __init__(self, texts: list[str | None]):
        w = Words(texts, spaced=False)
        s, e = w.start, w.end
        views = [(s, e), *((s, np.minimum(s + k, e)) for k in (4, 5, 6)), (np.maximum(e - 4, s), e)]
        ids = [(w.hashes(a, b) ^ np.uint64(k * 0x1E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - BITS) for k, (a, b) in enumerate(views)]
        self.features = np.stack(ids, 1).astype(np.int32)  # [word, view]
        ends = np.cumsum(_SENTENCE_END[w.raw])
        number = ends[s] if len(s) else np.empty(0, np.int64)
        fresh = np.diff(number, prepend=-1) != 0
        self.sentence = np.cumsum(fresh) - 1  # of each word
        self.doc = w.doc[fresh]  # of each sentence
        # Places of sentences, from their first to the end of their last word.
        self.first, self.words = s[fresh], w
        last = np.flatnonzero(np.append(fresh, True)) - 1
        self.last = e[last[1:]] if len(s) else e


class Model:
    """Weights of the sentence features; scores documents and sentences."""

    def __init__(self, weights: np.ndarray, bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant

    def sentences(self, x: Sentences) -> np.ndarray:
        """Log odds of every sentence, minus infinity of those without telling features."""
        w = self.weights[x.features]
        z = np.bincount(x.sentence, w.sum(1), len(x.doc)) + self.bias
        z[np.bincount(x.sentence, (w != 0).any(1), len(x.doc)) == 0] = -np.inf
        return z

    def documents(self, z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or of the instances; a document without any has the odds of the bias."""
        if self.constant is not None:
            return np.full(n, self.constant)
        log_none = -np.bincount(doc, np.logaddexp(0, z), n)
        log_none[np.bincount(doc[np.isfinite(z)], minlength=n) == 0] = -np.logaddexp(0, self.bias)
        return -np.expm1(log_none)


def telling(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, least_z: float, least_docs: int = 3, least_share: float = 0.002) -> np.ndarray:
    """Which features speak for toxicity: found in enough documents, and in toxic ones more often by
    ``least_z`` standard errors of the log odds. All other features only let a model learn
    labels of single documents by heart."""
    found = np.zeros((2, 1 << BITS))
    for (features, _), label in zip(documents, labels, strict=True):
        found[label][np.unique(features)] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    odds = np.log((found[1] + 0.5) / (n[1] + 1)) - np.log((found[0] + 0.5) / (n[0] + 1))
    error = np.sqrt(1 / (found[1] + 0.5) + 1 / (found[0] + 0.5))
    return (found.sum(0) >= max(least_docs, least_share * len(labels))) & (odds > least_z * error)


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, epochs: int = 40, rate: float = 0.3, batch: int = 32, decay: float = 1e-5, least_z: float = 3.0, seed: int = 5) -> Model:
    """``documents``: for each its [word, view] features and the number of each word's sentence."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, float(labels[0]) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    use = telling(documents, labels, least_z=least_z)
    bags = []
    for features, sentence in documents:
        word, view = np.nonzero(use[features])
        found, number = np.unique(sentence[word], return_inverse=True)
        # Without an instance, one without features stands for the document.
        bags.append((features[word, view], number, max(1, len(found))))
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 0.1)
    bias, bias_g2 = -4.0, 0.01
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            counts = [bags[j][2] for j in some]
            base = np.concatenate([[0], np.cumsum(counts)])
            f = np.concatenate([bags[j][0] for j in some])
            sentence = np.concatenate([bags[j][1] + b for j, b in zip(some, base, strict=False)])
            doc = np.repeat(np.arange(len(some)), counts)
            z = np.clip(np.bincount(sentence, w[f], base[-1]) + bias, -30, 30)
            p = 1 / (1 + np.exp(-z))
            none = np.clip(np.exp(-np.bincount(doc, np.logaddexp(0, z), len(some))), 1e-9, 1 - 1e-9)
            slope = np.where(labels[some] == 1, -none / (1 - none), 1.0)[doc] * p  # d loss / d z
            touched, at = np.unique(f, return_inverse=True)
            g = np.bincount(at, slope[sentence], len(touched)) + decay * w[touched]
            g2[touched] += g * g
            w[touched] -= rate * g / np.sqrt(g2[touched])
            b = slope.sum()
            bias_g2 += b * b
            bias -= rate * b / np.sqrt(bias_g2)
    return Model(w.astype(np.float32), float(bias))


def _features(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for first, end in groups(texts):
            x = Sentences(texts[first:end])
            doc = x.doc[x.sentence] if len(x.sentence) else x.sentence
            cut = np.searchsorted(doc, np.arange(end - first + 1))
            start = np.searchsorted(x.doc, np.arange(end - first))
            rows = [(x.features[a:b].tobytes(), (x.sentence[a:b] - s).astype("<i4").tobytes()) for a, b, s in zip(cut, cut[1:], start, strict=False)]
            part = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["label", "features", "sentence"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", *, toxic_sample: int = 1500, other_sample: int = 2500) -> Model:
    """Fit on labelled documents outside the held-out fifth.

    At most ``toxic_sample`` toxic and ``other_sample`` other documents are used, those first by a
    hash of their id; nothing else is read from labels. Without documents of both kinds
    the score is a constant: the label if there is one, else 0.5.
    """
    ship(docs.sparkSession)
    chosen = sampled_labels(labels, label_col, id_col, {1: toxic_sample, 0: other_sample})
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = own.join(F.broadcast(chosen), F.col("id") == F.col("__id")).select(F.col("__label").cast("int"), "text")
    got = rows.mapInArrow(_features, "label int, features binary, sentence binary").collect()
    got.sort(key=lambda r: (r["label"], bytes(r["features"])))  # whatever order the tasks ended in
    x = [(np.frombuffer(r["features"], np.int32).reshape(-1, VIEWS), np.frombuffer(r["sentence"], "<i4")) for r in got]
    return fit(x, np.array([r["label"] for r in got]))


def _characters(words: Words, doc: int, places: np.ndarray) -> np.ndarray:
    """Numbers of code points from the beginning of a text to places in the array."""
    begin = words.begin[doc]
    count = np.cumsum((words.raw[begin : words.begin[doc + 1]] & 0xC0) != 0x80)
    return np.where(places > begin, count[np.maximum(places - begin - 1, 0)], 0)


def _scores(batches, broadcast, blame: float):
    model = broadcast.value
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for first, end in groups(texts):
            x = Sentences(texts[first:end])
            z = model.sentences(x)
            score = model.documents(z, x.doc, end - first)
            found: list[list] = [[] for _ in range(end - first)]
            bad = np.flatnonzero(z >= np.log(blame / (1 - blame))) if model.constant is None else []
            for doc in np.unique(x.doc[bad]).tolist() if len(bad) else []:
                own = bad[x.doc[bad] == doc]
                a, b = _characters(x.words, doc, x.first[own]), _characters(x.words, doc, x.last[own])
                p = 1 / (1 + np.exp(-z[own].astype(np.float64)))
                found[doc] = [{"start": int(i), "end": int(j), "score": float(k)} for i, j, k in zip(a, b, p, strict=True)]
            part = batch.slice(first, end - first)
            columns = part.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array(found, kind)], [*batch.schema.names[:-1], "score", "offending"])


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])


def _scored(carried: DataFrame, model: Model) -> DataFrame:
    """(carried, text) -> (carried, score, offending)."""
    spark = carried.sparkSession
    ship(spark)
    broadcast = spark.sparkContext.broadcast(model)
    schema = T.StructType([carried.schema[0], T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(_SPAN))])
    return carried.mapInArrow(lambda b: _scores(b, broadcast, 0.5), schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted, offending) for every row.

    offending: the sentences that are toxic by themselves, as start and end in code points and
    probability. Null text counts as empty; a text without telling features has
    the lowest score, that of the bias. Texts are read whole, however long. Rows that repeat an id are scored each for
    itself; equal texts have equal scores. Other columns are not read. An empty table gives no rows.
    """
    out = _scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model)
    return out.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, with the columns of ``docs``. Cases as in ``score``."""
    out = _scored(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text")), model)
    return out.filter(F.col("score") < threshold).select("row.*")
