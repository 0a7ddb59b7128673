"""Toxicity from document labels by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with the logistic function of a bias and
the weights of its words; a document is toxic unless none of its sentences is (noisy-or). Only
documents are labelled; the fit finds the words, and the sentence scores then say where.

A word counts as itself and by its first four and five letters, so that inflected forms are
covered. The fit uses at most MAX_FIT labelled rows (those with the smallest hash of doc_id, so the
sample does not depend on the order of rows) and at most MAX_FEATURES features whose counts in
toxic and other rows differ clearly. Every text is scored whole.

NULL and empty texts have no sentence and score 0. Labels that are NULL are left out; rows of
a doc_id labelled twice are used once for each label. Without any usable label all scores are
those of the bias alone. Extra columns are not read.
"""

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_FIT, MAX_FEATURES = 20_000, 20_000
MIN_TOXIC_ROWS, MIN_GAIN = 3, 12.0
THRESHOLD = 0.3
ROUNDS, RATE, PENALTY = 300, 0.1, 0.02
WORDS_KEPT = 500_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_EDGE = ".,;:!?\"'()[]{}<>«»„“”’…-*#$%&|"


def sentences(text: str) -> list:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()] if text else []


def features(word: str) -> list:
    w = word.strip(_EDGE).lower()
    return [w] + [f"{w[:k]}~" for k in (4, 5) if len(w) >= k] if w else []


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def labelled(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """At most `max_fit` labelled rows outside the held-out part, with their texts."""
    ids = (labels.select("doc_id", F.col("toxic").cast("double").alias("y"))
           .where("doc_id is not null and y is not null").where(~held_out())
           .orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id", "y").limit(max_fit))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y")


def choose_features(sample: DataFrame) -> pd.DataFrame:
    """The features that tell toxic rows best, by likelihood ratio."""
    def count(batches):
        seen = {}
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                found = {f for w in set((text or "").split()) for f in features(w)} | {""}
                for f in found:
                    c = seen.setdefault(f, [0, 0])
                    c[0 if y > 0.5 else 1] += 1
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array(list(seen), pa.string()),
            "toxic": pa.array([c[0] for c in seen.values()], pa.int64()),
            "other": pa.array([c[1] for c in seen.values()], pa.int64())})

    c = (sample.mapInArrow(count, "feature string, toxic long, other long").groupBy("feature")
         .agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")))
    total = c.where("feature = ''").first()
    if total is None or not total["a"] or not total["b"]:
        return pd.DataFrame({"feature": [], "gain": []})
    p, n = float(total["a"]), float(total["b"])
    a, b = F.col("a"), F.col("b")
    e1, e2 = (a + b) * (p / (p + n)), (a + b) * (n / (p + n))
    gain = 2 * (a * F.log(a / e1) + F.when(b > 0, b * F.log(b / e2)).otherwise(0.0))
    rich = c.where((F.col("feature") != "") & (a >= MIN_TOXIC_ROWS) & (a > 2 * e1))
    return (rich.select("feature", gain.alias("gain")).where(F.col("gain") >= MIN_GAIN)
            .orderBy(F.col("gain").desc(), "feature").limit(MAX_FEATURES).toPandas())


def bags(sample: DataFrame, names: list) -> pd.DataFrame:
    """Per labelled row: label, number of sentences, and the features of its sentences."""
    known = {f: i for i, f in enumerate(names)}

    def make(batches):
        for b in batches:
            out = ([], [], [], [])
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                ss, feats, where = sentences(text), [], []
                for k, s in enumerate(ss):
                    ids = [known[f] for w in s.split() for f in features(w) if f in known]
                    feats += ids
                    where += [k] * len(ids)
                for c, v in zip(out, (y, len(ss), feats, where)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.float64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int32()))],
                names=["y", "n", "feats", "places"])

    return sample.mapInArrow(make, "y double, n long, feats array<int>, places array<int>").toPandas()


def fit(data: pd.DataFrame, names: list) -> dict:
    """Weights and bias that maximise the likelihood of the labels under noisy-or."""
    y = (data["y"].to_numpy() > 0.5).astype(float)
    sizes = data["n"].to_numpy(np.int64)
    base = math.log(max(y.mean(), 1e-3) / max(1, sizes.mean())) if len(y) else -6.0
    model = {"bias": min(base, -5.0), "weights": {}}
    if not names or not len(y) or not y.any():
        return model
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(y)), sizes)
    feat = np.concatenate([np.asarray(f, np.int64) for f in data["feats"]])
    sent = np.concatenate([np.asarray(p, np.int64) + s for p, s in zip(data["places"], first)])
    w, b = np.zeros(len(names)), model["bias"]
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.clip(np.bincount(sent, w[feat], len(row)) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))
        some = np.maximum(1 - none, 1e-9)
        g = p * np.where(y == 1, none / some, -1.0)[row]
        gw = np.bincount(feat, g[sent], len(w)) - PENALTY * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.99 ** t
        w += RATE * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b += RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        w = np.maximum(w, 0)
    return {"bias": float(b), "weights": {n: float(x) for n, x in zip(names, w) if x > 1e-3}}


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> dict:
    sample = labelled(docs, labels, max_fit)
    names = list(choose_features(sample)["feature"])
    return fit(bags(sample, names), names)


class _Words(dict):
    """Word to weight, remembered up to a bound."""

    def __init__(self, weights):
        self.weights = weights

    def __missing__(self, word):
        value = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(word) <= 60:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = value
        return value


def _logits(text, words, bias):
    return [bias + sum(map(words.__getitem__, s.split())) for s in sentences(text)]


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_sentences and worst_sentence (its number, from 0)."""
    bias, weights = model["bias"], model["weights"]

    def run(batches):
        words = _Words(weights)
        quiet = math.log1p(math.exp(bias))
        for b in batches:
            scores, counts, worst = [], [], []
            for t in b.column("text"):
                zs = _logits(t.as_py(), words, bias)
                loud = [z for z in zs if z > bias]
                total = quiet * (len(zs) - len(loud)) + sum(
                    math.log1p(math.exp(z)) if z < 30 else z for z in loud)
                scores.append(-math.expm1(-total))
                counts.append(len(zs))
                worst.append(zs.index(max(zs)) if loud else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(scores, pa.float64()),
                 pa.array(counts, pa.int64()), pa.array(worst, pa.int64())],
                names=["doc_id", "score", "n_sentences", "worst_sentence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, n_sentences long, worst_sentence long")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def offending(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence (number), text and score of every sentence at or above the threshold."""
    bias, weights = model["bias"], model["weights"]

    def run(batches):
        words = _Words(weights)
        for b in batches:
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for k, (s, z) in enumerate(zip(sentences(t), _logits(t, words, bias))):
                    p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
                    if p >= threshold:
                        rows.append((d, k, s, p))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], b.schema.field("doc_id").type), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())],
                names=["doc_id", "sentence", "text", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, sentence long, text string, score double")
