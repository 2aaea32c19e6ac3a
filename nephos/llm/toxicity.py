"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang and Manning, 2012).

A text's features are the n-grams it holds, once each; each is scaled by the log of how much commoner it is
in toxic texts.  A logistic model over the scaled features is trained on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nephos.llm.common import small_batches
from nephos.llm.language import held_out

#: Lengths of the n-grams, and bits of the table that their hashes index.
ORDERS, BITS = (3, 4, 5), 20
#: What a model learns from at most: labelled rows of each class, each with its whole text.
SAMPLE_ROWS = 3000
#: Logistic regression: rounds of gradient steps, step, and weight decay.
ROUNDS, STEP, DECAY = 200, 0.5, 1e-4
THRESHOLD = 0.7
#: Features of the rows that a gradient step goes through at a time.
RUN = 1_000_000

_seeds = np.random.default_rng(77)
_ODD = _seeds.integers(1, 2**31, size=8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def points_of(text: str) -> np.ndarray:
    """Lower-case code points, white space runs as one space, with a space at both ends."""
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(points: np.ndarray, order: int) -> np.ndarray:
    """Where each n-gram of this length falls in the table; n-grams of different lengths differ by their seed."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    mixed = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(order):
            mixed ^= points[i : i + n]
            mixed *= _ODD[i]
            mixed ^= mixed >> np.uint32(15)
    return mixed >> np.uint32(32 - BITS)


def features(text: str) -> np.ndarray:
    points = points_of(text)
    return np.unique(np.concatenate([hashes(points, n) for n in ORDERS]))


class Model:
    """weight: what each place of the table adds to a text's logit, scaled by its log-count ratio already."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)
        self.matters = self.weight != 0

    def score(self, text: str | None) -> float:
        points = points_of(text or "")
        total = self.bias
        found = []
        for n in ORDERS:
            places = hashes(points, n)
            found.append(places[self.matters[places]])
        total += float(self.weight[np.unique(np.concatenate(found))].astype(np.float64).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model of the texts; with one class only, that class holds for all.

    The bias is moved so that scores of 0.7 lie where two models, each of half of the texts, part the other half best.
    """
    return fit_features([features(t) for t in texts], labels)


def fit_features(each: list[np.ndarray], labels: list[int]) -> Model:
    y = np.array(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0))
    model = _fit(each, y)
    half = np.zeros(len(y), bool)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[::2]] = True
    if min(np.sum(y[half] == 1), np.sum(y[~half] == 1), np.sum(y[half] == 0), np.sum(y[~half] == 0)) < 20:
        return model
    logits = np.zeros(len(y))
    for side in (half, ~half):
        part = _fit([f for f, inside in zip(each, side, strict=True) if inside], y[side])
        for i in np.flatnonzero(~side):
            logits[i] = part.bias + part.weight[each[i]].astype(np.float64).sum()
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order])
    good = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    cut = int(np.argmax(good))
    border = logits[order[cut]] if cut + 1 == len(y) else (logits[order[cut]] + logits[order[cut + 1]]) / 2
    model.bias += float(np.log(THRESHOLD / (1 - THRESHOLD)) - border)
    return model


def _fit(each: list[np.ndarray], y: np.ndarray) -> Model:
    size = 1 << BITS
    counts = [np.ones(size), np.ones(size)]
    for places, label in zip(each, y, strict=True):
        counts[int(label)][places] += 1
    n = [np.sum(y == 0) + 2.0, np.sum(y == 1) + 2.0]
    ratio = np.log(counts[1] / n[1]) - np.log(counts[0] / n[0])
    seen = counts[0] + counts[1] - 2
    # A place tells little if it is rare or its ratio is near what chance gives.
    spread = np.sqrt(1 / counts[0] + 1 / counts[1])
    ratio[(seen < 4) | (np.abs(ratio) < 2.5 * spread)] = 0.0
    used = np.flatnonzero(ratio)
    column = np.full(size, -1, np.int32)
    column[used] = np.arange(len(used))
    rows = [c[c >= 0] for c in (column[p] for p in each)]
    scale = ratio[used]
    # Rows are gone through in runs, so that nothing besides their columns is as large as all of them.
    runs, first = [], 0
    while first < len(rows):
        last, n = first, 0
        while last < len(rows) and (last == first or n + len(rows[last]) <= RUN):
            n += len(rows[last])
            last += 1
        runs.append((slice(first, last), np.concatenate(rows[first:last]), np.array([len(r) for r in rows[first:last]])))
        rows[first:last] = [None] * (last - first)
        first = last

    def sums(of: np.ndarray) -> np.ndarray:
        """Of each row, the sum over its columns."""
        return np.concatenate([np.bincount(np.repeat(np.arange(len(n)), n), of[to], len(n)) for _, to, n in runs])

    # Rows are brought to a like length for the training only, by a common factor.
    norm = 1.0 / np.sqrt(np.mean(sums(scale**2)) + 1e-9)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b = np.zeros(len(used)), 0.0
    v, vb = np.zeros(len(used)), 0.0
    for _ in range(ROUNDS):
        logit = sums(w * scale) * norm + b
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * balance / len(y)
        grad = np.zeros(len(used))
        for which, to, n in runs:
            grad += np.bincount(to, np.repeat(error[which], n), len(used))
        grad = grad * scale * norm + DECAY * w
        v = 0.9 * v - STEP * grad
        vb = 0.9 * vb - STEP * error.sum()
        w, b = w + v, b + vb
    weight = np.zeros(size)
    weight[used] = w * scale * norm
    return Model(weight, b)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled rows, of which a bounded sample is read: the least hashes of each class's keys.

    The sample is drawn from the labels, and its keys, a bounded number, are broadcast to pick the texts, whose
    features are found where the texts are.
    """
    small_batches(docs.sparkSession)
    places = F.pandas_udf(lambda s: s.map(lambda x: features(x).tobytes()), "binary")
    each, sampled = [], []
    for y in (0, 1):
        keys = labels.where((F.col(label) == y) & F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
        drawn = keys.withColumn("_h", F.xxhash64("_key")).orderBy("_h", "_key").limit(SAMPLE_ROWS)
        found = docs.where(F.col(text).isNotNull()).join(F.broadcast(drawn), F.col(key) == F.col("_key"))
        rows = found.select("_h", "_key", F.xxhash64(text).alias("_t"), places(text).alias("places")).orderBy("_h", "_key", "_t").limit(SAMPLE_ROWS)
        for r in rows.select("places").toLocalIterator():
            each.append(np.frombuffer(bytes(r["places"]), np.uint32))
            sampled.append(y)
    return fit_features(each, sampled)


def scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score, the chance that a whole text is toxic, and predicted, 1 from 0.7 up.

    A null text counts as empty and gets a score as every text does.  Columns of these names are replaced, others stay.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    score = F.pandas_udf(lambda s: s.map(shared.value.score).astype("float64"), "double")
    docs = docs.drop("score", "predicted").withColumn("score", score(F.coalesce(F.col(text), F.lit(""))))
    return docs.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that op7 returns."""
    model = train(documents.select("doc_id", "text"), labels.where(~held_out()).select("doc_id", "toxic"))
    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return scores(rows, model).select("doc_id", "held_out", "score", "predicted")
