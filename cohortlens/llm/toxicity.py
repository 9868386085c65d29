"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text (A-Z in lower case, words parted by white space and ASCII
punctuation): its distinct words, word pairs and pairs that skip one word,
hashed into fixed ranges.  FTRL-proximal keeps a learning rate per coordinate,
and its L1 term leaves every feature at exactly zero that has not gathered
enough evidence, so the model is the few weights that are not zero.

The classifier is fitted on a bounded sample, at most about ``MAX_TRAIN``
labelled training rows drawn by a hash of their doc_id (the bound is a
parameter), in one task; its weights (at most the number of hash values) are
broadcast and every whole text is scored where it is read.  Labels, languages,
sources and ids are never inputs of a score.

Edge cases: null, empty and blank texts get the score of no features (the
bias); labels that are null are not learned from; a label row per repeated
document is a training row each; without training rows every score is 0;
a null doc_id is scored and not held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common as C
from cohortlens.llm import wordhash as W

MAX_TRAIN = 24_000
EPOCHS = 5
WORDS, PAIRS = 1 << 20, 1 << 21    # hash ranges of single words and of each kind of pair
FEATURES = WORDS + 2 * PAIRS
RATE, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
FOLDS, FOLD = 5, 0
_U = np.uint64


def features(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, pair and skip pair of a batch, with repeats."""
    h, owner = w.hash, w.owner()
    found = [(owner, (h % _U(WORDS)).astype(np.int64))]
    for skip, base in ((1, WORDS), (2, WORDS + PAIRS)):
        if len(h) > skip:
            same = owner[skip:] == owner[:-skip]
            pair = W.mix(h[:-skip][same] * _U(3) + (h[skip:][same] << _U(7 * skip)) + _U(skip))
            found.append((owner[:-skip][same], (pair % _U(PAIRS)).astype(np.int64) + base))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(owner * FEATURES + feature)
    return both // FEATURES, both % FEATURES


class Ftrl:
    """FTRL-proximal for logistic loss over binary features; the last coordinate is the bias (without L1)."""

    def __init__(self, size: int = FEATURES, rate: float = RATE, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.rate + self.l2)

    def bias(self) -> float:
        return -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - label
        for where, weight in ((at, w), (-1, b)):
            n = self.n[where]
            self.z[where] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * weight
            self.n[where] = n + g * g


def _fit(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            labels += batch.column(1).to_pylist()
            for i, j, w in W.batches(batch.column(0), lower=True, marks=True):
                owner, feature = _distinct(*features(w))
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                rows += [feature[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        model = Ftrl()
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                model.learn(rows[k], labels[k])
        if rows:
            at = np.flatnonzero(np.abs(model.z[:-1]) > model.l1)
            yield pa.record_batch([np.append(at, FEATURES), np.append(model.weights(at), model.bias())],
                                  names=["feature", "weight"])
    return run


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray] | None:
    """(features, weights) learned from labelled rows: docs (doc_id, text), labels (doc_id, toxic)."""
    n = labels.count()
    share = int(min(1.0, max_train / max(n, 1)) * (1 << 30))
    drawn = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    # at most about max_train small rows, by the draw above
    rows = docs.join(F.broadcast(drawn), "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("k"))
    table = (rows.repartition(1).sortWithinPartitions("k", "text").select("text", "toxic")
             .mapInArrow(_fit(epochs), "feature long, weight double").toPandas())
    return (table["feature"].to_numpy(), table["weight"].to_numpy()) if len(table) else None


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.value is None:
            for batch in batches:
                yield pa.record_batch([batch.column(0), np.zeros(len(batch))], names=["doc_id", "score"])
            return
        at, weight = model.value
        dense = np.zeros(FEATURES + 1, np.float32)
        dense[at] = weight
        for batch in batches:
            total = np.zeros(len(batch))
            for i, j, w in W.batches(batch.column(1), lower=True, marks=True):
                owner, feature = features(w)
                live = dense[feature] != 0
                owner, feature = _distinct(owner[live], feature[live])
                total[i:j] = np.bincount(owner, dense[feature], j - i)
            yield pa.record_batch([batch.column(0), 1 / (1 + np.exp(-np.clip(total + weight[-1], -500, 500)))],
                                  names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_score(held), f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; rows of fold 0 of 5 are never learned from."""
    docs = docs.select("doc_id", "text")
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = C.cut_lineage(known.filter(~C.held_out(F.col("doc_id"), FOLDS, FOLD)))
    scored = score(docs, fit(docs, known, max_train))
    return scored.select("doc_id", C.held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
