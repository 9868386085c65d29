"""Feed-forward network trained by epochs on weighted rows.

Every row takes part in every epoch with its own weight: a mini-batch's gradient
is the mean of weight x gradient (weights divided by their mean), so a row of
weight .05 counts .05 and none is drawn, copied or left out.

Rows are dealt by a hash of their key into shares of about ``share_rows`` rows and
sorted by hash inside a share, once.  In an epoch every share takes Adam steps
from the epoch's common parameters over its mini-batches, and the shares'
parameters are averaged by their weight: one table of parameters per epoch, whose
sums are added up in tasks before a few of them reach the driver.  Shares, order and mini-batches
follow from keys alone, so partitions, executors and retries change nothing but
the order of a float sum.  One share is plain sequential training.

Training goes on from the parameters of the epoch before (warm start) and stops
when the validation AUROC has not risen for ``patience`` epochs; the best epoch's
parameters are kept.  For this decision scores are counted in ``BINS`` equal bins
(ties inside a bin count one half); reports use the exact AUROC.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage

HIDDEN = (32, 16)
BATCH = 200
BUFFER = 100 * BATCH        # rows shuffled at a time
SHARE_ROWS = 100_000
RATE, BETA1, BETA2, EPSILON, L2 = 1e-3, 0.9, 0.999, 1e-8, 1e-4
BINS = 1 << 14
FEW = 8


@dataclass
class NeuralNet:
    """Layer sizes (inputs, hidden ..., 1) and all weights and biases as one vector."""

    sizes: list[int]
    params: np.ndarray
    history: list[tuple[int, float | None]] = field(default_factory=list)     # (epoch, validation AUROC)
    best_epoch: int = 0

    @staticmethod
    def fresh(sizes: Sequence[int], seed: int) -> NeuralNet:
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(sizes, sizes[1:]):
            bound = np.sqrt((6.0 if b != 1 else 2.0) / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return NeuralNet(list(sizes), np.concatenate(parts))

    def layers(self, params: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, biases) of every layer, as views into the vector."""
        p, out, at = self.params if params is None else params, [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((p[at:at + a * b].reshape(a, b), p[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Outputs of all layers; the last one is the probability of label 1."""
        out = [x]
        layers = self.layers()
        for k, (w, b) in enumerate(layers):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if k + 1 < len(layers) else 1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of mean(w * log loss) + L2 / (2 n) * sum of squared weights."""
        out, layers, n = self.forward(x), self.layers(), len(x)
        grad = np.zeros_like(self.params)
        delta = (out[-1][:, 0] - y)[:, None] * w[:, None] / n
        for k, (gw, gb) in reversed(list(enumerate(self.layers(grad)))):
            gw += out[k].T @ delta + L2 / n * layers[k][0]
            gb += delta.sum(axis=0)
            if k:
                delta = (delta @ layers[k][0].T) * (out[k] > 0)
        return grad

    def probability(self, features: Column) -> Column:
        """Row by row, for tables and streams; ``features`` is a vector column."""
        net = NeuralNet(self.sizes, self.params)

        @F.pandas_udf("double")
        def p(x: pd.Series) -> pd.Series:
            return pd.Series(net.forward(np.stack(x.to_numpy()))[-1][:, 0] if len(x) else [], dtype=float)
        return p(vector_to_array(features))

    def to_json(self) -> str:
        return json.dumps({"sizes": self.sizes, "params": self.params.tolist(), "history": self.history,
                           "best_epoch": self.best_epoch})

    @staticmethod
    def from_json(text: str) -> NeuralNet:
        d = json.loads(text)
        return NeuralNet(d["sizes"], np.array(d["params"]), [tuple(h) for h in d["history"]], d["best_epoch"])


class _Share:
    """One share's training in one epoch: rows come in, mini-batch steps are taken."""

    def __init__(self, net: NeuralNet, seed: Sequence[int]):
        self.net, self.seed, self.chunk = NeuralNet(net.sizes, net.params.copy()), list(seed), 0
        self.m, self.v, self.t, self.weight = np.zeros_like(net.params), np.zeros_like(net.params), 0, 0.0
        self.x, self.y, self.w, self.held = [], [], [], 0

    def add(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        while len(x):
            n = min(len(x), BUFFER - self.held)
            self.x.append(x[:n])
            self.y.append(y[:n])
            self.w.append(w[:n])
            self.held += n
            x, y, w = x[n:], y[n:], w[n:]
            if self.held == BUFFER:
                self.step()

    def step(self) -> None:
        if not self.held:
            return
        x, y, w = np.concatenate(self.x), np.concatenate(self.y), np.concatenate(self.w)
        order = np.random.default_rng([*self.seed, self.chunk]).permutation(len(x))
        for a in range(0, len(x), BATCH):
            i = order[a:a + BATCH]
            g = self.net.gradient(x[i], y[i], w[i])
            self.t += 1
            self.m = BETA1 * self.m + (1 - BETA1) * g
            self.v = BETA2 * self.v + (1 - BETA2) * g * g
            rate = RATE * np.sqrt(1 - BETA2 ** self.t) / (1 - BETA1 ** self.t)
            self.net.params -= rate * self.m / (np.sqrt(self.v) + EPSILON)
        self.weight += float(w.sum())
        self.x, self.y, self.w, self.held, self.chunk = [], [], [], 0, self.chunk + 1


def _epoch(net: NeuralNet, seed: int, epoch: int):
    """A task's shares of one epoch: (weight, weight x parameters), summed over its shares."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share, state, weight, total = None, None, 0.0, np.zeros_like(net.params)

        def close():
            state.step()
            return state.weight, state.weight * state.net.params
        for f in frames:
            ids = f["share"].to_numpy()
            cuts = np.flatnonzero(np.diff(ids, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=False):
                if ids[a] != share:
                    if state is not None:
                        part = close()
                        weight, total = weight + part[0], total + part[1]
                    share, state = ids[a], _Share(net, (seed, epoch, int(ids[a])))
                part = f.iloc[a:b]
                state.add(np.stack(part["x"].to_numpy()), part["y"].to_numpy(), part["w"].to_numpy())
        if state is not None:
            part = close()
            weight, total = weight + part[0], total + part[1]
            yield pd.DataFrame({"weight": [weight], "params": [total]})
    return run


def _sum(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tasks' sums added up, so that the driver receives ``FEW`` whatever the number of tasks."""
    weight, total = 0.0, None
    for f in frames:
        for w, p in zip(f["weight"], f["params"], strict=True):
            weight, total = weight + w, p if total is None else total + p
    if total is not None:
        yield pd.DataFrame({"weight": [weight], "params": [total]})


def binned_auroc(scored: DataFrame, label: str, score: str = "score") -> float | None:
    """AUROC over ``BINS`` equal score bins; None if a class is missing."""
    bin_ = F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * (BINS - 1)).cast("int")
    rows = scored.where(F.col(score).isNotNull()).groupBy(bin_.alias("b")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n")).collect()      # at most BINS rows
    rows = sorted((r["b"], r["p"], r["n"]) for r in rows)
    pos, neg = np.array([p for _, p, _ in rows], float), np.array([n for *_, n in rows], float)
    if not pos.sum() or not neg.sum():
        return None
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))


def fit_neural(train: DataFrame, n_features: int, label: str = "label", weight: str | None = "sample_weight",
               features: str = "features", key: str | None = None, val: DataFrame | None = None,
               judge: Callable[[DataFrame], DataFrame] | None = None, hidden: Sequence[int] = HIDDEN,
               max_epochs: int = 100, patience: int = 10, seed: int = 42, share_rows: int = SHARE_ROWS) -> NeuralNet:
    """One training, epoch by epoch, stopped by the validation AUROC.

    ``judge`` turns validation rows with ``p_raw`` into rows with ``score`` (prior and cap); without ``val``
    all ``max_epochs`` are run.  Rows without a label or of no positive weight take no part.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    name = F.col(key) if key else F.col(features)
    rows = train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"),
                        F.xxhash64(name.cast("string"), F.lit(seed)).alias("h"), name.cast("string").alias("k"))
    rows = rows.where("y IS NOT NULL AND w > 0")
    n, mean = rows.agg(F.count(F.lit(1)), F.avg("w")).first()       # two numbers
    net = NeuralNet.fresh([n_features, *hidden, 1], seed)
    if not n:
        return net
    shares = -(-n // share_rows)
    dealt = rows.select(F.pmod("h", F.lit(shares)).alias("share"), "x", "y", (F.col("w") / F.lit(mean)).alias("w"), "h", "k")
    dealt = dealt.repartition(shares, "share").sortWithinPartitions("share", "h", "k", "y", "w").drop("h", "k")
    dealt = cut_lineage(dealt)      # every epoch reads it, partition by partition
    best, stale = None, 0
    for epoch in range(1, max_epochs + 1):
        parts = dealt.mapInPandas(_epoch(net, seed, epoch), "weight double, params array<double>")
        if shares > FEW:
            parts = parts.repartition(FEW).mapInPandas(_sum, "weight double, params array<double>")
        sums = parts.collect()      # at most FEW rows of parameters
        net.params = sum(np.array(r["params"]) for r in sums) / sum(r["weight"] for r in sums)
        if val is None:
            net.best_epoch = epoch
            continue
        scored = val.withColumn("p_raw", net.probability(F.col(features)))
        scored = judge(scored) if judge else scored.withColumn("score", F.col("p_raw"))
        auroc = binned_auroc(scored, label)
        net.history.append((epoch, auroc))
        if auroc is not None and (best is None or auroc > best[0]):
            best, stale = (auroc, net.params.copy(), epoch), 0
        else:
            stale += 1
        if stale >= patience:
            break
    if best is not None:
        net.params, net.best_epoch = best[1], best[2]
    return net
