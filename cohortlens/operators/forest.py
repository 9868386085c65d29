"""Random-forest regression by histograms, one pass over the training rows per level.

Spark ML keeps a counter per row and tree and walks every tree for every row and
level, which makes some hundred trees cost far more than the rows they are grown
from.  The same forest (bootstrap of all rows per tree, a third of the features
drawn per node, variance gain over at most ``max_bins`` bins, depth and leaf limits)
is grown here from sums:

* Features become bins once; rows are dealt by a hash of all they hold into shares of
  about ``SHARE_ROWS`` and sorted, so a share is the same for every file layout.
* A share draws each tree's Poisson(1) row weights from a seed of its own, the same in
  every level.  Rows with equal bins fall into the same nodes: their weighted count
  and sum are added up before the tree is walked.
* Per tree, the shares' histograms of a level's nodes are added up and the best
  splits chosen in one task; only splits reach the driver.

Memory depends on the trees and a share, not on the rows; time grows with rows x trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage

SHARE_ROWS = 500_000
SEEN = 500_000          # predictions a task keeps
_CDF = np.cumsum([exp(-1) / factorial(k) for k in range(20)])
_EDGES = np.arange(65537) / 65536
#: Poisson(1) draws by the leading 16 bits of a uniform number; -1 where these do not decide it
_DRAWS = np.searchsorted(_CDF, _EDGES[:-1], "right").astype(float)
_DRAWS[_DRAWS != np.searchsorted(_CDF, _EDGES[1:], "left")] = -1


def bootstrap(rng: np.random.Generator, n: int) -> np.ndarray:
    """How often each of n rows is drawn: independent Poisson(1) numbers."""
    u = rng.integers(0, 65536, n, dtype=np.uint16)
    w = _DRAWS[u]
    odd = np.flatnonzero(w < 0)
    w[odd] = np.searchsorted(_CDF, (u[odd] + rng.random(len(odd))) / 65536, "right")
    return w


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _binned(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """Bins (row, feature): the number of thresholds below the value; NaN is above all."""
    return np.stack([np.searchsorted(t, x[:, f], "left") for f, t in enumerate(thresholds)], 1).astype(np.uint8)


def find_thresholds(rows: DataFrame, width: int, max_bins: int) -> list[np.ndarray]:
    """Per feature, midpoints of all its values if they are few, else approximate quantiles."""
    cells = rows.select(F.posexplode("x").alias("f", "v")).where(~F.isnan("v"))
    distinct = cut_lineage(cells.distinct())
    sizes = {r["f"]: r["n"] for r in distinct.groupBy("f").agg(F.count("*").alias("n")).collect()}
    found = [np.zeros(0)] * width
    few = [f for f, n in sizes.items() if n <= max_bins]
    values: dict[int, list[float]] = {f: [] for f in few}
    for r in distinct.where(F.col("f").isin(few)).collect():     # at most max_bins a feature
        values[r["f"]].append(r["v"])
    for f, v in values.items():
        v = np.sort(v)
        found[f] = (v[1:] + v[:-1]) / 2
    many = [f for f in sizes if f not in values]
    if many:
        probs = [k / max_bins for k in range(1, max_bins)]
        for r in cells.where(F.col("f").isin(many)).groupBy("f").agg(F.percentile_approx("v", probs, 10_000).alias("q")).collect():
            found[r["f"]] = np.unique(r["q"])
    return found


@dataclass
class ForestRegressor:
    """Trees as arrays (tree, node); the children of node i are 2i + 1 and 2i + 2, feature -1 marks a leaf."""
    thresholds: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray         # the last bin that goes left
    value: np.ndarray
    features: str = "features"

    def leaves(self, bins: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """The node that each row of bins has come to after ``levels`` steps."""
        feature, cut, rows = self.feature[tree], self.cut[tree], np.arange(len(bins))
        node = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + 1 + (bins[rows, f] > cut[node]))
        return node

    def predict(self, x: np.ndarray, seen: dict[bytes, float] | None = None) -> np.ndarray:
        """Means of the trees' values; ``seen`` keeps those of bins met before (bounded)."""
        seen = {} if seen is None else seen
        keys = [b.tobytes() for b in _binned(x, self.thresholds)]
        fresh = list({k for k in keys if k not in seen})
        if fresh:
            bins = np.frombuffer(b"".join(fresh), np.uint8).reshape(len(fresh), -1)
            depth = (self.feature.shape[1] + 1).bit_length() - 2
            total = np.zeros(len(bins))
            for t in range(len(self.feature)):
                total += self.value[t][self.leaves(bins, t, depth)]
            seen.update(zip(fresh, (total / len(self.feature)).tolist(), strict=True))
        out = np.array([seen[k] for k in keys])
        if len(seen) > SEEN:
            seen.clear()
        return out

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the mean of the trees' values."""
        model, seen = df.sparkSession.sparkContext.broadcast(self), {}

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            return pa.array(model.value.predict(_vectors(x, len(model.value.thresholds)), seen), pa.float64())

        # not repeated where a plan names the prediction more than once
        return df.withColumn(out, predicted.asNondeterministic()(vector_to_array(F.col(self.features))))


def _as_bins(thresholds: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _binned(_vectors(batch.column(0), len(thresholds)), thresholds)
            yield pa.record_batch([pa.array([b.tobytes() for b in bins], pa.binary()), *batch.columns[1:]], names=["bins", "y", "h"])
    return run


def _histograms(state, level: int, seed: int, bins_n: int):
    """Rows (tree, sums) of a share: (node, drawn feature, bin, [count, sum]) of the level's nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, subset = state.value
        trees, k, first, nodes = len(model.feature), subset.shape[2], (1 << level) - 1, 1 << level
        sums = np.zeros((trees, nodes * k * bins_n, 2))
        held, size, chunk, share = [], 0, 0, TaskContext.get().partitionId()

        def add() -> None:
            codes, y = (pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
            bins = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
            y = y.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], (bins[1:] != bins[:-1]).any(1))))
            bins = bins[starts]
            for t in range(trees):
                w = bootstrap(np.random.default_rng((seed, share, chunk, t)), len(y))
                node = model.leaves(bins, t, level)
                open_ = np.flatnonzero(node >= first)
                node, at = node[open_], bins[open_]
                stats = [np.add.reduceat(v, starts)[open_] for v in (w, w * y)]
                for j in range(k):
                    place = ((node - first) * k + j) * bins_n + at[np.arange(len(at)), subset[t, node, j]]
                    for s, v in enumerate(stats):
                        sums[t, :, s] += np.bincount(place, v, nodes * k * bins_n)

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= 2 * SHARE_ROWS:
                add()
                held, size, chunk = [], 0, chunk + 1
        if size:
            add()
        if size or chunk:
            for t in range(trees):
                yield pa.record_batch([pa.array([t], pa.int32()), pa.array([sums[t].tobytes()], pa.binary())], names=["tree", "sums"])
    return run


_SPLITS = "tree int, node long, feature int, cut int, value double, left double, right double"


def _best_splits(state, level: int, bins_n: int, least: float):
    """The best split of each of a tree's nodes on this level, feature -1 where none gains."""
    def run(table: pa.Table) -> pa.Table:
        _, subset = state.value
        k, first, nodes = subset.shape[2], (1 << level) - 1, 1 << level
        tree = table.column("tree")[0].as_py()
        sums = sum(np.frombuffer(b.as_py()) for b in table.column("sums")).reshape(nodes, k, bins_n, 2)
        rows = []
        for i in range(nodes):
            total = sums[i, 0].sum(0)
            if total[0] <= 0:
                continue
            left = sums[i].cumsum(1)[:, :-1]
            right = total - left
            # what a split takes from the squared error; the sums of squares cancel out
            part = lambda s: s[..., 1] ** 2 / np.maximum(s[..., 0], 1)
            both = part(left) + part(right)
            gain = np.where((left[..., 0] >= least) & (right[..., 0] >= least), both - part(total), -1.0)
            j, b = np.unravel_index(gain.argmax(), gain.shape)
            mean = [s[1] / max(s[0], 1) for s in (total, left[j, b], right[j, b])]
            # the sums' rounding is no gain
            real = gain[j, b] > 1e-12 * both[j, b]
            rows.append((tree, first + i, int(subset[tree, first + i, j]) if real else -1, int(b), *mean))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 3]
        names = [c.split()[0] for c in _SPLITS.split(", ")]
        return pa.table({n: pa.array([r[c] for r in rows], kinds[c]) for c, n in enumerate(names)})
    return run


def fit_forest(train: DataFrame, label: str, features: str = "features", key: str | None = None, seed: int = 42,
               numTrees: int = 300, maxDepth: int = 5, minInstancesPerNode: int = 5, max_bins: int = 32) -> ForestRegressor:
    """The forest of ``numTrees`` bootstrap trees over all rows; ``key`` tells rows of equal features and label apart."""
    spark = train.sparkSession
    rows = train.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"),
                        *([F.col(key).alias("key")] if key else []))
    n, mean, width = rows.agg(F.count("*"), F.avg("y"), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("no training rows")
    thresholds = find_thresholds(rows, width, max_bins)
    shares = max(1, -(-n // SHARE_ROWS))
    dealt = rows.select("x", (F.col("y") - F.lit(mean)).alias("y"), F.xxhash64(*rows.columns).alias("h"))
    dealt = dealt.mapInArrow(_as_bins(thresholds), "bins binary, y double, h long").repartition(shares, "h")
    dealt = cut_lineage(dealt.sortWithinPartitions("bins", "y").select("bins", "y"))
    nodes = (2 << maxDepth) - 1
    model = ForestRegressor(thresholds, np.full((numTrees, nodes), -1, np.int32), np.zeros((numTrees, nodes), np.int32),
                            np.full((numTrees, nodes), float(mean)), features)
    drawn = np.random.default_rng(seed).random((numTrees, nodes, width)).argsort(-1)[..., :max(1, -(-width // 3))]
    for level in range(maxDepth):
        state = spark.sparkContext.broadcast((model, drawn))
        sums = dealt.mapInArrow(_histograms(state, level, seed, max_bins), "tree int, sums binary")
        splits = sums.groupBy("tree").applyInArrow(_best_splits(state, level, max_bins, minInstancesPerNode), _SPLITS).collect()
        state.unpersist()
        for r in splits:
            t, i = r["tree"], r["node"]
            model.value[t, i] = mean + r["value"]
            if r["feature"] >= 0:
                model.feature[t, i], model.cut[t, i] = r["feature"], r["cut"]
                model.value[t, 2 * i + 1], model.value[t, 2 * i + 2] = mean + r["left"], mean + r["right"]
        if not any(r["feature"] >= 0 for r in splits):
            break
    return model
