"""Per-row attribution of tree ensembles, exact and in time linear in leaves x depth^2.

A tree's expected value given some features follows known splits and averages
unknown ones by the training weight of their branches.  Shapley values of that
game add up leaf by leaf: with m features on a leaf's path, z_j the share of the
weight that passes feature j's splits and o_j whether the row passes them,

    phi_i = value * (o_i - z_i) * sum_k  k! (m - 1 - k)! / m! * [t^k] prod_{j != i} (z_j + o_j t)

The product over all j is built once per leaf and divided by each factor in turn,
so no coalition is ever listed.  The sum over features is the score less the
ensemble's mean.  Nodes come from Spark ML's saved node table (the size of the
model); rows are computed where they are, in Arrow batches.

Linear models need no trees: coefficient x (value - mean), a plain expression.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import checkpoint_dir

CELLS = 4_000_000       # numbers held at a time by a task, per array


@dataclass
class Leaf:
    """One leaf: its value and, per feature on its path, (feature, low, high, share of weight, categories)."""

    value: float
    weight: float           # share of the root's weight
    path: list[tuple[int, float, float, float, frozenset | None]]


def _leaves(nodes: dict[int, dict], scale: float) -> Iterable[Leaf]:
    """Leaves of one tree; ``nodes`` by id: value, cover, left, right, feature, threshold, categories."""
    stack = [(0, 1.0, {})]
    while stack:
        i, share, path = stack.pop()
        n = nodes[i]
        if n["left"] < 0:
            yield Leaf(n["value"] * scale, share, [(f, lo, hi, z, cats) for f, (lo, hi, z, cats) in sorted(path.items())])
            continue
        for child, is_left in ((n["left"], True), (n["right"], False)):
            z = nodes[child]["cover"] / n["cover"]
            lo, hi, before, cats = path.get(n["feature"], (-math.inf, math.inf, 1.0, None))
            if n["categories"] is not None:
                allowed = n["categories"][0 if is_left else 1]
                cats = allowed if cats is None else cats & allowed
            elif is_left:
                hi = min(hi, n["threshold"])
            else:
                lo = max(lo, n["threshold"])
            if nodes[child]["cover"] > 0:
                stack.append((child, share * z, {**path, n["feature"]: (lo, hi, before * z, cats)}))


@dataclass
class Forest:
    """All leaves of an ensemble; ``base`` is its mean over the training weight."""

    leaves: list[Leaf]

    @property
    def base(self) -> float:
        return sum(x.value * x.weight for x in self.leaves)

    @staticmethod
    def of_nodes(trees: Iterable[tuple[float, list[dict]]]) -> Forest:
        """From (weight, nodes) per tree."""
        return Forest([x for scale, nodes in trees for x in _leaves({n["id"]: n for n in nodes}, scale)])

    @staticmethod
    def of_model(spark: SparkSession, model) -> Forest:
        """From a fitted Spark ML ensemble or tree.

        Random-forest classifiers are explained in probability, boosted classifiers in log odds, regressors
        in the target's unit.
        """
        kind = type(model).__name__
        path = f"{checkpoint_dir(spark).rstrip('/')}/nodes-{uuid.uuid4().hex}"
        model.write().overwrite().save(path)
        table = spark.read.parquet(f"{path}/data")
        if "nodeData" not in table.columns:     # a single tree
            table = table.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
        gini = kind in ("RandomForestClassificationModel", "DecisionTreeClassificationModel")
        trees: dict[int, list[dict]] = {}
        for r in table.collect():
            n, stats, split = r["nodeData"], r["nodeData"]["impurityStats"], r["nodeData"]["split"]
            cover = sum(stats) if gini else stats[0]
            value = (stats[1] / cover if cover else 0.0) if gini else n["prediction"]
            cats = None
            if split["numCategories"] >= 0 and n["leftChild"] >= 0:
                left = frozenset(int(c) for c in split["leftCategoriesOrThreshold"])
                cats = (left, frozenset(range(split["numCategories"])) - left)
            trees.setdefault(r["treeID"], []).append({
                "id": n["id"], "value": value, "cover": cover, "left": n["leftChild"], "right": n["rightChild"],
                "feature": split["featureIndex"], "categories": cats,
                "threshold": split["leftCategoriesOrThreshold"][0] if cats is None and n["leftChild"] >= 0 else None})
        weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
        scale = {"GBTClassificationModel": 2.0}.get(kind, 1.0)      # its margin is half the log odds
        if kind.startswith("RandomForest"):
            scale = 1.0 / len(weights)
        return Forest.of_nodes((weights[t] * scale, nodes) for t, nodes in sorted(trees.items()))

    def compiled(self, groups: Sequence[int], n_groups: int) -> list[tuple]:
        """Leaves stacked by path length: arrays (leaves, m) and where their contributions go (``groups`` per feature)."""
        out = []
        for m in sorted({len(x.path) for x in self.leaves} - {0}):
            mine = [x for x in self.leaves if len(x.path) == m]
            f, lo, hi, z = (np.array([[p[k] for p in x.path] for x in mine], float if k else np.int64) for k in range(4))
            cats = {(a, b): np.array(sorted(p[4])) for a, x in enumerate(mine) for b, p in enumerate(x.path) if p[4] is not None}
            to = np.zeros((f.size, n_groups))
            to[np.arange(f.size), np.array(groups)[f.ravel()]] = 1
            k = [math.factorial(i) * math.factorial(m - 1 - i) / math.factorial(m) for i in range(m)]
            out.append((f, lo, hi, z, cats, np.array([x.value for x in mine]), np.array(k), to))
        return out


def explain_rows(x: np.ndarray, stacks: list[tuple], n_groups: int) -> np.ndarray:
    """Attributions (rows, groups) of a matrix of features."""
    out = np.zeros((len(x), n_groups))
    for f, lo, hi, z, cats, value, k, to in stacks:
        leaves, m = f.shape
        step = max(1, CELLS // (leaves * (m + 1)))
        for a in range(0, len(x), step):
            v = x[a:a + step][:, f]
            o = ~(v <= lo) & ((v <= hi) | np.isinf(hi))
            for (i, j), allowed in cats.items():
                o[:, i, j] &= np.isin(v[:, i, j], allowed)
            o = o.astype(float)
            poly = np.zeros((len(v), leaves, m + 1))
            poly[:, :, 0] = 1
            for j in range(m):
                up = poly[:, :, :-1] * o[:, :, j, None]
                poly *= z[None, :, j, None]
                poly[:, :, 1:] += up
            phi = np.zeros((len(v), leaves, m))
            for j in range(m):
                # divide by (z + o t): from the top where o is 1, else by z alone
                total, rest = np.zeros((len(v), leaves)), np.zeros((len(v), leaves))
                passed = o[:, :, j] > 0
                for d in range(m - 1, -1, -1):
                    rest = poly[:, :, d + 1] - z[:, j] * rest
                    total += k[d] * np.where(passed, rest, poly[:, :, d] / z[:, j])
                phi[:, :, j] = total * (o[:, :, j] - z[:, j]) * value
            out[a:a + step] += phi.reshape(len(v), -1) @ to
    return out


def _groups(names: Sequence[str]) -> tuple[list[str], list[int]]:
    order = list(dict.fromkeys(names))
    return order, [order.index(n) for n in names]


def tree_attribution(rows: DataFrame, key: str, forest: Forest, names: Sequence[str], features: str = "features") -> DataFrame:
    """(key, feature, attribution): one row per row and name; ``names`` gives the raw feature of every encoded one.

    A NULL key comes back NULL; a NaN feature fails every split that asks for a value at or below a threshold,
    as in scoring.
    """
    order, groups = _groups(names)
    stacks, n = forest.compiled(groups, len(order)), len(order)

    @F.pandas_udf("array<double>")
    def phi(x: pd.Series) -> pd.Series:
        return pd.Series(list(explain_rows(np.stack(x.to_numpy()), stacks, n)) if len(x) else [], dtype=object)
    out = rows.select(key, phi(vector_to_array(features)).alias("_phi"))
    return _long(out, key, order, F.col("_phi"))


def linear_attribution(rows: DataFrame, key: str, coefficients: Sequence[float], means: Sequence[float],
                       names: Sequence[str], features: str = "features") -> DataFrame:
    """(key, feature, attribution) of a linear score against the mean row: coefficient x (value - mean)."""
    order, groups = _groups(names)
    x = vector_to_array(features)
    sums = [None] * len(order)
    for i, g in enumerate(groups):
        term = F.lit(float(coefficients[i])) * (F.col("_x")[i] - F.lit(float(means[i])))
        sums[g] = term if sums[g] is None else sums[g] + term
    return _long(rows.select(key, x.alias("_x")), key, order, F.array(*sums))


def _long(rows: DataFrame, key: str, order: Sequence[str], phi) -> DataFrame:
    named = F.transform(phi, lambda p, i: F.struct(F.element_at(F.array(*[F.lit(n) for n in order]), i + 1).alias("feature"),
                                                   p.alias("attribution")))
    return rows.select(key, F.explode(named).alias("_e")).select(key, "_e.feature", "_e.attribution")
