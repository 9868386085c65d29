"""Tree attribution against brute-force Shapley values of the path-dependent game."""
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from cohortlens.operators import attribution as A
from cohortlens.operators import models as M


def random_tree(rng, depth, n_features, categories=0):
    nodes = []

    def grow(d, cover):
        i = len(nodes)
        nodes.append({"id": i, "value": float(rng.normal()), "cover": cover, "left": -1, "right": -1, "feature": -1,
                      "threshold": None, "categories": None})
        if d and rng.random() < 0.9:
            part = float(rng.uniform(0.1, 0.9)) * cover
            nodes[i]["feature"] = int(rng.integers(n_features))
            if nodes[i]["feature"] < categories:
                left = frozenset(int(c) for c in range(4) if rng.random() < 0.5) or frozenset({0})
                nodes[i]["categories"] = (left, frozenset(range(4)) - left)
            else:
                nodes[i]["threshold"] = float(rng.normal())
            nodes[i]["left"], nodes[i]["right"] = grow(d - 1, part), grow(d - 1, cover - part)
        return i
    grow(depth, 100.0)
    return nodes


def expected(nodes, x, known, i=0):
    n = nodes[i]
    if n["left"] < 0:
        return n["value"]
    left, right = nodes[n["left"]], nodes[n["right"]]
    if n["feature"] in known:
        v = x[n["feature"]]
        go = v in n["categories"][0] if n["categories"] else v <= n["threshold"]
        return expected(nodes, x, known, n["left"] if go else n["right"])
    return sum(expected(nodes, x, known, c["id"]) * c["cover"] / n["cover"] for c in (left, right))


def shapley(trees, x, d):
    def game(known):
        return sum(w * expected(nodes, x, known) for w, nodes in trees)
    out = []
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) * (game({*s, i}) - game(set(s)))
                       for k in range(d) for s in itertools.combinations(rest, k)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    d, cats = 5, 2 if seed % 2 else 0
    trees = [(float(rng.uniform(0.2, 2)), random_tree(rng, 5, d, cats)) for _ in range(3)]
    forest = A.Forest.of_nodes(trees)
    x = rng.normal(size=(8, d))
    x[:, :cats] = rng.integers(0, 4, (8, cats))
    got = A.explain_rows(x, forest.compiled(range(d), d), d)
    for row, phi in zip(x, got, strict=True):
        assert phi == pytest.approx(shapley(trees, row, d), abs=1e-9)
        whole = sum(w * expected(nodes, row, set(range(d))) for w, nodes in trees)
        assert phi.sum() == pytest.approx(whole - forest.base, abs=1e-9)


def cohort(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)).round(2)
    data = [(i, x[i].tolist(), float(x[i, 0] + x[i, 1] * x[i, 2] > 0), float(1 + i % 3)) for i in range(400)]
    df = spark.createDataFrame(data, "id long, x array<double>, label double, sample_weight double").repartition(3)
    return df.withColumn("features", array_to_vector("x"))


@pytest.mark.parametrize(("estimator", "score"), [
    (lambda: GBTClassifier(maxIter=8, maxDepth=3, weightCol="sample_weight"), lambda p: math.log(p / (1 - p))),
    (lambda: RandomForestClassifier(numTrees=7, maxDepth=4, weightCol="sample_weight"), lambda p: p)])
def test_spark_ensembles_sum_to_their_score(spark, estimator, score):
    df = cohort(spark)
    model = estimator().fit(df)
    forest = A.Forest.of_model(spark, model)
    attr = A.tree_attribution(df, "id", forest, ["a", "b", "b", "c"])
    sums = {r.id: r.s for r in attr.groupBy("id").agg(F.sum("attribution").alias("s")).collect()}
    assert attr.select("feature").distinct().count() == 3
    for r in M.score(model, df).select("id", "p_raw").collect():
        assert sums[r.id] + forest.base == pytest.approx(score(r.p_raw), abs=1e-6)


def test_single_tree_linear_and_wide_models(spark):
    df = cohort(spark)
    model = DecisionTreeRegressor(maxDepth=5).fit(df)
    forest = A.Forest.of_model(spark, model)
    attr = A.tree_attribution(df, "id", forest, list("abcd")).groupBy("id").agg(F.sum("attribution").alias("s"))
    both = attr.join(model.transform(df).select("id", "prediction"), "id").collect()
    assert all(r.s + forest.base == pytest.approx(r.prediction, abs=1e-9) for r in both)
    lin = A.linear_attribution(df, "id", [1.0, 2.0, -1.0, 0.0], [0.5, 0.0, 0.0, 9.0], ["a", "b", "a", "c"])
    want = {(r.id, f): v for r in df.collect() for f, v in (
        ("a", r.x[0] - 0.5 - r.x[2]), ("b", 2 * r.x[1]), ("c", 0.0))}
    got = {(r.id, r.feature): r.attribution for r in lin.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    # twenty features, no coalition is listed
    rng = np.random.default_rng(0)
    forest = A.Forest.of_nodes([(1.0, random_tree(rng, 12, 20))])
    x = rng.normal(size=(5, 20))
    phi = A.explain_rows(x, forest.compiled(range(20), 20), 20)
    assert np.isfinite(phi).all() and phi.shape == (5, 20)
