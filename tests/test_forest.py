"""Random-forest regression from histograms (operators/forest.py)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler

from cohortlens.operators import forest as R
from cohortlens.operators import models as M


def _rows(spark, n=4000, parts=3):
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(0, 50, n), rng.random(n), rng.integers(0, 2, n)
    y = 10.0 * (a > 24) + 5.0 * (b > 0.5) + rng.normal(0, 0.1, n)
    df = spark.createDataFrame([(k, float(a[k]), float(b[k]), float(c[k]), float(y[k])) for k in range(n)],
                               "id long, a double, b double, c double, y double").repartition(parts)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def test_draws_are_poisson():
    w = R.bootstrap(np.random.default_rng(3), 400_000)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs((w == 0).mean() - np.exp(-1)) < 0.005


def test_forest_is_grown_from_sums_and_learns_steps(spark):
    df = _rows(spark)
    model = M.fit_regressor(df, "rf", "y", key="id")
    assert isinstance(model, R.ForestRegressor)      # Spark ML keeps a counter per row and tree
    assert model.feature.shape == (300, 63)
    out = model.transform(df).select("y", "prediction").toArrow()
    y, p = out.column("y").to_numpy(), out.column("prediction").to_numpy()
    assert 1 - ((y - p) ** 2).mean() / y.var() > 0.8
    assert len(np.unique(model.feature[:, 0])) == 3  # one of three features is drawn per node


def test_forest_is_the_same_for_every_layout(spark):
    one, two = (R.fit_forest(_rows(spark, parts=p), "y", key="id", numTrees=5) for p in (1, 4))
    assert (one.feature == two.feature).all() and (one.cut == two.cut).all() and np.allclose(one.value, two.value)


def test_leaves_hold_the_least_number_of_rows_and_constant_targets_do_not_split(spark):
    df = _rows(spark, n=30)
    tiny = R.fit_forest(df, "y", key="id", numTrees=4, minInstancesPerNode=40)
    assert (tiny.feature == -1).all()
    flat = R.fit_forest(df.drop("y").selectExpr("*", "3.5D AS y"), "y", key="id", numTrees=4)
    assert (flat.feature == -1).all() and np.allclose(flat.value, 3.5)
