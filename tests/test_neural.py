"""The network: gradients, weights, layout, early stopping, persistence."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.operators import evaluate as E
from cohortlens.operators import models as M
from cohortlens.operators import neural as NN


def rows(spark, n=1200, seed=0, weight=lambda i, y: 1.0, parts=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    data = [(i, x[i].tolist(), int((x[i, 0] * x[i, 1] > 0) ^ (rng.random() < 0.05))) for i in range(n)]
    df = spark.createDataFrame([(i, v, y, float(weight(i, y))) for i, v, y in data],
                               "id long, x array<double>, label int, sample_weight double")
    return df.repartition(parts).withColumn("features", array_to_vector("x"))


def test_gradient_is_the_slope_of_the_weighted_loss():
    rng = np.random.default_rng(1)
    net = NN.NeuralNet.fresh([3, 5, 4, 1], 2)
    x, y, w = rng.normal(size=(9, 3)), (rng.random(9) < 0.5).astype(float), rng.random(9) * 3

    def loss(params):
        t = NN.NeuralNet(net.sizes, params)
        p = t.forward(x)[-1][:, 0]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean() + NN.L2 / 18 * sum((a ** 2).sum() for a, _ in t.layers())
    g = net.gradient(x, y, w)
    for k in range(len(g)):
        step = np.zeros_like(g)
        step[k] = 1e-6
        assert g[k] == pytest.approx((loss(net.params + step) - loss(net.params - step)) / 2e-6, abs=1e-6)
    twice = net.gradient(np.vstack([x, x]), np.concatenate([y, y]), np.concatenate([w, w * 0]))
    whole = net.gradient(x, y, w / 2)       # a row of weight 0 counts as a row that says nothing
    assert np.allclose(twice, whole - NN.L2 / 18 * np.concatenate(
        [np.concatenate([a.ravel(), b * 0]) for a, b in net.layers()]))


def test_same_parameters_for_every_layout(spark):
    nets = [NN.fit_neural(rows(spark, parts=p, weight=lambda i, y: 0.05 + i % 3), 2, key="id", max_epochs=2, share_rows=100)
            for p in (1, 7)]        # twelve shares
    assert np.allclose(nets[0].params, nets[1].params, atol=1e-9)


def test_light_rows_count_by_their_weight(spark):
    """Rows of weight .05 are neither lost nor counted whole: the mean score follows the weighted share of label 1."""
    df = rows(spark, weight=lambda i, y: 1.0 if y else 0.05).withColumn("features", array_to_vector(F.array(F.lit(1.0), F.lit(0.0))))
    net = NN.fit_neural(df, 2, key="id", max_epochs=60)
    share = df.agg(F.sum(F.col("label") * F.col("sample_weight")) / F.sum("sample_weight")).first()[0]
    assert net.forward(np.array([[1.0, 0.0]]))[-1][0, 0] == pytest.approx(share, abs=0.01)


def test_learns_and_stops(spark):
    train, val = rows(spark, 3000), rows(spark, 800, seed=1)
    net = NN.fit_neural(train, 2, key="id", val=val, max_epochs=40, patience=3)
    assert net.history[net.best_epoch - 1][1] == max(a for _, a in net.history)
    assert len(net.history) in (net.best_epoch + 3, 40)
    exact = E.auroc_ap(M.score(net, val), "label", "p_raw").first()["auroc"]
    assert exact > 0.9 and exact == pytest.approx(net.history[net.best_epoch - 1][1], abs=1e-3)
    again = NN.NeuralNet.from_json(net.to_json())
    a, b = (sorted((r.id, r.p_raw) for r in M.score(m, val).select("id", "p_raw").collect()) for m in (net, again))
    assert a == b


def test_a_flat_judge_stops_after_patience(spark):
    df = rows(spark, 200)
    net = NN.fit_neural(df, 2, key="id", val=df, max_epochs=30, patience=2, judge=lambda s: s.withColumn("score", F.lit(0.5)))
    assert (len(net.history), net.best_epoch) == (3, 1)
    assert NN.fit_neural(df.limit(0), 2, key="id", max_epochs=3).best_epoch == 0
