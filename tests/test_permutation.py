"""Keyed permutations of row numbers, and the importance that uses them."""
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import explain as XP


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 200, 1009, 4097])
def test_bijection(spark, n):
    df = spark.range(n).crossJoin(spark.range(3).withColumnRenamed("id", "rep")).withColumn(
        "p", XP.permuted(F.col("id"), n, F.col("rep"), seed=n))
    out = {}
    for r in df.collect():
        out.setdefault(r.rep, {})[r.id] = r.p
    assert all(sorted(m.values()) == list(range(n)) for m in out.values())
    if n >= 200:        # repeats differ, and few rows keep their place
        assert out[0] != out[1]
        assert sum(k == v for k, v in out[0].items()) < 12
        # no order is left: neighbours land about a third of the range apart
        steps = [abs(out[0][i] - out[0][i + 1]) for i in range(n - 1)]
        assert n / 4 < sum(steps) / len(steps) < n / 2.4


def test_importance_of_used_and_unused_features(spark):
    rows = spark.range(600).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2).cast("double").alias("x"),
                                   (F.col("id") % 7).cast("double").alias("unused"))
    imp = {r.feature: r for r in XP.permutation_importance(
        rows, "id", "label", ["x", "unused"], lambda df: df.withColumn("score", F.col("x")), n_repeats=3).collect()}
    assert imp["unused"].importance_mean == 0 and imp["unused"].importance_std == 0
    assert imp["x"].importance_mean == pytest.approx(0.5, abs=0.06)


def test_one_ranking(spark, monkeypatch):
    calls = []
    real = XP.dense_rank_global
    monkeypatch.setattr(XP, "dense_rank_global", lambda *a, **k: calls.append(a[1]) or real(*a, **k))
    rows = spark.range(50).select("id", (F.col("id") % 2).cast("int").alias("label"), F.col("id").cast("double").alias("x"))
    XP.permutation_importance(rows, "id", "label", ["x"], lambda df: df.withColumn("score", F.lit(0.5)), n_repeats=4).collect()
    assert calls == [[]]
