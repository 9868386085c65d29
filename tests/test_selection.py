"""Radix selection: ranks, ties, heavy tails, NULL groups; the exact split that uses it."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.operators import evaluate as E
from cohortlens.operators import selection as S
from cohortlens.operators import weights as W


def test_order_bits_keep_the_order(spark):
    vals = [float("-inf"), -1e308, -2.5, -1e-320, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 3e9, float("inf")]
    rows = spark.createDataFrame([(v,) for v in vals], "v double").select("v", S.order_bits(F.col("v")).alias("k")).collect()
    keys = [r.k for r in sorted(rows, key=lambda r: r.v)]
    assert keys == sorted(keys) and len(set(keys)) == len(vals) - 1


@pytest.mark.parametrize("finish", [1, 30, 100_000])
def test_quantiles_of_awkward_values(spark, finish):
    rng = random.Random(finish)
    groups = {"tail": [10.0 ** rng.uniform(-200, 200) * rng.choice([-1, 1]) for _ in range(301)],
              "hot": [7.5] * 200 + [float(i) for i in range(60)], None: [rng.gauss(0, 1) for _ in range(50)],
              "one": [3.0], "near": [1 + i * 2.0 ** -52 for i in range(40)], "zeros": [-0.0, 0.0, 0.0, 1.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.g, r.q): r.value for r in S.exact_quantiles(df, "v", probs, ["g"], finish).collect()}
    assert set(got) == {(g, q) for g in groups for q in probs}
    for g, vs in groups.items():
        for q in probs:
            assert got[g, q] == pytest.approx(np.percentile(vs, 100 * q), rel=1e-12, abs=1e-12)


def test_within_tells_equal_rows_apart(spark):
    df = spark.createDataFrame([(k // 5, k // 5) for k in range(100)], "k long, v long")
    asked = spark.createDataFrame([(r,) for r in (0, 4, 5, 57, 99, 100)], "rank long")
    for finish in (1, 1000):
        got = sorted(tuple(r) for r in S.select_ranks(df, asked, [], "k", "v", finish).select("rank", "value", "within").collect())
        assert got == [(r, r // 5, r % 5) for r in (0, 4, 5, 57, 99)]


def test_exact_split_counts(spark):
    """Labels of any size, a NULL label, hashes that tie; repeated keys stay together."""
    rows = [(i, None if i % 11 == 0 else i % 3) for i in range(1000)] + [(5000 + i, 9) for i in range(3)] + [(7777, 8)] * 50
    df = spark.createDataFrame(rows, "id long, label int").repartition(6)
    out = W.stratified_split(df, "id")
    assert out.columns == ["id", "label", "split"] and out.count() == len(rows)
    h = {r.id: r.h for r in df.select("id", X.hash_u32(F.col("id"), 42).alias("h")).collect()}
    got = {(r.id, r.label): r.split for r in out.collect()}
    for label in (None, 0, 1, 2, 9):
        ids = sorted((i for i, y in rows if y == label), key=lambda i: (h[i], i))
        n = len(ids)
        want = ["train" if k < int(n * 0.7) else "val" if k < int(np.floor(n * (0.7 + 0.15))) else "test" for k in range(n)]
        assert [got[i, label] for i in ids] == want
    assert len({s for (i, _), s in got.items() if i == 7777}) == 1


def test_score_quantiles_of_a_null_domain(spark):
    df = spark.createDataFrame([(None, i / 10) for i in range(11)] + [("a", 0.5), ("b", None)], "domain string, score double")
    got = {r.domain: r for r in E.score_quantiles(df).collect()}
    assert set(got) == {None, "a"}
    assert (got[None].n, got[None].median, got[None].p90) == (11, pytest.approx(0.5), pytest.approx(0.9))
    assert got["a"].p10 == 0.5
