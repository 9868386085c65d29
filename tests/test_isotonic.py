"""Isotonic calibration against the max-min formula."""
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import isotonic as I


def max_min(rows):
    """{score: value}: max over starts of min over ends of the mean."""
    xs = sorted({s for s, _, _ in rows})
    at = {x: (sum(w for s, _, w in rows if s == x), sum(y * w for s, y, w in rows if s == x)) for x in xs}

    def mean(a, b):
        return sum(at[x][1] for x in xs[a:b + 1]) / sum(at[x][0] for x in xs[a:b + 1])
    n = len(xs)
    table = [[mean(a, b) for b in range(a, n)] for a in range(n)]
    return {x: max(min(table[a][i - a:]) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize(("ranges", "real"), [(1, False), (3, True), (64, False), (9, True)])
def test_blocks_equal_max_min(spark, ranges, real):
    rng = random.Random(ranges)
    rows = [(round(rng.random(), 2), rng.random() if real else float(rng.random() < 0.4), rng.choice([0.5, 1.0, 2.0]))
            for _ in range(150)]
    df = spark.createDataFrame(rows, "s double, y double, w double").repartition(5)
    blocks = sorted(I.isotonic_blocks(df, "s", "y", "w", ranges=ranges).collect())
    assert all(a.hi < b.lo and a.value < b.value for a, b in zip(blocks, blocks[1:], strict=False))
    for s, v in max_min(rows).items():
        assert next(b.value for b in blocks if b.lo <= s <= b.hi) == pytest.approx(v, abs=1e-9)
    assert sum(b.weight for b in blocks) == pytest.approx(sum(w for *_, w in rows))


def test_merging_is_associative():
    rng = random.Random(1)
    points = [(x / 40, x / 40, 1.0, float(rng.random() < x / 40)) for x in range(40)]
    whole = I.pooled(points)
    for cut in range(41):
        assert I.pooled(I.pooled(points[:cut]) + I.pooled(points[cut:])) == whole


def test_edges(spark):
    """NULL and NaN rows take no part; one hot score; an empty table; steps, interpolation and ends."""
    rows = [(0.5, 1.0)] * 300 + [(0.5, 0.0)] * 100 + [(0.1, 0.0), (0.9, 1.0), (None, 1.0), (float("nan"), 1.0), (0.2, None)]
    df = spark.createDataFrame(rows, "s double, y double")
    m = I.fit_isotonic(df, "s", "y")
    assert (m.scores, m.values) == ([0.1, 0.5, 0.9], [0.0, 0.75, 1.0])
    m = I.Isotonic.from_json(m.to_json())
    probe = spark.createDataFrame([(0, 0.0), (1, 0.3), (2, 0.5), (3, 2.0), (4, None)], "i int, s double")
    got = [r.v for r in probe.select("i", m.apply(F.col("s")).alias("v")).orderBy("i").collect()]
    assert got == [0.0, pytest.approx(0.375), 0.75, 1.0, None]
    none = I.fit_isotonic(df.limit(0), "s", "y")
    assert [r.v for r in probe.select(none.apply(F.col("s")).alias("v")).collect()] == [None] * 5
