import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import ann
from cohortlens.llm import common as C
from tests.conftest import SF_MID

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, asks, k):
    """{query: [(vec_id, score), ...]} by brute force."""
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(np.float32(x) for x in v)))
    lengths = [len(v) for _, v in good]
    d = min(set(lengths), key=lambda n: (-lengths.count(n), n), default=0)
    good = [(i, np.array(v, np.float64)) for i, v in good if len(v) == d]
    out = {}
    for q in {i for i, _ in good if asks(i)}:
        x = np.array(min(v.tolist() for i, v in good if i == q))
        best = sorted(((-float((x * y).sum()), i) for i, y in good if i != q))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def same(got, want):
    assert got.keys() == {q for q in want if want[q]}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_query_recall_and_scores(spark):
    rows = C.read(spark, SF_MID, "embeddings").collect()
    want = plain(rows, lambda i: i % 20 == 0, 20)
    got = found(ann.op13_ann(spark, SF_MID))
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, v in got.items():
        assert q not in [i for i, _ in v]
        assert v == sorted(v, key=lambda p: (-p[1], p[0]))
        assert [s for _, s in v] == pytest.approx([float(x[q] @ x[i]) for i, _ in v], abs=1e-12)


def vectors(rng, n=400, d=6):
    """Coarse components (many ties), a vector held by a third of all rows, and unequal norms."""
    rows = [(i, [float(c) for c in rng.integers(-2, 3, d)], 0) for i in range(n)]
    return [(i, [2.0] * d if i % 3 == 0 else v, z) for i, v, z in rows]


@pytest.mark.parametrize(("tables", "hashes", "cells", "part_rows"), [(2, 16, 2, 65_536), (3, 4, 4, 7), (1, 2, 2, 40)])
def test_whole_sample_and_recall_is_exact(spark, monkeypatch, tables, hashes, cells, part_rows):
    """All queries in the sample and recall 1: brute force, ties, classes and split buckets included."""
    monkeypatch.setattr(ann, "PART_ROWS", part_rows)
    rows = vectors(np.random.default_rng(3))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = found(ann.search(df, F.col("vec_id") % 7 == 0, 9, tables=tables, hashes=hashes, cells=cells, recall=1.0))
    same(got, plain(rows, lambda i: i % 7 == 0, 9))


def test_messy(spark):
    """Nulls, zero, non-finite and odd lengths, repeated rows and ids, clashing columns."""
    rows = vectors(np.random.default_rng(5), 60)
    rows += [(60, None, 1), (61, [], 1), (62, [0.0] * 6, 1), (63, [1.0, None] + [1.0] * 4, None), (None, [1.0] * 6, 1),
             (64, [float("nan")] + [1.0] * 5, 1), (66, [float("inf")] * 6, 1), (68, [1.0] * 5, 1), (0, [1.0] * 6, 2)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("id", "vec", "part", "kind", "code", "ids", "floor", "h", "asks"):
        df = df.withColumn(name, F.lit("x"))
    got = found(ann.search(df, F.col("vec_id") % 2 == 0, 5, recall=1.0))
    same(got, plain(rows, lambda i: i % 2 == 0, 5))


def test_few_and_none(spark):
    rows = [(i, [1.0, float(i)], 0) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    same(found(ann.search(df, F.col("vec_id") == 2, 20)), plain(rows, lambda i: i == 2, 20))
    assert ann.search(df.limit(0), F.col("vec_id") == 2, 20).collect() == []
    assert ann.search(df, F.col("vec_id") == 99, 20).collect() == []
    assert ann.search(df.filter("vec_id = 2"), F.col("vec_id") == 2, 20).collect() == []


def test_directory_holds_every_vector():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50, 200)
    d = ann.Directory.pack(rng.permutation(200), counts, 30)
    order = np.argsort(rng.permutation(200))
    assert len(order) == len(d.codes) and (np.diff(d.codes) > 0).all()
    for i in range(200):
        assert [p for p in range(len(d.at) - 1) if i in d.entries[d.at[p]:d.at[p + 1]]] == list(
            range(d.part[i], d.part[i] + d.slices[i]))
