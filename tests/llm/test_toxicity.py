"""Toxicity: held-out accuracy, weights learned from allowed rows only, odd rows."""

import random
import zlib

from cohortlens.llm import common as C
from cohortlens.llm import toxicity as T

from .conftest import sentence


def fold(d):
    return zlib.crc32(str(d).encode()) % 5


def corpus(spark, flip_held_out=False):
    rng = random.Random(5)
    docs, labels = [], []
    for d in range(1500):
        bad = rng.random() < 0.2
        w = sentence(rng, rng.randrange(20, 80)).split()
        for _ in range(rng.randrange(2, 5) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["nasty!", "Awful", "vile,", "foul"]))
        docs.append((d, " ".join(w)))
        if d % 3:
            labels.append((d, int(bad) if not (flip_held_out and fold(d) == 0) else 1 - int(bad)))
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, toxic int").repartition(3), dict(labels))


def test_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert len(got) == 1500 and all(r.held_out == (fold(d) == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [d for d in truth if got[d].held_out]
    assert sum(got[d].predicted == truth[d] for d in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels, _ = corpus(spark)
    _, flipped, _ = corpus(spark, flip_held_out=True)
    one, two = ({r.doc_id: r.score for r in T.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_sample_is_bounded(spark):
    docs, labels, _ = corpus(spark)
    at, weight = T.fit(docs, labels, max_train=100, epochs=1)
    assert len(at) == len(weight) and at[-1] == T.FEATURES


def test_messy_rows(messy, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (5, 0), (3, 7), (8, 1), (8, 1)], "doc_id long, toxic int")
    got = T.toxicity(messy, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in messy.collect())
    assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert {r.score for r in T.toxicity(messy, labels.limit(0)).collect()} == {0.0}
    assert T.toxicity(nothing, labels).collect() == []


def test_table_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in C.read(spark, sf, "labels").collect()}
    got = [r for r in T.op6_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    found = [r.predicted for r in got if truth[r.doc_id]]
    assert sum(found) >= 0.75 * len(found)
    assert sum(r.predicted for r in got if not truth[r.doc_id]) <= 0.01 * len(got)
