"""Mixtures: targets met, whole blocks, budgets, order; sources and texts that are null."""

import math
from collections import Counter

from pyspark.sql import functions as F

from cohortlens.llm import common as C
from cohortlens.llm import mixing as M


def used(df):
    return df.select("doc_id", "source", "mixed.tokens", "mixed.block", "mixed.block_start").collect()


def corpus(spark):
    rows = [(i, "w " * (1 + i % 9), s) for s, n in (("a", 900), ("b", 200), (None, 60), ("c", 12)) for i in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)] + [(5000, "", "a"), (5001, None, "b"), (5002, "", "empty")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)


def shares(rows):
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    return {s: n for s, n in tokens.items() if n}


def test_entropy_target_and_blocks(spark):
    rows, docs = corpus(spark)
    size = shares(rows)
    total = sum(size.values())
    plan = {r.source_key: r for r in M.weights(docs, F.col("source"), C.n_words(F.col("text")), entropy=0.9).collect()}
    w = [r.weight for r in plan.values()]
    assert abs(sum(w) - 1) < 1e-9 and "=empty" not in plan
    assert abs(-sum(x * math.log(x) for x in w) - 0.9 * math.log(4)) < 1e-6
    got = used(M.mix(docs, entropy=0.9))
    for s, n in size.items():
        budget = plan["" if s is None else "=" + s].budget
        assert abs(budget - plan["" if s is None else "=" + s].weight * total) <= 0.5
        mine = [r for r in got if r.source == s]
        ids = sorted(d for d, _, x in rows if x == s)
        blocks = {}
        for r in mine:
            blocks.setdefault(r.block, []).append(r)
        for k in range(budget // n):
            assert sorted(r.doc_id for r in blocks[k]) == ids
        assert max(blocks) <= budget // n and 0 <= budget - sum(r.tokens for r in mine) < 9
        for block in blocks.values():      # gapless order
            place = 0
            for r in sorted(block, key=lambda r: (r.block_start, r.tokens)):
                assert r.block_start == place
                place += r.tokens


def test_an_overlong_document_does_not_end_a_cut_block(spark):
    """Wherever it stands in the order: the source falls short by less than one of its short documents."""
    rows = [(i, "w " * 5, "long") for i in range(100)] + [(1000 + i, "v " * 900, "long") for i in range(3)]
    rows += [(2000 + i, "u " * 9, "big") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for budget in (3000, 5000, 9000):
        plan = {r.source_key: r for r in M.weights(docs, F.col("source"), C.n_words(F.col("text")), entropy=0.99, budget=budget).collect()}
        got = used(M.mix(docs, entropy=0.99, budget=budget))
        for s, short in (("long", 5), ("big", 9)):
            p, mine = plan["=" + s], [r for r in got if r.source == s]
            left = p.budget - sum(r.tokens for r in mine)
            rest = p.budget % p.tokens
            if s == "big" or rest < 900:
                assert 0 <= left < short or len(mine) == p.rows * (p.budget // p.tokens) + (100 if s == "long" else p.rows)


def test_limit_of_passes_and_cover(spark):
    rows, docs = corpus(spark)
    size = shares(rows)
    for cover in (False, True):
        plan = M.weights(docs, F.col("source"), C.n_words(F.col("text")), limit=2.0, cover=cover).collect()
        passes = [r.budget / r.tokens for r in plan]
        assert max(passes) <= 2.0 + 0.02 and (not cover or min(passes) >= 1)
        assert max(passes) > 1.9      # the exponent is the smallest within the limit
    got = Counter(r.doc_id for r in M.mixed_rows(docs, limit=2.0, cover=True).collect())
    assert all(got[d] in (1, 2) for d, _, s in rows if s in size)


def test_order_does_not_depend_on_partitions(spark):
    _, docs = corpus(spark)
    assert sorted(map(str, used(M.mix(docs, entropy=0.9)))) == sorted(map(str, used(M.mix(docs.repartition(2), entropy=0.9))))


def test_messy_rows(messy, nothing):
    kept = M.mixed_rows(messy, limit=3.0, cover=True)
    assert kept.columns == messy.columns
    ids = {str(r.doc_id) for r in kept.collect()}
    assert {"1", "2", "5", "6", "7", "8", "10", "None"} <= ids       # rows of sources that have tokens
    assert M.mixed_rows(nothing, limit=3.0).collect() == [] and M.mix(nothing, entropy=0.9).collect() == []
