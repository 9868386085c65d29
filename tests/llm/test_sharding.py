"""Shards of near equal bytes, with hot texts and deep subdivision."""

import zlib

import pytest

from cohortlens.llm import sharding as S


def check(rows, got, shards):
    assert sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows) == sorted(
        (str(r.doc_id), r.size, r.text_crc32) for r in got)
    size, slots = [0] * shards, [[] for _ in range(shards)]
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots)
    assert not got or max(size) - min(size) <= 2 * max(r.size for r in got)


@pytest.mark.parametrize("fanout", [4, 128])
def test_sizes_and_slots(spark, fanout):
    rows = [(i, "hot text") for i in range(1500)] + [(i, "x" * (i % 97)) for i in range(1500, 3000)]
    rows += [(None, None), (None, ""), (7, "hot text"), (7, "hot text"), (9000, "y" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = S.shard_by_bytes(docs, fanout=fanout).collect()
    check(rows, got, S.SHARDS)
    again = S.shard_by_bytes(docs.repartition(2), fanout=fanout).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_ranges_are_subdivided_within_their_share(spark):
    rows = [(i, "hot") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = S.ranged(S.records(docs), shards=4, fanout=16).groupBy("range").sum("size").collect()
    assert max(r[1] for r in ranges) <= 2 * 4 * 4000 // 16


def test_messy_rows(messy, nothing):
    check([(r.doc_id, r.text) for r in messy.collect()], S.shard_by_bytes(messy).collect(), S.SHARDS)
    assert S.shard_by_bytes(nothing).collect() == []


def test_no_nested_loops_behind_checkpoints(spark, monkeypatch):
    """Every plan that is run, those of the checkpoints included."""
    plans = []
    cut = S.C.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)
    monkeypatch.setattr(S.C, "cut_lineage", seen)
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(600)], "doc_id long, text string")
    out = S.shard_by_bytes(docs, fanout=4)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not [p for p in plans if "NestedLoop" in p or "Cartesian" in p]
