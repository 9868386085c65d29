"""Training rows of iterative fits are spread over the cores."""

from __future__ import annotations

from cohortlens.operators import models as M


def test_training_rows_are_spread_over_the_cores(spark, monkeypatch):
    monkeypatch.setattr(M, "TASK_ROWS", 100)
    few = spark.range(1000).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    out = M.dealt(few)
    assert out.rdd.getNumPartitions() == min(10, cores)
    assert sorted(r["id"] for r in out.collect()) == list(range(1000))
    monkeypatch.setattr(M, "MOST_ROWS", 50)         # more tasks than cores where shares would be large
    assert M.dealt(few).rdd.getNumPartitions() == max(20, min(10, cores))


def test_small_tables_stay_as_they_are(spark):
    few = spark.range(1000).coalesce(1)
    assert M.dealt(few) is few
