"""Appends to a table of rows: repeats, added columns, untouched files, failed runs."""
import os

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import rowstore as RS


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


def test_repeats_columns_and_untouched_files(spark, tmp_path):
    root = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x", 1.5), (2, None, None), (1, "x", 1.5), (None, None, None)], "k int, s string, v double")
    assert RS.append_rows(spark, root, a, parts=8) == 3
    before = files(root)
    # other column order, one more column, one row known, one known but for the new column
    b = spark.createDataFrame([("x", 1, 1.5, None), ("x", 1, 1.5, "n"), ("y", 3, 0.0, None)], "s string, k int, v double, new string")
    assert RS.append_rows(spark, root, b) == 2
    assert files(root).items() >= before.items()
    assert RS.append_rows(spark, root, a) == 0
    assert RS.append_rows(spark, root, a.limit(0)) == 0
    want = spark.createDataFrame([(1, "x", 1.5, None), (2, None, None, None), (None, None, None, None), (1, "x", 1.5, "n"),
                                  (3, "y", 0.0, None)], "k int, s string, v double, new string")
    assert rows(RS.read_rows(spark, root)) == rows(want)
    assert RS.read_rows(spark, root).columns == ["k", "s", "v", "new"]
    with pytest.raises(TypeError, match="column k"):
        RS.append_rows(spark, root, a.withColumn("k", F.lit("1")))
    with pytest.raises(FileNotFoundError):
        RS.read_rows(spark, str(tmp_path / "none"))


def test_a_failed_append_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    RS.append_rows(spark, root, spark.range(5), parts=4)

    def fails(*a):
        raise RuntimeError("lost before the commit")
    monkeypatch.setattr(RS, "_commit", fails)
    with pytest.raises(RuntimeError):
        RS.append_rows(spark, root, spark.range(3, 9))
    monkeypatch.undo()
    assert RS.read_rows(spark, root).count() == 5
    assert RS.append_rows(spark, root, spark.range(3, 9)) == 4
    assert sorted(r.id for r in RS.read_rows(spark, root).collect()) == list(range(9))
    # two appends at once: the second to commit fails
    m = RS.manifest(spark, root)
    with pytest.raises(Exception, match="(?i)exist"):
        RS._commit(spark, root, m)


def test_only_touched_folders_are_read(spark, tmp_path):
    root = str(tmp_path / "t")
    RS.append_rows(spark, root, spark.range(1000), parts=64)
    known = RS._batches(spark, root, RS.manifest(spark, root), []).where(F.col(RS.PART).isin([3])).select(RS.PART, RS.FINGERPRINT)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan or "PartitionFilters: [(_part" in plan
    assert "ReadSchema: struct<_fingerprint:binary>" in plan
