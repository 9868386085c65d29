"""Readers (S1-S3, S7, S12, S13) and sinks."""
import os

from pyspark.sql import functions as F

from cohortlens.sources import readers as RD
from cohortlens.sources import sinks as SK


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_folder_scan_with_project_from_path(spark, tmp_path):
    root = str(tmp_path / "raw")
    _write(f"{root}/PROJ-A/cases.csv", "case_id,Age Years\nc1,50\nc2,61\n")
    _write(f"{root}/PROJ-B/sub/cases.csv", "case_id,Age Years\nc3,70\n")
    _write(f"{root}/PROJ-B/notes.txt", "ignored")
    df = RD.read_folder(spark, root, "csv", schema="case_id string, `Age Years` double")
    out = df.withColumn("project", RD.project_from_path()).select("case_id", "project").collect()
    got = {r["case_id"]: r["project"] for r in out}
    assert got == {"c1": "PROJ-A", "c2": "PROJ-A", "c3": "sub"}


def test_read_any_by_suffix_and_load_tabular(spark, tmp_path):
    a = str(tmp_path / "a.csv")
    _write(a, "Case-ID,Label\n1,yes\n2,no\n2,no\n")
    b = str(tmp_path / "b.jsonl")
    _write(b, '{"Case-ID": 1, "BMI": 22.5}\n{"Case-ID": 3, "BMI": 30.1}\n')
    fa = RD.read_any(spark, a, schema="`Case-ID` int, Label string")
    fb = RD.read_any(spark, b, schema="`Case-ID` int, BMI double")
    union = RD.load_tabular([fa, fb], target="label")
    assert union.columns[-1] == "label" and union.count() == 4          # duplicate row dropped
    merged = RD.load_tabular([fa.dropDuplicates(), fb], merge_on=["Case-ID"], merge_how="outer")
    assert sorted(merged.columns) == ["bmi", "case_id", "label"]
    assert merged.count() == 3


def test_split_column_and_xy(spark):
    t = spark.createDataFrame([(1, "1")], "k int, label string")
    both = RD.with_split_column(t, t, t)
    assert sorted(r[0] for r in both.select("split").collect()) == ["test", "train", "val"]
    xy = RD.load_xy(both, "label")
    assert dict(xy.dtypes)["label"] == "int"


def test_partitioned_save_and_append_dedupe(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "k int, domain string, split string")
    out = str(tmp_path / "canon")
    SK.save(df, out, partition_by=["domain", "split"])
    back = spark.read.parquet(out)
    assert back.where(F.col("domain") == "a").count() == 1
    new = spark.createDataFrame([(2, "b", "test"), (3, "c", "val")], "k int, domain string, split string")
    merged = SK.append_dedupe(spark, out, new, str(tmp_path / "canon_v2"))
    assert merged.count() == 3
    row = SK.metrics_row(spark, {"auroc": 0.9, "n": 10})
    assert row.columns == ["auroc", "n"]
