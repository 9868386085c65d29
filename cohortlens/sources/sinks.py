"""Sinks (S8-S11): Parquet/CSV/JSON writes, per-group folders, append with
de-duplication into a fresh path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite-write; ``partition_by`` gives one folder per group
    (e.g. source_project, domain, split) so later reads prune partitions."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def append_dedupe(spark: SparkSession, existing_path: str | None, new: DataFrame, out_path: str) -> DataFrame:
    """S10 for a one-off copy: align columns with what exists, union, drop duplicates, write all to a
    new path (never overwrite the input being read).  ``rowstore.append_rows`` adds to a table in place."""
    if existing_path:
        old = spark.read.parquet(existing_path)
        merged = old.unionByName(new, allowMissingColumns=True).dropDuplicates()
    else:
        merged = new.dropDuplicates()
    merged.write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)


def metrics_row(spark: SparkSession, metrics: dict) -> DataFrame:
    """A one-row metric table from a small dict."""
    keys = sorted(metrics)
    return spark.createDataFrame([tuple(metrics[k] for k in keys)], keys)


def save_json_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def with_run_id(df: DataFrame, run_id: str) -> DataFrame:
    return df.withColumn("run_id", F.lit(run_id))
