"""Tabular sources.

Format is chosen by suffix; folders are scanned recursively by Spark itself
(``recursiveFileLookup`` + ``pathGlobFilter``), so listing and reading stay
on the cluster.  Schemas should be passed explicitly for CSV/JSON at scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens.operators import clean as CL

SUFFIXES = {".csv": "csv", ".jsonl": "json", ".ndjson": "json", ".json": "json", ".parquet": "parquet"}


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None,
             encoding: str = "UTF-8") -> DataFrame:
    """One CSV / JSONL / NDJSON / Parquet file (or folder of them) by suffix."""
    fmt = next((f for s, f in SUFFIXES.items() if path.lower().endswith(s)), "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("encoding", encoding) \
            .option("inferSchema", schema is None).csv(path)
    if fmt == "json":
        return reader.json(path)
    return reader.parquet(path)


def read_folder(spark: SparkSession, folder: str, fmt: str = "csv", schema: StructType | str | None = None,
                with_source: bool = True) -> DataFrame:
    """Recursive scan of one format; ``source_file`` names each row's file.
    Raises when nothing matches (Spark reports the empty path)."""
    suffix = {"csv": "*.csv", "json": "*.json*", "parquet": "*.parquet"}[fmt]
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", True).option("inferSchema", schema is None).csv(folder)
    elif fmt == "json":
        df = reader.json(folder)
    else:
        df = reader.parquet(folder)
    return df.withColumn("source_file", F.col("_metadata.file_path")) if with_source else df


def project_from_path(col: str = "source_file", pattern: str = r"/([^/]+)/[^/]+$") -> F.Column:
    """The project is the parent folder of each file."""
    return F.regexp_extract(F.col(col), pattern, 1)


def load_tabular(frames: Sequence[DataFrame], target: str | None = None, merge_on: Sequence[str] | None = None,
                 merge_how: str = "outer", keep_columns: Sequence[str] | None = None,
                 drop_dup_rows: bool = True, filter_never_col: str | None = None,
                 date_cols: Sequence[str] = (), drop_const: bool = False, drop_dup_cols: bool = False) -> DataFrame:
    """S3: several inputs -> one table: union by name (default) or an N-way key
    merge, then snake-case names, all-or-nothing numeric casts, listed date
    casts, optional never-diagnosed filter, constant / duplicate column drops,
    column subset, duplicate-row drop, target last."""
    if merge_on:
        from cohortlens.operators.joins import merge_on_keys
        df = merge_on_keys(list(frames), list(merge_on), merge_how)
    else:
        df = CL.union_by_name(*frames)
    df = CL.snake_columns(df)
    df = CL.numeric_cast_columns(df, ignore=[target] if target else [])
    if date_cols:
        df = CL.cast_datetimes(df, date_cols)
    if filter_never_col:
        df = CL.filter_never(df, filter_never_col)
    if drop_const:
        df = CL.drop_constant(df, target)
    if drop_dup_cols:
        df = CL.drop_duplicate_columns(df)
    if keep_columns:
        df = CL.keep_columns(df, keep_columns, target)
    if drop_dup_rows:
        df = df.dropDuplicates()
    if target and target in df.columns:
        df = df.select(*[c for c in df.columns if c != target], target)
    return df


def with_split_column(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """Three split tables as one table with a ``split`` column."""
    return train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")),
                                                                 allowMissingColumns=True) \
        .unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)


def load_xy(df: DataFrame, target: str = "label", task: str = "classification",
            domain_col: str = "domain") -> DataFrame:
    """Cast the label, keep the domain; regression drops NULL targets."""
    if task == "classification":
        return df.withColumn(target, F.col(target).try_cast("int"))
    return df.withColumn(target, F.col(target).try_cast("double")).where(F.col(target).isNotNull())
