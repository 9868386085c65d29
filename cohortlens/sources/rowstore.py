"""Append without repeated rows, to a table that is never rewritten.

Every row has a fingerprint, the digest of its non-NULL columns by name, so a row
is the same row before and after a column is added.  Rows lie in folders by the
first bits of their fingerprint.  An append deals its own rows, reads only the
fingerprint column of the folders they fall into, and adds the rows that are not
there yet as one more *batch*; nothing that exists is read whole or written again.

What the table holds is what its newest manifest lists: batches and the columns
of all of them.  A manifest is one file, written after its batch and committed
whole, so a run that fails in between leaves the table as it was (its batch is
listed nowhere), and of two appends at once one fails rather than undoing the other.

    <root>/batch-<id>/_part=<n>/...   rows and their fingerprints
    <root>/manifest/<version>/...     one JSON line
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import cut_lineage

FINGERPRINT, PART = "_fingerprint", "_part"
PARTS = 256


def fingerprint(columns) -> Column:
    """128-bit digest of a row's non-NULL columns; the order of columns and columns of NULLs make no difference."""
    named = F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(columns)])
    return F.unhex(F.md5(F.to_json(named, {"ignoreNullFields": "true"})))


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest, or None for a table that does not exist."""
    try:
        lines = spark.read.option("recursiveFileLookup", True).text(f"{root}/manifest").collect()   # one small line per append
    except AnalysisException:
        return None
    return max((json.loads(r["value"]) for r in lines), key=lambda m: m["version"], default=None)


def _batches(spark: SparkSession, root: str, m: dict, columns: list[T.StructField]) -> DataFrame | None:
    if not m["batches"]:
        return None
    schema = T.StructType([*columns, T.StructField(FINGERPRINT, T.BinaryType()), T.StructField(PART, T.IntegerType())])
    out = None      # a batch that lacks a column gives NULLs for it
    for b in m["batches"]:
        df = spark.read.schema(schema).parquet(f"{root}/{b}")
        out = df if out is None else out.unionByName(df)
    return out


def read_rows(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the table, with the columns of all batches."""
    m = manifest(spark, root)
    if m is None:
        raise FileNotFoundError(f"no table at {root}")
    fields = T.StructType.fromJson(m["schema"]).fields
    rows = _batches(spark, root, m, fields)
    if rows is None:
        return spark.createDataFrame([], T.StructType(fields))
    return rows.drop(FINGERPRINT, PART)


def append_rows(spark: SparkSession, root: str, new: DataFrame, parts: int = PARTS) -> int:
    """Add the rows of ``new`` that the table does not hold, each once; returns how many.

    Columns are matched by name; new ones are added, a changed type is an error.  The number of folders
    is set by the first append.
    """
    if {FINGERPRINT, PART} & set(new.columns):
        raise ValueError(f"{FINGERPRINT} and {PART} are names of the table's own columns")
    m = manifest(spark, root) or {"version": 0, "batches": [], "schema": {"type": "struct", "fields": []}, "parts": parts}
    old = {f.name: f for f in T.StructType.fromJson(m["schema"]).fields}
    for f in new.schema.fields:
        if f.name in old and old[f.name].dataType != f.dataType:
            raise TypeError(f"column {f.name} is {old[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    columns = [*old.values(), *(T.StructField(f.name, f.dataType) for f in new.schema.fields if f.name not in old)]
    rows = new.withColumn(FINGERPRINT, fingerprint(new.columns))
    head = F.conv(F.substring(F.hex(FINGERPRINT), 1, 8), 16, 10).cast("long")
    rows = cut_lineage(rows.withColumn(PART, (head % m["parts"]).cast("int")).dropDuplicates([FINGERPRINT]))
    known = _batches(spark, root, m, [])
    if known is not None:
        touched = [r[PART] for r in rows.select(PART).distinct().collect()]     # at most ``parts`` numbers
        rows = rows.join(known.where(F.col(PART).isin(touched)).select(PART, FINGERPRINT), [PART, FINGERPRINT], "left_anti")
    batch = f"batch-{uuid.uuid4().hex}"
    rows.repartition(PART).write.partitionBy(PART).parquet(f"{root}/{batch}")
    added = spark.read.schema(f"{FINGERPRINT} binary").parquet(f"{root}/{batch}").count()
    after = {"version": m["version"] + 1, "batches": [*m["batches"], *([batch] if added else [])], "parts": m["parts"],
             "schema": T.StructType(columns).jsonValue()}
    _commit(spark, root, after)
    return added


def _commit(spark: SparkSession, root: str, m: dict) -> None:
    """The table's new state: one file, there whole or not at all; an error if that version exists."""
    spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.mode("error").text(
        f"{root}/manifest/{m['version']}")
