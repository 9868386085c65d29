"""Nested case records: JSON ingest (S4), scalar projection (P14) and
flattening into keyed relations (S5), and table triage (S6).

Flattening is ``explode`` per array level, keys first; no record is ever
collected — each nested record is expanded where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import exprs as X
from cohortlens.sources.concatenated import read_concatenated


def read_nested_json(spark: SparkSession, path: str, schema: T.StructType, layout: str = "lines") -> DataFrame:
    """Nested JSON in four layouts.

    lines        one object per line (splittable; the scale path)
    array/object a JSON array or single object per file (``multiLine``)
    concatenated objects back to back, with or without separators, split over
    tasks like lines; a truncated or unparsable record fails the query
    (``concatenated.read_concatenated`` can report such records instead)
    """
    if layout == "lines":
        return spark.read.schema(schema).json(path)
    if layout in ("array", "object"):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return read_concatenated(spark, path, schema)


def parse_json_column(df: DataFrame, col: str, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """JSON text column -> struct fields (one record per row)."""
    return df.select(*keep, F.from_json(F.col(col), schema).alias("_r")).select(*keep, "_r.*")


def scalar_fields(schema: T.StructType, prefix: str = "", path: str = "") -> list[Column]:
    """Leaf scalars of a struct (nested structs walked, arrays skipped),
    named ``<prefix><leaf>``."""
    out = []
    for f in schema.fields:
        full = f"{path}.{f.name}" if path else f.name
        if isinstance(f.dataType, T.StructType):
            out += scalar_fields(f.dataType, prefix, full)
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(F.col(full).alias(f"{prefix}{f.name}"))
    return out


def coerce_yes_no(c: Column) -> Column:
    """P14 ``_coerce``: text yes/true -> 1, no/false -> 0, other values unchanged (as text)."""
    s = X.norm_text(c)
    return F.when(s.isin("yes", "true"), F.lit("1")).when(s.isin("no", "false"), F.lit("0")).otherwise(c.cast("string"))


def flatten_array(df: DataFrame, keys: Sequence[Column | str], array_col: str, prefix: str = "",
                  position: str | None = None) -> DataFrame:
    """One level: keys + scalar fields of each array element (outer explode
    would keep empty parents; like the source we emit only present elements)."""
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    elem_type = df.schema[array_col].dataType.elementType if "." not in array_col else None
    if position:
        base = df.select(*keys, F.posexplode(array_col).alias(position, "_e"))
        key_cols = [*[k for k in base.columns if k not in ("_e",)]]
    else:
        base = df.select(*keys, F.explode(array_col).alias("_e"))
        key_cols = [c for c in base.columns if c != "_e"]
    if elem_type is None:
        elem_type = base.schema["_e"].dataType
    if isinstance(elem_type, T.StructType):
        leaves = scalar_fields(elem_type, prefix, "_e")
    else:
        leaves = [F.col("_e").alias(prefix + "value")]
    return base.select(*key_cols, *leaves)


CASE_KEYS = ("case_submitter_id", "case_id")


def flatten_cases(cases: DataFrame) -> dict[str, DataFrame]:
    """Nested case records -> 9 relations keyed by (case_submitter_id,
    case_id[, diagnosis_id | follow_up_id]), keys first.

    ``cases`` holds case scalars, ``dem_``-prefixed demographics and
    ``project.project_id``; array fields give one relation each, and the
    second-level arrays (treatments, pathology details, molecular tests,
    other clinical attributes) carry their parent's id.
    """
    sch = cases.schema
    k = [F.col("submitter_id").alias("case_submitter_id"), F.col("case_id")]
    top = scalar_fields(T.StructType([f for f in sch.fields
                                      if f.name not in ("demographic", "project", "submitter_id", "case_id")]))
    out = {"cases": cases.select(*k, *top,
                                 *([F.col("project.project_id").alias("project_id")] if "project" in sch.names else []),
                                 *(scalar_fields(sch["demographic"].dataType, "dem_", "demographic")
                                   if "demographic" in sch.names else []))}
    for arr in ("exposures", "family_histories", "diagnoses", "follow_ups"):
        if arr in sch.names:
            out[arr] = flatten_array(cases, k, arr)
    second = {"diagnoses": ("diagnosis_id", ("treatments", "pathology_details")),
              "follow_ups": ("follow_up_id", ("molecular_tests", "other_clinical_attributes"))}
    for parent, (pid, children) in second.items():
        if parent not in sch.names:
            continue
        elem = sch[parent].dataType.elementType
        lvl = cases.select(*k, F.explode(parent).alias("_p"))
        for child in children:
            if child in elem.names:
                out[child] = flatten_array(lvl.select("case_submitter_id", "case_id",
                                                      F.col(f"_p.{pid}").alias(pid), F.col(f"_p.{child}").alias(child)),
                                           ["case_submitter_id", "case_id", pid], child)
    return out


def triage_report(tables: dict[str, DataFrame], keep_columns: Sequence[str], dataset: str = "dataset") -> DataFrame:
    """Keep tables holding any useful column (case-insensitive); report
    (dataset, table, rows, kept, matched_columns, reason).  Row counts are
    per-table aggregates unioned into one report."""
    keep = {c.lower() for c in keep_columns}
    parts = []
    for name, df in tables.items():
        matched = sorted(c for c in df.columns if c.lower() in keep)
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(dataset).alias("dataset"), F.lit(name).alias("table"), "rows",
            ((F.col("rows") > 0) & F.lit(bool(matched))).alias("kept"),
            F.lit(",".join(matched)).alias("matched_columns"),
            F.when(F.col("rows") == 0, F.lit("empty_table"))
            .when(F.lit(bool(matched)), F.lit("has_useful_columns")).otherwise(F.lit("no_useful_columns"))
            .alias("reason")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
