"""Canonicalisation of differently shaped sources into one table, lineage,
and the data-loss report.

Column choice is schema-level (driver side, from ``df.columns``); the row
work is one ``select`` per source and one ``unionByName``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.functions import tokens as TK
from cohortlens.operators.clean import blind_features, snake_columns
from cohortlens.operators.ordered import collapse_rows

CANONICAL_TYPES = {**{c: "double" for c in TK.CANONICAL_NUMERIC}, **{c: "string" for c in TK.CANONICAL_CATEGORICAL}}


def _first(df: DataFrame, candidates: Sequence[str]) -> str | None:
    for c in candidates:
        if c in df.columns:
            return c
    return None


def canonicalize(df: DataFrame, mapping: Mapping[str, Column | None], types: Mapping[str, str],
                 label: Column, domain: str) -> DataFrame:
    """Generic P4/P5: one select producing the canonical columns (absent -> typed NULL)."""
    cols = [(mapping.get(c) if mapping.get(c) is not None else F.lit(None)).cast(t).alias(c)
            for c, t in types.items()]
    return df.select(*cols, label.cast("int").alias("label"), F.lit(domain).alias("domain"))


def align_domain_a(df: DataFrame, domain: str = "hcmi_tcga", clean: bool = True) -> tuple[DataFrame, dict]:
    """Canonicalise the nested-case domain (already rolled up per case).

    Age: the ``age_years`` column if present, else -days_to_birth/365.25
    (1 dp), else mean diagnosis days/365.25 (1 dp).  Label NULL -> 1.
    Returns the frame and the canonical -> source mapping (lineage).
    """
    df = snake_columns(df)
    used: dict[str, list[str]] = {}
    if "age_years" in df.columns:
        age = X.to_number("age_years")
        used["age_years"] = ["age_years"]
    else:
        parts, srcs = [], []
        if "dem_days_to_birth" in df.columns:
            parts.append(X.days_to_years("dem_days_to_birth", negate=True))
            srcs.append("dem_days_to_birth")
        if "mean_age_at_dx" in df.columns:
            parts.append(X.days_to_years("mean_age_at_dx"))
            srcs.append("mean_age_at_dx")
        age = F.coalesce(*parts) if parts else None
        used["age_years"] = srcs
    mapping: dict[str, Column | None] = {"age_years": age}
    sources = {
        "height_last": ["height_last", "height"], "weight_last": ["weight_last", "weight"],
        "bmi_last": ["bmi_last", "bmi"], "tobacco_smoking_status_any": ["tobacco_smoking_status_any"],
        "pack_years_smoked_max": ["pack_years_smoked_max"],
        "sex": ["sex", "dem_gender", "gender", "dem_sex_at_birth"], "ethnicity": ["ethnicity", "dem_ethnicity"],
        "race": ["race", "dem_race"],
    }
    for canon, cands in sources.items():
        src = _first(df, cands)
        used[canon] = [src] if src else []
        if src is None:
            mapping[canon] = None
        elif canon in TK.CANONICAL_CATEGORICAL:
            mapping[canon] = X.token_to_null(src) if clean else F.col(src)
        else:
            mapping[canon] = X.to_number(src)
    label = F.coalesce(X.to_number("label").cast("int"), F.lit(1)) if "label" in df.columns else F.lit(1)
    return canonicalize(df, mapping, CANONICAL_TYPES, label, domain), used


def align_domain_b(df: DataFrame, domain: str = "nhanes", clean: bool = True) -> tuple[DataFrame, dict]:
    """P5: canonicalise the coded-survey domain (codes per FIXTURES §D).
    Label NULL -> 0; pack-years always NULL."""
    df = snake_columns(df)
    m: dict[str, Column | None] = {
        "age_years": X.to_number("ridageyr") if "ridageyr" in df.columns else None,
        "height_last": X.to_number("bmxht") if "bmxht" in df.columns else None,
        "weight_last": X.to_number("bmxwt") if "bmxwt" in df.columns else None,
        "bmi_last": X.to_number("bmxbmi") if "bmxbmi" in df.columns else None,
        "tobacco_smoking_status_any": X.coded_smoker(
            F.col("smq020") if "smq020" in df.columns else F.lit(None),
            F.col("smq040") if "smq040" in df.columns else F.lit(None)),
        "pack_years_smoked_max": None,
        "sex": X.coded_sex("riagendr") if "riagendr" in df.columns else None,
        "ethnicity": X.coded_ethnicity(F.col("ridreth3") if "ridreth3" in df.columns else F.lit(None)),
        "race": X.coded_race("ridreth3") if "ridreth3" in df.columns else None,
    }
    used = {"age_years": ["ridageyr"], "height_last": ["bmxht"], "weight_last": ["bmxwt"], "bmi_last": ["bmxbmi"],
            "tobacco_smoking_status_any": ["smq020", "smq040"], "pack_years_smoked_max": [],
            "sex": ["riagendr"], "ethnicity": ["ridreth3"], "race": ["ridreth3"]}
    label = F.coalesce(X.to_number("label").cast("int"), F.lit(0)) if "label" in df.columns else F.lit(0)
    out = canonicalize(df, m, CANONICAL_TYPES, label, domain)
    if clean:
        out = out.withColumns({c: X.token_to_null(c) for c in TK.CANONICAL_CATEGORICAL})
    return out, {k: [s for s in v if s in df.columns] for k, v in used.items()}


def align_union(a: DataFrame, b: DataFrame, drop_features: Sequence[str] = (), blind_mode: str = "drop") -> DataFrame:
    """M1 core: blind listed features in both domains, then union by name."""
    a2, b2 = blind_features(a, drop_features, blind_mode), blind_features(b, drop_features, blind_mode)
    return a2.unionByName(b2, allowMissingColumns=True)


def lineage_table(spark, mappings: Mapping[str, Mapping[str, Sequence[str]]], created: Sequence[str] = ("label", "domain"),
                  dropped: Sequence[str] = (), action: str = "drop") -> DataFrame:
    """(domain, column, sources, created, action) — the schema sidecar as a table."""
    rows = []
    for dom, m in mappings.items():
        for col, srcs in m.items():
            rows.append((dom, col, list(srcs), False, "blinded_" + action if col in dropped else "kept"))
        for col in created:
            rows.append((dom, col, [], True, "created"))
    return spark.createDataFrame(rows, "domain string, column string, sources array<string>, created boolean, "
                                       "action string")


def loss_report(raw: DataFrame, aligned: DataFrame, dataset: str, protected: Sequence[str],
                null_checks: Mapping[str, Sequence[str]]) -> DataFrame:
    """Data-loss report for one dataset — five stage rows and a null
    analysis per logical field (first existing source column; text tokens
    count as missing).  Two aggregates: one over the raw rows, one over the
    aligned rows."""
    spark = raw.sparkSession
    prot = [c for c in protected if c in aligned.columns]
    checks = {name: _first(raw, cands) for name, cands in null_checks.items()}
    raw_aggs = [F.count(F.lit(1)).alias("_n")]
    for name, src in checks.items():
        if src is not None:
            numeric = raw.schema[src].dataType.typeName() in ("double", "float", "integer", "long", "short",
                                                                "decimal", "byte")
            raw_aggs.append(F.count(F.when(X.is_missing(src, numeric=numeric), 1)).alias(f"m_{name}"))
    r = raw.agg(*raw_aggs)
    complete = F.lit(True)
    for c in prot:
        complete = complete & F.col(c).isNotNull()
    a = aligned.agg(F.count(F.lit(1)).alias("_a"), F.count(F.when(complete, 1)).alias("_c"))
    both = collapse_rows(r, a)
    L = F.lit
    nb = L(None).cast("bigint")

    def row(stage, column, total, after, lost, mc, mp, reason, source):
        return F.struct(L(dataset).alias("dataset"), L(stage).alias("stage"), L(column).alias("column"),
                        total.cast("bigint").alias("rows_total"), after.cast("bigint").alias("rows_after"),
                        lost.cast("bigint").alias("rows_lost"), mc.cast("bigint").alias("missing_count"),
                        mp.cast("double").alias("missing_pct"), L(reason).alias("reason"),
                        L(source).alias("source_column"))
    n, na, nc = F.col("_n"), F.col("_a"), F.col("_c")
    rows = [
        row("raw_load", "", n, n, L(0), nb, L(None), "load_csv", ""),
        row("after_align_filter", "", n, na, n - na, nb, L(None), "align_and_reindex", ""),
        row("after_normalize_categories", "", na, na, L(0), nb, L(None), "normalize_categories", ""),
        row("after_dropna_protected", ",".join(prot), na, nc, na - nc, nb, L(None), "dropna_any_protected", ""),
        row("merge_audit", "", n, n, L(0), nb, L(None), "no_merge_in_align", ""),
    ]
    for name, src in checks.items():
        if src is None:
            rows.append(row("null_analysis", name, n, nb, nb, nb, L(None), "column_missing_in_source", ""))
        else:
            m = F.col(f"m_{name}")
            rows.append(row("null_analysis", name, n, n - m, nb, m,
                            F.when(n > 0, m / n).otherwise(L(0.0)), "missing_or_token", src))
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def align_short_a(df: DataFrame, domain: str = "hcmi_tcga") -> DataFrame:
    """Short domain-A variant — no category cleaning."""
    return align_domain_a(df, domain, clean=False)[0]


def align_short_b(df: DataFrame, domain: str = "nhanes", diagnosis_col: str = "mcq220") -> DataFrame:
    """Short domain-B variant — rows pre-filtered to never diagnosed
    (F1 on the diagnosis question), no category cleaning."""
    from cohortlens.operators.clean import filter_never
    return align_domain_b(filter_never(snake_columns(df), diagnosis_col), domain, clean=False)[0]
