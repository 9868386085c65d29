"""Entity roll-ups: one row per case from its child relations.

Every roll-up is a single ``groupBy(case key).agg(...)`` with built-in
aggregates (partial aggregation map-side, so a hot case key is combined in
every task before the shuffle).  "Last known value" is ``max_by`` over an
explicit order, not a sort of each group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.functions import tokens as TK


def exposure_rollup(df: DataFrame, key: str = "case_id", status_col: str = "tobacco_smoking_status",
                    pack_col: str | None = "pack_years_smoked", legacy: bool = False) -> DataFrame:
    """A1: any-positive smoking status per case (1 beats 0 beats NULL) and max pack-years."""
    aggs = [F.max(X.smoking_status(status_col, legacy)).alias("tobacco_smoking_status_any")]
    if pack_col:
        aggs.append(F.max(X.to_number(pack_col)).alias("pack_years_smoked_max"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def last_known(df: DataFrame, key: str, value_cols: Sequence[str], date_col: str | None,
               tiebreak: str | None = None, suffix: str = "_last") -> DataFrame:
    """A2: last non-NULL value per case by update time; undated rows sort
    last and so win (T3); equal times resolved by ``tiebreak`` (largest wins)."""
    dt = F.col(date_col).cast("timestamp") if date_col else F.lit(None).cast("timestamp")
    aggs = []
    for v in value_cols:
        val = X.to_number(v) if v in df.columns and df.schema[v].dataType.typeName() == "string" else F.col(v)
        # without a tiebreak column, equal times are resolved by the value itself (deterministic)
        tb = F.col(tiebreak) if tiebreak else val
        order = F.when(val.isNotNull(), F.struct(dt.isNull().alias("undated"), dt.alias("dt"), tb.alias("tb")))
        aggs.append(F.max_by(val, order).alias(f"{v}{suffix}"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def median_age_rollup(df: DataFrame, key: str = "case_id", days_col: str = "age_at_diagnosis",
                      name: str = "age_dx_years") -> DataFrame:
    """A3: median of diagnosis age in years (days / 365.25, 1 dp half-even).
    The values live on a 0.1-year grid, so Spark's exact median keeps a small
    value->count map even for a very large case."""
    years = X.round1_even(X.to_number(days_col) / 365.25)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.median(years).alias(name))


def keyword_flags(df: DataFrame, key: str, text_col: str, words: Mapping[str, str] | Sequence[str],
                  count_name: str = "n_rows") -> DataFrame:
    """Row count plus one any-flag per keyword found in the (lower-cased) text."""
    words = dict(words) if isinstance(words, Mapping) else {f"has_{w}": w for w in words}
    t = F.lower(F.col(text_col))
    aggs = [F.count(F.lit(1)).alias(count_name)]
    aggs += [F.max(F.coalesce(t.contains(w), F.lit(False)).cast("int")).alias(n) for n, w in words.items()]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def flag_rollup(df: DataFrame, key: str, aggs: Mapping[str, Column]) -> DataFrame:
    """Generic roll-up — name -> aggregate expression."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[e.alias(n) for n, e in aggs.items()])


def any_flag(cond: Column) -> Column:
    """max(cast(cond as int)) with NULL conditions counted as 0."""
    return F.max(F.coalesce(cond, F.lit(False)).cast("int"))


def entity_key(df: DataFrame, id_col: str = "case_id", alt_col: str = "submitter_id") -> DataFrame:
    """A4: case_key = case_id when the table has any, else the submitter id.
    A positional fallback is refused: a row number is not a stable key."""
    has_id = df.where(F.col(id_col).isNotNull()).limit(1).count() > 0 if id_col in df.columns else False
    if has_id:
        return df.withColumn("case_key", F.col(id_col).cast("string"))
    if alt_col in df.columns:
        return df.withColumn("case_key", F.col(alt_col).cast("string"))
    raise ValueError(f"no stable entity key: neither {id_col} nor {alt_col} holds values")


def attach(base: DataFrame, key: str, *rollups: DataFrame) -> DataFrame:
    """Left-join pre-aggregated roll-ups (one row per key, so no fan-out)."""
    out = base
    for r in rollups:
        out = out.join(r, key, "left")
    return out


def fill_from(df: DataFrame, target: str, source: str) -> DataFrame:
    """Fill a column from another (after a key join), e.g. age from the diagnosis median."""
    return df.withColumn(target, F.coalesce(F.col(target), F.col(source)))


def group_missing_report(df: DataFrame, group_col: str, cols: Sequence[str]) -> DataFrame:
    """A10: rows and missing rate per column for each group (e.g. source project)."""
    present = [c for c in cols if c in df.columns]
    return df.groupBy(group_col).agg(F.count(F.lit(1)).alias("rows"),
                                     *[F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in present])


def build_raw_dataset(cases: DataFrame, exposures: DataFrame | None, other: DataFrame | None,
                      diagnoses: DataFrame | None, label_value: int = 1, domain_value: str = "hcmi_tcga",
                      project_col: str = "project_id") -> DataFrame:
    """Roll-ups per case joined onto the cases, demographics cleaned,
    age from given years -> days to birth -> diagnosis median (intended key
    join, T2), constant label and domain."""
    key = "case_id"
    parts = []
    if exposures is not None:
        parts.append(exposure_rollup(exposures, key))
    if other is not None:
        parts.append(last_known(other, key, ["bmi", "height", "weight"], "updated_datetime",
                                tiebreak="_row" if "_row" in other.columns else None))
    if diagnoses is not None:
        parts.append(median_age_rollup(diagnoses, key))
    base = attach(cases, key, *parts)
    age_parts = []
    if "dem_age_at_index" in base.columns:
        age_parts.append(X.to_number("dem_age_at_index"))
    if "dem_days_to_birth" in base.columns:
        age_parts.append(X.days_to_years("dem_days_to_birth", negate=True))
    if "age_dx_years" in base.columns:
        age_parts.append(F.col("age_dx_years"))
    sex_src = "dem_gender" if "dem_gender" in base.columns else ("dem_sex_at_birth" if "dem_sex_at_birth" in base.columns else None)
    cols = [F.col(key)]
    if project_col in base.columns:
        cols.append(F.col(project_col).alias("source_project"))
    cols += [
        (F.coalesce(*age_parts) if age_parts else F.lit(None).cast("double")).alias("age_years"),
        (X.token_to_null(sex_src) if sex_src else F.lit(None).cast("string")).alias("sex"),
        (X.token_to_null("dem_race") if "dem_race" in base.columns else F.lit(None).cast("string")).alias("race"),
        (X.token_to_null("dem_ethnicity") if "dem_ethnicity" in base.columns else F.lit(None).cast("string"))
        .alias("ethnicity"),
    ]
    for c in ("tobacco_smoking_status_any", "pack_years_smoked_max", "bmi_last", "height_last", "weight_last"):
        cols.append(F.col(c) if c in base.columns else F.lit(None).cast("double").alias(c))
    return base.select(*cols, F.lit(label_value).alias("label"), F.lit(domain_value).alias("domain"))


def _flag(col: str, tokens) -> Column:
    return any_flag(X.norm_text(col).isin(list(tokens)))


def _last(val: str, order: Sequence[str]) -> Column:
    """Last non-NULL value in ``order`` (the relation's record order)."""
    o = F.struct(*[F.col(c) for c in order])
    return F.max_by(F.col(val), F.when(F.col(val).isNotNull(), o))


def flat_case_table(rel: Mapping[str, DataFrame], key: str = "case_key",
                    order_cols: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """A5-A9 (+ A4 key): one row per case from the flattened relations.

    exposures   max pack-years, any recorded smoking status
    family      history count, any positive relative
    diagnoses   count, any metastasis / prior malignancy, last AJCC stage, mean age
    treatments  count + five keyword flags
    follow-ups  any progression (forces label 1), max days to follow-up
    pathology   three invasion any-flags
    attributes  last height / weight / bmi
    molecular   test count
    Base label: 1 unless vital status is 'alive'; unknown status stays NULL
    (T5).  Positive answers accept text and numeric forms (T4).  ``order_cols``
    names each relation's record order for "last" values.
    """
    order_cols = dict(order_cols or {})
    cases = rel["cases"]
    out_cols = [F.col(key)]
    if "dem_vital_status" in cases.columns:
        vs = X.norm_text("dem_vital_status")
        out_cols.append(F.when(vs.isNull(), F.lit(None)).when(vs == "alive", F.lit(0)).otherwise(F.lit(1))
                        .cast("int").alias("base_label"))
    else:
        out_cols.append(F.lit(0).alias("base_label"))
    dtb = "dem_days_to_birth" if "dem_days_to_birth" in cases.columns else \
        ("days_to_birth" if "days_to_birth" in cases.columns else None)
    if "age_years" in cases.columns:
        out_cols.append(X.to_number("age_years").alias("age_years"))
    elif dtb:
        out_cols.append(X.days_to_years(dtb, negate=True).alias("age_years"))
    for src, name in (("dem_gender", "sex"), ("dem_ethnicity", "ethnicity"), ("disease_type", "disease_type"),
                      ("primary_site", "primary_site")):
        if src in cases.columns:
            out_cols.append(X.norm_text(src).alias(name))
    base = cases.select(*out_cols)
    parts = []
    if "exposures" in rel:
        ex = rel["exposures"]
        parts.append(flag_rollup(ex, key, {
            "pack_years_smoked_max": F.max(X.to_number("pack_years_smoked")),
            "tobacco_smoking_status_any": any_flag(F.col("tobacco_smoking_status").isNotNull())}))
    if "family_histories" in rel:
        parts.append(flag_rollup(rel["family_histories"], key, {
            "fam_hist_count": F.count("family_history_id"),
            "fam_hist_pos_any": _flag("relative_with_cancer_history", TK.FAMILY_POSITIVE)}))
    if "diagnoses" in rel:
        dx = rel["diagnoses"].withColumn("_stage", X.norm_text("ajcc_pathologic_stage"))
        parts.append(flag_rollup(dx, key, {
            "n_diagnoses": F.count("diagnosis_id"),
            "any_metastasis": _flag("metastasis_at_diagnosis", TK.METASTASIS_POSITIVE + ("1",)),
            "any_prior_malignancy": _flag("prior_malignancy", TK.YES_TOKENS),
            "last_ajcc_stage": _last("_stage", order_cols.get("diagnoses", ["diagnosis_id"])),
            "mean_age_at_dx": F.avg(X.to_number("age_at_diagnosis"))}))
    if "treatments" in rel:
        tx = rel["treatments"].withColumn("_t", F.coalesce(X.norm_text("treatment_type"), F.lit("")))
        aggs = {"n_treatments": F.count("treatment_id")}
        aggs.update({n: any_flag(F.col("_t").contains(w)) for n, w in TK.TREATMENT_WORDS.items()})
        parts.append(flag_rollup(tx, key, aggs))
    if "follow_ups" in rel:
        parts.append(flag_rollup(rel["follow_ups"], key, {
            "any_progression": _flag("progression_or_recurrence", TK.YES_TOKENS),
            "last_days_to_follow_up": F.max(X.to_number("days_to_follow_up"))}))
    if "pathology_details" in rel:
        parts.append(flag_rollup(rel["pathology_details"], key, {
            f"{c}_any": _flag(f"{c}_present", TK.YES_TOKENS) for c in ("vascular_invasion", "lymphatic_invasion",
                                                                        "perineural_invasion")}))
    if "other_clinical_attributes" in rel:
        oa = rel["other_clinical_attributes"].withColumns({c: X.to_number(c) for c in ("height", "weight", "bmi")})
        order = order_cols.get("other_clinical_attributes", ["updated_datetime"])
        parts.append(flag_rollup(oa, key, {f"{c}_last": _last(c, order) for c in ("height", "weight", "bmi")}))
    if "molecular_tests" in rel:
        parts.append(flag_rollup(rel["molecular_tests"], key, {"n_molecular_tests": F.count("molecular_test_id")}))
    out = attach(base, key, *parts)
    label = F.col("base_label")
    if "any_progression" in out.columns:
        label = F.when(F.col("any_progression") == 1, F.lit(1)).otherwise(label)
    return out.withColumn("label", label.cast("int")).drop("base_label")
