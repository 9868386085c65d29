"""Composite jobs: raw-table preprocessing (M22), dataset alignment (M1) and
the one-row scientific report (M23).

Each composite is a chain of the operators, in the order the steps depend
on each other; data-dependent column drops are decided from one profile.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.functions import tokens as TK
from cohortlens.operators import canonical as C
from cohortlens.operators import clean as CL
from cohortlens.operators import explain as XP
from cohortlens.operators import features as FE
from cohortlens.operators import report as R
from cohortlens.operators import weights as W
from cohortlens.operators.ordered import collapse_rows


@dataclass
class Preprocessed:
    frame: DataFrame            # encoded rows with key, target and split
    encoder: FE.Encoder
    numeric: list
    categorical: list
    dropped: dict


def preprocess(df: DataFrame, target: str, key: str, task: str = "classification",
               cohort_cols: Sequence[str] = (), cohort_pattern: str = "colon|colorect",
               date_cols: Sequence[str] = (), null_threshold: float = 0.95, max_unique: int = 500,
               drop_constants: bool = True, seed: int = 42, protected: Sequence[str] = TK.PROTECTED_COLUMNS,
               numeric: Sequence[str] = (), categorical: Sequence[str] = (),
               train: float = 0.70, val: float = 0.15) -> Preprocessed:
    """M22 (§3 path 2): clean target -> dedupe rows -> cohort filter ->
    booleans -> dates -> missing tokens -> leakage -> ages -> target-related
    -> stage ordinal -> ids / nulls / cardinality / constants -> kinds ->
    split -> encoder fitted on train, applied to all rows.

    ``protected`` columns stay however many NULLs they have; ``numeric`` and
    ``categorical`` are hints that win over the schema."""
    out = CL.clean_binary_target(df, target) if task == "classification" else CL.clean_regression_target(df, target)
    out = CL.dedupe_rows(out, "case_key", target)
    if cohort_cols:
        out = CL.regex_cohort(out, cohort_cols, cohort_pattern)
    out = CL.coerce_boolean_like(out, target)
    out = CL.days_since_epoch(out, target, date_cols)
    out = CL.normalize_missing_tokens(out, target)
    out = CL.drop_leakage(out, target)
    out = CL.add_age_from_days(out, "mean_age_at_dx")
    out = CL.add_age_from_days(out, "dem_days_to_birth", "age_years", negate=True)
    if task != "classification":
        out = CL.drop_target_related(out, target)
    out = CL.ajcc_stage_ordinal(out)
    protect = [key, target]
    rep = CL.column_drop_report(out.drop(key), target, null_threshold, max_unique).collect()
    dropped = {}
    for r in rep:
        if r["column"] in protect or (r["reason"] == "constant" and not drop_constants) \
                or (r["reason"] == "high_null" and r["column"] in protected):
            continue
        dropped.setdefault(r["column"], r["reason"])
    out = out.drop(*dropped)
    kept = CL.drop_id_like(out, target).columns
    id_like = [c for c in out.columns if c not in kept and c != key]
    out = out.drop(*id_like)
    dropped.update({c: "id_like" for c in id_like})
    numeric, categorical = CL.infer_columns(out.drop(key), target, numeric, categorical)
    split = W.stratified_split(out, key, target, seed, train, val) if task == "classification" \
        else W.hash_split(out, key, seed, train, val)
    enc = FE.fit_encoder(split.where(F.col("split") == "train"), numeric, categorical)
    frame = enc.transform(split, keep=[key, target, "split"])
    return Preprocessed(frame, enc, numeric, categorical, dropped)


def align_datasets(a: DataFrame, b: DataFrame, key: str, seed: int = 42, drop_features: Sequence[str] = (),
                   blind_mode: str = "drop") -> DataFrame:
    """M1: two canonical domains -> blinded union -> stratified 70/15/15 split
    (exact, per label) as a ``split`` column; write with
    ``partitionBy("domain", "split")`` so later reads prune partitions."""
    union = C.align_union(a, b, drop_features, blind_mode)
    return W.stratified_split(union, key, "label", seed)


def scientific_report(scored: DataFrame, key: str, label: str, features: Sequence[str], scorer,
                      unlabeled: DataFrame, age_col: str, score_col: str = "score", n_repeats: int = 5,
                      top_k: int = 3, seed: int = 42, metric: str = "auprc", quantile: float = 0.9,
                      **columns: str) -> DataFrame:
    """One row — Brier, the top-k permutation importances by ``metric`` (auprc, auroc or brier), the age
    contrast and the twelve fields of the high-risk group of the unlabelled domain (``high_risk_`` before
    each; ``columns`` names bmi_col, ethnicity_col, race_col and sex_col)."""
    brier = scored.agg(F.avg(F.pow(F.col(score_col) - F.col(label).cast("double"), 2)).alias("brier"))
    imp = XP.permutation_importance(scored.select(key, label, *features), key, label, features, scorer,
                                    n_repeats, seed, metric)
    top = XP.top_features(imp, top_k).agg(F.sort_array(F.collect_list(F.struct("importance_mean", "feature")), False)
                                          .alias("top_importance"))   # k rows
    contrast = R.age_contrast(unlabeled, age_col, score_col)
    high = R.high_risk_group(unlabeled, score_col, quantile, age_col, **columns)
    high = high.select(*[F.col(c).alias(f"high_risk_{c}") for c in high.columns])
    return collapse_rows(brier, top, contrast, high).withColumn("metric", F.lit(metric))


def scientific_tables(unlabeled: DataFrame, key: str, age_col: str, bmi_col: str, score_col: str = "score",
                      n_boot: int = 300, seed: int = 42) -> dict[str, DataFrame]:
    """M23 tables beside the one row: the age x BMI grid, and mean risk with its interval by decade of age (20 to 120)."""
    a = F.col(age_col)
    decades = unlabeled.where((a >= 20) & (a <= 120)).withColumn(
        "age_decade", X.bin_expr(a, TK.DECADE_EDGES, TK.DECADE_LABELS))
    return {"age_bmi_grid": R.age_bmi_grid(unlabeled, age_col, bmi_col, score_col),
            "age_decades": R.bootstrap_mean_ci(decades, key, score_col, "age_decade", TK.DECADE_LABELS, n_boot, seed)}
