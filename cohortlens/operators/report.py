"""Score reports over a scored cohort: binned summaries, grids, contrasts,
high-risk profile, external-truth evaluation and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.functions import tokens as TK
from cohortlens.operators.evaluate import score_quantiles
from cohortlens.operators.ordered import collapse_rows, scalar, two_pass
from cohortlens.operators.selection import exact_quantiles, quantiles_wide


def bin_dimension(spark, specs: Mapping[str, tuple]) -> DataFrame:
    rows = [(feat, i, lab) for feat, (_, labels) in specs.items() for i, lab in enumerate(labels)]
    return spark.createDataFrame(rows, "feature string, bin_order int, bin string")


def score_by_bins(df: DataFrame, score_col: str, specs: Mapping[str, tuple]) -> DataFrame:
    """n, mean and median score per fixed left-closed bin of several features;
    every bin is reported (n = 0 when empty).  One pass: rows are stacked as
    (feature, bin) pairs and grouped once."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), X.bin_expr(F.col(f), edges, labels).alias("bin"))
        for f, (edges, labels) in specs.items()])).alias("e"), F.col(score_col).alias("_s")) \
        .select("e.*", "_s").where(F.col("bin").isNotNull())
    basic = stacked.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("mean_score"))
    med = exact_quantiles(stacked, "_s", [0.5], ["feature", "bin"]).select(
        "feature", "bin", F.col("value").alias("median_score"))
    agg = basic.join(med, ["feature", "bin"], "left")
    dim = F.broadcast(bin_dimension(df.sparkSession, specs))
    return dim.join(agg, ["feature", "bin"], "left").select(
        "feature", "bin_order", "bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        "mean_score", "median_score")


def risk_concordance(df: DataFrame, score_col: str = "score", domain_col: str = "domain", unlabeled_domain: str = "unlabelled",
                     age_col: str = "age_years", bmi_col: str = "bmi_last") -> DataFrame:
    """M20 concordance tables, long: (section, bin_order, bin, n, mean, median, p10, p25, p75, p90).

    Section ``domain``: the score in every domain (a NULL domain is one; order NULL).  Sections
    ``unlabeled_age_bin`` and ``unlabeled_bmi_bin``: the unlabelled domain's scores by age and BMI bin, every
    bin reported; without such rows, or without the column, the section is left out.
    """
    names = ["n", "mean", "median", "p10", "p25", "p75", "p90"]
    out = score_quantiles(df, score_col, [domain_col]).select(
        F.lit("domain").alias("section"), F.lit(None).cast("int").alias("bin_order"),
        F.col(domain_col).cast("string").alias("bin"), *names)
    specs = {c: s for c, s in ((age_col, ("unlabeled_age_bin", TK.GRID_AGE_EDGES, TK.GRID_AGE_LABELS)),
                               (bmi_col, ("unlabeled_bmi_bin", TK.CONCORDANCE_BMI_EDGES, TK.CONCORDANCE_BMI_LABELS)))
             if c in df.columns}
    sub = df.where(F.col(domain_col).cast("string") == unlabeled_domain)
    if not specs or not sub.take(1):
        return out
    numeric = sub.select(F.col(score_col).cast("double").alias(score_col),
                         *[X.to_number(F.col(c).cast("string")).alias(c) for c in specs])
    bins = score_by_bins(numeric, score_col, {c: (edges, labels) for c, (_, edges, labels) in specs.items()})
    section = F.element_at(F.create_map(*[F.lit(x) for c, s in specs.items() for x in (c, s[0])]), F.col("feature"))
    bins = bins.select(section.alias("section"), F.col("bin_order").cast("int"), "bin", "n", F.col("mean_score").alias("mean"),
                       F.col("median_score").alias("median"), *[F.lit(None).cast("double").alias(p) for p in names[3:]])
    return out.unionByName(bins)


def age_bmi_grid(df: DataFrame, age_col: str, bmi_col: str, score_col: str) -> DataFrame:
    """Observed (age bin, BMI category) cells: n and mean score."""
    a = X.bin_expr(F.col(age_col), TK.GRID_AGE_EDGES, TK.GRID_AGE_LABELS)
    b = X.bin_expr(F.col(bmi_col), TK.GRID_BMI_EDGES, TK.GRID_BMI_LABELS)
    return df.select(a.alias("age_bin"), b.alias("bmi_cat"), F.col(score_col).alias("_s")) \
        .where(F.col("age_bin").isNotNull() & F.col("bmi_cat").isNotNull()) \
        .groupBy("age_bin", "bmi_cat").agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("mean_proba"))


def age_contrast(df: DataFrame, age_col: str, score_col: str, hi: float = 70, lo: float = 40) -> DataFrame:
    a, s = F.col(age_col), F.col(score_col)
    out = df.agg(F.avg(F.when(a >= hi, s)).alias("mean_ge70"), F.avg(F.when(a < lo, s)).alias("mean_lt40"))
    return out.withColumn("ratio", F.try_divide(F.col("mean_ge70"), F.col("mean_lt40")))


def high_risk_profile(df: DataFrame, score_col: str, q: float, numeric: Sequence[str],
                      categorical: Sequence[str]) -> DataFrame:
    """Rows at or above the score's q-quantile: count, score mean and median,
    means and medians of the numeric columns, modes of the categorical ones
    (NULLs ignored, ties -> smallest value).  The cut-off is an exact
    distributed quantile."""
    df = two_pass(df, [score_col, *numeric, *categorical])
    cutoff = scalar(quantiles_wide(df, score_col, [q], ["cutoff"]))   # one number
    top = df.where(F.col(score_col) >= F.lit(cutoff))
    aggs = [F.lit(cutoff).cast("double").alias("cutoff"), F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in numeric]
    aggs += [F.avg(score_col).alias("score_mean")]
    # all medians by one selection over stacked (column, value) pairs
    cols = [*numeric, score_col]
    stacked = top.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                             for c in cols])).alias("e")).select("e.*")
    med = exact_quantiles(stacked, "v", [0.5], ["column"])
    meds = [med.agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"{c}_median") for c in cols])]
    # value counts are combined before the shuffle; no buffer holds a column's values
    modes = [top.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_c"))
             .agg(F.min(F.struct((-F.col("_c")).alias("_c"), F.col(c).alias("v"))).getField("v").alias(f"{c}_mode"))
             for c in categorical]
    out = collapse_rows(top.agg(*aggs), *meds, *modes).withColumnRenamed(f"{score_col}_median", "score_median")
    order = ["cutoff", "n"] + [x for c in numeric for x in (f"{c}_mean", f"{c}_median")] + \
        ["score_mean", "score_median"] + [f"{c}_mode" for c in categorical]
    return out.select(*order)


def high_risk_group(df: DataFrame, score_col: str = "score", q: float = 0.9, age_col: str = "age_years",
                    bmi_col: str = "bmi_last", ethnicity_col: str = "ethnicity", race_col: str = "race",
                    sex_col: str = "sex") -> DataFrame:
    """The twelve fields of the high-risk group (one row): n, score cut-off, mean and median, age and BMI
    mean and median, and the modes of BMI category, ethnicity, race and sex.  An absent column gives NULLs."""
    def text(c: str):
        return F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")

    def number(c: str):
        return X.to_number(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("double")
    rows = df.select(F.col(score_col).cast("double").alias("proba"), number(age_col).alias("age"), number(bmi_col).alias("bmi"),
                     text(ethnicity_col).alias("ethnicity"), text(race_col).alias("race"), text(sex_col).alias("sex"))
    rows = rows.withColumn("bmi_cat", X.bin_expr(F.col("bmi"), TK.GRID_BMI_EDGES, TK.GRID_BMI_LABELS))
    p = high_risk_profile(rows, "proba", q, ["age", "bmi"], ["bmi_cat", "ethnicity", "race", "sex"])
    return p.select("n", F.col("cutoff").alias("proba_threshold"), F.col("score_mean").alias("proba_mean"),
                    F.col("score_median").alias("proba_median"), "age_mean", "age_median", "bmi_mean", "bmi_median",
                    "bmi_cat_mode", "ethnicity_mode", "race_mode", "sex_mode")


def prediction_vs_truth(pred: DataFrame, truth: DataFrame, key: str, pred_col: str = "prediction",
                        truth_col: str = "true_label") -> DataFrame:
    """Scored rows joined to external labels on the id: TP / FP / TN / FN (High = positive)."""
    j = pred.join(truth, key, "inner")
    p = (F.col(pred_col) == TK.HIGH_RISK_LABEL).cast("int")
    t = F.col(truth_col).cast("int")
    return j.agg(F.sum(F.when((p == 1) & (t == 1), 1).otherwise(0)).cast("bigint").alias("tp"),
                 F.sum(F.when((p == 1) & (t == 0), 1).otherwise(0)).cast("bigint").alias("fp"),
                 F.sum(F.when((p == 0) & (t == 0), 1).otherwise(0)).cast("bigint").alias("tn"),
                 F.sum(F.when((p == 0) & (t == 1), 1).otherwise(0)).cast("bigint").alias("fn"))


def bootstrap_mean_ci(df: DataFrame, key_col: str, value_col: str, bin_col: str, bins: Sequence[str],
                      n_boot: int = 300, seed: int = 42) -> DataFrame:
    """95% bootstrap interval of the mean per bin (Poisson bootstrap).

    Each row is drawn Poisson(1) times in replicate r, the draw coming from
    md5(key:r:seed), so the result is reproducible and needs no shuffle of
    rows: rows x replicates are folded into (bin, replicate) sums map-side.
    One-row bins get no interval; empty bins are kept with n = 0.
    """
    base = df.where(F.col(bin_col).isNotNull() & F.col(value_col).isNotNull())
    reps = base.select(F.col(bin_col).alias("bin"), F.col(value_col).cast("double").alias("v"),
                       F.col(key_col).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    w = X.poisson1(X.hash_fraction(F.col("k"), F.col("rep"), seed))
    rep_means = reps.select("bin", "rep", w.alias("w"), "v").groupBy("bin", "rep") \
        .agg(F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    # (bins x n_boot) replicate means: a bounded table, so Spark's exact percentile is safe here
    ci = rep_means.groupBy("bin").agg(F.percentile("m", 0.025).alias("ci_low"),
                                      F.percentile("m", 0.975).alias("ci_high"))
    basic = base.groupBy(F.col(bin_col).alias("bin")).agg(F.count(F.lit(1)).alias("n"),
                                                         F.avg(value_col).alias("mean_proba"))
    dim = F.broadcast(df.sparkSession.createDataFrame([(i, b) for i, b in enumerate(bins)],
                                                      "bin_order int, bin string"))
    out = dim.join(basic, "bin", "left").join(ci, "bin", "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return out.select("bin_order", F.col("bin").alias(bin_col), n.alias("n"), "mean_proba",
                      F.when(n > 1, F.col("ci_low")).alias("ci_low"),
                      F.when(n > 1, F.col("ci_high")).alias("ci_high"))
