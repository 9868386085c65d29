"""Risk and descriptive tables: missingness, odds-ratio bins, mode targets,
2x2 risk statistics, age/sex pyramid and drift.

Each table is one or two aggregates over the cohort.  Only bounded results
reach the driver (three quartile edges per numeric feature).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import exprs as X
from cohortlens.functions import tokens as TK
from cohortlens.operators.ordered import collapse_rows, scalar, two_pass
from cohortlens.operators.selection import quantiles_wide


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


# ------------------------------------------------------------ missingness --

def missing_by_domain(df: DataFrame, cols: Sequence[str], domain_col: str = "domain") -> DataFrame:
    """(domain, feature, missing_pct, n): one aggregate, then unpivot."""
    cols = [c for c in cols if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        miss = X.is_missing(c, numeric=True) if _is_numeric(df, c) else F.col(c).isNull()
        aggs.append(F.avg(miss.cast("double")).alias(c))
    wide = df.groupBy(F.col(domain_col).cast("string").alias("domain")).agg(*aggs)
    return wide.unpivot(["domain", "n"], cols, "feature", "missing_pct") \
        .select("domain", "feature", "missing_pct", "n")


# ---------------------------------------------------------- odds tables ----

def _label_counts(label_col: str) -> list[Column]:
    y = F.col(label_col).cast("int")
    return [F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
            F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("neg")]


def positive_quartile_edges(df: DataFrame, feature: str, label_col: str = "label") -> list[float] | None:
    """Unique edges [-inf, q1, q2, q3, inf] from the positives' quartiles (merged
    when repeated); None when no positive has a value."""
    return positive_quartile_edges_many(df, [feature], label_col).get(feature)


def positive_quartile_edges_many(df: DataFrame, features: Sequence[str], label_col: str = "label") -> dict:
    """Quartile edges of several features from one distributed quantile job
    over stacked (feature, value) pairs of the positives; 3 numbers per
    feature reach the driver."""
    pos = df.where(F.col(label_col).cast("int") == 1)
    stacked = pos.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), _num(df, f).alias("v"))
                                             for f in features])).alias("e")).select("e.*")
    rows = quantiles_wide(stacked, "v", [0.25, 0.5, 0.75], ["q1", "q2", "q3"], ["feature"]).collect()
    out = {}
    for r in rows:
        if r["q1"] is not None:
            out[r["feature"]] = sorted({float("-inf"), r["q1"], r["q2"], r["q3"], float("inf")})
    return out


def _num(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("double") if _is_numeric(df, c) else X.to_number(c)


def numeric_odds_table(df: DataFrame, feature: str, label_col: str = "label", factor: float = 0.5,
                       edges: Sequence[float] | None = None) -> DataFrame:
    """Quartile-bin odds table of one feature (see :func:`numeric_odds_tables`)."""
    return numeric_odds_tables(df, [feature], label_col, factor,
                               {feature: list(edges)} if edges is not None else None)


def numeric_odds_tables(df: DataFrame, features: Sequence[str], label_col: str = "label", factor: float = 0.5,
                        edges: dict | None = None) -> DataFrame:
    """Quartile-bin odds tables — bins right-closed on the positives'
    quartiles; per bin n, pos, neg, pos_rate, smoothed OR against all other
    rows (NULL-valued rows included), weight ``1 + f tanh(ln OR)``; empty bins
    skipped.  All features are binned in one stacked aggregate."""
    if edges is None:
        df = two_pass(df, [*features, label_col])
        edges = positive_quartile_edges_many(df, features, label_col)
    edges = dict(edges)
    feats = [f for f in features if f in edges and len(edges[f]) >= 3]
    schema = "feature string, bin string, bin_low double, bin_high double, n bigint, pos bigint, " \
             "neg bigint, pos_rate double, odds_ratio double, weight double"
    if not feats:
        return df.sparkSession.createDataFrame([], schema)
    labels = {f: [f"Q{i + 1}" for i in range(len(edges[f]) - 1)] for f in feats}
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 X.bin_expr(_num(df, f), edges[f], labels[f], right=True, include_lowest=True).alias("bin"))
        for f in feats])).alias("e"), F.col(label_col).alias("_y")).select("e.*", "_y")
    per_bin = stacked.groupBy("feature", "bin").agg(*_label_counts("_y"))
    dim = df.sparkSession.createDataFrame(
        [(f, lab, float(edges[f][i]), float(edges[f][i + 1])) for f in feats for i, lab in enumerate(labels[f])],
        "feature string, bin string, bin_low double, bin_high double")
    odds = _odds_from_counts(per_bin, "bin", factor, group_col="feature").where(F.col("bin").isNotNull())
    return odds.join(F.broadcast(dim), ["feature", "bin"], "inner") \
        .select("feature", "bin", "bin_low", "bin_high", "n", "pos", "neg", "pos_rate", "odds_ratio", "weight")


def _odds_from_counts(per_key: DataFrame, key: str, factor: float, min_count: int = 0,
                      group_col: str | None = None) -> DataFrame:
    """Totals over every row (NULL key included) -> OR / weight per non-empty key."""
    if group_col:       # a few bins per feature
        every = Window.partitionBy(group_col)
        t = per_key.withColumn("_P", F.sum("pos").over(every)).withColumn("_N", F.sum("neg").over(every))
    else:               # any number of categories: two numbers
        total = per_key.agg(F.sum("pos"), F.sum("neg")).first()
        t = per_key.withColumn("_P", F.lit(total[0])).withColumn("_N", F.lit(total[1]))
    t = t.withColumn("n", F.col("pos") + F.col("neg")).where((F.col("n") > 0) & (F.col("n") >= min_count))
    orv = X.smoothed_odds_ratio("pos", "neg", F.col("_P") - F.col("pos"), F.col("_N") - F.col("neg"))
    keep = [group_col] if group_col else []
    return t.select(*keep, key, "n", "pos", "neg", (F.col("pos") / F.col("n")).alias("pos_rate"),
                    orv.alias("odds_ratio"), X.or_to_weight(orv, factor).alias("weight"))


def eda_category(c, include_unknown: bool) -> Column:
    """lower(trim(text)); nan/none/'' -> NULL, and 'unknown' too unless kept."""
    toks = list(TK.EDA_MISSING_TOKENS) + ([] if include_unknown else [TK.EDA_UNKNOWN_TOKEN])
    return X.token_to_null(c, toks)


def categorical_odds_table(df: DataFrame, feature: str, label_col: str = "label", factor: float = 0.5,
                           min_count: int = 0, include_unknown: bool = False) -> DataFrame:
    cat = eda_category(feature, include_unknown)
    per_cat = df.select(cat.alias("category"), F.col(label_col).alias("_y")) \
        .groupBy("category").agg(*_label_counts("_y"))
    out = _odds_from_counts(per_cat, "category", factor, min_count).where(F.col("category").isNotNull())
    return out.select(F.lit(feature).alias("feature"), "category", "n", "pos", "neg", "pos_rate",
                      "odds_ratio", "weight")


def mode_targets(df: DataFrame, numeric_tables: dict[str, DataFrame], numeric_edges: dict[str, list],
                 categorical_tables: dict[str, DataFrame], label_col: str = "label",
                 target_prob: float = 0.5) -> DataFrame:
    """Modal bin / category among positives and the logit scale that moves the
    base rate to ``target_prob``: k = (logit(target) - logit(base)) / ln(OR)
    when OR > 1, else reason 'mode_or<=1'.  Ties: the first bin, the smallest
    category."""
    y = F.col(label_col).cast("int")
    base = df.agg(F.avg(F.when(y == 1, 1.0).otherwise(0.0)).alias("base_pos_rate"))
    pos = df.where(y == 1)
    parts = []
    for feat, table in numeric_tables.items():
        edges = numeric_edges.get(feat)
        if not edges:
            continue
        labels = [f"Q{i + 1}" for i in range(len(edges) - 1)]
        b = pos.select(X.bin_expr(F.col(feat).cast("double"), edges, labels, right=True,
                                  include_lowest=True).alias("mode")).where(F.col("mode").isNotNull())
        cnt = b.groupBy("mode").agg(F.count(F.lit(1)).alias("_c"))
        top = cnt.agg(F.max_by("mode", F.struct(F.col("_c"), -F.substring("mode", 2, 3).cast("int")))
                      .alias("mode"))
        parts.append(top.join(table.select(F.col("bin").alias("mode"), "pos_rate", "odds_ratio"), "mode")
                     .select(F.lit(feat).alias("feature"), "mode", "pos_rate", "odds_ratio"))
    for feat, table in categorical_tables.items():
        c = pos.select(eda_category(feat, True).alias("mode")).where(F.col("mode").isNotNull())
        cnt = c.groupBy("mode").agg(F.count(F.lit(1)).alias("_c"))
        # ties -> smallest category: order by (count, reversed text rank)
        top = cnt.orderBy(F.col("_c").desc(), F.col("mode").asc()).limit(1)
        parts.append(top.join(table.select(F.col("category").alias("mode"), "pos_rate", "odds_ratio"), "mode")
                     .select(F.lit(feat).alias("feature"), "mode", "pos_rate", "odds_ratio"))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "feature string, mode string, mode_pos_rate double, mode_or double, scale_k double, "
                "reason string, base_pos_rate double, target_prob double")
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    allp = allp.withColumn("base_pos_rate", F.lit(scalar(base)).cast("double"))
    k = (F.lit(X.py_logit(target_prob)) - X.clamped_logit(F.col("base_pos_rate"))) / F.log("odds_ratio")
    return allp.select("feature", "mode", F.col("pos_rate").alias("mode_pos_rate"),
                       F.col("odds_ratio").alias("mode_or"),
                       F.when(F.col("odds_ratio") > 1, k).alias("scale_k"),
                       F.when(F.col("odds_ratio") > 1, F.lit(None).cast("string"))
                       .otherwise(F.lit("mode_or<=1")).alias("reason"),
                       "base_pos_rate", F.lit(float(target_prob)).alias("target_prob"))


# ------------------------------------------------------ 2x2 risk stats -----

@dataclass
class Exposure:
    """One risk-table feature.

    kind = 'bins' (one 2x2 per category, unexposed = every other row, NULL
    included), 'categorical' (rare -> 'other'; unexposed = other non-NULL
    rows), 'flag' (one category; unexposed = every other row).
    """
    feature: str
    category: Column            # category per row; NULL = none / not exposed
    kind: str = "categorical"


def risk_2x2(df: DataFrame, exposures: Sequence[Exposure], label_col: str = "label",
             min_count: int = 100, with_p_value: bool = False) -> DataFrame:
    """OR, RR, exposed/unexposed risk, risk difference and chi^2 per (feature,
    category).  Cells get +0.5 only when one of them is 0.  Rows are read once:
    each row emits one (feature, category) entry per feature, all features are
    counted in a single group-by, and the 'other' lump is built from counts."""
    y = F.col(label_col).cast("int")
    entries = F.array(*[F.struct(F.lit(e.feature).alias("f"), e.category.cast("string").alias("c"))
                        for e in exposures])
    counts = df.select(F.explode(entries).alias("e"), y.alias("_y")) \
        .groupBy(F.col("e.f").alias("feature"), F.col("e.c").alias("category")) \
        .agg(*_label_counts("_y")).withColumn("n", F.col("pos") + F.col("neg"))
    kinds = {e.feature: e.kind for e in exposures}
    kind_df = F.broadcast(df.sparkSession.createDataFrame(list(kinds.items()), "feature string, kind string"))
    counts = counts.join(kind_df, "feature")
    # categorical features: rare categories lumped into 'other'
    is_cat = F.col("kind") == "categorical"
    relabel = F.when(is_cat & F.col("category").isNotNull() & (F.col("n") < min_count), F.lit("other")) \
        .otherwise(F.col("category"))
    counts = counts.withColumn("category", relabel).groupBy("feature", "kind", "category") \
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    tot_all = counts.groupBy("feature").agg(
        F.sum("pos").alias("P_all"), F.sum("neg").alias("N_all"),
        F.sum(F.when(F.col("category").isNotNull(), F.col("pos")).otherwise(0)).alias("P_nn"),
        F.sum(F.when(F.col("category").isNotNull(), F.col("neg")).otherwise(0)).alias("N_nn"))
    t = counts.where(F.col("category").isNotNull()).join(tot_all, "feature")
    t = t.where(F.col("pos") + F.col("neg") >= min_count)
    P = F.when(F.col("kind") == "categorical", F.col("P_nn")).otherwise(F.col("P_all"))
    N = F.when(F.col("kind") == "categorical", F.col("N_nn")).otherwise(F.col("N_all"))
    t = t.select("feature", "category", F.col("pos").alias("a"), F.col("neg").alias("b"),
                 (P - F.col("pos")).alias("c"), (N - F.col("neg")).alias("d"))
    out = t.select("feature", "category", *risk_columns("a", "b", "c", "d"))
    if with_p_value:
        out = out.withColumn("p_value", chi2_p_value(F.col("chi2")))
    return out


def risk_columns(a, b, c, d) -> list[Column]:
    a, b, c, d = (F.col(v).cast("double") for v in (a, b, c, d))
    zero = F.least(a, b, c, d) == 0
    s = F.when(zero, F.lit(0.5)).otherwise(F.lit(0.0))
    aa, bb, cc, dd = a + s, b + s, c + s, d + s
    odds_e = F.when(bb > 0, aa / bb)
    odds_u = F.when(dd > 0, cc / dd)
    risk_e = F.when(aa + bb > 0, aa / (aa + bb))
    risk_u = F.when(cc + dd > 0, cc / (cc + dd))
    n = a + b + c + d
    denom = (a + b) * (c + d) * (a + c) * (b + d)
    return [
        (a + b).cast("bigint").alias("n_total"), a.cast("bigint").alias("n_pos"), b.cast("bigint").alias("n_neg"),
        F.when(odds_u > 0, odds_e / odds_u).alias("odds_ratio"),
        F.when(risk_u > 0, risk_e / risk_u).alias("risk_ratio"),
        risk_e.alias("risk_exposed"), risk_u.alias("risk_unexposed"), (risk_e - risk_u).alias("risk_diff"),
        F.when(denom != 0, n * F.pow(a * d - b * c, 2) / denom).alias("chi2"),
    ]


@F.pandas_udf(T.DoubleType())
def chi2_p_value(stat):  # pragma: no cover - runs in Python workers over a few result rows
    """Survival function of chi^2 with 1 degree of freedom: erfc(sqrt(x / 2))."""
    return stat.map(lambda x: None if x is None or x != x else math.erfc(math.sqrt(x / 2.0)))


def top_groups(risk: DataFrame, k: int = 10) -> DataFrame:
    """Top-k risk groups by odds ratio (ties by feature, category)."""
    return risk.orderBy(F.col("odds_ratio").desc_nulls_last(), "feature", "category").limit(k)


# -------------------------------------------------------------- pyramid ----

def age_sex_pyramid(df: DataFrame, age_col: str, sex_col: str) -> DataFrame:
    """8 left-closed age bins x sex: counts with every bin present, male negated."""
    spark = df.sparkSession
    edges, labels = TK.PYRAMID_EDGES, TK.PYRAMID_LABELS
    age = F.col(age_col).cast("double")
    sex = X.sex_display(F.col(sex_col))
    base = df.where(age.isNotNull() & F.col(sex_col).isNotNull() & (age >= 0) & (age <= 120)) \
        .select(X.bin_expr(age, edges, labels).alias("age_group"), sex.alias("sex"))
    counts = base.groupBy("age_group").agg(
        F.count(F.when(F.col("sex") == "Male", 1)).alias("male"),
        F.count(F.when(F.col("sex") == "Female", 1)).alias("female"))
    dim = F.broadcast(spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)],
                                            "bin_order int, age_group string"))
    return dim.join(counts, "age_group", "left").select(
        "bin_order", "age_group", (-F.coalesce("male", F.lit(0))).cast("bigint").alias("male_neg"),
        F.coalesce("female", F.lit(0)).cast("bigint").alias("female"))


# ---------------------------------------------------------------- drift ----

def numeric_drift(train: DataFrame, current: DataFrame, features: Sequence[str],
                  dedupe_train: bool = True) -> DataFrame:
    """Per feature: n, mean, population std, median, p10, p90 on both sides,
    mean_diff = input - train and Cohen's d = diff / sqrt((s1^2 + s2^2) / 2).
    The training side is de-duplicated (whole rows) first.  Both sides are
    stacked as (side, feature, value) so one aggregate and one quantile job
    cover everything."""
    if dedupe_train:
        train = train.dropDuplicates()
    def stack(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(f).alias("feature"),
                                                      F.col(f).cast("double").alias("v")) for f in features]))
                         .alias("e")).select("e.*")
    long = stack(train, "train").unionByName(stack(current, "input")) \
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
    basic = long.groupBy("side", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"),
                                                F.stddev_pop("v").alias("std"))
    q = quantiles_wide(long, "v", [0.5, 0.1, 0.9], ["median", "p10", "p90"], ["side", "feature"])
    per = basic.join(q, ["side", "feature"], "left")
    stats = ["n", "mean", "std", "median", "p10", "p90"]
    wide = per.groupBy("feature").pivot("side", ["train", "input"]).agg(*[F.first(c).alias(c) for c in stats])
    wide = wide.select("feature", *[F.col(f"{sd}_{c}") for sd in ("train", "input") for c in stats])
    diff = F.col("input_mean") - F.col("train_mean")
    pooled = F.sqrt((F.pow("train_std", 2) + F.pow("input_std", 2)) / 2)
    return wide.select("feature", "train_n", "input_n", "train_mean", "input_mean", diff.alias("mean_diff"),
                       F.when(pooled > 0, diff / pooled).alias("cohen_d"), "train_std", "input_std",
                       "train_median", "input_median", "train_p10", "input_p10", "train_p90", "input_p90")


def categorical_drift(train: DataFrame, current: DataFrame, features: Sequence[str],
                      dedupe_train: bool = True) -> DataFrame:
    """Share and count per category on both sides ('missing' is a category);
    pct_diff = input - train; the training side is de-duplicated first."""
    if dedupe_train:
        train = train.dropDuplicates()

    def side(df: DataFrame, tag: str) -> DataFrame:
        long = df.select(F.explode(F.array(*[F.struct(
            F.lit(f).alias("feature"),
            F.coalesce(X.norm_text(F.col(f)), F.lit("missing")).alias("category")) for f in features]))
            .alias("e")).select("e.*")
        cnt = long.groupBy("feature", "category").agg(F.count(F.lit(1)).alias(f"{tag}_n"))
        tot = long.groupBy("feature").agg(F.count(F.lit(1)).alias("_t"))
        return cnt.join(tot, "feature").select("feature", "category", f"{tag}_n",
                                               (F.col(f"{tag}_n") / F.col("_t")).alias(f"{tag}_pct"))
    j = side(train, "train").join(side(current, "input"), ["feature", "category"], "full_outer")
    return j.select("feature", "category",
                    F.coalesce("train_pct", F.lit(0.0)).alias("train_pct"),
                    F.coalesce("input_pct", F.lit(0.0)).alias("input_pct"),
                    (F.coalesce("input_pct", F.lit(0.0)) - F.coalesce("train_pct", F.lit(0.0))).alias("pct_diff"),
                    F.coalesce("train_n", F.lit(0)).cast("bigint").alias("train_n"),
                    F.coalesce("input_n", F.lit(0)).cast("bigint").alias("input_n"))


def describe_cohort(df: DataFrame, age_col: str, sex_col: str, label_col: str = "label") -> DataFrame:
    """n, mean/median/min/max age in years, sex counts, positive share (one row).

    Ages are days, and ``age_was_days`` true, where the column is called mean_age_at_dx or its median is above 200.
    """
    median = scalar(quantiles_wide(df, age_col, [0.5], ["m"]))      # one number
    days = age_col.lower() == "mean_age_at_dx" or (median is not None and median > 200)
    years = F.lit(365.25 if days else 1.0)
    age = F.col(age_col).cast("double") / years
    sex = X.sex_display(F.col(sex_col))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(age).alias("age_mean"), F.min(age).alias("age_min"),
                  F.max(age).alias("age_max"),
                  F.count(F.when(sex == "Male", 1)).alias("n_male"),
                  F.count(F.when(sex == "Female", 1)).alias("n_female"),
                  F.count(F.when(sex == "Unknown", 1)).alias("n_sex_unknown"),
                  F.avg((F.col(label_col).cast("int") == 1).cast("double")).alias("pos_share")) \
        .withColumns({"age_median": F.lit(median).cast("double") / years, "age_was_days": F.lit(days)})


def label_shares(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows and share of every label among the rows that have one."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()        # one row per label
    return counts.withColumn("share", F.col("n") / F.sum("n").over(every))
