"""Score evaluation: exact ranking metrics, curves, threshold sweeps and choice.

All metrics are computed from aggregated tables:

* per distinct score ``(group, score, pos, neg)`` with range-bucketed running
  sums (:mod:`cohortlens.operators.ordered`) for AUROC, average precision and
  the ROC / PR point tables;
* per threshold bucket ``(bucket, domain, label)`` for the 101-threshold scan,
  so the raw rows are read once however many thresholds are asked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.ordered import collapse_rows, running_sums
from cohortlens.operators.selection import quantiles_wide


def _lab(label_col: str) -> Column:
    return F.col(label_col).cast("int")


def score_counts(df: DataFrame, label_col: str = "label", score_col: str = "score",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """(group, score, pos, neg) — one row per distinct score; partial aggregation map-side."""
    y = _lab(label_col)
    return (df.where(F.col(score_col).isNotNull() & y.isNotNull())
            .groupBy(*group_cols, F.col(score_col).cast("double").alias("score"))
            .agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                 F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("neg")))


def _cumulative(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str]) -> DataFrame:
    """Per distinct score: totals P, N and TP/FP of the rule ``score >= s``."""
    g = list(group_cols)
    sc = score_counts(df, label_col, score_col, g)
    cum = running_sums(sc, g, ["score"], ["pos", "neg"], totals=True) \
        .withColumnsRenamed({"tot_pos": "P", "tot_neg": "N"})
    return (cum.withColumn("tp", F.col("P") - F.col("cum_pos") + F.col("pos"))
               .withColumn("fp", F.col("N") - F.col("cum_neg") + F.col("neg")))


def auroc_ap(df: DataFrame, label_col: str = "label", score_col: str = "score",
             group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact AUROC (ties count one half) and average precision (step sum).

    NULL when a group holds one class only.  The AUROC numerator is an
    integer, so the value does not depend on summation order.
    """
    g = list(group_cols)
    cum = _cumulative(df, label_col, score_col, g)
    two_class = (F.first("P") > 0) & (F.first("N") > 0)
    aggs = [
        (F.first("P") + F.first("N")).alias("n"),
        F.first("P").alias("n_pos"),
        F.when(two_class, F.sum(F.col("pos") * (2 * F.col("cum_neg") - F.col("neg"))).cast("double")
               / (F.lit(2.0) * F.first("P") * F.first("N"))).alias("auroc"),
        F.when(two_class, F.sum(F.when(F.col("P") > 0, (F.col("pos") / F.col("P"))
                                       * (F.col("tp") / (F.col("tp") + F.col("fp"))))))
        .alias("auprc"),
    ]
    return cum.groupBy(*g).agg(*aggs) if g else cum.agg(*aggs)


def roc_points(df: DataFrame, label_col: str = "label", score_col: str = "score",
               group_cols: Sequence[str] = ()) -> DataFrame:
    """ROC curve table: one point per distinct score (rule ``score >= threshold``)."""
    cum = _cumulative(df, label_col, score_col, group_cols)
    return cum.select(*group_cols, F.col("score").alias("threshold"),
                      F.when(F.col("N") > 0, F.col("fp") / F.col("N")).alias("fpr"),
                      F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("tpr"))


def pr_points(df: DataFrame, label_col: str = "label", score_col: str = "score",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """Precision-recall table: one point per distinct score."""
    cum = _cumulative(df, label_col, score_col, group_cols)
    return cum.select(*group_cols, F.col("score").alias("threshold"),
                      F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("recall"),
                      (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def _threshold_metrics(tp, fp, p, n) -> list[Column]:
    """accuracy / precision / recall / F1 from counts; 0 on zero division."""
    tn = n - fp
    pred = tp + fp
    return [
        F.when(p + n > 0, (tp + tn) / (p + n)).alias("accuracy"),
        F.when(pred > 0, tp / pred).otherwise(F.lit(0.0)).alias("precision"),
        F.when(p > 0, tp / p).otherwise(F.lit(0.0)).alias("recall"),
        F.when(p + pred > 0, (2 * tp) / (p + pred)).otherwise(F.lit(0.0)).alias("f1"),
    ]


def confusion(df: DataFrame, threshold: float, label_col: str = "label", score_col: str = "score",
              pred_col: str | None = None) -> dict[str, Column]:
    y = _lab(label_col)
    pred = F.col(pred_col).cast("int") if pred_col else \
        F.when(F.col(score_col) >= F.lit(float(threshold)), 1).otherwise(0)
    return {
        "tp": F.sum(F.when((y == 1) & (pred == 1), 1).otherwise(0)).cast("bigint"),
        "fp": F.sum(F.when((y == 0) & (pred == 1), 1).otherwise(0)).cast("bigint"),
        "tn": F.sum(F.when((y == 0) & (pred == 0), 1).otherwise(0)).cast("bigint"),
        "fn": F.sum(F.when((y == 1) & (pred == 0), 1).otherwise(0)).cast("bigint"),
    }


def classification_metrics(df: DataFrame, threshold: float = 0.5, label_col: str = "label",
                           score_col: str = "score", domain_col: str | None = None,
                           all_label: str = "all", pred_col: str | None = None) -> DataFrame:
    """Counts and threshold metrics per domain plus one global row (ROLLUP, one pass)."""
    cc = confusion(df, threshold, label_col, score_col, pred_col)
    aggs = [F.count(F.lit(1)).alias("n")] + [v.alias(k) for k, v in cc.items()]
    if domain_col:
        out = df.rollup(domain_col).agg(*aggs, F.grouping(domain_col).alias("_grp"))
        out = out.select(F.when(F.col("_grp") == 1, F.lit(all_label))
                         .otherwise(F.col(domain_col).cast("string")).alias("domain"),
                         "n", *cc.keys())
    else:
        out = df.agg(*aggs).withColumn("domain", F.lit(all_label))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.select("domain", "n", "tp", "fp", "tn", "fn",
                      *_threshold_metrics(tp, fp, tp + fn, tn + fp),
                      F.lit(float(threshold)).alias("threshold"))


def brier(df: DataFrame, label_col: str = "label", score_col: str = "score",
          group_cols: Sequence[str] = ()) -> DataFrame:
    e = F.pow(F.col(score_col) - _lab(label_col), 2)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(e).alias("brier")]
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)


def regression_metrics(df: DataFrame, y_col: str, pred_col: str) -> DataFrame:
    """R^2, MAE, RMSE (R^2 NULL when the target is constant)."""
    y, p = F.col(y_col).cast("double"), F.col(pred_col).cast("double")
    base = df.where(y.isNotNull() & p.isNotNull())
    out = base.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - p)).alias("mae"),
                   F.avg(F.pow(y - p, 2)).alias("mse"), F.var_pop(y).alias("_var"))
    return out.select("n", F.when(F.col("_var") > 0, F.lit(1.0) - F.col("mse") / F.col("_var")).alias("r2"),
                      "mae", F.sqrt("mse").alias("rmse"))


def domain_gap(df: DataFrame, threshold: float, domain_col: str = "domain",
               score_col: str = "score") -> DataFrame:
    """Positive rate per domain at a threshold -> gap (max - min), min, max."""
    pred = F.when(F.col(score_col) >= F.lit(float(threshold)), 1.0).otherwise(0.0)
    rates = df.where(F.col(domain_col).isNotNull()).groupBy(domain_col).agg(F.avg(pred).alias("rate"))
    return rates.agg(F.count(F.lit(1)).alias("n_domains"),
                     F.when(F.count(F.lit(1)) > 1, F.max("rate") - F.min("rate")).otherwise(F.lit(0.0))
                     .alias("domain_pos_rate_gap"),
                     F.coalesce(F.min("rate"), F.lit(0.0)).alias("domain_pos_rate_min"),
                     F.coalesce(F.max("rate"), F.lit(0.0)).alias("domain_pos_rate_max"))


def _threshold_bucket(p: Column) -> Column:
    """Largest i in 0..100 with i * 0.01 <= p (the grid is ``i * 0.01``, so
    0.29 is below threshold 29 = 0.29000000000000004); -1 when none or NULL."""
    i0 = F.least(F.greatest(F.floor(p * 100).cast("int"), F.lit(-1)), F.lit(100))
    t0 = i0.cast("double") * F.lit(0.01)
    t1 = (i0 + 1).cast("double") * F.lit(0.01)
    return (F.when(p.isNull() | F.isnan(p), F.lit(-1))
            .when((i0 >= 0) & (t0 > p), i0 - 1)
            .when((i0 < 100) & (t1 <= p), i0 + 1)
            .otherwise(i0))


def threshold_scan(df: DataFrame, label_col: str = "label", score_col: str = "score",
                   domain_col: str | None = "domain", target_domain: str | None = None,
                   with_ranking: bool = True) -> DataFrame:
    """101 thresholds 0, 0.01, ..., 1 in one pass over the rows.

    Rows are counted per (threshold bucket, domain, label); suffix sums over
    the 102-bucket grid give every threshold's confusion matrix and the
    per-domain positive rates.
    """
    y = _lab(label_col)
    dom = F.col(domain_col).cast("string") if domain_col else F.lit(None).cast("string")
    base = df.where(y.isNotNull()).select(
        _threshold_bucket(F.col(score_col).cast("double")).alias("b"), dom.alias("d"), y.alias("y"))
    counts = base.groupBy("b", "d", "y").agg(F.count(F.lit(1)).alias("c"))
    cells = counts.select("d", "y").distinct()
    grid = cells.select("d", "y", F.explode(F.sequence(F.lit(-1), F.lit(100))).alias("b"))
    marked = counts.withColumnsRenamed({"b": "_b", "d": "_d", "y": "_y"})
    full = grid.join(marked, (F.col("b") == F.col("_b")) & F.col("d").eqNullSafe(F.col("_d")) & (F.col("y") == F.col("_y")),
                     "left").drop("_b", "_d", "_y").fillna(0, subset=["c"])
    suffix = Window.partitionBy("d", "y").orderBy(F.col("b").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = full.withColumn("ge", F.sum("c").over(suffix))          # rows with bucket >= b
    total = Window.partitionBy("d", "y")
    full = full.withColumn("tot", F.sum("c").over(total))
    per_dom = full.where(F.col("b") >= 0).groupBy("b", "d").agg(
        F.sum(F.when(F.col("y") == 1, F.col("ge")).otherwise(0)).alias("tp_d"),
        F.sum(F.when(F.col("y") == 0, F.col("ge")).otherwise(0)).alias("fp_d"),
        F.sum(F.when(F.col("y") == 1, F.col("tot")).otherwise(0)).alias("p_d"),
        F.sum(F.when(F.col("y") == 0, F.col("tot")).otherwise(0)).alias("n_d"))
    rate = (F.col("tp_d") + F.col("fp_d")) / (F.col("p_d") + F.col("n_d"))
    has_dom = F.col("d").isNotNull()
    n_dom = F.count(F.when(has_dom, F.lit(1)))
    agg = per_dom.groupBy("b").agg(
        F.sum("tp_d").alias("tp"), F.sum("fp_d").alias("fp"), F.sum("p_d").alias("P"),
        F.sum("n_d").alias("N"),
        F.when(n_dom > 1, F.max(F.when(has_dom, rate)) - F.min(F.when(has_dom, rate)))
        .otherwise(F.lit(0.0)).alias("domain_pos_rate_gap"),
        F.coalesce(F.min(F.when(has_dom, rate)), F.lit(0.0)).alias("domain_pos_rate_min"),
        F.coalesce(F.max(F.when(has_dom, rate)), F.lit(0.0)).alias("domain_pos_rate_max"),
        F.max(F.when(F.col("d") == F.lit(target_domain), rate)).alias("target_domain_pos_rate"))
    tp, fp = F.col("tp"), F.col("fp")
    cols = [(F.col("b").cast("double") * F.lit(0.01)).alias("threshold"),
            *_threshold_metrics(tp, fp, F.col("P"), F.col("N")),
            (tp + fp).cast("bigint").alias("pred_pos")]
    if domain_col:
        cols += ["domain_pos_rate_gap", "domain_pos_rate_min", "domain_pos_rate_max"]
        if target_domain is not None:
            cols.append("target_domain_pos_rate")
    out = agg.select(*cols)
    if with_ranking:
        rk = auroc_ap(df, label_col, score_col).first()   # two numbers
        out = out.withColumn("auroc", F.lit(rk["auroc"]).cast("double")) \
            .withColumn("auprc", F.lit(rk["auprc"]).cast("double"))
    return out


def choose_threshold(scan: DataFrame, metric: str = "f1", min_precision: float | None = None,
                     domain_penalty_weight: float = 0.0, min_threshold: float = 0.0,
                     max_threshold: float = 1.0, min_recall: float = 0.0,
                     target_pos_rate: float | None = None, target_weight: float = 0.0) -> DataFrame:
    """Pick one threshold row from a :func:`threshold_scan` table (101 rows).

    Bounds first; the minimum-recall rule is dropped when nothing meets it;
    for ``metric='recall'`` rows under ``min_precision`` are skipped; the
    score subtracts the domain-gap and target-rate penalties.  Ties keep the
    lowest threshold, except that for recall higher precision wins.  With no
    candidate the first scan row (threshold 0) is returned.
    """
    s = scan
    in_bounds = (F.col("threshold") >= F.lit(float(min_threshold))) & \
        (F.col("threshold") <= F.lit(float(max_threshold)))
    s = s.withColumn("_in", in_bounds)
    if min_recall > 0.0:
        ok = F.col("_in") & (F.col("recall") >= F.lit(float(min_recall)))
        # scan tables hold 101 rows: a global window over them is bounded
        any_ok = F.max(ok.cast("int")).over(Window.partitionBy())
        s = s.withColumn("_cand", F.when(any_ok == 1, ok).otherwise(F.col("_in")))
    else:
        s = s.withColumn("_cand", F.col("_in"))
    if metric == "recall" and min_precision is not None:
        s = s.withColumn("_cand", F.col("_cand") & (F.col("precision") >= F.lit(float(min_precision))))
    score = F.col(metric)
    if domain_penalty_weight > 0 and "domain_pos_rate_gap" in scan.columns:
        score = score - F.lit(float(domain_penalty_weight)) * F.col("domain_pos_rate_gap")
    if target_weight > 0 and target_pos_rate is not None and "target_domain_pos_rate" in scan.columns:
        pen = F.lit(float(target_weight)) * F.abs(F.col("target_domain_pos_rate") - F.lit(float(target_pos_rate)))
        score = F.when(F.col("target_domain_pos_rate").isNotNull() & ~F.isnan("target_domain_pos_rate"),
                       score - pen).otherwise(score)
    s = s.withColumn("selection_score", F.when(F.col("_cand"), score))
    order = [F.col("_cand").desc(), F.col("selection_score").desc()]
    if metric == "recall":
        order.append(F.when(F.col("_cand"), F.col("precision")).desc_nulls_last())
    order.append(F.col("threshold").asc())
    # no candidate: the lowest threshold (first scan row) is what is left at the top
    return s.orderBy(*order).limit(1).drop("_in", "_cand")


def score_quantiles(df: DataFrame, score_col: str = "score", group_cols: Sequence[str] = ("domain",)) -> DataFrame:
    """n, mean, median, p10, p25, p75, p90 per group (exact, distributed)."""
    g = list(group_cols)
    probs, names = [0.1, 0.25, 0.5, 0.75, 0.9], ["p10", "p25", "median", "p75", "p90"]
    q = quantiles_wide(df, score_col, probs, names, g)
    clean = df.where(F.col(score_col).isNotNull())
    basic = clean.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg(score_col).alias("mean")) if g else \
        clean.agg(F.count(F.lit(1)).alias("n"), F.avg(score_col).alias("mean"))
    if g:
        # each group once on either side, a NULL group too
        return collapse_rows(basic, q, group_cols=g).where("n IS NOT NULL").select(
            *g, "n", "mean", "median", "p10", "p25", "p75", "p90")
    return collapse_rows(basic, q).select("n", "mean", "median", "p10", "p25", "p75", "p90")
