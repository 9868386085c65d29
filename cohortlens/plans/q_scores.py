"""Score-metric queries on the PU cohort's deterministic pseudo-score."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.functions import tokens as TK
from cohortlens.operators import evaluate as E
from cohortlens.operators import report as R
from cohortlens.plans.catalog import register
from cohortlens.plans.standins import EVENTS_SQL, PU_SQL, event_cohort, pu_cohort, table, with_sql

W_PU = with_sql(PU_SQL)

# ---------------------------------------------------------------- ranking --


@register("auroc_ap", W_PU + """
, sc AS (SELECT score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
                CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM pu GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cp,
             sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cn,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc)
SELECT CAST(max(P) + max(N) AS BIGINT) AS n, CAST(max(P) AS BIGINT) AS n_pos,
       CAST(sum(pos * (2 * cn - neg)) AS DOUBLE) / (2.0 * max(P) * max(N)) AS auroc,
       sum((pos / P) * ((P - cp + pos) / ((P - cp + pos) + (N - cn + neg)))) AS auprc
FROM c""", doubles=["auroc", "auprc"])
def q_auroc_ap(spark, sf):
    """Exact AUROC with ties and average precision."""
    return E.auroc_ap(pu_cohort(spark, sf))


_CUM_SQL = W_PU + """
, sc AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg FROM pu GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc)
"""


@register("roc_points", _CUM_SQL + "SELECT score AS threshold, fp / N AS fpr, tp / P AS tpr FROM c",
          doubles=["threshold", "fpr", "tpr"])
def q_roc_points(spark, sf):
    """ROC curve table, one point per distinct score."""
    return E.roc_points(pu_cohort(spark, sf))


@register("pr_points", _CUM_SQL + "SELECT score AS threshold, tp / P AS recall, tp / (tp + fp) AS precision FROM c",
          doubles=["threshold", "recall", "precision"])
def q_pr_points(spark, sf):
    """Precision-recall table, one point per distinct score."""
    return E.pr_points(pu_cohort(spark, sf))


@register("brier", W_PU + """
SELECT domain, count(*) AS n, avg(pow(score - label, 2)) AS brier FROM pu GROUP BY domain""",
          doubles=["brier"])
def q_brier(spark, sf):
    """Brier score per domain."""
    return E.brier(pu_cohort(spark, sf), group_cols=["domain"])


@register("regression_metrics", with_sql(EVENTS_SQL) + """
SELECT count(*) AS n,
       CASE WHEN var_pop(value) > 0 THEN 1 - avg(pow(value - k, 2)) / var_pop(value) END AS r2,
       avg(abs(value - k)) AS mae, sqrt(avg(pow(value - k, 2))) AS rmse
FROM ev WHERE value IS NOT NULL AND k IS NOT NULL""", doubles=["r2", "mae", "rmse"])
def q_regression_metrics(spark, sf):
    """R^2, MAE, RMSE of the events' props.k as a predictor of value."""
    return E.regression_metrics(event_cohort(spark, sf), "value", "k")


_CONF_SQL = """
SELECT domain, n, tp, fp, tn, fn,
       CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy,
       CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
       {t} AS threshold
FROM (
  SELECT COALESCE(domain, 'all') AS domain, count(*) AS n,
    CAST(sum(CASE WHEN label = 1 AND score >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN label = 0 AND score >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN label = 0 AND NOT score >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN label = 1 AND NOT score >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM pu GROUP BY ROLLUP (domain)) s"""


@register("confusion_by_domain", W_PU + _CONF_SQL.format(t="0.5"),
          doubles=["accuracy", "precision", "recall", "f1", "threshold"])
def q_confusion_by_domain(spark, sf):
    """Confusion counts and threshold metrics per domain and overall."""
    return E.classification_metrics(pu_cohort(spark, sf), 0.5, domain_col="domain")


@register("domain_gap", W_PU + """
, r AS (SELECT domain, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS rate FROM pu GROUP BY domain)
SELECT count(*) AS n_domains, CASE WHEN count(*) > 1 THEN max(rate) - min(rate) ELSE 0.0 END AS domain_pos_rate_gap,
       min(rate) AS domain_pos_rate_min, max(rate) AS domain_pos_rate_max FROM r""",
          doubles=["domain_pos_rate_gap", "domain_pos_rate_min", "domain_pos_rate_max"])
def q_domain_gap(spark, sf):
    """Positive-rate gap between domains at t = 0.5."""
    return E.domain_gap(pu_cohort(spark, sf), 0.5)


_SCAN_SQL = W_PU + """
, t AS (SELECT i, CAST(i AS DOUBLE) * 0.01 AS threshold FROM range(0, 101) r(i)),
g AS (
  SELECT t.threshold,
    sum(CASE WHEN pu.label = 1 AND pu.score >= t.threshold THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN pu.label = 0 AND pu.score >= t.threshold THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN pu.label = 1 THEN 1 ELSE 0 END) AS P, sum(CASE WHEN pu.label = 0 THEN 1 ELSE 0 END) AS N
  FROM t CROSS JOIN pu GROUP BY t.threshold),
d AS (
  SELECT t.threshold, pu.domain, avg(CASE WHEN pu.score >= t.threshold THEN 1.0 ELSE 0.0 END) AS rate
  FROM t CROSS JOIN pu WHERE pu.domain IS NOT NULL GROUP BY t.threshold, pu.domain),
dg AS (
  SELECT threshold, CASE WHEN count(*) > 1 THEN max(rate) - min(rate) ELSE 0.0 END AS gap,
         min(rate) AS rmin, max(rate) AS rmax,
         max(CASE WHEN domain = 'unlabelled' THEN rate END) AS target_rate
  FROM d GROUP BY threshold)
SELECT g.threshold,
  CAST(tp + (N - fp) AS DOUBLE) / (P + N) AS accuracy,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / P ELSE 0.0 END AS recall,
  CASE WHEN P + tp + fp > 0 THEN CAST(2 * tp AS DOUBLE) / (P + tp + fp) ELSE 0.0 END AS f1,
  CAST(tp + fp AS BIGINT) AS pred_pos,
  dg.gap AS domain_pos_rate_gap, dg.rmin AS domain_pos_rate_min, dg.rmax AS domain_pos_rate_max,
  dg.target_rate AS target_domain_pos_rate
FROM g JOIN dg ON g.threshold = dg.threshold
"""

_SCAN_D = ["threshold", "accuracy", "precision", "recall", "f1", "domain_pos_rate_gap",
           "domain_pos_rate_min", "domain_pos_rate_max", "target_domain_pos_rate"]


@register("threshold_scan", _SCAN_SQL, doubles=_SCAN_D)
def q_threshold_scan(spark, sf):
    """101-threshold scan with domain gap and target-domain rate."""
    return E.threshold_scan(pu_cohort(spark, sf), target_domain="unlabelled", with_ranking=False)


@register("threshold_choice", "SELECT * FROM (" + _SCAN_SQL + """) s
WHERE threshold >= 0.1 AND threshold <= 0.9 AND recall >= 0.8
ORDER BY f1 - 0.3 * domain_pos_rate_gap DESC, threshold ASC LIMIT 1""", doubles=_SCAN_D)
def q_threshold_choice(spark, sf):
    """F1 with gap penalty .3, bounds [.1, .9], min recall .8."""
    scan = E.threshold_scan(pu_cohort(spark, sf), target_domain="unlabelled", with_ranking=False)
    return E.choose_threshold(scan, metric="f1", domain_penalty_weight=0.3, min_threshold=0.1,
                              max_threshold=0.9, min_recall=0.8).drop("selection_score")


@register("score_quantiles", W_PU + """
SELECT domain, count(*) AS n, avg(score) AS mean, quantile_cont(score, 0.5) AS median,
       quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.25) AS p25,
       quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.9) AS p90
FROM pu GROUP BY domain""", doubles=["mean", "median", "p10", "p25", "p75", "p90"])
def q_score_quantiles(spark, sf):
    """Score summary per domain (exact quantiles, distributed)."""
    return E.score_quantiles(pu_cohort(spark, sf))


# ---------------------------------------------------- unlabelled reports --

def _bins_case(col: str, edges, labels) -> str:
    parts = []
    for i, lab in enumerate(labels):
        lo, hi = float(edges[i]), float(edges[i + 1])
        lo_s = f"{col} >= {lo!r}" if lo != float("-inf") else "TRUE"
        hi_s = f"{col} < {hi!r}" if hi != float("inf") else "TRUE"
        parts.append(f"WHEN {lo_s} AND {hi_s} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


# n_chars / 100 plays age, n_lines plays BMI (re-scaled so the fixed bins are populated)
AGE_EXPR_SQL = "(n_chars / 100.0)"
BMI_EXPR_SQL = "(n_lines * 3.0)"


def _pu_report(spark, sf):
    pu = pu_cohort(spark, sf, with_lines=True)
    return pu.withColumn("age_years", F.col("n_chars") / 100.0).withColumn("bmi_last", F.col("n_lines") * 3.0)


_SCORE_BY_BIN_SQL = W_PU + """
, u AS (SELECT *, """ + AGE_EXPR_SQL + """ AS age_years, """ + BMI_EXPR_SQL + """ AS bmi_last FROM pu WHERE domain = 'unlabelled'),
dim AS (SELECT * FROM (VALUES {dims}) v(feature, bin_order, bin)),
obs AS (
  SELECT 'age_years' AS feature, {age_case} AS bin, score FROM u
  UNION ALL SELECT 'bmi_last', {bmi_case}, score FROM u),
agg AS (SELECT feature, bin, count(*) AS n, avg(score) AS mean_score, quantile_cont(score, 0.5) AS median_score
        FROM obs WHERE bin IS NOT NULL GROUP BY feature, bin)
SELECT dim.feature, dim.bin_order, dim.bin, CAST(COALESCE(agg.n, 0) AS BIGINT) AS n, agg.mean_score, agg.median_score
FROM dim LEFT JOIN agg ON dim.feature = agg.feature AND dim.bin = agg.bin"""

SBB_AGE = (TK.GRID_AGE_EDGES, TK.GRID_AGE_LABELS)
SBB_BMI = (TK.CONCORDANCE_BMI_EDGES, TK.CONCORDANCE_BMI_LABELS)


def _dims_sql():
    rows = [f"('age_years', {i}, '{b}')" for i, b in enumerate(SBB_AGE[1])] + \
           [f"('bmi_last', {i}, '{b}')" for i, b in enumerate(SBB_BMI[1])]
    return ", ".join(rows)


@register("score_by_bin", _SCORE_BY_BIN_SQL.format(
    dims=_dims_sql(), age_case=_bins_case("age_years", *SBB_AGE), bmi_case=_bins_case("bmi_last", *SBB_BMI)),
    doubles=["mean_score", "median_score"])
def q_score_by_bin(spark, sf):
    """A20 + J5: unlabelled scores by 6 age bins and 5 BMI bins, empty bins kept."""
    u = _pu_report(spark, sf).where(F.col("domain") == "unlabelled")
    return R.score_by_bins(u, "score", {"age_years": SBB_AGE, "bmi_last": SBB_BMI})


@register("bin_grid", W_PU + """
, u AS (SELECT *, """ + AGE_EXPR_SQL + """ AS age_years, """ + BMI_EXPR_SQL + """ AS bmi_last FROM pu WHERE domain = 'unlabelled')
SELECT age_bin, bmi_cat, n, mean_proba FROM (
  SELECT """ + _bins_case("age_years", TK.GRID_AGE_EDGES, TK.GRID_AGE_LABELS) + """ AS age_bin,
         """ + _bins_case("bmi_last", TK.GRID_BMI_EDGES, TK.GRID_BMI_LABELS) + """ AS bmi_cat,
         count(*) AS n, avg(score) AS mean_proba
  FROM u GROUP BY ALL) g WHERE age_bin IS NOT NULL AND bmi_cat IS NOT NULL""", doubles=["mean_proba"])
def q_bin_grid(spark, sf):
    """Age x BMI grid over observed cells of the unlabelled domain."""
    u = _pu_report(spark, sf).where(F.col("domain") == "unlabelled")
    return R.age_bmi_grid(u, "age_years", "bmi_last", "score")


@register("age_contrast", W_PU + """
, u AS (SELECT *, """ + AGE_EXPR_SQL + """ AS age_years FROM pu WHERE domain = 'unlabelled')
SELECT avg(CASE WHEN age_years >= 70 THEN score END) AS mean_ge70,
       avg(CASE WHEN age_years < 40 THEN score END) AS mean_lt40,
       avg(CASE WHEN age_years >= 70 THEN score END) / avg(CASE WHEN age_years < 40 THEN score END) AS ratio
FROM u""", doubles=["mean_ge70", "mean_lt40", "ratio"])
def q_age_contrast(spark, sf):
    """Mean score at age >= 70 vs < 40 and their ratio (unlabelled)."""
    u = _pu_report(spark, sf).where(F.col("domain") == "unlabelled")
    return R.age_contrast(u, "age_years", "score")


@register("high_risk_profile", W_PU + """
, u AS (SELECT *, """ + AGE_EXPR_SQL + """ AS age_years, """ + BMI_EXPR_SQL + """ AS bmi_last FROM pu WHERE domain = 'unlabelled'),
cut AS (SELECT quantile_cont(score, 0.9) AS c FROM u),
h AS (SELECT u.*, """ + _bins_case("bmi_last", TK.GRID_BMI_EDGES, TK.GRID_BMI_LABELS) + """ AS bmi_cat
      FROM u, cut WHERE u.score >= cut.c),
mb AS (SELECT bmi_cat FROM h WHERE bmi_cat IS NOT NULL GROUP BY bmi_cat ORDER BY count(*) DESC, bmi_cat ASC LIMIT 1),
ml AS (SELECT lang FROM h WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang ASC LIMIT 1),
ms AS (SELECT source FROM h WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source ASC LIMIT 1)
SELECT (SELECT c FROM cut) AS cutoff, count(*) AS n, avg(age_years) AS age_years_mean,
       quantile_cont(age_years, 0.5) AS age_years_median, avg(bmi_last) AS bmi_last_mean,
       quantile_cont(bmi_last, 0.5) AS bmi_last_median, avg(score) AS score_mean,
       quantile_cont(score, 0.5) AS score_median, (SELECT bmi_cat FROM mb) AS bmi_cat_mode,
       (SELECT lang FROM ml) AS lang_mode, (SELECT source FROM ms) AS source_mode
FROM h""", doubles=["cutoff", "age_years_mean", "age_years_median", "bmi_last_mean", "bmi_last_median",
                    "score_mean", "score_median"])
def q_high_risk_profile(spark, sf):
    """Profile of the top 10% unlabelled scores: n, cut-off, score mean / median,
    age and BMI means / medians, modes of BMI category, lang and source."""
    u = _pu_report(spark, sf).where(F.col("domain") == "unlabelled") \
        .withColumn("bmi_cat", X.bin_expr(F.col("bmi_last"), TK.GRID_BMI_EDGES, TK.GRID_BMI_LABELS))
    return R.high_risk_profile(u, "score", 0.9, numeric=["age_years", "bmi_last"],
                               categorical=["bmi_cat", "lang", "source"])


@register("prediction_vs_truth", W_PU + """
, pred AS (SELECT doc_id, CASE WHEN score >= 0.5 THEN 'Riesgo Alto' ELSE 'Riesgo Bajo' END AS prediction FROM pu)
SELECT CAST(sum(CASE WHEN p = 1 AND t = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN p = 1 AND t = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN p = 0 AND t = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(sum(CASE WHEN p = 0 AND t = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
FROM (SELECT CASE WHEN pred.prediction = 'Riesgo Alto' THEN 1 ELSE 0 END AS p, l.toxic AS t
      FROM pred JOIN labels l ON pred.doc_id = l.doc_id) j""")
def q_prediction_vs_truth(spark, sf):
    """J4 + A21: scored output joined to external true labels (labels.toxic) on the id."""
    pu = pu_cohort(spark, sf)
    pred = pu.select("doc_id", X.risk_label("score", 0.5).alias("prediction"))
    truth = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("true_label"))
    return R.prediction_vs_truth(pred, truth, "doc_id")
