"""Risk-table queries: odds bins, mode targets, 2x2 statistics, pyramid, drift,
bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.functions import tokens as TK
from cohortlens.operators import report as R
from cohortlens.operators import risk as K
from cohortlens.plans.catalog import register
from cohortlens.plans.q_scores import AGE_EXPR_SQL, _bins_case
from cohortlens.plans.standins import EVENTS_SQL, PU_SQL, event_cohort, pu_cohort, with_sql

W_PU = with_sql(PU_SQL)
W_EV = with_sql(EVENTS_SQL)


def _odds_sql(feature: str) -> str:
    return f"""
SELECT '{feature}' AS feature, bin,
       CASE bin WHEN 'Q1' THEN CAST('-inf' AS DOUBLE) WHEN 'Q2' THEN q1 WHEN 'Q3' THEN q2 ELSE q3 END AS bin_low,
       CASE bin WHEN 'Q1' THEN q1 WHEN 'Q2' THEN q2 WHEN 'Q3' THEN q3 ELSE CAST('inf' AS DOUBLE) END AS bin_high,
       CAST(pos + neg AS BIGINT) AS n, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg,
       CAST(pos AS DOUBLE) / (pos + neg) AS pos_rate, orv AS odds_ratio,
       CASE WHEN orv > 0 THEN 1 + 0.5 * tanh(ln(orv)) ELSE 1.0 END AS weight
FROM (
  SELECT bin, pos, neg, q1, q2, q3,
         ((pos + 0.5) / (neg + 0.5)) / ((P - pos + 0.5) / (N - neg + 0.5)) AS orv
  FROM (
    SELECT bin, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg,
           any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3
    FROM (SELECT CASE WHEN {feature} <= q1 THEN 'Q1' WHEN {feature} <= q2 THEN 'Q2' WHEN {feature} <= q3 THEN 'Q3'
                      WHEN {feature} IS NOT NULL THEN 'Q4' END AS bin, label, q1, q2, q3
          FROM pu, (SELECT quantile_cont({feature}, 0.25) AS q1, quantile_cont({feature}, 0.5) AS q2,
                           quantile_cont({feature}, 0.75) AS q3 FROM pu WHERE label = 1) q)
    WHERE bin IS NOT NULL GROUP BY bin) c,
  (SELECT sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS P, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS N FROM pu) t
  WHERE pos + neg > 0) o"""


_ODDS_D = ["bin_low", "bin_high", "pos_rate", "odds_ratio", "weight"]


@register("numeric_odds_table", W_PU + _odds_sql("n_chars") + "\nUNION ALL" + _odds_sql("n_lines"), doubles=_ODDS_D)
def q_numeric_odds_table(spark, sf):
    """Quartile-bin odds tables (edges from the positives) for n_chars and n_lines."""
    return K.numeric_odds_tables(pu_cohort(spark, sf, with_lines=True), ["n_chars", "n_lines"])


def _cat_sql(feature: str, min_count: int) -> str:
    return f"""
SELECT '{feature}' AS feature, category, CAST(pos + neg AS BIGINT) AS n, CAST(pos AS BIGINT) AS pos,
       CAST(neg AS BIGINT) AS neg, CAST(pos AS DOUBLE) / (pos + neg) AS pos_rate, orv AS odds_ratio,
       CASE WHEN orv > 0 THEN 1 + 0.5 * tanh(ln(orv)) ELSE 1.0 END AS weight
FROM (
  SELECT category, pos, neg, ((pos + 0.5) / (neg + 0.5)) / ((P - pos + 0.5) / (N - neg + 0.5)) AS orv
  FROM (SELECT CASE WHEN lower(trim({feature})) IN ('nan', 'none', '', 'unknown') THEN NULL
                    ELSE lower(trim({feature})) END AS category,
               sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg
        FROM pu GROUP BY 1) c,
       (SELECT sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS P, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS N FROM pu) t
  WHERE category IS NOT NULL AND pos + neg > 0 AND pos + neg >= {min_count}) o"""


@register("categorical_odds_table", W_PU + _cat_sql("lang", 10) + "\nUNION ALL" + _cat_sql("source", 10),
          doubles=["pos_rate", "odds_ratio", "weight"])
def q_categorical_odds_table(spark, sf):
    """Categorical odds tables for lang and source (min count 10, 'unknown' dropped)."""
    pu = pu_cohort(spark, sf)
    return K.categorical_odds_table(pu, "lang", min_count=10).unionByName(
        K.categorical_odds_table(pu, "source", min_count=10))


@register("mode_targets", W_PU + """
, num AS (""" + _odds_sql("n_chars") + """),
cat AS (""" + _cat_sql("lang", 10) + """),
base AS (SELECT avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS b FROM pu),
mnum AS (SELECT CASE WHEN n_chars <= q1 THEN 'Q1' WHEN n_chars <= q2 THEN 'Q2' WHEN n_chars <= q3 THEN 'Q3' ELSE 'Q4' END AS mode
         FROM pu, (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2,
                          quantile_cont(n_chars, 0.75) AS q3 FROM pu WHERE label = 1) q
         WHERE label = 1 AND n_chars IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 ASC LIMIT 1),
mcat AS (SELECT lower(trim(lang)) AS mode FROM pu WHERE label = 1 AND lang IS NOT NULL
         AND lower(trim(lang)) NOT IN ('nan', 'none', '') GROUP BY 1 ORDER BY count(*) DESC, 1 ASC LIMIT 1),
m AS (SELECT 'n_chars' AS feature, mnum.mode, num.pos_rate, num.odds_ratio FROM mnum JOIN num ON num.bin = mnum.mode
      UNION ALL SELECT 'lang', mcat.mode, cat.pos_rate, cat.odds_ratio FROM mcat JOIN cat ON cat.category = mcat.mode)
SELECT feature, mode, pos_rate AS mode_pos_rate, odds_ratio AS mode_or,
       CASE WHEN odds_ratio > 1 THEN (0.0 - ln(least(greatest(b, 1e-6), 1 - 1e-6) / (1 - least(greatest(b, 1e-6), 1 - 1e-6)))) / ln(odds_ratio) END AS scale_k,
       CASE WHEN odds_ratio > 1 THEN NULL ELSE 'mode_or<=1' END AS reason, b AS base_pos_rate, 0.5 AS target_prob
FROM m, base""", doubles=["mode_pos_rate", "mode_or", "scale_k", "base_pos_rate", "target_prob"])
def q_mode_targets(spark, sf):
    """Modal bin / category among positives and the logit scale to reach p = 0.5."""
    pu = pu_cohort(spark, sf).cache()
    edges = K.positive_quartile_edges(pu, "n_chars")
    num = K.numeric_odds_table(pu, "n_chars", edges=edges)
    cat = K.categorical_odds_table(pu, "lang", min_count=10)
    return K.mode_targets(pu, {"n_chars": num}, {"n_chars": edges}, {"lang": cat}, target_prob=0.5)


# ------------------------------------------------------------ 2x2 tables --

def _event_exposures():
    return [
        K.Exposure("value_bin", X.bin_expr(F.col("value"), TK.RISK_AGE_EDGES, TK.RISK_AGE_LABELS), "bins"),
        K.Exposure("weekday", F.date_format("ts", "EEEE"), "categorical"),
        K.Exposure("high_k", F.when(F.col("k") >= 80, F.lit("yes")), "flag"),
        K.Exposure("risk_group", F.when((F.col("value") >= 60) & (F.col("k") >= 50), F.lit("value>=60 & k>=50")),
                   "flag"),
    ]


_RISK_SQL = W_EV + """
, e AS (SELECT label, """ + _bins_case("value", TK.RISK_AGE_EDGES, TK.RISK_AGE_LABELS) + """ AS value_bin,
               dayname(ts) AS weekday, CASE WHEN k >= 80 THEN 'yes' END AS high_k,
               CASE WHEN value >= 60 AND k >= 50 THEN 'value>=60 & k>=50' END AS risk_group FROM ev),
lng AS (SELECT 'value_bin' AS feature, 'bins' AS kind, value_bin AS category, label FROM e
        UNION ALL SELECT 'weekday', 'categorical', weekday, label FROM e
        UNION ALL SELECT 'high_k', 'flag', high_k, label FROM e
        UNION ALL SELECT 'risk_group', 'flag', risk_group, label FROM e),
cnt AS (SELECT feature, kind, category, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
               sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg FROM lng GROUP BY ALL),
lum AS (SELECT feature, kind,
               CASE WHEN kind = 'categorical' AND category IS NOT NULL AND pos + neg < 100 THEN 'other' ELSE category END AS category,
               sum(pos) AS pos, sum(neg) AS neg FROM cnt GROUP BY ALL),
tot AS (SELECT feature, sum(pos) AS pa, sum(neg) AS na,
               sum(CASE WHEN category IS NOT NULL THEN pos ELSE 0 END) AS pn,
               sum(CASE WHEN category IS NOT NULL THEN neg ELSE 0 END) AS nn FROM lum GROUP BY feature),
t AS (SELECT l.feature, l.category, CAST(l.pos AS DOUBLE) AS a, CAST(l.neg AS DOUBLE) AS b,
             CAST(CASE WHEN kind = 'categorical' THEN pn ELSE pa END - l.pos AS DOUBLE) AS c,
             CAST(CASE WHEN kind = 'categorical' THEN nn ELSE na END - l.neg AS DOUBLE) AS d
      FROM lum l JOIN tot ON l.feature = tot.feature WHERE l.category IS NOT NULL AND l.pos + l.neg >= 100),
s AS (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0.0 END AS sm FROM t),
r AS (SELECT feature, category, a, b, c, d, (a + sm) / (b + sm) AS oe, (c + sm) / (d + sm) AS ou,
             (a + sm) / (a + b + 2 * sm) AS re, (c + sm) / (c + d + 2 * sm) AS ru FROM s)
SELECT feature, category, CAST(a + b AS BIGINT) AS n_total, CAST(a AS BIGINT) AS n_pos, CAST(b AS BIGINT) AS n_neg,
       oe / ou AS odds_ratio, re / ru AS risk_ratio, re AS risk_exposed, ru AS risk_unexposed, re - ru AS risk_diff,
       CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) <> 0
            THEN (a + b + c + d) * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)) END AS chi2
FROM r"""
_RISK_D = ["odds_ratio", "risk_ratio", "risk_exposed", "risk_unexposed", "risk_diff", "chi2"]


@register("risk_2x2", _RISK_SQL, doubles=_RISK_D)
def q_risk_2x2(spark, sf):
    """OR, RR, risks, chi^2 for value bins, weekday, flags and a composite group."""
    return K.risk_2x2(event_cohort(spark, sf), _event_exposures(), min_count=100)


@register("top_groups", "SELECT * FROM (" + _RISK_SQL + ") x ORDER BY odds_ratio DESC NULLS LAST, feature, category LIMIT 10",
          doubles=_RISK_D)
def q_top_groups(spark, sf):
    """K2: top 10 risk groups by odds ratio."""
    return K.top_groups(K.risk_2x2(event_cohort(spark, sf), _event_exposures(), min_count=100), 10)


_SEX_SQL = """CASE WHEN event_type IN ('click', 'view') THEN ' M ' WHEN event_type IN ('signup', 'purchase')
    THEN 'Female' ELSE 'unknown' END"""


def _event_sex():
    return F.when(F.col("event_type").isin("click", "view"), F.lit(" M ")) \
        .when(F.col("event_type").isin("signup", "purchase"), F.lit("Female")).otherwise(F.lit("unknown"))


@register("age_sex_pyramid", W_EV + """
, p AS (SELECT value AS age, lower(trim(""" + _SEX_SQL + """)) AS s FROM ev WHERE value IS NOT NULL AND value >= 0 AND value <= 120),
b AS (SELECT """ + _bins_case("age", TK.PYRAMID_EDGES, TK.PYRAMID_LABELS) + """ AS age_group,
             CASE WHEN s IN ('m', 'male', 'masculino', 'man') THEN 'Male'
                  WHEN s IN ('f', 'female', 'femenino', 'woman') THEN 'Female' ELSE 'Unknown' END AS sex FROM p),
c AS (SELECT age_group, count(CASE WHEN sex = 'Male' THEN 1 END) AS male, count(CASE WHEN sex = 'Female' THEN 1 END) AS female
      FROM b GROUP BY age_group),
dim AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(TK.PYRAMID_LABELS)) + """) v(bin_order, age_group))
SELECT dim.bin_order, dim.age_group, CAST(-COALESCE(c.male, 0) AS BIGINT) AS male_neg,
       CAST(COALESCE(c.female, 0) AS BIGINT) AS female
FROM dim LEFT JOIN c ON dim.age_group = c.age_group""")
def q_age_sex_pyramid(spark, sf):
    """A37 + J5: 8 age bins x sex, every bin present, male negated."""
    ev = event_cohort(spark, sf).withColumn("sex", _event_sex())
    return K.age_sex_pyramid(ev, "value", "sex")


_SPLIT_TS = "2024-01-16 00:00:00"


def _drift_sides(spark, sf):
    ev = event_cohort(spark, sf)
    early = ev.where(F.col("ts") < F.lit(_SPLIT_TS).cast("timestamp"))
    late = ev.where(F.col("ts") >= F.lit(_SPLIT_TS).cast("timestamp"))
    return early, late


def _num_drift_side(tag: str, cond: str) -> str:
    return f"""
{tag} AS (
  SELECT feature, count(v) AS {tag}_n, avg(v) AS {tag}_mean, stddev_pop(v) AS {tag}_std,
         quantile_cont(v, 0.5) AS {tag}_median, quantile_cont(v, 0.1) AS {tag}_p10, quantile_cont(v, 0.9) AS {tag}_p90
  FROM (SELECT 'value' AS feature, value AS v FROM ev WHERE {cond} UNION ALL SELECT 'k', k FROM ev WHERE {cond}) x
  WHERE v IS NOT NULL GROUP BY feature)"""


@register("numeric_drift", W_EV + "," + _num_drift_side("train", f"ts < TIMESTAMP '{_SPLIT_TS}'") + "," +
          _num_drift_side("input", f"ts >= TIMESTAMP '{_SPLIT_TS}'") + """
SELECT COALESCE(train.feature, input.feature) AS feature, train_n, input_n, train_mean, input_mean,
       input_mean - train_mean AS mean_diff,
       CASE WHEN sqrt((pow(train_std, 2) + pow(input_std, 2)) / 2) > 0
            THEN (input_mean - train_mean) / sqrt((pow(train_std, 2) + pow(input_std, 2)) / 2) END AS cohen_d,
       train_std, input_std, train_median, input_median, train_p10, input_p10, train_p90, input_p90
FROM train FULL OUTER JOIN input ON train.feature = input.feature""",
          doubles=["train_mean", "input_mean", "mean_diff", "cohen_d", "train_std", "input_std", "train_median",
                   "input_median", "train_p10", "input_p10", "train_p90", "input_p90"])
def q_numeric_drift(spark, sf):
    """Drift of value and props.k, early (training) vs late (input) half of events."""
    early, late = _drift_sides(spark, sf)
    # with the key, de-duplicating needs no other column of the events
    cols = ["event_id", "value", "k"]
    return K.numeric_drift(early.select(*cols), late.select(*cols), ["value", "k"])


def _cat_drift_side(tag: str, src: str) -> str:
    return f"""
{tag} AS (
  SELECT feature, category, count(*) AS {tag}_n,
         CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY feature) AS {tag}_pct
  FROM (SELECT 'event_type' AS feature, COALESCE(lower(trim(event_type)), 'missing') AS category FROM {src}
        UNION ALL SELECT 'weekday', COALESCE(lower(trim(weekday)), 'missing') FROM {src}) x
  GROUP BY feature, category)"""


@register("categorical_drift", W_EV + f"""
, tr AS (SELECT DISTINCT user_id, event_type, dayname(ts) AS weekday FROM ev WHERE ts < TIMESTAMP '{_SPLIT_TS}'),
inp AS (SELECT user_id, event_type, dayname(ts) AS weekday FROM ev WHERE ts >= TIMESTAMP '{_SPLIT_TS}'),""" +
          _cat_drift_side("train", "tr") + "," + _cat_drift_side("input", "inp") + """
SELECT COALESCE(train.feature, input.feature) AS feature, COALESCE(train.category, input.category) AS category,
       COALESCE(train_pct, 0.0) AS train_pct, COALESCE(input_pct, 0.0) AS input_pct,
       COALESCE(input_pct, 0.0) - COALESCE(train_pct, 0.0) AS pct_diff,
       CAST(COALESCE(train_n, 0) AS BIGINT) AS train_n, CAST(COALESCE(input_n, 0) AS BIGINT) AS input_n
FROM train FULL OUTER JOIN input ON train.feature = input.feature AND train.category = input.category""",
          doubles=["train_pct", "input_pct", "pct_diff"])
def q_categorical_drift(spark, sf):
    """Category shares per side with 'missing' as a category; training side de-duplicated."""
    early, late = _drift_sides(spark, sf)
    cols = ["user_id", "event_type", F.date_format("ts", "EEEE").alias("weekday")]
    return K.categorical_drift(early.select(*cols), late.select(*cols), ["event_type", "weekday"])


def _poisson_sql(u: str) -> str:
    parts = " ".join(f"WHEN {u} < {c!r} THEN {k}" for k, c in enumerate(TK.POISSON1_CDF))
    return f"CASE {parts} ELSE {len(TK.POISSON1_CDF)} END"


_U_SQL = "(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST(rep AS VARCHAR) || ':42'), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0)"


@register("bootstrap_ci", W_PU + """
, u AS (SELECT doc_id, score, """ + AGE_EXPR_SQL + """ AS age FROM pu WHERE domain = 'unlabelled'),
b AS (SELECT doc_id, score, """ + _bins_case("age", TK.DECADE_EDGES, TK.DECADE_LABELS) + """ AS bin
      FROM u WHERE age >= 20 AND age <= 120),
r AS (SELECT bin, rep, score, """ + _poisson_sql(_U_SQL) + """ AS w FROM b, range(0, 300) t(rep) WHERE bin IS NOT NULL),
rm AS (SELECT bin, rep, CASE WHEN sum(w) > 0 THEN sum(w * score) / sum(w) END AS m FROM r GROUP BY bin, rep),
ci AS (SELECT bin, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM rm GROUP BY bin),
st AS (SELECT bin, count(*) AS n, avg(score) AS mean_proba FROM b WHERE bin IS NOT NULL GROUP BY bin),
dim AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(TK.DECADE_LABELS)) + """) v(bin_order, bin))
SELECT dim.bin_order, dim.bin AS age_decade, CAST(COALESCE(st.n, 0) AS BIGINT) AS n, st.mean_proba,
       CASE WHEN st.n > 1 THEN ci.lo END AS ci_low, CASE WHEN st.n > 1 THEN ci.hi END AS ci_high
FROM dim LEFT JOIN st ON dim.bin = st.bin LEFT JOIN ci ON dim.bin = ci.bin""",
          doubles=["mean_proba", "ci_low", "ci_high"])
def q_bootstrap_ci(spark, sf):
    """Poisson-bootstrap 95% CI (300 replicates) of the mean score per age decade."""
    u = pu_cohort(spark, sf).where(F.col("domain") == "unlabelled").withColumn("age", F.col("n_chars") / 100.0)
    u = u.where((F.col("age") >= 20) & (F.col("age") <= 120)) \
        .withColumn("age_decade", X.bin_expr(F.col("age"), TK.DECADE_EDGES, TK.DECADE_LABELS))
    return R.bootstrap_mean_ci(u, "doc_id", "score", "age_decade", TK.DECADE_LABELS, n_boot=300, seed=42)
