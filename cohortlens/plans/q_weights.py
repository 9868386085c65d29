"""Weighting, split, PU, missingness-injection, prior and encoder queries on
the PU cohort (n_chars / 100 plays age, lang plays ethnicity, en = smoker)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import features as FE
from cohortlens.operators import weights as W
from cohortlens.plans.catalog import register
from cohortlens.plans.standins import PU_SQL, pu_cohort, with_sql


def pu_features(spark, sf):
    pu = pu_cohort(spark, sf)
    smoker = F.when(F.col("lang") == "en", F.lit(1.0)).when(F.col("lang") == "de", F.lit(None).cast("double")) \
        .otherwise(F.lit(0.0))
    return pu.select("doc_id", "label", "domain", "score", "lang", "source",
                     (F.col("n_chars") / 100.0).alias("age_years"), smoker.alias("tobacco_smoking_status_any"),
                     F.col("lang").alias("ethnicity"))


FEAT_SQL = with_sql(PU_SQL) + """
, pf AS (SELECT doc_id, label, domain, score, lang, source, n_chars / 100.0 AS age_years,
                CASE WHEN lang = 'en' THEN 1.0 WHEN lang = 'de' THEN NULL ELSE 0.0 END AS tobacco_smoking_status_any,
                lang AS ethnicity FROM pu)
"""


def _h(parts: str) -> str:
    return f"(CAST(('0x' || substr(md5({parts}), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0)"


@register("class_weights", FEAT_SQL + """
, c AS (SELECT label, count(*) AS nc FROM pf GROUP BY label),
t AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
SELECT pf.doc_id, pf.label, CASE WHEN t.k >= 2 THEN CAST(t.n AS DOUBLE) / (t.k * c.nc) ELSE 1.0 END AS class_weight
FROM pf JOIN c ON pf.label = c.label, t""", doubles=["class_weight"])
def q_class_weights(spark, sf):
    """M5: balanced class weights n / (k n_c) per row."""
    return W.class_weights(pu_features(spark, sf).select("doc_id", "label"))


@register("risk_weights", FEAT_SQL + """
SELECT doc_id, 1.0 + 1.5 * ((CASE WHEN age_years >= 60 THEN 1.0 ELSE 0.0 END)
                          + (CASE WHEN tobacco_smoking_status_any = 1 THEN 1.0 ELSE 0.0 END)) / 2.0 AS risk_weight
FROM pf""", doubles=["risk_weight"])
def q_risk_weights(spark, sf):
    """M6: 1 + f * (share of risk markers present: age >= 60, smoker)."""
    df = pu_features(spark, sf).select("doc_id", "age_years", "tobacco_smoking_status_any")
    return W.risk_weights(df, min_age=60, factor=1.5).select("doc_id", "risk_weight")


@register("combined_weights", FEAT_SQL + """
, c AS (SELECT label, count(*) AS nc FROM pf GROUP BY label), t AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
SELECT doc_id, (1.0 + 1.5 * ((CASE WHEN age_years >= 60 THEN 1.0 ELSE 0.0 END)
                + (CASE WHEN tobacco_smoking_status_any = 1 THEN 1.0 ELSE 0.0 END)) / 2.0)
       * CASE WHEN t.k >= 2 THEN CAST(t.n AS DOUBLE) / (t.k * c.nc) ELSE 1.0 END AS sample_weight
FROM pf JOIN c ON pf.label = c.label, t""", doubles=["sample_weight"])
def q_combined_weights(spark, sf):
    """M9: risk and class weights as one; a weight column that is absent or NULL counts as 1."""
    df = pu_features(spark, sf).select("doc_id", "label", "age_years", "tobacco_smoking_status_any")
    df = W.class_weights(W.risk_weights(df, min_age=60, factor=1.5), "label").withColumn("empty", F.lit(None).cast("double"))
    return W.combine_weights(df, ["risk_weight", "class_weight", "empty", "absent"]).select("doc_id", "sample_weight")


_BANDS = "<10:0.5,10-30:1.5,>=50:3,>70:4"


@register("band_weights", FEAT_SQL + """
, b AS (SELECT doc_id, CASE WHEN age_years IS NOT NULL AND age_years >= 70 THEN 4.0
                            WHEN age_years IS NOT NULL AND age_years >= 50 THEN 3.0
                            WHEN age_years IS NOT NULL AND age_years >= 10 AND age_years < 30 THEN 1.5
                            WHEN age_years IS NOT NULL AND age_years < 10 THEN 0.5 ELSE 1.0 END AS w FROM pf)
SELECT doc_id, w / (SELECT avg(w) FROM b) AS band_weight FROM b""", doubles=["band_weight"])
def q_band_weights(spark, sf):
    """M8 + C21: age-band weights (later bands override, '>' inclusive), normalised to mean 1."""
    df = pu_features(spark, sf).select("doc_id", "age_years")
    return W.band_weights(df, _BANDS, normalize=True).select("doc_id", "band_weight")


@register("odds_weights", FEAT_SQL + """
, q AS (SELECT quantile_cont(age_years, 0.25) AS q1, quantile_cont(age_years, 0.5) AS q2,
               quantile_cont(age_years, 0.75) AS q3 FROM pf WHERE label = 1),
t AS (SELECT sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS P, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS N FROM pf),
r AS (SELECT pf.*, CASE WHEN age_years <= q1 THEN 'Q1' WHEN age_years <= q2 THEN 'Q2' WHEN age_years <= q3 THEN 'Q3'
                        WHEN age_years IS NOT NULL THEN 'Q4' END AS age_bin,
             CASE WHEN lower(trim(ethnicity)) IN ('unknown', 'nan', 'none') THEN NULL ELSE lower(trim(ethnicity)) END AS eth
      FROM pf, q),
ab AS (SELECT age_bin, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg
       FROM r WHERE age_bin IS NOT NULL GROUP BY age_bin),
eb AS (SELECT eth, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg
       FROM r WHERE eth IS NOT NULL GROUP BY eth),
aw AS (SELECT age_bin, CASE WHEN pos + neg >= 50 THEN 1 + 0.5 * tanh(ln(((pos + 0.5) / (neg + 0.5)) / ((P - pos + 0.5) / (N - neg + 0.5)))) ELSE 1.0 END AS w FROM ab, t),
ew AS (SELECT eth, CASE WHEN pos + neg >= 50 THEN 1 + 0.5 * tanh(ln(((pos + 0.5) / (neg + 0.5)) / ((P - pos + 0.5) / (N - neg + 0.5)))) ELSE 1.0 END AS w FROM eb, t)
SELECT r.doc_id, least(greatest(COALESCE(aw.w, 1.0) * COALESCE(ew.w, 1.0), 0.5), 2.0) AS odds_weight
FROM r LEFT JOIN aw ON r.age_bin = aw.age_bin LEFT JOIN ew ON r.eth = ew.eth""", doubles=["odds_weight"])
def q_odds_weights(spark, sf):
    """M7: age-quartile x ethnicity odds weights (groups < 50 -> 1), clipped to [0.5, 2]."""
    df = pu_features(spark, sf).select("doc_id", "label", "age_years", "ethnicity")
    out, _ = W.odds_weights(df, factor=0.5, min_count=50)
    return out.select("doc_id", "odds_weight")


@register("pu_rows", FEAT_SQL + """
SELECT doc_id, label, CASE WHEN domain = 'unlabelled' AND label = 0 THEN 0.95 ELSE 1.0 END AS pu_weight,
       FALSE AS is_pu_copy FROM pf
UNION ALL
SELECT doc_id, 1, 0.05, TRUE FROM pf WHERE domain = 'unlabelled' AND label = 0""", doubles=["pu_weight"])
def q_pu_rows(spark, sf):
    """M4/U4: PU label smoothing — unlabelled negatives weighted .95 plus a positive copy at .05."""
    df = pu_features(spark, sf).select("doc_id", "label", "domain")
    return W.pu_rows(df, prob=0.05).select("doc_id", "label", "pu_weight", "is_pu_copy")


@register("hash_split", FEAT_SQL + f"""
SELECT doc_id, CASE WHEN {_h("CAST(doc_id AS VARCHAR) || ':42'")} < 0.7 THEN 'train'
                    WHEN {_h("CAST(doc_id AS VARCHAR) || ':42'")} < 0.85 THEN 'val' ELSE 'test' END AS split
FROM pf""")
def q_hash_split(spark, sf):
    """M2: stable 70/15/15 split from md5(key:seed)."""
    return W.hash_split(pu_features(spark, sf).select("doc_id"), "doc_id", seed=42)


@register("missing_injection", FEAT_SQL + f"""
, m AS (SELECT *, {_h("CAST(doc_id AS VARCHAR) || ':row:42'")} < 0.3 AS picked FROM pf)
SELECT doc_id,
  CASE WHEN picked AND {_h("CAST(doc_id AS VARCHAR) || ':age_years:42'")} < 0.5 THEN NULL ELSE age_years END AS age_years,
  CASE WHEN picked AND {_h("CAST(doc_id AS VARCHAR) || ':lang:42'")} < 1.0 THEN NULL ELSE lang END AS lang,
  CASE WHEN picked AND {_h("CAST(doc_id AS VARCHAR) || ':source:42'")} < 0.5 THEN NULL ELSE source END AS source
FROM m""", doubles=["age_years"])
def q_missing_injection(spark, sf):
    """M3: reproducible missingness — 30% of rows, 50% per column, doubled for the hard column lang."""
    df = pu_features(spark, sf).select("doc_id", "age_years", "lang", "source")
    return W.inject_missingness(df, "doc_id", ["age_years", "lang", "source"], 0.3, 0.5, seed=42, hard_cols=["lang"])


@register("age_prior_blend", FEAT_SQL + """
, a AS (SELECT quantile_cont(age_years, 0.1) AS a0, quantile_cont(age_years, 0.5) AS a1,
               quantile_cont(age_years, 0.9) AS a2 FROM pf WHERE label = 1),
p AS (SELECT doc_id, score, COALESCE(CASE WHEN age_years <= a0 THEN 0.05
        WHEN age_years <= a1 THEN 0.05 + (age_years - a0) * ((0.2 - 0.05) / (a1 - a0))
        WHEN age_years <= a2 THEN 0.2 + (age_years - a1) * ((0.6 - 0.2) / (a2 - a1))
        WHEN age_years IS NOT NULL THEN 0.6 END, 0.0) AS prior FROM pf, a)
SELECT doc_id, score AS score_raw, least(greatest(score, prior), 0.7) AS score_final FROM p""",
          doubles=["score_raw", "score_final"])
def q_age_prior_blend(spark, sf):
    """C17-C20: anchors at the positives' age percentiles 10/50/90 -> p .05/.2/.6, floor mode, cap .7."""
    df = pu_features(spark, sf)
    anchors = W.anchors_from_percentiles(df, "age_years", [10, 50, 90], [0.05, 0.2, 0.6])
    out = W.apply_age_prior(df.withColumn("score_raw", F.col("score")), "score", "age_years", anchors,
                            mode="floor", cap=0.7, out_col="score_final")
    return out.select("doc_id", "score_raw", "score_final")


_LANGS = ("de", "en", "es", "fr")
_SOURCES = tuple(f"src{i}" for i in range(20))


@register("encode_matrix", FEAT_SQL + f"""
, tr AS (SELECT * FROM pf WHERE {_h("CAST(doc_id AS VARCHAR) || ':42'")} < 0.7),
med AS (SELECT quantile_cont(age_years, 0.5) AS m FROM tr),
st AS (SELECT avg(COALESCE(age_years, m)) AS mu, stddev_pop(COALESCE(age_years, m)) AS sd FROM tr, med)
SELECT doc_id, (COALESCE(age_years, m) - mu) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END AS age_years, """ +
          ", ".join(f"CAST(COALESCE(lang, 'unknown') = '{v}' AS DOUBLE) AS lang_{v}" for v in _LANGS) + ", " +
          ", ".join(f"CAST(COALESCE(source, 'unknown') = '{v}' AS DOUBLE) AS source_{v}" for v in _SOURCES) +
          " FROM pf, med, st",
          doubles=["age_years"] + [f"lang_{v}" for v in _LANGS] + [f"source_{v}" for v in _SOURCES])
def q_encode_matrix(spark, sf):
    """Encoder fitted on the train split (median impute, population z-score,
    one-hot with <1% merged) and applied to every row."""
    df = pu_features(spark, sf)
    train = W.hash_split(df, "doc_id", seed=42).where(F.col("split") == "train")
    enc = FE.fit_encoder(train, ["age_years"], ["lang", "source"], min_frequency=0.01)
    return enc.transform(df, keep=["doc_id"])
