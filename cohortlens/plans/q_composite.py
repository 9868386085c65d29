"""Composite queries: raw case table (A42), descriptives (A38), per-group
missing report (A10), aligned splits (M1), preprocessing (M22), scientific
report (M23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import tokens as TK
from cohortlens.operators import report as R
from cohortlens.operators import risk as K
from cohortlens.operators import rollup as RU
from cohortlens.plans import pipelines as PL
from cohortlens.plans.catalog import register
from cohortlens.plans.q_columns import _UNION_SQL, _two_schemas
from cohortlens.plans.q_risk import _SEX_SQL, _event_sex
from cohortlens.plans.q_rollup import _smoking_sql
from cohortlens.plans.standins import (EVENTS_SQL, ORDERS_SQL, PU_SQL, event_cohort, orders_as_exposures, pu_cohort,
                                       table, with_sql)

_TOKENS_SQL = "(" + ", ".join(f"'{t}'" for t in TK.MISSING_TOKENS) + ")"


def _gender():
    seg = F.col("c_mktsegment")
    return F.when(seg == "AUTOMOBILE", F.lit("male")).when(seg == "BUILDING", F.lit("Female ")) \
        .when(seg == "FURNITURE", F.lit("not reported")).otherwise(F.lit("unknown"))


def _race():
    k = F.col("c_nationkey")
    return F.when(k < 8, F.lit("White")).when(k < 16, F.lit("asian")).otherwise(F.lit("N/A"))


@register("raw_case_table", with_sql(ORDERS_SQL) + f"""
, ex AS (SELECT case_id, max({_smoking_sql('smoking_text')}) AS tobacco_smoking_status_any,
                max(value) AS pack_years_smoked_max FROM ox WHERE case_id IS NOT NULL GROUP BY case_id),
oa AS (SELECT o_custkey AS case_id, o_orderkey AS rk, o_orderdate AS dt,
              CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 10000 END AS bmi,
              o_totalprice / 1000 AS weight FROM orders),
lb AS (SELECT case_id, bmi AS bmi_last FROM (SELECT case_id, bmi, row_number() OVER (PARTITION BY case_id
         ORDER BY (dt IS NULL) DESC, dt DESC, rk DESC) AS rn FROM oa WHERE bmi IS NOT NULL) t WHERE rn = 1),
lw AS (SELECT case_id, weight AS weight_last FROM (SELECT case_id, weight, row_number() OVER (PARTITION BY case_id
         ORDER BY (dt IS NULL) DESC, dt DESC, rk DESC) AS rn FROM oa WHERE weight IS NOT NULL) t WHERE rn = 1),
dx AS (SELECT o.o_custkey AS case_id, median(round_even(l.l_extendedprice / 365.25 * 10, 0) / 10) AS age_dx
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey),
c AS (SELECT c_custkey AS case_id,
             CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'male' WHEN c_mktsegment = 'BUILDING' THEN 'Female '
                  WHEN c_mktsegment = 'FURNITURE' THEN 'not reported' ELSE 'unknown' END AS g,
             CASE WHEN c_nationkey < 8 THEN 'White' WHEN c_nationkey < 16 THEN 'asian' ELSE 'N/A' END AS r
      FROM customer)
SELECT c.case_id, dx.age_dx AS age_years,
       CASE WHEN lower(trim(g)) IN {_TOKENS_SQL} THEN NULL ELSE lower(trim(g)) END AS sex,
       CASE WHEN lower(trim(r)) IN {_TOKENS_SQL} THEN NULL ELSE lower(trim(r)) END AS race,
       CAST(NULL AS VARCHAR) AS ethnicity, ex.tobacco_smoking_status_any, ex.pack_years_smoked_max,
       lb.bmi_last, CAST(NULL AS DOUBLE) AS height_last, lw.weight_last, 1 AS label, 'hcmi_tcga' AS domain
FROM c LEFT JOIN ex ON c.case_id = ex.case_id LEFT JOIN lb ON c.case_id = lb.case_id
LEFT JOIN lw ON c.case_id = lw.case_id LEFT JOIN dx ON c.case_id = dx.case_id""",
          doubles=["age_years", "tobacco_smoking_status_any", "pack_years_smoked_max", "bmi_last", "height_last",
                   "weight_last"])
def q_raw_case_table(spark, sf):
    """Cases + exposure roll-up + last-known attributes + diagnosis-age
    median, joined per case with cleaned demographics (customer = case,
    orders = exposures / dated attributes, lineitems = diagnoses)."""
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), _gender().alias("dem_gender"),
                                               _race().alias("dem_race"))
    ox = orders_as_exposures(spark, sf).select("case_id", F.col("smoking_text").alias("tobacco_smoking_status"),
                                               F.col("value").alias("pack_years_smoked"))
    o = table(spark, sf, "orders")
    other = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("_row"),
                     F.col("o_orderdate").alias("updated_datetime"),
                     F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") / 10000).alias("bmi"),
                     F.lit(None).cast("double").alias("height"), (F.col("o_totalprice") / 1000).alias("weight"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    diag = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("case_id")),
                   "l_orderkey").select("case_id", F.col("l_extendedprice").alias("age_at_diagnosis"))
    return RU.build_raw_dataset(cust, ox, other, diag)


@register("describe_cohort", with_sql(EVENTS_SQL) + """
, d AS (SELECT value, label, lower(trim(""" + _SEX_SQL + """)) AS s FROM ev),
e AS (SELECT value, label, CASE WHEN s IN ('m', 'male', 'masculino', 'man') THEN 'Male'
                                WHEN s IN ('f', 'female', 'femenino', 'woman') THEN 'Female' ELSE 'Unknown' END AS sex FROM d)
SELECT count(*) AS n, avg(value) AS age_mean, min(value) AS age_min, max(value) AS age_max,
       count(CASE WHEN sex = 'Male' THEN 1 END) AS n_male, count(CASE WHEN sex = 'Female' THEN 1 END) AS n_female,
       count(CASE WHEN sex = 'Unknown' THEN 1 END) AS n_sex_unknown,
       avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS pos_share, quantile_cont(value, 0.5) AS age_median,
       quantile_cont(value, 0.5) > 200 AS age_was_days
FROM (SELECT sex, label, value / CASE WHEN (SELECT quantile_cont(value, 0.5) FROM e) > 200 THEN 365.25 ELSE 1 END AS value FROM e)""",
          doubles=["age_mean", "age_min", "age_max", "pos_share", "age_median"])
def q_describe_cohort(spark, sf):
    """N, age mean / median / min / max, sex counts and positive share."""
    ev = event_cohort(spark, sf).withColumn("sex", _event_sex())
    return K.describe_cohort(ev, "value", "sex")


@register("describe_days_cohort", with_sql(PU_SQL) + """
SELECT count(*) AS n, avg(n_chars / 365.25) AS age_mean, min(n_chars / 365.25) AS age_min, max(n_chars / 365.25) AS age_max,
       count(CASE WHEN lang = 'en' THEN 1 END) AS n_male, count(CASE WHEN lang = 'de' THEN 1 END) AS n_female,
       count(CASE WHEN lang NOT IN ('en', 'de') THEN 1 END) AS n_sex_unknown,
       avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS pos_share, quantile_cont(n_chars / 365.25, 0.5) AS age_median,
       TRUE AS age_was_days FROM pu""", doubles=["age_mean", "age_min", "age_max", "pos_share", "age_median"])
def q_describe_days_cohort(spark, sf):
    """Ages named as days at diagnosis are described in years."""
    pu = pu_cohort(spark, sf).select(F.col("n_chars").alias("mean_age_at_dx"), "label", F.when(F.col("lang") == "en", "male")
                                     .when(F.col("lang") == "de", "F").alias("sex"))
    return K.describe_cohort(pu, "mean_age_at_dx", "sex")


@register("label_shares", with_sql(PU_SQL) + """
SELECT CAST(label AS VARCHAR) AS label, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM pu) AS share
FROM pu GROUP BY label""", doubles=["share"])
def q_label_shares(spark, sf):
    """Rows and share of every label."""
    return K.label_shares(pu_cohort(spark, sf))


_BMI = "16 + (doc_id * 7) % 25"


@register("risk_concordance", with_sql(PU_SQL) + f"""
, c AS (SELECT CASE WHEN lang = 'fr' THEN NULL ELSE domain END AS domain, score, n_chars / 100.0 AS age, {_BMI} AS bmi FROM pu),
d AS (SELECT 'domain' AS section, CAST(NULL AS INTEGER) AS bin_order, domain AS bin, count(*) AS n, avg(score) AS mean,
        quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.25) AS p25,
        quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.9) AS p90 FROM c GROUP BY domain),
bins(section, bin_order, bin, lo, hi) AS (VALUES
  ('unlabeled_age_bin', 0, '<40', 0, 40), ('unlabeled_age_bin', 1, '40-49', 40, 50), ('unlabeled_age_bin', 2, '50-59', 50, 60),
  ('unlabeled_age_bin', 3, '60-69', 60, 70), ('unlabeled_age_bin', 4, '70-79', 70, 80), ('unlabeled_age_bin', 5, '80+', 80, 1e300),
  ('unlabeled_bmi_bin', 0, '<18.5', 0, 18.5), ('unlabeled_bmi_bin', 1, '18.5-24.9', 18.5, 25),
  ('unlabeled_bmi_bin', 2, '25-29.9', 25, 30), ('unlabeled_bmi_bin', 3, '30-34.9', 30, 35), ('unlabeled_bmi_bin', 4, '35+', 35, 1e300)),
b AS (SELECT section, bin_order, bin, count(score) AS n, avg(score) AS mean, quantile_cont(score, 0.5) AS median
      FROM bins LEFT JOIN (SELECT * FROM c WHERE domain = 'unlabelled') c
        ON CASE WHEN section = 'unlabeled_age_bin' THEN age ELSE bmi END >= lo
       AND CASE WHEN section = 'unlabeled_age_bin' THEN age ELSE bmi END < hi GROUP BY ALL)
SELECT * FROM d UNION ALL SELECT *, NULL, NULL, NULL, NULL FROM b""", doubles=["mean", "median", "p10", "p25", "p75", "p90"])
def q_risk_concordance(spark, sf):
    """Score by domain (a NULL one too) and, in the unlabelled domain, by age and BMI bin."""
    return R.risk_concordance(_risk_rows(spark, sf).withColumn("domain", F.when(F.col("lang") != "fr", F.col("domain"))))


def _risk_rows(spark, sf):
    return pu_cohort(spark, sf).withColumns({"age_years": F.col("n_chars") / 100.0, "bmi_last": F.expr(_BMI).cast("double"),
                                             "sex": F.when(F.col("label") == 1, "female").otherwise("male")})


@register("high_risk_group", with_sql(PU_SQL) + f"""
, u AS (SELECT score, n_chars / 100.0 AS age, {_BMI} AS bmi, lang, source, CASE WHEN label = 1 THEN 'female' ELSE 'male' END AS sex
        FROM pu WHERE domain = 'unlabelled'),
h AS (SELECT *, CASE WHEN bmi < 25 THEN 'Normal' WHEN bmi < 30 THEN 'Sobrepeso' ELSE 'Obeso' END AS cat
      FROM u WHERE score >= (SELECT quantile_cont(score, 0.9) FROM u))
SELECT count(*) AS n, (SELECT quantile_cont(score, 0.9) FROM u) AS proba_threshold, avg(score) AS proba_mean,
       quantile_cont(score, 0.5) AS proba_median, avg(age) AS age_mean, quantile_cont(age, 0.5) AS age_median, avg(bmi) AS bmi_mean,
       quantile_cont(bmi, 0.5) AS bmi_median,
       (SELECT cat FROM h GROUP BY cat ORDER BY count(*) DESC, cat LIMIT 1) AS bmi_cat_mode,
       (SELECT lang FROM h GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1) AS ethnicity_mode,
       (SELECT source FROM h GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) AS race_mode,
       (SELECT sex FROM h GROUP BY sex ORDER BY count(*) DESC, sex LIMIT 1) AS sex_mode FROM h""",
          doubles=["proba_threshold", "proba_mean", "proba_median", "age_mean", "age_median", "bmi_mean", "bmi_median"])
def q_high_risk_group(spark, sf):
    """The twelve fields of the unlabelled domain's top tenth."""
    rows = _risk_rows(spark, sf).where("domain = 'unlabelled'")
    return R.high_risk_group(rows, ethnicity_col="lang", race_col="source")


@register("group_missing_report", _UNION_SQL + """
SELECT domain, count(*) AS "rows", avg(CASE WHEN acctbal IS NULL THEN 1.0 ELSE 0.0 END) AS missing_acctbal,
       avg(CASE WHEN nationkey IS NULL THEN 1.0 ELSE 0.0 END) AS missing_nationkey,
       avg(CASE WHEN segment IS NULL THEN 1.0 ELSE 0.0 END) AS missing_segment
FROM canon GROUP BY domain""", doubles=["missing_acctbal", "missing_nationkey", "missing_segment"])
def q_group_missing_report(spark, sf):
    """A10: rows and missing rate per column for each source group."""
    from cohortlens.operators import canonical as C
    a, b = _two_schemas(spark, sf)
    return RU.group_missing_report(C.align_union(a, b), "domain", ["acctbal", "nationkey", "segment"])


@register("aligned_splits", _UNION_SQL + """
, h AS (SELECT entity_id, domain, label,
               ('0x' || substr(md5(CAST(entity_id AS VARCHAR) || ':42'), 1, 8))::BIGINT AS hv FROM canon),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY hv, entity_id) - 1 AS rk,
             count(*) OVER (PARTITION BY label) AS n FROM h)
SELECT entity_id, domain, label, CASE WHEN rk < floor(n * 0.7) THEN 'train' WHEN rk < floor(n * 0.85) THEN 'val'
                                      ELSE 'test' END AS split FROM r""")
def q_aligned_splits(spark, sf):
    """M1 + M2 exact: canonical union, stratified 70/15/15 per label by md5 order (distributed rank)."""
    a, b = _two_schemas(spark, sf)
    return PL.align_datasets(a, b, "entity_id").select("entity_id", "domain", "label", "split")


@register("preprocess_raw")
def q_preprocess_raw(spark, sf):
    """Raw case table -> target cleaning, dedupe, booleans, dates, tokens,
    drops from one profile, exact stratified split, encoder fitted on train."""
    cust = table(spark, sf, "customer")
    ox = orders_as_exposures(spark, sf)
    roll = RU.attach(RU.exposure_rollup(ox, "case_id", "smoking_text", "value"),
                     "case_id", RU.last_known(ox, "case_id", ["value"], "updated", tiebreak="row_key"),
                     table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("case_id"))
                     .agg(F.max("o_orderdate").alias("last_order_date")))
    raw = cust.select(F.col("c_custkey").alias("case_key"), F.col("c_nationkey").cast("string").alias("nation_id"),
                      F.col("c_acctbal").alias("acctbal"),
                      F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), F.lit("Yes")).otherwise(F.lit("no"))
                      .alias("target"),
                      F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("Unknown")).otherwise(F.col("c_mktsegment"))
                      .alias("segment_text"),
                      F.lit("constant").alias("const_col")) \
        .join(roll, F.col("case_key") == F.col("case_id"), "left").drop("case_id")
    pp = PL.preprocess(raw, "target", "case_key", date_cols=["last_order_date"])
    return pp.frame


@register("scientific_report")
def q_scientific_report(spark, sf):
    """Brier, top-3 permutation importances (AUPRC), age contrast and the high-risk group's twelve fields in one row."""
    from cohortlens.plans import train as TR
    from cohortlens.plans.q_models import _cohort, _scorer
    df = _cohort(spark, sf).cache()
    res = TR.train_and_validate(df, TR.TrainConfig(model="logreg"))
    cfg = res.cfg
    held = df.where(F.col("split") != "train")
    scorer = _scorer(res)
    scored = scorer(held.select("doc_id", "label", "domain", *cfg.numeric, *cfg.categorical))
    unl = scored.where(F.col("domain") == cfg.unlabeled_domain)
    rows = held.select("doc_id", "label", *cfg.numeric, *cfg.categorical)
    return PL.scientific_report(rows.join(scored.select("doc_id", "score"), "doc_id"), "doc_id", "label",
                                list(cfg.numeric) + list(cfg.categorical), scorer, unl, "age_years",
                                ethnicity_col="lang", race_col="source")


def _flat_relations(spark, sf):
    c = table(spark, sf, "customer")
    vs = F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("Dead")) \
        .when(F.col("c_mktsegment") == "BUILDING", F.lit(" Alive")) \
        .when(F.col("c_mktsegment") == "FURNITURE", F.lit(None).cast("string")).otherwise(F.lit("alive"))
    cases = c.select(F.col("c_custkey").alias("case_key"), vs.alias("dem_vital_status"),
                     F.when(F.col("c_nationkey") < 12, F.lit("Female")).otherwise(F.lit("MALE ")).alias("dem_gender"))
    ox = orders_as_exposures(spark, sf)
    exposures = ox.select(F.col("case_id").alias("case_key"),
                          F.when(F.col("smoking_text") != "Not Reported", F.col("smoking_text"))
                          .alias("tobacco_smoking_status"), F.col("value").alias("pack_years_smoked"))
    o = table(spark, sf, "orders")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    diagnoses = o.select(F.col("o_custkey").alias("case_key"), F.col("o_orderkey").alias("diagnosis_id"),
                         "o_orderdate", F.col("o_totalprice").alias("age_at_diagnosis"),
                         F.when(st == "F", F.lit("Metastasis, NOS")).when(st == "O", F.lit("No"))
                         .alias("metastasis_at_diagnosis"),
                         F.when(pr == "1-URGENT", F.lit("Yes")).otherwise(F.lit("no")).alias("prior_malignancy"),
                         F.when(pr == "2-HIGH", F.lit("Stage II")).when(pr == "3-MEDIUM", F.lit("Stage IIIA"))
                         .when(pr == "4-NOT SPECIFIED", F.lit("Stage IV")).alias("ajcc_pathologic_stage"))
    li = table(spark, sf, "lineitem")
    tt = F.when(F.col("l_returnflag") == "R", F.lit("Chemotherapy")) \
        .when(F.col("l_returnflag") == "A", F.lit("Radiation Therapy, NOS")) \
        .when(F.col("l_linestatus") == "O", F.lit("Surgery")).otherwise(F.lit("Targeted Molecular therapy"))
    treatments = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("case_key")),
                         "l_orderkey").select("case_key", F.col("l_linenumber").alias("treatment_id"),
                                              tt.alias("treatment_type"))
    follow_ups = o.select(F.col("o_custkey").alias("case_key"),
                          F.when(st == "P", F.lit("Yes")).otherwise(F.lit("No")).alias("progression_or_recurrence"),
                          F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double")
                          .alias("days_to_follow_up"))
    return {"cases": cases, "exposures": exposures, "diagnoses": diagnoses, "treatments": treatments,
            "follow_ups": follow_ups}


_FLAT_SQL = """
WITH cs AS (SELECT c_custkey AS case_key,
                   CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Dead' WHEN c_mktsegment = 'BUILDING' THEN ' Alive'
                        WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE 'alive' END AS vs,
                   CASE WHEN c_nationkey < 12 THEN 'Female' ELSE 'MALE ' END AS g FROM customer),
ex AS (SELECT o_custkey AS case_key, max(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END) AS pack_years_smoked_max,
              max(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END) AS tobacco_smoking_status_any
       FROM orders GROUP BY o_custkey),
dxr AS (SELECT o_custkey AS case_key, o_orderkey, o_orderdate, o_totalprice,
               CASE WHEN o_orderstatus = 'F' THEN 'Metastasis, NOS' WHEN o_orderstatus = 'O' THEN 'No' END AS met,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'no' END AS prior,
               CASE WHEN o_orderpriority = '2-HIGH' THEN 'stage ii' WHEN o_orderpriority = '3-MEDIUM' THEN 'stage iiia'
                    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'stage iv' END AS stage FROM orders),
ls AS (SELECT case_key, stage AS last_ajcc_stage FROM (SELECT case_key, stage, row_number() OVER (PARTITION BY case_key
         ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM dxr WHERE stage IS NOT NULL) t WHERE rn = 1),
dx AS (SELECT case_key, count(o_orderkey) AS n_diagnoses,
              max(CASE WHEN lower(trim(met)) IN ('metastasis, nos', 'yes', '1') THEN 1 ELSE 0 END) AS any_metastasis,
              max(CASE WHEN lower(trim(prior)) IN ('yes', '1') THEN 1 ELSE 0 END) AS any_prior_malignancy,
              avg(o_totalprice) AS mean_age_at_dx FROM dxr GROUP BY case_key),
txr AS (SELECT o.o_custkey AS case_key, l.l_linenumber,
               lower(CASE WHEN l.l_returnflag = 'R' THEN 'Chemotherapy' WHEN l.l_returnflag = 'A' THEN 'Radiation Therapy, NOS'
                          WHEN l.l_linestatus = 'O' THEN 'Surgery' ELSE 'Targeted Molecular therapy' END) AS t
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
tx AS (SELECT case_key, count(l_linenumber) AS n_treatments,
              max(CASE WHEN contains(t, 'chemotherapy') THEN 1 ELSE 0 END) AS any_chemo,
              max(CASE WHEN contains(t, 'radiation') THEN 1 ELSE 0 END) AS any_radiation,
              max(CASE WHEN contains(t, 'surgery') THEN 1 ELSE 0 END) AS any_surgery,
              max(CASE WHEN contains(t, 'immunotherapy') THEN 1 ELSE 0 END) AS any_immuno,
              max(CASE WHEN contains(t, 'targeted') THEN 1 ELSE 0 END) AS any_targeted FROM txr GROUP BY case_key),
fu AS (SELECT o_custkey AS case_key, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS any_progression,
              max(CAST(datediff('day', DATE '1995-01-01', o_orderdate) AS DOUBLE)) AS last_days_to_follow_up
       FROM orders GROUP BY o_custkey)
SELECT cs.case_key, lower(trim(g)) AS sex, ex.pack_years_smoked_max, ex.tobacco_smoking_status_any,
       dx.n_diagnoses, dx.any_metastasis, dx.any_prior_malignancy, ls.last_ajcc_stage, dx.mean_age_at_dx,
       tx.n_treatments, tx.any_chemo, tx.any_radiation, tx.any_surgery, tx.any_immuno, tx.any_targeted,
       fu.any_progression, fu.last_days_to_follow_up,
       CAST(CASE WHEN fu.any_progression = 1 THEN 1 WHEN lower(trim(vs)) IS NULL THEN NULL
                 WHEN lower(trim(vs)) = 'alive' THEN 0 ELSE 1 END AS INTEGER) AS label
FROM cs LEFT JOIN ex ON cs.case_key = ex.case_key LEFT JOIN dx ON cs.case_key = dx.case_key
LEFT JOIN ls ON cs.case_key = ls.case_key LEFT JOIN tx ON cs.case_key = tx.case_key
LEFT JOIN fu ON cs.case_key = fu.case_key"""


@register("flat_case_table", _FLAT_SQL, doubles=["pack_years_smoked_max", "mean_age_at_dx", "last_days_to_follow_up"])
def q_flat_case_table(spark, sf):
    """Flat per-case roll-ups (exposures, diagnoses with last stage, treatment keywords,
    follow-ups forcing the label) joined onto the cases; unknown vital status stays NULL."""
    rel = _flat_relations(spark, sf)
    return RU.flat_case_table(rel, "case_key", {"diagnoses": ["o_orderdate", "diagnosis_id"]})


def _coded_survey(spark, sf):
    """customer as a coded survey: sex 1/2, race/ethnicity code = nation key,
    smoking questions from segment and nation, heights/weights from balances."""
    c = table(spark, sf, "customer")
    seg, nk = F.col("c_mktsegment"), F.col("c_nationkey")
    return c.select(F.col("c_custkey").alias("SEQN"), (F.col("c_acctbal") / 100 + 40).alias("RIDAGEYR"),
                    F.when(nk < 12, F.lit(1)).otherwise(F.lit(2)).alias("RIAGENDR"), nk.alias("RIDRETH3"),
                    (F.col("c_acctbal") / 50 + 150).alias("BMXHT"), (F.col("c_acctbal") / 100 + 70).alias("BMXWT"),
                    F.when(seg == "AUTOMOBILE", F.lit(1)).when(seg == "BUILDING", F.lit(2)).alias("SMQ020"),
                    F.when(nk < 5, F.lit(1)).when(nk < 10, F.lit(3)).alias("SMQ040"))


@register("coded_survey_canonical", """
WITH s AS (SELECT c_custkey AS seqn, c_acctbal / 100 + 40 AS age, CASE WHEN c_nationkey < 12 THEN 1 ELSE 2 END AS sx,
                  c_nationkey AS eth, c_acctbal / 50 + 150 AS ht, c_acctbal / 100 + 70 AS wt,
                  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 WHEN c_mktsegment = 'BUILDING' THEN 2 END AS q1,
                  CASE WHEN c_nationkey < 5 THEN 1 WHEN c_nationkey < 10 THEN 3 END AS q2 FROM customer)
SELECT age AS age_years, ht AS height_last, wt AS weight_last, CAST(NULL AS DOUBLE) AS bmi_last,
       CASE WHEN q1 = 1 THEN 1.0 WHEN q1 = 2 THEN 0.0 WHEN q2 IN (1, 2) THEN 1.0 WHEN q2 = 3 THEN 0.0 END
         AS tobacco_smoking_status_any,
       CAST(NULL AS DOUBLE) AS pack_years_smoked_max,
       CASE WHEN sx = 1 THEN 'male' WHEN sx = 2 THEN 'female' END AS sex,
       CASE WHEN eth IN (1, 2) THEN 'hispanic or latino' ELSE 'not hispanic or latino' END AS ethnicity,
       CASE WHEN eth = 3 THEN 'white' WHEN eth = 4 THEN 'black or african american' WHEN eth = 6 THEN 'asian'
            WHEN eth = 7 THEN 'other' END AS race,
       0 AS label, 'nhanes' AS domain
FROM s""", doubles=["age_years", "height_last", "weight_last", "bmi_last", "tobacco_smoking_status_any",
                    "pack_years_smoked_max"])
def q_coded_survey_canonical(spark, sf):
    """P5 + C5-C8: a coded survey (upper-case names snake-cased) mapped to the canonical row:
    coded sex, ethnicity (everything else -> not hispanic), race, two-question smoker."""
    from cohortlens.operators import canonical as C
    return C.align_domain_b(_coded_survey(spark, sf))[0]


_W_LANGS = ("de", "en", "es", "fr")


@register("encode_weighted", """
WITH d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) / 100.0 AS age_years, lang FROM documents),
tr AS (SELECT * FROM d WHERE (CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8))::BIGINT AS DOUBLE)
                              / 4294967296.0) < 0.7),
med AS (SELECT quantile_cont(age_years, 0.5) AS m FROM tr),
st AS (SELECT avg(COALESCE(age_years, m)) AS mu, stddev_pop(COALESCE(age_years, m)) AS sd FROM tr, med),
z AS (SELECT doc_id, (COALESCE(age_years, m) - mu) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END AS age_years, lang
      FROM d, med, st)
SELECT doc_id, age_years, """ + ", ".join(f"CAST(COALESCE(lang, 'unknown') = '{v}' AS DOUBLE) * 0.5 AS lang_{v}"
                                          for v in _W_LANGS) + """, age_years * 3.0 AS age_years_weighted
FROM z""", doubles=["age_years", "age_years_weighted"] + [f"lang_{v}" for v in _W_LANGS])
def q_encode_weighted(spark, sf):
    """M12 + M13: encoder with a weighted copy of scaled age (x3) and a feature weight of 0.5
    on every lang one-hot column."""
    from cohortlens.operators import features as FE
    from cohortlens.operators import weights as W
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars").cast("double") / 100.0).alias("age_years"),
                                             "lang")
    train = W.hash_split(d, "doc_id", seed=42).where(F.col("split") == "train")
    enc = FE.fit_encoder(train, ["age_years"], ["lang"], age_weight=3.0, feature_weights={"lang_": 0.5})
    return enc.transform(d, keep=["doc_id"])


@register("case_domain_canonical", f"""
WITH c AS (SELECT c_custkey AS case_id,
                  CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE -(c_acctbal + 20000.0) END AS dtb,
                  (c_acctbal + 10000.0) * 2 AS dx,
                  CASE WHEN c_nationkey < 12 THEN ' Female' WHEN c_nationkey < 20 THEN 'MALE' ELSE 'Not Reported' END AS g,
                  CASE WHEN c_nationkey < 6 THEN 'white' ELSE 'unknown' END AS r FROM customer)
SELECT COALESCE(round_even(-dtb / 365.25 * 10, 0) / 10, round_even(dx / 365.25 * 10, 0) / 10) AS age_years,
       CAST(NULL AS DOUBLE) AS height_last, CAST(NULL AS DOUBLE) AS weight_last, CAST(NULL AS DOUBLE) AS bmi_last,
       CAST(NULL AS DOUBLE) AS tobacco_smoking_status_any, CAST(NULL AS DOUBLE) AS pack_years_smoked_max,
       CASE WHEN lower(trim(g)) IN {_TOKENS_SQL} THEN NULL ELSE lower(trim(g)) END AS sex,
       CAST(NULL AS VARCHAR) AS ethnicity,
       CASE WHEN lower(trim(r)) IN {_TOKENS_SQL} THEN NULL ELSE lower(trim(r)) END AS race,
       1 AS label, 'hcmi_tcga' AS domain
FROM c""", doubles=["age_years", "height_last", "weight_last", "bmi_last", "tobacco_smoking_status_any",
                    "pack_years_smoked_max"])
def q_case_domain_canonical(spark, sf):
    """P4 + C1 + C3: case-domain canonical row — age from days to birth, else mean diagnosis
    days (1 dp, half-even), demographics cleaned of missing tokens, label NULL -> 1."""
    from cohortlens.operators import canonical as C
    c = table(spark, sf, "customer")
    nk = F.col("c_nationkey")
    raw = c.select(F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(None).cast("double"))
                   .otherwise(-(F.col("c_acctbal") + 20000.0)).alias("dem_days_to_birth"),
                   ((F.col("c_acctbal") + 10000.0) * 2).alias("mean_age_at_dx"),
                   F.when(nk < 12, F.lit(" Female")).when(nk < 20, F.lit("MALE")).otherwise(F.lit("Not Reported"))
                   .alias("dem_gender"),
                   F.when(nk < 6, F.lit("white")).otherwise(F.lit("unknown")).alias("dem_race"))
    return C.align_domain_a(raw)[0]
