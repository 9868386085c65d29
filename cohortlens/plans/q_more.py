"""Queries for operators that no other query runs: row rules, key and schema rules, NULL groups.

The SQL states token lists and rules literally, not from the tested modules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.operators import clean as CL
from cohortlens.operators import evaluate as E
from cohortlens.operators import rollup as RU
from cohortlens.operators import weights as W
from cohortlens.plans.catalog import register
from cohortlens.plans.standins import ORDERS_SQL, PU_SQL, orders_as_exposures, pu_cohort, table, with_sql

_MISSING = ("('', 'nan', 'none', 'null', 'unknown', 'unk', 'not reported', 'not known', 'not specified', "
            "'not applicable', 'n/a', 'missing')")

# a cohort whose German documents have no domain and whose Spanish ones have no label
_NULLS_SQL = with_sql(PU_SQL) + """
, pn AS (SELECT doc_id, n_chars, lang, source, CASE WHEN lang = 'de' THEN NULL ELSE domain END AS domain,
                CASE WHEN lang = 'es' THEN NULL ELSE label END AS label, score FROM pu)
"""


def _nulls(spark, sf):
    pu = pu_cohort(spark, sf)
    return pu.withColumn("domain", F.when(F.col("lang") != "de", F.col("domain"))) \
        .withColumn("label", F.when(F.col("lang") != "es", F.col("label")))


@register("auroc_by_group_nulls", _NULLS_SQL + """
, sc AS (SELECT domain, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg FROM pn WHERE label IS NOT NULL GROUP BY domain, score),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER g AS P, sum(neg) OVER g AS N FROM sc
      WINDOW w AS (PARTITION BY domain ORDER BY score ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY domain))
SELECT domain, CAST(max(P) + max(N) AS BIGINT) AS n, CAST(max(P) AS BIGINT) AS n_pos,
       CASE WHEN max(P) > 0 AND max(N) > 0 THEN CAST(sum(pos * (2 * cn - neg)) AS DOUBLE) / (2.0 * max(P) * max(N)) END AS auroc,
       CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum((pos / P) * ((P - cp + pos) / ((P - cp + pos) + (N - cn + neg)))) END AS auprc
FROM c GROUP BY domain""", doubles=["auroc", "auprc"])
def q_auroc_by_group_nulls(spark, sf):
    """A23/A24 by domain where some rows have no domain (a group of its own) and some no label (left out)."""
    return E.auroc_ap(_nulls(spark, sf), group_cols=["domain"])


@register("stratified_split_nulls", _NULLS_SQL + """
, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY
              ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8))::BIGINT, doc_id) - 1 AS k,
              count(*) OVER (PARTITION BY label) AS n FROM pn)
SELECT doc_id, label, CASE WHEN k < floor(n * 0.70::DOUBLE) THEN 'train' WHEN k < floor(n * (0.70::DOUBLE + 0.15::DOUBLE))
       THEN 'val' ELSE 'test' END AS split FROM r""")
def q_stratified_split_nulls(spark, sf):
    """M2 exact split where some labels are NULL: a class of its own, no row lost."""
    return W.stratified_split(_nulls(spark, sf).select("doc_id", "label"), "doc_id")


@register("threshold_scan_nulls", _NULLS_SQL + """
, t AS (SELECT CAST(i AS DOUBLE) * 0.01 AS threshold FROM range(0, 101) r(i))
SELECT threshold, CAST(sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS pred_pos,
       sum(CASE WHEN label = 1 AND score >= threshold THEN 1.0 ELSE 0 END) / sum(label) AS recall
FROM t CROSS JOIN (SELECT * FROM pn WHERE label IS NOT NULL) GROUP BY threshold""", doubles=["threshold", "recall"])
def q_threshold_scan_nulls(spark, sf):
    """Rows without a domain count in every threshold's totals."""
    return E.threshold_scan(_nulls(spark, sf), with_ranking=False).select("threshold", "pred_pos", "recall")


@register("regression_target_clean", """
SELECT event_id, CAST(target AS DOUBLE) AS target FROM (
  SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) END AS target FROM events)
WHERE target IS NOT NULL""", doubles=["target"])
def q_regression_target_clean(spark, sf):
    """a numeric target from text; rows that do not parse are dropped."""
    t = F.when(F.col("event_type").isin("click", "view"), F.col("value").cast("bigint").cast("string")) \
        .when(F.col("event_type") == "error", F.lit("n/a"))
    return CL.clean_regression_target(table(spark, sf, "events").select("event_id", t.alias("target")), "target")


_SPARSE_SQL = with_sql(ORDERS_SQL) + """
, sp AS (SELECT row_key, case_id, CASE WHEN smoking_text <> 'Not Reported' THEN smoking_text END AS status, value, updated FROM ox)
"""


def _sparse(spark, sf):
    return orders_as_exposures(spark, sf).select(
        "row_key", "case_id", F.when(F.col("smoking_text") != "Not Reported", F.col("smoking_text")).alias("status"),
        "value", "updated")


@register("row_null_count_filter", _SPARSE_SQL + """
SELECT * FROM sp WHERE (status IS NULL)::INT + (value IS NULL)::INT + (updated IS NULL)::INT <= 1""", doubles=["value"])
def q_row_null_count_filter(spark, sf):
    """rows with at most one NULL among three columns."""
    return CL.drop_rows_by_null_count(_sparse(spark, sf), 1, ["status", "value", "updated"])


@register("complete_cases", _SPARSE_SQL + "SELECT * FROM sp WHERE status IS NOT NULL AND value IS NOT NULL", doubles=["value"])
def q_complete_cases(spark, sf):
    """rows in which every protected column is present (absent names are ignored)."""
    return CL.complete_cases(_sparse(spark, sf), ["status", "value", "no_such_column"])


@register("survey_clean", _SPARSE_SQL + """
SELECT row_key, status, value, updated FROM sp
WHERE ((status IS NULL)::INT + (value IS NULL)::INT + (updated IS NULL)::INT) / 4.0 <= 0.25""", doubles=["value"])
def q_survey_clean(spark, sf):
    """empty and constant columns, id columns, then sparse rows over what remains."""
    wide = _sparse(spark, sf).withColumns({"empty": F.lit(None).cast("string"), "same": F.lit(7)})
    return CL.clean_survey(wide, drop_constants=True, row_null_ratio=0.25)


@register("regex_cohort_no_match", "SELECT p_partkey, p_name FROM part")
def q_regex_cohort_no_match(spark, sf):
    """unfiltered when no row matches."""
    return CL.regex_cohort(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name"], "no such words anywhere")


@register("datetime_cast", """
SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_orderdate AS TIMESTAMP) END AS updated FROM orders""")
def q_datetime_cast(spark, sf):
    """P10: text to timestamps; text that is no date becomes NULL."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "1-URGENT",
                                                               F.col("o_orderdate").cast("string")).otherwise("soon").alias("updated"))
    return CL.cast_datetimes(o, ["updated", "no_such_column"])


@register("missing_token_normalise", f"""
SELECT entity_id, CASE WHEN lower(trim(segment)) IN {_MISSING} THEN NULL ELSE segment END AS segment FROM (
  SELECT c_custkey AS entity_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN ' Not Reported '
         WHEN c_mktsegment = 'HOUSEHOLD' THEN 'n/a' ELSE ' ' || c_mktsegment END AS segment FROM customer)""")
def q_missing_token_normalise(spark, sf):
    """Missing-value tokens become NULL, other text is untouched."""
    from cohortlens.plans.standins import customer_domain
    return CL.normalize_missing_tokens(customer_domain(spark, sf).select("entity_id", "segment"))


@register("scoring_schema", """
SELECT CAST(s_acctbal AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS absent, s_suppkey AS key FROM supplier""", doubles=["value"])
def q_scoring_schema(spark, sf):
    """Label and domain dropped, absent features added as NULL, order as listed, other columns kept."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").cast("double").alias("value"),
                                            F.lit(1).alias("label"), F.lit("d").alias("domain"))
    return CL.enforce_schema(s, ["value", "absent"])


_INPUT_SQL = """
SELECT c_custkey, g AS gender, lower(trim(g)) AS sex,
       CASE lower(trim(e)) WHEN 'not hispanic' THEN 'not hispanic or latino' WHEN 'hispanic' THEN 'hispanic or latino'
            ELSE lower(trim(e)) END AS ethnicity,
       CASE lower(trim(r)) WHEN 'black' THEN 'black or african american' ELSE lower(trim(r)) END AS race,
       CASE WHEN c_nationkey <> 2 THEN CAST(c_nationkey AS DOUBLE) END AS age_years,
       CASE WHEN c_nationkey % 4 = 0 THEN 1.0 ELSE 0.0 END AS tobacco_smoking_status_any
FROM (SELECT c_custkey, c_nationkey,
             CASE WHEN c_nationkey % 2 = 0 THEN ' Male' ELSE 'FEMALE ' END AS g,
             CASE c_nationkey % 3 WHEN 0 THEN ' Hispanic' WHEN 1 THEN 'not hispanic' ELSE 'Other ' END AS e,
             CASE c_nationkey % 3 WHEN 0 THEN 'Black' WHEN 1 THEN ' WHITE' ELSE NULL END AS r FROM customer)"""


@register("input_normalise", _INPUT_SQL, doubles=["age_years", "tobacco_smoking_status_any"])
def q_input_normalise(spark, sf):
    """P24 + P25: scoring inputs normalised, a missing smoker flag read as 0."""
    n = F.col("c_nationkey")
    df = table(spark, sf, "customer").select(
        "c_custkey", F.when(n % 2 == 0, " Male").otherwise("FEMALE ").alias("gender"),
        F.when(n % 3 == 0, " Hispanic").when(n % 3 == 1, "not hispanic").otherwise("Other ").alias("ethnicity"),
        F.when(n % 3 == 0, "Black").when(n % 3 == 1, " WHITE").alias("race"),
        F.when(n != 2, n.cast("string")).otherwise("x").alias("age_years"),
        F.when(n % 4 == 0, "1").alias("tobacco_smoking_status_any"))
    return CL.assume_non_smoker(CL.normalize_inputs(df))


@register("stage_ordinal", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 16 END AS stage_ord FROM part""")
def q_stage_ordinal(spark, sf):
    """C11: stage text to its ordinal; unknown stages NULL, the source column dropped."""
    k = F.col("p_size") % 5
    p = table(spark, sf, "part").select("p_partkey", F.when(k == 0, "Stage 0").when(k == 1, " stage IA").when(k == 2, "STAGE IIC")
                                        .when(k == 3, "Stage IVC").otherwise("Stage X").alias("stage"))
    return CL.ajcc_stage_ordinal(p, "stage")


@register("prior_modes", with_sql(PU_SQL) + """
, x AS (SELECT doc_id, score AS p, CASE WHEN lang = 'de' THEN 0.0 ELSE 0.2 END AS q FROM pu WHERE score > 0.01 AND score < 0.99)
SELECT doc_id, greatest(p, q) AS floor_p, 0.7 * p + 0.3 * q AS blend_p FROM x""", doubles=["floor_p", "blend_p"])
def q_prior_modes(spark, sf):
    """Prior by floor and by blend; a missing prior counts as 0."""
    x = pu_cohort(spark, sf).where("score > 0.01 AND score < 0.99").select(
        "doc_id", F.col("score").alias("p"), F.when(F.col("lang") != "de", 0.2).alias("q"))
    return x.select("doc_id", X.apply_prior("p", "q", "floor").alias("floor_p"),
                    X.apply_prior("p", "q", "blend", 0.3).alias("blend_p"))


@register("prior_odds", with_sql(PU_SQL) + """
SELECT doc_id, 1 / (1 + exp(-(ln(score / (1 - score)) + 0.5 * ln(0.2 / 0.8)))) AS odds_p
FROM pu WHERE score > 0.01 AND score < 0.99""", doubles=["odds_p"])
def q_prior_odds(spark, sf):
    """Prior added in log odds."""
    x = pu_cohort(spark, sf).where("score > 0.01 AND score < 0.99").select("doc_id", F.col("score").alias("p"), F.lit(0.2).alias("q"))
    return x.select("doc_id", X.apply_prior("p", "q", "odds", 0.5).alias("odds_p"))


@register("age_from_days", """
SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 365.25 * 10, 0) / 10 AS age_dx_years FROM lineitem""",
          doubles=["age_dx_years"])
def q_age_from_days(spark, sf):
    """Days to years at one decimal, the source column replaced."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("age_dx"))
    return CL.add_age_from_days(li, "age_dx")


@register("entity_key_fallback", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS case_key FROM orders""")
def q_entity_key_fallback(spark, sf):
    """A4: the submitter id is the key where no case id is given."""
    o = table(spark, sf, "orders").select("o_orderkey", F.lit(None).cast("string").alias("case_id"),
                                          F.col("o_custkey").alias("submitter_id"))
    return RU.entity_key(o).select("o_orderkey", "case_key")


@register("filled_from_rollup", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, m) AS value
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS m FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
          doubles=["value"])
def q_filled_from_rollup(spark, sf):
    """J2 + J3: a roll-up attached by key, missing values filled from it."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("m"))
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("value"))
    return RU.fill_from(RU.attach(o, "o_orderkey", li), "value", "m").select("o_orderkey", "value")
