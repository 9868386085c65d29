"""Isotonic calibration on the PU cohort's deterministic pseudo-score (SQL: the max-min formula)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import isotonic as I
from cohortlens.operators import weights as W
from cohortlens.plans.catalog import register
from cohortlens.plans.standins import PU_SQL, pu_cohort, with_sql

# the fit at a score is the largest, over all starts at or below it, of the smallest mean up to any end at or above it
_FIT_SQL = """
, g AS (SELECT score AS s, row_number() OVER (ORDER BY score) AS i, sum(sum(label)) OVER (ORDER BY score) AS cy,
               sum(count(*)) OVER (ORDER BY score) AS cn, sum(label) AS y, count(*) AS n FROM {rows} GROUP BY score),
m AS (SELECT a.i AS a, b.i AS b, CAST(b.cy - a.cy + a.y AS DOUBLE) / (b.cn - a.cn + a.n) AS mean FROM g a JOIN g b ON b.i >= a.i),
lowest AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS low FROM m),
fit AS (SELECT i, max(low) AS v FROM lowest GROUP BY i),
blocks AS (SELECT min(s) AS lo, max(s) AS hi, CAST(sum(n) AS DOUBLE) AS weight, v AS value FROM fit JOIN g USING (i) GROUP BY v)
"""


@register("isotonic_blocks", with_sql(PU_SQL) + _FIT_SQL.format(rows="pu") + "SELECT lo, hi, weight, value FROM blocks",
          doubles=["lo", "hi", "weight", "value"])
def q_isotonic_blocks(spark, sf):
    """The steps of the isotonic fit of the label on the score, from blocks merged over score ranges."""
    return I.isotonic_blocks(pu_cohort(spark, sf), "score", "label")


_U = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0"


@register("isotonic_scores", with_sql(PU_SQL) + f"""
, va AS (SELECT * FROM pu WHERE {_U} >= 0.7 AND {_U} < 0.85), te AS (SELECT doc_id, score FROM pu WHERE {_U} >= 0.85)
""" + _FIT_SQL.format(rows="va") + """
, steps AS (SELECT lo, hi, value, lead(lo) OVER (ORDER BY lo) AS nlo, lead(value) OVER (ORDER BY lo) AS nvalue,
                   row_number() OVER (ORDER BY lo) AS k FROM blocks)
SELECT doc_id, CASE WHEN score <= hi OR nlo IS NULL THEN value
                    ELSE value + (nvalue - value) * (score - hi) / (nlo - hi) END AS p_cal
FROM te JOIN steps ON (score >= lo OR k = 1) AND (score < nlo OR nlo IS NULL)""", doubles=["p_cal"])
def q_isotonic_scores(spark, sf):
    """Fitted on the validation split, applied to the test split (steps, linear between them, flat beyond)."""
    df = W.hash_split(pu_cohort(spark, sf), "doc_id", seed=42)
    model = I.fit_isotonic(df.where("split = 'val'"), "score", "label")
    return df.where("split = 'test'").select("doc_id", model.apply(F.col("score")).alias("p_cal"))
