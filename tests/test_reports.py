"""Composites of a training run: concordance tables, saved isotonic models, report tables."""
from pyspark.sql import functions as F

from cohortlens.plans import pipelines as PL
from cohortlens.plans import q_models as Q
from cohortlens.plans import train as TR
from tests.conftest import SF_SMALL


def test_concordance_persistence_and_tables(spark, tmp_path):
    df, res = Q._fit(spark, SF_SMALL, model="logreg", calibrate="isotonic")
    df = df.withColumn("bmi_last", (F.col("doc_id") % 20 + 15).cast("double"))
    table = TR.test_concordance(df, res).collect()
    n = {s: sum(r.n for r in table if r.section == s) for s in {r.section for r in table}}
    test = df.where("split = 'test'")
    unlabelled = test.where("domain = 'unlabelled'").count()
    assert n == {"domain": test.count(), "unlabeled_age_bin": unlabelled, "unlabeled_bmi_bin": unlabelled}
    assert [r.bin for r in sorted((r for r in table if r.section == "unlabeled_bmi_bin"), key=lambda r: r.bin_order)] == [
        "<18.5", "18.5-24.9", "25-29.9", "30-34.9", "35+"]

    TR.save_result(res, str(tmp_path / "m"))
    again = TR.load_result(spark, str(tmp_path / "m"))
    assert again.isotonic == res.isotonic
    a, b = (sorted(map(str, TR.batch_score(df.drop("split"), r, keep=["doc_id"]).collect())) for r in (res, again))
    assert a == b

    rows = df.select("doc_id", F.col("age_years").alias("age"), "bmi_last", "score")
    tables = PL.scientific_tables(rows, "doc_id", "age", "bmi_last", n_boot=20)
    decades = {r.age_decade: r for r in tables["age_decades"].collect()}
    assert len(decades) == 7 and sum(r.n for r in decades.values()) == rows.where("age >= 20 AND age <= 120").count()
    assert all(r.ci_low <= r.mean_proba <= r.ci_high for r in decades.values() if r.n > 5)
    assert sum(r.n for r in tables["age_bmi_grid"].collect()) == rows.where("age >= 0 AND bmi_last >= 0").count()
