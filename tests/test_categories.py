"""Encoding columns with any number of categories."""
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import clean as CL
from cohortlens.operators import features as FE


@pytest.mark.parametrize("listed", [5, 100_000])
def test_many_infrequent_categories(spark, monkeypatch, listed):
    """As a table or as a list: the same columns and values; an unseen category has none."""
    monkeypatch.setattr(FE, "LISTED", listed)
    train = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("c"), F.col("id").cast("string"))).alias("c"), (F.col("id") % 3).cast("string").alias("d"))
    enc = FE.Encoder.from_json(FE.fit_encoder(train, [], ["c", "d"]).to_json())
    assert enc.categorical[0]["categories"] == ["hot", "unknown"] and bool(enc.categorical[0].get("table")) == (listed == 5)
    assert enc.output_columns() == ["c_hot", "c_unknown", "c_infrequent_sklearn", "d_0", "d_1", "d_2"]
    assert enc.raw_columns() == ["c", "c", "c", "d", "d", "d"]
    probe = spark.createDataFrame([(0, "hot", "0"), (1, "c3", "1"), (2, "never", "2"), (3, None, "9"), (4, "c3", None)],
                                  "i int, c string, d string")
    got = [tuple(r) for r in enc.transform(probe, keep=["i"]).orderBy("i").collect()]
    assert got == [(0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0),
                   (3, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0), (4, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)]
    total = enc.transform(train).agg(F.count(F.lit(1)), F.sum("c_infrequent_sklearn"), F.sum("c_hot")).first()
    assert tuple(total) == (20_000, 8_000.0, 10_000.0)


def test_high_cardinality_is_counted_exactly(spark):
    df = spark.range(1002).select((F.col("id") % 500).cast("string").alias("at"), (F.col("id") % 501).cast("string").alias("over"),
                                  F.lit(None).cast("string").alias("none"), "id")
    assert CL.drop_high_cardinality(df, max_unique=500).columns == ["at", "none", "id"]
