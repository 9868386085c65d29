"""Nested ingest / flatten, triage, models, scoring and streaming."""
import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources import nested as N
from cohortlens.operators import explain as XP
from cohortlens.plans import train as TR
from tests.conftest import SF_SMALL

CASE_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("submitter_id", T.StringType()),
    T.StructField("disease_type", T.StringType()),
    T.StructField("project", T.StructType([T.StructField("project_id", T.StringType())])),
    T.StructField("demographic", T.StructType([T.StructField("gender", T.StringType()),
                                               T.StructField("days_to_birth", T.DoubleType())])),
    T.StructField("exposures", T.ArrayType(T.StructType([T.StructField("tobacco_smoking_status", T.StringType()),
                                                         T.StructField("pack_years_smoked", T.DoubleType())]))),
    T.StructField("diagnoses", T.ArrayType(T.StructType([
        T.StructField("diagnosis_id", T.StringType()), T.StructField("age_at_diagnosis", T.DoubleType()),
        T.StructField("treatments", T.ArrayType(T.StructType([T.StructField("treatment_type", T.StringType())]))),
    ]))),
])

CASES = [
    {"case_id": "c1", "submitter_id": "s1", "disease_type": "Colon adenocarcinoma", "project": {"project_id": "P1"},
     "demographic": {"gender": "female", "days_to_birth": -20000.0},
     "exposures": [{"tobacco_smoking_status": "Current Smoker", "pack_years_smoked": 10.0},
                   {"tobacco_smoking_status": "never", "pack_years_smoked": None}],
     "diagnoses": [{"diagnosis_id": "d1", "age_at_diagnosis": 20000.0,
                    "treatments": [{"treatment_type": "Surgery"}, {"treatment_type": "Chemotherapy"}]}]},
    {"case_id": "c2", "submitter_id": "s2", "disease_type": "Lung", "project": {"project_id": "P2"},
     "demographic": {"gender": "Not Reported", "days_to_birth": None}, "exposures": [],
     "diagnoses": [{"diagnosis_id": "d2", "age_at_diagnosis": 3652.5, "treatments": []},
                   {"diagnosis_id": "d3", "age_at_diagnosis": 7305.0, "treatments": None}]},
]


@pytest.fixture(scope="module")
def case_files():
    d = tempfile.mkdtemp(prefix="cohortlens-test-")
    with open(os.path.join(d, "lines.json"), "w") as f:
        f.write("\n".join(json.dumps(c) for c in CASES))
    os.makedirs(os.path.join(d, "concat"))
    with open(os.path.join(d, "concat", "cases.json"), "w") as f:
        f.write("".join(json.dumps(c) for c in CASES))
    return d


def test_read_layouts(spark, case_files):
    a = N.read_nested_json(spark, os.path.join(case_files, "lines.json"), CASE_SCHEMA, "lines")
    b = N.read_nested_json(spark, os.path.join(case_files, "concat"), CASE_SCHEMA, "concatenated")
    assert a.count() == 2 and b.count() == 2
    assert sorted(r[0] for r in b.select("case_id").collect()) == ["c1", "c2"]


def test_flatten_cases_relations(spark, case_files):
    cases = N.read_nested_json(spark, os.path.join(case_files, "lines.json"), CASE_SCHEMA)
    rel = N.flatten_cases(cases)
    assert set(rel) == {"cases", "exposures", "diagnoses", "treatments"}
    assert rel["cases"].columns[:2] == ["case_submitter_id", "case_id"]
    assert "dem_gender" in rel["cases"].columns and "project_id" in rel["cases"].columns
    assert rel["exposures"].count() == 2
    assert rel["diagnoses"].count() == 3
    tr = rel["treatments"]
    assert tr.columns[:3] == ["case_submitter_id", "case_id", "diagnosis_id"] and tr.count() == 2


def test_build_raw_dataset_from_nested(spark, case_files):
    from cohortlens.operators import rollup as RU
    cases = N.read_nested_json(spark, os.path.join(case_files, "lines.json"), CASE_SCHEMA)
    rel = N.flatten_cases(cases)
    raw = RU.build_raw_dataset(rel["cases"], rel["exposures"], None, rel["diagnoses"])
    got = {r["case_id"]: r for r in raw.collect()}
    assert got["c1"]["tobacco_smoking_status_any"] == 1.0
    assert got["c1"]["pack_years_smoked_max"] == 10.0
    assert got["c1"]["age_years"] == pytest.approx(54.8)      # -(-20000)/365.25, 1 dp
    assert got["c2"]["age_years"] == pytest.approx(15.0)      # median of 10.0 and 20.0 (T2: key join)
    assert got["c2"]["sex"] is None and got["c1"]["sex"] == "female"
    assert {r["label"] for r in got.values()} == {1}


def test_triage(spark):
    t = {"a": spark.createDataFrame([(1, 2.0)], "x int, BMI double"), "b": spark.createDataFrame([(1,)], "y int"),
         "c": spark.createDataFrame([], "bmi double")}
    rep = {r["table"]: r for r in N.triage_report(t, ["bmi"]).collect()}
    assert rep["a"]["kept"] and rep["a"]["matched_columns"] == "BMI"
    assert not rep["b"]["kept"] and rep["b"]["reason"] == "no_useful_columns"
    assert rep["c"]["reason"] == "empty_table"


@pytest.fixture(scope="module")
def trained(spark):
    from cohortlens.plans.q_weights import pu_features
    from cohortlens.operators import weights as W
    df = W.hash_split(pu_features(spark, SF_SMALL), "doc_id").cache()
    res = TR.train_and_validate(df, TR.TrainConfig(model="logreg", prior_percentiles=(10, 50, 90),
                                                   prior_probs=(0.05, 0.2, 0.5)))
    return df, res


def test_training_run_metrics(spark, trained):
    df, res = trained
    m = TR.split_metrics(df, res, "logreg").collect()
    assert [r["split"] for r in m] == ["val", "test"]
    for r in m:
        assert 0.0 <= r["brier"] <= 1.0
        assert r["auroc"] is None or 0.0 <= r["auroc"] <= 1.0
    assert 0.0 <= res.threshold <= 1.0
    assert res.scan.count() == 101


def test_batch_score_keeps_inputs_and_caps(spark, trained):
    df, res = trained
    out = TR.batch_score(df.drop("split"), res, keep=["doc_id", "lang"])
    assert out.columns == ["doc_id", "lang", "risk_probability", "prediction"]
    assert out.count() == df.count()
    mx = out.agg(F.max("risk_probability")).first()[0]
    assert mx <= 0.7 + 1e-12
    assert {r[0] for r in out.select("prediction").distinct().collect()} <= {"Riesgo Alto", "Riesgo Bajo"}


def test_shapley_efficiency(spark, trained):
    """Attributions of a row sum to score(row) - score(baseline)."""
    df, res = trained
    from cohortlens.plans.q_models import _scorer
    cfg = res.cfg
    rows = df.select("doc_id", *cfg.numeric, *cfg.categorical).limit(20)
    base = {n["col"]: n["median"] for n in res.encoder.numeric}
    for c in res.encoder.categorical:
        base[c["col"]] = c["categories"][0]
    scorer = _scorer(res)
    attr = XP.baseline_shapley(rows, "doc_id", {c: [c] for c in (*cfg.numeric, *cfg.categorical)}, base, scorer)
    tot = attr.groupBy("doc_id").agg(F.sum("attribution").alias("s"))
    full = scorer(rows).select("doc_id", "score")
    b = spark.createDataFrame([tuple(base[c] for c in (*cfg.numeric, *cfg.categorical))],
                              rows.drop("doc_id").schema)
    bscore = scorer(b.withColumn("doc_id", F.lit(-1).cast("bigint"))).first()["score"]
    for r in tot.join(full, "doc_id").collect():
        assert r["s"] == pytest.approx(r["score"] - bscore, abs=1e-9)


def test_permutation_importance_shape(spark, trained):
    df, res = trained
    from cohortlens.plans.q_models import _scorer
    cfg = res.cfg
    rows = df.select("doc_id", "label", *cfg.numeric, *cfg.categorical)
    imp = XP.permutation_importance(rows, "doc_id", "label", ["age_years", "lang"], _scorer(res), n_repeats=2)
    got = {r["feature"]: r for r in imp.collect()}
    assert set(got) == {"age_years", "lang"}
    assert all(r["importance_std"] >= 0 for r in got.values())


def test_streaming_scoring_matches_batch(spark, trained, tmp_path):
    df, res = trained
    from cohortlens.streaming.score import score_stream
    src = str(tmp_path / "in")
    df.drop("split").select("doc_id", "age_years", "lang", "source", "tobacco_smoking_status_any") \
        .write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = score_stream(stream, res, keep=["doc_id"]).writeStream.format("memory").queryName("scored_test") \
        .outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM scored_test")
    batch = score_stream(spark.read.parquet(src), res, keep=["doc_id"])
    assert got.count() == batch.count()
    diff = got.join(batch.withColumnRenamed("risk_probability", "b"), "doc_id") \
        .where(F.abs(F.col("risk_probability") - F.col("b")) > 1e-12).count()
    assert diff == 0


def test_save_load_roundtrip(spark, trained, tmp_path):
    df, res = trained
    path = str(tmp_path / "run")
    TR.save_result(res, path)
    back = TR.load_result(spark, path)
    assert back.threshold == res.threshold and back.anchors == res.anchors
    a = TR.batch_score(df.drop("split"), res, keep=["doc_id"]).withColumnRenamed("risk_probability", "a")
    b = TR.batch_score(df.drop("split"), back, keep=["doc_id"]).withColumnRenamed("risk_probability", "b")
    assert a.join(b, "doc_id").where(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0
    rep = TR.evaluate_saved(spark, path, df).collect()
    assert {r["domain"] for r in rep} >= {"all"}


def test_streaming_file_sink_with_checkpoint(spark, trained, tmp_path):
    df, res = trained
    from cohortlens.streaming.score import start_scoring
    src = str(tmp_path / "in2")
    df.drop("split").select("doc_id", "age_years", "lang", "source", "tobacco_smoking_status_any").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = start_scoring(stream, res, str(tmp_path / "out"), str(tmp_path / "ckpt"), keep=["doc_id"], trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == df.count()
    assert set(out.columns) == {"doc_id", "risk_probability", "prediction"}


def _newton_logreg(X, y, s, C=1.0, iters=50):
    """0.5 * ||w||^2 + C * sum s_i * logloss_i, intercept unpenalised (Newton steps)."""
    n, d = X.shape
    Xa = np.hstack([X, np.ones((n, 1))])
    w = np.zeros(d + 1)
    pen = np.eye(d + 1)
    pen[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xa @ w))
        g = pen @ w + C * Xa.T @ (s * (p - y))
        H = pen + C * (Xa * (s * p * (1 - p))[:, None]).T @ Xa
        w -= np.linalg.solve(H, g)
    return w


def test_logistic_regression_matches_reference_objective(spark):
    from pyspark.ml.feature import VectorAssembler
    from cohortlens.operators import models as M
    rng = np.random.default_rng(7)
    X = rng.normal(size=(400, 3))
    y = (X @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=400) > 0).astype(float)
    s = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))     # balanced class weights
    rows = [(float(a), float(b), float(c), float(t), float(w)) for (a, b, c), t, w in zip(X, y, s)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, sample_weight double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = M.fit_classifier(df, "logreg", 3, params={"tol": 1e-10, "maxIter": 500})
    want = _newton_logreg(X, y, s)
    got = np.append(model.coefficients.toArray(), model.intercept)
    assert np.allclose(got, want, atol=1e-4)


def test_platt_matches_soft_target_fit(spark):
    from cohortlens.operators import models as M
    rng = np.random.default_rng(3)
    p = np.clip(rng.beta(2, 2, 300), 1e-3, 1 - 1e-3)
    y = (rng.random(300) < p ** 1.5).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p_raw double, label int")
    platt = M.fit_platt(df, "p_raw", "label")
    n_pos, n_neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    m = np.log(p / (1 - p))[:, None]
    # soft targets as two weighted rows, no penalty (huge C)
    X2 = np.vstack([m, m])
    y2 = np.concatenate([np.ones(300), np.zeros(300)])
    s2 = np.concatenate([t, 1 - t])
    want = _newton_logreg(X2, y2, s2, C=1e9)
    assert [platt.a, platt.b] == pytest.approx(list(want), abs=1e-4)


def test_batch_score_completes_missing_inputs(spark, trained):
    """Scoring input lacking a feature (and with gender instead of sex) still scores every row."""
    df, res = trained
    inp = df.select("doc_id", "age_years", "lang", "source")          # no smoker column
    out = TR.batch_score(inp, res, keep=["doc_id"])
    assert out.where(F.col("risk_probability").isNull()).count() == 0
    assert out.count() == inp.count()


def test_batch_score_keeps_every_row(spark, trained, tmp_path):
    """Repeated and NULL keys, a missing smoker flag and an absent feature: as many rows out as in, stream = batch."""
    from cohortlens.plans.train import batch_score
    from cohortlens.streaming.score import score_stream
    df, res = trained
    rows = df.drop("split").limit(40)
    rows = rows.unionByName(rows).unionByName(rows.withColumn("doc_id", F.lit(None).cast("long")))
    rows = rows.withColumn("tobacco_smoking_status_any", F.lit(None).cast("double"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for table in (rows, rows.drop("source")):
        out = batch_score(table, res)
        got = out.collect()
        assert len(got) == rows.count() and out.columns[:len(table.columns)] == table.columns
        assert all(r.risk_probability is not None and r.prediction is not None for r in got)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        again = score_stream(table, res, keep=["doc_id", "age_years"])
        key = lambda r: (str(r.doc_id), str(r.age_years), round(r.risk_probability, 12), r.prediction)
        assert sorted(map(key, again.collect())) == sorted(map(key, got))


def test_preprocess_keeps_protected_columns(spark):
    """A clinical column that is 97% NULL stays, another such column goes; ids and hints are respected."""
    from cohortlens.plans.pipelines import preprocess
    rows = [(f"c{i}", f"s{i}", i % 2, float(i) if i % 33 == 0 else None, float(i) if i % 33 == 0 else None, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "case_key string, submitter_id string, target int, weight_last double, other double, grade int")
    pp = preprocess(df, "target", "case_key", categorical=["grade"], train=0.5, val=0.25)
    assert "weight_last" in pp.numeric and "other" in pp.dropped and "submitter_id" in pp.dropped
    assert pp.categorical == ["grade"]
    n = {r["split"]: r["count"] for r in pp.frame.groupBy("split").count().collect()}
    assert n == {"train": 200, "val": 100, "test": 100}
