"""Operator semantics: traps, golden replays of published
result rows, invariants and brute-force comparisons on small frames."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.operators import canonical as C
from cohortlens.operators import clean as CL
from cohortlens.operators import evaluate as E
from cohortlens.operators import ordered as O
from cohortlens.operators import risk as K
from cohortlens.operators import rollup as RU
from cohortlens.operators import selection as S
from cohortlens.operators import weights as W


# ------------------------------------------------------------------ goldens --

def test_odds_row_recomputes_published_value(spark):
    """First numeric odds row of the published EDA table: n/pos/neg plus the
    cohort totals 21,501 positives / 11,933 negatives give its OR and weight."""
    per = spark.createDataFrame([("Q1", 898, 7157), (None, 21501 - 898, 11933 - 7157)],
                                "bin string, pos bigint, neg bigint")
    row = K._odds_from_counts(per, "bin", 0.5).where("bin = 'Q1'").first()
    assert row["n"] == 8055
    assert row["pos_rate"] == pytest.approx(0.11148355058969583, abs=1e-15)
    assert row["odds_ratio"] == pytest.approx(0.02910217881333656, abs=1e-15)
    assert row["weight"] == pytest.approx(0.5008462201167159, abs=1e-14)


# published validation scan, thresholds 0.10 .. 0.50 (golden values): precision, recall, F1
_SCAN_PREC = [0.8896031302403578, 0.9005665722379603, 0.9082595027150614, 0.9129310344827586, 0.9313782991202346,
            0.9440809042236764, 0.9556962025316456, 0.9606060606060606, 0.9611885991510006, 0.9643944004869142,
            0.9661482159194876, 0.9664224664224664, 0.9667175572519084, 0.9672982885085575, 0.9681762545899633,
            0.9687691365584813, 0.9687691365584813, 0.9687691365584813, 0.9693439607602697, 0.9699386503067484,
            0.9707872078720787, 0.9713581767785648, 0.9731564331996297, 0.9737492279184682, 0.9737411183194316,
            0.9740420271940667, 0.9743113587124729, 0.9742874845105328, 0.9742795165788658, 0.9742795165788658,
            0.9745499689633768, 0.9751552795031055, 0.9757236227824463, 0.9763166095356809, 0.9780839073262367,
            0.9783834586466166, 0.9783766844249452, 0.9792648444863337, 0.9795661741590694, 0.9798678829820698,
            0.9801449732114718]
_SCAN_RECALL = [0.9869767441860465, 0.9857364341085272, 0.9854263565891472, 0.9851162790697674, 0.9848062015503876,
                0.9841860465116279, 0.9832558139534884, 0.9829457364341085, 0.9829457364341085, 0.9826356589147287,
                0.9823255813953489, 0.9817054263565892, 0.9817054263565892, 0.9813953488372092, 0.9810852713178294,
                0.9810852713178294, 0.9810852713178294, 0.9810852713178294, 0.9804651162790697, 0.9804651162790697,
                0.9789147286821706, 0.977984496124031, 0.977984496124031, 0.9776744186046512, 0.9773643410852714,
                0.9773643410852714, 0.9761240310077519, 0.9751937984496124, 0.9748837209302326, 0.9748837209302326,
                0.9736434108527132, 0.9736434108527132, 0.9720930232558139, 0.9714728682170543, 0.9686821705426356,
                0.9683720930232558, 0.9680620155038759, 0.9665116279069768, 0.9662015503875969, 0.9658914728682171,
                0.9643410852713178]
_SCAN_F1 = [0.9357636336910187, 0.9412287194670614, 0.9452706722189174, 0.9476510067114094, 0.957347400150716,
              0.9637164111127979, 0.9692801467216873, 0.9716475095785441, 0.9719454238847156, 0.9734295807095684,
              0.974169741697417, 0.97400399938471, 0.9741538461538461, 0.9742958288440818, 0.9745880178653935,
              0.9748883068864582, 0.9748883068864582, 0.9748883068864582, 0.9748728225682134, 0.9751734772552043,
              0.9748340280994288, 0.9746600741656366, 0.9755644911846583, 0.9757078755995667, 0.9755493655215104,
              0.9757003559820461, 0.9752168525402726, 0.9747404308073764, 0.9745815251084935, 0.9745815251084935,
              0.9740964789824724, 0.9743987587276959, 0.9739049394221808, 0.9738887161952129, 0.9733603365010126,
              0.9733520336605891, 0.9731920199501247, 0.9728464419475655, 0.9728379644083671, 0.9728294815740163,
              0.9721788058768365]


def test_threshold_choice_replays_published_scan(spark):
    """F1 choice in [0.1, 0.5] with min recall 0.8 on the published scan -> 0.33 (threshold.json)."""
    rows = [(i * 0.01, _SCAN_PREC[i - 10], _SCAN_RECALL[i - 10], _SCAN_F1[i - 10]) for i in range(10, 51)]
    rows = [(i * 0.01, 0.5, 0.5, 0.5) for i in range(10)] + rows + [(i * 0.01, 0.99, 0.1, 0.2) for i in range(51, 101)]
    scan = spark.createDataFrame(rows, "threshold double, precision double, recall double, f1 double")
    best = E.choose_threshold(scan, "f1", min_threshold=0.1, max_threshold=0.5, min_recall=0.8).first()
    assert best["threshold"] == pytest.approx(0.33)
    assert best["f1"] == pytest.approx(0.9757078755995667)
    assert best["precision"] == pytest.approx(0.9737492279184682)


def test_cohen_d_formula_published_row():
    """Numeric drift: d = diff / sqrt((s1^2 + s2^2) / 2) with population std (published row)."""
    tm, im, ts, is_ = 49.943635835270676, 53.85, 17.564848893585676, 13.911416175213795
    assert (im - tm) / math.sqrt((ts ** 2 + is_ ** 2) / 2) == pytest.approx(0.246554893525506, rel=1e-12)


def test_numeric_drift_matches_numpy(spark):
    a = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "v double")
    b = spark.createDataFrame([(float(x),) for x in (2, 4, 6)], "v double")
    r = K.numeric_drift(a, b, ["v"]).first()
    x, y = np.array([1, 2, 3, 4, 10.0]), np.array([2, 4, 6.0])
    d = (y.mean() - x.mean()) / math.sqrt((x.std() ** 2 + y.std() ** 2) / 2)
    assert r["cohen_d"] == pytest.approx(d)
    assert r["train_p90"] == pytest.approx(np.percentile(x, 90))
    assert r["input_median"] == pytest.approx(4.0)


# ----------------------------------------------------------------- traps ----

def test_t1_smoking_keywords(spark):
    df = spark.createDataFrame([("never",), ("Non-smoker",), ("Current smoker",), ("not reported",), ("1",),
                                (None,), ("former",)], "s string")
    fixed = [r[0] for r in df.select(X.smoking_status("s")).collect()]
    legacy = [r[0] for r in df.select(X.smoking_status("s", legacy=True)).collect()]
    assert fixed == [0.0, 0.0, 1.0, None, 1.0, None, 1.0]
    assert legacy == [1.0, 1.0, 1.0, None, 1.0, None, 1.0]


def test_t11_threshold_grid_is_i_times_001(spark):
    df = spark.createDataFrame([(1, 0.35, "a"), (0, 0.7, "a"), (1, 0.7, "b")], "label int, score double, domain string")
    scan = {round(r["threshold"], 2): r for r in E.threshold_scan(df, with_ranking=False).collect()}
    assert scan[0.35]["pred_pos"] == 2          # 0.35 < 35 * 0.01 = 0.35000000000000003
    assert scan[0.34]["pred_pos"] == 3
    assert scan[0.7]["pred_pos"] == 0           # 0.7 < 70 * 0.01 = 0.7000000000000001
    assert scan[0.69]["pred_pos"] == 2
    assert len(scan) == 101


def test_t12_ties_first_threshold_and_recall_precision(spark):
    scan = spark.createDataFrame([(0.1, 0.5, 0.9, 0.6), (0.2, 0.7, 0.9, 0.6), (0.3, 0.8, 0.5, 0.6)],
                                 "threshold double, precision double, recall double, f1 double")
    assert E.choose_threshold(scan, "f1").first()["threshold"] == pytest.approx(0.1)
    assert E.choose_threshold(scan, "recall").first()["threshold"] == pytest.approx(0.2)
    none = E.choose_threshold(scan, "recall", min_precision=0.99).first()
    assert none["threshold"] == pytest.approx(0.1)   # no candidate -> first row


def test_t20_half_even_rounding(spark):
    r = spark.range(1).select(X.round1_even(F.lit(0.25)).alias("a"), X.round1_even(F.lit(0.35)).alias("b")).first()
    assert r["a"] == 0.2 and r["b"] == 0.4


def test_t10_band_greater_is_inclusive(spark):
    bands = W.parse_age_bands("<30:0.1,30-45:0.6,>75:8")
    df = spark.createDataFrame([(20.0,), (30.0,), (75.0,), (None,), (50.0,)], "age_years double")
    w = [r[0] for r in W.band_weights(df, bands).select("band_weight").collect()]
    assert w == [0.1, 0.6, 8.0, 1.0, 1.0]


def test_t13_categorical_unexposed_excludes_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (0, "a"), (1, "b"), (0, "b"), (1, None), (1, None)], "label int, c string")
    r = K.risk_2x2(df, [K.Exposure("c", F.col("c"), "categorical"), K.Exposure("f", F.col("c"), "bins")],
                   min_count=1).where("category = 'a'").orderBy("feature").collect()
    cat, bins = r[0], r[1]
    # categorical: unexposed = 'b' only (a=1,b=1,c=1,d=1); bins: unexposed includes the NULL rows (c=3)
    assert cat["risk_unexposed"] == pytest.approx(0.5)
    assert bins["risk_unexposed"] == pytest.approx(0.75)


def test_2x2_zero_cell_smoothing_and_chi2(spark):
    df = spark.createDataFrame([(1, "x")] * 5 + [(0, "y")] * 5 + [(1, "y")] * 2, "label int, c string")
    r = K.risk_2x2(df, [K.Exposure("c", F.when(F.col("c") == "x", "x"), "flag")], min_count=1,
                   with_p_value=True).first()
    a, b, c, d = 5, 0, 2, 5
    assert r["odds_ratio"] == pytest.approx(((a + .5) / (b + .5)) / ((c + .5) / (d + .5)))
    n = a + b + c + d
    chi2 = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert r["chi2"] == pytest.approx(chi2)
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(chi2 / 2)))


def test_t3_last_known_undated_wins_and_tiebreak(spark):
    df = spark.createDataFrame([
        (1, 1, "2020-01-01", 10.0), (1, 2, "2021-01-01", 20.0), (1, 3, None, 30.0), (1, 4, "2022-01-01", None),
        (2, 5, "2020-01-01", 1.0), (2, 6, "2020-01-01", 2.0)], "k int, rk int, d string, v double")
    out = dict(RU.last_known(df.withColumn("d", F.to_timestamp("d")), "k", ["v"], "d", "rk").collect())
    assert out == {1: 30.0, 2: 2.0}


def test_coded_survey_maps(spark):
    df = spark.createDataFrame([(1, 1, 1, None), (2, 5, None, 3), (None, None, 2, 1)],
                               "riagendr int, ridreth3 int, smq020 int, smq040 int")
    out, used = C.align_domain_b(df)
    rows = out.select("sex", "ethnicity", "race", "tobacco_smoking_status_any", "label").collect()
    assert [r["sex"] for r in rows] == ["male", "female", None]
    assert [r["ethnicity"] for r in rows] == ["hispanic or latino", "not hispanic or latino", "not hispanic or latino"]
    assert [r["race"] for r in rows] == [None, None, None]
    assert [r["tobacco_smoking_status_any"] for r in rows] == [1.0, 0.0, 0.0]
    assert {r["label"] for r in rows} == {0}
    assert used["sex"] == ["riagendr"]


def test_align_domain_a_age_chain(spark):
    df = spark.createDataFrame([(-3652.5 * 2, 1000.0, "Female", "not reported"), (None, 365.25 * 5, "male", "white")],
                               "dem_days_to_birth double, mean_age_at_dx double, dem_gender string, dem_race string")
    out, _ = C.align_domain_a(df)
    rows = out.select("age_years", "sex", "race", "label").collect()
    assert [r["age_years"] for r in rows] == [20.0, 5.0]
    assert [r["race"] for r in rows] == [None, "white"]
    assert {r["label"] for r in rows} == {1}


# --------------------------------------------------------- ranking metrics --

def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def _brute_ap(y, s):
    order = np.argsort(-s, kind="mergesort")
    ap, P = 0.0, y.sum()
    for t in np.unique(s)[::-1]:
        pred = s >= t
        tp, fp = (pred & (y == 1)).sum(), (pred & (y == 0)).sum()
        ap += ((y[s == t] == 1).sum() / P) * tp / (tp + fp)
    return ap


def test_auroc_ap_against_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) * 0.6 + 0.3 * y, 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    r = E.auroc_ap(df).first()
    assert r["auroc"] == pytest.approx(_brute_auc(y, s), abs=1e-12)
    assert r["auprc"] == pytest.approx(_brute_ap(y, s), abs=1e-12)
    one = E.auroc_ap(df.where("label = 1")).first()
    assert one["auroc"] is None and one["auprc"] is None


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = rng.normal(size=500).round(2)
    grp = rng.integers(0, 3, 500)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(grp, vals)], "g int, v double")
    q = S.quantiles_wide(df, "v", [0.1, 0.5, 0.9], ["a", "b", "c"], ["g"], finish=4).collect()
    for r in q:
        x = vals[grp == r["g"]]
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(np.percentile(x, [10, 50, 90])), abs=1e-12)


def test_dense_rank_is_a_permutation(spark):
    df = spark.range(0, 1000).withColumn("g", F.col("id") % 3).withColumn("h", X.hash_u32(F.col("id")))
    r = O.dense_rank_global(df, ["g"], [F.col("h"), F.col("id")], buckets=5)
    agg = r.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("rank0").alias("d"),
                             F.min("rank0").alias("lo"), F.max("rank0").alias("hi")).collect()
    for a in agg:
        assert a["n"] == a["d"] == a["hi"] + 1 and a["lo"] == 0
    got = r.select("g", "h", "id", "rank0").toPandas()
    want = got.sort_values(["g", "h", "id"]).groupby("g").cumcount()
    assert (got.loc[want.index, "rank0"].values == want.values).all()


def test_running_sums_consistent_when_reused(spark):
    """Buckets are a pure function of the row, so two consumers of one frame agree."""
    df = spark.range(0, 3000).withColumn("g", (F.col("id") % 2).cast("int")) \
        .withColumn("h", X.hash_u32(F.col("id"))).withColumn("one", F.lit(1))
    r = O.running_sums(df, ["g"], [F.col("h"), F.col("id")], ["one"], buckets=7, totals=True)
    a = r.select("g", "id", "cum_one", "tot_one")
    b = r.select("g", "id", F.col("cum_one").alias("c2"))
    j = a.join(b, ["g", "id"])
    assert j.where(F.col("cum_one") != F.col("c2")).count() == 0
    assert {x[0] for x in r.select("tot_one").distinct().collect()} == {1500}


# -------------------------------------------------------------- invariants --

def test_pu_weights_sum_to_rows(spark):
    df = spark.createDataFrame([(1, "l"), (0, "l"), (0, "u"), (0, "u"), (1, "u")], "label int, domain string")
    out = W.pu_rows(df, prob=0.2, unlabeled_domain="u")
    assert out.count() == 7
    assert out.agg(F.sum("pu_weight")).first()[0] == pytest.approx(5.0)
    assert out.where("is_pu_copy").select(F.min("label")).first()[0] == 1


def test_band_normalise_mean_one(spark):
    df = spark.createDataFrame([(float(a),) for a in (10, 20, 35, 50, 80, 90)], "age_years double")
    out = W.band_weights(df, "<30:0.1,30-45:0.6,>75:8", normalize=True)
    assert out.agg(F.avg("band_weight")).first()[0] == pytest.approx(1.0)


def test_split_shares(spark):
    df = spark.range(0, 2000).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    ex = W.stratified_split(df, "id", "label").groupBy("label", "split").count().collect()
    got = {(r["label"], r["split"]): r["count"] for r in ex}
    assert got[(1, "train")] == 350 and got[(1, "val")] == 75 and got[(0, "train")] == 1050
    hs = W.hash_split(df, "id").groupBy("split").count().collect()
    shares = {r["split"]: r["count"] / 2000 for r in hs}
    assert abs(shares["train"] - 0.7) < 0.05


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 9, "label int")
    out = W.class_weights(df).groupBy("label").agg(F.sum("class_weight").alias("s")).collect()
    assert {r["label"]: r["s"] for r in out} == {1: pytest.approx(6.0), 0: pytest.approx(6.0)}


def test_missing_injection_is_reproducible(spark):
    df = spark.range(0, 500).withColumn("a", F.col("id").cast("double"))
    o1 = W.inject_missingness(df, "id", ["a"], 0.5, 0.5, seed=1)
    o2 = W.inject_missingness(df, "id", ["a"], 0.5, 0.5, seed=1)
    n1 = o1.where("a is null").count()
    assert n1 == o2.where("a is null").count()
    assert 80 < n1 < 170


def test_age_prior_floor_blend_odds_and_cap(spark):
    df = spark.createDataFrame([(0.1, 30.0), (0.1, None), (0.9, 80.0)], "p double, age double")
    anchors = [(40.0, 0.2), (60.0, 0.6)]
    f = [r[0] for r in W.apply_age_prior(df, "p", "age", anchors, "floor", cap=0.7).select("p").collect()]
    assert f == pytest.approx([0.2, 0.1, 0.7])
    b = [r[0] for r in W.apply_age_prior(df, "p", "age", anchors, "blend", 0.5).select("p").collect()]
    assert b == pytest.approx([0.15, 0.05, 0.75])


# ----------------------------------------------------------------- cleaning --

def test_boolean_like_threshold_is_inclusive(spark):
    rows = [("yes",)] * 7 + [("maybe",)] * 3
    df = spark.createDataFrame(rows, "f string")
    assert dict(CL.coerce_boolean_like(df).dtypes)["f"] == "double"
    df2 = spark.createDataFrame(rows[:6] + [("maybe",)] * 4, "f string")
    assert dict(CL.coerce_boolean_like(df2).dtypes)["f"] == "string"


def test_numeric_cast_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "1"), ("2.5", "x"), (None, "3")], "a string, b string")
    out = CL.numeric_cast_columns(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string"}


def test_regex_cohort_unfiltered_when_nothing_matches(spark):
    df = spark.createDataFrame([("lung",), ("breast",)], "site string")
    assert CL.regex_cohort(df, ["site"]).count() == 2
    df2 = spark.createDataFrame([("Colon adenocarcinoma",), ("breast",)], "site string")
    assert CL.regex_cohort(df2, ["site"]).count() == 1


def test_duplicate_columns_confirmed_exactly(spark):
    df = spark.createDataFrame([(1, 5, 5, "a", "a", "b"), (2, 6, 6, "c", "c", "c")],
                               "k int, x int, y int, s string, t string, u string")
    dups = sorted(tuple(r) for r in CL.duplicate_columns(df, "k").collect())
    assert dups == [("t", "s"), ("y", "x")]


def test_snake_case_rule():
    assert X.snake(" Age-At Index.Years ") == "age_at_index_years"
    assert X.snake("a__b") == "a_b"


def test_merge_on_keys_suffixes(spark):
    from cohortlens.operators import joins as J
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    out = J.merge_on_keys([a, b], ["k"], "outer")
    assert sorted(out.columns) == ["k", "v", "v__1"]
    assert out.count() == 2
    with pytest.raises(ValueError):
        J.merge_on_keys([a, b.drop("k")], ["k"])


def test_data_sized_buckets_stay_exact(spark):
    """With a tiny row budget per bucket, many buckets are used; results are unchanged."""
    spark.conf.set("spark.cohortlens.rowsPerBucket", "50")
    try:
        df = spark.range(0, 2000).withColumn("g", (F.col("id") % 2).cast("int")) \
            .withColumn("h", X.hash_u32(F.col("id"))).withColumn("v", (F.col("id") % 97).cast("double"))
        r = O.dense_rank_global(df, ["g"], [F.col("h"), F.col("id")])
        got = r.select("g", "h", "id", "rank0").toPandas()
        want = got.sort_values(["g", "h", "id"]).groupby("g").cumcount()
        assert (got.loc[want.index, "rank0"].values == want.values).all()
        q = S.quantiles_wide(df, "v", [0.1, 0.5, 0.93], ["a", "b", "c"], ["g"]).collect()
        pdf = df.select("g", "v").toPandas()
        for row in q:
            x = pdf[pdf.g == row["g"]].v.values
            assert [row["a"], row["b"], row["c"]] == pytest.approx(list(np.percentile(x, [10, 50, 93])))
    finally:
        spark.conf.unset("spark.cohortlens.rowsPerBucket")


def test_encoder_infrequent_unseen_and_scaling(spark):
    from cohortlens.operators import features as FE
    rows = [(float(i % 10), "a" if i % 2 else "b") for i in range(198)] + [(None, "rare"), (5.0, None)]
    train = spark.createDataFrame(rows, "x double, c string")
    enc = FE.fit_encoder(train, ["x"], ["c"], min_frequency=0.01)
    assert enc.categorical[0]["categories"] == ["a", "b"]
    assert enc.categorical[0]["infrequent"] == ["rare", "unknown"]
    x = np.array([r[0] if r[0] is not None else np.nan for r in rows])
    med = np.nanmedian(x)
    imp = np.where(np.isnan(x), med, x)
    assert enc.numeric[0]["median"] == pytest.approx(med)
    assert enc.numeric[0]["scale"] == pytest.approx(imp.std())
    test = spark.createDataFrame([(None, "rare"), (1.0, "never-seen"), (2.0, "a")], "x double, c string")
    out = enc.transform(test).collect()
    assert [r["c_infrequent_sklearn"] for r in out] == [1.0, 0.0, 0.0]
    assert [r["c_a"] + r["c_b"] for r in out] == [0.0, 0.0, 1.0]       # unseen -> all zeros
    assert out[0]["x"] == pytest.approx((med - imp.mean()) / imp.std())


def test_flat_case_table_all_relations(spark):
    rel = {
        "cases": spark.createDataFrame([("a", "Alive", -3652.5), ("b", None, None), ("c", "dead", None)],
                                       "case_key string, dem_vital_status string, dem_days_to_birth double"),
        "family_histories": spark.createDataFrame([("a", "f1", "Sí"), ("a", "f2", "no"), ("b", "f3", None)],
                                                  "case_key string, family_history_id string, relative_with_cancer_history string"),
        "follow_ups": spark.createDataFrame([("a", "yes", 10.0), ("b", "no", 30.0)],
                                            "case_key string, progression_or_recurrence string, days_to_follow_up double"),
        "pathology_details": spark.createDataFrame([("c", "1", "no", None)],
                                                   "case_key string, vascular_invasion_present string, "
                                                   "lymphatic_invasion_present string, perineural_invasion_present string"),
        "other_clinical_attributes": spark.createDataFrame(
            [("a", 1, 170.0, None, 25.0), ("a", 2, None, 80.0, None), ("a", 3, 172.0, None, None)],
            "case_key string, pos int, height double, weight double, bmi double"),
        "molecular_tests": spark.createDataFrame([("c", "m1"), ("c", "m2"), ("c", None)],
                                                 "case_key string, molecular_test_id string"),
    }
    out = {r["case_key"]: r for r in RU.flat_case_table(rel, "case_key",
                                                        {"other_clinical_attributes": ["pos"]}).collect()}
    assert out["a"]["age_years"] == 10.0
    assert out["a"]["fam_hist_count"] == 2 and out["a"]["fam_hist_pos_any"] == 1
    assert out["a"]["label"] == 1            # alive, but progression forces 1
    assert out["b"]["label"] is None         # unknown vital status stays NULL (T5)
    assert out["c"]["label"] == 1 and out["c"]["vascular_invasion_any"] == 1 and out["c"]["lymphatic_invasion_any"] == 0
    assert out["c"]["n_molecular_tests"] == 2
    assert (out["a"]["height_last"], out["a"]["weight_last"], out["a"]["bmi_last"]) == (172.0, 80.0, 25.0)


def test_short_alignment_variants(spark):
    b = spark.createDataFrame([(1, 2, 1, "2"), (2, 1, 3, "1"), (3, 2, 6, "No")],
                              "SEQN int, RIAGENDR int, RIDRETH3 int, MCQ220 string")
    out = C.align_short_b(b).select("sex", "race").collect()
    assert [(r["sex"], r["race"]) for r in out] == [("female", None), ("female", "asian")]   # MCQ220=1 row dropped
    a = spark.createDataFrame([(" Female ", "Not Reported")], "dem_gender string, dem_race string")
    row = C.align_short_a(a).first()
    assert row["sex"] == " Female " and row["race"] == "Not Reported"     # no cleaning in the short variant


def test_a17_rare_categories_lumped_then_dropped(spark):
    rows = [(1, "x")] * 60 + [(0, "x")] * 60 + [(1, "y")] * 3 + [(0, "z")] * 2 + [(1, "w")] * 40 + [(0, "w")] * 70
    df = spark.createDataFrame(rows, "label int, c string")
    r = K.risk_2x2(df, [K.Exposure("c", F.col("c"), "categorical")], min_count=100).collect()
    assert sorted(x["category"] for x in r) == ["w", "x"]          # y, z -> 'other' (5 rows) -> dropped
    r2 = K.risk_2x2(df, [K.Exposure("c", F.col("c"), "categorical")], min_count=4).collect()
    assert sorted(x["category"] for x in r2) == ["other", "w", "x"]   # y (3) + z (2) lumped = 5 >= 4


def test_duplicate_columns_without_key(spark):
    df = spark.createDataFrame([(5, 5, 1), (6, 6, 2), (7, 7, 7)], "x int, y int, z int")
    assert [tuple(r) for r in CL.duplicate_columns(df).collect()] == [("y", "x")]


def test_mode_target_scale_published_value(spark):
    """Published mode target: base rate, target 0.7 and modal-bin OR give scale_k."""
    base, target, orv = 0.6430878746186517, 0.7, 9.438644241282248
    k = spark.range(1).select(((F.lit(X.py_logit(target)) - X.clamped_logit(F.lit(base))) / F.log(F.lit(orv)))
                              .alias("k")).first()["k"]
    assert k == pytest.approx(0.11515710252622674, rel=1e-12)


def test_age_band_parse_published_spec():
    """The published band report: '>' reads as an inclusive lower bound."""
    bands = W.parse_age_bands("<30:0.1,30-45:0.6,45-55:2,55-75:6,>75:8")
    got = [(b.raw, b.lo, b.hi, b.lo_inclusive, b.hi_inclusive, b.weight) for b in bands]
    assert got == [("<30", None, 30.0, True, False, 0.1), ("30-45", 30.0, 45.0, True, False, 0.6),
                   ("45-55", 45.0, 55.0, True, False, 2.0), ("55-75", 55.0, 75.0, True, False, 6.0),
                   (">75", 75.0, None, True, False, 8.0)]


def test_categorical_odds_row_published_value(spark):
    """Published categorical odds row (sex = female) from its counts and the cohort totals."""
    per = spark.createDataFrame([("female", 12308, 6358), (None, 21501 - 12308, 11933 - 6358)],
                                "category string, pos bigint, neg bigint")
    row = K._odds_from_counts(per, "category", 0.5).where("category = 'female'").first()
    assert row["n"] == 18666
    assert row["odds_ratio"] == pytest.approx(1.1739602555437891, rel=1e-14)
    assert row["weight"] == pytest.approx(1.079510856025276, rel=1e-14)


def test_dedupe_rows_keeps_smallest_row(spark):
    df = spark.createDataFrame([("k1", 1, "b"), ("k1", 1, "a"), ("k2", 0, "z")], "case_key string, label int, v string")
    out = sorted(tuple(r) for r in CL.dedupe_rows(df, "case_key", "label").collect())
    assert out == [("k1", 1, "a"), ("k2", 0, "z")]


def test_threshold_bucket_property(spark):
    """Bucket = largest i in 0..100 with i * 0.01 <= p (the reference's grid), over random scores."""
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.floats(min_value=-0.5, max_value=1.5, allow_nan=False), min_size=50, max_size=300))
    def check(values):
        grid = [i * 0.01 for i in range(101)]
        probe = values + [g for g in grid] + [0.35, 0.7, 1.0, 0.0]
        df = spark.createDataFrame([(float(v),) for v in probe], "p double")
        got = [r[0] for r in df.select(E._threshold_bucket(F.col("p"))).collect()]
        want = [max([i for i, g in enumerate(grid) if g <= v], default=-1) for v in probe]
        assert got == want
    check()


def test_cdf_buckets_skewed_key_exact_ranks(spark):
    spark.conf.set("spark.cohortlens.rowsPerBucket", "40")
    try:
        rng = np.random.default_rng(11)
        v = np.round(rng.lognormal(0, 2.5, 3000), 3)
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double")
        r = O.dense_rank_global(df, [], [F.col("v"), F.col("id")]).select("id", "v", "rank0").toPandas()
        want = r.sort_values(["v", "id"]).reset_index(drop=True)
        assert (want["rank0"].values == np.arange(len(want))).all()
    finally:
        spark.conf.unset("spark.cohortlens.rowsPerBucket")


def test_drop_target_related(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "bmi_last double, weight_last double, height_last double, age_years double")
    assert CL.drop_target_related(df, "bmi_last").columns == ["bmi_last", "age_years"]
    assert CL.drop_target_related(df, "weight_last").columns == ["weight_last", "height_last", "age_years"]
    assert CL.drop_target_related(df, "label").columns == df.columns


# ------------------------------------------------ NULL groups, any distribution ----

def _ranked_rows(spark):
    return spark.createDataFrame([(i, None if i % 10 == 0 else ("a" if i % 3 else "b"), i % 2, (i * 37 % 1000) / 1000)
                                  for i in range(1000)], "id long, domain string, label int, score double")


@pytest.mark.parametrize("rows_per_bucket", ["20", "2000000"])
def test_null_groups_keep_their_rows(spark, rows_per_bucket):
    from cohortlens.operators import evaluate as E
    from cohortlens.operators import ordered as O
    from cohortlens.operators import weights as W
    df = _ranked_rows(spark)
    spark.conf.set(O.ROWS_PER_BUCKET_CONF, rows_per_bucket)
    try:
        ranks = O.dense_rank_global(df, ["domain"], ["score", "id"])
        got = {}
        for r in ranks.collect():
            got.setdefault(r.domain, []).append(r.rank0)
        assert {k: len(v) for k, v in got.items()} == {None: 100, "a": 600, "b": 300}
        assert all(sorted(v) == list(range(len(v))) for v in got.values())
        assert {r.domain for r in E.auroc_ap(df, group_cols=["domain"]).collect()} == {None, "a", "b"}
        split = W.stratified_split(df.withColumn("label", F.when(F.col("id") % 10 != 1, F.col("label"))), "id")
        assert split.count() == 1000 and split.where("label IS NULL AND split = 'train'").count() == 70
    finally:
        spark.conf.unset(O.ROWS_PER_BUCKET_CONF)


def test_threshold_scan_counts_every_row(spark):
    from cohortlens.operators import evaluate as E
    df = _ranked_rows(spark)
    for domain in (None, "domain"):
        first = E.threshold_scan(df, domain_col=domain).orderBy("threshold").first()
        assert first["pred_pos"] == 1000 and first["recall"] == 1.0


@pytest.mark.parametrize("shape", ["exp", "reciprocal"])
def test_buckets_stay_within_budget(spark, shape):
    from cohortlens.operators import ordered as O
    x = F.exp((F.col("id") % 5000 - 2500) / 200.0) if shape == "exp" else 1.0 / (F.col("id") + 1)
    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), (x + F.col("id") * 1e-12).alias("x"))
    spark.conf.set(O.ROWS_PER_BUCKET_CONF, "200")
    try:
        got = O.with_buckets(df, ["g"], F.col("x")).groupBy("g", "_bkt").agg(
            F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("g", "_bkt").collect()
    finally:
        spark.conf.unset(O.ROWS_PER_BUCKET_CONF)
    assert max(r.n for r in got) <= 200 and sum(r.n for r in got) == 30_000
    assert all(a.hi < b.lo for a, b in zip(got, got[1:]) if a.g == b.g)


def test_many_groups(spark):
    from cohortlens.operators import ordered as O
    df = spark.range(30_000).select((F.col("id") % 5000).alias("g"), F.col("id").cast("double").alias("x"))
    spark.conf.set(O.ROWS_PER_BUCKET_CONF, "2")
    try:
        assert O.dense_rank_global(df, ["g"], ["x"]).agg(F.max("rank0")).first()[0] == 5
    finally:
        spark.conf.unset(O.ROWS_PER_BUCKET_CONF)


def test_missing_score_has_no_label(spark):
    from cohortlens.functions import exprs as X
    df = spark.createDataFrame([(0.9,), (0.1,), (None,), (float("nan"),)], "p double")
    assert [r[0] is None for r in df.select(X.risk_label("p", 0.5)).collect()] == [False, False, True, True]


def test_smoking_status_reads_whole_words(spark):
    from cohortlens.functions import exprs as X
    want = {"Current Reformed Smoker, Duration Not Specified": 1.0, "Smoker at Diagnosis": 1.0,
            "Former smoker, amount unknown": 1.0, "Never Smoker": 0.0, "Lifelong Non-Smoker": 0.0, "No": 0.0,
            "non smoker": 0.0, "Current smoker": 1.0, "not a current smoker": 0.0, None: None, "yes": 1.0}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r.s: r.v for r in df.select("s", X.smoking_status("s").alias("v")).collect()} == want


def test_band_and_anchor_grammar():
    from cohortlens.operators import weights as W
    got = [(b.raw, b.lo, b.hi, b.lo_inclusive, b.hi_inclusive, b.weight) for b in
           W.parse_age_bands(" <30:0.1, 30-45:0.6,<=50:1,>75:8,>=80:9,bad,40:2,x-y:1,5-:1,1-2:z")]
    assert got == [("<30", None, 30.0, True, False, 0.1), ("30-45", 30.0, 45.0, True, False, 0.6),
                   ("<=50", None, 50.0, True, True, 1.0), (">75", 75.0, None, True, False, 8.0),
                   (">=80", 80.0, None, True, False, 9.0)]
    assert W.parse_anchors("60:0.5, 40:0.1,,x") == [(40.0, 0.1), (60.0, 0.5)]
