"""Model queries on the PU cohort (fits have no SQL oracle: tests check invariants)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.operators import attribution as AT
from cohortlens.operators import explain as XP
from cohortlens.plans import train as TR
from cohortlens.plans.catalog import register
from cohortlens.plans.q_weights import FEAT_SQL, pu_features
from cohortlens.operators import weights as W
from cohortlens.operators.ordered import dense_rank_global
from cohortlens.session import cut_lineage


def _cohort(spark, sf):
    return W.hash_split(pu_features(spark, sf), "doc_id", seed=42)


def _fit(spark, sf, **kw):
    df = _cohort(spark, sf).cache()
    cfg = TR.TrainConfig(**kw)
    return df, TR.train_and_validate(df, cfg)


@register("fit_logreg")
def q_fit_logreg(spark, sf):
    """M14 + M19/M20: weighted logistic regression, PU .05, sigmoid calibration; val/test metrics."""
    df, res = _fit(spark, sf, model="logreg", risk_factor=1.0, odds_factor=0.5)
    return TR.split_metrics(df, res, "logreg")


@register("fit_gbt")
def q_fit_gbt(spark, sf):
    """Gradient boosting (200 trees, lr .05, depth 3, subsample .9), PU .05, sigmoid, cap .7."""
    df, res = _fit(spark, sf, model="gbt", age_bands="<10:0.5,>=50:2", prior_percentiles=(10, 50, 90),
                   prior_probs=(0.05, 0.2, 0.5))
    return TR.split_metrics(df, res, "gbt")


@register("fit_rf")
def q_fit_rf(spark, sf):
    """Random forest (300 trees, depth 5, leaf 5), class weights, no PU."""
    df, res = _fit(spark, sf, model="rf", pu_prob=0.0, calibrate=None)
    return TR.split_metrics(df, res, "rf")


@register("fit_mlp")
def q_fit_mlp(spark, sf):
    """(32, 16) network, weighted mini-batch gradients, one training stopped by the validation AUROC."""
    df, res = _fit(spark, sf, model="mlp", calibrate=None)
    return TR.split_metrics(df, res, "mlp")


@register("calibrate_sigmoid")
def q_calibrate_sigmoid(spark, sf):
    """M18 sigmoid (Platt, smoothed targets) with gap penalty .3 and min recall .8 in the choice."""
    df, res = _fit(spark, sf, model="logreg", calibrate="sigmoid", gap_penalty=0.3, min_recall=0.8,
                   min_threshold=0.05, max_threshold=0.95)
    return TR.test_by_domain(df, res)


@register("calibrate_isotonic")
def q_calibrate_isotonic(spark, sf):
    """M18 isotonic calibration; threshold by recall with min precision .5 and target-rate penalty."""
    df, res = _fit(spark, sf, model="logreg", calibrate="isotonic", metric="recall", min_precision=0.5,
                   target_rate=0.12, target_weight=1.0)
    return TR.split_metrics(df, res, "logreg_isotonic")


@register("batch_score")
def q_batch_score(spark, sf):
    """Train on the train split, score every row: inputs kept + risk_probability + label."""
    df, res = _fit(spark, sf, model="logreg", prior_percentiles=(10, 50, 90), prior_probs=(0.05, 0.2, 0.5))
    return TR.batch_score(df.drop("split"), res, keep=["doc_id", "age_years", "lang", "source", "domain"])


def _scorer(res):
    """The model as it scores: encoder, either calibration, age prior, cap."""
    cfg = res.cfg

    def run(rows):
        keep = [c for c in rows.columns if c not in ("features", *cfg.numeric, *cfg.categorical)]
        aged = rows.withColumn("_age_raw", F.col("age_years").cast("double")) if "age_years" in rows.columns else rows
        return res.finalize(res.score(aged, keep=[*keep, *(["_age_raw"] if aged is not rows else [])]))
    return run


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """A36 + K1: Brier permutation importance, 5 repeats, over the validation + test rows."""
    df, res = _fit(spark, sf, model="logreg")
    rows = df.where(F.col("split") != "train").select("doc_id", "label", *res.cfg.numeric, *res.cfg.categorical)
    return XP.permutation_importance(rows, "doc_id", "label", list(res.cfg.numeric) + list(res.cfg.categorical),
                                     _scorer(res), n_repeats=5, seed=42)


@register("attribution_compare")
def q_attribution_compare(spark, sf):
    """M24 + J6 + K3: tree attributions of a boosted model (log odds) for every row; mean |attribution|
    per feature, and the comparison of documents 0 and 1 with top-3 and break point."""
    df, res = _fit(spark, sf, model="gbt", model_params={"maxIter": 30})
    forest = AT.Forest.of_model(spark, res.model)
    rows = res.encoder.transform(df, keep=["doc_id"], vector_col="features").select("doc_id", "features")
    attr = cut_lineage(AT.tree_attribution(rows, "doc_id", forest, res.encoder.raw_columns()))
    glob = attr.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs_attribution"))
    pair = XP.compare_pair(attr, "doc_id", 0, 1, k=3)
    return glob.join(pair, "feature", "left")


def _node(i, cover, value=0.0, feature=-1, threshold=None, left=-1, right=-1):
    return {"id": i, "value": value, "cover": cover, "left": left, "right": right, "feature": feature,
            "threshold": threshold, "categories": None}


# two fixed trees over (age_years, smoker): nodes (id, training weight, value, feature, threshold, children)
_TREES = [(1.0, [_node(0, 10.0, feature=0, threshold=15.0, left=1, right=2), _node(1, 6.0, feature=1, threshold=0.5, left=3, right=4),
                 _node(2, 4.0, 0.8), _node(3, 4.0, -0.5), _node(4, 2.0, 0.3)]),
          (0.5, [_node(0, 8.0, feature=1, threshold=0.5, left=1, right=2), _node(1, 5.0, -1.0),
                 _node(2, 3.0, feature=0, threshold=30.0, left=3, right=4), _node(3, 1.0, 0.4), _node(4, 2.0, 1.2)])]

_TREE_SQL = FEAT_SQL + """
, f AS (SELECT doc_id, age_years AS a, coalesce(tobacco_smoking_status_any, 0.0) AS s FROM pf),
-- the trees' value with both features known, with one, with none (branches weighted by training weight)
g AS (SELECT doc_id,
  (CASE WHEN a <= 15 THEN CASE WHEN s <= 0.5 THEN -0.5 ELSE 0.3 END ELSE 0.8 END)
    + 0.5 * (CASE WHEN s <= 0.5 THEN -1.0 WHEN a <= 30 THEN 0.4 ELSE 1.2 END) AS v_as,
  (CASE WHEN a <= 15 THEN (4 * -0.5 + 2 * 0.3) / 6 ELSE 0.8 END)
    + 0.5 * (5 * -1.0 + 3 * (CASE WHEN a <= 30 THEN 0.4 ELSE 1.2 END)) / 8 AS v_a,
  (6 * (CASE WHEN s <= 0.5 THEN -0.5 ELSE 0.3 END) + 4 * 0.8) / 10
    + 0.5 * (CASE WHEN s <= 0.5 THEN -1.0 ELSE (1 * 0.4 + 2 * 1.2) / 3 END) AS v_s,
  (4 * -0.5 + 2 * 0.3 + 4 * 0.8) / 10 + 0.5 * (5 * -1.0 + 1 * 0.4 + 2 * 1.2) / 8 AS v FROM f)
SELECT doc_id, 'age_years' AS feature, ((v_a - v) + (v_as - v_s)) / 2 AS attribution FROM g
UNION ALL SELECT doc_id, 'tobacco_smoking_status_any', ((v_s - v) + (v_as - v_a)) / 2 FROM g"""


@register("tree_attribution", _TREE_SQL, doubles=["attribution"])
def q_tree_attribution(spark, sf):
    """Attributions of a fixed ensemble of two trees for every row (path-dependent Shapley values)."""
    names = ["age_years", "tobacco_smoking_status_any"]
    rows = pu_features(spark, sf).select("doc_id", array_to_vector(F.array(*[F.coalesce(n, F.lit(0.0)) for n in names])).alias("features"))
    return AT.tree_attribution(rows, "doc_id", AT.Forest.of_nodes(_TREES), names)


def _feistel_sql(k: str, seed: int) -> str:
    """The permutation as nested DuckDB lists: a pair is turned round by round, then walked back into 0 .. n - 1."""
    def scramble(x):
        one = f"list_transform([({x}) * 1640531527 % 4294967296], lambda t: xor(t, t >> 15))"
        return f"list_transform({one}, lambda t: xor(t * 1103515245 % 4294967296, (t * 1103515245 % 4294967296) >> 13))[1]"

    def once(v):
        cells = f"[{{'l': ({v}) // b, 'r': ({v}) % b}}]"
        for j in range(6):
            c = f"(('0x' || substr(md5('feistel:{seed}:{j}'), 1, 8))::BIGINT % 1073741824)"
            salt = f"((rep * 7919 + {c}) % 1073741824)"
            left, right = ("h.l", f"(h.r + {scramble('h.l + ' + salt)}) % b") if j % 2 else (
                f"(h.l + {scramble('h.r + ' + salt)}) % a", "h.r")
            cells = f"list_transform({cells}, lambda h: {{'l': {left}, 'r': {right}}})"
        return f"list_transform({cells}, lambda h: h.l * b + h.r)[1]"
    return f"list_reduce(list_prepend({once(k)}, range(1, 17)), lambda v, i: CASE WHEN v < n THEN v ELSE {once('v')} END)"


@register("permuted_donors", FEAT_SQL + f"""
, k AS (SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5(doc_id || ':42'), 1, 8))::BIGINT, doc_id) - 1 AS k,
               count(*) OVER () AS n FROM pf),
g AS (SELECT *, ceil(sqrt(n))::BIGINT AS a, ((n + ceil(sqrt(n)) - 1) // ceil(sqrt(n)))::BIGINT AS b FROM k),
p AS (SELECT doc_id, rep, {_feistel_sql('k', 42)} AS d FROM g, (SELECT unnest(range(3)) AS rep) r)
SELECT p.doc_id, p.rep::INTEGER AS rep, k.doc_id AS donor FROM p JOIN k ON k.k = p.d""")
def q_permuted_donors(spark, sf):
    """In each of three repeats, the row whose values every row gets: one numbering, a permutation by arithmetic."""
    rows = pu_features(spark, sf).select("doc_id").withColumn("_h", X.hash_u32(F.col("doc_id"), 42))
    numbered = cut_lineage(dense_rank_global(rows, [], [F.col("_h"), F.col("doc_id")], "_k").drop("_h"))
    n = numbered.count()
    recv = numbered.select("doc_id", F.explode(F.array(*[F.lit(r) for r in range(3)])).alias("rep"), "_k")
    recv = recv.withColumn("_d", XP.permuted(F.col("_k"), n, F.col("rep"), 42))
    donors = numbered.select(F.col("_k").alias("_d"), F.col("doc_id").alias("donor"))
    return recv.join(donors, "_d").select("doc_id", "rep", "donor")


@register("fit_regression")
def q_fit_regression(spark, sf):
    """M15/M16 regression + F3 + A27: random-forest regressor of lineitem extended price
    from quantity, discount, tax and flags; R^2 / MAE / RMSE on validation and test."""
    from cohortlens.plans.standins import table
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_key"), "l_extendedprice", "l_quantity",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    _, _, metrics = TR.train_regression(li, "line_key", "l_extendedprice", ["l_quantity", "l_discount", "l_tax"],
                                        ["l_returnflag", "l_linestatus"], model="rf")
    return metrics


@register("permutation_importance_auprc")
def q_permutation_importance_auprc(spark, sf):
    """A36 with the AUPRC metric (drop in average precision), 5 repeats."""
    df, res = _fit(spark, sf, model="logreg")
    rows = df.where(F.col("split") != "train").select("doc_id", "label", *res.cfg.numeric, *res.cfg.categorical)
    return XP.permutation_importance(rows, "doc_id", "label", list(res.cfg.numeric) + list(res.cfg.categorical),
                                     _scorer(res), n_repeats=5, seed=42, metric="auprc")
