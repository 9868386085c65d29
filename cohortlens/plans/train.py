"""Training run (M19), test evaluation (M20) and batch scoring (M21) as one
composed job over a cohort with a ``split`` column.

Every step is a column or an aggregate on keyed rows: weights are columns,
PU adds rows by ``explode``, the encoder is a literal ``select``, the model
is Spark ML, and every report is an aggregate over the scored rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.operators import evaluate as E
from cohortlens.operators import features as FE
from cohortlens.operators import isotonic as I
from cohortlens.operators import models as M
from cohortlens.operators import neural as NN
from cohortlens.operators import weights as W
from cohortlens.operators.ordered import collapse_rows
from cohortlens.session import cut_lineage


@dataclass
class TrainConfig:
    model: str = "gbt"
    numeric: Sequence[str] = ("age_years", "tobacco_smoking_status_any")
    categorical: Sequence[str] = ("lang", "source")
    key: str = "doc_id"
    label: str = "label"
    domain: str = "domain"
    unlabeled_domain: str = "unlabelled"
    pu_prob: float = 0.05
    class_weight: bool = True
    risk_factor: float = 0.0
    risk_min_age: float = 60.0
    odds_factor: float = 0.0
    age_bands: str = ""
    normalize_bands: bool = True
    row_missing: float = 0.0
    col_missing: float = 0.0
    calibrate: str | None = "sigmoid"
    prior_percentiles: Sequence[float] = ()
    prior_probs: Sequence[float] = ()
    prior_mode: str = "floor"
    prior_alpha: float = 0.5
    cap: float | None = 0.7
    metric: str = "f1"
    min_threshold: float = 0.0
    max_threshold: float = 1.0
    min_recall: float = 0.0
    min_precision: float | None = None
    gap_penalty: float = 0.0
    target_rate: float | None = None
    target_weight: float = 0.0
    age_weight: float = 1.0
    feature_weights: dict = field(default_factory=dict)     # M13: pattern -> factor on encoded columns
    hard_missing: Sequence[str] = ("height_last", "weight_last", "bmi_last")   # doubled missingness rate
    assume_non_smoker: bool = True
    seed: int = 42
    model_params: dict = field(default_factory=dict)
    max_epochs: int = 100       # of the network
    patience: int = 10


@dataclass
class TrainResult:
    encoder: FE.Encoder
    model: object
    platt: M.Platt | None
    isotonic: I.Isotonic | None
    anchors: list
    threshold: float
    scan: DataFrame
    choice: DataFrame
    cfg: TrainConfig

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Encode -> model -> calibration -> age prior -> cap (prior once, then cap: T7)."""
        enc = self.encoder.transform(df, keep=list(keep), vector_col="features")
        s = M.score(self.model, enc)
        p = F.col("p_raw")
        if self.platt is not None:
            s = s.withColumn("p_cal", self.platt.apply(p))
        elif self.isotonic is not None:
            s = s.withColumn("p_cal", self.isotonic.apply(p))
        else:
            s = s.withColumn("p_cal", p)
        return s

    def finalize(self, scored: DataFrame) -> DataFrame:
        """Age prior (where the raw age was kept as ``_age_raw``), then cap: no join, the age is a column of the row."""
        anchors = self.anchors if (self.anchors and "_age_raw" in scored.columns) else []
        return W.apply_age_prior(scored, "p_cal", "_age_raw", anchors, self.cfg.prior_mode, self.cfg.prior_alpha,
                                 self.cfg.cap, out_col="score")


def with_raw_age(df: DataFrame, age_col: str = "age_years") -> DataFrame:
    """The age before encoding, kept beside the features for the prior."""
    return df.withColumn("_age_raw", F.col(age_col).cast("double")) if age_col in df.columns else df


def _kept(df: DataFrame, *cols: str) -> list[str]:
    return [*cols, *(["_age_raw"] if "_age_raw" in df.columns else [])]


def _training_rows(train: DataFrame, cfg: TrainConfig) -> DataFrame:
    """Weights from the raw rows -> missingness on every feature -> PU copies -> class weights -> one weight."""
    w = train
    names = []
    if cfg.risk_factor > 0:
        w = W.risk_weights(w, cfg.risk_min_age, cfg.risk_factor)
        names.append("risk_weight")
    if cfg.odds_factor > 0:
        w, _ = W.odds_weights(w, cfg.label, cfg.odds_factor)
        names.append("odds_weight")
    if cfg.age_bands:
        w = W.band_weights(w, cfg.age_bands, cfg.normalize_bands)
        names.append("band_weight")
    if cfg.row_missing > 0 and cfg.col_missing > 0:
        cols = [c for c in (*cfg.numeric, *cfg.categorical) if c in w.columns]
        w = W.inject_missingness(w, cfg.key, cols, cfg.row_missing, cfg.col_missing, cfg.seed, hard_cols=cfg.hard_missing)
    if cfg.pu_prob > 0:
        w = W.pu_rows(w, cfg.label, cfg.domain, cfg.unlabeled_domain, cfg.pu_prob)
        names.append("pu_weight")
    # logistic regression is class-balanced inside the model (computed on the
    # labels it is fitted on, PU copies included); other models get balanced
    # sample weights only when PU smoothing is off (M5)
    if cfg.class_weight and (cfg.model == "logreg" or cfg.pu_prob <= 0):
        w = W.class_weights(w, cfg.label)
        names.append("class_weight")
    return W.combine_weights(w, names)


def _anchors(train: DataFrame, cfg: TrainConfig) -> list:
    if not cfg.prior_percentiles:
        return []
    return W.anchors_from_percentiles(train, "age_years", cfg.prior_percentiles, cfg.prior_probs, cfg.label)


def train_and_validate(df: DataFrame, cfg: TrainConfig) -> TrainResult:
    """Split (hash) -> weights -> missingness -> PU -> encoder fitted on the
    rows that are trained on -> fit -> calibrate on validation -> prior/cap ->
    101-threshold scan -> choice."""
    from cohortlens.operators import clean as CL
    if cfg.assume_non_smoker:
        df = CL.assume_non_smoker(df)
    if "split" not in df.columns:
        df = W.hash_split(df, cfg.key, cfg.seed)
    train = df.where(F.col("split") == "train")
    val = df.where(F.col("split") == "val")
    tr = _training_rows(train, cfg)
    enc = FE.fit_encoder(tr, list(cfg.numeric), list(cfg.categorical), age_weight=cfg.age_weight,
                         feature_weights=cfg.feature_weights)
    n_feat = len(enc.output_columns())
    tr_enc = enc.transform(tr, keep=[cfg.key, cfg.label, "sample_weight"], vector_col="features")
    # iterative fits read the training rows many times: cut the weighting /
    # PU / encoding lineage with a reliable checkpoint in the shared folder
    tr_enc = M.dealt(cut_lineage(tr_enc))
    val_enc = enc.transform(val, keep=[cfg.key, cfg.label, cfg.domain], vector_col="features")
    if cfg.model == "mlp":
        # the score that stops the training is the one reported: prior, then cap
        draft = TrainResult(enc, None, None, None, _anchors(train, cfg), 0.5, None, None, cfg)
        held = cut_lineage(enc.transform(with_raw_age(val), keep=_kept(with_raw_age(val), cfg.label), vector_col="features"))
        model = NN.fit_neural(tr_enc, n_feat, cfg.label, "sample_weight", key=cfg.key, val=held, seed=cfg.seed,
                              judge=lambda s: draft.finalize(s.withColumn("p_cal", F.col("p_raw"))),
                              **{"max_epochs": cfg.max_epochs, "patience": cfg.patience, **cfg.model_params})
    else:
        model = M.fit_classifier(tr_enc, cfg.model, n_feat, cfg.label, "sample_weight", seed=cfg.seed,
                                 key=cfg.key, params=dict(cfg.model_params))
    val_scored = M.score(model, val_enc)
    platt = iso = None
    if cfg.calibrate == "sigmoid":
        platt = M.fit_platt(val_scored, "p_raw", cfg.label)
    elif cfg.calibrate == "isotonic":
        iso = I.fit_isotonic(val_scored, "p_raw", cfg.label)
    res = TrainResult(enc, model, platt, iso, _anchors(train, cfg), 0.5, None, None, cfg)
    val = with_raw_age(val)
    val_final = res.finalize(res.score(val, keep=_kept(val, cfg.key, cfg.label, cfg.domain)))
    # validation scores feed the ranking metrics, the scan and the choice: score once
    val_final = val_final.select(cfg.key, cfg.label, cfg.domain, "score").persist(StorageLevel.MEMORY_AND_DISK)
    scan = E.threshold_scan(val_final, cfg.label, "score", cfg.domain,
                            target_domain=cfg.unlabeled_domain if cfg.target_rate is not None else None) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    choice = E.choose_threshold(scan, cfg.metric, cfg.min_precision, cfg.gap_penalty, cfg.min_threshold,
                                cfg.max_threshold, cfg.min_recall, cfg.target_rate, cfg.target_weight)
    res.scan, res.choice = scan, choice
    res.threshold = float(choice.select("threshold").first()[0])
    return res


def scored_split(df: DataFrame, res: TrainResult, split: str) -> DataFrame:
    from cohortlens.operators import clean as CL
    cfg = res.cfg
    part = df.where(F.col("split") == split) if split else df
    part = CL.assume_non_smoker(part) if cfg.assume_non_smoker else part
    part = with_raw_age(part)
    return res.finalize(res.score(part, keep=_kept(part, cfg.key, cfg.label, cfg.domain)))


def split_metrics(df: DataFrame, res: TrainResult, name: str) -> DataFrame:
    """AUROC / AP / Brier and threshold metrics on validation and test (one row each)."""
    if "split" not in df.columns:
        df = W.hash_split(df, res.cfg.key, res.cfg.seed)
    rows = []
    for sp in ("val", "test"):
        s = scored_split(df, res, sp).select(res.cfg.key, res.cfg.label, res.cfg.domain, "score") \
            .persist(StorageLevel.MEMORY_AND_DISK)      # three aggregates read it
        rk = E.auroc_ap(s, res.cfg.label, "score")
        br = E.brier(s, res.cfg.label, "score").select("brier")
        cm = E.classification_metrics(s, res.threshold, res.cfg.label, "score").drop("domain", "n")
        one = collapse_rows(rk, br, cm)
        rows.append(one.select(F.lit(name).alias("model"), F.lit(sp).alias("split"), "*"))
    return rows[0].unionByName(rows[1])


def test_by_domain(df: DataFrame, res: TrainResult) -> DataFrame:
    """Test metrics per domain and overall at the chosen threshold."""
    if "split" not in df.columns:
        df = W.hash_split(df, res.cfg.key, res.cfg.seed)
    s = scored_split(df, res, "test").select(res.cfg.key, res.cfg.label, res.cfg.domain, "score") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    cm = E.classification_metrics(s, res.threshold, res.cfg.label, "score", res.cfg.domain)
    rk = E.auroc_ap(s, res.cfg.label, "score", [res.cfg.domain]).select(
        F.col(res.cfg.domain).cast("string").alias("_d"), "auroc", "auprc") \
        .unionByName(E.auroc_ap(s, res.cfg.label, "score").select(F.lit("all").alias("_d"), "auroc", "auprc"))
    # one row per domain on both sides, a NULL domain too
    return cm.join(rk, F.col("domain").eqNullSafe(F.col("_d")), "left").drop("_d")


def test_concordance(df: DataFrame, res: TrainResult, bmi_col: str = "bmi_last") -> DataFrame:
    """Risk-concordance tables of the test split's final scores."""
    from cohortlens.operators.report import risk_concordance
    if "split" not in df.columns:
        df = W.hash_split(df, res.cfg.key, res.cfg.seed)
    cfg = res.cfg
    part = with_raw_age(df.where(F.col("split") == "test"))
    keep = [cfg.key, cfg.domain, *(c for c in (bmi_col,) if c in part.columns)]
    if cfg.assume_non_smoker:
        from cohortlens.operators import clean as CL
        part = CL.assume_non_smoker(part)
    s = res.finalize(res.score(part, keep=_kept(part, *keep))).withColumnRenamed("age_years", "_encoded_age")
    s = s.withColumnRenamed("_age_raw", "age_years")
    return risk_concordance(s, "score", cfg.domain, cfg.unlabeled_domain, bmi_col=bmi_col)


def prepare_inputs(df: DataFrame, res: TrainResult) -> DataFrame:
    """M21 input side (P24, P23, P25): gender -> sex and synonyms, numeric
    features parsed, absent features added as NULL, missing smoker flag -> 0."""
    from cohortlens.operators import clean as CL
    cfg = res.cfg
    types = {**{c: "double" for c in cfg.numeric}, **{c: "string" for c in cfg.categorical}}
    out = CL.enforce_schema(CL.normalize_inputs(df), [*cfg.numeric, *cfg.categorical],
                            drop=(cfg.label, cfg.domain), types=types)
    return CL.assume_non_smoker(out)


def batch_score(df: DataFrame, res: TrainResult, keep: Sequence[str] | None = None) -> DataFrame:
    """Inputs normalised and completed, encoded, scored, calibrated,
    prior then cap; input columns kept, ``risk_probability`` and the
    High/Low label added.

    Row by row, for tables and streams alike: the kept columns travel with
    their row as one struct, so nothing is joined back, repeated or NULL keys
    neither multiply nor lose rows, and raw and encoded names cannot clash.
    """
    keep = list(keep or df.columns)
    prepared = prepare_inputs(df.withColumn("_raw", F.struct(*keep)), res)
    age = F.col("age_years") if "age_years" in prepared.columns else F.lit(None)
    prepared = prepared.withColumn("_age_raw", age.cast("double"))
    out = res.finalize(res.score(prepared, keep=["_raw", "_age_raw"]))
    out = out.select("_raw.*", F.col("score").alias("risk_probability"))
    return out.withColumn("prediction", X.risk_label("risk_probability", res.threshold))


# ------------------------------------------------------------ persistence --

_MODEL_CLASSES = {
    "logreg": "pyspark.ml.classification.LogisticRegressionModel",
    "gbt": "pyspark.ml.classification.GBTClassificationModel",
    "rf": "pyspark.ml.classification.RandomForestClassificationModel",
}


def save_result(res: TrainResult, path: str) -> None:
    """Spark ML writers for the model, a JSON sidecar for the encoder,
    Platt coefficients or isotonic steps, anchors, threshold and configuration — all under ``path`` (a shared folder on a cluster)."""
    import json
    from dataclasses import asdict
    spark = res.scan.sparkSession if res.scan is not None else None
    neural = res.model.to_json() if isinstance(res.model, NN.NeuralNet) else None
    if neural is None:
        res.model.write().overwrite().save(f"{path}/model")
    # tables of infrequent categories lie in a scratch folder: they are kept beside the model
    entries = []
    for i, c in enumerate(res.encoder.categorical):
        if c.get("table"):
            spark.read.parquet(c["table"]).write.mode("overwrite").parquet(f"{path}/categories-{i}")
            c = {**c, "table": f"{path}/categories-{i}"}
        entries.append(c)
    meta = {"encoder": replace(res.encoder, categorical=entries).to_json(), "platt": None if res.platt is None else [res.platt.a, res.platt.b],
            "isotonic": None if res.isotonic is None else res.isotonic.to_json(),
            "neural": neural, "anchors": [list(a) for a in res.anchors], "threshold": res.threshold,
            "cfg": {k: (list(v) if isinstance(v, tuple) else v) for k, v in asdict(res.cfg).items()}}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta")


def load_result(spark, path: str) -> TrainResult:
    """Inverse of :func:`save_result` (scan and choice tables are not kept)."""
    import importlib
    import json
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    cfg = TrainConfig(**{k: (tuple(v) if isinstance(v, list) else v) for k, v in meta["cfg"].items()})
    if meta.get("neural"):
        model = NN.NeuralNet.from_json(meta["neural"])
    else:
        mod, cls = _MODEL_CLASSES[cfg.model].rsplit(".", 1)
        model = getattr(importlib.import_module(mod), cls).load(f"{path}/model")
    iso = I.Isotonic.from_json(meta["isotonic"]) if meta.get("isotonic") else None
    platt = M.Platt(*meta["platt"]) if meta["platt"] else None
    return TrainResult(FE.Encoder.from_json(meta["encoder"]), model, platt, iso,
                       [tuple(a) for a in meta["anchors"]], float(meta["threshold"]), None, None, cfg)


def evaluate_saved(spark, path: str, df: DataFrame) -> DataFrame:
    """Load saved artefacts, score the test split, report per domain."""
    return test_by_domain(df, load_result(spark, path))



def train_regression(df: DataFrame, key: str, target: str, numeric: Sequence[str], categorical: Sequence[str],
                     model: str = "rf", seed: int = 42) -> tuple[FE.Encoder, object, DataFrame]:
    """Regression run: clean target (F3), plain hash split (M2), encoder on
    train, GBT / RF / linear regressor (M15/M16), R^2 / MAE / RMSE on
    validation and test (A27).  Returns (encoder, model, metrics)."""
    from cohortlens.operators.clean import clean_regression_target
    data = W.hash_split(clean_regression_target(df, target), key, seed)
    train = data.where(F.col("split") == "train")
    enc = FE.fit_encoder(train, list(numeric), list(categorical))
    tr = cut_lineage(enc.transform(train, keep=[key, target], vector_col="features"))
    reg = M.fit_regressor(tr, model, target, seed=seed, key=key)
    parts = []
    for sp in ("val", "test"):
        part = enc.transform(data.where(F.col("split") == sp), keep=[key, target], vector_col="features")
        pred = reg.transform(part)
        parts.append(E.regression_metrics(pred, target, "prediction").select(
            F.lit(model).alias("model"), F.lit(sp).alias("split"), "*"))
    return enc, reg, parts[0].unionByName(parts[1])
