"""Model fitting, calibration and scoring on Spark ML.

Estimators take the encoded ``features`` vector and a ``weightCol``; the
network (neural.py) weights its gradients.  Calibration is a second stage on the
validation rows: Platt scaling with smoothed targets, or isotonic regression (isotonic.py).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.operators.forest import ForestRegressor, fit_forest
from cohortlens.operators.neural import NeuralNet, fit_neural
from cohortlens.session import checkpoint_dir, cut_lineage


# reference model settings (fixed values)
GBT_PARAMS = dict(maxIter=200, stepSize=0.05, maxDepth=3, subsamplingRate=0.9)
RF_PARAMS = dict(numTrees=300, maxDepth=5, minInstancesPerNode=5)


#: training rows of an iterative fit that are worth a task of their own, and those that are too many for one
TASK_ROWS, MOST_ROWS = 50_000, 2_000_000


def dealt(train: DataFrame) -> DataFrame:
    """Rows of an iterative fit, in partitions that keep the cores busy: encoded rows are narrow, and
    what is coalesced by bytes leaves every tree or epoch to a few tasks.  Tables with enough
    partitions stay as they are."""
    n, cores = train.count(), train.sparkSession.sparkContext.defaultParallelism
    parts = max(min(-(-n // TASK_ROWS), cores), -(-n // MOST_ROWS))
    return train if train.rdd.getNumPartitions() >= parts else cut_lineage(train.repartition(parts))


def positive_probability(pred: DataFrame, prob_col: str = "probability", out: str = "p_raw") -> DataFrame:
    return pred.withColumn(out, vector_to_array(F.col(prob_col)).getItem(1))


def fit_classifier(train: DataFrame, kind: str, n_features: int, label: str = "label",
                   weight: str | None = "sample_weight", features: str = "features", seed: int = 42,
                   key: str | None = None, params: dict | None = None) -> Model | NeuralNet:
    """Logistic regression (L2, C = 1 -> regParam = 1 / sum w, tol 1e-4), gradient
    boosting, random forest or a (32, 16) perceptron."""
    params = dict(params or {})
    train = train.withColumn(label, F.col(label).cast("double"))
    if kind == "logreg":
        wsum = train.agg(F.sum(F.col(weight) if weight else F.lit(1.0))).first()[0] or 1.0
        est = LogisticRegression(featuresCol=features, labelCol=label, maxIter=params.pop("maxIter", 200),
                                 regParam=params.pop("regParam", 1.0 / wsum), elasticNetParam=0.0,
                                 tol=params.pop("tol", 1e-4), standardization=False, **params)
        if weight:
            est.setWeightCol(weight)
    elif kind == "gbt":
        checkpoint_dir(train.sparkSession)
        est = GBTClassifier(featuresCol=features, labelCol=label, seed=seed, checkpointInterval=10,
                            **{**GBT_PARAMS, **params})
        if weight:
            est.setWeightCol(weight)
    elif kind == "rf":
        est = RandomForestClassifier(featuresCol=features, labelCol=label, seed=seed, **{**RF_PARAMS, **params})
        if weight:
            est.setWeightCol(weight)
    elif kind == "mlp":
        return fit_neural(train, n_features, label, weight, features, key, seed=seed, **params)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    return est.fit(train)


def fit_regressor(train: DataFrame, kind: str, label: str, weight: str | None = None,
                  features: str = "features", seed: int = 42, key: str | None = None) -> Model | ForestRegressor:
    """Regression variants of M14-M16; a forest of unweighted rows is grown from histograms (forest.py)."""
    if kind == "rf" and not weight:
        return fit_forest(train, label, features, key, seed, **RF_PARAMS)
    if kind == "gbt":
        est = GBTRegressor(featuresCol=features, labelCol=label, seed=seed, **GBT_PARAMS)
    elif kind == "rf":
        est = RandomForestRegressor(featuresCol=features, labelCol=label, seed=seed, **RF_PARAMS)
    else:
        est = LinearRegression(featuresCol=features, labelCol=label)
    if weight:
        est.setWeightCol(weight)
    return est.fit(train)


def score(model: Model | NeuralNet, df: DataFrame, out: str = "p_raw") -> DataFrame:
    """Model -> positive-class probability column; Spark's helper columns dropped."""
    if isinstance(model, NeuralNet):
        return df.withColumn(out, model.probability(F.col("features")))
    pred = positive_probability(model.transform(df), out=out)
    return pred.drop("rawPrediction", "probability", "prediction")


# ----------------------------------------------------------- calibration --

@dataclass
class Platt:
    a: float
    b: float

    def apply(self, p: Column) -> Column:
        """sigmoid(a * logit(p) + b)."""
        z = F.lit(self.a) * X.clamped_logit(p) + F.lit(self.b)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_platt(val: DataFrame, score_col: str = "p_raw", label: str = "label") -> Platt:
    """M18 sigmoid: logistic fit of the label on logit(score) with Platt's
    smoothed targets, each row entering as two weighted rows (target and
    1 - target).  Only the two coefficients reach the driver."""
    y = F.col(label).cast("int")
    counts = val.agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("np"),
                     F.sum(F.when(y == 0, 1).otherwise(0)).alias("nn")).first()
    t_pos = (counts["np"] + 1.0) / (counts["np"] + 2.0)
    t_neg = 1.0 / (counts["nn"] + 2.0)
    t = F.when(y == 1, F.lit(t_pos)).otherwise(F.lit(t_neg))
    two = val.select(X.clamped_logit(F.col(score_col)).alias("m"), t.alias("t")) \
        .select("m", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("t").alias("w")),
                                       F.struct(F.lit(0.0).alias("y"), (F.lit(1.0) - F.col("t")).alias("w"))))
                .alias("r")).select("m", "r.*")
    two = VectorAssembler(inputCols=["m"], outputCol="f").transform(two)
    lr = LogisticRegression(featuresCol="f", labelCol="y", weightCol="w", regParam=0.0, maxIter=100,
                            standardization=False).fit(two)
    return Platt(float(lr.coefficients[0]), float(lr.intercept))
