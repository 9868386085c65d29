"""Feature encoding fitted with aggregates and applied as literal expressions.

Fit = two aggregates over the training rows (exact distributed medians, then
mean / population std of the imputed values) plus one category count; the
fitted state is a few numbers per column, so transform is a single
``select`` that stays in whole-stage codegen.  A column with very many
infrequent categories keeps them as a table that rows are joined with, so the
number of categories has no limit.  Spark ML's Imputer (approximate
median), StandardScaler (sample std) and StringIndexer (own slot for unseen
values) differ from the semantics reproduced here (T8).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.operators.selection import quantiles_wide
from cohortlens.session import checkpoint_dir, cut_lineage

INFREQUENT = "infrequent_sklearn"
#: infrequent categories of a column up to which they are listed in the encoder; more are kept as a table
LISTED = 1_000


@dataclass
class Encoder:
    numeric: list[dict] = field(default_factory=list)        # {col, median, mean, scale}
    categorical: list[dict] = field(default_factory=list)    # {col, categories, infrequent, table}
    age_weight: float = 1.0
    age_col: str = "age_years"
    feature_weights: dict = field(default_factory=dict)

    # ------------------------------------------------------------------
    def output_columns(self) -> list[str]:
        cols = [n["col"] for n in self.numeric]
        for c in self.categorical:
            cols += [f"{c['col']}_{v}" for v in c["categories"]]
            if _has_infrequent(c):
                cols.append(f"{c['col']}_{INFREQUENT}")
        if self.age_weight != 1.0 and any(n["col"] == self.age_col for n in self.numeric):
            cols.append(f"{self.age_col}_weighted")
        return cols

    def raw_columns(self) -> list[str]:
        """The raw column behind every output column."""
        cols = [n["col"] for n in self.numeric]
        for c in self.categorical:
            cols += [c["col"]] * (len(c["categories"]) + _has_infrequent(c))
        return cols + [self.age_col] * (len(self.output_columns()) - len(cols))

    def transform(self, df: DataFrame, keep: Sequence[str] = (), vector_col: str | None = None) -> DataFrame:
        """Encoded columns (plus ``keep`` pass-through columns), optionally assembled into a vector."""
        exprs = []
        for i, c in enumerate(self.categorical):
            if c.get("table"):
                df = _marked(df, c, f"_known_{i}")
        for n in self.numeric:
            v = F.coalesce(X.to_number(F.col(n["col"]).cast("string")) if n.get("text") else F.col(n["col"]).cast("double"),
                           F.lit(n["median"]))
            exprs.append(((v - F.lit(n["mean"])) / F.lit(n["scale"])).alias(n["col"]))
        for i, c in enumerate(self.categorical):
            s = _category(c["col"])
            for v in c["categories"]:
                exprs.append((s == F.lit(v)).cast("double").alias(f"{c['col']}_{v}"))
            if c.get("table"):
                exprs.append(F.col(f"_known_{i}").isNotNull().cast("double").alias(f"{c['col']}_{INFREQUENT}"))
            elif c["infrequent"]:
                exprs.append(s.isin(list(c["infrequent"])).cast("double").alias(f"{c['col']}_{INFREQUENT}"))
        out = df.select(*keep, *exprs)
        if self.age_weight != 1.0 and self.age_col in out.columns:
            out = out.withColumn(f"{self.age_col}_weighted", F.col(self.age_col) * F.lit(float(self.age_weight)))
        if self.feature_weights:
            out = apply_feature_weights(out, self.feature_weights, exclude=keep)
        if vector_col:
            out = VectorAssembler(inputCols=self.output_columns(), outputCol=vector_col,
                                  handleInvalid="keep").transform(out)
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(s: str) -> "Encoder":
        return Encoder(**json.loads(s))


def _category(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("unknown"))


def _has_infrequent(c: Mapping) -> bool:
    return bool(c["infrequent"] or c.get("table"))


def _marked(df: DataFrame, c: Mapping, name: str) -> DataFrame:
    """``df`` with a mark on the rows whose category is a known infrequent one (each row once, none lost).

    Frequent categories, which hold nearly all rows, do not meet the table: they get keys of their own that match nothing.
    """
    known = df.sparkSession.read.schema("v string").parquet(c["table"]).select(F.col("v").alias("_v"), F.lit(True).alias(name))
    s = _category(c["col"])
    spread = F.concat(F.lit("\0"), (F.monotonically_increasing_id() % 4096).cast("string"))
    key = F.when(s.isin(c["categories"]), spread).otherwise(s) if c["categories"] else s
    return df.withColumn("_key", key).join(known, F.col("_key") == F.col("_v"), "left").drop("_key", "_v")


def fit_encoder(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], min_frequency: float = 0.01,
                age_weight: float = 1.0, age_col: str = "age_years",
                feature_weights: Mapping[str, float] | None = None) -> Encoder:
    """M10 fit: medians (exact, distributed) -> mean / population std of the
    imputed column (0 -> 1); categories after 'unknown' imputation, sorted,
    those under ``min_frequency`` of the rows merged as infrequent."""
    enc = Encoder(age_weight=age_weight, age_col=age_col, feature_weights=dict(feature_weights or {}))
    if numeric:
        stacked = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v"))
                                                   for c in numeric])).alias("e")).select("e.*")
        medians = {c: None for c in numeric}
        medians.update({r["col"]: r["m"] for r in quantiles_wide(stacked, "v", [0.5], ["m"], ["col"]).collect()})
        imp = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c] if medians[c] is not None else 0.0))
               for c in numeric}
        stats = train.agg(*[F.avg(imp[c]).alias(f"m_{i}") for i, c in enumerate(numeric)],
                          *[F.stddev_pop(imp[c]).alias(f"s_{i}") for i, c in enumerate(numeric)]).first()
        for i, c in enumerate(numeric):
            sd = stats[f"s_{i}"]
            enc.numeric.append({"col": c, "median": float(medians[c] if medians[c] is not None else 0.0),
                                "mean": float(stats[f"m_{i}"] or 0.0), "scale": float(sd) if sd else 1.0})
    if categorical:
        long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"),
                                                         F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("v"))
                                                for c in categorical])).alias("e")).select("e.*")
        counts = cut_lineage(long.groupBy("col", "v").agg(F.count(F.lit(1)).alias("n")))
        # per column; what is listed is bounded: at most 1 / min_frequency frequent categories, and LISTED others
        totals = {r["col"]: r for r in counts.groupBy("col").agg(F.sum("n").alias("n")).collect()}
        for c in categorical:
            mine = counts.where(F.col("col") == c)
            threshold = min_frequency * (totals[c]["n"] if c in totals else 0)
            frequent = sorted(r["v"] for r in mine.where(F.col("n") >= threshold).collect())
            others = mine.where(F.col("n") < threshold).select("v")
            listed = [r["v"] for r in others.limit(LISTED + 1).collect()]
            entry = {"col": c, "categories": frequent, "infrequent": sorted(listed)}
            if len(listed) > LISTED:
                entry |= {"infrequent": [], "table": f"{checkpoint_dir(train.sparkSession).rstrip('/')}/categories-{uuid.uuid4().hex}"}
                others.write.parquet(entry["table"])
            enc.categorical.append(entry)
    return enc


def apply_feature_weights(df: DataFrame, weights: Mapping[str, float], exclude: Sequence[str] = ()) -> DataFrame:
    """Multiply every column whose name contains a pattern by its weight."""
    out = {}
    for pattern, w in weights.items():
        for c in df.columns:
            if pattern in c and c not in exclude:
                out[c] = (out.get(c, F.col(c))) * F.lit(float(w))
    return df.withColumns(out) if out else df
