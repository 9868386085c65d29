"""Isotonic calibration by mergeable pool-adjacent-violators blocks.

A block is (lo, hi, weight, total): a range of scores whose rows share one value,
total / weight.  Pooled sequences of blocks merge: where the last block of the
lower range is not below the first of the upper, the two are pooled and looked
at again, and everything further away stays as it is.  So

1. rows are summed per distinct score, before and after the shuffle;
2. score ranges are pooled by one task each, which streams its sorted scores
   and holds blocks only;
3. neighbouring ranges are merged ``FANOUT`` at a time, level by level.

Blocks have strictly growing values, so labels 0 and 1 of n rows leave at most
about n ** (2 / 3) of them (as many different fractions as n rows can hold), in
practice far fewer.  No task ever holds a range's rows.  What a model keeps, and
what rows are scored with, are the blocks' edges.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 8
BLOCK = "part long, lo double, hi double, weight double, total double"


def pooled(blocks: Iterable[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Blocks in order of score -> pooled blocks of strictly growing value."""
    out: list[tuple[float, float, float, float]] = []
    for lo, hi, weight, total in blocks:
        while out and out[-1][3] * weight >= total * out[-1][2]:
            below = out.pop()
            lo, weight, total = below[0], weight + below[2], total + below[3]
        out.append((lo, hi, weight, total))
    return out


def _pool_sorted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's range: its rows come sorted by score, only blocks are held."""
    part, held = None, []
    for f in frames:
        if len(f):
            part = int(f["part"].iloc[0])
            held = pooled([*held, *zip(f["s"], f["s"], f["weight"], f["total"], strict=True)])
    if held:
        yield pd.DataFrame([(part, *b) for b in held], columns=["part", "lo", "hi", "weight", "total"])


def _merge(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("lo")
    held = pooled(zip(f["lo"], f["hi"], f["weight"], f["total"], strict=True))
    return pd.DataFrame([(int(f["part"].iloc[0]) // FANOUT, *b) for b in held],
                        columns=["part", "lo", "hi", "weight", "total"])


def isotonic_blocks(df: DataFrame, score: str = "p_raw", label: str = "label", weight: str | None = None,
                    ranges: int | None = None) -> DataFrame:
    """(lo, hi, weight, value): the steps of the non-decreasing least-squares fit of label on score.

    Rows with a NULL or NaN score or label, or no positive weight, take no part.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    s = F.col(score).cast("double")
    rows = df.select(s.alias("s"), F.col(label).cast("double").alias("y"), w.alias("w"))
    rows = rows.where("s IS NOT NULL AND NOT isnan(s) AND y IS NOT NULL AND NOT isnan(y) AND w > 0")
    sums = rows.groupBy("s").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("y")).alias("total"))
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sums.repartitionByRange(n, "s").sortWithinPartitions("s").withColumn(
        "part", F.spark_partition_id().cast("long"))
    blocks = dealt.mapInPandas(_pool_sorted, BLOCK)
    while n > 1:
        blocks = blocks.groupBy(F.floor(F.col("part") / FANOUT).alias("_up")).applyInPandas(_merge, BLOCK)
        n = -(-n // FANOUT)
    return blocks.select("lo", "hi", "weight", (F.col("total") / F.col("weight")).alias("value"))


@dataclass
class Isotonic:
    """A fitted calibration: edges of the steps (ascending scores) and their values."""

    scores: list[float]
    values: list[float]

    def apply(self, p: Column) -> Column:
        """Step value; between two steps linear interpolation; beyond the ends the end value; NULL stays NULL."""
        xs, ys = np.array(self.scores), np.array(self.values)
        if not len(xs):
            return F.lit(None).cast("double")

        @F.pandas_udf("double")
        def value(s: pd.Series) -> pd.Series:
            x = s.to_numpy(dtype=float)
            return pd.Series(np.where(np.isnan(x), np.nan, np.interp(x, xs, ys)))
        out = value(p.cast("double"))
        return F.when(~F.isnan(out), out)

    def to_json(self) -> str:
        return json.dumps({"scores": self.scores, "values": self.values})

    @staticmethod
    def from_json(text: str) -> Isotonic:
        return Isotonic(**json.loads(text))


def fit_isotonic(df: DataFrame, score: str = "p_raw", label: str = "label", weight: str | None = None) -> Isotonic:
    """M18 isotonic: the blocks' edges (the size of the model) reach the driver, pooling does not."""
    xs, ys = [], []
    for b in sorted(isotonic_blocks(df, score, label, weight).collect()):
        for x in dict.fromkeys((b["lo"], b["hi"])):
            xs.append(x)
            ys.append(b["value"])
    return Isotonic(xs, ys)
