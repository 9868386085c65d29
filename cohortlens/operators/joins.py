"""Joins: N-way key merge (J1), complete-bin reports (J5), pairwise entity
comparison (J6).  Roll-up joins (J2/J3) live in :mod:`rollup`.

Broadcast hints are used only for tables whose size is fixed by the
caller's parameters (bin dimensions, feature lists); everything else is
left to AQE, which broadcasts at run time from measured sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_on_keys(frames: Sequence[DataFrame], keys: Sequence[str], how: str = "outer") -> DataFrame:
    """Fold of equi-joins on ``keys``; a right column clashing with an
    existing one is renamed ``<name>__<i>`` (i = position of the right frame)."""
    how = {"outer": "full_outer", "full": "full_outer"}.get(how, how)
    for i, f in enumerate(frames):
        missing = [k for k in keys if k not in f.columns]
        if missing:
            raise ValueError(f"frame {i} lacks merge keys {missing}")
    out = frames[0]
    for i, right in enumerate(frames[1:], start=1):
        ren = {c: f"{c}__{i}" for c in right.columns if c not in keys and c in out.columns}
        right = right.withColumnsRenamed(ren) if ren else right
        out = out.join(right, on=list(keys), how=how)
    return out


def complete_bins(counts: DataFrame, dimension: DataFrame, on: Sequence[str],
                  zero_cols: Sequence[str] = ("n",)) -> DataFrame:
    """Every bin of the (small, parameter-sized) dimension is reported;
    count columns of empty bins become 0, other measures stay NULL."""
    out = F.broadcast(dimension).join(counts, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in zero_cols})


def compare_entities(long: DataFrame, id_col: str, a, b, feature_col: str = "feature",
                     value_col: str = "value") -> DataFrame:
    """Two entities' per-feature values side by side (full outer on the
    feature) with delta = b - a."""
    left = long.where(F.col(id_col) == F.lit(a)).select(feature_col, F.col(value_col).alias("value_a"))
    right = long.where(F.col(id_col) == F.lit(b)).select(feature_col, F.col(value_col).alias("value_b"))
    j = left.join(right, feature_col, "full_outer")
    return j.withColumn("delta", F.coalesce("value_b", F.lit(0.0)) - F.coalesce("value_a", F.lit(0.0)))
