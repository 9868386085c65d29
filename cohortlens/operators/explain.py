"""Model explanations as Spark jobs.

* Permutation importance (A36): rows are numbered once; in every repeat a
  keyed Feistel permutation of the numbers names each row's donor, and rows
  meet their donors by an equi-join on the number — no row ever leaves its
  partition for the driver and no group is gathered into one task.
* Per-row attribution (M24) of tree ensembles and linear models is in
  attribution.py; ``baseline_shapley`` here takes any scorer: each row is
  expanded into its 2^g coalitions (absent features replaced by the training
  baseline), scored once, and folded back in one aggregate.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.operators.ordered import dense_rank_global
from cohortlens.session import cut_lineage

Scorer = Callable[[DataFrame], DataFrame]   # rows -> rows + "score"


def _loss(metric: str, label: str, score: str):
    y = F.col(label).cast("double")
    if metric == "brier":
        return F.avg(F.pow(F.col(score) - y, 2))
    raise ValueError("only the Brier loss is available as an aggregate; use evaluate.auroc_ap per group otherwise")


def _per_group_score(scored: DataFrame, label: str, metric: str, groups: Sequence[str]) -> DataFrame:
    """Loss per group: Brier (lower is better) or AUROC / AUPRC (exact, distributed)."""
    if metric == "brier":
        return scored.groupBy(*groups).agg(_loss(metric, label, "score").alias("m")) if groups else \
            scored.agg(_loss(metric, label, "score").alias("m"))
    from cohortlens.operators.evaluate import auroc_ap
    col = {"auroc": "auroc", "auprc": "auprc"}[metric]
    return auroc_ap(scored, label, "score", groups).select(*groups, F.col(col).alias("m"))


ROUNDS = 6
WALK = 16       # more than the numbers outside for n up to 256; beyond, a step ends outside with a chance under 1 / 16


def round_keys(seed: int) -> list[int]:
    """One 30-bit key per Feistel round: the first eight hex digits of md5('feistel:seed:round')."""
    return [int(hashlib.md5(f"feistel:{seed}:{j}".encode()).hexdigest()[:8], 16) % 2 ** 30 for j in range(ROUNDS)]


def _scramble(x: Column) -> Column:
    """32 well-mixed bits of a number below 2^31, in exact 64-bit arithmetic."""
    t = F.pmod(x * F.lit(1640531527), F.lit(2 ** 32))
    t = t.bitwiseXOR(F.shiftright(t, 15))
    t = F.pmod(t * F.lit(1103515245), F.lit(2 ** 32))
    return t.bitwiseXOR(F.shiftright(t, 13))


def _round(salt: Column, a: int, b: int, right_half: bool):
    """One round over a pair (l, r) of an a x b grid."""
    def turned(h: Column) -> Column:
        left, right = h["l"], h["r"]
        if right_half:
            right = F.pmod(right + _scramble(left + salt), F.lit(b))
        else:
            left = F.pmod(left + _scramble(right + salt), F.lit(a))
        return F.struct(left.alias("l"), right.alias("r"))
    return turned


def permuted(k: Column, n: int, rep: Column, seed: int = 42) -> Column:
    """The place of ``k`` in a permutation of 0 .. n - 1, one per ``rep`` and ``seed``; no row needs another to know it.

    A Feistel network over pairs (l, r) of a grid of a x b >= n cells (a the root of n, rounded up): each
    round adds a keyed hash of one half to the other, modulo its side, so it can be undone.  Numbers that
    leave 0 .. n - 1, at most one in the root of n, walk on along their cycle until they are back.
    """
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))

    def once(v: Column) -> Column:
        cells = F.array(F.struct(F.call_function("div", v, F.lit(b)).alias("l"), F.pmod(v, F.lit(b)).alias("r")))
        for j, c in enumerate(round_keys(seed)):
            # both halves are below 2^30: with the key and the repeat the sum stays below 2^31
            salt = F.pmod(rep.cast("long") * F.lit(7919) + F.lit(c), F.lit(2 ** 30))

            cells = F.transform(cells, _round(salt, a, b, j % 2 == 1))
        return F.transform(cells, lambda h: h["l"] * F.lit(b) + h["r"])[0]
    first = once(k.cast("long"))
    if a * b == n:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))


def permutation_importance(rows: DataFrame, key: str, label: str, features: Sequence[str], scorer: Scorer,
                           n_repeats: int = 5, seed: int = 42, metric: str = "brier") -> DataFrame:
    """Mean and population std over repeats of the loss increase when one
    raw column is permuted: perm - base for Brier, base - perm for AUROC / AUPRC."""
    base_loss = _per_group_score(scorer(rows), label, metric, []).first()[0]    # one number
    # rows are numbered once; the permutation of a repeat serves every feature
    reps = F.explode(F.array(*[F.lit(r) for r in range(n_repeats)])).alias("rep")
    numbered = rows.withColumn("_h", X.hash_u32(F.col(key), seed))
    numbered = cut_lineage(dense_rank_global(numbered, [], [F.col("_h"), F.col(key)], "_k").drop("_h"))
    n = numbered.count()
    don = numbered.select(F.col("_k").alias("_dk"), F.struct(*features).alias("_d"))
    recv = numbered.select("*", reps).withColumn("_dk", permuted(F.col("_k"), n, F.col("rep"), seed))
    perm = recv.join(don, "_dk").select("*", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    perm = perm.withColumns({f: F.when(F.col("feature") == f, F.col("_d")[f]).otherwise(F.col(f))
                             for f in features}).drop("_k", "_dk", "_d")
    scored = scorer(perm)
    per = _per_group_score(scored, label, metric, ["feature", "rep"]).withColumnRenamed("m", "perm_loss")
    base = F.lit(float(base_loss) if base_loss is not None else None).cast("double")
    delta = (F.col("perm_loss") - base) if metric == "brier" else (base - F.col("perm_loss"))
    return per.groupBy("feature").agg(F.avg(delta).alias("importance_mean"),
                                      F.stddev_pop(delta).alias("importance_std"))


def top_features(imp: DataFrame, k: int = 3, by: str = "importance_mean") -> DataFrame:
    """K1: top-k by importance (descending, ties by name)."""
    return imp.orderBy(F.col(by).desc(), "feature").limit(k)


def shapley_weights(g: int) -> dict[int, float]:
    """w(s) = s! (g - s - 1)! / g! for coalition size s."""
    return {s: math.factorial(s) * math.factorial(g - s - 1) / math.factorial(g) for s in range(g)}


def baseline_shapley(rows: DataFrame, key: str, groups: Mapping[str, Sequence[str]],
                     baseline: Mapping[str, object], scorer: Scorer) -> DataFrame:
    """M24 for a scorer that is neither linear nor made of trees: per row and feature group, the exact Shapley
    value of the score against a fixed baseline (medians / modes), at 2^g scored rows per row.  Trees and
    linear models have ``attribution.tree_attribution`` / ``linear_attribution``, which list no coalition.
    Output long: (key, feature, attribution)."""
    names = list(groups)
    g = len(names)
    ex = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 ** g - 1).cast("long"))).alias("_s"))
    present = {name: F.call_function("getbit", F.col("_s"), F.lit(j)) == 1 for j, name in enumerate(names)}
    repl = {c: F.when(present[name], F.col(c)).otherwise(F.lit(baseline[c]).cast(rows.schema[c].dataType))
            for name in names for c in groups[name]}
    scored = scorer(ex.withColumns(repl))
    # a coalition of s features counts with w(s - 1) for those it holds and with -w(s) for the others
    weights = F.array(*[F.lit(x) for x in shapley_weights(g).values()])
    size = F.bit_count("_s")
    aggs = [F.sum(F.when(present[name], F.get(weights, size - 1)).otherwise(-F.get(weights, size)) * F.col("score")).alias(name)
            for name in names]
    per_row = scored.groupBy(key).agg(*aggs)
    return per_row.unpivot([key], names, "feature", "attribution")


def top_k_per_entity(attr: DataFrame, key: str, k: int = 3) -> DataFrame:
    """K3: top-k features by |attribution| per entity (window per entity; an
    entity holds only its g feature rows)."""
    w = Window.partitionBy(key).orderBy(F.abs("attribution").desc(), "feature")
    return attr.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def compare_pair(attr: DataFrame, key: str, a, b, k: int = 3) -> DataFrame:
    """J6 + K3: two entities side by side per feature; union of their top-k
    lists flagged; the break point is the largest |delta|."""
    left = attr.where(F.col(key) == F.lit(a)).select("feature", F.col("attribution").alias("value_a"))
    right = attr.where(F.col(key) == F.lit(b)).select("feature", F.col("attribution").alias("value_b"))
    j = left.join(right, "feature", "full_outer") \
        .withColumn("delta", F.coalesce("value_b", F.lit(0.0)) - F.coalesce("value_a", F.lit(0.0)))
    topk = top_k_per_entity(attr.where(F.col(key).isin(a, b)), key, k).select("feature").distinct() \
        .withColumn("in_top_k", F.lit(True))
    j = j.join(topk, "feature", "left").withColumn("in_top_k", F.coalesce("in_top_k", F.lit(False)))
    # g rows: a window over them is bounded by the number of features
    w = Window.partitionBy(F.lit(0)).orderBy(F.abs("delta").desc(), "feature")
    return j.withColumn("is_break_point", F.row_number().over(w) == 1)
