"""Order-dependent aggregates that stay distributed.

A window with no PARTITION BY runs in one task, and Spark's exact
``percentile`` keeps a value->count map of the whole group in one buffer.
Both break on a 100 TB table.  The helpers here use the classic two-level
scheme instead:

1. each row gets a bucket, a range of its leading order key: buckets above the
   row budget are cut at approximate quantiles of their own keys, again and
   again until every bucket is within budget or holds one key.  The cut points
   are tables fixed by a checkpoint, so a bucket is the same however often and
   wherever the plan is recomputed;
2. per-(group, bucket) totals form a table of at most groups x buckets rows,
   whose running sums give each bucket's offset;
3. a window partitioned by (group, bucket) finishes the running sum inside
   each bucket, so no task sees more than one bucket.

Used for exact AUROC / average precision, ROC and PR tables and dense global
ranks (permutations); single ranks and quantiles need no order of all rows
(selection.py).  Inputs are
pre-aggregated to distinct order keys (or carry a unique tiebreak), so a hot
value is one row, not a hot bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage


ROWS_PER_BUCKET_CONF = "spark.cohortlens.rowsPerBucket"
DEFAULT_ROWS_PER_BUCKET = 2_000_000
#: parts into which one bucket is cut at a time, and cut tables up to so many rows are broadcast
FANOUT = 100
SMALL_TABLE = 2_000


def _rows_per_bucket(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_BUCKET_CONF, str(DEFAULT_ROWS_PER_BUCKET)))


def _same(cols: Sequence[str], mark: str) -> Column:
    """Null-safe equality of ``cols`` with their marked copies."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(mark + c))
    return cond


def join_small(df: DataFrame, table: DataFrame, cols: Sequence[str], n: int, how: str = "inner") -> DataFrame:
    """``df`` with the columns of a table keyed by ``cols`` (NULL keys match); broadcast if it has few rows."""
    marked = table.withColumnsRenamed({c: f"_j_{c}" for c in cols})
    marked = F.broadcast(marked) if n <= SMALL_TABLE else marked
    return df.join(marked, _same(cols, "_j_"), how).drop(*[f"_j_{c}" for c in cols])


def with_buckets(df: DataFrame, group_cols: Sequence[str], key: Column, buckets: int | None = None) -> DataFrame | None:
    """``df`` with ``_bkt``: bucket numbers that grow with ``key`` inside a group.

    A bucket has at most ``spark.cohortlens.rowsPerBucket`` rows or a single
    key, for any distribution and any number of groups (a NULL group is one).
    Returns None when every group fits one bucket.
    """
    per = _rows_per_bucket(df)
    if buckets:
        per = min(per, max(1, df.count() // int(buckets)))
    keys = [*group_cols, "_bkt"]
    df = df.withColumn("_bkt", F.lit(0).cast("bigint")).withColumn("_key", key.cast("double"))
    split = False
    while True:
        over = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi")) \
            .where((F.col("_n") > per) & (F.col("_lo") < F.col("_hi")))
        over = cut_lineage(over)
        n = over.count()
        if n == 0:
            return df.drop("_key") if split else None
        inside = join_small(df.select(*keys, "_key"), over.select(*keys, "_n", "_hi"), keys, n)
        # every m-th of FANOUT quantiles, as many as the bucket needs, and the largest key
        step = F.greatest(F.lit(1), F.floor(F.lit(FANOUT * per / 2) / F.col("_n"))).cast("int")
        cuts = inside.groupBy(*keys).agg(
            F.percentile_approx("_key", [i / FANOUT for i in range(1, FANOUT)], 50 * FANOUT).alias("_q"),
            F.max(step).alias("_s"), F.max("_hi").alias("_hi"))
        cuts = cut_lineage(cuts.select(*keys, F.array_append(
            F.filter("_q", lambda x, i: (i + 1) % F.col("_s") == 0), F.col("_hi")).alias("_cuts")))
        part = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda x: x <= F.col("_key")))
        df = join_small(df, cuts, keys, n, "left").withColumn("_bkt", F.col("_bkt") * (FANOUT + 1) + part).drop("_cuts")
        df = cut_lineage(df)
        split = True


def running_sums(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                 value_cols: Sequence[str], prefix: str = "cum_", buckets: int | None = None,
                 totals: bool = False) -> DataFrame:
    """Add ``cum_<v>``: sum of ``v`` over the rows of the same group up to and
    including the current one, in ascending ``order_cols`` order; with
    ``totals`` also ``tot_<v>``, the group total (taken from the small bucket
    table, so no join or extra pass is needed).

    The leading order column must be numeric; the order must be total inside
    a group (pre-aggregate ties, or add a unique tiebreak).
    """
    group_cols = list(group_cols)
    order_exprs = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    # sizes, cuts and sums read the same (pre-aggregated) input: the source is scanned once
    df = cut_lineage(df)
    keyed = with_buckets(df, group_cols, order_exprs[0], buckets)
    if keyed is None:
        # every group is within one bucket's row budget: a plain window per
        # group is bounded by that budget, and no offsets or join are needed
        grp = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
        run = grp.orderBy(*order_exprs).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        extra = [F.sum(v).over(grp).alias(f"tot_{v}") for v in value_cols] if totals else []
        return df.select("*", *[F.sum(v).over(run).alias(f"{prefix}{v}") for v in value_cols], *extra)
    bucket_sums = keyed.groupBy(*group_cols, "_bkt").agg(*[F.sum(v).alias(f"_tot_{v}") for v in value_cols])
    # bucket table: at most groups x buckets rows, so windows over it are bounded
    grp = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    before = grp.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum(f"_tot_{v}").over(grp).alias(f"tot_{v}") for v in value_cols] if totals else []
    bucket_sums = cut_lineage(bucket_sums)
    offsets = bucket_sums.select(*group_cols, "_bkt", *[
        F.coalesce(F.sum(f"_tot_{v}").over(before), F.lit(0)).alias(f"_off_{v}") for v in value_cols], *extra)
    inside = Window.partitionBy(*group_cols, "_bkt").orderBy(*order_exprs) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = join_small(keyed, offsets, [*group_cols, "_bkt"], bucket_sums.count())
    out = out.select("*", *[(F.col(f"_off_{v}") + F.sum(v).over(inside)).alias(f"{prefix}{v}")
                            for v in value_cols])
    return out.drop("_bkt", *[f"_off_{v}" for v in value_cols])


def dense_rank_global(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                      name: str = "rank0", buckets: int | None = None) -> DataFrame:
    """0-based row index inside each group in ``order_cols`` order (order must be unique)."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = running_sums(one, group_cols, order_cols, ["_one"], prefix="_cum", buckets=buckets)
    return out.withColumn(name, F.col("_cum_one") - F.lit(1)).drop("_one", "_cum_one")


def collapse_rows(*frames: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Combine aggregates that share the same group keys (one row per group
    each, disjoint value columns) into one row per group: union by name, then
    keep each column's single non-NULL value.  Replaces joins of one-row
    aggregates (which the optimizer turns into nested-loop joins)."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    cols = [c for c in dict.fromkeys(c for f in frames for c in f.columns) if c not in group_cols]
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in cols]
    return u.groupBy(*group_cols).agg(*aggs) if group_cols else u.agg(*aggs)


def scalar(df: DataFrame, col: str | None = None):
    """Value of a one-row aggregate on the driver (a single number)."""
    row = df.first()
    return None if row is None else (row[col] if col else row[0])


def two_pass(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    """Narrow projection kept for operators that decide something from the
    data (edges, a cut-off, medians) and then use it on the same rows: the
    source is scanned once, and only the needed columns are kept."""
    return cut_lineage(df.select(*cols))
