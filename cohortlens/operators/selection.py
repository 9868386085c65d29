"""Exact order statistics by radix selection: values at given ranks without ranking rows.

Values are mapped to 64-bit integers of the same order.  A round counts the rows
by their next ``BITS`` bits, per group and among the rows that share a wanted
rank's leading bits so far; running counts over at most 2 ** BITS buckets tell in
which one the rank lies, and only that bucket's rows are looked at in the next
round.  A bucket that holds one distinct value is that value, however many rows
hold it; buckets of at most ``FINISH`` rows are sorted.  So what is shuffled is
histograms, not values, and no task sorts more than a small bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage

BITS = 12
FINISH = 20_000


def order_bits(value: Column) -> Column:
    """A long in the order of a double that is neither NULL nor NaN (-0.0 and 0.0 are one value)."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2 ** 63 - 1)))


def _same(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return cond


def _marked(table: DataFrame, cols: Sequence[str]) -> DataFrame:
    return table.withColumnsRenamed({c: f"_t_{c}" for c in cols})


def _inside(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys (NULLs match) are among ``cells``."""
    return rows.join(_marked(cells.select(*keys).distinct(), keys), _same(keys), "left_semi")


def select_ranks(rows: DataFrame, targets: DataFrame, group_cols: Sequence[str], key: str, value: str,
                 finish: int | None = None) -> DataFrame:
    """``targets`` (group columns, ``rank`` from 0, others) with ``value``, that of the row of that rank by ``key``
    in its group, and ``within``, the rows of the same value before it.

    ``key`` is a long; rows of one key must have one value.  Ranks outside a group have no result.
    """
    g, finish = list(group_cols), FINISH if finish is None else finish
    keys = [*g, "_prefix"]
    rows = cut_lineage(rows.select(*g, F.col(key).alias("_key"), F.col(value).alias("_value")))
    extra = [c for c in targets.columns if c not in g and c != "rank"]
    todo = targets.select(*g, *extra, "rank", F.lit(0).cast("long").alias("_prefix"), F.col("rank").alias("_left"))
    prefix, bits, done = F.lit(0).cast("long"), 0, None
    while True:
        more = min(BITS, 64 - bits)
        bits += more
        cells = (rows if bits == more else _inside(rows.withColumn("_prefix", prefix), todo, keys).drop("_prefix"))
        rows = cells if bits == more else cut_lineage(cells)
        inner = F.shiftright("_key", 64 - bits) if bits < 64 else F.col("_key")
        hist = rows.groupBy(*g, prefix.alias("_prefix"), inner.alias("_next")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
        upto = Window.partitionBy(*keys).orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = _marked(hist.withColumn("_upto", F.sum("_n").over(upto)), keys)
        left = F.col("_left")
        hit = todo.join(hist, _same(keys) & (left < F.col("_upto")) & (left >= F.col("_upto") - F.col("_n")))
        hit = cut_lineage(hit.select(*g, *extra, "rank", F.col("_next").alias("_prefix"),
                                     (left - F.col("_upto") + F.col("_n")).alias("_left"), "_n", "_lo", "_hi"))
        found = hit.where("_lo = _hi").select(*g, *extra, "rank", F.col("_lo").alias("value"), F.col("_left").alias("within"))
        done = found if done is None else done.unionByName(found)
        todo, prefix = hit.where("NOT (_lo = _hi)").drop("_lo", "_hi"), inner
        largest = todo.agg(F.max("_n")).first()[0]      # one number
        if largest is None:
            return done
        if largest <= finish:
            break
        todo = todo.drop("_n")
    rest = _inside(rows.withColumn("_prefix", prefix), todo, keys)
    order = Window.partitionBy(*keys).orderBy("_key")
    place, first = F.row_number().over(order) - 1, F.rank().over(order) - 1
    rest = _marked(rest.select(*keys, place.cast("long").alias("_place"), F.col("_value").alias("value"),
                               (place - first).cast("long").alias("within")), keys)
    last = todo.join(rest, _same(keys) & (F.col("_left") == F.col("_place")))
    return done.unionByName(last.select(*g, *extra, "rank", "value", "within"))


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                    finish: int | None = None) -> DataFrame:
    """One row per (group, q) with columns ``q`` and ``value``: exact quantiles with linear interpolation
    (numpy 'linear', Spark ``percentile``, DuckDB ``quantile_cont``).  NULL and NaN values are ignored; a
    NULL group is a group."""
    g = list(group_cols)
    x = F.col(value_col).cast("double")
    rows = df.select(*g, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    rows = cut_lineage(rows.select(*g, "_x", order_bits(F.col("_x")).alias("_k")))
    h = (F.col("_n") - 1) * F.col("q")
    qs = F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("q")
    asked = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select(*g, "_n", qs)
    asked = asked.select(*g, "q", (h - F.floor(h)).alias("frac"), F.explode(F.array_distinct(F.array(
        F.floor(h).cast("long"), F.ceil(h).cast("long")))).alias("rank"))
    picked = select_ranks(rows, asked, g, "_k", "_x", finish)
    # the lower and the upper neighbour; the same one where the rank is whole
    ends = picked.groupBy(*g, "q").agg(F.min(F.struct("rank", "value"))["value"].alias("lo"),
                                       F.max(F.struct("rank", "value"))["value"].alias("hi"), F.max("frac").alias("frac"))
    return ends.select(*g, "q", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")).alias("value"))


def quantiles_wide(df: DataFrame, value_col: str, probs: Sequence[float], names: Sequence[str],
                   group_cols: Sequence[str] = (), finish: int | None = None) -> DataFrame:
    """:func:`exact_quantiles` pivoted to one column per probability."""
    long = exact_quantiles(df, value_col, probs, group_cols, finish)
    aggs = [F.max(F.when(F.col("q") == F.lit(float(q)), F.col("value"))).alias(n) for q, n in zip(probs, names)]
    return long.groupBy(*group_cols).agg(*aggs) if group_cols else long.agg(*aggs)
