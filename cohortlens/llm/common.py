"""Column expressions and session helpers shared by the corpus operators.

A *word* is a maximal run of characters other than the six ASCII white-space
characters; a null text has none.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import packed
from cohortlens.llm.worker import lean
from cohortlens.session import checkpoint_dir, cut_lineage

WHITE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A plain column that a lambda refers to may be inlined by the optimiser
    and then be computed for every element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null, empty or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPLIT))).cast("long")


def crc(col: Column) -> Column:
    """Unsigned crc32 of a value's text form."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod folds is the held-out fold; false for a null id."""
    return F.coalesce(crc(doc_id) % folds == fold, F.lit(False))


def key(col: Column) -> Column:
    """A non-null join key that keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def own(name: str, taken) -> str:
    """``name``, or a variation of it that no column of the caller's table has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session has ``value`` for jobs that run inside, and its own again afterwards."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def leading_bits(v: Column, bits: int = 6) -> Column:
    """A non-negative integer with all but its leading bits cleared: the lower edge of its log-linear bucket."""
    shift = F.greatest(F.length(F.bin(v)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def most_frequent(table: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of largest count, at most ``limit`` of them: those from a threshold on, ties in or out together.

    The threshold comes from a histogram of a few thousand buckets; nothing is sorted.
    """
    edge = leading_bits(F.col(count), 10)
    n, least = 0, None
    for r in sorted(table.groupBy(edge.alias("e")).agg(F.count("*").alias("n")).collect(), reverse=True):
        n += r["n"]
        if n > limit:
            break
        least = r["e"]
    return table.filter(F.col(count) >= least) if least is not None else table.limit(0)


#: ids up to which a set of them is broadcast
SMALL_SET = 1_000_000
#: bits of the bitmap that stands for a larger set
MAX_BITS = 1 << 27


def small_set(ids: DataFrame) -> DataFrame:
    """A one-column set of ids, broadcast if it is counted to be small, so that texts are not shuffled to meet it."""
    ids = cut_lineage(ids)
    return F.broadcast(ids) if ids.count() <= SMALL_SET else ids


def _marked(marks, bits: int):
    """Rows whose first column, an id, has its bit set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = marks.value
        for batch in batches:
            at = packed.spark_xxhash64(batch.column(0).to_numpy()) & (bits - 1)
            yield batch.filter(pa.array((words[at >> 6] >> (at & 63)) & 1 == 1))
    return run


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose first column, a non-null long, is in the one-column set ``ids``, found without a shuffle of the rows.

    A set counted to be small is broadcast.  Of a larger one a bitmap of hashes is,
    so that some other rows come along, the more the larger it is; a join leaves them out.
    """
    ids = cut_lineage(ids)
    name, n = ids.columns[0], ids.count()
    if n <= SMALL_SET:
        return rows.join(F.broadcast(ids), name, "left_semi")
    bits = min(MAX_BITS, 1 << (16 * n - 1).bit_length())
    at = ids.select(F.xxhash64(name).bitwiseAND(bits - 1).alias("at"))
    table = at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("held")).toArrow()
    words = np.zeros(bits >> 6, np.int64)
    words[table.column("word").to_numpy()] = table.column("held").to_numpy()
    return rows.mapInArrow(lean(_marked(rows.sparkSession.sparkContext.broadcast(words), bits)), rows.schema)


def let_go(spark: SparkSession) -> None:
    """Shuffle files and broadcasts of finished steps are removed from the executors now.

    Spark removes them once the driver's JVM finds that no plan refers to them any more, and
    a driver with memory to spare looks seldom: they would add up over the steps of a query.
    Plans that Python's own garbage refers to count as in use, so that is collected before.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back: cuts the lineage and keeps wide rows compressed."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


__all__ = ["WHITE", "SPLIT", "read", "bind", "words", "n_words", "crc", "held_out", "key", "own", "partitions",
           "setting", "shared_path", "leading_bits", "most_frequent", "small_set", "among", "let_go", "stored", "cut_lineage", "checkpoint_dir"]
