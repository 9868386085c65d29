"""Sharding by sampled splitters.

Records are ordered by the key (crc32 of the text, doc_id), so equal texts lie
side by side.  Keys are drawn with a chance proportional to their size, the
weighted quantiles of the draws become range boundaries, and records are
range-partitioned by them.  A range that holds over twice its share is drawn
from again and subdivided, until every range is within its share, but for one
record that may be larger, or holds a single key.  Exact totals per range then give every record its place in the
whole order by one window per range (no window spans the data), and a shard is
the sixteenth of all bytes in which the middle of the record falls.  Law
``bytes``: shard sizes differ by less than the two records at their ends.

Edge cases: a null text has size 1 and crc32 0; null ids come first among equal
texts; repeated rows are placed one after the other; an empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm import common as C

SHARDS = 16
FANOUT = 128            # ranges per level
DRAWS = 64              # expected draws per range
SMALL_TABLE = 10_000    # rows up to which a table of ranges is broadcast; larger ones are joined by shuffle
MAX_RANGE_ROWS = 4_000_000


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
                       C.crc(t).alias("text_crc32"))


def _key() -> Column:
    return F.struct(F.col("text_crc32").alias("c"), F.coalesce(F.col("doc_id"), F.lit(-(2 ** 63))).alias("d"))


def _sized(table: DataFrame, n: int) -> DataFrame:
    """A table of ranges with ``n`` rows, broadcast if that is few."""
    return F.broadcast(table) if n <= SMALL_TABLE else table


def _splitters(rows: DataFrame, fanout: int, level: int) -> DataFrame:
    """(range, splitters): sorted boundary keys of every range; ``bytes`` of each row is its range's total.

    At most about ``fanout * DRAWS`` keys are drawn per range, whatever its rows.
    """
    u = (F.xxhash64("text_crc32", "doc_id", F.lit(level)) % 1_000_000 + 1_000_000) / 2_000_000
    drawn = (rows.withColumn("draws", F.floor(F.col("size") * (fanout * DRAWS) / F.col("bytes") + u).cast("long"))
             .filter("draws > 0").groupBy("range", _key().alias("k")).agg(F.sum("draws").alias("draws")))
    w = Window.partitionBy("range")
    run = (drawn.withColumn("upto", F.sum("draws").over(w.orderBy("k")))
           .withColumn("part", F.floor(F.col("upto") * fanout / (F.sum("draws").over(w) + 1))))
    first = run.groupBy("range", "part").agg(F.min("k").alias("k")).filter("part > 0")
    return first.groupBy("range").agg(F.sort_array(F.collect_list("k")).alias("splitters"))


def _place(splitters: Column) -> Column:
    """How many of the boundary keys lie at or before the row's key."""
    return F.size(F.filter(splitters, lambda b: b <= _key()))


def _first_ranges(rows: DataFrame, fanout: int) -> tuple[DataFrame, int]:
    """The ranges of the first level and the bytes of all rows.

    All rows are one range here, so its total and its (fewer than ``fanout``) boundary keys are literals: no join.
    """
    whole = rows.agg(F.sum("size")).first()[0] or 0
    one = rows.withColumns({"range": F.lit(0).cast("long"), "bytes": F.lit(whole).cast("long")})
    cuts = _splitters(one, fanout, 0).select(F.explode("splitters").alias("k")).select("k.*").collect() if whole else []
    keys = F.array(*[F.struct(F.lit(c).cast("long").alias("c"), F.lit(d).cast("long").alias("d")) for c, d in sorted(map(tuple, cuts))])
    inner = _place(keys) if cuts else F.lit(0)
    return C.cut_lineage(rows.withColumn("range", inner.cast("long"))), whole


def ranged(rows: DataFrame, shards: int = SHARDS, fanout: int = FANOUT,
           max_range_rows: int = MAX_RANGE_ROWS) -> DataFrame:
    """``rows`` with a range number that grows with the key."""
    rows, whole = _first_ranges(rows, fanout)
    level, before = 1, 0
    share = max(1, whole // (fanout if shards <= fanout else shards))
    while True:
        totals = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"),
                                           F.max("size").alias("largest"), F.min(_key()).alias("lo"), F.max(_key()).alias("hi"))
        over = ((F.col("bytes") - F.col("largest") > 2 * share) | (F.col("n") > max_range_rows)) & (F.col("lo") < F.col("hi"))
        totals = C.cut_lineage(totals.withColumn("over", over))
        n_ranges, totals = totals.count(), C.cut_lineage(totals.filter("over"))
        n = totals.count()
        if not n or n_ranges == before:     # a range beside one huge record may not divide further
            return rows
        before = n_ranges
        cuts = C.cut_lineage(_splitters(rows.join(_sized(totals.select("range", "bytes"), n), "range"), fanout, level))
        rows = (rows.join(_sized(cuts, n), "range", "left")
                .withColumn("range", F.col("range") * fanout + _place(F.coalesce(
                    "splitters", F.array().cast("array<struct<c:bigint,d:bigint>>")))).drop("splitters"))
        rows = C.cut_lineage(rows)
        level += 1


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text",
                   fanout: int = FANOUT) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: law ``bytes``)."""
    rows = ranged(C.cut_lineage(records(docs, doc_id, text)), shards, fanout)
    totals = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # one row per range: as many as the data has range-sized pieces
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = C.cut_lineage(totals)
    whole, n = totals.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    offsets = totals.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("r0"))
    inside = Window.partitionBy("range").orderBy(*order())
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("b", F.coalesce(F.sum("size").over(run), F.lit(0)))
              .withColumn("r", F.row_number().over(inside) - 1).join(_sized(offsets, n), "range"))
    middle = 2 * (F.col("b0") + F.col("b")) + F.col("size")
    shard = F.call_function("div", middle * shards, F.lit(max(1, 2 * whole)))
    placed = placed.select("doc_id", "size", "text_crc32", (F.col("r0") + F.col("r")).alias("rank"),
                           F.least(shard, F.lit(shards - 1)).cast("int").alias("shard"))
    placed = C.cut_lineage(placed)
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def order() -> list[Column]:
    return [F.col("text_crc32"), F.col("doc_id").asc_nulls_first(), F.col("size")]


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of near equal bytes."""
    return shard_by_bytes(C.read(spark, sf_dir, "documents"))


_HEX = "hex(encode(coalesce(text, '')))"
OP5_SQL = f"""
WITH tbl AS (SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1
               THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS g(i))),
bytes AS (SELECT doc_id, text, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_HEX} AS h FROM documents),
rec AS (SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
            list_transform(range(1, len(h), 2), lambda j: ('0x' || h[j:j + 1])::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM bytes, tbl),
pos AS (SELECT *, coalesce(sum(size) OVER (ORDER BY text_crc32, doc_id NULLS FIRST, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b,
            (sum(size) OVER ())::BIGINT AS whole FROM rec),
sh AS (SELECT *, least({SHARDS - 1}, ((2 * b + size) * {SHARDS}) // (2 * whole))::INTEGER AS shard FROM pos)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY text_crc32, doc_id NULLS FIRST, size) - 1 AS slot,
       NULL::INTEGER AS grown_shard FROM sh
"""
