"""Records out of JSON files that hold objects back to back, with or without separators.

Files are cut at every ``}``, wherever it stands, so Spark splits them over tasks
as it splits lines, and a file of one endless line is no exception.  Whether a
``}`` ends a record depends on all that comes before it, but only through a small
state: inside a string or not, and how many braces are open.

1. A piece (what lies before a ``}``) maps the state before it to the state after:
   its unescaped quotes flip "inside a string", and the braces that count are
   those outside, known for either start.
2. Inside a split, running sums compose the maps of its pieces; a split as a whole
   is then again such a map: one row with its flips and its change of depth for
   either start.
3. A window over the splits of a file (one row per split) gives every split its
   true start, and so every piece its true state.  Pieces that stand between two
   returns to depth 0 are one record and meet by its key.

Text between records may be white space, commas and square brackets (so an array
of objects reads the same way).  What else stands there, a record the file ends
in, and text that does not parse are reported, never dropped.  Whether the very
last ``}`` is there is told from the file's size; for compressed files it is taken
to be.  A record is put together in one task; a split's pieces are sorted in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BETWEEN = r"^[\s,\[\]\x{FEFF}]*"
BAD = "_bad_text"


def _outside(segments: Column, start: int) -> Column:
    """``{`` outside strings, when the piece starts inside (1) or outside (0) of one: every other segment between quotes."""
    mine = F.filter(segments, lambda s, i: i % 2 == start)
    return F.aggregate(mine, F.lit(0), lambda acc, s: acc + F.length(s) - F.length(F.replace(s, F.lit("{"))))


def pieces(spark: SparkSession, path) -> DataFrame:
    """Pieces with their place: file, split, nth, piece (without the brace), closed (whether a brace follows)."""
    raw = spark.read.option("lineSep", "}").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                      F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("nth"),
                      F.col("value").alias("piece"))
    # a last piece without its brace: the pieces and one brace each are a byte more than the file (3 less with a byte order mark)
    ends = rows.groupBy("file").agg(F.max(F.struct("split", "nth")).alias("last"),
                                    F.sum(F.octet_length("piece") + 1).alias("bytes"), F.max("size").alias("size"))
    open_ends = ends.where((F.col("bytes") - F.col("size")).isin(1, -2)).select(
        "file", F.col("last.split").alias("split"), F.col("last.nth").alias("nth"), F.lit(False).alias("closed"))
    return rows.drop("size").join(open_ends, ["file", "split", "nth"], "left").withColumn(
        "closed", F.coalesce("closed", F.lit(True)))


def split_records(spark: SparkSession, path) -> DataFrame:
    """One row per record or leftover: file, record (numbers grow along a file), value, problem (NULL: none)."""
    # pairs of a backslash and what it escapes hold no quotes or braces that count
    segments = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"', -1)
    p = pieces(spark, path).withColumn("_seg", segments)
    p = p.withColumns({"flips": (F.size("_seg") - 1) % 2, "open0": _outside(F.col("_seg"), 0),
                       "open1": _outside(F.col("_seg"), 1)}).drop("_seg")
    inside = Window.partitionBy("file", "split").orderBy("nth")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumn("after", F.sum("flips").over(upto) % 2)        # for a split that starts outside; else the other one
    before = (F.col("after") + F.col("flips")) % 2
    for start in (0, 1):
        opened = F.when(before == start, F.col("open0")).otherwise(F.col("open1"))
        shut = F.when(F.col("closed") & (F.col("after") == start), 1).otherwise(0)
        p = p.withColumn(f"change{start}", opened - shut)
    p = p.withColumns({f"depth{s}": F.sum(f"change{s}").over(upto) for s in (0, 1)})
    # one row per split: its map of states
    maps = p.groupBy("file", "split").agg((F.sum("flips") % 2).alias("flips"), F.sum("change0").alias("change0"),
                                          F.sum("change1").alias("change1"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumn("state", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2)
    maps = maps.withColumn("change", F.when(F.col("state") == 0, F.col("change0")).otherwise(F.col("change1")))
    maps = maps.select("file", "split", "state", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth"))
    p = p.join(maps, ["file", "split"])
    depth = F.col("depth") + F.when(F.col("state") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    p = p.withColumn("ends", (F.col("closed") & (depth <= 0) & (F.col("after") == F.col("state"))).cast("int"))
    # a record's number: returns to depth 0 before it, first by split, then inside
    returns = p.groupBy("file", "split").agg(F.sum("ends").alias("ends"))
    returns = returns.select("file", "split", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("records"))
    p = p.join(returns, ["file", "split"]).withColumn(
        "record", F.col("records") + F.sum("ends").over(upto) - F.col("ends"))
    text = F.concat("piece", F.when(F.col("closed"), F.lit("}")).otherwise(F.lit("")))
    whole = p.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("split", "nth", text.alias("text")))).alias("parts"),
                                            F.max("ends").alias("done"))
    value = F.regexp_replace(F.array_join("parts.text", ""), BETWEEN, "")
    whole = whole.select("file", "record", value.alias("value"), "done").where("done = 1 OR value <> ''")
    problem = F.when(~F.col("value").startswith("{"), F.lit("unexpected text")).when(F.col("done") == 0, F.lit("truncated"))
    return whole.select("file", "record", "value", problem.alias("problem"))


def read_concatenated(spark: SparkSession, path, schema: T.StructType, on_error: str = "raise") -> DataFrame:
    """Parsed records of concatenated files.

    on_error="raise": running the query fails on the first leftover, truncated or unparsable record.
    on_error="report": all rows, with ``_problem`` (NULL: none) and ``_text`` (of a row with a problem).
    """
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    rows = split_records(spark, path).withColumn(
        "r", F.from_json("value", full, {"columnNameOfCorruptRecord": BAD, "mode": "PERMISSIVE"}))
    problem = F.coalesce("problem", F.when(F.col("r").isNull() | F.col(f"r.{BAD}").isNotNull(), F.lit("unparsable")))
    rows = rows.withColumn("problem", problem)
    fields = [F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields]
    if on_error == "report":
        return rows.select(*[F.when(F.col("problem").isNull(), c).alias(f.name)
                             for c, f in zip(fields, schema.fields, strict=True)],
                           F.col("problem").alias("_problem"), F.when(F.col("problem").isNotNull(), F.col("value")).alias("_text"))
    if on_error != "raise":
        raise ValueError("on_error is 'raise' or 'report'")
    message = F.concat(F.lit("record "), F.col("record").cast("string"), F.lit(" of "), F.col("file"), F.lit(": "), F.col("problem"))
    checked = rows.where(F.when(F.col("problem").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*fields)
