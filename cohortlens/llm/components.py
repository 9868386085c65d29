"""Connected components of a graph held in tables (no part of it reaches the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of ``links`` (columns a, b) the smallest node it is connected with.

    Each round hooks every node to its smallest neighbour, follows the hooks a
    few steps by pointer doubling and contracts the links; a node that did not get
    to its root this way keeps a link to where it got.  Minima are combined before
    the shuffle, and joins on a node with very many links are split by AQE.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    links = C.cut_lineage(links.unionByName(links.selectExpr("b AS a", "a AS b")).distinct())
    whole = None
    while links.take(1):
        hook = links.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("root"))
        jump = hook
        for _ in range(2):
            jump = jump.join(jump.select(F.col("node").alias("root"), F.col("root").alias("top")), "root").select(
                "node", F.col("top").alias("root"))
        jump = C.cut_lineage(jump)
        up = jump.select(F.col("node").alias("root"), F.col("root").alias("top"))
        if whole is None:
            whole = jump
        else:
            whole = C.cut_lineage(whole.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        ends = [jump.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in ("a", "b")]
        left = links.join(ends[0], "a").join(ends[1], "b").selectExpr("ra AS a", "rb AS b")
        far = jump.select("root").distinct().join(up, "root").selectExpr("root AS a", "top AS b")
        links = left.unionByName(far).unionByName(far.selectExpr("b AS a", "a AS b")).filter("a <> b").distinct()
        links = C.cut_lineage(links)
    return whole if whole is not None else links.selectExpr("a AS node", "b AS root")


def extend(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after further links, of which only those between known components are worked on."""
    if found is None:
        return components(links)
    ends = [found.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in ("a", "b")]
    across = (links.join(ends[0], "a", "left").join(ends[1], "b", "left")
              .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    top = components(across)
    moved = found.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    fresh = top.join(found.select("node"), "node", "left_anti")
    return C.cut_lineage(moved.select("node", F.coalesce("top", "root").alias("root")).unionByName(fresh))
