"""Merkle manifest of a dataset: one digest over all records, and per record the proof that leads to it.

H is the lowercase hex SHA-256 of its concatenated inputs; digests enter as hex
text.  A record's leaf is H over its columns (``-`` for null, else byte count,
``:``, value).  Every source has a tree: its leaves in doc_id order, then again
and again every ``FANOUT`` consecutive nodes become one, until one is left, the
subroot.  The subroots, in order of their sources, are the leaves of one more
such tree, whose top is the root.

1. Leaves are range-partitioned by (source, doc_id, leaf) and numbered inside
   their partition; the counts per (source, partition), of which there are no
   more than partitions and sources together, give each leaf its place in its
   source.  No window or task spans a source, however many rows it holds.
2. Slot pivot: conditional aggregates spread the children of a parent into
   ``FANOUT`` slot columns.  All slots concatenated are hashed to the parent;
   the slots before and after a child are its left and right siblings.  A level
   has a sixteenth of the rows of the one below.
3. From the top down, every pivoted parent hands its children its own path of
   (left, right) sibling strings behind theirs.  A leaf's path proves it: folding
   its digest with each (left, right) up the path gives the root again.

Edge cases: a null doc_id comes first in its source; rows of equal source and
doc_id are ordered by their leaves, so repeated rows are leaves side by side; a
null source is a source of its own, before all others; a single leaf is its
subroot and a single subroot the root, without siblings; a null or empty text is
a value like any other; texts are hashed whole, in one pass; an empty table
gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm import common as C

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"


def _field(col: Column) -> Column:
    value = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(values: dict[str, Column], columns=COLUMNS) -> Column:
    """H of a record's columns, in the order of ``columns``."""
    return F.sha2(F.concat(*[_field(values[c]) for c in columns]), 256)


def numbered(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, the place inside its ``tree`` (from 0) in the given order, and ``n``, the tree's size."""
    parts = C.partitions(rows.sparkSession)
    dealt = C.cut_lineage(rows.repartitionByRange(parts, F.col(tree), *order).sortWithinPartitions(F.col(tree), *order)
                          .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))
    counts = dealt.groupBy(tree, "part").agg(F.count("*").alias("here"), F.min("row").alias("first"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(tree, "part", "first", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"),
                           F.sum("here").over(whole).alias("n"))
    return (dealt.join(counts, [tree, "part"]).withColumn("pos", F.col("row") - F.col("first") + F.col("offset"))
            .drop("part", "row", "first", "offset"))


def _slots() -> list[Column]:
    return [F.col(f"s{i}") for i in range(FANOUT)]


def _pivot(nodes: DataFrame, tree: str, payload: list[str]) -> DataFrame:
    """One row per parent: tree, pos, n (nodes of its level) and the children in slot columns s0, s1, ..."""
    child = F.struct("digest", *payload)
    spread = [F.max(F.when(F.col("pos") % FANOUT == i, child)).alias(f"s{i}") for i in range(FANOUT)]
    up = nodes.groupBy(tree, F.shiftright("pos", FANOUT.bit_length() - 1).alias("up")).agg(F.max("n").alias("n"), *spread)
    return C.cut_lineage(up.withColumnRenamed("up", "pos").withColumn("n", F.ceil(F.col("n") / FANOUT).cast("long")))


def _unpivot(parents: DataFrame, tree: str, payload: list[str], keep: list[str]) -> DataFrame:
    """The children of pivoted parents that have a path: their siblings, then the parent's path."""
    digests = [s["digest"] for s in _slots()]
    children = F.array(*[
        F.when(s.isNotNull(), F.struct(
            F.lit(i).alias("slot"), s["digest"].alias("digest"), *[s[p].alias(p) for p in payload],
            F.concat_ws("", *digests[:i]).alias("left"), F.concat_ws("", *digests[i + 1:]).alias("right")))
        for i, s in enumerate(_slots())])
    each = parents.select(tree, "pos", "path", *keep, F.explode(F.array_compact(children)).alias("c"))
    step = F.array(F.struct("c.left", "c.right")).cast(f"array<{STEP}>")
    return each.select(tree, (F.col("pos") * FANOUT + F.col("c.slot")).alias("pos"), "c.digest",
                       *[F.col(f"c.{p}").alias(p) for p in payload], F.concat(step, "path").alias("path"), *keep)


def grow(nodes: DataFrame, tree: str, payload: list[str], most: int) -> tuple[list[DataFrame], DataFrame]:
    """The pivoted levels above numbered ``nodes`` (tree, pos, n, digest) and the tops (tree, digest, depth).

    ``most`` is the size of the largest tree.  A tree of n nodes has ceil(log16 n) levels.
    """
    levels, tops, depth = [], None, 0
    while True:
        top = nodes.filter("n = 1").select(tree, "digest", F.lit(depth).alias("depth"))
        tops = top if tops is None else tops.unionByName(top)
        if most <= 1:
            return levels, tops
        pivot = _pivot(nodes.filter("n > 1"), tree, payload if depth == 0 else [])
        levels.append(pivot)
        nodes = pivot.select(tree, "pos", "n", F.sha2(F.concat_ws("", *[s["digest"] for s in _slots()]), 256).alias("digest"))
        most, depth = -(-most // FANOUT), depth + 1


def descend(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, tree: str, payload: list[str],
            keep: list[str]) -> DataFrame:
    """The bottom nodes with their whole paths; ``tops`` has tree, depth, path and the columns ``keep``."""
    paths = None
    for depth in range(len(levels), 0, -1):
        own = tops.filter(F.col("depth") == depth).select(tree, F.lit(0).cast("long").alias("pos"), "path", *keep)
        paths = own if paths is None else own.unionByName(paths.select(tree, "pos", "path", *keep))
        paths = _unpivot(levels[depth - 1].join(paths, [tree, "pos"]), tree, payload if depth == 1 else [], keep)
    single = nodes.filter("n = 1").join(tops.filter("depth = 0").select(tree, "path", *keep), tree).select(
        tree, "pos", "digest", *payload, "path", *keep)
    return single if paths is None else single.unionByName(paths)


def manifest(docs: DataFrame, changed: Column | None = None, doc_id: str = "doc_id", source: str = "source",
             lang: str = "lang", n_chars: str = "n_chars", text: str = "text") -> DataFrame:
    """One row per record: doc_id, source, leaf, subroot, root, path (array of left and right siblings, leaf to root).

    With ``changed``, a text to be held against the manifest (null: the record's own), also ``seen``: the
    leaf of the record with that text, to be folded with the path.
    """
    names = dict(zip(COLUMNS, (doc_id, source, lang, n_chars, text), strict=True))
    values = {c: F.col(f"`{n}`") for c, n in names.items()}
    leaf = leaf_digest(values)
    seen = F.lit(None).cast("string") if changed is None else F.when(
        changed.isNotNull(), leaf_digest(values | {"text": changed}))
    rows = C.cut_lineage(docs.select(
        C.key(values["source"]).alias("tree"), values["source"].cast("string").alias("source"),
        values["doc_id"].alias("doc_id"), leaf.alias("digest"), seen.alias("seen")))
    leaves = numbered(rows.drop("source"), "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    payload = ["doc_id", "seen"]
    most = rows.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels, tops = grow(leaves, "tree", payload, most)
    # the tree over the subroots: its leaves are the tops, in order of their sources
    tops = C.cut_lineage(tops)
    over = numbered(tops.select(F.lit(0).alias("all"), "tree", "digest", "depth"), "all", [F.col("tree")])
    over_levels, over_tops = grow(over, "all", ["tree", "depth"], tops.count())
    over_tops = over_tops.select("all", "depth", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    heads = descend(over, over_levels, over_tops, "all", ["tree", "depth"], ["root"])
    heads = C.cut_lineage(heads.select("tree", "depth", F.col("digest").alias("subroot"), "root", "path"))
    out = descend(leaves, levels, heads, "tree", payload, ["subroot", "root"])
    name = F.when(F.col("tree") != "", F.substring("tree", 2, 2 ** 31 - 1))
    return out.select("doc_id", name.alias("source"), F.col("digest").alias("leaf"), "subroot", "root", "path", "seen")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; where 5 divides the id's crc32, held against a lower-cased text."""
    docs = C.read(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(C.crc(F.col("doc_id")) % 5 == 0, F.coalesce(lower, F.lit("")))
    # a null text stays null: its leaf is its own
    m = manifest(docs, F.when(F.col("text").isNotNull(), tampered))
    whole = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    m = m.select("doc_id", "leaf", "subroot", "root", F.sha2(whole, 256).alias("proof_sha256"),
                 folded(F.coalesce("seen", "leaf"), F.col("path")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6) -> str:
    """DuckDB SQL for trees of at most FANOUT ** levels nodes."""
    hexes = "('0x' || hex(encode(doc_id::VARCHAR))[j:j + 1])::BIGINT"
    enc = {c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in COLUMNS}
    low = "translate(text, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')"
    leaf = " || ".join(enc[c] for c in COLUMNS)
    seen = leaf.replace(enc["text"], enc["text"].replace("text", low)) if "text" in enc else leaf

    def climb(tag: str, base: str, tree: str) -> str:
        """CTEs {tag}0 .. {tag}{levels}: nodes of a level; {tag}p0 .. : with the strings of their siblings."""
        out = [f"{tag}0 AS ({base})"]
        for k in range(levels):
            run = f"PARTITION BY {tree}, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
            out.append(f"""{tag}p{k} AS (SELECT {tree}, pos, pos // {FANOUT} AS up, n,
                coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM {tag}{k})""")
            out.append(f"""{tag}{k + 1} AS (SELECT {tree}, pos // {FANOUT} AS pos, (max(n) + {FANOUT - 1}) // {FANOUT} AS n,
                CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
                FROM {tag}{k} GROUP BY {tree}, pos // {FANOUT})""")
        return ",\n".join(out)

    def path(tag: str, start: str, tree: str, keep: str) -> str:
        """CTEs {tag}q0 .. {tag}q{levels}: proof and folded digest so far of every bottom node."""
        out = [f"{tag}q0 AS ({start})"]
        for k in range(levels):
            out.append(f"""{tag}q{k + 1} AS (SELECT {keep}, {tree}, p.up AS pos, q.proof || p.l || p.r AS proof,
                CASE WHEN p.n = 1 THEN q.fold ELSE sha256(p.l || q.fold || p.r) END AS fold
                FROM {tag}q{k} q JOIN {tag}p{k} p USING ({tree}, pos))""")
        return ",\n".join(out)

    return f"""
WITH tbl AS (SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1
               THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS g(i))),
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({leaf}) AS digest, sha256({seen}) AS seen,
        xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
            range(1, len(hex(encode(doc_id::VARCHAR))), 2), lambda j: {hexes})),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM documents, tbl),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
        count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{climb('a', 'SELECT tree, pos, n, digest FROM placed', 'tree')},
subs AS (SELECT 0 AS one, tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a{levels}),
{climb('b', 'SELECT one, pos, n, digest FROM subs', 'one')},
{path('a', "SELECT doc_id, digest AS leaf, tree, pos, '' AS proof, CASE WHEN crc % 5 = 0 THEN seen ELSE digest END AS fold FROM placed",
      'tree', 'q.doc_id, q.leaf')},
{path('b', f"SELECT q.doc_id, q.leaf, s.digest AS subroot, s.one, s.pos, q.proof, q.fold FROM aq{levels} q JOIN subs s USING (tree)",
      'one', 'q.doc_id, q.leaf, q.subroot')}
SELECT q.doc_id, q.leaf, q.subroot, b.digest AS root, sha256(q.proof) AS proof_sha256, q.fold AS folded_root,
       q.fold = b.digest AS verified FROM bq{levels} q, b{levels} b
"""


OP12_SQL = _sql()
