"""Jaccard join of documents on word shingles by T-occurrence search.

A document's set is its distinct five-word shingles (of the text with A-Z in
lower case); a text with fewer words has its whole sequence as one shingle, one
without words has none and is linked with nothing.  Two documents link when
``100 * intersection >= 80 * union``.  All such links count; groups of copies
are never expanded into all pairs.

1. Documents with equal sets (128-bit digest) form a class; its smallest
   doc_id stands for it.
2. Shingles have one order for the whole corpus: those counted often in some
   chunk of documents last, by count, all others before them by hash.  Linked
   sets share a shingle within the first ``n - ceil(0.8 n) + 1`` of either.  The
   order decides the cost only, so a bounded table of frequent shingles is enough.
3. Tasks hash these leading shingles; a chunk is combined before the shuffle (one
   entry per shingle), and hash buckets find the shingles of two or more
   documents.  Only these *lists* go on.
4. Every list has a few leaders, drawn by a hash.  A document is compared with the
   two leaders it shares most lists with: linear in the documents.  The links found
   contract documents into components, and lists of one component are done with.
5. Documents of one list in different components are candidates, the one in the
   smaller component as the query.  A query's lists meet in a task, as blocks of
   postings, and documents that occur in too few of them for the overlap drop out;
   the others are compared, the likeliest first, as long as they are not connected
   yet.  So no link that would join two components is missed, and pairs inside
   one are not enumerated.

A comparison is a T-occurrence search: of the query's shingles, each with the
list of candidates that hold it, the ``L`` longest lists are set aside; the
others are merged through a heap, candidates that reach ``T - L`` occurrences
are looked up in the long lists by binary search (DivideSkip), and those that
reach the overlap of their own size are links.  A query with many candidates
is dealt out in bounded groups.

Edge cases: a null doc_id counts as the smallest and comes back null; rows with
one doc_id are one document (its texts are linked with each other), repeated
rows are returned as often as they occur; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm import common as C
from cohortlens.llm import packed
from cohortlens.llm import wordhash as W
from cohortlens.llm.components import extend
from cohortlens.llm.worker import lean, lean_group

SIZE = 5
#: similarity as a fraction
NUM, DEN = 4, 5
NO_ID = -(2 ** 63)
CHUNK = 1_000_000       # shingles combined before a shuffle
OFTEN = 8               # documents of a chunk that make a shingle frequent there
MAX_FREQUENT = 200_000  # entries of the broadcast order of frequent shingles
GROUP = 128             # candidates searched at a time
LEADERS, BEST = 12, 2    # leaders per list, and those a document is compared with
LIKELIEST = 4           # candidates per document compared before all others
BLOCK, POSTINGS = 2048, 2_000_000   # documents in a block of a list; postings counted together in a task
SENT, AGAIN = 32_000_000, 16    # postings under way at once: so many, or so many times those of all lists


# ---- sets ---------------------------------------------------------------------------------

def _scan(batches: Iterator[pa.RecordBatch], each) -> Iterator[pa.RecordBatch]:
    """``each(ids, values, offsets)`` for the sets of consecutive documents."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i, j, w in W.batches(batch.column(1), lower=True, max_bytes=W.SMALL_BYTES):
            yield from each(ids[i:j], *W.shingle_sets(w, SIZE))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, n, d1, d2) of documents and (hash, null, count, null) of shingles frequent in a chunk."""
    held, size = [], 0

    def often() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        h, n = h[n >= OFTEN], n[n >= OFTEN]
        empty = pa.nulls(len(h), pa.int64())
        return pa.record_batch([h.view(np.int64), empty, n, empty], names=["doc", "n", "d1", "d2"])

    def each(ids, values, offsets):
        nonlocal held, size
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(values ^ np.uint64(seed)), dtype=np.uint64)))
                for seed in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5)]
        d1, d2 = (np.asarray(s[offsets[1:]] - s[offsets[:-1]], np.uint64).view(np.int64) for s in sums)
        yield pa.record_batch([ids, np.diff(offsets), d1, d2], names=["doc", "n", "d1", "d2"])
        held.append(values)
        size += len(values)
        if size >= CHUNK:
            yield often()
            held, size = [], 0

    yield from _scan(batches, each)
    if held:
        yield often()


# ---- lists of shared leading shingles --------------------------------------------------------

_LISTS = "bucket long, listed boolean, token binary, doc binary, n binary, many binary"


def _lists_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(
        cols, (pa.int64(), pa.bool_(), *[pa.binary()] * 4), strict=True)],
        names=["bucket", "listed", "token", "doc", "n", "many"])


def _leading(order, buckets: int):
    """Packed leading shingles by bucket; ``listed`` rows are known to be in a list already."""
    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        token, doc, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        at = np.lexsort((doc, token))
        token, doc, n = token[at], doc[at], n[at]
        del at
        run = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        many = np.diff(np.append(run, len(token))) > 1
        rest = np.ones(len(token), bool)
        rest[run] = False
        shift = np.uint64(64 - buckets.bit_length() + 1)
        rows = []
        for listed, part in ((False, run), (True, np.flatnonzero(rest))):
            key = token[part]
            cut = np.searchsorted(key >> shift, np.arange(buckets + 1, dtype=np.uint64))
            flag = many.astype(np.int64) if not listed else np.ones(len(part), np.int64)
            for b in range(buckets):
                x = slice(cut[b], cut[b + 1])
                if cut[b] < cut[b + 1]:
                    rows.append((b, listed, packed.pack(key[x], True), packed.pack(doc[part[x]]),
                                 packed.pack(n[part[x]]), packed.pack(flag[x])))
        yield _lists_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = order.value
        held, size = [], 0

        def each(ids, values, offsets):
            nonlocal held, size
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(ids)), n)
            place = np.full(len(values), -1)
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                place = np.where(known[at] == values, rank[at], -1)
            by = np.lexsort((values, place, owner))
            values, owner = values[by], owner[by]
            lead = n - (NUM * n + DEN - 1) // DEN + 1
            first = np.arange(len(values)) - offsets[owner] < lead[owner]
            held.append((values[first], ids[owner[first]], n[owner[first]]))
            size += int(first.sum())
            if size >= CHUNK:
                yield from flush(held)
                held, size = [], 0

        yield from _scan(batches, each)
        if size:
            yield from flush(held)
    return run


def _shared(table: pa.Table) -> pa.Table:
    """Rows (token, doc, n) of a bucket's shingles that two or more documents have among their leading ones."""
    out = []
    for wanted in (False, True):
        part = table.filter(table.column("listed") if wanted else pc.invert(table.column("listed")))

        def column(name: str, part: pa.Table = part) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.int64), *(packed.unpack(x.as_py(), name == "token") for x in part.column(name))])

        # one column at a time: a bucket may hold millions of entries
        token, at = column("token"), slice(None)
        if not wanted and len(token):
            at = np.argsort(token)
            token = token[at]
            run = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.append(run, len(token)))
            keep = np.repeat((size > 1) | (np.add.reduceat(column("many")[at], run) > 0), size)
            token, at = token[keep], at[keep]
            del run, size, keep
        out.append(pa.table({"token": token, "doc": column("doc")[at], "n": column("n")[at]}))
    return pa.concat_tables(out)


# ---- T-occurrence search ---------------------------------------------------------------------

def t_occurrence(query: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(candidates that link with the query, their overlaps); sets are sorted and distinct."""
    sizes = np.array([len(s) for s in sets])
    need = -(-NUM * (len(query) + sizes) // (NUM + DEN))      # overlap that makes 100 i >= 80 u
    member = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    at = np.minimum(np.searchsorted(query, values), len(query) - 1)
    hit = query[at] == values
    by = np.argsort(at[hit], kind="stable")
    member, at = member[hit][by], at[hit][by]
    cut = np.searchsorted(at, np.arange(len(query) + 1))
    lists = sorted((member[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True) if a < b), key=len, reverse=True)
    least = int(need.min())
    if not lists or len(lists) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # lists set aside: they can add this much, so the rest must give least - n_long occurrences
    n_long = min(least - 1, int(least / (0.01 * np.log2(len(lists[0]) + 1) + 1)))
    count = np.zeros(len(sets), np.int64)
    for member_id, same in groupby(heapq.merge(*(x.tolist() for x in lists[n_long:]))):
        count[member_id] = sum(1 for _ in same)
    alive = np.flatnonzero(count >= least - n_long)
    for long_list in lists[:n_long]:
        if not len(alive):
            break
        place = np.minimum(np.searchsorted(long_list, alive), len(long_list) - 1)
        count[alive] += long_list[place] == alive
    found = alive[count[alive] >= need[alive]]
    return found, count[found]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (query, part): the query's own text (b null) and its candidates' texts."""
    state: dict = {"key": None, "query": [], "ids": [], "sets": []}

    def found() -> list[tuple[int, int, int]]:
        out = []
        for q in state["query"]:
            if state["sets"] and len(q):
                hits, overlap = t_occurrence(q, state["sets"])
                out += [(state["key"][0], state["ids"][k], n) for k, n in zip(hits, overlap, strict=True)]
        state["ids"], state["sets"] = [], []
        return out

    for batch in batches:
        a, b, part = (batch.column(k).to_pylist() for k in range(3))
        links = []
        for i, j, w in W.batches(batch.column(3), lower=True, max_bytes=W.SMALL_BYTES):
            values, offsets = W.shingle_sets(w, SIZE)
            for k in range(i, j):
                if (a[k], part[k]) != state["key"]:
                    links += found()
                    state["key"], state["query"] = (a[k], part[k]), []
                own = values[offsets[k - i]:offsets[k - i + 1]]
                if b[k] is None:
                    state["query"].append(own)
                elif len(own):
                    state["ids"].append(b[k])
                    state["sets"].append(own)
                    if len(state["sets"]) >= GROUP:
                        links += found()
        if links:
            yield _links(links)
    if links := found():
        yield _links(links)


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a, b, n = zip(*rows, strict=True)
    return pa.record_batch([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "overlap"])


def search(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the candidate pairs (a, b) that link: a is the query, b its candidate; texts: (doc, text).

    Texts of documents that are in no pair are left out where they are read, and
    the others meet their uses in one shuffle.
    """
    spark = texts.sparkSession
    load = pairs.groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (8 * GROUP))).cast("long").alias("parts"))
    given = pairs.join(load, "a").select(F.col("b").alias("doc"), "a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    asked = load.select(F.col("a").alias("doc"), "a", F.lit(None).cast("long").alias("b"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    uses = C.cut_lineage(asked.unionByName(given))
    rows = (uses.join(C.among(texts, uses.select("doc").distinct()), "doc").select("a", "b", "part", "text")
            .repartition(C.partitions(spark), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()))
    return C.cut_lineage(rows.mapInArrow(lean(_search), "a long, b long, overlap long"))


def _sizes_fit():
    return (F.col("na") * NUM <= F.col("nb") * DEN) & (F.col("nb") * NUM <= F.col("na") * DEN) & (F.col("a") != F.col("b"))


def _may_link():
    """Whether sets of na and nb shingles that share c of their leading ones can reach the overlap.

    What they share beyond the leading ones of the set whose leading ones end
    first lies in that set's rest, which has ``ceil(0.8 n) - 1`` shingles.
    """
    need = F.ceil((F.col("na") + F.col("nb")) * NUM / (NUM + DEN))
    rest = F.ceil(F.greatest("na", "nb") * NUM / DEN) - 1
    return _sizes_fit() & (F.col("c") >= need - rest)


def _placed(lists: DataFrame, found: DataFrame | None) -> DataFrame:
    """Lists that hold documents of two or more components: (token, doc, n, comp, size, top, m).

    ``size`` is that of the document's component, ``top`` the largest (size, comp)
    in the list and ``m`` the list's length.
    """
    if found is None:
        placed = lists.withColumns({"comp": F.col("doc"), "size": F.lit(1).cast("long")})
    else:
        sizes = found.groupBy("root").agg(F.count("*").alias("size"))
        known = found.join(sizes, "root").select(F.col("node").alias("doc"), "root", "size")
        placed = lists.join(known, "doc", "left").select(
            "token", "doc", "n", F.coalesce("root", "doc").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
    mixed = (placed.groupBy("token").agg(F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("m"),
                                         F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .filter("lo < hi").drop("lo", "hi"))
    return C.cut_lineage(placed.join(mixed, "token"))


def _with_leaders(placed: DataFrame) -> DataFrame:
    """Candidates (a, b): for every document b the few leaders, of other components, that it shares most lists with."""
    lead = [F.min_by(F.struct("doc", "n", "comp"), F.xxhash64("doc", F.lit(k))) for k in range(LEADERS)]
    leaders = placed.groupBy("token").agg(F.array_distinct(F.array(*lead)).alias("leaders"))
    star = placed.join(leaders, "token").select(
        F.col("doc").alias("b"), F.col("n").alias("nb"), "comp",
        F.explode(F.filter("leaders", lambda x: x["comp"] != F.col("comp"))).alias("lead"))
    star = (star.groupBy(F.col("lead.doc").alias("a"), F.col("lead.n").alias("na"), "b", "nb")
            .agg(F.count("*").alias("c")).filter(_may_link()))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), "a"))
    return star.select("a", "b", rank.alias("rank")).filter(F.col("rank") <= BEST).select("a", "b")


def _count_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, na, ca, sa, part, parts, postings) sorted by (a, part): candidates of larger components, lists shared."""
    key, held = None, []

    def found() -> Iterator[pa.RecordBatch]:
        if key is None:
            return
        a, part, na, ca, sa, parts = key
        docs, n, comps, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        mine = ((sizes > sa) | ((sizes == sa) & (comps > ca))) & (packed.spark_xxhash64(docs) % parts == part)
        both, c = np.unique(np.stack([docs[mine], n[mine]]), axis=1, return_counts=True)
        docs, nb = both
        need = -(-NUM * (na + nb) // (NUM + DEN))
        rest = -(-NUM * np.maximum(na, nb) // DEN) - 1
        ok = (na * NUM <= nb * DEN) & (nb * NUM <= na * DEN) & (c >= need - rest)
        yield pa.record_batch([np.full(int(ok.sum()), a, np.int64), docs[ok], c[ok].astype(np.int64)], names=["a", "b", "c"])

    for batch in batches:
        a, na, ca, sa, part, parts = (batch.column(k).to_pylist() for k in range(6))
        for k in range(len(batch)):
            here = (a[k], part[k], na[k], ca[k], sa[k], parts[k])
            if here != key:
                yield from found()
                key, held = here, []
            held.append(tuple(batch.column(c)[k].values.to_numpy() for c in (6, 7, 8, 9)))
    yield from found()


def _across(placed: DataFrame, spark) -> DataFrame:
    """All candidates (a, b, c lists shared) of different components: a in the smaller one, b in the larger.

    In every list that two such documents share, the first is outside the
    largest component, so its postings count all of them.  Lists travel as blocks
    of postings, and a document's postings are counted together in a task, in as
    many parts as their number asks for.  Long lists travel often: the documents take
    turns, so that what is under way at once stays in proportion to the lists.
    """
    blocks = F.ceil(F.col("m") / BLOCK)
    postings = placed.groupBy("token", F.pmod(F.xxhash64("doc"), blocks).alias("block")).agg(
        F.collect_list(F.struct("doc", "n", "comp", "size")).alias("held"))
    postings = postings.select("token", *[F.col(f"held.{c}").alias(f"{c}s") for c in ("doc", "n", "comp", "size")])
    few = placed.filter((F.col("size") != F.col("top.size")) | (F.col("comp") != F.col("top.comp"))).select(
        "token", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("size").alias("sa"), "m")

    def counted(few: DataFrame) -> DataFrame:
        load = few.groupBy("a").agg(F.ceil(F.sum("m") / POSTINGS).cast("long").alias("parts"))
        asked = few.join(load, "a").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        rows = (asked.join(postings, "token").select("a", "na", "ca", "sa", "part", "parts", "docs", "ns", "comps", "sizes")
                .repartition(C.partitions(spark), "a", "part").sortWithinPartitions("a", "part", "na", "ca"))
        return rows.mapInArrow(lean(_count_lists), "a long, b long, c long")

    sent = few.agg(F.sum("m").alias("n")).first()["n"] or 0
    turns = -(-sent // max(SENT, AGAIN * placed.count()))
    if turns <= 1:
        return counted(few)
    out = None
    for k in range(turns):
        more = C.cut_lineage(counted(few.filter(F.pmod(F.xxhash64("a"), F.lit(turns)) == k)))
        C.let_go(spark)
        out = more if out is None else out.unionByName(more)
    return out


# ---- the join --------------------------------------------------------------------------------

def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    scanned = C.stored(rows.mapInArrow(lean(_digests), "doc long, n long, d1 long, d2 long"), "digests")
    sets = scanned.filter("n IS NOT NULL")
    frequent = (scanned.filter("n IS NULL").groupBy(F.col("doc").alias("hash")).agg(F.sum("d1").alias("count")))
    table = C.most_frequent(C.cut_lineage(frequent), "count", MAX_FREQUENT).toArrow()
    known = table.column("hash").to_numpy().view(np.uint64)
    by = np.argsort(known)
    order = spark.sparkContext.broadcast((known[by], table.column("count").to_numpy()[by]))

    alike = sets.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc").alias("rep"))
    named = C.cut_lineage(sets.join(alike, ["d1", "d2", "n"], "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep")))
    reps = named.filter("doc = rep").select("doc").distinct()

    buckets = max(64, 1 << (C.partitions(spark) - 1).bit_length())
    lists = (rows.mapInArrow(lean(_leading(order, buckets)), _LISTS).groupBy("bucket")
             .applyInArrow(lean_group(_shared), "token long, doc long, n long"))
    lists = C.stored(lists.join(reps, "doc", "left_semi"), "lists")
    members = lists.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1").select("token")
    lists = C.stored(lists.join(members, "token"), "lists")
    C.let_go(spark)

    # representatives that are texts of one document are held together
    found = None
    several = named.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b")
    if several.take(1):
        found = extend(None, named.join(several, "doc").select("a", F.col("rep").alias("b")))
    pairs = C.cut_lineage(_with_leaders(_placed(lists, found)))
    C.let_go(spark)
    found = extend(found, search(pairs, rows))
    C.let_go(spark)
    tried = pairs.unionByName(pairs.selectExpr("b AS a", "a AS b"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))
    rest = C.cut_lineage(_across(_placed(lists, found), spark).groupBy("a", "b").agg(F.max("c").alias("c"))
                         .join(tried, ["a", "b"], "left_anti").withColumn("rank", rank))
    C.let_go(spark)
    # the likeliest candidates first: they join most of what there is to join
    found = extend(found, search(rest.filter(F.col("rank") <= LIKELIEST).select("a", "b"), rows))
    C.let_go(spark)
    ends = [found.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in ("a", "b")]
    rest = (rest.filter(F.col("rank") > LIKELIEST).join(ends[0], "a", "left").join(ends[1], "b", "left")
            .filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    found = extend(found, search(C.cut_lineage(rest), rows))
    out = (named.join(found.withColumnRenamed("node", "rep"), "rep", "left")
           .select("doc", "n", F.coalesce("root", "rep").alias("component")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate component of every document."""
    return link_components(C.read(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stand for their component: the smallest doc_id of each, once.

    Of rows that share the doc_id kept, the smallest by its columns stays.
    Documents without words are linked with nothing and stay, and so do rows
    without a doc_id, which have no name to be kept by.
    """
    named = docs.filter(F.col(doc_id).isNotNull())
    again = C.cut_lineage(named.groupBy(doc_id).count().filter("count > 1").select(doc_id))
    gone = (link_components(named, doc_id, text).filter("doc_id <> component_id")
            .select(F.col("doc_id").alias(doc_id)).distinct())
    kept = docs.join(C.small_set(gone), doc_id, "left_anti").select(*docs.columns)
    if not again.take(1):
        return kept
    one = kept.join(again, doc_id, "left_semi").groupBy(doc_id).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.join(again, doc_id, "left_anti").select(*docs.columns).unionByName(one.select("row.*"))


OP8_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
           FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[s + 1:s + {SIZE}], ' ')) AS h FROM (
           SELECT doc_id, ws, unnest(range(greatest(1, len(ws) - {SIZE} + 1))) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id
          JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)
          SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(reach.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id
"""
