"""Benchmark decontamination by MinHash containment search.

Words are parted by white space and ASCII punctuation, A-Z in lower case.  An
item is found in a document that holds at least four fifths of the item's
distinct five-word shingles, however long the document is.

An item's MinHash sketch is its smallest shingle hashes.  The Jaccard
similarity of a short item and a long document is near zero whatever they
share, so equal signatures of both would find nothing; instead items are
partitioned by size, and an item with ``n`` shingles keeps the
``n - ceil(0.8 n) + 1`` smallest of them: a document that holds four fifths
of the shingles holds one of these, so probing a document's shingles against
the sketches of a partition loses no item.  Candidates are verified by exact
containment of the full sets.  Both steps happen where the document is read;
nothing of the documents is shuffled.

Partitions go to the tasks in passes of at most about ``PASS_HASHES`` hashes
(a partition beyond that is split by a hash of its items), one scan of the
documents per pass; so what is broadcast is bounded for every benchmark size.

Edge cases: null, empty and blank items are found nowhere and such documents
hold nothing; an item of under five words has its whole sequence as its one
shingle and is found in documents that consist of it; repeated rows on either
side are found once per row; null ids are carried; empty tables find nothing;
other columns of the documents are carried by ``remove_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortlens.llm import common as C
from cohortlens.llm import wordhash as W
from cohortlens.llm.worker import lean

SIZE = 5
NUM, DEN = 4, 5
PASS_HASHES = 2_000_000
_SIEVE = 1 << 22


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, w in W.batches(batch.column(1), lower=True, marks=True, max_bytes=W.SMALL_BYTES):
            values, offsets = W.shingle_sets(w, SIZE)
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.LargeListArray.from_arrays(
                offsets, values.view(np.int64)).cast(pa.list_(pa.int64()))], names=["item_id", "hashes"])


class Items:
    """The items of one pass: full sets, and the sketches of all size partitions as one probe table."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        held, owner = [], []
        partition = [len(s).bit_length() for s in sets]
        for size in sorted(set(partition)):
            for k in (k for k, p in enumerate(partition) if p == size):
                n = len(sets[k])
                sketch = sets[k][:n - -(-NUM * n // DEN) + 1]     # sets are sorted: the smallest hashes
                held.append(sketch)
                owner.append(np.full(len(sketch), k))
        values = np.concatenate([np.zeros(0, np.uint64), *held])
        by = np.argsort(values, kind="stable")
        self.values, self.owner = values[by], np.concatenate([np.zeros(0, np.int64), *owner])[by]
        self.sieve = np.zeros(_SIEVE, bool)
        self.sieve[(self.values % np.uint64(_SIEVE)).astype(np.int64)] = True

    def find(self, w: W.Words) -> list[tuple[int, int, int]]:
        """(text of the batch, item, shared shingles) of every contained item."""
        values, offsets = W.shingle_sets(w, SIZE)
        maybe = np.flatnonzero(self.sieve[(values % np.uint64(_SIEVE)).astype(np.int64)])
        lo = np.searchsorted(self.values, values[maybe])
        hi = np.searchsorted(self.values, values[maybe], side="right")
        maybe, lo, n = maybe[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else n
        text = np.repeat(np.searchsorted(offsets, maybe, side="right") - 1, n)
        out = []
        for t, k in np.unique(np.stack([text, self.owner[at]]), axis=1).T.tolist() if len(at) else ():
            doc, item = values[offsets[t]:offsets[t + 1]], self.sets[k]
            place = np.minimum(np.searchsorted(doc, item), len(doc) - 1)
            shared = int((doc[place] == item).sum())
            if shared * DEN >= NUM * len(item):
                out.append((t, k, shared))
        return out


def passes(spark, items: DataFrame, item_id: str = "item_id", text: str = "text", pass_hashes: int = PASS_HASHES):
    """Broadcasts of the items, each of bounded size."""
    kind = items.schema[item_id].dataType.simpleString()
    sets = C.cut_lineage(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
                         .mapInArrow(lean(_item_sets), f"item_id {kind}, hashes array<long>").filter("size(hashes) > 0")
                         .withColumn("partition", F.length(F.bin(F.size("hashes")))))
    load = {r["partition"]: r["n"] for r in sets.groupBy("partition").agg(F.sum(F.size("hashes")).alias("n")).collect()}
    groups, room = [], 0
    for p, n in sorted(load.items()):
        parts = -(-n // pass_hashes)
        if parts > 1:
            groups += [([p], parts, k) for k in range(parts)]
            room = 0
        elif room < n:
            groups.append(([p], 1, 0))
            room = pass_hashes - n
        else:
            groups[-1][0].append(p)
            room -= n
    for wanted, parts, k in groups:
        chosen = sets.filter(F.col("partition").isin(wanted) & (F.pmod(F.xxhash64("item_id", "hashes"), F.lit(parts)) == k))
        table = chosen.select("item_id", "hashes").toArrow().combine_chunks()
        yield spark.sparkContext.broadcast(Items(
            table.column("item_id").to_pylist(),
            [np.sort(h.values.to_numpy().view(np.uint64)) for h in table.column("hashes")]))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, n_shingles of the item, n_shared of them."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    dk, ik = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {dk}, item_id {ik}, n_shingles long, n_shared long"
    id_type = to_arrow_type(items.schema["item_id"].dataType)
    found = None

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, _, w in W.batches(batch.column(1), lower=True, marks=True, max_bytes=W.SMALL_BYTES):
                    if hits := held.value.find(w):
                        t, k, n = zip(*hits, strict=True)
                        yield pa.record_batch([
                            batch.column(0).take(pa.array([i + x for x in t])),
                            pa.array([held.value.ids[x] for x in k], id_type),
                            pa.array([len(held.value.sets[x]) for x in k], pa.int64()), pa.array(n, pa.int64())],
                            names=["doc_id", "item_id", "n_shingles", "n_shared"])
        return run

    for held in passes(spark, items):
        part = rows.mapInArrow(lean(search(held)), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, all their columns untouched and none shuffled."""
    at = docs.columns.index(text)

    def clean(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for i, _, w in W.batches(batch.column(at), lower=True, marks=True, max_bytes=W.SMALL_BYTES):
                    for t, _, _ in held.value.find(w):
                        keep[i + t] = False
                yield batch.filter(pa.array(keep))
        return run

    for held in passes(docs.sparkSession, items):
        docs = docs.mapInArrow(lean(clean(held)), docs.schema)
    return docs


def op7_decontam(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the items and shared shingles."""
    return contaminated(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


_WORDS_SQL = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+'), lambda x: x <> '')"""
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents), b AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, len(ws) < {SIZE} AS short, array_to_string(ws[s + 1:s + {SIZE}], ' ') AS g FROM (
    SELECT doc_id, ws, unnest(range(greatest(1, len(ws) - {SIZE} + 1))) AS s FROM d WHERE len(ws) > 0)),
bs AS (SELECT DISTINCT item_id, len(ws) < {SIZE} AS short, array_to_string(ws[s + 1:s + {SIZE}], ' ') AS g FROM (
    SELECT item_id, ws, unnest(range(greatest(1, len(ws) - {SIZE} + 1))) AS s FROM b WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared
FROM ds JOIN bs USING (g, short) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) * {DEN} >= {NUM} * n
"""
