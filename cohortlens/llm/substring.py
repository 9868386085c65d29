"""Removal of repeated passages: every window of ``width`` words that also starts earlier.

1. Tasks hash all windows of their texts (Rabin-Karp over word hashes).  A
   chunk of windows is combined before the shuffle: only the earliest window of
   each hash leaves the chunk, later ones are known to be repeats already, so a
   passage held by a third of all documents sends one row per chunk.
2. Hash ranges ("buckets") are shuffled as packed columns and counted: in a
   bucket, every occurrence but the smallest (doc_id, start) is a repeat.  The
   number of buckets follows the size of all texts, so a bucket's windows are
   bounded whatever the partitions: copies have been combined before.
3. Repeats go back to their documents, where overlapping windows merge into
   maximal intervals of words, which are cut out of the whole text.  Documents
   are dealt into ``shares`` for this, again by the size of all texts.

A window's fingerprint has 64 bits (8 to 10 of them in its bucket number): two
different windows among n are taken for equal with a chance of about
n * n / 2**65, some 1e-3 for 1e8 windows of 20 words.

Edge cases: null, empty and short texts have no window and stay whole (a null
text as an empty one); a null doc_id counts as the smallest and comes back
null; rows with the same doc_id and text are one document, judged once and
returned as often as they occur; rows with the same doc_id and other texts are
documents of their own, in the order of their texts' hashes; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common as C
from cohortlens.llm import packed
from cohortlens.llm import wordhash as W

WIDTH = 20
CHUNK_WINDOWS = 400_000         # windows combined at a time before the shuffle
BUCKET_WINDOWS = 400_000        # windows counted at a time, about
SHARE_BYTES = 8 << 20           # text cut at a time, about, unless one text is longer
NO_ID = -(2 ** 63)


def _send_repeats(where: np.ndarray, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray, shares: int) -> list[tuple]:
    """Packed (bucket, kind, hash, doc, tie, pos) rows for repeats, dealt out by their document."""
    to = packed.spark_xxhash64(doc[where]) % shares
    order = np.lexsort((pos[where], tie[where], doc[where], to))
    where, to = where[order], to[order]
    cuts = np.flatnonzero(np.diff(to, prepend=-1))
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(to)], strict=False):
        part = where[a:b]
        out.append((int(to[a]), True, b"", packed.pack(doc[part], True), packed.pack(tie[part]),
                    packed.pack(pos[part])))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    types = (pa.int64(), pa.bool_(), *[pa.binary()] * 4)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)],
                           names=["bucket", "repeat", "hash", "doc", "tie", "pos"])


SENT = "bucket long, repeat boolean, hash binary, doc binary, tie binary, pos binary"


def _chunk(parts: list[tuple], buckets: int, shares: int) -> Iterator[pa.RecordBatch]:
    """Combine a chunk: the earliest window of each hash by bucket, the others as repeats by document."""
    hashes, doc, tie, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    rank = np.lexsort((pos, tie, doc)) if (np.diff(doc) < 0).any() or tie.any() else None
    if rank is not None:
        hashes, doc, tie, pos = hashes[rank], doc[rank], tie[rank], pos[rank]
    order = np.argsort(hashes)
    sorted_hash = hashes[order]
    run = np.flatnonzero(np.concatenate(([True], sorted_hash[1:] != sorted_hash[:-1])))
    first = np.minimum.reduceat(order, run)
    lead = np.repeat(first, np.diff(np.append(run, len(order))))
    # the same place in a repeated row is not a repeat
    late = (doc[order] != doc[lead]) | (tie[order] != tie[lead]) | (pos[order] != pos[lead])
    if late.any():
        yield _batch(_send_repeats(order[late], doc, tie, pos, shares))
    keys = sorted_hash[run]
    shift = np.uint64(64 - buckets.bit_length() + 1)
    at = np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64))
    rows = [(b, False, packed.pack(keys[at[b]:at[b + 1]], True), packed.pack(doc[x]), packed.pack(tie[x]),
             packed.pack(pos[x])) for b in range(buckets) if len(x := first[at[b]:at[b + 1]])]
    yield _batch(rows)


def _hash_windows(width: int, buckets: int, shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, w in W.batches(batch.column(2)):
                h = W.windows(w.hash, width)
                owner = w.owner()[:len(h)]
                inside = np.arange(len(h)) + width <= w.first[owner + 1] if len(h) else np.zeros(0, bool)
                if not inside.any():
                    continue
                owner = owner[inside]
                start = np.flatnonzero(inside) - w.first[owner]
                parts.append((h[inside], ids[i + owner], ties[i + owner], start))
                size += len(owner)
                if size >= CHUNK_WINDOWS:
                    yield from _chunk(parts, buckets, shares)
                    parts, size = [], 0
        if parts:
            yield from _chunk(parts, buckets, shares)
    return run


def _count_bucket(shares: int):
    def run(table: pa.Table) -> pa.Table:
        seen = table.filter(table.column("repeat"))     # known repeats of these documents pass through
        table = table.filter(pc.invert(table.column("repeat")))
        if not len(table):
            return seen
        cols = [[], [], [], []]
        for h, d, t, p in zip(*(table.column(c).to_pylist() for c in ("hash", "doc", "tie", "pos")), strict=True):
            for out, x in zip(cols, (packed.unpack(h, True), packed.unpack(d), packed.unpack(t), packed.unpack(p)),
                              strict=True):
                out.append(x)
        h, doc, tie, pos = (np.concatenate(x) for x in cols)
        order = np.argsort(h)
        h = h[order]
        many = np.zeros(len(h), bool)
        many[1:] = h[1:] == h[:-1]
        many[:-1] |= many[1:]
        order, h = order[many], h[many]
        doc, tie, pos = doc[order], tie[order], pos[order]
        order = np.lexsort((pos, tie, doc, h))
        h, doc, tie, pos = h[order], doc[order], tie[order], pos[order]
        run_at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        lead = np.repeat(run_at, np.diff(np.append(run_at, len(h))))
        late = np.flatnonzero((doc != doc[lead]) | (tie != tie[lead]) | (pos != pos[lead]))
        made = pa.Table.from_batches([_batch(_send_repeats(late, doc, tie, pos, shares))])
        return pa.concat_tables([made, seen.cast(made.schema)])
    return run


def _cut(width: int):
    """Cogroup of one share of the documents with their repeats: removed intervals and the text that is left."""
    def run(repeats: pa.Table, docs: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)] * 3]
        for d, t, p in zip(*(repeats.column(c).to_pylist() for c in ("doc", "tie", "pos")), strict=True):
            found.append([packed.unpack(d, True), packed.unpack(t), packed.unpack(p)])
        doc, tie, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((pos, tie, doc))
        doc, tie, pos = doc[order], tie[order], pos[order]
        ids, ties = docs.column("id").to_numpy(), docs.column("tie").to_numpy()
        lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
        n_words, starts, ends, kept = [], [], [], []
        for k, text in enumerate(docs.column("text").to_pylist()):
            ws = (text or "").encode().split()
            p = pos[lo[k]:hi[k]]
            if len(p):
                t = tie[lo[k]:hi[k]]
                p = p[np.searchsorted(t, ties[k]):np.searchsorted(t, ties[k], side="right")]
            n_words.append(len(ws))
            if len(p):
                p = np.unique(p)
                gap = np.flatnonzero(np.diff(p) > width)
                s, e = p[np.append(0, gap + 1)], p[np.append(gap, len(p) - 1)] + width
                starts.append(s.tolist())
                ends.append(e.tolist())
                left, at = [], 0
                for a, b in zip(starts[-1], ends[-1], strict=True):
                    left += ws[at:a]
                    at = b
                ws = left + ws[at:]
            else:
                starts.append([])
                ends.append([])
            kept.append(b" ".join(ws).decode())
        return pa.table({"id": docs.column("id"), "n_words": pa.array(n_words, pa.int64()),
                         "starts": pa.array(starts, pa.list_(pa.int64())),
                         "ends": pa.array(ends, pa.list_(pa.int64())), "kept_text": pa.array(kept, pa.string())})
    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, removed (array of word intervals [start, end)), kept_text."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # a window is a word; words and the white space after them have some six bytes
    buckets = max(256, 1 << (size // (6 * BUCKET_WINDOWS)).bit_length())
    shares = max(64, size // SHARE_BYTES)
    again = docs.groupBy(doc_id).count().filter("count > 1").limit(1).count()
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
                       (F.xxhash64(text) if again else F.lit(0).cast("long")).alias("tie"), F.col(text).alias("text"))
    sent = rows.mapInArrow(_hash_windows(width, buckets, shares), SENT)
    repeats = sent.groupBy("bucket").applyInArrow(_count_bucket(shares), SENT)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("long"))
    cut = repeats.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(
        _cut(width), "id long, n_words long, starts array<long>, ends array<long>, kept_text string")
    return cut.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words",
                      F.arrays_zip("starts", "ends").alias("removed"), "kept_text")


def op10_substring(spark, sf_dir: str) -> DataFrame:
    """Per document: its words, how many of them were removed, and the digest of those left."""
    cut = remove_repeats(C.read(spark, sf_dir, "documents"))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["ends"] - x["starts"])
    return cut.select("doc_id", "n_words", n.alias("n_removed"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                                      lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1:s + {WIDTH}], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(len(ws) - {WIDTH} + 1)) AS s FROM w WHERE len(ws) >= {WIDTH})),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM win)
         WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + {WIDTH})) AS p FROM late)),
per AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
marked AS (SELECT w.doc_id, ws, coalesce(n, 0) AS n,
                  CASE WHEN n IS NULL THEN ws ELSE (
                      SELECT list(x.word ORDER BY x.i) FROM (SELECT unnest(ws) AS word, unnest(range(len(ws))) AS i) x
                      WHERE x.i NOT IN (SELECT unnest(ps))) END AS kept
           FROM w LEFT JOIN per USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, n::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM marked
"""
