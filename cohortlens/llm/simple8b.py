"""Token ids in Simple-8b words, written and read as files.

A 64-bit word is a 4-bit selector (high bits) and 60 bits that hold ``n``
values of ``60 // n`` bits each, the first in the lowest bits.  Selector 15 is
an escape: its payload is an index into the frame's list of raw 64-bit values.
Ids are cut into blocks of ``BLOCK`` values; every block starts a new word and
its word offset is stored, so blocks decode on their own and all words of one
selector decode in one vector operation.

A file row is a *frame*: whole documents, about ``FRAME`` ids or one longer
document.  Frames are written by Spark as Parquet rows (so commits and retries
are Spark's) into files that are ranges of ascending doc_id; ``part`` and
``start`` place a frame, and the sum of the ids of earlier parts makes it the
place in the whole corpus.

Edge cases: null and empty texts hold the end id alone; null ids come first;
repeated rows are documents of their own, next to each other; an empty table
writes files without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm import common as C
from cohortlens.llm import worker
from cohortlens.llm.worker import lean

END_ID = 2
BLOCK = 1024
FRAME = 1 << 18
#: words that a worker keeps: with those of one more batch just under two thirds of 2 ** 20, where a dict doubles
CACHE_WORDS = 600_000
#: bytes of the Arrow batches that bring texts to the workers; a longer text comes alone
BATCH_BYTES = 1 << 20
#: values per word, by selector
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = 60 // COUNTS
ESCAPE = 15
_U = np.uint64
_LIMITS = (_U(1) << BITS.astype(_U))
_WIDTH = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=_U), side="right").astype(np.int8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block, escaped values) of non-negative 64-bit integers."""
    v = ids.astype(_U)
    n = len(v)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.uint32), np.zeros(0, _U)
    # width: how many of the slot sizes are too narrow for a value
    if v.max() < len(_WIDTH):
        width = _WIDTH[v.astype(np.intp)]
    else:
        width = np.searchsorted(_LIMITS, v, side="right").astype(np.int8)
    left = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n))    # the rest of the block bounds a word too
    take, sel = np.ones(n, np.int8), np.where(width == len(BITS), ESCAPE, len(BITS) - 1).astype(np.int8)
    for s in range(len(BITS) - 2, -1, -1):
        wide = np.flatnonzero(width > s)
        if n - len(wide) < COUNTS[s]:
            continue
        edge = np.concatenate(([-1], wide, [n]))
        spare = np.diff(edge) - COUNTS[s]       # starts that have COUNTS[s] narrow values, in each run
        run = np.flatnonzero(spare > 0)
        if len(run):
            spare = spare[run]
            first = np.cumsum(spare) - spare
            fits = np.repeat(edge[run] + 1 - first, spare) + np.arange(int(spare.sum()))
            fits = fits[left[fits] >= COUNTS[s]]
            take[fits], sel[fits] = COUNTS[s], s
    # all blocks are walked side by side, a word at a time
    at, here = [], np.arange(0, n, BLOCK)
    stop = np.minimum(here + BLOCK, n)
    while len(here):
        at.append(here)
        here = here + take[here]
        live = here < stop
        here, stop = here[live], stop[live]
    at = np.sort(np.concatenate(at))
    sel = sel[at].astype(np.int64)
    words = sel.astype(_U) << _U(60)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(sel == s)
        for k in range(COUNTS[s] if len(mine) else 0):
            words[mine] |= v[at[mine] + k] << _U(k * BITS[s])
    mine = np.flatnonzero(sel == ESCAPE)
    words[mine] |= np.arange(len(mine), dtype=_U)
    return words, np.searchsorted(at, np.arange(0, n, BLOCK)).astype(np.uint32), v[at[mine]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of consecutive words (all of a frame, or from one block's offset to another's)."""
    sel = (words >> _U(60)).astype(np.int64)
    load = words & _U((1 << 60) - 1)
    counts = np.where(sel == ESCAPE, 1, COUNTS[np.minimum(sel, len(COUNTS) - 1)])
    to = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), _U)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            slot = np.arange(COUNTS[s])
            mask = _U((1 << int(BITS[s])) - 1)
            out[to[mine][:, None] + slot] = (load[mine][:, None] >> (slot * BITS[s]).astype(_U)) & mask
    mine = np.flatnonzero(sel == ESCAPE)
    out[to[mine]] = escapes[load[mine].astype(np.int64)]
    return out


class _Known(dict):
    """Word -> number; a new word gets the next number and is remembered for ``learn``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


_MARK, _SPECIAL = b"<|endoftext|>", b"<|"
#: ASCII punctuation but for the apostrophe, which may begin a piece with the letters after it
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_JOIN = 200


def _spread(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every stretch, one stretch after the other."""
    ends = np.cumsum(lens)
    return np.repeat(start - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordTokenizer:
    """Ids of whole texts by a tokenizer that lowers case and never joins what ASCII white space parts.

    Words are looked up; new ones go through the tokenizers library, many at a
    time, joined by a special token, which parts them for the tokenizer (words that may
    hold one go alone).  Punctuation after an ASCII letter is a piece of its own for the
    tokenizer, so it is parted from a new word before, which leaves fewer and plainer words.  The table is bounded: past ``limit`` words those
    that no later batch has met again are forgotten, and of the others all but the earliest two thirds of ``limit``.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.limit = Tokenizer.from_str(json.dumps(spec)), limit
        # to words of lower-case ASCII letters the normaliser and the pattern do nothing
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None}))
        self.mark_id = self.tokenizer.token_to_id(_MARK.decode())
        self.known = _Known()
        self.flat, self.offset = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.again = np.zeros(0, bool)      # words that a later batch has met again

    def forget(self) -> None:
        if len(self.known) > self.limit:
            kept = np.flatnonzero(self.again)[:self.limit * 2 // 3]
            words = list(compress(self.known, self.again))[:len(kept)]
            self.known = _Known()
            self.known.update(zip(words, range(len(words)), strict=True))
            start, lens = self.offset[kept], np.diff(self.offset)[kept]
            self.flat = self.flat[_spread(start, lens)]
            self.offset = np.concatenate((np.zeros(1, np.int64), np.cumsum(lens)))
            self.again = np.ones(len(kept), bool)

    def learn(self) -> None:
        new, self.known.new = self.known.new, []
        learned, pieces, first, second = len(self.offset) - 1, {}, [], []
        for w in new:
            base = w.rstrip(_TAIL)
            tail = w[len(base):]
            if tail and base and 97 <= base[-1] <= 122 and _SPECIAL not in w:
                first.append(pieces.setdefault(base, len(pieces)))
                second.append(pieces.setdefault(tail, len(pieces)))
            else:
                first.append(pieces.setdefault(w, len(pieces)))
                second.append(-1)
        names, place = list(pieces), np.array([self.known.get(w, learned) for w in pieces])
        old, fresh = np.flatnonzero(place < learned), np.flatnonzero(place >= learned)
        flat, lens = self.encode([names[k] for k in fresh])
        # the pieces that the table has already, behind the fresh ones
        have = self.offset[place[old]]
        n_old = self.offset[place[old] + 1] - have
        flat = np.concatenate([flat, self.flat[_spread(have, n_old)]])
        start = np.empty(len(names), np.int64)
        size = np.empty(len(names), np.int64)
        size[fresh], size[old] = lens, n_old
        lens = np.concatenate([lens, n_old])
        start[np.concatenate([fresh, old])] = np.cumsum(lens) - lens
        first, second = np.array(first), np.array(second)
        both = np.stack([first, second], axis=1).ravel()
        both = both[both >= 0]
        ends = np.cumsum(size[first] + np.where(second >= 0, size[second], 0))
        self.offset = np.concatenate([self.offset, self.offset[-1] + ends])
        self.flat = np.concatenate([self.flat, flat[_spread(start[both], size[both])]])

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each) by the library."""
        kinds: tuple[list, list, list] = ([], [], [])
        for k, w in enumerate(words):
            kinds[0 if w.isalpha() and w.islower() else 2 if _SPECIAL in w else 1].append(k)
        flat, lens = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for mine, tokenizer, size in zip(kinds, (self.plain, self.tokenizer, self.tokenizer), (_JOIN, _JOIN, 1), strict=True):
            texts = [_MARK.join([words[k] for k in mine[a:a + size]]).decode() for a in range(0, len(mine), size)]
            for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                ids = np.array(e.ids, np.int32)
                if size == 1:
                    lens.append(np.array([len(ids)]))
                else:
                    part = np.concatenate(([-1], np.flatnonzero(ids == self.mark_id), [len(ids)]))
                    lens.append(np.diff(part) - 1)
                    ids = ids[ids != self.mark_id]
                flat.append(ids)
        # back to the order of the words
        flat, lens = np.concatenate(flat), np.concatenate(lens)
        order = np.argsort(np.concatenate(kinds).astype(np.int64))
        start, lens = (np.cumsum(lens) - lens)[order], lens[order]
        return flat[_spread(start, lens)], lens

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); without end ids."""
        self.forget()
        get, index, n_words = self.known.__getitem__, [], []
        for t in texts:
            if t and _SPECIAL.decode() in t:    # the case of a special token counts
                ws = [w if _SPECIAL in w else w.lower() for w in t.encode().split()]
            else:
                ws = t.encode().lower().split() if t else []
            index.append(np.fromiter(map(get, ws), np.int64, len(ws)))
            n_words.append(len(ws))
        at = np.concatenate([np.zeros(0, np.int64), *index])
        self.again[at[at < len(self.again)]] = True
        if self.known.new:
            self.learn()
            self.again = np.concatenate([self.again, np.zeros(len(self.known) - len(self.again), bool)])
        start = self.offset[at]
        lens = self.offset[at + 1] - start
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(lens)))
        ids = self.flat[_spread(start, lens)]
        return ids, np.diff(total[np.concatenate(([0], np.cumsum(n_words))).astype(np.int64)])


TOKENS = "tokens"     # kind of task


def tokenizer_of(path: str) -> WordTokenizer:
    """The worker process's tokenizer: what it has learned serves its later tasks of this kind too."""
    held = worker.kept.setdefault(TOKENS, {})
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


_FRAME = "part int, start long, doc_id array<long>, n_tokens array<long>, words binary, blocks binary, escapes binary"


def _frames(tokenizer: str, end_id: int):
    def flush(part: int, start: int, ids: list, docs: list, counts: list) -> pa.RecordBatch:
        words, blocks, escapes = encode(np.concatenate(ids))
        return pa.record_batch([
            pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
            pa.array([counts], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary())
                                                        for x in (words, blocks, escapes)]],
            names=["part", "start", "doc_id", "n_tokens", "words", "blocks", "escapes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        to_ids = tokenizer_of(tokenizer)
        ids, docs, counts, size = [], [], [], 0
        for batch in batches:
            doc_ids, lens = batch.column(0).to_pylist(), pa.compute.binary_length(batch.column(1)).to_pylist()
            i = 0
            while i < len(doc_ids):
                j, room = i, BATCH_BYTES
                while j < len(doc_ids) and (j == i or room > 0):
                    room -= (lens[j] or 0)
                    j += 1
                flat, n = to_ids(batch.column(1).slice(i, j - i).to_pylist())
                at = 0
                for d, k in zip(doc_ids[i:j], n.tolist(), strict=True):
                    ids += [flat[at:at + k], np.array([end_id])]
                    at += k
                    docs.append(d)
                    counts.append(k + 1)
                    size += k + 1
                    if size >= FRAME:
                        yield flush(part, start, ids, docs, counts)
                        start += size
                        ids, docs, counts, size = [], [], [], 0
                i = j
        if docs:
            yield flush(part, start, ids, docs, counts)
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                 end_id: int = END_ID) -> None:
    """Encode whole texts in ascending doc_id order and write them to a new folder that all executors share."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    rows = (rows.withColumn("tie", tie).repartitionByRange(C.partitions(docs.sparkSession), "doc_id", "tie")
            .sortWithinPartitions("doc_id", "tie").drop("tie"))
    # Spark's own batches are 10,000 rows of up to 64 MB, for which the JVM keeps memory outside its heap in every task thread
    with C.setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b"):
        rows.mapInArrow(lean(_frames(tokenizer, end_id), TOKENS), _FRAME).write.parquet(path)


def _unpack(value: Callable[[np.ndarray], object], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = decode(np.frombuffer(row["words"], _U), np.frombuffer(row["escapes"], _U))
                ends = np.cumsum(row["n_tokens"])
                starts = ends - row["n_tokens"]
                yield pa.record_batch([
                    pa.array([row["part"]] * len(ends), pa.int32()), pa.array(row["doc_id"], pa.int64()),
                    pa.array(starts + row["start"], pa.int64()), pa.array(row["n_tokens"], pa.int64()),
                    pa.array([value(ids[a:b]) for a, b in zip(starts, ends, strict=True)], kind)],
                    names=["part", "doc_id", "start", "n_tokens", "value"])
    return run


def read_tokens(spark: SparkSession, path: str, value: Callable[[np.ndarray], object] = lambda ids: ids.astype(np.int64),
                kind: pa.DataType | None = None, sql_type: str = "array<long>") -> DataFrame:
    """(doc_id, start, n_tokens, value): by default value is the document's ids, its end id included.

    The table of parts, one row per file, places each file after those before it.
    """
    frames = spark.read.schema(_FRAME).parquet(path)
    n = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = frames.groupBy("part").agg(F.sum(n).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    got = frames.mapInArrow(lean(_unpack(value, kind or pa.list_(pa.int64())), TOKENS),
                            f"part int, doc_id long, start long, n_tokens long, value {sql_type}")
    return got.join(parts, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"),
                                          "n_tokens", "value")


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' ids to the shared folder and return what the files hold, one row per document."""
    spark = docs.sparkSession
    path = C.shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path, ids_crc32, pa.int64(), "long").withColumnRenamed("value", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op4_simple8b(spark, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back: place, length and digest of each one's ids."""
    return token_table(C.read(spark, sf_dir, "documents"), default_tokenizer())
