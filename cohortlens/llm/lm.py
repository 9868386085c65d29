"""Log-likelihood of whole documents under a gated recurrent language model.

Words are lower-cased (A-Z); a document is its words and one end token.

* **Counts** of every training token are gathered over all training documents
  (combined per task before the shuffle): c, N and V of the base score, the
  model's vocabulary (the ``VOCAB`` most frequent tokens; all others share one
  symbol) and the probability of such a word given that symbol.
* **Model**: a GRU whose output is factored into classes of words of about
  equal total count, ``p(w) = p(class | h) p(w | class, h)``, so a step costs two
  small softmaxes.  Output biases start at the log counts over all documents.
* **Training**: texts become symbols once; documents are dealt by a hash of doc_id
  and text into shares of about ``SHARE_TOKENS`` tokens and sorted by it, so shares
  and their order are the same for every file layout, partition count and retry.
  A document is cut into segments of ``SEGMENT`` windows of ``STEPS`` tokens.  Each
  segment is learned from once, in one of the ``ROUNDS`` (dealt out in turn, from the
  hash on), by truncated backpropagation in numpy: the state goes on from window to
  window, gradients stop at a window's start.  Every share trains a copy of the model
  from the same start; the copies' average, weighted by tokens, starts the next round.
* **Scoring**: the state is carried from window to window through the whole text,
  many documents side by side; the longest come first, so lanes end close together.

The probability is proper: the shared symbol's mass is split over its words and
one unseen word by (c + 1) / (N_rest + V_rest + 1).  The counts of the ``HEAD``
most frequent tokens are broadcast, a bounded table; rarer words are joined with
their counts through a shuffle, as that table grows with the corpus (such words
have no hot keys).

Edge cases: null, empty and blank texts are one end token; a null doc_id is
trained on; repeated rows count and are scored as often as they occur; without
training tokens N and V are 0 and the model is uniform; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common as C

FOLDS, FOLD = 7, 2
VOCAB = 4_000       # tokens with a symbol of their own; a parameter of the model, not of the counts
CLASSES = 40
HEAD = 250_000      # tokens whose counts are broadcast; the others are joined
HIDDEN = 16
STEPS = 16          # tokens per window of truncated backpropagation
SEGMENT = 4         # windows through which training carries the state
BATCH = 512         # segments or documents side by side
ROUNDS = 2          # each learns from its share of the segments, together from all
RATE = 0.01
SHARE_TOKENS = 2_000_000
END = b"\n"         # no word contains it
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
COUNT_FLUSH = 200_000


def words_of(text: str | None) -> list[bytes]:
    """Words and the end token."""
    ws = text.encode().translate(_LOWER).split() if text else []
    ws.append(END)
    return ws


# ---- counts ----------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())],
                               names=["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            held.update(words_of(text.as_py()))
            if len(held) >= COUNT_FLUSH:
                yield flush()
                held.clear()
    if held:
        yield flush()


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all documents."""
    return docs.select(text).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


# ---- model -----------------------------------------------------------------------------------

class Vocabulary:
    """Symbols in classes, by falling count, and the known counts.

    ``head``: (word, count) by falling count; the first ``size`` have a symbol of
    their own, symbol ``rest`` stands for all other words.
    """

    def __init__(self, head: list[tuple[bytes, int]], n: int, v: int, size: int = VOCAB, classes: int = CLASSES):
        own = head[:size]
        self.rest_n, self.rest_v = n - sum(c for _, c in own), v - len(own)
        self.n, self.v = n, v
        entries = sorted([(max(self.rest_n, 1), -1), *((c, k) for k, (_, c) in enumerate(own))], key=lambda x: (-x[0], x[1]))
        count = np.array([c for c, _ in entries], float)
        share = np.cumsum(count) / count.sum()
        group = np.minimum((share - count / count.sum() / 2) * classes, classes - 1).astype(int)
        _, self.group = np.unique(group, return_inverse=True)
        self.start = np.searchsorted(self.group, np.arange(self.group[-1] + 2))
        self.prior = count
        symbol = {k: at for at, (_, k) in enumerate(entries)}
        self.rest = symbol[-1]
        self.index = {w: k for k, (w, _) in enumerate(head)}
        # by number of a head word; the last entry is for all words outside
        self.symbol = np.array([symbol.get(k, self.rest) for k in range(len(head))] + [self.rest], np.int32)
        known = np.array([c for _, c in head] + [0], float)
        self.base = np.log10((known + 1) / (n + v + 1))
        self.inner = np.where(self.symbol == self.rest, np.log10((known + 1) / (self.rest_n + self.rest_v + 1)), 0)
        self.base[-1] = self.inner[-1] = 0      # added from the joined counts
        self.end = int(self.symbol[self.index.get(END, -1)])

    def __len__(self) -> int:
        return len(self.group)

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        """Head numbers of words, -1 for those outside."""
        return np.fromiter(map(self.index.get, ws, repeat(-1)), np.int64, len(ws))


def initial(vocab: Vocabulary, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    n, k = len(vocab), int(vocab.group[-1]) + 1
    per_class = np.bincount(vocab.group, vocab.prior)
    scale = 1 / np.sqrt(hidden)
    p = {"in": rng.normal(0, 0.3, (n, 3 * hidden)), "zr": rng.normal(0, scale, (hidden, 2 * hidden)),
         "h": rng.normal(0, scale, (hidden, hidden)), "b": np.zeros(3 * hidden),
         "class": np.zeros((hidden, k)), "class_b": np.log(per_class),
         "word": np.zeros((n, hidden)), "word_b": np.log(vocab.prior)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _gates(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of both gates (2, symbols, hidden) and of the new state, biases included, and the gates' weights.

    Those of the gates are halved: a sigmoid is 0.5 + 0.5 tanh(x / 2).
    """
    m = p["h"].shape[0]
    inputs = p["in"] + p["b"]
    gates = np.stack([inputs[:, :m], inputs[:, m:2 * m]])
    gates *= 0.5
    return gates, np.ascontiguousarray(inputs[:, 2 * m:]), 0.5 * np.stack([p["zr"][:, :m], p["zr"][:, m:]])


def _fed(weights: tuple, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What symbols (steps, batch) give to the gates (2, steps, batch, hidden) and to the new state."""
    xs = xs.astype(np.intp)
    return np.take(weights[0], xs, axis=1), np.take(weights[1], xs, axis=0)


def _step(weights: tuple, state: np.ndarray, gates: np.ndarray, new: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    zr = np.matmul(h, weights[2])
    zr += gates
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    z, r = zr
    rh = r * h
    c = rh @ state
    c += new
    np.tanh(c, out=c)
    out = c - h
    out *= z
    out += h
    return out, (h, z, r, rh, c)


def step(p: dict, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One GRU step: input symbols x (batch), state h (batch, hidden)."""
    weights = _gates(p)
    return _step(weights, p["h"], *_fed(weights, x), h)


class _Softmaxes:
    """The softmaxes of classes and of the words in each class, for one state of the weights.

    A state's entries lie within -1 and 1 or, where a caller gives others, within
    ``most``: no logit exceeds its bias plus ``most`` times its weights' sizes.  The
    largest such bound of a softmax is taken off its biases, so no exponential overflows;
    a row whose sum is too small for that is done again with its own largest logit.
    """

    def __init__(self, p: dict, vocab: Vocabulary, most: float = 1.0):
        self.start = vocab.start
        self.classes = self.made(p["class"].T, p["class_b"], most, np.zeros(1, int))
        self.words = self.made(p["word"], p["word_b"], most, vocab.start[:-1])

    @staticmethod
    def made(w: np.ndarray, b: np.ndarray, most: float, first: np.ndarray) -> np.ndarray:
        """Rows (weights, bias less the softmax's bound) of the softmaxes that begin at ``first``."""
        bound = np.maximum.reduceat(b + most * np.abs(w).sum(1), first)
        shifted = b - np.repeat(bound, np.diff(np.append(first, len(b))))
        return np.concatenate([w, shifted[:, None].astype(w.dtype)], 1)


def _exponentials(h1: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials of the logits, their sums, logarithms of the sums) by row; h1: states and a last column of ones."""
    e = h1 @ w1.T
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], e.dtype)
    if total.min() >= 1e-25:
        return e, total, np.log(total)
    low = np.flatnonzero(total < 1e-25)
    again = h1[low] @ w1.T
    top = again.max(1)
    e[low] = np.exp(again - top[:, None])
    total[low] = e[low].sum(1)
    log = np.log(total)
    log[low] += top
    return e, total, log


def output(p: dict, vocab: Vocabulary, h: np.ndarray, y: np.ndarray, grad: dict | None = None, soft: _Softmaxes | None = None):
    """Log probabilities of symbols y after states h; with ``grad``, also adds gradients of -sum and returns that of h."""
    if not len(y):
        return np.zeros(0, h.dtype), np.zeros_like(h)
    if soft is None:
        soft = _Softmaxes(p, vocab, max(1.0, float(np.abs(h).max())))
    m = h.shape[1]
    order = _sorted(y, vocab)       # symbols ascend by class
    ys = np.take(y, order)
    cuts = np.searchsorted(ys, soft.start)
    group, row = np.take(vocab.group, ys), np.arange(len(y))
    h1 = np.empty((len(y), m + 1), h.dtype)
    h1[:, :m], h1[:, m] = np.take(h, order, axis=0), 1

    def add(e: np.ndarray, total: np.ndarray, at: slice, mine: np.ndarray, w1: np.ndarray, into: np.ndarray, bias: np.ndarray):
        """Gradients of a softmax's weights; that of the states."""
        e[row[:len(e)], mine] -= total      # of the logits, times the sums: exponentials, less the sum at y
        one = 1 / total[:, None]
        each = e.T @ (h1[at] * one)
        into += each[:, :m]
        bias += each[:, m]
        back = e @ w1[:, :m]
        back *= one
        return back

    e, total, log = _exponentials(h1, soft.classes)
    found = np.einsum("ij,ij->i", h1, np.take(soft.classes, group, axis=0)) - log
    if grad is not None:
        dh = add(e, total, slice(None), group, soft.classes, grad["class"].T, grad["class_b"])
    own = np.einsum("ij,ij->i", h1, np.take(soft.words, ys, axis=0))
    for g in range(len(soft.start) - 1):
        at = slice(cuts[g], cuts[g + 1])
        a, b = soft.start[g], soft.start[g + 1]
        if at.start == at.stop or b - a == 1:
            continue
        e, total, log = _exponentials(h1[at], soft.words[a:b])
        found[at] += own[at] - log
        if grad is not None:
            dh[at] += add(e, total, at, ys[at] - a, soft.words[a:b], grad["word"][a:b], grad["word_b"][a:b])
    logp = np.empty_like(found)
    logp[order] = found
    if grad is None:
        return logp, None
    back = np.empty_like(h)
    back[order] = dh
    return logp, back


def _sorted(symbols: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    return np.argsort(symbols.astype(np.uint16) if len(vocab) < 1 << 16 else symbols, kind="stable")


def backpropagate(p: dict, vocab: Vocabulary, x: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray,
                  grad: dict | None = None):
    """Gradients of the summed loss of one window: x, y, live (batch, steps); the state before it is a constant.

    ``grad``: arrays of zeros to use.
    """
    grad = {k: np.zeros_like(v) for k, v in p.items()} if grad is None else grad
    n, steps, m = len(x), x.shape[1], h.shape[1]
    most = max(1.0, float(np.abs(h).max(initial=0)))
    weights, caches = _gates(p), []
    xs, ys, on = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), np.ascontiguousarray(live.T)
    hs = np.empty((steps, n, m), h.dtype)
    gates, new = _fed(weights, xs)
    for t in range(steps):
        h, cache = _step(weights, p["h"], gates[:, t], new[t], h)
        hs[t] = h
        caches.append(cache)
    soft = _Softmaxes(p, vocab, most)
    at = np.flatnonzero(on)
    dhs = np.zeros_like(hs)
    logp, dhs.reshape(-1, m)[at] = output(p, vocab, np.take(hs.reshape(-1, m), at, axis=0), np.take(ys, at), grad, soft)
    carry = np.zeros_like(h)
    inputs = np.empty((3, steps, n, m), h.dtype)
    back_h = np.ascontiguousarray(p["h"].T)
    back_z, back_r = (np.ascontiguousarray(w.T) for w in (p["zr"][:, :m], p["zr"][:, m:]))
    for t in range(steps - 1, -1, -1):
        prev, z, r, rh, c = caches[t]
        dz, dr, dc = inputs[:, t]
        carry += dhs[t]
        change = c - prev
        np.multiply(c, c, out=dc)
        np.subtract(1, dc, out=dc)
        dc *= z
        dc *= carry
        drh = dc @ back_h
        np.subtract(1, z, out=dz)
        rest = carry * dz
        dz *= z
        dz *= change
        dz *= carry
        np.subtract(1, r, out=dr)
        dr *= drh
        dr *= rh
        drh *= r
        rest += drh
        rest += dz @ back_z
        rest += dr @ back_r
        carry = rest
    prevs = np.concatenate([cache[0] for cache in caches])
    rhs = np.concatenate([cache[3] for cache in caches])
    flat_x = xs.ravel()
    by = _sorted(flat_x, vocab)
    sym = flat_x[by]
    first = np.flatnonzero(np.concatenate(([True], sym[1:] != sym[:-1])))
    for k, before in enumerate((prevs, prevs, rhs)):
        part, cols = inputs[k].reshape(-1, m), slice(k * m, (k + 1) * m)
        weight = grad["zr"][:, cols] if k < 2 else grad["h"]
        weight += before.T @ part
        grad["b"][cols] += np.ones(len(part), part.dtype) @ part
        grad["in"][sym[first], cols] = np.add.reduceat(np.take(part, by, axis=0), first)
    return grad, float(-logp.sum()), int(live.sum()), h


class Adam:
    """Steps in place, over stretches that stay in the processor's cache."""

    STRETCH = 1 << 14

    def __init__(self, p: dict, rate: float):
        self.m, self.v, self.t, self.rate = ({k: np.zeros_like(x) for k, x in p.items()},
                                             {k: np.zeros_like(x) for k, x in p.items()}, 0, rate)

    def update(self, p: dict, grad: dict, n: int) -> None:
        self.t += 1
        size = self.rate * np.sqrt(1 - 0.99 ** self.t) / (1 - 0.9 ** self.t)
        for k in grad:
            arrays = [a[k].reshape(-1) for a in (p, grad, self.m, self.v)]
            for i in range(0, len(arrays[0]), self.STRETCH):
                x, g, m, v = (a[i:i + self.STRETCH] for a in arrays)
                g = g / n
                d = g - m
                d *= 0.1
                m += d
                np.multiply(g, g, out=d)
                d -= v
                d *= 0.01
                v += d
                np.sqrt(v, out=d)
                d += 1e-6
                np.divide(m, d, out=d)
                d *= float(size)
                x -= d


# ---- training --------------------------------------------------------------------------------

def _flat(p: dict) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype("<f4").tobytes()


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _symbols(model):
    """Rows (share, order, text) with the text as symbols of two bytes (four in a large vocabulary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = model.value
        kind = _kind(vocab)
        for batch in batches:
            out = [vocab.symbol[vocab.numbers(words_of(t.as_py()))].astype(kind).tobytes() for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["share", "order", "symbols"])
    return run


def _kind(vocab: Vocabulary) -> str:
    return "<u2" if len(vocab) < 1 << 16 else "<i4"


class _Copy:
    """One share's copy of the model while it learns."""

    def __init__(self, vocab: Vocabulary, start: dict, rate: float):
        self.vocab, self.p = vocab, {k: v.copy() for k, v in start.items()}
        self.adam, self.loss, self.seen = Adam(self.p, rate), 0.0, 0
        self.grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, symbols: np.ndarray, first: int, rounds: int) -> None:
        """Learn from every ``rounds``-th segment of a document, from segment ``first`` on."""
        length = STEPS * SEGMENT
        for a in range(first * length, len(symbols), length * rounds):
            y = symbols[a:a + length]
            before = symbols[a - 1:a + len(y) - 1] if a else np.concatenate(([self.vocab.end], y[:-1]))
            self.held.append((before, y))
            if len(self.held) == BATCH:
                self.learn()

    def learn(self) -> None:
        if not self.held:
            return
        length = STEPS * SEGMENT
        x = np.zeros((len(self.held), length), np.int32)
        y, live = np.zeros_like(x), np.zeros(x.shape, bool)
        for k, (sx, sy) in enumerate(self.held):
            x[k, :len(sx)], y[k, :len(sy)], live[k, :len(sy)] = sx, sy, True
        h = np.zeros((len(self.held), self.p["h"].shape[0]), np.float32)
        for a in range(0, length, STEPS):
            w = slice(a, a + STEPS)
            if not live[:, a].any():
                break
            for g in self.grad.values():
                g.fill(0)
            grad, lost, n, h = backpropagate(self.p, self.vocab, x[:, w], y[:, w], live[:, w], h, self.grad)
            self.adam.update(self.p, grad, n)
            self.loss, self.seen = self.loss + lost, self.seen + n
        self.held = []

    def done(self) -> Iterator[pa.RecordBatch]:
        self.learn()
        if self.seen:
            yield pa.record_batch([pa.array([self.seen], pa.int64()), pa.array([self.loss]), pa.array([_flat(self.p)], pa.binary())],
                                  names=["n", "loss", "weights"])


def _train(model, round_no: int, rounds: int, rate: float):
    """Copies of the model after their shares of the training segments: (tokens, loss, weights).

    A task may hold several whole shares, one after the other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, start = model.value
        share, copy, kind = None, None, _kind(vocab)
        for batch in batches:
            for s, order, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if s != share:
                    if copy is not None:
                        yield from copy.done()
                    share, copy = s, _Copy(vocab, start, rate)
                copy.add(np.frombuffer(symbols.as_py(), kind).astype(np.int32), ((order >> 32) + round_no) % rounds, rounds)
        if copy is not None:
            yield from copy.done()
    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token-weighted sums of copies, so that the driver receives a few whatever the number of tasks."""
    total, n, loss = None, 0, 0.0
    for batch in batches:
        for row in batch.to_pylist():
            w = np.frombuffer(row["weights"], "<f4").astype(np.float64) * row["n"]
            total = w if total is None else total + w
            n, loss = n + row["n"], loss + row["loss"]
    if n:
        # double precision: the sum of the sums is the same whatever copies met here, to float error
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([loss]), pa.array([total.tobytes()], pa.binary())],
                              names=["n", "loss", "weights"])


def train(docs: DataFrame, vocab: Vocabulary, text: str = "text", rounds: int = ROUNDS, rate: float = RATE,
          doc_id: str = "doc_id", share_tokens: int = SHARE_TOKENS) -> dict:
    """Weights after ``rounds`` of local training and averaging, which together learn from every segment once."""
    spark = docs.sparkSession
    p = initial(vocab)
    schema = "n long, loss double, weights binary"
    shares = max(1, -(-vocab.n // share_tokens))
    words = spark.sparkContext.broadcast(vocab)
    order = F.xxhash64(doc_id, text)
    rows = docs.select(F.pmod(order, F.lit(shares)).cast("int").alias("share"), order.alias("order"), F.col(text).alias("text"))
    rows = rows.mapInArrow(_symbols(words), "share int, order long, symbols binary")
    rows = C.cut_lineage(rows.repartition(shares, "share").sortWithinPartitions("share", "order", "symbols"))
    for k in range(rounds):
        model = spark.sparkContext.broadcast((vocab, p))
        copies = rows.mapInArrow(_train(model, k, rounds, rate / (k + 1)), schema)
        few = copies.repartition(8).mapInArrow(_average, schema).collect()    # at most eight sums of copies
        model.unpersist()
        if not few:
            break
        n = sum(r["n"] for r in few)
        p = _shaped(sum(np.frombuffer(r["weights"], "<f8") for r in few) / n, p)
    words.unpersist()
    return p


# ---- scoring ---------------------------------------------------------------------------------

def log_likelihood(p: dict, vocab: Vocabulary, docs: list[np.ndarray], batch: int = BATCH) -> np.ndarray:
    """Log probability (natural) of each sequence of symbols, the state carried through all of it."""
    total = np.zeros(len(docs))
    weights, soft = _gates(p), _Softmaxes(p, vocab)
    order = np.argsort([-len(d) for d in docs], kind="stable")    # long ones first: lanes end close together
    for a in range(0, len(docs), batch):
        lane = order[a:a + batch]
        lens = np.array([len(docs[k]) for k in lane])
        start, flat = np.cumsum(lens) - lens, np.concatenate([docs[k] for k in lane])
        h = np.zeros((len(lane), p["h"].shape[0]), np.float32)
        last = np.full(len(lane), vocab.end, np.int32)
        for t0 in range(0, int(lens[0]) if len(lane) else 0, STEPS):
            n = int((lens > t0).sum())                            # lanes are sorted, the live ones come first
            h, last = h[:n], last[:n]
            size = min(STEPS, int(lens[0]) - t0)
            steps = t0 + np.arange(size)[:, None]
            live = steps < lens[:n]
            ys = np.take(flat, np.minimum(steps, lens[:n] - 1) + start[:n])    # past its end a lane repeats its last symbol
            states = np.empty((size, n, h.shape[1]), h.dtype)
            gates, new = _fed(weights, np.concatenate([last[None], ys[:-1]]))
            last = ys[-1]
            for t in range(size):
                h, _ = _step(weights, p["h"], gates[:, t], new[t], h)
                states[t] = h
            at = np.flatnonzero(live)
            logp, _ = output(p, vocab, np.take(states.reshape(-1, h.shape[1]), at, axis=0), np.take(ys, at), soft=soft)
            total[lane[:n]] += np.bincount(at % n, logp.astype(float), n)
    return total


_SCORED = "row long, doc_id long, word binary, n long, known long, base double, score double"


def _score(model):
    """Rows with a null word: a document's sums over the head; others: its words outside, to be joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = model.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts, i = batch.column(0), batch.column(1), 0
            while i < len(ids):
                j, size, found = i, 0, []
                outside, times, of = [], [], []     # words outside the head, by document
                while j < len(ids) and (j == i or size < 2_000_000):
                    ws = words_of(texts[j].as_py())
                    at = vocab.numbers(ws)
                    out = Counter([ws[k] for k in np.flatnonzero(at < 0).tolist()])
                    outside += out
                    times += out.values()
                    of.append(len(out))
                    found.append((vocab.symbol[at], len(ws), len(ws) - out.total(), vocab.base[at].sum(), vocab.inner[at].sum()))
                    size += len(ws)
                    j += 1
                symbols, n, known, base, inner = zip(*found, strict=True)
                score = log_likelihood(p, vocab, list(symbols)) / np.log(10) + np.array(inner)
                yield pa.record_batch([
                    row + np.arange(j - i), ids.slice(i, j - i), pa.nulls(j - i, pa.binary()), pa.array(n, pa.int64()),
                    pa.array(known, pa.int64()), pa.array(base, pa.float64()), score], names=_NAMES)
                if outside:
                    r, empty = np.repeat(row + np.arange(j - i), of), pa.nulls(len(outside), pa.float64())
                    yield pa.record_batch([pa.array(r, pa.int64()), pa.nulls(len(r), pa.int64()), pa.array(outside, pa.binary()),
                                           pa.array(times, pa.int64()), pa.nulls(len(r), pa.int64()), empty, empty], names=_NAMES)
                row += j - i
                i = j
    return run


_NAMES = ["row", "doc_id", "word", "n", "known", "base", "score"]


def score_documents(docs: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    size: int = VOCAB, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every document, learned from ``training``."""
    spark = docs.sparkSession
    counts = C.stored(token_counts(training, text), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = C.most_frequent(counts, "c", head).toArrow()     # a bounded table
    known = sorted(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    vocab = Vocabulary(known, n, v, size)
    p = train(training, vocab, text, rounds, doc_id=doc_id)
    model = spark.sparkContext.broadcast((vocab, p))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = C.stored(rows.mapInArrow(_score(model), _SCORED), "scored")
    tail = (scored.filter("word IS NOT NULL").select("row", "word", "n").join(counts, "word", "left")
            .withColumn("c", F.coalesce("c", F.lit(0))))
    tail = tail.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"),
                       F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"),
                       (F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("base"),
                       (F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(vocab.rest_n + vocab.rest_v + 1)))).alias("score"))
    whole = scored.filter("word IS NULL").drop("word").unionByName(tail)
    out = whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"),
                                   F.sum("known").alias("n_known"), F.sum("base").alias("base_score"),
                                   F.sum("score").alias("score"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm(spark, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learned from those outside the held-out fold."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = C.held_out(F.col("doc_id"), FOLDS, FOLD)
    scored = score_documents(docs, docs.filter(~out))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
