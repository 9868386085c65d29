"""Periodic runs in the word sequence of a text, found on its Re-Pair grammar.

A run is a maximal stretch of words with smallest period q (words q apart are
equal) and at least max(LEAST, TIMES * q) words.

1. Re-Pair: again and again the pairs of neighbouring symbols that occur most
   often become rules X -> A B, until no pair occurs twice.  Every text has
   symbols of its own; all texts of a batch are rewritten in the same numpy
   rounds.  In a round, a pair is replaced if none of its occurrences touches one
   of a more frequent pair: such replacements do not hinder each other, so
   together they are what one after the other would give.  A boundary between two
   symbols whose pair occurs once stays for good, and what lies between two such
   boundaries leaves the rounds.
2. A run lies inside one symbol, or crosses a boundary of the string that is
   left.  So every rule is looked at once, at the boundary of its two halves, in
   the text of its first occurrence, and so is every boundary of the string that
   is left.  A run over a boundary holds two periods on one side of it, so q is
   the distance of that side's first (last) L words, L <= q < 2 L, to their next
   (previous) occurrence: candidates come from the occurrences of words L = 4, 8,
   16, ... long that are repeated at all, and q < 4 is tried directly.  A
   candidate's stretch is measured by bisection over prefix hashes.
3. A rule's runs are translated to all positions at which the derivation has it.
   Stretches of one period that lie in others are merged into them, and of equal
   stretches the smallest period stays.  What is left is compared word by word; a
   text in which hashes took two different sequences for equal is done again with
   other hash keys on exact word numbers.

Work is near n log n per text, whatever its repeats; a text is handled whole, in
one task, in some 200 bytes a word.

Edge cases: null, empty and blank texts have no words, no runs and an empty
collapsed text; a null id comes back null; repeated rows are judged one by one;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common as C
from cohortlens.llm import wordhash as W

LEAST = 6
TIMES = 4
_P = np.uint64((1 << 31) - 1)


class PrefixHash:
    """Hashes of stretches of a sequence: two residues modulo 2^31 - 1, equal for equal stretches."""

    def __init__(self, ids: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.n, self.total, self.power = len(ids), [], []
        for base in rng.integers(1 << 20, int(_P) - 1, 2):
            value = W.mix(ids.astype(np.uint64) + np.uint64(int(base) * 2 + 1)) % _P
            power = np.ones(self.n + 1, np.uint64)
            done, step = 1, np.uint64(base)
            while done <= self.n:
                more = min(done, self.n + 1 - done)
                power[done:done + more] = power[:more] * step % _P
                done, step = done + more, step * step % _P
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(value * power[:-1] % _P, out=total[1:])
            self.total.append(total % _P)
            self.power.append(power)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of ids[a:b], for arrays of places."""
        out = np.zeros(len(a), np.uint64)
        for total, power in zip(self.total, self.power, strict=True):
            out = (out << np.uint64(31)) | ((total[b] + _P - total[a]) % _P * power[self.n - a] % _P)
        return out

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self(a, a + n) == self(b, b + n)


class Grammar:
    """Re-Pair of several sequences at once.

    ``ids``: numbers 0 .. below ``terminals``, of which no two sequences share one; ``first``: where sequences begin.
    ``left``, ``right``, ``size`` by rule (a rule's symbol is ``terminals`` + its index), ``at``: its first occurrence.
    ``symbol``, ``start``: the string that is left.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray, terminals: int):
        n = len(ids)
        self.terminals = terminals
        lefts, rights, ats, ends_sym, ends_pos = [], [], [], [], []
        size = [np.ones(terminals, np.int64)]
        sym, pos, live = ids.astype(np.int64), np.arange(n), np.ones(n, bool)
        # live[i]: the pair of sym[i] and sym[i + 1] may occur twice
        live[first[1:][first[1:] > 0] - 1] = False
        if n:
            live[-1] = False
        self.often = np.zeros(n, np.int64)      # occurrences of the word pair that ends before each place
        made, fresh = terminals, True
        while True:
            at = np.flatnonzero(live)
            if not len(at):
                break
            a, b = sym[at], sym[at + 1]
            _, cls = np.unique(a * np.int64(made) + b, return_inverse=True)
            if fresh:
                self.often[at + 1] = np.bincount(cls)[cls]
                fresh = False
            # of a a a a, every other pair counts
            chained = np.zeros(len(at), bool)
            chained[1:] = (a[1:] == b[1:]) & (a[:-1] == b[:-1]) & (at[1:] == at[:-1] + 1) & (a[1:] == a[:-1])
            place = np.arange(len(at))
            head = np.maximum.accumulate(np.where(chained, 0, place))
            counts = (place - head) % 2 == 0
            count = np.bincount(cls[counts], minlength=cls.max() + 1)
            twice = count[cls] >= 2
            live[at[~twice]] = False
            at, cls, counts = at[twice], cls[twice], counts[twice]
            if len(at):
                tie = W.mix(np.arange(len(count), dtype=np.uint64) + np.uint64(made))
                rank = np.empty(len(count), np.int64)
                rank[np.lexsort((tie, count))] = np.arange(1, len(count) + 1)
                weight = np.zeros(len(sym) + 1, np.int64)
                weight[at] = rank[cls]
                mine, hit = weight[at], at[counts]
                beaten = (weight[at - 1] > mine) | (weight[at + 1] > mine)
                blocked = np.zeros(len(count), bool)
                blocked[cls[counts & beaten]] = True
                take = ~blocked[cls[counts]]
                hit, kind = hit[take], cls[counts][take]
                names, where, kind = np.unique(kind, return_index=True, return_inverse=True)
                lefts.append(sym[hit[where]])
                rights.append(sym[hit[where] + 1])
                ats.append(pos[hit[where]])
                known = np.concatenate(size)
                size = [known, known[lefts[-1]] + known[rights[-1]]]
                sym[hit] = made + kind
                live[hit] = live[hit + 1]
                made += len(names)
                stay = np.ones(len(sym), bool)
                stay[hit + 1] = False
                sym, pos, live = sym[stay], pos[stay], live[stay]
            # a symbol between two boundaries that stay is done
            busy = live.copy()
            busy[1:] |= live[:-1]
            if not busy.all():
                ends_sym.append(sym[~busy])
                ends_pos.append(pos[~busy])
                sym, pos, live = sym[busy], pos[busy], live[busy]
        ends_sym.append(sym)
        ends_pos.append(pos)
        start, symbol = np.concatenate(ends_pos), np.concatenate(ends_sym)
        order = np.argsort(start)
        self.start, self.symbol = start[order], symbol[order]
        none = [np.zeros(0, np.int64)]
        self.left, self.right, self.at = (np.concatenate(none + x) for x in (lefts, rights, ats))
        self.size = np.concatenate(size)

    def occurrences(self, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rule, place) of all nodes of the derivation whose rule is hot; a rule that leads to a hot one must be hot too."""
        sym, pos = self.symbol, self.start
        while True:
            rule = sym - self.terminals
            keep = rule >= 0
            keep[keep] = hot[rule[keep]]
            rule, pos = rule[keep], pos[keep]
            if not len(rule):
                return
            yield rule, pos
            mid = pos + self.size[self.left[rule]]
            sym, pos = np.concatenate((self.left[rule], self.right[rule])), np.concatenate((pos, mid))


def _reach(same, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words on from (or back to) places a and b agree, at most ``most``."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        shift = mid if back else 0
        ok = same(a - shift, b - shift, mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return low


def _candidates(ids: np.ndarray, often: np.ndarray, end: np.ndarray, hashes: PrefixHash, place: np.ndarray, low: np.ndarray,
                high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(boundary, q, origin): boundaries at ``place`` with a possible period q; ``origin`` begins two equal stretches of q."""
    def squares(which: np.ndarray, q: np.ndarray, left: bool):
        p = place[which]
        origin = p - 2 * q if left else p
        ok = (TIMES * q <= high[which] - low[which]) & (
            (origin >= low[which]) if left else (p + 2 * q <= high[which]))
        which, q, origin = which[ok], q[ok], origin[ok]
        ok = ids[origin] == ids[origin + q]
        which, q, origin = which[ok], q[ok], origin[ok]
        ok = hashes.same(origin, origin + q, q)
        return which[ok], q[ok], origin[ok]

    every = np.arange(len(place))
    for q in range(1, 4):
        for left in (False, True):
            yield squares(every, np.full(len(every), q), left)
    length, begin = 4, None
    reach = int((high - low).max(initial=0)) // TIMES
    while length <= reach:
        if begin is None:
            begin = np.arange(len(ids))
            begin = begin[begin + length <= end]
            for i in range(1, length):
                begin = begin[often[begin + i] >= 2]
        else:       # both halves of a repeated stretch are repeated
            known = np.zeros(len(ids) + length, bool)
            known[begin] = True
            begin = begin[known[begin + length // 2] & (begin + length <= end[begin])]
        if not len(begin):
            return
        key = hashes(begin, begin + length)
        order = np.argsort(key, kind="stable")      # places of a class in ascending order
        begin, key = begin[order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        cls = np.cumsum(new) - 1
        many = np.bincount(cls)[cls] >= 2
        begin, cls = begin[many], cls[many]
        rank = np.full(len(ids) + 1, -1)
        rank[begin] = np.arange(len(begin))
        for left in (False, True):
            own = place - length if left else place
            which = every[(own >= low) & (place <= high) & (high - low >= TIMES * length)]
            which = which[rank[own[which]] >= 0]
            at, step = rank[own[which]], 0
            while len(which):
                step += 1
                other = at - step if left else at + step
                ok = (other >= 0) & (other < len(begin))
                which, at, other = which[ok], at[ok], other[ok]
                q = np.abs(begin[other] - begin[at])
                ok = (cls[other] == cls[at]) & (q < 2 * length)
                which, at, q = which[ok], at[ok], q[ok]
                far = q >= length
                yield squares(which[far], q[far], left)
        begin = np.sort(begin)
        length *= 2


def runs_of(ids: np.ndarray, first: np.ndarray, terminals: int, seed: int = 11) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period; places count through all sequences.

    Stretches are compared by hashes: a row may rest on two different stretches taken for equal.
    """
    none = np.zeros((0, 3), np.int64)
    if len(ids) < LEAST:
        return none
    g = Grammar(ids, first, terminals)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][owner]
    inner = g.size[g.left] if len(g.left) else g.at
    place = np.concatenate((g.at + inner, g.start))
    low = np.concatenate((g.at, first[owner[g.start]]))
    high = np.concatenate((g.at + g.size[g.terminals:], end[g.start]))
    rule = np.concatenate((np.arange(len(g.at)), np.full(len(g.start), -1)))
    # a run crosses its boundary, so it holds the boundary's word pair three times
    ok = (place > low) & (high - low >= LEAST) & (g.often[place] >= 3)
    place, low, high, rule = place[ok], low[ok], high[ok], rule[ok]
    if not len(place):
        return none
    hashes = PrefixHash(ids, seed)
    found = []
    for which, q, origin in _candidates(ids, g.often, end, hashes, place, low, high):
        if len(which):
            ahead = _reach(hashes.same, origin, origin + q, high[which] - origin - q, False)
            behind = _reach(hashes.same, origin, origin + q, origin - low[which], True)
            s, e = origin - behind, origin + q + ahead
            ok = e - s >= np.maximum(LEAST, TIMES * q)
            found.append(np.stack([s[ok], e[ok], q[ok], rule[which[ok]]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
    out = [rows[rows[:, 3] < 0, :3]]
    inside = rows[rows[:, 3] >= 0]
    if len(inside):
        inside = inside[np.argsort(inside[:, 3], kind="stable")]
        at = np.searchsorted(inside[:, 3], np.arange(len(g.at) + 1))
        hot = np.diff(at) > 0
        while True:     # as often as the grammar is deep
            whole = np.concatenate((np.zeros(terminals, bool), hot))
            more = hot | whole[g.left] | whole[g.right]
            if (more == hot).all():
                break
            hot = more
        for node, pos in g.occurrences(hot):
            n = np.diff(at)[node]
            each = np.repeat(at[node] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            shift = np.repeat(pos - g.at[node], n)
            part = inside[each, :3].copy()
            part[:, :2] += shift[:, None]
            out.append(part)
    rows = np.concatenate(out)
    if not len(rows):
        return none
    # stretches of one period inside a longer one belong to it
    rows = rows[np.lexsort((-rows[:, 1], rows[:, 0], rows[:, 2]))]
    _, group = np.unique(rows[:, 2], return_inverse=True)
    reach = rows[:, 1] + group * np.int64(len(ids) + 1)
    before = np.maximum.accumulate(np.append(-1, reach[:-1]))
    rows = rows[reach > before]
    # of equal stretches the smallest period is the run's
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _exact(words: list[bytes], rows: list[list[int]]) -> bool:
    return all(words[s:e - q] == words[s + q:e] for s, e, q in rows)


def _again(words: list[bytes]) -> list[list[int]]:
    """The runs of one text after a hash failed: exact word numbers, other keys until the words agree."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    seed = 12
    while True:
        rows = runs_of(ids, np.array([0, len(ids)]), len(number), seed).tolist()
        if _exact(words, rows):
            return rows
        seed += 1


def _kept(words: list[bytes], rows: list[list[int]]) -> list[bytes]:
    out, at = [], 0
    for s, e in sorted((s + q, e) for s, e, q in rows):
        out += words[at:s]
        at = max(at, e)
    return out + words[at:]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for i, j, w in W.batches(texts):
            owner = w.owner().astype(np.uint64)
            # two texts share no symbol
            names, ids = np.unique(W.mix(w.hash + owner * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
            found = runs_of(ids, w.first, len(names))
            at = np.searchsorted(found[:, 0], w.first)
            n_words, runs, left = [], [], []
            for k, text in enumerate(texts.slice(i, j - i).to_pylist()):
                words = (text or "").encode().split()
                rows = found[at[k]:at[k + 1]]
                rows = (rows - [w.first[k], w.first[k], 0]).tolist() if len(rows) else []
                if rows and not _exact(words, rows):
                    rows = _again(words)
                n_words.append(len(words))
                runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in rows])
                left.append(b" ".join(_kept(words, rows) if rows else words).decode())
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(RUN)),
                                   pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed_text"])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed_text.

    The collapsed text keeps the words, parted by single spaces, that no run holds after its first period.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(_find, "doc_id long, n_words long, "
                                  "runs array<struct<start:long,length:long,period:long>>, collapsed_text string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, in which every tenth document (by the crc32 of its id) ends in a repeated stretch."""
    h = C.crc(doc_id)
    g = F.floor(h / 10)

    def bent(ws: Column) -> Column:
        n = F.size(ws)
        return C.bind(g % n, lambda a: C.bind(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.array_join(F.transform(
            ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")))
    changed = C.bind(C.words(text), lambda ws: F.when(F.size(ws) > 0, bent(ws)))
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)


def op11_periodic(spark, sf_dir: str) -> DataFrame:
    """Every document's runs, a tenth of the texts bent to end in one: their number, the strongest, and digests."""
    docs = C.read(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    # exact comparison of length / period; the runs are in order of start and period, so a tie keeps the earlier
    best = F.aggregate("runs", F.expr("cast(null AS struct<start:long,length:long,period:long>)"), lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"),
        F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
