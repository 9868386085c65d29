import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import common as C
from cohortlens.llm import periodic
from tests.conftest import SF_MID


def smallest(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[:len(w) - q])


def plain_runs(w):
    """(start, end, period) by trying every period."""
    out, n, number = [], len(w), {}
    x = np.array([number.setdefault(v, len(number)) for v in w], np.int64)
    for q in range(1, n // 4 + 1):
        differ = np.flatnonzero(np.concatenate(([True], x[q:] != x[:-q], [True])))
        for k in np.flatnonzero(np.diff(differ) - 1 + q >= max(6, 4 * q)):
            i, j = int(differ[k]), int(differ[k + 1]) - 1
            if smallest(w[i:i + 2 * q]) == q:
                out.append((i, j + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_kept(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < e for s, e, q in runs)]


def several(texts):
    """Runs of several sequences, rewritten together."""
    names, ids, first = {}, [], [0]
    for k, t in enumerate(texts):
        ids += [names.setdefault((k, x), len(names)) for x in t]
        first.append(len(ids))
    rows = periodic.runs_of(np.array(ids, np.int64), np.array(first), max(1, len(names)))
    return [[(s - a, e - a, q) for s, e, q in rows.tolist() if a <= s < b] for a, b in zip(first, first[1:], strict=False)]


piece = st.lists(st.integers(0, 3), min_size=1, max_size=7)
bent = st.lists(st.tuples(piece, st.integers(1, 9)), max_size=8).map(lambda ps: [x for p, n in ps for x in p * n])


@settings(max_examples=300, deadline=None)
@given(st.lists(bent, min_size=1, max_size=4))
def test_runs_equal_plain(texts):
    assert several(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=300))
def test_two_words(text):
    assert several([text]) == [plain_runs(text)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


@pytest.mark.parametrize("text", [
    [0] * 5, [0] * 6, [0] * 1000, fibonacci(800) * 5, thue_morse(2048) * 2, list(range(50)) * 9,
    ([0] * 20 + [1] * 30) * 6 + [0] * 11, ([0, 1, 2] * 7 + [3]) * 5, (list(range(9)) * 5 + [0] * 6 + [4]) * 4])
def test_hard_words(text):
    assert several([text, text[::-1]]) == [plain_runs(text), plain_runs(text[::-1])]


def test_grammar_spells_the_texts_and_repeats_no_pair():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 5, 400), rng.integers(5, 9, 300), [9] * 50])
    first = np.array([0, 400, 700, 750])
    g = periodic.Grammar(ids, first, 10)

    def spell(s):
        return [s] if s < 10 else spell(g.left[s - 10]) + spell(g.right[s - 10])
    assert [x for s in g.symbol for x in spell(s)] == ids.tolist()
    assert all(spell(10 + x) == ids[at:at + n].tolist() for x, (at, n) in enumerate(zip(g.at, g.size[10:], strict=True)))
    inner = [(a, b) for a, b, p in zip(g.symbol, g.symbol[1:], g.start[1:], strict=False) if p not in first]
    assert len({p for p in inner if p[0] != p[1]}) == len([p for p in inner if p[0] != p[1]])


def test_a_failed_hash_is_done_again(monkeypatch):
    real = periodic.PrefixHash.same
    text = [b"%d" % x for x in [1, 2] * 11 + list(range(30, 60))]
    seeds = []

    class Weak(periodic.PrefixHash):
        def __init__(self, ids, seed):
            super().__init__(ids, seed)
            self.seed = seed
            seeds.append(seed)

        def same(self, a, b, n):
            return np.ones(len(a), bool) if self.seed < 13 else real(self, a, b, n)
    monkeypatch.setattr(periodic, "PrefixHash", Weak)
    assert [tuple(r) for r in periodic._again(text)] == plain_runs(text)
    assert max(seeds) == 13


def check(rows, want):
    for r in rows:
        runs = [(x.start, x.start + x.length, x.period) for x in r.runs]
        words = want.pop(r.doc_id).split() if r.doc_id in want else None
        if words is not None:
            assert (runs, r.n_words, r.collapsed_text) == (
                plain_runs(words), len(words), " ".join(plain_kept(words, runs)))


def test_messy_rows(spark, messy):
    """Nulls, empty and very long texts, repeated rows, clashing columns."""
    rows = periodic.find_runs(messy).collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert r.runs == [] and (r.doc_id not in (2, 3, 4, 9) or (r.n_words, r.collapsed_text) == (0, ""))
    long = " ".join(["tick tock"] * 40_000 + [f"w{i % 7919}" for i in range(30_000)])
    df = spark.createDataFrame([(1, long), (None, "a b " * 4), (2, "x\ty\x0bz " * 6)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.find_runs(df).collect()}
    assert got == {1: [(0, 80_000, 2)], None: [(0, 8, 2)], 2: [(0, 18, 3)]}


def test_empty(nothing):
    assert periodic.find_runs(nothing).collect() == []


def test_query_against_plain(spark):
    docs = C.read(spark, SF_MID, "documents").collect()
    got = {r.doc_id: r for r in periodic.op11_periodic(spark, SF_MID).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        w, h = (d.text or "").encode().split(), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), zlib.crc32(str(d.doc_id).encode()) // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        r = got[d.doc_id]
        assert (r.start, r.length, r.period) == ((best[0], best[1] - best[0], best[2]) if best else (None,) * 3)
        assert r.exponent_milli == (1000 * (best[1] - best[0]) // best[2] if best else None)
        assert (r.n_runs, r.runs_sha256) == (len(runs), hashlib.sha256(lines.encode()).hexdigest())
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(plain_kept(w, runs))).hexdigest()
        some += len(runs)
    assert some > 20
