"""Language model: exact counts and base scores, gradients, probabilities that sum to one, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from cohortlens.llm import common as C
from cohortlens.llm import lm as L
from tests.conftest import SF_MID

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def plain(rows):
    c = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return [(str(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            for d, t in rows for ws in [tokens(t)]]


def same(got, rows):
    got = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    for a, b in zip(got, sorted(plain(rows), key=str), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)


def test_base_scores_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    got = L.op2_lm(spark, sf).collect()
    same(got, [(r.doc_id, r.text) for r in C.read(spark, sf, "documents").collect()])
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_outside_the_head_are_joined(spark):
    docs = spark.createDataFrame([(k, f"a b c a w{k} w{k % 3}") for k in range(40)] + [(50, None), (None, "a"), (None, "a")],
                                 "doc_id long, text string").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = docs.filter("doc_id IS NULL OR doc_id >= 0").filter(~C.held_out(docs.doc_id, 7, 2))
    few, all_ = (L.score_documents(docs, train, size=3, head=h, rounds=1).collect() for h in (4, 1000))
    same(few, rows)
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.score, 3))
    assert sorted(map(key, few)) == sorted(map(key, all_))


def test_every_segment_is_learned_from(spark):
    # a word's input weights move only if its segment is learned from; past a first window gradients reach them
    texts = ["a " * 20 + f"w{k}" for k in range(40)] + [" ".join("a " * 40 + f"x{k}" + " a" * 23 for k in range(17))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    counts = Counter(w for t in texts for w in L.words_of(t))
    vocab = L.Vocabulary(sorted(counts.items(), key=lambda x: (-x[1], x[0])), sum(counts.values()), len(counts))
    before, own = L.initial(vocab), vocab.symbol[vocab.numbers(sorted(counts.keys() - {L.END}))]
    for rounds in (1, L.ROUNDS, 3):
        moved = (L.train(docs, vocab, rounds=rounds)["in"] != before["in"]).any(1)
        assert moved[own].all()


def model(n=30, size=20):
    rng = np.random.default_rng(0)
    head = [(f"w{k}".encode(), int(100 / (k + 1)) + 1) for k in range(n - 1)] + [(L.END, 9)]
    head.sort(key=lambda x: (-x[1], x[0]))
    vocab = L.Vocabulary(head, sum(c for _, c in head) + 5, n + 5, size, classes=5)
    p = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float64) for k, v in L.initial(vocab, 6).items()}
    return vocab, p, rng


def test_probabilities_sum_to_one():
    vocab, p, rng = model()
    h = rng.normal(size=(1, 6))
    logp, _ = L.output(p, vocab, np.repeat(h, len(vocab), 0), np.arange(len(vocab)))
    assert abs(np.exp(logp).sum() - 1) < 1e-9
    # the shared symbol's words and one unseen word share its mass
    inner = 10 ** vocab.inner[:-1][vocab.symbol[:-1] == vocab.rest]
    outside = 5 * 2 + 1      # five words seen once outside the head, one never seen
    assert abs(inner.sum() + outside / (vocab.rest_n + vocab.rest_v + 1) - 1) < 1e-9


def test_gradients():
    vocab, p, rng = model()
    x, y = rng.integers(0, len(vocab), (2, 3, 7))
    live = np.ones((3, 7), bool)
    live[1, 4:] = False
    h = rng.normal(size=(3, 6))
    grad, loss, n, _ = L.backpropagate(p, vocab, x, y, live, h)
    assert n == 18
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p[k].shape)
            if k == "in":
                at = (int(x[0, 0]), at[1])
            old, diff = p[k][at], []
            for e in (1e-5, -1e-5):
                p[k][at] = old + e
                diff.append(L.backpropagate(p, vocab, x, y, live, h)[1])
            p[k][at] = old
            assert abs((diff[0] - diff[1]) / 2e-5 - grad[k][at]) < 1e-3


def test_state_is_carried_through_the_whole_text():
    vocab, p, rng = model()
    docs = [rng.integers(0, len(vocab), k).astype(np.int32) for k in (1, 5, 16, 17, 100, 33, 2)]
    got = L.log_likelihood(p, vocab, docs, batch=3)
    for d, want in zip(docs, got, strict=True):
        h, last, total = np.zeros((1, 6)), np.array([vocab.end]), 0.0
        for s in d:
            h, _ = L.step(p, last, h)
            total += L.output(p, vocab, h, np.array([s]))[0][0]
            last = np.array([s])
        assert abs(total - want) < 1e-3


def test_messy_rows(messy, nothing, spark):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = L.score_documents(messy, messy.filter(~C.held_out(messy.doc_id, 7, 2))).collect()
    same(got, rows)
    assert L.score_documents(nothing, nothing).collect() == []
    assert all(r.score == 0 and r.base_score == 0 for r in L.score_documents(messy, nothing).collect())


def test_scores_do_not_depend_on_the_layout(spark):
    """One file or many: the same shares, order and model; and the model gains on held-out text with each."""
    docs = C.read(spark, SF_MID, "documents").select("doc_id", "text").cache()
    counts = L.C.cut_lineage(L.token_counts(docs, "text"))
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    vocab = L.Vocabulary(sorted(((bytes(r.word), r.c) for r in counts.collect()), key=lambda x: (-x[1], x[0])), n, v, 1000)
    for share in (20_000, 10 ** 9):
        p = [L.train(docs.repartition(k), vocab, share_tokens=share) for k in (1, 16, 211)]
        for q in p[1:]:
            assert all(np.allclose(p[0][w], q[w], atol=1e-6) for w in p[0])
    docs.unpersist()


def test_one_exponential_per_logit(monkeypatch):
    """Training takes a softmax's exponentials once, for its sum and its gradients."""
    vocab, p, rng = model()
    x, y = rng.integers(0, len(vocab), (2, 8, 16))
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda e, **k: taken.append(e.size) or exp(e, **k))
    L.backpropagate(p, vocab, x, y, np.ones(x.shape, bool), np.zeros((8, 6)))
    size = np.diff(vocab.start)
    assert sum(taken) <= y.size * len(size) + size[vocab.group[y]].sum()


def test_probabilities_far_below_the_bound():
    """Logits all much smaller than the weights' sizes allow: the exponentials' sum vanishes and is taken anew."""
    vocab, p, rng = model()
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["class"][:], p["word"][:] = 100, 100
    h = np.full((len(vocab), 6), -0.9, np.float32)
    y = np.arange(len(vocab))
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    logp, dh = L.output(p, vocab, h, y, grad)
    assert abs(np.exp(logp.astype(float)).sum() - 1) < 1e-3
    assert all(np.isfinite(g).all() for g in grad.values()) and np.isfinite(dh).all()
