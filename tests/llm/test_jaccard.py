"""Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from cohortlens.llm import common as C
from cohortlens.llm import jaccard as J
from cohortlens.llm.components import components

from .conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def plain(rows):
    """(doc, n, component) per row by comparing all pairs."""
    rows = [(J.NO_ID if d is None else d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) or a == b:
                ra, rb = sorted((root(a), root(b)))
                up[rb] = ra
    return sorted((d, len(x), root(d)) for d, x in rows)


def have(df):
    z = J.NO_ID
    return sorted((z if r.doc_id is None else r.doc_id, r.n_shingles, z if r.component_id is None else r.component_id)
                  for r in df.collect())


def corpus(seed):
    """Bases, exact and near copies at every distance, chains, shared passages, short texts, repeated rows."""
    rng = random.Random(seed)
    passage, rows = sentence(rng, 60), []
    for _ in range(14):
        base = sentence(rng, rng.choice([6, 12, 40, 150])).split()
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(["zz", "yy", "xx"]) + str(rng.randrange(5))
            w = w[:len(w) - rng.choice([0, 0, 1, len(w) // 10, len(w) // 5])]
            rows.append(" ".join(w) + (" " + passage if rng.random() < 0.3 else ""))
            if rng.random() < 0.2:
                base = w
    rows += ["a b", "a b", "A  B", "a b c d", "", None, " ", "one two three four five", "ONE two three four five"]
    ids = list(range(3, 3 * len(rows) + 3, 3))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


def test_equals_all_pairs(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        rows += rows[:3] + [(None, rows[0][1]), (rows[5][0], rows[9][1])]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert have(J.link_components(docs)) == plain(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = sentence(rng, 120).split()
    rows = []
    for k in range(700):
        w = list(base)
        w[rng.randrange(120)] = f"edit{k}"
        rows.append((k + 10, " ".join(w)))
    rows += [(2000 + k, sentence(rng, 80) + " " + " ".join(base[:30])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = have(J.link_components(docs))
    assert {c for d, _, c in got if d < 2000} == {10} and all(d == c for d, _, c in got if d >= 2000)


def test_messy_rows(messy, nothing):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert have(J.link_components(messy)) == plain(rows)
    assert J.link_components(nothing).collect() == []
    kept = J.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "5", "7", "9"])
    assert J.keep_one(nothing).collect() == []


def test_documents_take_turns_and_large_id_sets_are_marked(spark, monkeypatch):
    """As on large tables: long lists in several turns, ids that are too many to be broadcast; the same result."""
    monkeypatch.setattr(J, "SENT", 2000)
    monkeypatch.setattr(J, "AGAIN", 0)
    monkeypatch.setattr(C, "SMALL_SET", 0)
    turns, let_go = [], C.let_go
    monkeypatch.setattr(C, "let_go", lambda session: (turns.append(1), let_go(session)))
    rows = corpus(1)
    rows += rows[:3] + [(None, rows[0][1]), (rows[5][0], rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert have(J.link_components(docs)) == plain(rows)
    assert len(turns) > 6       # five without turns


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_texts_that_are_compared_with_none_stay_where_they_are(spark, monkeypatch, small):
    """Every document shares a passage with others, few link: no text is stored, and few are shuffled."""
    stored, read, real_stored, real_among = [], [], C.stored, C.among
    monkeypatch.setattr(C, "SMALL_SET", small)
    monkeypatch.setattr(C, "stored", lambda df, name: (stored.append(df.columns), real_stored(df, name))[1])
    monkeypatch.setattr(C, "among", lambda rows, ids: (read.append(out := real_among(rows, ids)), out)[1])
    rng = random.Random(4)
    shared = [sentence(rng, 30) for _ in range(6)]
    rows = [(k, " ".join(f"{rng.random()}" for _ in range(400)) + " " + shared[k % 6]) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " tail") for k in range(3)]
    got = have(J.link_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(d, c) for d, _, c in got if d != c] == [(1000, 0), (1001, 1), (1002, 2)]
    assert stored and not any("text" in columns for columns in stored)
    for texts in read:
        assert texts.count() < 60
        assert "Exchange hash" not in texts._jdf.queryExecution().executedPlan().toString()
    assert read


def test_search_counts_overlaps():
    rng = np.random.default_rng(3)
    for _ in range(60):
        query = np.unique(rng.integers(0, 400, rng.integers(1, 120))).astype(np.uint64)
        sets = []
        for _ in range(rng.integers(1, 30)):
            s = query[rng.random(len(query)) < rng.choice([0.5, 0.85, 0.95, 1.0])]
            sets.append(np.unique(np.concatenate([s, rng.integers(0, 400, rng.integers(1, 20)).astype(np.uint64)])))
        found, overlap = J.t_occurrence(query, sets)
        want = {k: len(np.intersect1d(query, s)) for k, s in enumerate(sets)}
        want = {k: i for k, i in want.items() if 100 * i >= 80 * (len(query) + len(sets[k]) - i)}
        assert dict(zip(found.tolist(), overlap.tolist(), strict=True)) == want


def test_rows_among_ids(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"t{k}") for k in [J.NO_ID, *range(-50, 3000), 7]], "doc long, text string").repartition(4)
    ids = spark.createDataFrame([(k,) for k in (J.NO_ID, -50, -1, 0, 7, 2999, 10**15)], "doc long")
    want = [J.NO_ID, -50, -1, 0, 7, 7, 2999]
    assert sorted(r.doc for r in C.among(rows, ids).collect()) == want
    monkeypatch.setattr(C, "SMALL_SET", 2)
    marked = C.among(rows, ids)
    assert marked.schema == rows.schema and marked.count() < 500
    assert sorted(r.doc for r in marked.join(ids, "doc", "left_semi").collect()) == want
    monkeypatch.setattr(C, "MAX_BITS", 64)      # a bitmap too small for its set lets more through, and leaves none out
    assert sorted(r.doc for r in C.among(rows, ids).join(ids, "doc", "left_semi").collect()) == want


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1050)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query_on_a_table(spark):
    docs = C.read(spark, "/root/testdata/sf0.001", "documents")
    assert have(J.op8_jaccard(spark, "/root/testdata/sf0.001")) == plain([(r.doc_id, r.text) for r in docs.collect()])
