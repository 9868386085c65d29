"""Removal of repeated passages against plain Python."""

import hashlib
import random

from cohortlens.llm import substring as S

from .conftest import sentence

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def plain(rows, width):
    """(doc, n_words, n_removed, kept) per row; rows of one doc_id and text are one document."""
    docs = {(d, t or "") for d, t in rows}
    first = {}
    low = lambda d: -1e30 if d is None else d
    by_text = {}
    for d, t in docs:
        ws = words(t)
        for i in range(len(ws) - width + 1):
            first.setdefault(tuple(ws[i:i + width]), []).append((low(d), by_text.setdefault(t, len(by_text)), i))
    out = []
    for d, t in rows:
        ws, gone = words(t), set()
        for i in range(len(ws) - width + 1):
            if min(first[tuple(ws[i:i + width])]) < (low(d), by_text[t or ""], i):
                gone |= set(range(i, i + width))
        out.append((str(d), len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out)


def have(df):
    return sorted((str(r.doc_id), r.n_words, sum(x.ends - x.starts for x in r.removed), r.kept_text) for r in df.collect())


def test_equals_plain(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        shared = [sentence(rng, 30) for _ in range(4)] + ["la la la la " * 12]
        rows = []
        for d in range(40):
            parts = [sentence(rng, rng.randrange(0, 40))]
            for _ in range(rng.randrange(3)):
                parts += [rng.choice(shared), sentence(rng, rng.randrange(0, 30))]
            rows.append((rng.randrange(10 ** 6) if d else None, rng.choice(["  ", "\n", "\t "]).join(parts)))
        rows += [rows[3], rows[4], (10 ** 7, rows[5][1]), (10 ** 7 + 1, None), (10 ** 7 + 2, "")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert have(S.remove_repeats(docs)) == plain(rows, 20)
        assert have(S.remove_repeats(docs, width=3)) == plain(rows, 3)


def test_messy_rows(messy, nothing):
    assert have(S.remove_repeats(messy)) == plain([(r.doc_id, r.text) for r in messy.collect()], 20)
    assert S.remove_repeats(nothing).collect() == []


def test_rows_of_one_id_with_other_texts_are_ordered(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, passage + " x"), (1, passage + " y"), (1, passage + " x"), (2, passage)]
    got = have(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    removed = sorted((r[0], r[2]) for r in got)
    # one of the two texts of id 1 holds the passage, its repeated row with it
    assert removed in ([("1", 0), ("1", 0), ("1", 25), ("2", 25)], [("1", 0), ("1", 25), ("1", 25), ("2", 25)])


def test_intervals_are_maximal(spark):
    text = " ".join(f"p{i}" for i in range(50))
    got = S.remove_repeats(spark.createDataFrame([(1, text), (2, "a " + text + " b")], "doc_id long, text string"))
    r = {x.doc_id: x for x in got.collect()}
    assert [(x.starts, x.ends) for x in r[2].removed] == [(1, 51)] and r[2].kept_text == "a b" and r[1].removed == []
    assert hashlib.sha256(r[1].kept_text.encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    """Slices of a few bytes, words longer than a slice, very long texts in little memory."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from cohortlens.llm import wordhash as W
    texts = pa.array(["a bb ccc " * 50, "", None, "x" * 300 + " y", "é \U0001F600 z" * 20])

    def hashes():
        return np.concatenate([w.hash for *_, w in W.batches(texts)])
    whole = hashes()
    for n in (1, 7, 64):
        monkeypatch.setattr(W, "SLICE", n)
        assert (hashes() == whole).all()
    monkeypatch.undo()
    long = pa.array(["word" + " word" * 2_000_000])
    tracemalloc.start()
    for _ in W.batches(long):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * long.nbytes
