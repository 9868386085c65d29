"""Containment search against plain Python, with one and with many passes."""

import random
import re

from cohortlens.llm import decontam as D

from .conftest import sentence

WORD = re.compile(r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")


def shingles(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {(len(ws) < 5, *ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def plain(docs, items):
    out = []
    for d, t in docs:
        x = shingles(t)
        for k, u in items:
            y = shingles(u)
            if y and 5 * len(x & y) >= 4 * len(y):
                out.append((d, k, len(y), len(x & y)))
    return sorted(out, key=str)


def tables(spark):
    rng = random.Random(4)
    items = [(k, sentence(rng, rng.choice([3, 6, 20, 60]))) for k in range(30)] + [(30, None), (31, " "), (None, sentence(rng, 9))]
    items += [items[2], (40, "a b c d e " * 30)]
    docs = []
    for d in range(60):
        k, t = rng.choice(items)
        w = (t or "").split()
        for _ in range(rng.choice([0, 0, 1, 1, 3, 6])):
            if w:
                w[rng.randrange(len(w))] = "edited"
        glue = rng.choice([" ", ", ", "\n", "!"])
        docs.append((d, glue.join([sentence(rng, rng.choice([0, 30, 900])), " ".join(w).upper(), sentence(rng, 15)])))
    docs += [(100, None), (101, ""), (None, docs[3][1]), docs[4], (102, items[0][1])]
    return docs, items, (spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                         spark.createDataFrame(items, "item_id long, text string").repartition(3))


def test_equals_plain(spark):
    docs, items, (d, b) = tables(spark)
    got = sorted((tuple(r) for r in D.contaminated(d, b).collect()), key=str)
    assert got == plain(docs, items) and len(got) > 20


def test_passes_of_bounded_size_find_the_same(spark):
    docs, items, (_, b) = tables(spark)
    held = [x.value for x in D.passes(spark, b, pass_hashes=40)]
    assert len(held) > 5 and sum(len(x.ids) for x in held) == sum(bool(shingles(t)) for _, t in items)


def test_removal_keeps_rows_and_columns(messy, nothing, spark):
    items = spark.createDataFrame([(1, "Ein\u00a0Wort été \U0001F600"), (2, "a b c d e f g h")], "item_id long, text string")
    left = D.remove_contaminated(messy, items)
    assert left.columns == messy.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["2", "3", "4", "None", "5", "6", "9"])
    assert D.remove_contaminated(messy, items.limit(0)).count() == messy.count()
    assert D.remove_contaminated(nothing, items).collect() == []
    assert D.contaminated(messy, items.limit(0)).collect() == []
