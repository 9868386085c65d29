"""Quality rules: statistics against plain Python, fences that do not depend on partitioning, labelled rows."""

import re

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import common as C
from cohortlens.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    ws = WORD.findall(text)
    seen = {}
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i:i + 3]), []).append(i)
    hit = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(hit))


def got(judged):
    s = F.col(judged.columns[-1])["stats"]
    return judged.select("doc_id", s["n_words"], s["word_chars"], s["n_symbols"], s["lines"]["dup"], s["n_repeat_words"],
                         F.col(judged.columns[-1])["base_failed"], F.col(judged.columns[-1])["kept"]).collect()


def test_statistics_of_messy_rows(messy):
    want = sorted((str(r.doc_id), *plain(r.text)) for r in messy.collect())
    have = got(Q.judge(messy))
    assert sorted((str(r[0]), *r[1:6]) for r in have) == want
    for r in have:
        assert r[6] == (r[1] < 50 or 100 * r[5] > 50 * r[1]) and not (r[6] and r[7])


def test_filter_keeps_the_columns(messy, nothing):
    kept = Q.keep_good(messy)
    assert kept.columns == messy.columns and {r.doc_id for r in kept.collect()} == {5, 6}
    assert Q.keep_good(nothing).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_labelled_rows_and_partitioning(spark, sf):
    docs = C.read(spark, sf, "documents")
    want = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
            for r in Q.op9_quality(spark, sf).collect()}
    for r in docs.collect():
        assert want[r.doc_id][:5] == plain(r.text)
    again = {r[0]: tuple(r)[1:] for r in got(Q.judge(docs.repartition(17), keep=["doc_id"]))}
    assert again == want
    labels = C.read(spark, sf, "labels").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and not want[r.doc_id][5]]
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert all(want[d][6] for d in good) and sum(want[d][6] for d in bad) <= 0.05 * len(bad)


def test_buckets_keep_six_leading_bits(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 123456]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", C.leading_bits(F.col("v")).alias("b"))
    for v, b in df.collect():
        shift = max(0, v.bit_length() - 6)
        assert b == (v >> shift) << shift and v - b <= v / 32


def test_a_source_that_is_a_third_junk(spark):
    plain_words = " ".join(f"word{k}" for k in range(60))
    some = " ".join(f"wo#d{k}" if k % 2 else f"wo##{k}" for k in range(60))     # a source of its own kind, all alike
    junk = " ".join(f"###w{k}##" for k in range(60))
    rows = [(k, plain_words, "en", f"clean{k % 3}") for k in range(1200)]
    rows += [(2000 + k, junk if k % 3 == 0 else plain_words, "en", "mixed") for k in range(300)]
    rows += [(3000 + k, some, "en", "own") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r[0] for r in got(Q.judge(docs)) if r[7]}
    assert kept == {d for d, t, _, _ in rows if t != junk}
