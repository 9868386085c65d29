"""Token files: exact round trips and equality with the tokenizer run over whole texts."""

import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import common as C
from cohortlens.llm import simple8b as S


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2 ** 16), st.integers(0, 2 ** 64 - 1)), max_size=3000))
def test_words_round_trip(ids):
    v = np.array(ids, dtype=np.uint64)
    words, blocks, escapes = S.encode(v)
    assert (S.decode(words, escapes) == v).all() and len(S.decode(words, escapes)) == len(v)
    if len(blocks) > 1:   # a block decodes on its own
        assert (S.decode(words[blocks[1]:], escapes) == v[S.BLOCK:]).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aB'.,<|>! é5s", max_size=40),
                          st.text(alphabet="abz'.,-_$ \u0301é5&~^`\\\"", max_size=40)), max_size=5))
def test_ids_equal_the_whole_text_s(texts):
    t = Tokenizer.from_file(S.default_tokenizer())
    texts = texts + ["(Hello,) 'tis. don't!?; x's, €5, -- ...a.b... 5%! é. (é) <|ENDOFTEXT|> <| a<|endoftext|>, A'S 'S", "It's <|endoftext|>x <|startoftext|> don 't", "á ́b c\x1cd ΣΣ Å"]
    ids, n = S.WordTokenizer(S.default_tokenizer(), limit=4)(texts)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_words_and_their_punctuation_met_before():
    """A word, its base and its tail in the table already, or new in the same batch."""
    t = Tokenizer.from_file(S.default_tokenizer())
    w = S.WordTokenizer(S.default_tokenizer())
    for x in ("word ,,, word,,, other.", "word. other ... word,,, . word...", "new new; ;; new;; , wo'rd's, 's, a's.'t, é, zé."):
        assert w([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_a_full_table_keeps_the_words_met_again():
    t = Tokenizer.from_file(S.default_tokenizer())
    w = S.WordTokenizer(S.default_tokenizer(), limit=6)
    for k in range(40):
        x = f"once{k} seldom{k // 9}, often, the tokenizer's once-{k}."
        assert w([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids
        assert len(w.again) == len(w.known) == len(w.offset) - 1 <= 6 + 6
        assert {b"often,", b"the"} <= w.known.keys()
    assert b"once0" not in w.known


def test_a_full_table_and_a_batch_of_new_words_fit_before_the_dict_doubles():
    assert sys.getsizeof(dict.fromkeys(range(S.CACHE_WORDS + 90_000))) < 25 << 20


def test_files_hold_all_documents_in_order(spark, tmp_path):
    rows = [(5, "one two three", "x"), (None, "none", "x"), (3, None, "y"), (3, "", "y"), (9, "a b " * 40_000, None),
            (5, "one two three", "x"), (7, "été !", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    S.write_tokens(docs, str(tmp_path / "t"), S.default_tokenizer())
    got = [tuple(r) for r in S.read_tokens(spark, str(tmp_path / "t")).collect()]
    got.sort(key=lambda r: r[1])
    t = Tokenizer.from_file(S.default_tokenizer())
    place = 0
    assert sorted((r[0] is not None, r[0] or 0) for r in rows) == [(r[0] is not None, r[0] or 0) for r in got]
    left = [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x, _ in rows]
    for doc, start, n, ids in got:
        assert (start, n) == (place, len(ids))
        left.remove((doc, ids))
        place += n
    assert not left


def test_texts_come_to_the_workers_in_small_batches(spark, tmp_path, monkeypatch):
    def sizes(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pylist([{"start": b.nbytes}], pa.schema([
                    ("part", pa.int32()), ("start", pa.int64()), ("doc_id", pa.list_(pa.int64())),
                    ("n_tokens", pa.list_(pa.int64())), ("words", pa.binary()), ("blocks", pa.binary()),
                    ("escapes", pa.binary())]))
        return run

    monkeypatch.setattr(S, "_frames", sizes)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 4000).alias("text"))
    S.write_tokens(docs, str(tmp_path / "t"), S.default_tokenizer())
    got = [r.start for r in spark.read.parquet(str(tmp_path / "t")).collect()]
    assert sum(got) >= 2000 * 20_000 and max(got) < 1.5 * (1 << 20)
    assert spark.conf.get(key) == before


def test_settings_go_back(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for own in (None, "7m"):
        if own:
            spark.conf.set(key, own)
        with pytest.raises(ZeroDivisionError), C.setting(spark, key, "5b"):
            assert spark.conf.get(key) == "5b"
            1 / 0
        assert spark.conf.get(key, None) == own
        spark.conf.unset(key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.token_table(docs, S.default_tokenizer()).collect() == []


@pytest.mark.parametrize("table", ["documents"])
def test_query_equals_brute_force(spark, table):
    t = Tokenizer.from_file(S.default_tokenizer())
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in S.op4_simple8b(spark, sf).collect()}
    place = 0
    for r in sorted(C.read(spark, sf, table).collect(), key=lambda r: r.doc_id):
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (
            place, len(ids), zlib.crc32(ids.tobytes()))
        place += len(ids)
