"""The pipeline, stage by stage, against plain versions over a whole small table."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import common as C
from cohortlens.llm import quality, simple8b

from . import test_decontam, test_jaccard

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = C.read(spark, SF, "documents"), []
    out.append(docs)
    for _, stage in P.STAGES:
        docs = C.stored(stage(spark, docs, SF), "stage")
        out.append(docs)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])
    assert stages[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_rules(spark, stages):
    good = {r.doc_id for r in quality.op9_quality(spark, SF).collect() if r.kept}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r[0] in good] and 0 < len(good) < stages[0].count()


def test_near_duplicates(stages):
    keep = {d for d, _, c in test_jaccard.plain([r[:2] for r in rows(stages[1])]) if d == c}
    assert rows(stages[2]) == [r for r in rows(stages[1]) if r[0] in keep]


def test_near_duplicates_leave_no_texts_on_disk(spark, stages, monkeypatch):
    """The later stages' disk counts with what this one stored; as for a table with too many ids to be broadcast."""
    stored, real = [], C.stored
    monkeypatch.setattr(C, "SMALL_SET", 0)
    monkeypatch.setattr(C, "stored", lambda df, name: (stored.append(df.columns), real(df, name))[1])
    assert rows(P.near_duplicates(spark, stages[1], SF)) == rows(stages[2])
    assert stored and not any("text" in columns for columns in stored)


def test_benchmark_passages(spark, stages):
    items = [(r.item_id, r.text) for r in C.read(spark, SF, "benchmark").collect()]
    bad = {r[0] for r in test_decontam.plain([r[:2] for r in rows(stages[2])], items)}
    assert rows(stages[3]) == [r for r in rows(stages[2]) if r[0] not in bad]


def test_mixture(stages):
    before, after = Counter(rows(stages[3])), Counter(rows(stages[4]))
    assert set(after) == set(before) and max(after.values()) <= 3
    tokens, used = Counter(), Counter()
    for r, n in after.items():
        tokens[r[3]] += len(r[1].split())
        used[r[3]] += n * len(r[1].split())
    passes = [used[s] / tokens[s] for s in tokens]
    assert min(passes) >= 1 and 1.2 < max(passes) <= P.MAX_PASSES + 0.01


def test_token_files(spark, stages):
    t, place, want = Tokenizer.from_file(simple8b.default_tokenizer()), 0, []
    for r in sorted(rows(stages[4]), key=lambda r: r[0]):
        ids = np.array(t.encode(r[1], add_special_tokens=False).ids + [2], "<u4")
        want.append((r[0], place, len(ids), zlib.crc32(ids.tobytes())))
        place += len(ids)
    assert sorted(map(tuple, stages[5].collect())) == sorted(want)
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(want)
