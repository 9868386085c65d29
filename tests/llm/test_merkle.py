import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import common as C
from cohortlens.llm import merkle
from tests.conftest import SF_SMALL


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(digests):
    """Root and, per leaf, its siblings level by level."""
    paths, place = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for leaf, at in enumerate(place):
            run = digests[at // 16 * 16:at // 16 * 16 + 16]
            paths[leaf].append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
            place[leaf] = at // 16
        digests = [h(*digests[i:i + 16]) for i in range(0, len(digests), 16)]
    return digests[0], paths


def plain(rows):
    """Per record (doc_id, source): leaf, subroot, root, path; sorted."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(*[r[c] for c in merkle.COLUMNS])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: plain_tree([x[2] for x in sorted(by[s])]) for s in names}
    root, outer = plain_tree([inner[s][0] for s in names])
    out = []
    for s, up in zip(names, outer, strict=True):
        for (has, doc_id, leaf), path in zip(sorted(by[s]), inner[s][1], strict=True):
            out.append((doc_id if has else None, s, leaf, inner[s][0], root, path + up))
    return sorted(out, key=repr)


def found(df):
    rows = merkle.manifest(df).collect()
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.path]) for r in rows), key=repr)


@pytest.mark.parametrize("sizes", [(1,), (257, 16, 17, 1, 3), (2,) * 17])
def test_equals_plain_trees(spark, sizes):
    rows = [(i * 100 + k, f"text {k}", None, f"s{i}é" if i else None, k) for i, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert found(docs) == plain(docs.collect())


def test_messy_rows(messy):
    """Nulls, empty and very long texts, repeated rows, clashing columns."""
    docs = messy.withColumns({"n_chars": F.length("text").cast("long"), "digest": F.lit(1), "pos": F.lit("x"), "tree": F.lit(2)})
    assert found(docs) == plain(docs.collect())


def test_empty(nothing):
    assert merkle.manifest(nothing.withColumn("n_chars", F.lit(1))).collect() == []


def test_folding_finds_every_change(spark):
    docs = C.read(spark, SF_SMALL, "documents").limit(60)
    m = merkle.manifest(docs, F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))))
    rows = m.select("doc_id", "root", merkle.folded(F.coalesce("seen", "leaf"), F.col("path")).alias("fold")).collect()
    assert all((r.fold == r.root) == (r.doc_id % 2 == 1) for r in rows)


def test_query_against_plain(spark):
    docs = C.read(spark, SF_SMALL, "documents").collect()
    want = {r[0]: r for r in plain(docs)}
    text = {r.doc_id: r for r in docs}
    rows = merkle.op12_merkle(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        _, _, leaf, subroot, root, path = want[r.doc_id]
        d, fold = text[r.doc_id], leaf
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and d.text is not None:
            low = d.text.translate({c: c + 32 for c in range(65, 91)})
            fold = plain_leaf(d.doc_id, d.source, d.lang, d.n_chars, low)
        for left, right in path:
            fold = h(left, fold, right)
        proof = h(*[left + right for left, right in path])
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (
            leaf, subroot, root, proof, fold, fold == root)
    assert {r.verified for r in rows} == {True, False}
