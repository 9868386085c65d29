"""Concatenated JSON records: quotes, escapes, splits, truncation."""
import json

import pytest
from pyspark.sql import types as T

from cohortlens.sources import concatenated as K
from cohortlens.sources import nested as N

SCHEMA = T.StructType([T.StructField("a", T.StringType()),
                       T.StructField("b", T.ArrayType(T.StructType([T.StructField("c", T.LongType())])))])
RECORDS = [{"a": "x} {y"}, {"a": '}{"', "b": [{"c": 1}, {"c": 2}]}, {"a": "\\"}, {"a": '\\"}\\\\'}, {"a": "é}😀{"}, {},
           {"a": "line\nbreak", "b": []}, {"a": "[,]"}] * 7


def rows(df):
    return sorted((r.a or "", [x.c for x in r.b] if r.b is not None else None) for r in df.collect())


def want(records):
    return sorted((r.get("a") or "", [x["c"] for x in r["b"]] if "b" in r else None) for r in records)


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes: nearly every piece is in another task than the one before it."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("sep", ["", "\n", " ,\r\n", None])
def test_records_over_many_splits(spark, tmp_path, small_splits, sep):
    for k in range(2):
        dump = json.dumps(RECORDS, ensure_ascii=False, indent=1) if sep is None else sep.join(
            json.dumps(r, ensure_ascii=bool(k)) for r in RECORDS)
        (tmp_path / f"{k}.json").write_text(dump, encoding="utf-8")
    df = N.read_nested_json(spark, str(tmp_path), SCHEMA, "concatenated")
    assert rows(df) == want(RECORDS * 2)
    assert K.pieces(spark, str(tmp_path)).select("split").distinct().count() > 5


@pytest.mark.parametrize(("tail", "problem"), [
    ('{"a": "cut', "truncated"), ('{"a": 1, "b": [{"c": 1}', "truncated"), ('{"a": "x"', "truncated"), ("{", "truncated"),
    ("oops", "unexpected text"), ('{"a": nope}', "unparsable")])
def test_a_bad_record_is_reported(spark, tmp_path, tail, problem):
    (tmp_path / "f.json").write_text('{"a":"x} {y"}{"a":"z"}' + tail)
    got = K.read_concatenated(spark, str(tmp_path), SCHEMA, on_error="report")
    assert sorted((r.a or "", r._problem or "", r._text or "") for r in got.collect()) == [
        ("", problem, tail), ("x} {y", "", ""), ("z", "", "")]
    with pytest.raises(Exception, match=problem):
        K.read_concatenated(spark, str(tmp_path), SCHEMA).collect()


def test_empty_files_and_marks(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "blank.json").write_text(" \n\t")
    (tmp_path / "mark.json").write_bytes(b'\xef\xbb\xbf{"a":"m"}')
    (tmp_path / "none.json").write_text("[]\n")
    df = K.read_concatenated(spark, str(tmp_path), SCHEMA)
    assert rows(df) == [("m", None)]
