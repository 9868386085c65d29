"""Every query with an oracle matches DuckDB on sf0.01 (rows, columns, values)."""
import hashlib
import math

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_MID

ORACLE = entry.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_MID)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(rows, df.columns) == _digest(orows, ocols)


def test_every_query_has_a_docstring():
    for name, fn in entry.queries().items():
        assert fn.__doc__, name


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 1
    assert df.columns[:2] == ["feature", "bin"]
