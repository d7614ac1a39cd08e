"""The queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomtext import queries as records

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = records.queries(), records.oracle_sql()


def _norm(v):
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = db.sql(ORACLES[name])
    cols = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    a = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    assert a == sorted(repr(tuple(_norm(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert "pii_drop" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
