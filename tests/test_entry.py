"""Every core query against its SQL on the smallest tables."""

import collections
import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexframe.plans import general, more, queries

DATA = os.environ.get("LEXFRAME_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
CORE = {**queries.QUERIES, **general.QUERIES, **more.QUERIES}
CORE_SQL = {**queries.SQL, **general.SQL, **more.SQL}


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = CORE[name](spark, DATA)
    cols = sorted(df.columns)
    ours = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(CORE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    theirs = collections.Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(CORE) - set(CORE_SQL)))
def test_query_runs(spark, name):
    assert CORE[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
