import collections
import os

import duckdb
import pytest

from lexframe.llm import queries

DATA = os.environ.get("LEXFRAME_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name in queries.SQL:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
        rel = con.execute(queries.SQL[name])
        cols = [c[0] for c in rel.description]
        assert collections.Counter(tuple(r[c] for c in cols) for r in rows) == collections.Counter(rel.fetchall())
