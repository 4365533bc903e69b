import glob
import os

import duckdb
import pytest
from factloom.llm import queries

DATA = os.environ.get("FACTLOOM_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name in queries.ORACLES:
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        got = con.execute(queries.ORACLES[name])
        at = [[x[0] for x in got.description].index(c) for c in sorted(df.columns)]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())
