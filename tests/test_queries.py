import glob
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("FACTLOOM_DATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.core.QUERIES, entry.core.ORACLES


def plain(v):
    if v is None or isinstance(v, (str, bytes, bytearray)):
        return v
    if isinstance(v, (bool, np.bool_)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    f = float(v)
    return "nan" if math.isnan(f) else float(f"{f:.9g}") + 0.0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*cols).collect())
    if name in ORACLES:
        got = duck.execute(ORACLES[name])
        names = [x[0] for x in got.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
