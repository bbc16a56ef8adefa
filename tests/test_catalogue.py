"""Every catalogued query against its SQL twin, on the smallest tables."""

import glob
import os

import pytest

from tests.conftest import TESTDATA

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables here")

if os.path.isdir(TESTDATA):
    import duckdb

    from wordmosaic.plans import catalogue, oracle

    NAMES = list(catalogue.QUERIES)
else:
    NAMES = []


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{TESTDATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    found = catalogue.QUERIES[name](spark, TESTDATA)
    rows = found.collect()
    if name not in oracle.ORACLE:
        assert found.columns
        return
    r = con.sql(oracle.ORACLE[name])
    columns = sorted(r.columns)
    assert columns == sorted(found.columns)
    at = [r.columns.index(c) for c in columns]
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted((tuple(near(x[c]) for c in columns) for x in rows), key=repr) == sorted((tuple(near(x[k]) for k in at) for x in r.fetchall()), key=repr)
