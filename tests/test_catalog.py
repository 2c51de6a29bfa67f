"""Every query of the log engine against its SQL, at the smallest scale."""

import os

import pytest

from emberlog import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    return con


def plain(v):
    return repr(round(v, 9) if isinstance(v, float) else v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    found = duck.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in rows) == want
