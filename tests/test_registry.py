"""Every registered query against its SQL."""

import os

import pytest

from tabulon.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    key = lambda r: repr(sorted((k, plain(v)) for k, v in r.items()))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert {k: plain(v) for k, v in a.items()} == {k: plain(v) for k, v in b.items()}
