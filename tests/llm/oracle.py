"""Compares a registered query with its SQL in DuckDB on the tables of a folder."""

import os


def compare(spark, name, sf_dir, tables=("documents", "benchmark", "embeddings", "pages", "labels", "conversations")):
    import duckdb

    from tabulon.llm import queries

    con = duckdb.connect()
    for t in tables:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    df = queries.QUERIES[name](spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(df.columns) == sorted(want[0] if want else df.columns)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a == b
