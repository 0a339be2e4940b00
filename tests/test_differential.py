"""Random statements, run here and in DuckDB: predicates and arithmetic trees, grouped aggregates, orders."""

import random

import pytest

from tabulon.plans.engine import Engine
from tabulon.sources.tables import Catalog

SF = "/root/testdata/sf0.001"
INTS, FLOATS, TEXTS = ("l_orderkey", "l_partkey", "l_linenumber"), ("l_quantity", "l_extendedprice", "l_discount"), ("l_returnflag", "l_linestatus")


def number(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([*INTS, *FLOATS, str(rng.randint(0, 50)), f"NULLIF(l_linenumber, {rng.randint(1, 7)})"])
    return f"({number(rng, depth - 1)} {rng.choice('+-*')} {number(rng, depth - 1)})"


def predicate(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        kind = rng.randint(0, 5)
        if kind == 0:
            return f"{rng.choice(TEXTS)} {rng.choice(['=', '<>', '<', '>='])} '{rng.choice('AFNOR')}'"
        if kind == 1:
            return f"{rng.choice(INTS)} {rng.choice(['', 'NOT '])}BETWEEN {rng.randint(0, 20)} AND {rng.randint(20, 900)}"
        if kind == 2:
            return f"{rng.choice(INTS)} {rng.choice(['', 'NOT '])}IN ({', '.join(str(rng.randint(0, 9)) for _ in range(3))})"
        if kind == 3:
            return f"NULLIF(l_linenumber, {rng.randint(1, 7)}) IS {rng.choice(['', 'NOT '])}NULL"
        if kind == 4:
            return f"{rng.choice(TEXTS)} LIKE '{rng.choice(['A%', '%F', '_', '%'])}'"
        return f"{number(rng, 1)} {rng.choice(['=', '<>', '<', '<=', '>', '>='])} {number(rng, 1)}"
    return rng.choice([f"({predicate(rng, depth - 1)} AND {predicate(rng, depth - 1)})", f"({predicate(rng, depth - 1)} OR {predicate(rng, depth - 1)})", f"(NOT {predicate(rng, depth - 1)})"])


def query(rng):
    where = f"WHERE {predicate(rng, 3)}"
    if rng.random() < 0.5:
        return f"SELECT l_orderkey, l_linenumber, {number(rng, 2)} AS x FROM lineitem {where} ORDER BY l_orderkey, l_linenumber, x NULLS LIMIT {rng.randint(1, 60)} OFFSET {rng.randint(0, 9)}"
    keys = rng.sample(TEXTS, rng.randint(1, 2))
    arg = rng.choice([*INTS, "NULLIF(l_linenumber, 3)"])
    return f"SELECT {', '.join(keys)}, count(*) AS n, count({arg}) AS c, min({arg}) AS lo, max({arg}) AS hi, count(DISTINCT {arg}) AS d FROM lineitem {where} GROUP BY {', '.join(keys)} HAVING count(*) > {rng.randint(0, 40)}"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("seed", range(40))
def test_random_statement(spark, seed):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    sql = query(random.Random(seed))
    engine = Engine(spark, Catalog(spark).load(SF, ("lineitem",)))
    got = [tuple(map(plain, r)) for r in engine.execute(sql.replace(" NULLS", "")).collect()]
    want = [tuple(map(plain, r)) for r in con.execute(sql.replace("x NULLS", "x NULLS FIRST")).fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key), sql
