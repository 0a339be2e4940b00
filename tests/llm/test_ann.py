import numpy as np
import pytest

from tabulon.llm import ann


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_the_whole_table(spark, sf):
    from tabulon.llm.queries import QUERIES

    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    ids, x = t.vec_id.to_numpy(), np.array(t.embedding.tolist(), float)
    want, got = brute(ids, x, 20), by_query(QUERIES["op4_neighbours"](spark, f"/root/testdata/{sf}").collect())
    assert want.keys() == got.keys() and all(len(v) == 20 for v in got.values())
    place = {int(i): n for n, i in enumerate(ids)}
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s - float(x[place[q]] @ x[place[v]])) < 1e-12 for v, s in found)
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_lengths_copies_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * rng.exponential(size=(300, 1))
    x = np.concatenate([x, np.repeat(x[:1], 150, axis=0), np.repeat(x[5:6] * 2, 40, axis=0)])
    df = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int")
    got = by_query(ann.nearest(df, lambda i: i % 20 == 0, k=20, leaf_rows=1000).collect())
    assert got == brute(np.arange(len(x)), x, 20)  # one leaf a tree: exact


def test_bad_vectors_and_small_tables(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [1.0]), (120, []), (1, [1.0, 1.0]), (2, [2.0, 1.0]), (3, [float("inf"), 1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert by_query(ann.nearest(df, lambda i: i % 20 == 0).collect()) == {0: [(2, 2.0), (1, 1.0)]}
    assert ann.nearest(df.where("vec_id = 20"), lambda i: i % 20 == 0).collect() == []
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).collect() == []
