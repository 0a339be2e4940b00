import random

import numpy as np
import pytest
import xxhash

from tabulon.llm import simhash


def fp_of(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, radius):
    """Least doc_id of each one's component over all pairs."""
    ids = list(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= radius:
                a, b = sorted((root(x), root(y)))
                up[b] = a
    return {i: root(i) for i in ids}


def test_query_matches_brute_force(spark, sf_dir):
    from tabulon.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op6_simhash"](spark, sf_dir).collect()}
    fps = {r.doc_id: fp_of(r.text) for r in docs}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute(fps, 4)


@pytest.mark.parametrize("radius", [1, 4, 6])
def test_links_are_exact_on_dense_clusters(spark, radius):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))))
    fps = {i: f for i, f in enumerate(sorted(fps))}
    from tabulon.llm._store import Scratch

    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps.values()], "fp long")
    edges = simhash.linked_fingerprints(df, radius, Scratch(spark, "t")).collect()
    name = {f: i for i, f in fps.items()}
    as_id = lambda x: name[x % (1 << 64)]
    groups = {as_id(a): as_id(b) for a, b in edges}
    want = brute(fps, radius)
    parts = lambda label: {frozenset(i for i in fps if label(i) == r) for r in {label(i) for i in fps}}
    assert parts(lambda i: groups.get(i, i)) == parts(want.get)


def test_large_bucket_is_split_without_loss():
    rng = np.random.default_rng(3)
    centre = np.uint64(0x0123456789ABCDEF)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(6000)], np.uint64)
    members = np.unique(centre ^ flips)
    rows = simhash._Rows(members, np.zeros_like(members), np.arange(len(members)), 4, 0)
    found = np.concatenate(rows.links(np.arange(len(members)), np.arange(0)), axis=1)
    got = simhash.forest(len(members), found[0], found[1])
    i, j = np.nonzero(np.bitwise_count(members[:, None] ^ members[None, :]) <= 4)
    assert (got == simhash.forest(len(members), i, j)).all()


def test_nearest_edges_hold_a_minimum_spanning_forest():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 10, 120).astype(np.uint64)
    rows = simhash._Rows(fp, np.zeros_like(fp), np.arange(120), 4, 2)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))
    kept = rows.reduce(np.stack([i, j]))
    assert kept.shape[1] <= 4 * 120
    for d in range(5):  # the same components at every distance
        label = [simhash.forest(120, *e[:, np.bitwise_count(fp[e[0]] ^ fp[e[1]]) <= d]) for e in (np.stack([i, j]), kept)]
        assert (label[0] == label[1]).all()


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t\n", "z"), (4, "One two", "a"), (5, "one TWO", "b"), (5, "one TWO", "b"), (6, "w " * 200_000, "c")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6)]
    assert {r.fingerprint for r in out if r.doc_id < 4} == {"0" * 16}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
