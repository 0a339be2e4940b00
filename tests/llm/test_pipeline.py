import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import corpus_pipeline
from tabulon.llm import quality, simhash
from test_decontam import leaked
from test_secrets import base


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(docs, least=0.8):
    """Least doc_id of each document's component over all pairs at that similarity."""
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            a, b = sets[x], sets[y]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and (a == b or len(a & b) >= least * len(a | b)):
                lo, hi = sorted((root(x), root(y)))
                up[hi] = lo
    return {d: root(d) for d in ids}


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """Input and output of every stage at sf0.01."""
    d, out = "/root/testdata/sf0.01", []
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, d).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return {name: (a, b, c) for name, a, b, c in out}


def test_columns(outputs):
    for name, (_, _, columns) in outputs.items():
        if name != "packing":
            assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_clean_and_drops_junk(outputs, spark):
    before, after, _ = outputs["quality"]
    kept = {r.doc_id for r in after}
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [d for d in label if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(d in kept for d in held if label[d] == 1) >= 0.97 * sum(label[d] == 1 for d in held)
    assert sum(d in kept for d in held if label[d] == 0) <= 0.25 * sum(label[d] == 0 for d in held)
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}


def test_near_dedup_keeps_the_first_of_each_group(outputs):
    before, after, _ = outputs["near_dedup"]
    want = {d for d, r in groups([(r.doc_id, r.text) for r in before]).items() if d == r}
    got = {r.doc_id for r in after}
    assert want <= got and len(got - want) <= 0.002 * len(before)


def test_decontamination_matches_brute_force(outputs, spark):
    before, after, _ = outputs["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    want = {r.doc_id for r in before} - leaked([(r.doc_id, r.text) for r in before], items)
    assert {r.doc_id for r in after} == want and len(want) < len(before)


def test_secrets_are_masked_and_rows_stay(outputs):
    before, after, _ = outputs["secrets"]
    now = {r.doc_id: r for r in after}
    assert now.keys() == {r.doc_id for r in before}
    for r in before:
        new = now[r.doc_id]
        assert new.n_chars == len(new.text) and base(new.text) == ""
        assert (new.text != r.text) >= bool(base(r.text))
        assert new.text == r.text or "<secret>" in new.text


def test_packing_covers_every_document(outputs):
    before, after, _ = outputs["packing"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    assert len({(r.sequence_id, r.offset) for r in after}) == len(after)


def test_near_copies_at_the_edges(spark):
    words = [f"w{i}" for i in range(200)]
    near = words[:100] + ["other"] + words[101:]
    far = words[:60] + ["x"] * 80 + words[140:]
    rows = [(5, " ".join(words)), (3, " ".join(near).upper()), (9, " ".join(far)), (7, None), (8, ""), (1, "a b"), (2, "a  B"), (2, "a  B"), (4, "b a"), (6, " ".join(words))]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.keep_id) for r in simhash.similar_groups(df).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 3), (6, 3), (7, 7), (8, 7), (9, 9)]
    assert sorted(r.doc_id for r in simhash.without_near_copies(df).collect()) == [1, 3, 4, 7, 9]
    assert simhash.without_near_copies(df.limit(0)).collect() == []


def test_near_copies_of_one_hub_are_one_group(spark):
    """Copies of one original that are no near copies of each other: each must be tried against the original, whatever is nearer by bits."""
    rng = random.Random(3)
    new = lambda n: ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]
    rows = []
    for hub in range(3):
        words = new(200)
        rows.append((1000 * hub, " ".join(words)))
        for i in range(1, 301):
            copy = list(words)
            for at in rng.sample(range(5, 195), 4):
                copy[at] = new(1)[0]
            rows.append((1000 * hub + i, " ".join(copy)))
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows)


def test_cut_and_extended_copies_are_met(spark):
    """Pairs without nearer copies whose fingerprints may lie far apart: a block is cut off or added."""
    rng = random.Random(4)
    new = lambda n: ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]
    rows = []
    for i in range(400):
        words = new(rng.randrange(50, 150))
        n = len(words)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: n - n * rng.randrange(8, 19) // 100] if i % 2 else words + new(n * rng.randrange(8, 25) // 100)))]
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = groups(rows)
    assert got == want and sum(d != k for d, k in want.items()) > 300


def test_frequent_shingles_last_give_the_same_groups(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 3000")
    monkeypatch.setattr(simhash, "_SAMPLED", 1)
    assert len(simhash._frequent(docs.selectExpr("doc_id", "cast(text as binary) text"), 5))
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(docs).collect()}
    assert got == groups([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_at_scale_match_a_search_over_shared_shingles(spark):
    """All 10,000 texts of sf0.1: the groups are those of every pair that is 0.8 similar, found by counting shared shingles."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    sets = {d: shingles(t) for d, t in rows}
    having = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    shared = Counter()
    for ids in having.values():
        if len(ids) > 1:
            shared.update(combinations(sorted(ids), 2))
    up = {d: d for d in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    empty = sorted(d for d, s in sets.items() if not s)
    for a, b in pairs + list(zip(empty, empty[1:], strict=False)):
        lo, hi = sorted((root(a), root(b)))
        up[hi] = lo
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: root(d) for d in sets} and len(pairs) > 30


def test_rows_of_one_id_or_none(spark):
    rows = [(1, "b c", "x"), (1, "a b", "y"), (1, None, "z"), (None, "q", "u"), (None, "q", "v"), (3, "other", "w")]
    for order in (rows, rows[::-1]):
        got = simhash.without_near_copies(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted([(1, "a b", "y"), (None, "q", "u"), (None, "q", "v"), (3, "other", "w")], key=repr)
