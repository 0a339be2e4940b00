import hashlib
import random
import re

import pytest

from oracle import compare
from tabulon.llm import decontam


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=13):
    out = []
    for doc, text in docs:
        w, hit, names = tokens(text), set(), set()
        for name, t in items:
            v = tokens(t)
            n = min(window, len(v))
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def leaked(docs, items, window=13):
    """Ids of texts with a whole window of an item, or of which shorter items are a twentieth or more."""
    out = set()
    long = [(i, t) for i, t in items if len(tokens(t)) >= window]
    for row in docs:
        if brute([row], long)[0][2] or brute([row], items)[0][5]:
            out.add(row[0])
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_leaks_in_long_texts_go_and_short_items_need_a_share(spark, block):
    rng = random.Random(12)
    new = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    items = [(i, " ".join(new(rng.choice([3, 13, 20, 40])))) for i in range(30)]
    docs = []
    for i in range(80):
        w, t = new(rng.choice([20, 100, 3000])), tokens(rng.choice(items)[1])
        at = rng.randrange(len(w))
        w[at:at] = t[: rng.choice([0, 5, 12, 13, 99])]
        docs.append((i, " ".join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    gone = leaked(docs, items)
    assert 10 < len(gone) < 70 and any(len(tokens(t)) > 2000 for i, t in docs if i in gone)
    assert {r.doc_id for r in decontam.without_contaminated(d, b, block_bytes=block).collect()} == {i for i, _ in docs} - gone


def test_oracle(spark, sf_dir):
    compare(spark, "op9_winnowing", sf_dir)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_random_texts_match_brute_force(spark, block):
    rng = random.Random(11)
    vocab = ["a", "b", "c", "Dd", "é", "x1"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 5, 8, 12, 13, 14, 30])))) for i in range(25)] + [(90, None), (91, "..."), (92, "")]
    docs = []
    for i in range(60):
        w = rng.choices(vocab + ["zz", "yy", "qq"], k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            t = tokens(rng.choice(items)[1])
            w[5:5] = t[rng.randint(0, 3) :]
        docs.append((i, " , ".join(w)))
    docs += [(3, docs[3][1]), (100, None), (101, ""), (102, "word " * 100_000)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.contamination(d, b, block_bytes=block).collect())
    assert got == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.contamination(d, b).collect()] == [False]
    assert decontam.contamination(d.limit(0), b).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_items_without_an_id_count(spark, block):
    text = "the quick brown fox jumps over one lazy dog near that old barn"
    d = spark.createDataFrame([(1, text), (2, "other words here")], "doc_id long, text string")
    b = spark.createDataFrame([(None, text), (7, "no such words"), (8, "nor any of these words at all")], "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.contamination(d, b, block_bytes=block).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got == {1: (13, 13, 0, none, True), 2: (3, 0, 0, none, False)}
    assert [r.doc_id for r in decontam.without_contaminated(d, b, block_bytes=block).collect()] == [2]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_rows_of_one_id_or_none_are_judged_each_by_itself(spark, block):
    text, other = "the quick brown fox jumps over one lazy dog near that old barn", "a b c d e f g h i j k l m"
    rows = [(1, text), (1, other), (None, text), (None, other), (2, "clean"), (2, text)]
    items = [(7, text), (8, "nor any of these words at all")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0] or 0, *r[1:])
    got = sorted((tuple(r) for r in decontam.contamination(d, b, block_bytes=block).collect()), key=key)
    assert got == sorted((brute([r], items)[0] for r in rows), key=key)
    kept = [tuple(r) for r in decontam.without_contaminated(d, b, block_bytes=block).collect()]
    assert sorted(kept, key=key) == [(None, other), (1, other), (2, "clean")]
