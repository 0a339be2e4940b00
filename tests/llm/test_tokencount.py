import random

import pytest

from tabulon.llm import tokencount


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_greedy_matching(seed):
    rng = random.Random(seed)
    letters = "abc"[: rng.choice([2, 3])]
    word = lambda n: "".join(rng.choices(letters, k=rng.randint(1, n)))
    for _ in range(60):
        heads, tails = {word(5) for _ in range(rng.randint(0, 12))}, {word(5) for _ in range(rng.randint(0, 12))}
        automaton = tokencount.Automaton(heads, tails)
        for _ in range(60):
            w = word(14)
            assert automaton.count(w) == tokencount.greedy_count(w, heads, tails), (w, heads, tails)


def test_query_matches_greedy_matching(spark, sf_dir):
    from tabulon.llm.queries import QUERIES

    heads, tails = tokencount.piece_vocabulary()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_tokencount"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        counts = [tokencount.greedy_count(w.decode(), heads, tails) for w in r.text.encode().split()]
        assert got[r.doc_id] == (len(counts), sum(1 if c < 0 else c for c in counts), counts.count(-1))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "ab ab"), (4, "ab ab"), (5, "ab " * 200_000), (6, "é" * 500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = sorted(tuple(r) for r in tokencount.token_counts(df, {"a", "ab"}, {"b"}).collect())
    assert got == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 2, 2, 0), (4, 2, 2, 0), (5, 200_000, 200_000, 0), (6, 1, 1, 1)]
    assert tokencount.token_counts(df.limit(0), {"a"}, set()).collect() == []


def test_words_of_any_length_are_matched(spark):
    rng = random.Random(5)
    heads, tails = {"a", "ab", "abb"}, {"a", "b", "ba", "bab"}
    word = "a" + "".join(rng.choices("ab", k=99_999))
    want, at = 0, 0
    while at < len(word):  # greedy, by pieces of three letters at most
        at += next(n for n in (3, 2, 1) if word[at : at + n] in (tails if at else heads))
        want += 1
    df = spark.createDataFrame([(1, word), (2, word + "x"), (3, "a" * 201)], "doc_id long, text string")
    got = sorted(tuple(r) for r in tokencount.token_counts(df, heads, tails).collect())
    assert got == [(1, 1, want, 0), (2, 1, 1, 1), (3, 1, 201, 0)]
    assert tokencount.token_counts(df.where("doc_id = 3"), heads, tails, max_word=200).first()[1:] == (1, 1, 1)
