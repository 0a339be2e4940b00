import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import hpylm
from tabulon.llm._store import Scratch
from tabulon.llm._text import span_hashes

END = "\n"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def code(word):
    """Hash of a word, as the model has it."""
    if word == END:
        return int(hpylm.END)
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0])


def plain_probability(model, m):
    """P(word after word before), looked up in the collected model."""
    rows = defaultdict(dict)
    parent = {}
    for r in model.collect():
        for x, c, t in zip(r.ctx, r.cs, r.ts, strict=True):
            rows[r.w][x] = (c, t)
        parent[r.w] = m.frequent[r.w] if 0 <= r.w < len(m.frequent) else m.root(r.customers, r.tables)

    def number(word):
        h = np.array([code(word)])
        return h, m.vocabulary.numbered(h)

    def p(before, word):
        h, n = number(before)
        ctx = int(m.vocabulary.context(n, h)[0])
        h, n = number(word)
        w = int(m.vocabulary.coded(n, h)[0])
        c, t = rows.get(w, {}).get(ctx, (0, 0))
        return (c - m.d * t) * float(m.inverse[ctx]) + float(m.backoff[ctx]) * parent.get(w, m.unseen)

    return p


def test_counts_and_base_match_brute_force_and_model_beats_it(spark):
    from tabulon.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in texts.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op3_hpylm"](spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ws = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws)
        assert r.score < 0
    test = [r for r in rows if r.held_out]
    per = lambda rows, k: sum(r[k] for r in rows) / sum(r.n_tokens for r in rows)
    assert per(test, "score") > per(test, "base_score") + 0.4
    assert per([r for r in rows if not r.held_out], "score") > per(test, "score") + 1


@pytest.mark.parametrize(("frequent", "pairs"), [(200, 500), (5, 3), (100_000, 0)])
def test_scores_match_a_plain_lookup(spark, frequent, pairs):
    """Wherever a token is looked up (in place, by its pair, by its word), its probability is the model's."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = lambda i: i % 5 == 2
    model, m = hpylm.train(docs.where("doc_id % 5 <> 2").select("text"), Scratch(spark, "t"), frequent)
    p = plain_probability(model, m)
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    for r in hpylm.score(docs, fold, frequent=frequent, most_pairs=pairs).collect():
        ws = texts[r.doc_id]
        want = sum(math.log10(p(a, b)) for a, b in zip([END, *ws], ws, strict=False))
        assert abs(r.score - want) < 1e-4 * max(1, abs(want))


def test_probabilities_sum_to_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    model, m = hpylm.train(docs, Scratch(spark, "t"), 300)
    total, roots = np.zeros(m.vocabulary.contexts), {}
    for r in model.collect():
        total[r.ctx] += (np.array(r.cs) - m.d * np.array(r.ts)) * m.inverse[r.ctx]
        roots[r.w] = m.frequent[r.w] if 0 <= r.w < len(m.frequent) else m.root(r.customers, r.tables)
    assert len(roots) == m.vocabulary.words
    assert abs(sum(roots.values()) + m.unseen - 1) < 1e-6
    assert np.abs(total + m.backoff - 1).max() < 1e-4


def seated_one_by_one(bigrams, d, theta, d0, theta0, sweeps, seed):
    """Mean probabilities of a sampler that takes out and seats again one customer at a time."""
    rng = random.Random(seed)
    vocab = sorted({w for _, w in bigrams})
    low, high = defaultdict(list), defaultdict(list)  # (context, word) and word to the customers of their tables
    customers, tables = Counter(), Counter()

    def root(w):
        c, t = sum(map(sum, high.values())), sum(map(len, high.values()))
        return (sum(high[w]) - d0 * len(high[w]) + (theta0 + d0 * t) / (len(vocab) + 1)) / (theta0 + c)

    def pick(weights):
        at = rng.random() * sum(weights)
        for i, x in enumerate(weights):
            at -= x
            if at < 0:
                return i
        return len(weights) - 1

    def seat(sizes, opened, discount):
        i = pick([n - discount for n in sizes] + [opened])
        if i < len(sizes):
            sizes[i] += 1
            return False
        sizes.append(1)
        return True

    def seat_root(w):
        t = sum(map(len, high.values()))
        seat(high[w], (theta0 + d0 * t) / (len(vocab) + 1), d0)

    def leave(sizes):
        i = pick(sizes)
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            return True
        return False

    def add(u, w):
        if seat(low[u, w], (theta + d * tables[u]) * root(w), d):
            tables[u] += 1
            seat_root(w)
        customers[u] += 1

    for u, w in bigrams:
        add(u, w)
    mean, n = Counter(), 0
    for sweep in range(sweeps):
        for u, w in bigrams:
            customers[u] -= 1
            if leave(low[u, w]):
                tables[u] -= 1
                leave(high[w])
            add(u, w)
        if sweep > sweeps // 10:
            n += 1
            roots = {w: root(w) for w in vocab}
            for u in {u for u, _ in bigrams}:
                for w in vocab:
                    mean[u, w] += (sum(low[u, w]) - d * len(low[u, w]) + (theta + d * tables[u]) * roots[w]) / (theta + customers[u])
    return {k: x / n for k, x in mean.items()}


def test_small_corpus_agrees_with_seating_one_customer_at_a_time(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("a b c d e f".split(), [6, 4, 2, 1, 1, 1], k=rng.randrange(4, 14))) for _ in range(25)]
    monkeypatch.setattr(hpylm, "CHAINS", 300)
    monkeypatch.setattr(hpylm, "PASSES", 6)
    monkeypatch.setattr(hpylm, "INNER", 8)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    model, m = hpylm.train(docs, Scratch(spark, "t"), 5)
    p = plain_probability(model, m)
    bigrams = [x for t in texts for x in zip([END, *words(t)], words(t), strict=False)]
    # Words that share a restaurant by hash are one context here too.
    h = lambda u: np.array([code(u)])
    context = {u: int(m.vocabulary.context(m.vocabulary.numbered(h(u)), h(u))[0]) for u, _ in bigrams}
    of = {v: k for k, v in context.items()}
    runs = [seated_one_by_one([(context[u], w) for u, w in bigrams], m.d, m.theta, m.d0, m.theta0, 400, s) for s in range(3)]
    for (x, w), a in runs[0].items():
        want = np.mean([r[x, w] for r in runs])
        assert abs(p(of[x], w) - want) < 0.004 + 0.02 * want + 2 * np.std([a, *(r[x, w] for r in runs)])


def shared_once():
    """Two words that a hash of 17 bits gives one restaurant."""
    seen = {}
    for i in range(10_000):
        place = int(hpylm.mix(np.array([code(f"q{i}")]).view(np.uint64))[0]) % (1 << 17)
        if place in seen:
            return seen[place], f"q{i}"
        seen[place] = f"q{i}"


def test_every_word_has_a_restaurant_of_its_own(spark):
    """Contexts that are not frequent words, before words that are (a, b) and that are not (x, y)."""
    u, v = shared_once()
    texts = [f"{u} a", f"{v} b", f"{u} x", f"{v} y"] * 6 + ["a b"] * 30
    asked = [f"{u} a", f"{u} b", f"{v} a", f"{v} b", f"{u} x", f"{u} y", f"{v} x", f"{v} y"]
    docs = spark.createDataFrame([*enumerate(texts, 100), *enumerate(asked)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in hpylm.score(docs, lambda i: i < 100, frequent=3).collect()}
    for i in (0, 4):  # log10 of P(a | u) P(b | v) / P(b | u) P(a | v): 0 in one restaurant
        assert score[i] + score[i + 3] - score[i + 1] - score[i + 2] > 1
    _, m = hpylm.train(docs.where("doc_id >= 100").select("text"), Scratch(spark, "t"), 3)
    h = np.array([code(u), code(v), code("never")])
    context = m.vocabulary.context(m.vocabulary.numbered(h), h)
    assert len(set(context.tolist())) == 3
    assert np.allclose(1 / m.inverse[context] - m.theta, [12, 12, 0], rtol=1e-5, atol=1e-5)


def test_far_pairs_agree_with_seating_one_customer_at_a_time(spark, monkeypatch):
    """As above, but of two frequent words only, so that contexts and words that are not exchange what they have drawn."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("a b c d e f".split(), [3, 3, 2, 2, 1, 1], k=rng.randrange(4, 14))) for _ in range(25)]
    monkeypatch.setattr(hpylm, "CHAINS", 200)
    monkeypatch.setattr(hpylm, "PASSES", 6)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    model, m = hpylm.train(docs, Scratch(spark, "t"), 2)
    p = plain_probability(model, m)
    bigrams = [x for t in texts for x in zip([END, *words(t)], words(t), strict=False)]
    runs = [seated_one_by_one(bigrams, m.d, m.theta, m.d0, m.theta0, 400, s) for s in range(3)]
    for (u, w), a in runs[0].items():
        want = np.mean([r[u, w] for r in runs])
        assert abs(p(u, w) - want) < 0.004 + 0.02 * want + 2 * np.std([a, *(r[u, w] for r in runs)])


def test_invented_words_score_below_prose(spark):
    rng = random.Random(6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(-7 * i - 5, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(200))) for i in range(40)]
    both = docs.union(spark.createDataFrame(odd, docs.schema))
    rows = [r for r in hpylm.score(both, lambda i: F.pmod(i, F.lit(7)) == 2).collect() if r.held_out]
    prose, odd_ = [r for r in rows if r.doc_id >= 0 and r.n_tokens > 50], [r for r in rows if r.doc_id < 0]
    assert len(odd_) == 40 and all(r.n_known == 1 for r in odd_)
    per = lambda r: r.score / r.n_tokens
    assert max(map(per, odd_)) < np.quantile(list(map(per, prose)), 0.05)
    assert max(map(per, odd_)) < np.mean([r.base_score / r.n_tokens for r in odd_]) + 0.5


def test_table_numbers_follow_their_weights():
    rng = np.random.default_rng(0)
    for c, x, d in ((5, 0.7, 0.6), (20, 3.0, 0.4)):
        s = hpylm.stirling(d)
        t = np.arange(1, c + 1)
        p = np.exp(s[c, 1 : c + 1] + t * np.log(x))
        p /= p.sum()
        got = np.bincount(hpylm.draw_tables(np.full(40_000, c), np.full(40_000, x), d, rng), minlength=c + 1)[1:] / 40_000
        assert np.abs(got - p).max() < 0.015


@pytest.mark.parametrize("d", [0.3, 0.6, 0.85])
@pytest.mark.parametrize("x", [0.001, 0.3, 3.0, 40.0, 400.0])
def test_many_customers_come_near_the_weights(d, x):
    """Where the table of weights ends, their limit for many customers takes over: c - d * t, of which probabilities are made, is within 2 %."""
    rng, c = np.random.default_rng(1), hpylm.EXACT
    exact = hpylm.draw_tables(np.full(4000, c), np.full(4000, x), d, rng)
    near = hpylm._many(np.full(4000, c), np.full(4000, x), d, rng)
    assert abs((c - d * near).mean() / (c - d * exact).mean() - 1) < 0.02


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "A b a"), (3, "A b a"), (4, "a " * 150_000), (9, "zz new"), (None, "b")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = hpylm.score(df, lambda i: F.col("doc_id") == 9).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in got) == [(0, 2, 2), (1, 1, 1), (2, 1, 1), (3, 4, 4), (3, 4, 4), (4, 150_001, 150_001), (9, 3, 1)]
    assert {r.held_out for r in got} == {True, False}
    assert {r.train_tokens for r in got} == {1 + 1 + 4 + 4 + 150_001 + 2}
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    none = hpylm.score(df, lambda i: F.lit(True)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in none)
    assert hpylm.score(df.limit(0), lambda i: F.col("doc_id") == 9).collect() == []


def test_blocks_hold_rows_as_they_were(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(hpylm, "BLOCK", 3)
    rows = [(-5 << 40, [1, 2], [1, 1 << 40], 0, 0, True, [], []), (7, [], [], 2, 0, False, [-3], [2]), (8, [4], [9], 1, 1, False, [], []), *((20 + i, [i] * i, [1] * i, i, 1, False, [-i], [i]) for i in range(5))]
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], hpylm._columns(hpylm.ROW))
    blocks = list(hpylm._blocks(iter)([batch.slice(0, 2), batch.slice(2), batch.slice(0, 0)]))
    assert [x.num_rows for x in blocks] == [1] * 4 and blocks[0].schema.field("w").type == pa.binary() and {(x["side"][0].as_py(), x["crossed"][0].as_py()) for x in blocks} == {(0, True), (0, False), (1, False)}
    back = pa.Table.from_batches(hpylm._opened(iter)(blocks))
    assert back.schema == batch.schema and sorted(back.to_pylist(), key=str) == sorted(batch.to_pylist(), key=str)
    some = [x.select(["w", "ctx", "side"]) for x in blocks]
    assert pa.Table.from_batches(hpylm._opened(iter)(some)).to_pylist() == back.select(["w", "ctx", "side"]).to_pylist()


def test_pairs_worked_on_at_once_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(hpylm, "VALUES", 100, raising=False)
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([[1] * 60], pa.list_(pa.int32())), pa.array([[2] * 60], pa.list_(pa.int64()))], ["w", "ctx", "cs"]) for i in range(5)]
    assert [list(w) for _, w, *_ in hpylm._rows(batches)] == [[0, 1], [2, 3], [4]]


def test_what_is_exchanged_is_packed(spark, monkeypatch):
    """Words, crossed names and letters travel as a few rows for each task (a row for each word, name or pair before: CPU seconds)."""
    rng = random.Random(9)
    texts = [" ".join(x for i in rng.sample(range(300), 60) for x in (f"u{i}", f"w{i % 150}")) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    saved, plans = {}, {}

    class Spied(Scratch):
        def save(self, df, name):
            out = super().save(df, name)
            saved[name], plans[name] = out.count(), df._jdf.queryExecution().analyzed().toString()
            return out

    _, m = hpylm.trained(docs, Spied(spark, "t"), 5)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert m.vocabulary.tokens == sum(len(words(t)) for t in texts) and m.vocabulary.words == len({w for t in texts for w in words(t)}) == saved["words"]
    assert 0 < saved["crossed"] <= 2 * tasks < 300
    assert all(0 < saved[x] <= tasks * (tasks + 1) for x in ("asked0", "letters0", "asked1", "letters1", "asked", "letters"))
    assert "Aggregate" not in plans["words"] and "value#" in plans["words"]


def test_places_in_sorted_hashes_are_those_of_a_search():
    rng = np.random.default_rng(2)
    far = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    for names in (far, np.arange(-40, 500), np.array([-5, -5, 3, 3, 3]), np.repeat(far[:50], 30), np.array([7]), np.zeros(0, np.int64)):
        names = np.sort(names)
        asked = np.concatenate([names, names + 1, rng.integers(-(1 << 63), (1 << 63) - 1, 500), [-(1 << 63), (1 << 63) - 1, 0]])
        at, found = hpylm.Sorted(names).find(asked)
        want = np.minimum(np.searchsorted(names, asked), max(len(names) - 1, 0))
        assert (at == want).all() and (found == np.isin(asked, names)).all()


def test_counts_of_one_pair_in_several_parts_are_added():
    for kind in (np.uint32, np.int64):
        parts = [(np.array([9, -4]), np.array([2, 1], np.uint32), np.array([7, 1, 5], kind), np.array([1, 2, 3], np.uint32)), (np.array([-4, 9, 2]), np.array([1, 1, 1], np.uint32), np.array([5, 7, 0], kind), np.array([4, 5, 6], np.uint32))]
        assert [x.tolist() for x in hpylm._merged(parts)] == [[-4, 2, 9, 9], [5, 0, 1, 7], [7, 6, 2, 6]]
