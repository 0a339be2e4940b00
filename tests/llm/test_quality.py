import random

import numpy as np

from tabulon.llm import quality


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1.0
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    from tabulon.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    rows = QUERIES["op1_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    test = rows[rows.held_out & rows.quality.notna()]
    assert auc(test.score.to_numpy(), test.quality.to_numpy()) > 0.93
    assert (test.predicted == test.quality).mean() > 0.9


def test_rules_as_columns_equal_rules_as_arrays(spark):
    rng = np.random.default_rng(0)
    x = rng.random((800, len(quality.STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] < 0.7) | (x[:, 9] > 0.9)).astype(float)
    model = quality.learn(x, y)
    assert 0 < len(model.rules) < 150
    want = 1 / (1 + np.exp(-(model.bias + sum(w * r.holds(x) for w, r in model.rules))))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"_q_{s}" for s in quality.STATS])
    got = np.array([r[0] for r in df.select(model.score()).collect()])
    assert np.abs(got - want).max() < 1e-9
    assert ((got > 0.5) == (y == 1)).mean() > 0.97


def test_stats_by_hand():
    texts = [b"", b"AB ab ab.\nX** 12", b"|"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s = [dict(zip(quality.STATS, r, strict=True)) for r in quality.text_stats(data, offs)]
    assert not any(s[0].values())
    assert s[1]["n_words"] == 5 and s[1]["capital_word"] == 0.2 and s[1]["same_as_before"] == 0.2 and s[1]["distinct_words"] == 0.8
    assert s[1]["symbol_end"] == 0.2 and s[1]["sentence_end"] == 0.2 and s[1]["words_per_line"] == 2.5 and s[1]["digit"] == 2 / 16
    assert s[2]["bare_symbol"] == 1 and s[2]["n_words"] == 1


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "A b " * 200_000, 5.0), (3, "x", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == 4 and all(r.score > 0.99 and r.predicted == 1 for r in rows)
    assert quality.scored(docs.limit(0), model).collect() == []


def plain_stats(text):
    """The statistics of one text, counted plainly."""
    raw = (text or "").encode()
    words = raw.split()
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    lines = [x for x in raw.split(b"\n") if x]
    triples = [tuple(low[i : i + 3]) for i in range(len(low) - 2)]
    symbols = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    letters = lambda w: sum(65 <= b <= 90 or 97 <= b <= 122 for b in w)
    per = lambda a, b: a / b if b else 0.0
    n, size = len(words), len(raw)
    return {
        "n_bytes": size, "n_words": n, "word_len": per(sum(map(len, words)), n),
        "upper": per(sum(65 <= b <= 90 for b in raw), size), "digit": per(sum(48 <= b <= 57 for b in raw), size), "symbol": per(sum(b in symbols for b in raw), size),
        "space": per(sum(b == 32 or 9 <= b <= 13 for b in raw), size), "wide": per(sum(b >= 128 for b in raw), size),
        "symbol_end": per(sum(w[-1] in symbols and chr(w[-1]) not in ".,;:!?" for w in words), n),
        "bare_symbol": per(sum(letters(w) == 0 and w[-1] < 128 and not 48 <= w[-1] <= 57 for w in words), n),
        "capital_word": per(sum(sum(65 <= b <= 90 for b in w) >= 2 and not any(97 <= b <= 122 for b in w) for w in words), n),
        "distinct_words": per(len(set(low)), n), "same_as_before": per(sum(a == b for a, b in zip(low, low[1:], strict=False)), n),
        "distinct_triples": per(len(set(triples)), len(triples)), "words_per_line": per(n, len(lines)), "distinct_lines": per(len(set(lines)), len(lines)),
        "sentence_end": per(sum(w[-1:] == b"." for w in words), n), "top_word": per(max(map(low.count, set(low)), default=0), n),
    }


def test_stats_match_a_plain_count(spark):
    rng = random.Random(8)
    bits = ["a", "B", "AB", "Cd", "e.", "f,", "**", "9", "x9", "é", "É!", "|", "end.", "\n", "\n\n", "\t", " ", "日", "OK", "ok", "-"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [None, "", " ", "A " * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    for r in quality.with_stats(df).collect():
        want = plain_stats(texts[r.i])
        assert list(want) == list(quality.STATS)
        for name, x in want.items():
            assert abs(r[f"_q_{name}"] - x) < 1e-9, (name, texts[r.i])


def test_lasso_meets_the_conditions_of_its_optimum():
    """At the least of loss plus penalty, each weight's gradient is the penalty against its sign, or within it where the weight is zero."""
    rng = np.random.default_rng(3)
    r = (rng.random((3000, 12)) < 0.4).astype(np.float32)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 * r[:, 0] - 1.5 * r[:, 1] + 0.2)))).astype(float)
    penalty = 0.01
    w = quality._lasso(r, y, penalty, np.zeros(13), 3000)
    miss = 1 / (1 + np.exp(-(r @ w[:-1] + w[-1]))) - y
    slope = miss @ r / len(y)
    on = np.abs(w[:-1]) > 1e-6
    assert abs(miss.mean()) < 2e-3 and on[:2].all() and on.sum() < 8
    assert np.abs(slope[on] + penalty * np.sign(w[:-1][on])).max() < 2e-3 and (np.abs(slope[~on]) <= penalty + 2e-3).all()


def test_a_tree_takes_the_best_split_first():
    rng = np.random.default_rng(4)
    x = rng.random((500, 4))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for k in range(4)]
    codes = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    grad, hess = rng.normal(size=500) - (x[:, 2] > 0.4), np.ones(500)
    best = max(((grad[x[:, k] <= t].sum() ** 2 / ((x[:, k] <= t).sum() + 1) + grad[x[:, k] > t].sum() ** 2 / ((x[:, k] > t).sum() + 1), k, t) for k in range(4) for t in cuts[k] if 10 <= (x[:, k] <= t).sum() <= 490))
    paths, step = quality._grow(codes, cuts, grad, hess)
    assert paths[0][0][:2] == (best[1], best[2]) and all(len(p) <= quality.DEPTH for p in paths)
    leaves = [p for p in paths if not any(q[: len(p)] == p and len(q) > len(p) for q in paths)]
    for p in leaves:
        rows = quality.Rule(p).holds(x)
        assert np.allclose(step[rows], -grad[rows].sum() / (rows.sum() + 1))


def test_learned_rows_are_bounded_where_ids_repeat(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(i, "b " * i) for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 3 + [(i, i % 2) for i in range(2, 60)] + [(None, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "learn", lambda x, y: seen.append((len(x), len(y))) or quality.Model(0.0, ()))
    quality.fit(docs, labels, sample_rows=40)
    quality.fit(docs, labels.limit(0), sample_rows=40)
    assert seen == [(40, 40), (0, 0)]
