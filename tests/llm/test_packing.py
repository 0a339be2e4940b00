import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabulon.llm import packing


def check(rows, texts, capacity):
    tk = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert by_doc.keys() == ids.keys()
    for d, rs in by_doc.items():
        rs.sort(key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs)))
        assert [r.start for r in rs] == [capacity * k for k in range(len(rs))]
        assert sum(r.length for r in rs) == len(ids[d]) and all(r.length == capacity for r in rs[:-1])
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), -(-sum(map(len, ids.values())) // capacity)


def test_query_round_trip(spark, sf_dir):
    from tabulon.llm.queries import QUERIES

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, least = check(QUERIES["op10_packing"](spark, sf_dir).collect(), texts, 4096)
    assert used <= 1.02 * least + 1


def test_words_coded_alone_equal_the_whole_text():
    tk = Tokenizer.from_file(packing.default_tokenizer())
    coder = packing.WordCoder(open(packing.default_tokenizer()).read())
    rng = random.Random(1)
    odd = ["don't", "it's", "<|endoftext|>", "a<|endoftext|>b", "É", "é", "ß", "\x1c", "a\x1fb", " x y", "12ab34", "''s", "x'LL", "😀", "​", "İ", "Σας", "a.b,c!!", "***", "\x7f", "́", "½", "Ça", "naïve", "STRAẞE", "straße", "ÿ", "×", "÷", "µ", "ÀÖØÞ", "e\u0301", "日本語", "|", "&lt;", "A"]
    for _ in range(3000):
        text = "".join(rng.choice([" ", "\n", "\t ", "\x0b", ""]) + rng.choice(odd) for _ in range(rng.randint(0, 9)))
        assert list(np.frombuffer(coder.encode(text.encode()), "<u4")) == tk.encode(text, add_special_tokens=False).ids, repr(text)


def test_brackets_are_best_fit_row_by_row():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size, gap = rng.integers(1, 12, 30), rng.random(30) < 0.5
        order = np.lexsort((~gap, -size))
        size, gap = size[order], gap[order]
        gaps, pieces, wanting, offered = packing.brackets(gap)
        free = {int(i): int(size[i]) for i in np.flatnonzero(gap)}
        want = {}
        for i in np.flatnonzero(~gap):  # the largest piece first takes the least gap that holds it
            fit = min((s for s in free.values() if s >= size[i]), default=None)
            if fit is not None:
                del free[next(k for k, s in free.items() if s == fit)]
                want[int(i)] = fit
        assert {int(p): int(size[g]) for g, p in zip(gaps, pieces, strict=True)} == want
        assert set(wanting.tolist()) == set(np.flatnonzero(~gap).tolist()) - want.keys()
        assert len(offered) == len(free) and sorted(size[offered]) == sorted(free.values())
    assert all(len(x) == 0 for x in packing.brackets(np.zeros(0, bool)))


def test_ranges_settled_by_rank_equal_one_range():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size, gap = rng.integers(1, 30, 60), rng.random(60) < rng.random()
        order = np.lexsort((~gap, -size))
        size, gap = size[order], gap[order]
        want = sorted((int(size[p]), int(size[g])) for g, p in zip(*packing.brackets(gap)[:2], strict=True))
        cuts = np.sort(rng.choice(61, 4))
        found, left, local = [], [], []
        for a, b in zip([0, *cuts], [*cuts, 60], strict=True):
            gaps, pieces, wanting, offered = packing.brackets(gap[a:b])
            found += [(int(size[a + p]), int(size[a + g])) for g, p in zip(gaps, pieces, strict=True)]
            left.append((len(wanting), len(offered)))
            local.append((a + wanting, a + offered))
        runs, kept = packing.between(left)
        for part, first, last, of, n in runs:
            found += [(int(size[local[part][0][k]]), int(size[local[of][1][n - 1 - (k - first)]])) for k in range(first, last)]
        assert sorted(found) == want
        assert sum(kept.values()) + len(found) == gap.sum()


@pytest.mark.parametrize("seed", range(5))
def test_one_range_is_finished(seed):
    rng = np.random.default_rng(seed)
    size, gap = rng.integers(1, 64, 300), rng.random(300) < 0.2
    seq = np.where(gap, np.cumsum(gap) - 1, 0)
    to, offset = packing.finish(size, gap, seq, 64, int(gap.sum()))
    used = {int(seq[i]): 64 - int(size[i]) for i in np.flatnonzero(gap)}
    for i in sorted(np.flatnonzero(~gap), key=lambda i: (to[i], offset[i])):
        assert used.setdefault(int(to[i]), 0) == offset[i] and offset[i] + size[i] <= 64
        used[int(to[i])] += int(size[i])
    assert len(used) <= gap.sum() + 1.1 * max(0, size[~gap].sum() - size[gap].sum()) / 64 + 12


@pytest.mark.parametrize("capacity", [7, 64])
def test_many_ranges_round_trip_and_fill(spark, monkeypatch, capacity):
    monkeypatch.setattr(packing, "RANGE_ROWS", 37)
    monkeypatch.setattr(packing, "ONE_RANGE", 40)
    rng = random.Random(4)
    texts = [(i, "a " * rng.choice([1, 3, 3, 3, capacity // 2, rng.randint(0, 3 * capacity)])) for i in range(600)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), capacity=capacity).collect()
    used, _ = check(rows, texts, capacity)
    gaps = []  # best fit, one piece after the other, the largest first
    for n in sorted((r.length for r in rows), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    assert used <= 1.03 * len(gaps) + 2


def test_large_pieces_open_their_own_sequences(spark):
    texts = [(i, "a " * (40 + i % 5)) for i in range(100)]
    used, _ = check(packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), capacity=64).collect(), texts, 64)
    assert used == 100


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "word " * 9000), (4, "a b c"), (5, "x" * 3000)]
    df = spark.createDataFrame([(*t, 7) for t in texts], "doc_id long, text string, length int")
    used, least = check(packing.pack(df, capacity=64).collect(), texts, 64)
    assert used <= least + 2
    assert packing.pack(df.limit(0)).collect() == []
    twice = packing.pack(df.where("doc_id = 4").union(df.where("doc_id = 4"))).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2
