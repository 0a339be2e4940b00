import math
import random
from collections import Counter

import numpy as np

from tabulon.llm import langid


def test_held_out_accuracy(spark):
    from tabulon.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    rows = QUERIES["op2_language"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    test = rows[rows.held_out]
    assert (test.lang_pred == test.lang).mean() > 0.97


def test_codewords_keep_their_distance():
    for k in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(k)
        far = min((code[a] != code[b]).sum() for a in range(k) for b in range(a))
        assert far >= (1 if k == 2 else 2) and (abs(code.sum(axis=0)) < k).all()


def test_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 -- 4", "fr"), (4, "the house the", "en"), (5, "la maison la", "fr"), (6, "ж", None), (7, "le " * 300_000, "fr"), (4, "the house the", "en")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][0] == "en" and got[5][0] == got[7][0] == "fr" and got[6][0] in ("en", "fr")
    assert langid.fit(docs.where("lang is null")) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), None).collect() == []
    one = docs.where("lang = 'en'")
    assert {r.lang_pred for r in langid.predict(one, langid.fit(one)).collect()} == {"en", "und"}


def plain_grams(text):
    """3-grams of a text between spaces, folded plainly; two spaces in a row count for nothing."""
    raw = (text or "").encode()
    low = bytearray(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in raw)
    for i in range(1, len(raw)):
        if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E and raw[i] != 0x97:
            low[i] += 32
    x = b" " + bytes(low) + b" "
    out = []
    for i in range(len(x) - 2):
        if x[i : i + 2] != b"  " and x[i + 1 : i + 3] != b"  ":
            number = x[i] | x[i + 1] << 8 | x[i + 2] << 16
            out.append((number * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - 15))
    return out


def test_grams_match_a_plain_count():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", " ", ".", "é", "É", "×", "日", "1", "ß"]) for _ in range(rng.randrange(0, 30))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    h, first = langid.grams(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for i, t in enumerate(texts):
        assert h[first[i] : first[i + 1]].tolist() == plain_grams(t), repr(t)


def test_predictions_match_a_plain_decoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    total: dict = {}
    for r in rows:
        if r.lang is not None:
            total.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    names = sorted(total)
    code = langid.codewords(len(names))
    share = {n: (total[n], sum(total[n].values())) for n in names}
    p = lambda n, g: 0.99 * share[n][0][g] / max(share[n][1], 1) + 0.01 / langid.FEATURES
    sides = [([n for n, b in zip(names, bits, strict=True) if b > 0], [n for n, b in zip(names, bits, strict=True) if b < 0]) for bits in code.T]
    mean = lambda ns, g: sum(p(n, g) for n in ns) / len(ns)
    apart = [sum((mean(a, g) - mean(b, g)) * math.log(mean(a, g) / mean(b, g)) for g in range(langid.FEATURES) if any(share[n][0][g] for n in names)) for a, b in sides]
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    for r in rows[:60]:
        grams = plain_grams(r.text)
        if got[r.doc_id].lang_pred == "und":
            assert not any(ch.isalpha() for ch in r.text or "")
            continue
        margins = [sum(math.log(mean(a, g) / mean(b, g)) for g in grams) / max(len(grams), 1) for a, b in sides]
        sure = math.sqrt(min(len(grams), 400))
        loss = [sum(w / sum(apart) * math.log1p(math.exp(min(700, -sure * m * bit))) for w, m, bit in zip(apart, margins, word, strict=True)) for word in code]
        like = [math.exp(-8 * (x - min(loss))) for x in loss]
        best = min(range(len(names)), key=loss.__getitem__)
        assert got[r.doc_id].lang_pred == names[best] and abs(got[r.doc_id].score - like[best] / sum(like)) < 1e-3
        assert got[r.doc_id].ambiguous == (sorted(loss)[1] - min(loss) < langid.AMBIGUOUS) or abs(sorted(loss)[1] - min(loss) - langid.AMBIGUOUS) < 1e-3
