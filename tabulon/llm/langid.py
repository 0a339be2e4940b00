"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary n-gram classifier tells the languages whose bit is set from the others:
log-odds of hashed byte 3-grams, counted over all learning documents. A text's margin on a bit is the mean log-odds of its 3-grams.
Decoding adds up a logistic loss of margin and codeword, bits weighted by how far their two sides differ, and takes the codeword of
least loss. A text is ambiguous if the runner-up's loss is close.

Defined results: `und` with score 0 if a text is null or has no letter, or if nothing could be learned; repeated rows decode alike;
null languages are not learned from; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, utf8

#: Hashed 3-grams.
FEATURES = 1 << 15
#: Most languages that can be told apart; more raise an error.
MAX_LANGUAGES = 1000
#: Loss by which the runner-up must lose at least.
AMBIGUOUS = 0.25
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3-grams of the folded texts, each text between spaces, and each row's first one's index. Two spaces in a row count for nothing."""
    n = len(offs) - 1
    low = _FOLD[data]
    if len(low) > 1:  # capitals of the Latin-1 letters
        low[1:] += (32 * ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))).astype(np.uint8)
    x = np.insert(low, np.concatenate([offs[:-1], offs[1:]]), 32).astype(np.uint32)
    starts = offs[:-1] + 2 * np.arange(n)  # of the leading spaces
    h = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16) if len(x) > 2 else x[:0]
    good = ~(((x[:-2] == 32) & (x[1:-1] == 32)) | ((x[1:-1] == 32) & (x[2:] == 32))) if len(x) > 2 else np.zeros(0, bool)
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1)
    kept = np.concatenate([[0], np.cumsum(good)])
    return h[good].astype(np.int64), kept[np.append(np.minimum(starts, len(good)), len(good))]


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1 and -1: all two-way splits up to five languages, else the best of random codes by least distance."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        rows = [(1, *bits) for bits in product((1, -1), repeat=k - 1) if -1 in bits]
        return np.array(rows, float).T
    rng, width, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, width))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        far = (code.shape[1] - code @ code.T) / 2 + np.eye(k) * width
        if best is None or far.min() > best[0]:
            best = (far.min(), code)
    return best[1]


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: languages x FEATURES."""
        self.languages, self.code = languages, codewords(len(languages))
        # Each language counts alike, however many texts it has; a 3-gram unseen in two of them tells them not apart.
        share = 0.99 * counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) + 0.01 / FEATURES
        weights, apart = [], []
        for bit in self.code.T:
            plus = share[bit > 0].mean(axis=0) if (bit > 0).any() else np.full(FEATURES, 1 / FEATURES)
            minus = share[bit < 0].mean(axis=0) if (bit < 0).any() else np.full(FEATURES, 1 / FEATURES)
            odds = np.log(plus / minus)
            weights.append(odds)
            apart.append(float(((plus - minus) * odds).sum()))
        self.weights = np.stack(weights, axis=1).astype(np.float32)
        self.bits = np.array(apart) / max(sum(apart), 1e-12)

    def decode(self, margins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's index, its score, and whether it is ambiguous. margins: mean log-odds; n: 3-grams."""
        sure = np.sqrt(np.minimum(n, 400))[:, None] * margins
        loss = np.logaddexp(0, -sure[:, None, :] * self.code[None]) @ self.bits
        like = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 8)
        best = loss.argmin(axis=1)
        if loss.shape[1] < 2:
            return best, np.ones(len(best)), np.zeros(len(best), bool)
        two = np.partition(loss, 1, axis=1)[:, :2]
        return best, like.max(axis=1) / like.sum(axis=1), two[:, 1] - two[:, 0] < AMBIGUOUS


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=None) -> Model | None:
    """Counts 3-grams by language over all rows with a language for which held_out does not hold. The driver gets languages x FEATURES counts at most."""
    own = docs.where(F.col(lang_col).isNotNull())
    if held_out is not None:
        own = own.where(~held_out(F.col(id_col)))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for a, b, data, offs in slices(batch, 1):
                h, first = grams(data, offs)
                names, code = np.unique(np.array(lang[a:b], object).astype(str), return_inverse=True)
                n = np.bincount(np.repeat(code, np.diff(first)) * FEATURES + h, minlength=len(names) * FEATURES).reshape(len(names), FEATURES)
                for name, row in zip(names.tolist(), n, strict=True):
                    total[name] = total[name] + row if name in total else row
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(row[at])], ["lang", "h", "n"])

    languages = sorted(r[0] for r in own.select(F.col(lang_col).cast("string").alias("lang")).distinct().limit(MAX_LANGUAGES + 1).collect())
    if not languages:
        return None
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), FEATURES))
    place = {x: i for i, x in enumerate(languages)}
    rows = own.select(F.col(lang_col).cast("string").alias("lang"), utf8(text_col).alias("text")).mapInArrow(run, "lang string, h long, n long")
    for lang, h, n in rows.groupBy("lang", "h").agg(F.sum("n")).toPandas().itertuples(index=False):
        counts[place[lang], h] = n
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (0 to 1), ambiguous, runner-up aside."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            names, scores, unsure = [], [], []
            for a, b, data, offs in slices(batch, 1):
                n = b - a
                ascii_letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
                lettered = ascii_letters[offs[1:]] > ascii_letters[offs[:-1]]
                for k in np.flatnonzero(~lettered & (np.diff(offs) > 0)):
                    lettered[k] = bool(_LETTER.search(data[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace")))
                if model is None:
                    lettered[:] = False
                    best, score, close = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
                else:
                    h, first = grams(data, offs)
                    count = np.diff(first)
                    sums = np.zeros((n, model.weights.shape[1]))
                    some = np.flatnonzero(count)
                    if len(some):
                        sums[some] = np.add.reduceat(model.weights[h], first[some], axis=0, dtype=np.float64)
                    best, score, close = model.decode(sums / np.maximum(count, 1)[:, None], count)
                names += [model.languages[i] if ok else "und" for i, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                scores.append(np.where(lettered, score, 0.0))
                unsure.append(close | ~lettered)
            flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(flat(scores, float)), pa.array(flat(unsure, bool))], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
