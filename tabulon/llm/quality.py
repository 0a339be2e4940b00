"""Quality classifier: a sparse rule ensemble.

Statistics of each whole text (shares of byte classes, word and line shapes, repetition) are columns. On a bounded sample of
labelled rows shallow boosted trees are grown; every path from a root is a conjunctive rule; logistic regression with an L1 penalty
keeps few of them. The kept rules are compiled into one Spark column expression over the statistics, so scoring is a map.

Defined results: null and empty texts have zero statistics and get a score like any other row; repeated rows score alike; rows with
a null label are not learned from; with no or one-sided labels every score is the share of label 1 (1.0 without any label); an
empty table gives an empty result. Input columns are kept; the statistics are named with the prefix `_q_`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import LOWER, NOT_SPACE, byte_class, lean, mix, slices, span_hashes, words

#: Most rows to learn from: those of least hash of their doc_id, however often ids and labels repeat.
SAMPLE_ROWS = 20_000
ROUNDS, DEPTH, BINS = 24, 3, 32
KEEP_FROM = 0.7

STATS = (
    "n_bytes", "n_words", "word_len", "upper", "digit", "symbol", "space", "wide", "symbol_end", "bare_symbol",
    "capital_word", "distinct_words", "same_as_before", "distinct_triples", "words_per_line", "distinct_lines", "sentence_end", "top_word",
)
_CLASSES = {
    "upper": byte_class(lambda b: 65 <= b <= 90),
    "digit": byte_class(lambda b: 48 <= b <= 57),
    "symbol": byte_class(lambda b: 33 <= b <= 126 and not chr(b).isalnum()),
    "space": byte_class(lambda b: b == 32 or 9 <= b <= 13),
    "wide": byte_class(lambda b: b >= 128),
}
_LOWER_LETTER = byte_class(lambda b: 97 <= b <= 122)
_NOT_NEWLINE = byte_class(lambda b: b != 10)
_STOP = byte_class(lambda b: chr(b) in ".,;:!?")


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's hashes: how many differ, and how often the most frequent occurs."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    starts = np.flatnonzero(new)
    most = np.zeros(len(first) - 1, np.int64)
    np.maximum.at(most, r[starts], np.diff(np.append(starts, len(h))))
    return np.bincount(r[starts], minlength=len(first) - 1), most


def text_stats(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows x STATS of the texts in data."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    per = lambda num, den: np.divide(num, den, out=np.zeros(n), where=den > 0)

    def within(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    starts, ends, first = words(data, offs, NOT_SPACE)
    count = np.diff(first).astype(float)
    hashes = span_hashes(LOWER[data], starts, ends)
    last_bytes = data[ends - 1] if len(ends) else data[:0]
    lower = np.concatenate([[0], np.cumsum(_LOWER_LETTER[data])])
    upper = np.concatenate([[0], np.cumsum(_CLASSES["upper"][data])])
    letters = (upper[ends] - upper[starts]) + (lower[ends] - lower[starts])
    shout = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][count > 0]] = False
    distinct, most = _distinct(hashes, first)
    triples = mix(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)) if len(hashes) > 2 else hashes[:0]
    row = np.repeat(np.arange(n), np.diff(first))
    inside = row[: len(triples)] == row[2:] if len(triples) else np.zeros(0, bool)
    triple_first = np.searchsorted(row[: len(triples)][inside], np.arange(n + 1))
    triple_count = np.diff(triple_first).astype(float)
    line_start, line_end, line_first = words(data, offs, _NOT_NEWLINE)
    lines = np.diff(line_first).astype(float)
    cls = {k: within(v[data], offs) for k, v in _CLASSES.items()}
    out = {
        "n_bytes": size,
        "n_words": count,
        "word_len": per(within(NOT_SPACE[data], offs), count),
        **{k: per(v, size) for k, v in cls.items()},
        "symbol_end": per(within(_CLASSES["symbol"][last_bytes] & ~_STOP[last_bytes], first), count),
        "bare_symbol": per(within((letters == 0) & ~_CLASSES["wide"][last_bytes] & ~_CLASSES["digit"][last_bytes], first), count),
        "capital_word": per(within(shout, first), count),
        "distinct_words": per(distinct, count),
        "same_as_before": per(within(again, first), count),
        "distinct_triples": per(_distinct(triples[inside], triple_first)[0], triple_count),
        "words_per_line": per(count, lines),
        "distinct_lines": per(_distinct(span_hashes(data, line_start, line_end), line_first)[0], lines),
        "sentence_end": per(within(last_bytes == 46, first), count),
        "top_word": per(most, count),
    }
    return np.stack([out[k] for k in STATS], axis=1)


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a double column `_q_<name>` for each of STATS."""

    at = docs.columns.index(text_col)  # an Arrow string has the same buffers as its bytes: the text is passed once

    def run(batches):
        for batch in batches:
            found = [text_stats(data, offs) for _, _, data, offs in slices(batch, at)]
            stats = np.concatenate(found) if found else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(stats[:, j]) for j in range(len(STATS)))], [*batch.schema.names, *(f"_q_{x}" for x in STATS)])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *(T.StructField(f"_q_{x}", T.DoubleType()) for x in STATS)]))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic's index, threshold, above): all hold. above: statistic > threshold, else <=."""

    terms: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, t, above in self.terms:
            out &= (x[:, k] > t) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, t, above in self.terms:
            c = F.col(f"_q_{STATS[k]}")
            out = out & (c > t if above else c <= t)
        return out


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self) -> Column:
        """Chance of label 1 as a column over the statistics."""
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[list[tuple[tuple, ...]], np.ndarray]:
    """A tree on binned statistics: the paths to all its nodes, and the step for each row."""
    paths, step = [], np.zeros(len(grad))
    todo = [((), np.arange(len(grad)))]
    while todo:
        path, rows = todo.pop()
        g, h = grad[rows], hess[rows]
        best = None
        if len(path) < DEPTH and len(rows) >= 40:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for k in range(codes.shape[1]):
                gs = np.cumsum(np.bincount(codes[rows, k], g, BINS))[: len(cuts[k])]
                hs = np.cumsum(np.bincount(codes[rows, k], h, BINS))[: len(cuts[k])]
                ns = np.cumsum(np.bincount(codes[rows, k], minlength=BINS))[: len(cuts[k])]
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(ns < 10) | (len(rows) - ns < 10)] = -1
                if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0]):
                    best = (gain.max(), k, int(gain.argmax()))
        if best is None:
            step[rows] = -g.sum() / (h.sum() + 1)
            continue
        _, k, cut = best
        for above in (False, True):
            part = rows[(codes[rows, k] > cut) == above]
            longer = (*path, (k, float(cuts[k][cut]), above))
            paths.append(longer)
            todo.append((longer, part))
    return paths, step


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 150) -> np.ndarray:
    """Logistic weights (the last: bias, unpenalised) by accelerated proximal gradient. r: 0 or 1 in single precision."""
    top = r.sum(axis=0, dtype=np.float64)
    v = np.sqrt(np.append(top, len(r)))
    for _ in range(8):  # the largest curvature, by power iteration
        u = r @ v[:-1].astype(np.float32) + np.float32(v[-1])
        v = np.append(u @ r, u.sum(dtype=np.float64))
        size = np.linalg.norm(v)
        v = v / size
    rate = 1 / (0.26 * size / len(r) + 1e-9)
    w, z, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        miss = (1 / (1 + np.exp(-(r @ z[:-1].astype(np.float32) + np.float32(z[-1])))) - y).astype(np.float32)
        new = z - rate * np.append(miss @ r, miss.sum(dtype=np.float64)) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, done, w, t = new + (t - 1) / s * (new - w), np.abs(new - w).max() < 1e-4, new, s
        if done:
            break
    return w


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    """Trees to rules to a sparse model; the penalty is the one of least loss on every fifth row."""
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        rate = float(y.mean()) if len(y) else 1.0
        return Model(float(np.log((rate + 1e-6) / (1 - rate + 1e-6))), ())
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    rules: dict[tuple, None] = {}
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        paths, step = _grow(codes, cuts, p - y, p * (1 - p))
        rules.update(dict.fromkeys(tuple(sorted(set(path))) for path in paths))
        f += 0.3 * step
    all_ = [Rule(terms) for terms in rules]
    if not all_:  # too few rows for any split
        return Model(float(np.log(y.mean() / (1 - y.mean()))), ())
    r = np.stack([rule.holds(x) for rule in all_], axis=1).astype(np.float32)
    test = np.arange(len(y)) % 5 == 4
    loss = lambda w: float(np.mean(np.logaddexp(0, -(2 * y[test] - 1) * (r[test] @ w[:-1] + w[-1]))))
    w, best = np.zeros(r.shape[1] + 1), None
    for penalty in np.geomspace(0.05, 0.0005, 7):
        w = _lasso(r[~test], y[~test], penalty, w)
        if best is None or loss(w) < best[0] - 1e-4:
            best = (loss(w), penalty)
    w = _lasso(r, y, best[1], w, 300)
    return Model(float(w[-1]), tuple((float(a), rule) for a, rule in zip(w[:-1], all_, strict=True) if abs(a) > 1e-4))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, held_out=None) -> Model:
    """Learns from at most sample_rows labelled rows for which held_out (a condition on doc_id) does not hold."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    if held_out is not None:
        own = own.where(~held_out(F.col("doc_id")))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(own), "doc_id").select("doc_id", "label", "text")  # sample_rows rows of two numbers
    # Ids and labels may repeat, so the rows are bounded once more; in one order, whatever order they come in.
    names = [f"_q_{s}" for s in STATS]
    rows = with_stats(joined).drop("text").orderBy(F.xxhash64("doc_id"), "doc_id", "label", *names).limit(sample_rows).toArrow()
    x = np.stack([rows[n].to_numpy() for n in names], axis=1) if rows.num_rows else np.zeros((0, len(STATS)))
    return learn(x, rows["label"].to_numpy())


def fold(doc_id: Column, parts: int = 4, held: int = 2) -> Column:
    """Whether a document is held out: crc32 of its id as text, by remainder. Without an id it is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == held, F.lit(False))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with the columns score (0 to 1) and predicted (1 if score >= KEEP_FROM), in place of any columns so named."""
    rows = with_stats(docs, text_col).withColumn("score", model.score()).withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))
    return rows.drop(*(f"_q_{s}" for s in STATS))
