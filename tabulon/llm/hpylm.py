"""Hierarchical Pitman-Yor language model, trained by Gibbs sampling of Chinese-restaurant seatings on all training documents.

Tokens are words and one end for each text. The context of a token is the word before it (the end, for a text's first): every word has a
restaurant of its own. All contexts share one parent, the restaurant of all tokens, whose base is uniform over the V words seen and one
event "a word not seen": the event space of add-one smoothing with N + V + 1. An unseen word thus gets what any single word without
customers gets, a context not seen gives the parent's probabilities.

Seating. A dish (word) with c customers at a context sits at t tables, and each table is one customer of that dish at the parent.
1. Given a restaurant's number of tables T, g ~ Gamma(theta / d + T). Given g and the dish's probability p at the parent, the numbers of
   tables of its dishes are independent, with weights S_d(c, t) * (d * g * p)^t (S: generalised Stirling numbers), and are drawn so.
2. Likewise at the parent, with p = 1 / (V + 1).
3. Given the parent's seating, p ~ Beta(a, theta + C - a), a = c - d * t + (theta + d * T) / (V + 1): a coordinate of the Dirichlet
   distribution of its probabilities, in which the base's own draw for a word stands by its mean.
Steps 1 to 3 are the conditionals of one Gibbs sampler, so no customer has to be moved one by one. CHAINS chains with their own random
numbers run PASSES passes; after each, theta of either level is set to its most likely value (one step of expectation-maximisation). The last pass's seatings, averaged over the chains,
give the predictive probabilities, which sum to one: (c - d * t) / (theta + C) at a context, and (theta + d * T) / (theta + C) of the parent's.

Scale. What all executors hold is of fixed size: g and p of the `frequent` most frequent words, and in scoring the PAIRS most frequent pairs.
Pairs at the context of a frequent word are held by their word (side 0; those of frequent words are dealt over SHARDS), where g is known to
all. Pairs of a frequent word at any other context are held by their context (side 1), which draws its own g, ROUNDS times in turn with their
tables, as p is known to all. Pairs of two words that are not frequent ("far") are held by both; those with one customer have one table, and of
the others the context sends g to the word, which draws their tables and sends them back, in every pass. All tokens that are scored go to the
task that has their pair, far ones to that of their context and that of their word (log of the context's share of the parent; log of the parent's
probability and what the pair adds): as runs of (name, other, texts), compressed, COUNT_TOKENS tokens at a time. No text is shuffled.

Defined results: null and empty texts are the end alone; rows that repeat an id are scored each by itself; a null id is not held out;
without training tokens every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, one_to_one, packed, unpacked
from ._text import LOWER, NOT_SPACE, lean, mix, slices, span_hashes, utf8, words

#: Most frequent words, whose numbers every executor holds.
FREQUENT = 65_536
#: Pairs of context and word, of the most frequent ones, whose probabilities every executor holds while texts are scored.
PAIRS = 1 << 18
#: Tasks that a frequent word's contexts are dealt over, and tokens (on average) of a task.
SHARDS, TASK_TOKENS = 32, 3_000_000
CHAINS, PASSES, INNER = 4, 3, 2
#: Turns of g and tables, in a pass, of a context that is not a frequent word.
ROUNDS = 3
END = np.int64(0x5AFE_E27D_0C0D_E0FF)
#: Rows that are worked on at once, and about how many pairs of them; names of a block.
ROWS, VALUES = 100_000, 1_000_000
BLOCK = 20_000
#: Tokens that a task counts at once: memory against rows sent.
COUNT_TOKENS = 1_500_000
#: Customers up to which the number of tables is drawn from the whole table of its weights; beyond, from their limit for many customers.
EXACT = 256


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lower-cased texts: token hashes (each text's words, then its end), the tokens before them, and each row's first token's index."""
    n = len(offs) - 1
    low = LOWER[data]
    starts, ends, first = words(low, offs, NOT_SPACE)
    at = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))
    word = np.full(len(starts) + n, END, np.int64)
    word[at] = span_hashes(low, starts, ends).view(np.int64)
    return word, np.concatenate([[END], word[:-1]])[: len(word)], first + np.arange(n + 1)


class Places:
    """Places of numbers in a sorted array of hashes: by a table of their first bits, and by search where two share one."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.shift = np.uint64(64 - max(4, (16 * len(names)).bit_length()))
        slot = (names.view(np.uint64) >> self.shift).astype(np.int64)
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.table[slot] = np.arange(len(names))
        self.shared = np.zeros(len(self.table), bool)
        self.shared[slot[np.bincount(slot, minlength=len(self.table))[slot] > 1]] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """-1 for those that are not there."""
        if not len(self.names):
            return np.full(len(x), -1)
        slot = (x.view(np.uint64) >> self.shift).astype(np.int64)
        at = self.table[slot].astype(np.int64)
        at[self.names[at] != x] = -1
        again = np.flatnonzero(self.shared[slot] & (at < 0))
        found = np.minimum(np.searchsorted(self.names, x[again]), len(self.names) - 1)
        at[again] = np.where(self.names[found] == x[again], found, -1)
        return at


class Sorted:
    """Places of numbers among sorted hashes, as np.searchsorted has them: from where their first bits begin, in a few steps."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.shift = np.uint64(64 - max(4, len(names).bit_length()))
        self.begin = np.zeros((1 << (64 - int(self.shift))) + 1, np.int32)
        np.cumsum(np.bincount(self.slot(names), minlength=len(self.begin) - 1), out=self.begin[1:])

    def slot(self, x: np.ndarray) -> np.ndarray:
        return ((x.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that exist, and whether the number is there."""
        if not len(self.names):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        last, at = len(self.names) - 1, self.begin[self.slot(x)].astype(np.int64)
        np.minimum(at, last, out=at)
        here = self.names[at]
        found, on = here == x, np.flatnonzero((here < x) & (at < last))
        for _ in range(8):
            if not len(on):
                return at, found
            at[on] += 1
            here = self.names[at[on]]
            found[on] = here == x[on]
            on = on[(here < x[on]) & (at[on] < last)]
        at[on] = np.minimum(np.searchsorted(self.names, x[on]), last)
        found[on] = self.names[at[on]] == x[on]
        return at, found


@dataclass
class Vocabulary:
    """The frequent words' hashes in order (a word's number is its place) and counts; words and tokens of the corpus; if numbered, the other
    contexts' names in order."""

    names: np.ndarray
    counts: np.ndarray
    words: int
    tokens: int
    others: np.ndarray | None = None

    @property
    def contexts(self) -> int:
        """Restaurants that have numbers: those of frequent words, of the others, and one without customers for all not seen."""
        return len(self.names) + (0 if self.others is None else len(self.others) + 1)

    def __post_init__(self):
        self.places = None

    def __getstate__(self):
        return self.__dict__ | {"places": None}

    def numbered(self, word: np.ndarray) -> np.ndarray:
        """Numbers of the frequent words, -1 for others."""
        if self.places is None:
            self.places = Places(self.names)
        return self.places.find(word)

    def pairs(self, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens in order: words and contexts as coded, and the numbers of both. before: each text's tokens moved by one."""
        number = self.numbered(word)
        same = before[1:] == word[:-1]
        earlier = np.empty_like(number)
        earlier[1:] = number[:-1]
        odd = np.concatenate([[0], 1 + np.flatnonzero(~same)]) if len(word) else np.zeros(0, np.int64)
        earlier[odd] = self.numbered(before[odd])
        return self.coded(number, word), self.coded(earlier, before), number, earlier

    def order(self, task: np.ndarray, w: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """The order of pairs by task, word and context, so that equal pairs stand together; a word may stand in two places."""
        bits = np.uint64(len(self.names).bit_length())
        high = np.uint64(max(1, int(task.max(initial=0)).bit_length()))
        key = (task.astype(np.uint64) << (np.uint64(64) - high)) | (mix(w.view(np.uint64)) >> (high + bits) << bits) | ctx.astype(np.uint64)
        order = np.argsort(key)
        key, sorted_ = key[order], w[order]
        if ((key[1:] == key[:-1]) & (sorted_[1:] != sorted_[:-1])).any():  # two words of one hash, as far as it is used
            return np.lexsort((ctx, w, task))
        return order

    def coded(self, number: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of frequent words and hashes of others; hashes that look like numbers are moved."""
        return np.where(number >= 0, number, np.where((word >= 0) & (word < len(self.names)), word + (1 << 40), word))

    def context(self, number: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of words' restaurants, where all have numbers."""
        name = self.coded(number, word)
        at = np.searchsorted(self.others, name)
        found = np.append(self.others, -1)[at] == name
        return np.where(number >= 0, number, len(self.names) + np.where(found & (at < len(self.others)), at, len(self.others)))


def kinds(w: np.ndarray, u: np.ndarray, often: np.ndarray, near: np.ndarray):
    """Where pairs of words w (frequent: often) and contexts u (frequent: near) are held: (kind, which, their names, their others). Kinds: 0, at a
    word with a frequent context's number; 1, at a context with a frequent word's number; 2 and 3, far ones at their word and at their context."""
    for kind, some in enumerate((near, ~near & often, ~near & ~often, ~near & ~often)):
        some = np.flatnonzero(some)
        yield kind, some, *((u[some], w[some]) if kind % 2 else (w[some], u[some]))


def pair_hash(word: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return mix(word.view(np.uint64) ^ mix(ctx.astype(np.uint64) + np.uint64(1))).view(np.int64)


def dealt(w: np.ndarray, ctx: np.ndarray, size: int, tasks: int) -> np.ndarray:
    """The task of a pair: that of its name, and of a frequent word also of the context's shard."""
    shard = np.where((w >= 0) & (w < size), ctx % SHARDS + 1, 0)
    return (mix(w.view(np.uint64) * np.uint64(SHARDS + 1) + shard.astype(np.uint64)) % np.uint64(tasks)).astype(np.int64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values, and their lengths."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(x))) if len(x) else starts


def _bounds(x: np.ndarray) -> list[tuple[int, int]]:
    starts, n = _runs(x)
    return list(zip(starts.tolist(), (starts + n).tolist(), strict=True))


def _sent(task: np.ndarray, w: np.ndarray, ctx: np.ndarray, more: list[np.ndarray]):
    """Pairs sorted by task and name, to (task, a value with the task's names, their pairs, the others and what else each pair has)."""
    for a, b in _bounds(task):
        at, n = _runs(w[a:b])
        yield int(task[a]), packed(w[a:b][at], n.astype(np.uint32), ctx[a:b], *(x[a:b] for x in more))


def _counted_words(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """(w, c): words and their counts. Runs of some COUNT_TOKENS tokens send theirs packed, to one task for each word."""

    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            word = np.sort(np.concatenate(held))
            held.clear()
            at, c = _runs(word)
            word = word[at]
            task = (mix(word.view(np.uint64)) % np.uint64(len(keys))).astype(np.int64)
            order = np.argsort(task, kind="stable")
            word, c, bounds = word[order], c[order].astype(np.uint32), _bounds(task[order])
            columns = [pa.array(keys[[task[order[a]] for a, _ in bounds]]), pa.array([packed(word[a:b], c[a:b]) for a, b in bounds], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "value"])

        for batch in batches:
            for _, _, data, offs in slices(batch, 0):
                held.append(tokens(data, offs)[0])
                if sum(map(len, held)) >= COUNT_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    def summed(batches):
        parts = [unpacked(x.as_py()) for batch in batches for x in batch.column(1)]
        if not parts:
            return
        word, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word)
        at, _ = _runs(word[order])
        word, c = word[order[at]], np.add.reduceat(c[order].astype(np.int64), at)
        for a in range(0, len(word), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(word[a : a + (1 << 17)]), pa.array(c[a : a + (1 << 17)])], ["w", "c"])

    sent = docs.select(utf8("text")).mapInArrow(lean(run), "k int, value binary")
    return sent.repartition(len(keys), "k").mapInArrow(lean(summed), "w long, c long")


def _firsts(w: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal pairs."""
    return np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (ctx[1:] != ctx[:-1])])) if len(w) else np.zeros(0, np.int64)


def _counted_pairs(docs: DataFrame, known, keys: np.ndarray) -> DataFrame:
    """(k, kind, value): the pairs of runs of some COUNT_TOKENS tokens with their counts, by task and kind."""

    def run(batches):
        v, held = known.value, []

        def flush():
            word, before = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            w, u, number, earlier = v.pairs(word, before)
            del word, before
            for kind, _, name, other in kinds(w, u, number >= 0, earlier >= 0):
                if not len(name):
                    continue
                task = dealt(name, other, len(v.names), len(keys))
                order = v.order(task, name, other) if kind < 2 else np.lexsort((other, name, task))
                name, other, task = name[order], other[order], task[order]
                at = _firsts(name, other)
                c = np.diff(np.append(at, len(name))).astype(np.uint32)
                rows = list(_sent(task[at], name[at], other[at].astype(np.uint32 if kind < 2 else np.int64), [c]))
                columns = [pa.array(keys[[t for t, _ in rows]]), pa.array([kind] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "kind", "value"])

        for batch in batches:
            for _, _, data, offs in slices(batch, 0):
                held.append(tokens(data, offs)[:2])
                if sum(len(x[0]) for x in held) >= COUNT_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(utf8("text")).mapInArrow(lean(run), "k int, kind int, value binary")


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of one kind as names, others and counts, in order, each pair once."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    place = np.repeat(place, np.concatenate([p[1] for p in parts]))
    ctx, c = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
    order = np.argsort((place.astype(np.uint64) << np.uint64(32)) | ctx) if ctx.dtype == np.uint32 else np.lexsort((ctx, place))
    w = names[place]
    w, ctx, c = w[order], ctx[order], c[order].astype(np.int64)
    first = _firsts(w, ctx)
    return w[first], ctx[first].astype(np.int64), np.add.reduceat(c, first)


#: A name of a side (0: word, 1: context) with the numbers of its others and their counts; far ones, how many, and whether one has more customers than one.
ROW = "w long, ctx array<int>, cs array<long>, nf int, side int, crossed boolean, far array<long>, fc array<long>"


def _columns(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def _lists(first: np.ndarray, values: np.ndarray, kind=None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array((first - first[0]).astype(np.int32)), pa.array(values[first[0] : first[-1]], kind))


#: Types of the columns of ROW and MODEL that blocks hold packed; side and crossed are the same in a block's rows, and stay as they are.
_PACKED = {"w": np.int64, "ctx": np.int32, "cs": np.int64, "ts": np.float32, "nf": np.int32, "customers": float, "tables": float, "n": np.int64, "far": np.int64, "fc": np.int64, "ft": np.float32}


def _packed_schema(schema: str) -> str:
    return ", ".join(f"{x} binary" if x in _PACKED else f"{x} {kind}" for x, kind in (y.split(" ") for y in schema.split(", ")))


def _least_type(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if x.dtype.kind == "i" and len(x) and x.min() >= 0 and x.max() < 1 << 32 else x


def _blocks(run):
    """A function that gives batches of ROW or MODEL, to one that gives blocks: a row for BLOCK names of one side, whose columns are packed."""

    def blocks(batches):
        for whole in run(batches):
            names, odd = whole.schema.names, [i for i, x in enumerate(whole.schema.names) if x not in _PACKED]
            flags = [whole.column(i).to_numpy(zero_copy_only=False) for i in odd]
            code = sum((x.astype(np.int64) << j for j, x in enumerate(flags)), np.zeros(whole.num_rows, np.int64))
            for value in np.unique(code):
                same = whole if (code == value).all() else whole.filter(pa.array(code == value))
                for at in range(0, same.num_rows, BLOCK):
                    part = same.slice(at, BLOCK)
                    columns = []
                    for name, column in zip(names, part.columns, strict=True):
                        if name not in _PACKED:
                            columns.append(column.slice(0, 1))
                        elif pa.types.is_list(column.type):
                            first, values = _list(column)
                            columns.append(pa.array([packed(_least_type(values), np.diff(first).astype(np.uint32))], pa.binary()))
                        else:
                            columns.append(pa.array([packed(_least_type(column.to_numpy(zero_copy_only=False)))], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return blocks


def _opened(run):
    """A function over batches of ROW or MODEL (or some of their columns), to one over blocks of them."""

    def batches_of(blocks):
        for batch in blocks:
            for i in range(batch.num_rows):
                columns, rows = [], None
                for name, column in zip(batch.schema.names, batch.columns, strict=True):
                    if name not in _PACKED:
                        columns.append(column[i].as_py())
                        continue
                    values, *lengths = unpacked(column[i].as_py())
                    column = pa.array(values.astype(_PACKED[name], copy=False))
                    if lengths:
                        column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths[0], dtype=np.int32)).astype(np.int32)), column)
                    columns, rows = [*columns, column], len(column)
                columns = [x if isinstance(x, pa.Array) else pa.array(np.full(rows, x, bool if isinstance(x, bool) else np.int32)) for x in columns]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return lambda blocks: run(batches_of(blocks))


def _unpacked_rows(blocks: DataFrame, schema: str) -> DataFrame:
    """Blocks as rows of `schema`."""
    return blocks.select(*_columns(schema)).mapInArrow(lean(_opened(lambda batches: batches)), schema)


def _nested(batches):
    """A task's pairs (k, kind, value) to rows of ROW, one for each name."""
    parts = {}
    for batch in batches:
        for kind, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            parts.setdefault(kind, []).append(unpacked(x.as_py()))
    for side in (0, 1):
        (near, ctx, c), (far, mate, fc) = (_merged(parts.pop(side + i, [])) for i in (0, 2))
        names = np.unique(np.concatenate([near[_runs(near)[0]], far[_runs(far)[0]]]))
        crossed = np.zeros(len(names), bool)
        crossed[np.searchsorted(names, far[fc >= 2])] = True
        first, far_first = np.append(np.searchsorted(near, names), len(near)), np.append(np.searchsorted(far, names), len(far))
        for a in range(0, len(names), 20_000):
            b = min(a + 20_000, len(names))
            f, g = first[a : b + 1], far_first[a : b + 1]
            columns = [_lists(f, ctx, pa.int32()), _lists(f, c), pa.array(np.diff(g).astype(np.int32)), pa.array(np.full(b - a, side, np.int32)), pa.array(crossed[a:b]), _lists(g, mate), _lists(g, fc)]
            yield pa.RecordBatch.from_arrays([pa.array(names[a:b]), *columns], _columns(ROW))


_STIRLING: dict[float, np.ndarray] = {}


def stirling(d: float) -> np.ndarray:
    """log S_d(c, t) for c, t up to EXACT: S(c + 1, t) = S(c, t - 1) + (c - t * d) * S(c, t)."""
    if d not in _STIRLING:
        if len(_STIRLING) > 3:
            _STIRLING.clear()
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[1, 1] = 0.0
        for c in range(1, EXACT):
            t = np.arange(1, c + 2)
            with np.errstate(divide="ignore"):
                s[c + 1, 1 : c + 2] = np.logaddexp(s[c, t - 1], np.log(np.maximum(c - t * d, 0)) + s[c, t])
        _STIRLING[d] = s
    return _STIRLING[d]


def _many(c: np.ndarray, x: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of many customers. As the weights' generating function is exp(x * (1 - (1 - z)^d) / d), t is the number of jumps of a compound
    Poisson sum that is c. At the z whose mean is c there are x * (1 - (1 - z)^d) / d jumps; one large jump makes up for what they lack."""
    x = np.maximum(x, 1e-300)
    low, high = np.full(len(c), -60.0), np.full(len(c), 60.0)  # log of z / (1 - z)
    for _ in range(50):  # z * (1 - z)^(d - 1) * x = c
        y = (low + high) / 2
        less = -np.logaddexp(0, -y) + (1 - d) * np.logaddexp(0, y) + np.log(x) < np.log(c)
        low, high = np.where(less, y, low), np.where(less, high, y)
    z, q = 1 / (1 + np.exp(-low)), 1 / (1 + np.exp(low))
    mean = -x * np.expm1(-d * np.logaddexp(0, low)) / d
    size = c / np.maximum(mean, 1e-300)  # of a jump
    square = size * (1 + (1 - d) * z / q)
    spread = np.sqrt(mean * np.clip(1 - size * size / square, 0, 1))
    out = np.where(mean < 30, 1 + rng.poisson(np.minimum(mean, 30)), np.rint(mean + spread * rng.standard_normal(len(c))))
    return np.clip(out, 1, c).astype(np.int64)


def draw_tables(c: np.ndarray, x: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of c customers with weights S_d(c, t) * x^t."""
    out = np.ones(len(c), np.int64)
    if not len(c):
        return out
    log_x, s = np.log(np.maximum(x, 1e-300)), stirling(d)
    order = np.argsort(np.minimum(c, EXACT + 1).astype(np.uint16), kind="stable")
    starts, lengths = _runs(np.minimum(c[order], EXACT + 1))
    for n, a, b in zip(c[order[starts]].tolist(), starts.tolist(), (starts + lengths).tolist(), strict=True):
        if n == 1:
            continue
        if n > EXACT:
            rows = order[a:]
            rows = rows[np.argsort(c[rows], kind="stable")]
            out[rows] = _many(c[rows], x[rows], d, rng)
            break
        step, t = max(1 << 10, (1 << 16) // n), np.arange(1, n + 1)
        for at in range(a, b, step):
            rows = order[at : min(b, at + step)]
            if len(rows) < 4 * n:
                weight = s[n, 1 : n + 1] + log_x[rows, None] * t
                weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
                out[rows] = 1 + (weight < rng.random(len(rows))[:, None] * weight[:, -1:]).sum(axis=1)
                continue
            weight = s[n, 1 : n + 1, None] + log_x[rows] * t[:, None]  # a row for each t: the same sums, over many pairs at once
            weight = np.exp(weight - weight.max(axis=0))
            for i in range(1, n):
                weight[i] += weight[i - 1]
            out[rows] = 1 + (weight < rng.random(len(rows)) * weight[-1]).sum(axis=0)
    return out


@dataclass
class Chains:
    """What all dishes of a pass share, by chain: g of every context, p of the frequent words, g, customers and tables of the parent."""

    g: np.ndarray
    p: np.ndarray
    g0: np.ndarray
    c0: np.ndarray
    t0: np.ndarray
    d: float
    theta: float
    d0: float
    theta0: float
    words: int

    def share(self, k: int, c, t):
        """a of the Beta distribution of a dish with c customers and t tables at the parent."""
        return c - self.d0 * t + (self.theta0 + self.d0 * self.t0[k]) / (self.words + 1)

    def beta(self, k: int, c: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        a = self.share(k, c, t)
        return rng.beta(a, np.maximum(self.theta0 + self.c0[k] - a, 1e-9))

    def root_tables(self, k: int, c: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return draw_tables(c, np.full(len(c), self.d0 * self.g0[k] / (self.words + 1)), self.d0, rng)


def seat(k: int, chains: Chains, w: np.ndarray, first: np.ndarray, ctx: np.ndarray, c: np.ndarray, nf: np.ndarray, rng: np.random.Generator, far: np.ndarray | None = None):
    """One chain's pass over some words (w; ctx and c of first[i]:first[i + 1]; nf more pairs with one customer): tables of every pair; customers
    and tables at the parent of every row (tables 0 for frequent words, which are seated there with all their rows). far: g where ctx is -1."""
    n = len(w)
    dish = np.repeat(np.arange(n), np.diff(first))
    often = (w >= 0) & (w < len(chains.p))
    p = np.zeros(n)
    p[often] = chains.p[w[often], k]
    own = np.diff(first) + nf
    customers, tables = own.astype(np.int64), np.where(often, 0, 1)
    t = np.ones(len(c), np.int64)
    more = np.flatnonzero(c >= 2)
    if far is None:
        g = chains.g[ctx[more], k]
    else:
        g = far[more].copy()
        g[ctx[more] >= 0] = chains.g[ctx[more][ctx[more] >= 0], k]
    live = np.zeros(n, bool)  # other words, with tables to be drawn
    live[dish[more]] = True
    live &= ~often
    p[live] = chains.beta(k, customers[live], tables[live], rng)
    for step in range(INNER):
        last = step == INNER - 1
        some = np.arange(len(more)) if last else np.flatnonzero(live[dish[more]])
        at = more[some]
        t[at] = draw_tables(c[at], chains.d * g[some] * p[dish[at]], chains.d, rng)
        customers = own + np.bincount(dish[at], t[at] - 1, n).astype(np.int64)
        some = np.flatnonzero((~often if last else live) & (customers >= 2))
        tables[some] = chains.root_tables(k, customers[some], rng)
        if not last:
            p[live] = chains.beta(k, customers[live], tables[live], rng)
    return t, customers, tables


def seat_context(k: int, chains: Chains, first: np.ndarray, w: np.ndarray, c: np.ndarray, base: np.ndarray, rounds: int, rng: np.random.Generator):
    """One chain's pass over some contexts (frequent words w and c of first[i]:first[i + 1]; base: tables if each of these pairs had one):
    tables of every pair and of every context."""
    n = len(base)
    dish = np.repeat(np.arange(n), np.diff(first))
    t, all_, more = np.ones(len(c), np.int64), base, np.flatnonzero(c >= 2)
    live = _runs(dish[more])[0]
    live, of = dish[more][live], np.repeat(np.arange(len(live)), _runs(dish[more])[1])
    for _ in range(rounds if len(more) else 0):
        g = rng.gamma(chains.theta / chains.d + all_[live])
        t[more] = draw_tables(c[more], chains.d * g[of] * chains.p[w[more], k], chains.d, rng)
        all_ = base + np.bincount(dish[more], t[more] - 1, n).astype(np.int64)
    return t, all_


def _list(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists as where each begins, and all their values."""
    first = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return first - first[0], column.flatten().to_numpy(zero_copy_only=False)


def _picked(rows: np.ndarray, first: np.ndarray, *flat: np.ndarray) -> tuple[np.ndarray, ...]:
    """The lists of some rows."""
    n = np.diff(first)[rows]
    ends = np.cumsum(n)
    at = np.repeat(first[rows] - (ends - n), n) + np.arange(n.sum())
    return np.append(0, ends), *(x[at] for x in flat)


def _of(first: np.ndarray) -> np.ndarray:
    """Each value's row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _rows(batches):
    """Runs of some ROWS rows, or VALUES pairs, of batches (w, ctx, cs, ...): the rows as one batch, w, first, ctx, cs."""
    held, n, pairs = [], 0, 0

    def merged():
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
        first, ctx = _list(part.column(1))
        return part, part.column(0).to_numpy(zero_copy_only=False), first, ctx.astype(np.int64), _list(part.column(2))[1]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        pairs += len(batch.column(1).flatten())
        if n >= ROWS or pairs >= VALUES:
            yield merged()
            held, n, pairs = [], 0, 0
    if held:
        yield merged()


def _sides(batches):
    """Rows (w, ctx, cs, nf, side, ...) one side at a time: side, the batch, which of its rows, w, first, ctx, cs, nf."""
    for part, w, first, ctx, c in _rows(batches):
        nf, side = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        for s in (0, 1):
            some = np.flatnonzero(side == s)
            if len(some):
                lists = (first, ctx, c) if len(some) == len(w) else _picked(some, first, ctx, c)
                yield s, part, some, w[some], *lists, nf[some].astype(np.int64)


def _rng(seed: int, k: int, w: np.ndarray, ctx: np.ndarray) -> np.random.Generator:
    return np.random.default_rng([seed, k, int(np.bitwise_xor.reduce(mix(w.view(np.uint64)))) if len(w) else 0, int(ctx[0]) if len(ctx) else 0])


def _collect(found: DataFrame, size: int) -> np.ndarray:
    """(i, v0, v1, ...) summed by i, as an array of `size` rows."""
    names = found.columns[1:]
    table = found.groupBy("i").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    out = np.zeros((size, len(names)))
    out[table["i"].to_numpy()] = np.stack([table[x].to_numpy() for x in names], axis=1)
    return out


def _summed(total: np.ndarray, names: list[str]):
    """Rows (i, ...) of an array's rows that are not zero."""
    some = np.flatnonzero(total.any(axis=1)) if len(total) else np.zeros(0, np.int64)
    for a in range(0, len(some), 1 << 16):
        at = some[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(total[at, j]) for j in range(total.shape[1]))], ["i", *names])


#: What names send to others, packed by the receivers' task: the receiver and the sender of a pair, its customers and a number for each chain. Sums have no k.
LETTERS = "k int, value binary"


def _homes(w: np.ndarray, tasks: int) -> np.ndarray:
    """The tasks of names that are not frequent words."""
    return dealt(w, np.zeros(len(w), np.int64), 0, tasks)


def _letters(keys: np.ndarray, key: np.ndarray, mate: np.ndarray, c: np.ndarray, x: np.ndarray):
    home = _homes(key, len(keys))
    order = np.argsort(home, kind="stable")
    bounds = _bounds(home[order])
    for at in range(0, len(bounds), 1 << 8):
        rows = [(home[order[a]], packed(*(y[order[a:b]] for y in (key, mate, c)), x[order[a:b]].astype(float).ravel())) for a, b in bounds[at : at + (1 << 8)]]
        yield pa.RecordBatch.from_arrays([pa.array(keys[[k for k, _ in rows]]), pa.array([y for _, y in rows], pa.binary())], _columns(LETTERS))


def _noted(total: np.ndarray):
    some = np.flatnonzero(total.any(axis=1)) if len(total) else np.zeros(0, np.int64)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array([packed(some.astype(np.int32), *total[some].T)], pa.binary())], _columns(LETTERS))


def _by_home(dishes: DataFrame, keys: np.ndarray) -> DataFrame:
    """Crossed rows of blocks, (k, side, value), packed by their names' task."""

    def run(batches):
        for batch in batches:
            w, side = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            lists = [_list(batch.column(i)) for i in (1, 2, 4, 5)]
            home = _homes(w, len(keys)) * 2 + side
            order = np.argsort(home, kind="stable")
            rows = []
            for a, b in _bounds(home[order]):
                some = order[a:b]
                (first, ctx, c), (far_first, far, fc) = (_picked(some, lists[i][0], lists[i][1], lists[i + 1][1]) for i in (0, 2))
                rows.append((home[some[0]], packed(w[some], *(_least_type(y) for y in (np.diff(first), ctx, c, np.diff(far_first), far, fc)))))
            columns = [pa.array(keys[[k // 2 for k, _ in rows]]), pa.array([k % 2 for k, _ in rows], pa.int32()), pa.array([y for _, y in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "side", "value"])

    return dishes.where("crossed").select("w", "ctx", "cs", "side", "far", "fc").mapInArrow(lean(_opened(run)), "k int, side int, value binary")


def _exchange(rows: DataFrame, letters: DataFrame | None, tasks: int) -> DataFrame:
    """Rows (k, value, letter) of `_by_home` and the letters to them, each with its name's task."""
    out = rows.select("k", "value", F.lit(False).alias("letter"))
    if letters is not None:
        out = out.union(letters.where("k is not null").select("k", "value", F.lit(True)))
    return out.repartition(tasks, "k")


def _met(batches):
    """A task's rows in order (w, first, ctx, cs, first far, far, fc) and its letters in order: their rows, mates, customers and numbers."""
    parts: dict[bool, list] = {False: [], True: []}
    for batch in batches:
        for value, letter in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            parts[letter].append(unpacked(value.as_py()))
    if not parts[False]:
        return
    w, n, ctx, c, n_far, far, fc = (np.concatenate(x).astype(np.int64) for x in zip(*parts[False], strict=True))
    order = np.argsort(w)
    first, ctx, c = _picked(order, np.append(0, np.cumsum(n)), ctx, c)
    far_first, far, fc = _picked(order, np.append(0, np.cumsum(n_far)), far, fc)
    w = w[order]
    key, mate, sent, x = (np.concatenate(y) for y in zip(*parts[True], strict=True)) if parts[True] else (*[np.zeros(0, np.int64)] * 3, np.zeros(0))
    order = np.lexsort((mate, key))
    x = x.reshape(len(key), -1)[order] if len(key) else np.zeros((0, 1))
    yield w, first, ctx, c, far_first, far, fc, np.searchsorted(w, key[order]), mate[order], sent[order], x


def _seated_contexts(chains: Chains, seed: int, n_chains: int, w, first, ctx, c, base: np.ndarray, rounds: int):
    """seat_context for each chain: the chain's random numbers, tables of every pair, and tables of every context beyond `base`'s one a pair."""
    for k in range(n_chains):
        rng = _rng(seed, k, w, ctx)
        t, all_ = seat_context(k, chains, first, ctx, c, base[:, k], rounds, rng)
        yield k, rng, t, all_


def _word_sums(total: np.ndarray, k: int, size: int, w, ctx, t, own, customers, tables) -> None:
    often = (w >= 0) & (w < size)
    some = np.flatnonzero((t > 1) & (ctx >= 0))
    total[:size, k] += np.bincount(ctx[some], t[some] - 1, size).astype(np.int64)
    total[size:-4, k] += np.bincount(w[often], (customers - own)[often], size).astype(np.int64)
    total[-4:-2, k] += [customers[~often].sum(), tables.sum()]


def _context_sums(total: np.ndarray, k: int, size: int, ctx, t) -> None:
    some = np.flatnonzero(t > 1)
    total[size:-4, k] += np.bincount(ctx[some], t[some] - 1, size).astype(np.int64)


def _sum_of(total: np.ndarray, chains: Chains, customers, tables) -> None:
    """What the concentration is fitted from, in whole millionths, so that the order of addition does not matter."""
    total[-2:, 0] += np.rint(1e6 * opened(chains.theta, chains.d, customers, tables)).astype(np.int64)


def _crossed_words(met, chains: Chains, seed: int, n_chains: int):
    """seat for each chain on words and letters (c, g of contexts): chain, own pairs, contexts (-1: a letter), tables, customers, tables at the
    parent, and where the pairs of the rows and those of the letters stand."""
    w, first, ctx, c, far_first, _, fc, at, _, sent, g = met
    nf = np.bincount(_of(far_first)[fc == 1], minlength=len(w))
    dish = np.concatenate([_of(first), at])
    order = np.argsort(dish, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    all_first = np.append(0, np.cumsum(np.bincount(dish, minlength=len(w))))
    all_ctx, all_c = np.concatenate([ctx, np.full(len(at), -1)])[order], np.concatenate([c, sent])[order]
    for k in range(n_chains):
        far = np.concatenate([np.zeros(len(ctx)), g[:, k] if len(at) else np.zeros(0)])[order]
        t, customers, tables = seat(k, chains, w, all_first, all_ctx, all_c, nf, _rng(seed, k, w, ctx), far)
        yield k, np.diff(all_first) + nf, all_ctx, t, customers, tables, place[: len(ctx)], place[len(ctx) :]


def _ask_words(rows: DataFrame, letters: DataFrame | None, shared, seed: int, keys: np.ndarray) -> DataFrame:
    """Contexts with far pairs that have more customers than one: LETTERS to the words with g, and sums. letters: those pairs' tables beyond one."""

    def run(batches):
        chains = shared.value
        size, total = len(chains.p), np.zeros((2 * len(chains.p) + 4, CHAINS), np.int64)
        for w, first, ctx, c, far_first, far, fc, at, _, _, x in _met(batches):
            of, n = _of(far_first), len(w)
            base, tables = (np.diff(first) + np.diff(far_first))[:, None] + np.zeros((1, CHAINS), np.int64), np.zeros(n)
            for k in range(CHAINS if len(at) else 0):
                base[:, k] += np.bincount(at, x[:, k], n).astype(np.int64)
            heavy = np.flatnonzero(fc >= 2)
            g = np.zeros((len(heavy), CHAINS))
            for k, rng, t, all_ in _seated_contexts(chains, seed, CHAINS, w, first, ctx, c, base, ROUNDS):
                _context_sums(total, k, size, ctx, t)
                tables += all_ / CHAINS
                g[:, k] = rng.gamma(chains.theta / chains.d + all_)[of[heavy]]
            _sum_of(total, chains, np.bincount(_of(first), c, n) + np.bincount(of, fc, n), tables)
            yield from _letters(keys, far[heavy], w[of[heavy]], fc[heavy], g)
        yield from _noted(total)

    return _exchange(rows.where("side = 1"), letters, len(keys)).mapInArrow(lean(run), LETTERS)


def _answer_contexts(rows: DataFrame, letters: DataFrame, shared, seed: int, keys: np.ndarray) -> DataFrame:
    """Words with such pairs: LETTERS to the contexts with their tables beyond one, and sums."""

    def run(batches):
        chains = shared.value
        size, total = len(chains.p), np.zeros((2 * len(chains.p) + 4, CHAINS), np.int64)
        for met in _met(batches):
            w, at, mate, sent = met[0], *met[7:10]
            x = np.zeros((len(at), CHAINS))
            for k, own, ctx, t, customers, tables, _, theirs in _crossed_words(met, chains, seed, CHAINS):
                _word_sums(total, k, size, w, ctx, t, own, customers, tables)
                x[:, k] = t[theirs] - 1
            yield from _letters(keys, mate, w[at], sent, x)
        yield from _noted(total)

    return _exchange(rows.where("side = 0"), letters, len(keys)).mapInArrow(lean(run), LETTERS)


def _pass(dishes: DataFrame, chains: Chains, seed: int) -> np.ndarray:
    """Sums after a pass over rows that are not crossed, by chain: tables of each frequent context beyond one a pair, then customers at the
    parent of each frequent word beyond one a pair, then customers and tables at the parent of all other words, then what `opened` gives of all other contexts."""
    shared = dishes.sparkSession.sparkContext.broadcast(chains)
    names = [f"v{k}" for k in range(CHAINS)]
    size = len(chains.p)

    def run(batches):
        chains, total = shared.value, np.zeros((2 * size + 4, CHAINS), np.int64)
        for side, _, _, w, first, ctx, c, nf in _sides(batches):
            own = np.diff(first) + nf
            if side:
                tables = np.zeros(len(w))
                for k, _, t, all_ in _seated_contexts(chains, seed, CHAINS, w, first, ctx, c, own[:, None] + np.zeros((1, CHAINS), np.int64), ROUNDS):
                    _context_sums(total, k, size, ctx, t)
                    tables += all_ / CHAINS
                _sum_of(total, chains, np.bincount(_of(first), c, len(w)) + nf, tables)
                continue
            for k in range(CHAINS):
                t, customers, tables = seat(k, chains, w, first, ctx, c, nf, _rng(seed, k, w, ctx))
                _word_sums(total, k, size, w, ctx, t, own, customers, tables)
        yield from _summed(total, names)

    plain = dishes.where("not crossed").select("w", "ctx", "cs", "nf", "side")
    return _collect(plain.mapInArrow(lean(_opened(run)), "i int, " + ", ".join(f"{x} long" for x in names)), 2 * size + 4).astype(np.int64)


def _letter_sums(letters: DataFrame, size: int) -> np.ndarray:
    def run(batches):
        for batch in batches:
            for value in batch.column(1):
                i, *v = unpacked(value.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(i), *map(pa.array, v)], names)

    names = ["i", *(f"v{k}" for k in range(CHAINS))]
    some = letters.where("k is null").mapInArrow(lean(run), "i int, " + ", ".join(f"{x} long" for x in names[1:]))
    return _collect(some, 2 * size + 4).astype(np.int64)


def _discount(ones: float, twos: float) -> float:
    """The usual estimate from how many counts are one and two."""
    return round(float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)), 6) if ones else 0.5


def _digamma(x: np.ndarray) -> np.ndarray:
    low = np.zeros_like(x)
    for _ in range(6):
        low, x = low - np.where(x < 6, 1 / x, 0), np.where(x < 6, x + 1, x)
    return low + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def opened(theta: float, d: float, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Sums over restaurants: log eta of Beta(theta + 1, C - 1), and of the tables but the first those whose theta opened them."""
    some = (customers >= 2) & (tables >= 1)
    c, t = customers[some].astype(float), tables[some].astype(float)
    one = lambda x: _digamma(np.array([x]))[0]
    return np.array([(one(theta + 1.0) - _digamma(theta + c)).sum(), (theta / d * (_digamma(theta / d + t) - one(theta / d + 1.0))).sum()])


def concentration(theta: float, d: float, customers: np.ndarray, tables: np.ndarray, more: np.ndarray | float = 0.0) -> float:
    """One step of expectation-maximisation on theta (prior Gamma(1, 1)) over restaurants, and others of which `opened` gives `more`."""
    log_eta, of_theta = opened(theta, d, customers, tables) + more
    return float(np.clip(of_theta / (1 - log_eta), 1e-3, 1e6)) if log_eta else theta


@dataclass
class Model:
    """The frequent words and, of the averaged seatings: theta + C inverted and the parent's share of the contexts that have numbers, parent
    probabilities of the frequent words and of a word not seen, and what those of other words and contexts come from."""

    vocabulary: Vocabulary
    inverse: np.ndarray
    backoff: np.ndarray
    frequent: np.ndarray
    unseen: float
    d: float
    d0: float
    theta: float
    theta0: float
    base: float
    all0: float

    def probability(self, ctx: np.ndarray, c: np.ndarray, t: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Of words with c customers at t tables at contexts, whose parent probability is root."""
        return (c - self.d * t) * self.inverse[ctx].astype(float) + self.backoff[ctx].astype(float) * root

    def root(self, c, t):
        """Parent probability of a word with c customers at t tables there."""
        return (c - self.d0 * t + self.base) / self.all0


#: A name of a side with its others, their customers and (averaged) tables. Side 0: customers and tables at the parent of words that are not
#: frequent, and tokens. Side 1: customers and tables of the context, and far ones with their customers and tables.
MODEL = "w long, ctx array<int>, cs array<long>, ts array<float>, customers double, tables double, n long, side int, far array<long>, fc array<long>, ft array<float>"


def _model(side: int, w, first, ctx, c, t, customers, tables, n, far_first, far, fc, ft) -> pa.RecordBatch:
    lists = [_lists(first, ctx, pa.int32()), _lists(first, c), _lists(first, t.astype(np.float32))]
    columns = [pa.array(customers.astype(float)), pa.array(tables.astype(float)), pa.array(n.astype(np.int64)), pa.array(np.full(len(w), side, np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(w), *lists, *columns, _lists(far_first, far), _lists(far_first, fc), _lists(far_first, ft.astype(np.float32))], _columns(MODEL))


def trained(docs: DataFrame, scratch: Scratch, frequent: int = FREQUENT) -> tuple[DataFrame, Model]:
    """docs (text) to the model: blocks of rows of MODEL, and what is of fixed size; w and far are the numbers of frequent words, else their hashes."""
    sc = docs.sparkSession.sparkContext
    words_ = scratch.save(_counted_words(docs, one_to_one(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "words")
    n_words, n_tokens = (x or 0 for x in words_.agg(F.count("*"), F.sum("c")).first())
    top = words_.orderBy(F.desc("c"), "w").limit(frequent).toArrow()  # at most `frequent` pairs of numbers
    order = np.argsort(top["w"].to_numpy())
    vocabulary = Vocabulary(top["w"].to_numpy()[order], top["c"].to_numpy()[order], n_words, n_tokens)
    size = len(order)
    known = sc.broadcast(vocabulary)

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_tokens // TASK_TOKENS + 1)
    keys = one_to_one(tasks)
    dishes = scratch.save(_counted_pairs(docs, known, keys).repartition(tasks, "k").mapInArrow(lean(_blocks(_nested)), _packed_schema(ROW)), "dishes")
    scratch.forget()
    crossed = scratch.save(_by_home(dishes, keys), "crossed")

    def census(batches):
        total = np.zeros((2 * size + 3, 3), np.int64)
        for side, part, some, w, first, ctx, c, nf in _sides(batches):
            own = np.diff(first) + nf
            total[-3] += [(c == 1).sum(), (c == 2).sum(), 0]
            if side:
                _, fc = _picked(some, *_list(part.column(5)))
                total[-3] += [(fc == 1).sum(), (fc == 2).sum(), 0]
                total[size:-3, 0] += np.bincount(ctx, minlength=size)
                continue
            often = (w >= 0) & (w < size)
            total[:size, 0] += np.bincount(ctx, c, size).astype(np.int64)
            total[:size, 1] += np.bincount(ctx, minlength=size)
            total[size:-3, 0] += np.bincount(w[often], own[often], size).astype(np.int64)
            total[-2] += [(own[~often] == 1).sum(), (own[~often] == 2).sum(), (~often).sum()]
            total[-1] += [own[~often].sum(), 0, 0]
        yield from _summed(total, ["a", "b", "c"])

    found = _collect(dishes.select("w", "ctx", "cs", "nf", "side", "fc").mapInArrow(lean(_opened(census)), "i int, a long, b long, c long"), 2 * size + 3).astype(np.int64)
    customers, pairs, per_word = found[:size, 0], found[:size, 1], found[size:-3, 0]
    d, d0 = _discount(*found[-3, :2]), _discount(*found[-2, :2])
    rare, rare_pairs = found[-2, 2], found[-1, 0]
    rng = np.random.default_rng(7)
    wide = lambda x: np.repeat(np.asarray(x)[..., None], CHAINS, axis=-1)
    # To begin with, every pair of word and context has one table, and so has every word at the parent.
    tables, c_often, t_often = wide(pairs), wide(per_word), wide(np.ones(size, np.int64))
    c_rest, t_rest, theta, theta0 = wide(rare_pairs), wide(rare), 1.0, 1.0

    def state() -> Chains:
        c0, t0 = c_often.sum(axis=0) + c_rest, t_often.sum(axis=0) + t_rest
        out = Chains(rng.gamma(theta / d + tables), np.zeros((size, CHAINS)), rng.gamma(theta0 / d0 + t0), c0, t0, d, theta, d0, theta0, n_words)
        for k in range(CHAINS if size else 0):
            t_often[:, k] = out.root_tables(k, c_often[:, k], rng)
            out.p[:, k] = out.beta(k, c_often[:, k], t_often[:, k], rng)
        out.t0 = t_often.sum(axis=0) + t_rest
        return out

    letters, any_crossed = None, not crossed.isEmpty()
    for n in range(PASSES - 1 if n_words else 0):
        now = state()
        sums = _pass(dishes, now, n)
        if any_crossed:
            shared = sc.broadcast(now)
            asked = scratch.save(_ask_words(crossed, letters, shared, n, keys), f"asked{n}")
            letters = scratch.save(_answer_contexts(crossed, asked, shared, n, keys), f"letters{n}")
            sums += _letter_sums(asked, size) + _letter_sums(letters, size)
        tables, c_often = pairs[:, None] + sums[:size], per_word[:, None] + sums[size:-4]
        c_rest, t_rest = sums[-4], sums[-3]
        theta = concentration(theta, d, customers, tables.mean(axis=1), sums[-2:, 0] / 1e6)
        theta0 = concentration(theta0, d0, np.array([(c_often.sum(axis=0) + c_rest).mean()]), np.array([(t_often.sum(axis=0) + t_rest).mean()]))
    last = state()
    shared = sc.broadcast(last)

    def run(batches):
        chains = shared.value
        for side, part, some, w, first, ctx, c, nf in _sides(batches):
            own, n = np.diff(first) + nf, np.bincount(_of(first), c, len(w)) + nf
            if side:
                far_first, far = _picked(some, *_list(part.column(5)))
                found = [(t, all_) for _, _, t, all_ in _seated_contexts(chains, 99, CHAINS, w, first, ctx, c, own[:, None] + np.zeros((1, CHAINS), np.int64), ROUNDS)]
                t, tables = (np.mean(x, axis=0) for x in zip(*found, strict=True))
                yield _model(1, w, first, ctx, c, t, n, tables, n, far_first, far, np.ones(len(far), np.int64), np.ones(len(far)))
                continue
            found = [seat(k, chains, w, first, ctx, c, nf, _rng(99, k, w, ctx)) for k in range(CHAINS)]
            t, customers, tables = (np.mean(x, axis=0) for x in zip(*found, strict=True))
            yield _model(0, w, first, ctx, c, t, customers, tables, n, np.zeros(len(w) + 1, np.int64), *[np.zeros(0, np.int64)] * 3)

    def run_words(batches):
        for met in _met(batches):
            w, first, ctx, c, far_first, _, fc = met[:7]
            found = [(t[ours], customers, tables) for _, _, _, t, customers, tables, ours, _ in _crossed_words(met, shared.value, 99, CHAINS)]
            t, customers, tables = (np.mean(x, axis=0) for x in zip(*found, strict=True))
            n = np.bincount(_of(first), c, len(w)) + np.bincount(_of(far_first), fc, len(w))
            yield _model(0, w, first, ctx, c, t, customers, tables, n, np.zeros(len(w) + 1, np.int64), *[np.zeros(0, np.int64)] * 3)

    def run_contexts(batches):
        for w, first, ctx, c, far_first, far, fc, at, _, _, x in _met(batches):
            base = (np.diff(first) + np.diff(far_first))[:, None] + np.zeros((1, CHAINS), np.int64)
            for k in range(CHAINS):
                base[:, k] += np.bincount(at, x[:, k], len(w)).astype(np.int64)
            found = [(t, all_) for _, _, t, all_ in _seated_contexts(shared.value, 100, CHAINS, w, first, ctx, c, base, ROUNDS)]
            t, tables = (np.mean(y, axis=0) for y in zip(*found, strict=True))
            n = np.bincount(_of(first), c, len(w)) + np.bincount(_of(far_first), fc, len(w))
            ft = np.ones(len(far))
            ft[fc >= 2] += x.mean(axis=1)  # in one order: rows by context and far word, letters by their receivers and senders
            yield _model(1, w, first, ctx, c, t, n, tables, n, far_first, far, fc, ft)

    model = dishes.where("not crossed").select("w", "ctx", "cs", "nf", "side", "far").mapInArrow(lean(_blocks(_opened(run))), _packed_schema(MODEL))
    if any_crossed:
        asked = scratch.save(_ask_words(crossed, letters, shared, 99, keys), "asked")
        letters = scratch.save(_answer_contexts(crossed, asked, shared, 99, keys), "letters")
        model = model.union(_exchange(crossed.where("side = 0"), asked, tasks).mapInArrow(lean(_blocks(run_words)), _packed_schema(MODEL)))
        model = model.union(_exchange(crossed.where("side = 1"), letters, tasks).mapInArrow(lean(_blocks(run_contexts)), _packed_schema(MODEL)))
    model = scratch.save(model, "model")

    def settle(batches):
        total = np.zeros((2 * size + 2, 1))
        for part, w, first, ctx, _ in _rows(batches):
            side, t = part.column(6).to_numpy(zero_copy_only=False), _list(part.column(3))[1].astype(float)
            own = side[_of(first)] == 0
            total[:size, 0] += np.bincount(ctx[own], t[own], size)
            total[size:-2, 0] += np.bincount(ctx[~own], t[~own], size)
            often = (w >= 0) & (w < size) & (side == 0)
            customers, tables = (part.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            total[size:-2, 0] += np.bincount(w[often], customers[often], size)
            rest = (side == 0) & ~often
            total[-2:, 0] += [customers[rest].sum(), tables[rest].sum()]
        yield from _summed(total, ["a"])

    end = _collect(model.select("w", "ctx", "cs", "ts", "customers", "tables", "side").mapInArrow(lean(_opened(settle)), "i int, a double"), 2 * size + 2)[:, 0]
    for name in ("dishes", "words", "crossed", "asked", "letters", *(f"{x}{n}" for x in ("asked", "letters") for n in range(PASSES - 1))):
        scratch.drop(name)
    mean_t = np.mean([last.root_tables(k, np.rint(end[size:-2]).astype(np.int64), rng) for k in range(CHAINS)], axis=0) if size else np.zeros(0)
    c0, t0 = end[size:].sum() - end[-1], mean_t.sum() + end[-1]
    inverse = 1 / (theta + customers)
    base = (theta0 + d0 * t0) / (n_words + 1)
    out = Model(vocabulary, inverse.astype(np.float32), ((theta + d * end[:size]) * inverse).astype(np.float32), np.zeros(0), 1.0, d, d0, theta, theta0, base, theta0 + c0)
    out.frequent, out.unseen = out.root(end[size:-2], mean_t), base / out.all0
    return model, out


def train(docs: DataFrame, scratch: Scratch, frequent: int = FREQUENT) -> tuple[DataFrame, Model]:
    """The model with all restaurants numbered, for corpora whose words fit the driver: rows (w, ctx, cs, ts, customers, tables) with the averaged
    tables of every pair and, for words that are not frequent, customers and tables at the parent; w is the number of a frequent word, else its hash."""
    model, m = trained(docs, scratch, frequent)
    model = _unpacked_rows(model, MODEL)
    found = model.where("side = 1").select("w", "customers", "tables").toArrow().sort_by("w")
    others, c, t = (found[x].to_numpy() for x in ("w", "customers", "tables"))
    number = docs.sparkSession.createDataFrame(pa.table({"name": others, "number": (len(m.frequent) + np.arange(len(others))).astype(np.int32)}))
    at_words, at_contexts = (model.where(f"side = {x}") for x in (0, 1))
    pairs = at_words.select("w", F.inline(F.arrays_zip("ctx", "cs", "ts")))
    for x in (("ctx", "cs", "ts"), ("far", "fc", "ft")):
        more = at_contexts.select(F.col("w").alias("name"), F.inline(F.arrays_zip(*x))).join(number, "name")
        pairs = pairs.union(more.select(F.col(x[0]).cast("long"), "number", *x[1:]))
    pairs = pairs.groupBy("w").agg(F.collect_list(F.struct("ctx", "cs", "ts")).alias("p"))
    heads = at_words.groupBy("w").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables"))
    whole = pairs.join(heads, "w", "left").select("w", "p.ctx", "p.cs", "p.ts", "customers", "tables")
    inverse, backoff = np.append(1 / (m.theta + c), 1 / m.theta), np.append((m.theta + m.d * t) / (m.theta + c), 1.0)
    return whole, replace(m, vocabulary=replace(m.vocabulary, others=others), inverse=np.append(m.inverse, inverse), backoff=np.append(m.backoff, backoff))


def _place(c: np.ndarray) -> np.ndarray:
    """Counts as places of a histogram: up to 4,096 as they are, then by powers of two."""
    return np.where(c <= 4096, c, 4084 + np.ceil(np.log2(np.maximum(c, 1)))).astype(np.int64)


def _least(model: DataFrame, size: int, most: int) -> int:
    """The least count that at most `most` pairs of frequent words have or exceed."""

    def run(batches):
        total = np.zeros((4200, 1), np.int64)
        for _, w, first, _, c in _rows(batches):
            some = c[np.repeat((w >= 0) & (w < size), np.diff(first)) & (c >= 2)]
            total[:, 0] += np.bincount(_place(some), minlength=4200)
        yield from _summed(total, ["n"])

    above = np.cumsum(_collect(model.where("side = 0").select("w", "ctx", "cs").mapInArrow(lean(_opened(run)), "i int, n long"), 4200)[::-1, 0])[::-1]
    place = int(np.argmax(above <= most)) if (above <= most).any() else 4199
    return max(2, place if place <= 4096 else (1 << (place - 4085)) + 1)


def _most_frequent(model: DataFrame, shared, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and log10 probabilities of the pairs of frequent words seen `least` times or more."""

    def run(batches):
        m = shared.value
        for part, w, first, ctx, c in _rows(batches):
            of = np.repeat(np.arange(len(w)), np.diff(first))
            some = np.flatnonzero(((w >= 0) & (w < len(m.frequent)))[of] & (c >= least))
            t = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)[some]
            p = m.probability(ctx[some], c[some], t, m.frequent[w[of[some]]])
            yield pa.RecordBatch.from_arrays([pa.array(pair_hash(w[of[some]], ctx[some])), pa.array(np.log10(p))], ["key", "lp"])

    table = model.where("side = 0").select("w", "ctx", "cs", "ts").mapInArrow(lean(_opened(run)), "key long, lp double").toArrow()
    order = np.argsort(table["key"].to_numpy())
    return table["key"].to_numpy()[order], table["lp"].to_numpy()[order]


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, most_pairs: int = PAIRS) -> DataFrame:
    """Trains on the rows for which held_out (a condition on the id) does not hold and scores all rows.

    Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (both log10 of the text's probability).
    """
    spark = docs.sparkSession
    sc, scratch = spark.sparkContext, Scratch(spark, "hpylm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    model, m = trained(rows.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text"), scratch, frequent)
    scratch.forget()
    v, size, shared = m.vocabulary, len(m.frequent), sc.broadcast(m)
    top = sc.broadcast(_most_frequent(model, shared, _least(model, size, most_pairs)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), v.tokens // TASK_TOKENS + 1)
    keys = one_to_one(tasks)

    def ask(batches):
        """For each run of some COUNT_TOKENS tokens (chunk), by task and kind: what its texts' tokens ask for; and a value with the texts' ids and
        the sums of what is known in place."""
        m, (pairs, logs) = shared.value, top.value
        places = Places(pairs)
        lc = np.log10(np.append(m.vocabulary.counts, 0) + 1.0)
        chunk, held, own, n_held = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            all_w, all_u, often, near, rows_ = (np.concatenate(x) for x in zip(*held, strict=True))
            sent = []
            for kind, some, w, ctx in kinds(all_w, all_u, often, near):
                row = rows_[some]
                if kind == 3:
                    ctx = np.zeros_like(ctx)  # its context's share alone
                task = dealt(w, ctx, size, tasks)
                order = np.lexsort((ctx, w, task)) if kind == 2 else m.vocabulary.order(task, w, ctx)
                w, ctx, row, task = w[order], ctx[order], row[order], task[order]
                at = _firsts(w, ctx)
                n = np.diff(np.append(at, len(w))) if len(w) else at
                other = ctx[at].astype(np.int64 if kind == 2 else np.uint32)
                for (a, b), (k, value) in zip(_bounds(task[at]), _sent(task[at], w[at], other, [n.astype(np.uint32)]), strict=True):
                    texts = row[at[a] : at[b] if b < len(at) else len(row)].astype(np.uint32)
                    sent.append((keys[k], chunk, kind, value, packed(texts)))
            mine = packed(*(np.concatenate(x) for x in zip(*own, strict=True)))
            sent.append((keys[chunk % tasks], chunk, -1, None, mine))
            columns = zip(*sent, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["k", "chunk", "kind", "value", "texts"])

        for batch in batches:
            for a, b, data, offs in slices(batch, 1):
                word, before, first = tokens(data, offs)
                n, row = b - a, np.repeat(np.arange(b - a), np.diff(first))
                w, ctx, number, earlier = m.vocabulary.pairs(word, before)
                often, near = number >= 0, earlier >= 0
                at = places.find(pair_hash(w, ctx))
                here = often & near & (at >= 0)
                ids = batch.column(0).slice(a, n)
                in_place = np.bincount(row[here], logs[at[here]], n).astype(float) if len(pairs) else np.zeros(n)
                own.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), np.diff(first), np.bincount(row[often], minlength=n), np.bincount(row, lc[number], n).astype(float), in_place))
                rest = np.flatnonzero(~here)
                held.append((w[rest], ctx[rest], often[rest], near[rest], row[rest] + n_held))
                n_held += n
                if sum(len(x[0]) for x in held) >= COUNT_TOKENS or n_held >= 100_000:
                    yield from flush()
                    held, own, n_held, chunk = [], [], 0, chunk + 1
        if own:
            yield from flush()

    def tell(batches):
        """The model's rows: as what they answer, by task and kind."""
        m = shared.value
        for part, w, first, ctx, c in _rows(batches):
            t = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            customers, tables = (part.column(i).to_numpy(zero_copy_only=False).astype(np.float32) for i in (4, 5))
            count, side = (part.column(i).to_numpy(zero_copy_only=False) for i in (6, 7))
            often = (w >= 0) & (w < size)
            sent = []
            some = np.flatnonzero(often)
            f, x, cx, tx = _picked(some, first, ctx, c, t)
            of = some[_of(f)]
            task = dealt(w[of], x, size, tasks)
            order = np.lexsort((x, of, task))
            for a, b in _bounds(task[order]):
                o = order[a:b]
                at, n = _runs(of[o])
                word = of[o][at]
                sent.append((keys[task[o[0]]], 0, packed(w[word], n.astype(np.uint32), x[o].astype(np.uint32), cx[o], tx[o], customers[word], tables[word], count[word])))
            for kind in (0, 1):  # other names have one task each, also without pairs
                some = np.flatnonzero(~often & (side == kind))
                task = dealt(w[some], np.zeros(len(some), np.int64), size, tasks)
                order = np.argsort(task, kind="stable")
                for a, b in _bounds(task[order]):
                    o = some[order[a:b]]
                    f, x, cx, tx = _picked(o, first, ctx, c, t)
                    sent.append((keys[task[order[a]]], kind, packed(w[o], np.diff(f).astype(np.uint32), x.astype(np.uint32), cx, tx, customers[o], tables[o], count[o])))
            (f, far), fc, ft = _list(part.column(8)), _list(part.column(9))[1], _list(part.column(10))[1]
            of = _of(f)
            adds = ((fc - m.d * ft) / (m.theta + m.d * tables[of])).astype(np.float32)
            task = dealt(far, np.zeros(len(far), np.int64), size, tasks)
            order = np.argsort(task, kind="stable")
            for a, b in _bounds(task[order]):
                o = order[a:b]
                sent.append((keys[task[o[0]]], 2, packed(far[o], w[of[o]], adds[o])))
            columns = zip(*sent, strict=True)
            if sent:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["k", "kind", "value"])

    def meet(batches):
        """A task's model rows and what is asked of it: (chunk, value) with texts and sums, and the chunks' own values as they are."""
        m, known, asked = shared.value, ([], [], []), []
        for batch in batches:
            for chunk, kind, value, texts in zip(*(batch.column(i) for i in (1, 2, 3, 4)), strict=True):
                if not chunk.is_valid:
                    known[kind.as_py()].append(unpacked(value.as_py()))
                elif value.is_valid:
                    asked.append((chunk.as_py(), kind.as_py(), value.as_py(), texts.as_py()))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), pa.array([True]), pa.array([texts.as_py()], pa.binary())], ["chunk", "own", "value"])

        def joined(kind, *types):
            out = [np.concatenate(x) for x in zip([np.zeros(0, x) for x in types], *known[kind], strict=True)]
            known[kind].clear()
            return out

        def ordered(key, *more):
            order = np.argsort(key)
            return Sorted(key[order]), *(x[order] for x in more)

        told = ("<i8", "<u4", "<u4", "<i8", "<f4", "<f4", "<f4", "<i8")
        w, n, ctx, c, t, customers, tables, count = joined(0, *told)
        often = (w >= 0) & (w < size)
        root = m.root(customers.astype(float), tables.astype(float))
        root[often] = m.frequent[w[often]]
        of, ctx = np.repeat(np.arange(len(w)), n), ctx.astype(np.int64)
        at_words = ordered(pair_hash(w[of], ctx), np.log10(m.probability(ctx, c, t.astype(float), root[of])))
        rare, root, lc = ordered(w[~often], root[~often], np.log10(count[~often] + 1.0))
        u, n, w, c, t, customers, tables, _ = joined(1, *told)
        of, w, inverse = np.repeat(np.arange(len(u)), n), w.astype(np.int64), 1 / (m.theta + customers.astype(float))
        backoff = (m.theta + m.d * tables) * inverse
        at_contexts = ordered(pair_hash(u[of], w), np.log10((c - m.d * t) * inverse[of] + backoff[of] * m.frequent[w]))
        u, shares = ordered(u, np.log10(backoff))
        w, mate, adds = joined(2, "<i8", "<i8", "<f4")
        at, found = rare.find(w)
        far = ordered(pair_hash(w, mate), np.log10(1 + adds / (root[at] if len(root) else 1.0)))

        for chunk, kind, value, texts in asked:
            w, n, ctx, times = unpacked(value)
            (texts,) = unpacked(texts)
            of, ctx = np.repeat(np.arange(len(w)), n), ctx.astype(np.int64)
            found = base = np.zeros(len(w))
            if kind % 2:
                at, seen = u.find(w)
                share = np.where(seen, shares[at], 0.0) if len(shares) else np.zeros(len(w))
                found = np.zeros(len(w), bool)
                total = share[of] + (np.log10(m.frequent[ctx]) if kind == 1 else 0.0)
            else:
                often = (w >= 0) & (w < size)
                at, found = rare.find(w)
                found = found & ~often
                parent = np.full(len(w), m.unseen)
                parent[often], parent[found] = m.frequent[w[often]], root[at[found]]
                base = np.where(found, lc[at], 0.0) if len(lc) else np.zeros(len(w))
                total = np.log10(parent)[of] if kind else np.log10(m.backoff[ctx] * parent[of])
            if kind < 3:
                key, lp = (at_words, at_contexts, far)[kind]
                at, seen = key.find(pair_hash(w[of], ctx))
                if len(lp):
                    total = np.where(seen, total + lp[at] if kind == 2 else lp[at], total)
            of, times = np.repeat(of, times), np.repeat(total, times)
            other = np.flatnonzero(found[of])
            n = int(texts.max(initial=0)) + 1
            sums = [np.bincount(texts[other], minlength=n).astype(np.int32), np.bincount(texts[other], base[of[other]], n).astype(float), np.bincount(texts, times, n).astype(float)]
            some = np.flatnonzero(np.bincount(texts, minlength=n)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([False]), pa.array([packed(some, *(x[some] for x in sums))], pa.binary())], ["chunk", "own", "value"])

    def settle(batches):
        """All values of each chunk to one row for each text."""
        owns, sums = {}, {}
        for batch in batches:
            for chunk, own, value in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                if own:
                    owns[chunk] = unpacked(value)
                else:
                    sums.setdefault(chunk, []).append(value)
        for chunk, (ids, none, n_tokens, *known) in owns.items():
            known = [x.astype(float) for x in known]
            for value in sums.pop(chunk, ()):
                some, *more = unpacked(value)
                for x, y in zip(known, more, strict=True):
                    x[some] += y
            for a in range(0, len(ids), 10_000):
                s = slice(a, a + 10_000)
                columns = [pa.array(ids[s], mask=none[s].astype(bool)), pa.array(n_tokens[s]), pa.array(np.rint(known[0][s]).astype(np.int64)), pa.array(known[1][s]), pa.array(known[2][s])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base", "score"])

    asked = rows.mapInArrow(lean(ask), "k int, chunk long, kind int, value binary, texts binary")
    told = model.mapInArrow(lean(_opened(tell)), "k int, kind int, value binary").select("k", F.lit(None).cast("long").alias("chunk"), "kind", "value", F.lit(None).cast("binary").alias("texts"))
    met = asked.union(told).repartition(tasks, "k").mapInArrow(lean(meet), "chunk long, own boolean, value binary")
    out = met.repartition(tasks, "chunk").mapInArrow(lean(settle), "doc_id long, n_tokens long, n_known long, base double, score double")
    log_n = float(np.log10(v.tokens + v.words + 1))
    return out.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(log_n)).alias("base_score"), (F.col("score") if v.tokens else F.lit(0.0)).alias("score"),
    )
