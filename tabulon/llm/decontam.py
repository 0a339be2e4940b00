"""Benchmark decontamination by winnowing.

Of every `width` consecutive k-gram hashes of a text the least are kept (all of equal least ones), so any span of k + width - 1 words
that two texts share leaves at least one fingerprint at the same place of the span in both. Test fingerprints are joined to the
documents' fingerprints while these are made, and each meeting is extended word by word, on the words themselves, to the longest
shared span. A span counts if it holds a whole window of the item: `window` consecutive words, or all words of a shorter item.

The test set is joined as a broadcast of checked size: beyond `block_bytes` it is cut into blocks by a hash of its items, one pass
over the documents each. For that the documents are written once with a row number, by which the spans of the passes are merged and rows
are dropped, so each row is judged by itself whatever the test set's size. Documents are never shuffled with their text.

Defined results: null or empty texts have no words and are clean; repeated items and documents count each by itself; an item without an id
hits and contaminates like any other, but is left out of n_items and items_sha256; an empty test set leaves every document clean; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import ALNUM, LOWER, lean, mix, slices, span_hashes, utf8, words

#: k of the k-grams for a guarantee of `window` words; the rest of the window is winnowed.
GRAM = 6
#: Bytes of test text that one broadcast may hold.
BLOCK_BYTES = 32 << 20

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, at the place of the first; short by k - 1 at the end."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mix(out)


def winnow(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some window of `width` valid places in a row. valid: the gram lies within one text."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if width == 1:
        return np.flatnonzero(valid)
    least = grams[:n].copy()
    whole = valid[:n].copy()
    for j in range(1, width):
        np.minimum(least, grams[j : j + n], out=least)
        whole &= valid[j : j + n]
    least[~whole] = 0
    best = np.zeros(len(grams), np.uint64)
    for j in range(width):
        np.maximum(best[j : j + n], least, out=best[j : j + n])
    return np.flatnonzero((best == grams) & valid & (best != 0))


class TestSet:
    """Fingerprints and words of a block of test items."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window, self.items = window, []
        found: dict[tuple[int, int], dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for name, text in items:
            data = LOWER[np.frombuffer(text, np.uint8)]
            starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
            if not len(starts):
                continue
            low, at = data.tobytes(), len(self.items)
            self.items.append((name, [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]))
            n = len(starts)
            # Items of n words with a common power of two below them share a k; longer ones share the guarantee of `window` words.
            k, width = (min(GRAM, window), window - min(GRAM, window) + 1) if n >= window else (1 << (n.bit_length() - 1), 1)
            grams = gram_hashes(span_hashes(data, starts, ends), k)
            places = winnow(grams, np.ones(len(grams), bool), width) if n >= window else [0]
            for p in places:
                found[k, width][int(grams[p])].append((at, int(p)))
        self.kinds = [(k, width, np.array(sorted(hits), np.uint64), [hits[h] for h in sorted(hits)]) for (k, width), hits in sorted(found.items())]

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """By row: the word spans shared with items, and the items' names. first: index of each row's first word."""
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        names: dict[int, set[str]] = defaultdict(set)
        if not self.kinds or not len(starts):
            return spans, names
        hashes = span_hashes(data, starts, ends)
        limit = np.repeat(first[1:], np.diff(first))  # index after the last word of each word's row
        low, st, en = data, starts, ends
        for k, width, keys, places in self.kinds:
            grams = gram_hashes(hashes, k)
            if not len(grams):
                continue
            chosen = winnow(grams, np.arange(len(grams)) + k <= limit[: len(grams)], width)
            at = np.searchsorted(keys, grams[chosen])
            at[at == len(keys)] = 0
            met = keys[at] == grams[chosen]
            done: dict[tuple[int, int, int], int] = {}  # (row, item, offset) to the end of the last span
            rows = np.searchsorted(first, chosen[met], "right") - 1
            for p, h, row in zip(chosen[met].tolist(), at[met].tolist(), rows.tolist(), strict=True):
                lo, hi = int(first[row]), int(first[row + 1])
                for item, q in places[h]:
                    if done.get((row, item, p - q), -1) >= p + k:
                        continue
                    name, words_ = self.items[item]
                    word = lambda i: low[st[i] : en[i]].tobytes()
                    a, b = p, p
                    while b < hi and b - p + q < len(words_) and word(b) == words_[b - p + q]:
                        b += 1
                    while a > lo and a - p + q > 0 and word(a - 1) == words_[a - 1 - p + q]:
                        a -= 1
                    done[row, item, p - q] = max(b, p + k)
                    if b - a >= min(self.window, len(words_)):
                        spans[row].append((a - lo, b - lo))
                        if name is not None:
                            names[row].add(name)
        return spans, names


_WORKER: dict[str, TestSet] = {}


def _test_set(key: str, shared, window: int) -> TestSet:
    """A broadcast block's fingerprints, made once in each Python worker."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = TestSet(shared.value, window)
    return _WORKER[key]


def merged(spans: list[tuple[int, int]]) -> int:
    """Words in the union of the spans."""
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def leaks(spans: list[tuple[int, int]], n_words: int, window: int, share: int) -> bool:
    """Whether a text is to be left out: it holds a whole window, however long it is, or shorter items that are 1/share of its words."""
    return any(b - a >= window for a, b in spans) or (bool(spans) and share * merged(spans) >= n_words)


def _row(n_words: int, spans, names, share: int) -> tuple[int, int, str, bool]:
    n_hit = merged(spans)
    return n_hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n_hit > 0 and share * n_hit >= n_words


def _sized(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    """Items (item, text) and the bytes of their texts."""
    items = benchmark.select(F.col(item_id_col).cast("string").alias("item"), utf8(item_text_col).alias("text"))
    return items, items.agg(F.sum(F.length("text"))).first()[0] or 0


def _in_blocks(source: DataFrame, items: DataFrame, blocks: int, window: int, share: int) -> DataFrame:
    """source (row, doc_id, text; row differs) to row, leaked and SCHEMA's columns, by one pass for each block of items."""
    sc = source.sparkSession.sparkContext

    def passed(block: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        shared = sc.broadcast([(r.item, bytes(r.text)) for r in own.collect()])  # about block_bytes
        key = uuid.uuid4().hex

        def run(batches):
            test = _test_set(key, shared, window)
            for batch in batches:
                out = []
                for _, _, raw, offs in slices(batch, 2):
                    data = LOWER[raw]
                    starts, ends, first = words(data, offs, ALNUM)
                    spans, names = test.hits(data, starts, ends, first)
                    out += [(n, [x for s in spans.get(row, ()) for x in s], sorted(names.get(row, ()))) for row, n in enumerate(np.diff(first).tolist())]
                columns = list(zip(*out, strict=True)) if out else [()] * 3
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["row", "doc_id", "n_words", "spans", "items"])

        return source.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_words long, spans array<long>, items array<string>")

    every = passed(0)
    for b in range(1, blocks):
        every = every.union(passed(b))
    both = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def settle(batches):
        for batch in batches:
            out = []
            for row, doc, n_words, spans, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = list(zip(spans[::2], spans[1::2], strict=True))
                out.append((row, leaks(pairs, n_words, window, share), doc, n_words, *_row(n_words, pairs, set(names), share)))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list("abcdefgh"))

    return both.mapInArrow(settle, f"row long, leaked boolean, {SCHEMA}")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document SCHEMA's columns: contaminated if at least 1/share of its words lie in an occurrence of an item's window."""
    items, size = _sized(benchmark, item_id_col, item_text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    if size > block_bytes:
        source = Scratch(docs.sparkSession, "decontam").save(source.withColumn("row", F.monotonically_increasing_id()), "source")
        return _in_blocks(source, items, -(-size // block_bytes), window, share).drop("row", "leaked")
    shared = docs.sparkSession.sparkContext.broadcast([(r.item, bytes(r.text)) for r in items.collect()])  # at most block_bytes
    key = uuid.uuid4().hex

    def run(batches):
        test = _test_set(key, shared, window)
        for batch in batches:
            out = []
            for _, _, raw, offs in slices(batch, 1):
                data = LOWER[raw]
                starts, ends, first = words(data, offs, ALNUM)
                spans, names = test.hits(data, starts, ends, first)
                out += [(n, *_row(n, spans.get(row, []), names.get(row, ()), share)) for row, n in enumerate(np.diff(first).tolist())]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *"abcde"])

    return source.mapInArrow(lean(run), SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that do not leak test items (see `leaks`), unchanged. A test set of one block is matched in place, without a shuffle."""
    items, size = _sized(benchmark, item_id_col, item_text_col)
    if size > block_bytes:
        mark = f"_row_{uuid.uuid4().hex}"
        kept = Scratch(docs.sparkSession, "decontam").save(docs.withColumn(mark, F.monotonically_increasing_id()), "source")
        source = kept.select(F.col(mark).alias("row"), F.lit(None).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
        found = _in_blocks(source, items, -(-size // block_bytes), window, share)
        return kept.join(found.where("leaked").select(F.col("row").alias(mark)), mark, "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast([(r.item, bytes(r.text)) for r in items.collect()])  # at most block_bytes
    at, key = docs.columns.index(text_col), uuid.uuid4().hex

    def run(batches):
        test = _test_set(key, shared, window)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, _, raw, offs in slices(batch, at):
                data = LOWER[raw]
                starts, ends, first = words(data, offs, ALNUM)
                for row, spans in test.hits(data, starts, ends, first)[0].items():
                    keep[a + row] = not leaks(spans, int(first[row + 1] - first[row]), window, share)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)


#: DuckDB SQL of the registered query.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' '))) AS win
  FROM b WHERE len(w) > 0
), n AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS win
  FROM d, n WHERE len(w) >= n
), hit AS (SELECT DISTINCT doc_id, i, dw.n, item FROM dw JOIN bw USING (n, win)), word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN its USING (doc_id)
"""
