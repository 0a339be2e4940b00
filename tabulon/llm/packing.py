"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens, in bulk-synchronous supersteps.

1. Documents are tokenised once and cut into pieces of at most `capacity` tokens; the pieces (no texts, no ids) are written to the
   shared folder. As many sequences are opened as their tokens fill: gaps of the whole capacity.
2. A superstep sorts pieces and gaps together by size, largest first, over ranges of rows (a size that many rows have is spread over
   several). In each range the largest piece takes its successor, the least gap that still holds it, the next piece the next one, and
   so on: gaps are opening brackets, pieces closing ones. What a range leaves is settled between ranges by rank: the first pieces of a
   range take the last gaps of the ranges before it, and meet in a join by range and rank. A gap takes one piece a superstep.
3. Gaps are updated, and the next superstep places the pieces that found none. When few of them do, new sequences are opened.
   Each superstep places the largest pieces that fit, so some ten of them place almost all. As soon as ONE_RANGE rows or fewer are
   left, they are one range, whose task repeats the sweep until all pieces are placed.

The driver holds, for each superstep, counts by size (at most 2 * `capacity`) and two numbers of each range of RANGE_ROWS rows or more.

Defined results: null and empty texts are the end token alone; repeated rows are packed each by itself; an empty table gives no rows.
The tokenizer must be of the default's kind: it lower-cases, cuts at single digits, drops white space and never joins across it.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, one_to_one
from ._text import lean, utf8

CAPACITY = 4096
END_ID = 1
#: Pieces and gaps of a range, and least number of ranges, of a superstep.
RANGE_ROWS, RANGES = 100_000, 6
#: Pieces and gaps that one task finishes.
ONE_RANGE = 30_000
#: Words whose ids a worker remembers, and two thirds as many word parts: the first ones that it meets. After FORGET times as many others it begins anew.
CACHE_WORDS, FORGET = 300_000, 4
#: Words of ASCII and Latin-1 letters: no apostrophe, no `<`, no combining characters, so they are cut only between letters, single digits and other characters.
_PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Bytes as the characters that a byte-level vocabulary is written in: visible Latin-1 as itself, the others from U+0100 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHARS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_WORKERS: dict[int, WordCoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCoder:
    """Little-endian 32-bit ids of a text, word by word with a memory. For tokenizers that drop white space and never join across it."""

    def __init__(self, spec: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_str(spec)
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[bytes, bytes] = {}
        self.others = 0
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """Ids of lower-case letters, of one digit or of other characters, as the tokenizer's pattern leaves them."""
        if (ids := self.parts.get(part)) is None:
            written = part if part.isascii() else part.encode().decode("latin-1").translate(_AS_CHARS)
            ids = b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(written)])
            if len(self.parts) >= 2 * self.most // 3:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        low = word.lower()
        if low.isalpha():  # ASCII letters only
            return self._part(low.decode())
        if low[-1:] in (b".", b",") and low[:-1].isalpha():
            return self._part(low[:-1].decode()) + self._part(low[-1:].decode())
        text = word.decode()
        if _PLAIN.fullmatch(text):
            return b"".join(map(self._part, _PARTS.findall(text.lower())))
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _missing(self, word: bytes) -> bytes:
        """Ids of a word that is not remembered."""
        if (ids := self.words.get(word)) is None:
            ids = self._word(word)
            if len(self.words) < self.most and len(word) <= 64:
                self.words[word] = ids
            else:
                self.others += 1
                if self.others > FORGET * self.most:
                    self.words, self.others = {}, 0
        return ids

    def encode(self, text: bytes) -> bytes:
        words = text.split()
        out = list(map(self.words.get, words))
        for at in [i for i, ids in enumerate(out) if ids is None]:
            out[at] = self._missing(words[at])
        return b"".join(out)


def worker_coder(spec: str, most: int) -> WordCoder:
    """One coder for each Python worker, kept over its tasks."""
    if (key := hash((spec, most))) not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = WordCoder(spec, most)
    return _WORKERS[key]


#: Pieces (kind 1) and gaps (kind 0) with their sizes; of a gap its sequence, of a piece the rest.
STATE = "kind int, size int, seq long, doc_id long, piece long, start long, ids_crc32 long"


def pieces(docs: DataFrame, spec: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """STATE rows of each document's pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        coder = worker_coder(shared.value, cache_words)
        end = struct.pack("<I", END_ID)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode(text.as_py()) + end
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    rows.append((1, len(part) // 4, 0, doc, at // (4 * capacity), at // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)] if rows else [pa.array([], k) for k in _KINDS], list("abcdefg"))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return source.mapInArrow(lean(run), STATE)


_KINDS = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
_OUT = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
#: Roles of rows after a sweep: placed pieces (size; offset in the sequence), pieces without a gap, gaps without a piece, gaps as they are now.
PLACED, PIECE, GAP, CHANGED = range(4)
SWEPT = "part int, role int, rank long, offset long, size int, seq long, doc_id long, piece long, start long, ids_crc32 long"


def brackets(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of gaps (True) and pieces (False), largest first: matched gaps and their pieces, pieces left, gaps left (indices, each in order)."""
    height = np.cumsum(np.where(gap, 1, -1))
    floor = np.minimum(np.minimum.accumulate(height), 0) if len(gap) else height
    lost = ~gap & (floor < np.concatenate([[0], floor[:-1]]))
    level = height - floor + ~gap
    rest = np.flatnonzero(~lost)
    order = rest[np.argsort(level[rest], kind="stable")]  # on one level a gap and its piece follow one another
    pair = np.flatnonzero(gap[order][:-1] & ~gap[order][1:] & (level[order][:-1] == level[order][1:])) if len(order) else order
    taken = np.zeros(len(gap), bool)
    taken[order[pair]] = True
    return order[pair], order[pair + 1], np.flatnonzero(lost), np.flatnonzero(gap & ~taken)


def between(left: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Of the ranges' pieces and gaps left (counts, in order): runs (range, first rank, rank after the last, range of the gaps, gap's rank after
    the first's), by which the piece of rank first + i takes the gap of rank last - 1 - i; and the gaps that each range keeps."""
    runs, stack, kept = [], [], {}
    for part, (wanting, offered) in enumerate(left):
        rank = 0
        while rank < wanting and stack:
            of, n = stack.pop()
            take = min(n, wanting - rank)
            runs.append((part, rank, rank + take, of, n))
            rank += take
            if n > take:
                stack.append((of, n - take))
        if offered:
            stack.append((part, offered))
    kept.update(stack)
    return runs, kept


def _ranges(counts: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray, int]:
    """By size and kind (index size * 2 + kind): the first range of such rows and how many they are spread over; the number of ranges."""
    total = sum(counts.values())
    n = max(RANGES, -(-total // RANGE_ROWS))
    top = 2 * max(size for _, size in counts) + 2
    first, spread, before = np.zeros(top, np.int64), np.ones(top, np.int64), 0
    for kind, size in sorted(counts, key=lambda x: (-x[1], x[0])):
        a, b = before * n // total, (before + counts[kind, size] - 1) * n // total
        first[2 * size + kind], spread[2 * size + kind] = a, b - a + 1
        before += counts[kind, size]
    return first, spread, n


def _sweep(state: DataFrame, counts: dict[tuple[int, int], int], capacity: int, scratch: Scratch, step: int) -> tuple[DataFrame, DataFrame]:
    """One superstep: rows placed (STATE's columns and offset), and the state after it."""
    spark = state.sparkSession
    first, spread, n = _ranges(counts)
    keys = one_to_one(n)

    def deal(batches):
        for batch in batches:
            kind, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = 2 * size.astype(np.int64) + kind
            part = first[at] + np.arange(batch.num_rows) % spread[at]
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(part.astype(np.int32)), *batch.columns], ["k", "part", *batch.schema.names])

    def match(batches):
        held = [pa.Table.from_batches([b]) for b in batches]
        if not held:
            return
        every = pa.concat_tables(held)
        parts = every["part"].to_numpy()
        for part in np.unique(parts):  # one, but where the number of partitions was changed
            rows = every.take(pa.array(np.flatnonzero(parts == part))) if (parts != part).any() else every
            kind, size = rows["kind"].to_numpy(), rows["size"].to_numpy().astype(np.int64)
            order = np.lexsort((kind, -size))
            gaps, taken, wanting, offered = brackets(kind[order] == 0)
            seq = rows["seq"].to_numpy()
            gaps, taken, wanting, offered = order[gaps], order[taken], order[wanting], order[offered]
            after = size[gaps] - size[taken]
            some = after > 0
            at = np.concatenate([taken, wanting, offered, gaps[some]])
            sizes = [len(taken), len(wanting), len(offered), int(some.sum())]
            role = np.repeat([PLACED, PIECE, GAP, CHANGED], sizes)
            rank = np.concatenate([np.zeros(sizes[0], np.int64), np.arange(sizes[1]), np.arange(sizes[2]), np.zeros(sizes[3], np.int64)])
            offset = np.concatenate([capacity - size[gaps], np.zeros(sum(sizes[1:]), np.int64)])
            columns = [np.full(len(at), part, np.int32), role.astype(np.int32), rank, offset, np.concatenate([size[taken], size[wanting], size[offered], after[some]]).astype(np.int32), np.concatenate([seq[gaps], seq[wanting], seq[offered], seq[gaps[some]]])]
            rest = rows.select(["doc_id", "piece", "start", "ids_crc32"]).take(pa.array(at)).combine_chunks()
            out = pa.Table.from_arrays([*map(pa.array, columns), *rest.columns], [x.split(" ")[0] for x in SWEPT.split(", ")])
            yield from out.to_batches(100_000)

    dealt = state.mapInArrow(deal, f"k int, part int, {STATE}").repartition(n, "k").drop("k")
    swept = scratch.save(dealt.mapInArrow(match, SWEPT), f"swept{step}")
    left = [[0, 0] for _ in range(n)]
    for r in swept.where(F.col("role").isin(PIECE, GAP)).groupBy("part", "role").count().collect():  # two numbers a range
        left[r.part][r.role - PIECE] = r["count"]
    runs, kept = between([tuple(x) for x in left])
    placed = swept.where(F.col("role") == PLACED)
    if not runs:
        return placed, _state(swept.where(F.col("role") != PLACED))
    table = np.array(sorted(runs), np.int64)
    start, limit = (table[:, 0] << 40) + table[:, 1], np.zeros(n, np.int64)
    for part, rest in kept.items():
        limit[part] = rest

    def settled(batches):
        """Adds the range and rank of the gap that a piece takes, or that a gap is if it is taken; -1 if none."""
        for batch in batches:
            part, role, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2))
            at = np.maximum(np.searchsorted(start, (part << 40) + rank, "right") - 1, 0)
            run = table[at]
            wants = (role == PIECE) & (run[:, 0] == part) & (rank >= run[:, 1]) & (rank < run[:, 2])
            taken = (role == GAP) & (rank >= limit[part])
            of = np.where(wants, run[:, 3], np.where(taken, part, -1))
            which = np.where(wants, run[:, 4] - 1 - (rank - run[:, 1]), np.where(taken, rank, -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(which)], [*batch.schema.names, "of", "which"])

    every = swept.where(F.col("role") != PLACED).mapInArrow(settled, f"{SWEPT}, of int, which long")
    gaps = every.where(f"of >= 0 AND role = {GAP}").select("of", "which", F.col("size").alias("free"), F.col("seq").alias("to"))
    met = scratch.save(every.where(f"of >= 0 AND role = {PIECE}").join(gaps, ["of", "which"]), f"met{step}")
    row = [x.split(" ")[0] for x in SWEPT.split(", ")]
    placed = placed.unionByName(met.withColumn("role", F.lit(PLACED)).withColumn("offset", (capacity - F.col("free")).cast("long")).withColumn("seq", F.col("to")).select(*row))
    changed = met.where("free > size").withColumn("role", F.lit(CHANGED)).withColumn("size", F.col("free") - F.col("size")).withColumn("seq", F.col("to")).select(*row)
    return placed, _state(every.where("of < 0").select(*row).unionByName(changed))


def opening(sizes: dict[int, int], capacity: int, first: bool) -> int:
    """New sequences for pieces of these sizes (to their numbers): as many as the tokens fill, or as pieces of over half a sequence need; after
    the first time, a sixth of the pieces."""
    tokens, large = sum(size * n for size, n in sizes.items()), sum(n for size, n in sizes.items() if 2 * size > capacity)
    return max(-(-tokens // capacity), large, 0 if first else -(-sum(sizes.values()) // 6))


def finish(size: np.ndarray, gap: np.ndarray, seq: np.ndarray, capacity: int, opened: int) -> tuple[np.ndarray, np.ndarray]:
    """Sweeps over one range until all pieces are placed: each piece's sequence and offset (0 for gaps). New sequences are numbered from `opened`."""
    to, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    pieces, free, of = np.flatnonzero(~gap), size[gap].astype(np.int64), seq[gap].astype(np.int64)
    before = None
    while len(pieces):
        if before is not None and 10 * (before - len(pieces)) < before:
            values, n = np.unique(size[pieces], return_counts=True)
            more = opening(dict(zip(values.tolist(), n.tolist(), strict=True)), capacity, False)
            free, of, opened = np.append(free, np.full(more, capacity)), np.append(of, opened + np.arange(more)), opened + more
        before = len(pieces)
        both, kind = np.concatenate([free, size[pieces]]), np.repeat([0, 1], [len(free), len(pieces)])
        order = np.lexsort((kind, -both))
        gaps, taken, wanting, _ = brackets(kind[order] == 0)
        gaps, taken, wanting = order[gaps], order[taken] - len(free), order[wanting] - len(free)
        at = pieces[taken]
        to[at], offset[at] = of[gaps], capacity - free[gaps]
        free[gaps] -= size[at]
        pieces = pieces[wanting]
        some = free > 0
        free, of = free[some], of[some]
    return to, offset


def _state(rows: DataFrame) -> DataFrame:
    return rows.select(F.when(F.col("role") == PIECE, 1).otherwise(0).alias("kind"), "size", "seq", "doc_id", "piece", "start", "ids_crc32")


def _last(state: DataFrame, capacity: int, opened: int) -> DataFrame:
    """All pieces of a small state, placed."""

    def run(batches):
        held = [pa.Table.from_batches([b]) for b in batches]
        if held:
            rows = pa.concat_tables(held)
            gap = rows["kind"].to_numpy() == 0
            size = rows["size"].to_numpy().astype(np.int64)
            to, offset = finish(size, gap, rows["seq"].to_numpy(), capacity, opened)
            out = pa.Table.from_arrays([pa.array(offset), pa.array(size.astype(np.int32)), pa.array(to), *(rows[c] for c in ("doc_id", "piece", "start", "ids_crc32"))], ["offset", "size", "seq", "doc_id", "piece", "start", "ids_crc32"])
            yield from out.filter(pa.array(~gap)).combine_chunks().to_batches(10_000)

    return state.repartition(1).mapInArrow(run, "offset long, size int, seq long, doc_id long, piece long, start long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (all long). cache_words: memory of a worker against its time."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    spec = Path(tokenizer_path or default_tokenizer()).read_text()  # on the driver; executors get it as a broadcast
    state = scratch.save(pieces(docs, spec, capacity, id_col, text_col, cache_words), "pieces")
    opened, step, before, done = 0, 0, None, []
    while True:
        counts = {(r.kind, r["size"]): r["count"] for r in state.groupBy("kind", "size").count().collect()}  # 2 * capacity rows at most
        sizes = {size: n for (kind, size), n in counts.items() if kind == 1}
        left = sum(sizes.values())
        if not left:
            break
        # Gaps that hold none of the pieces left take no part any more.
        least = min(sizes)
        state = state.where((F.col("kind") == 1) | (F.col("size") >= least))
        counts = {k: n for k, n in counts.items() if k[0] == 1 or k[1] >= least}
        # New sequences: to begin with, as many as the tokens fill; later, when few pieces find a gap.
        if before is None or 10 * (before - left) < before:
            more = opening(sizes, capacity, before is None)
            fresh = spark.range(opened, opened + more, numPartitions=max(1, more // RANGE_ROWS)).select(F.lit(0).alias("kind"), F.lit(capacity).alias("size"), F.col("id").alias("seq"), *(F.lit(None).cast("long").alias(c) for c in ("doc_id", "piece", "start", "ids_crc32")))
            state = state.unionByName(fresh)
            counts[0, capacity] = counts.get((0, capacity), 0) + more
            opened += more
        if sum(counts.values()) <= ONE_RANGE:
            done.append(_last(state, capacity, opened))
            break
        before = left
        placed, state = _sweep(state, counts, capacity, scratch, step)
        done.append(placed)
        step += 1
    columns = ("doc_id", "piece", "start", F.col("size").cast("long").alias("length"), "ids_crc32", F.col("seq").alias("sequence_id"), "offset")
    if not done:
        return state.select("doc_id", "piece", "start", F.col("size").cast("long").alias("length"), "ids_crc32", F.col("seq").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    return reduce(DataFrame.union, (x.select(*columns) for x in done))
