"""Byte-level text work on Arrow batches: slices of bounded size, word boundaries and 64-bit word hashes in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lean(run):
    """A function over batches that, when it has ended, gives unused memory back: workers wait for more tasks, and keep what they once took."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not that C library
            pass

    return wrapped


def byte_class(inside) -> np.ndarray:
    """Lookup table over the 256 byte values: True where inside(value)."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Everything but white space U+0020 and U+0009 to U+000D.
NOT_SPACE = byte_class(lambda b: b != 0x20 and not 9 <= b <= 13)
#: ASCII letters and digits, and every byte of a character outside ASCII.
ALNUM = byte_class(lambda b: b >= 128 or chr(b).isalnum())


def utf8(column: str) -> Column:
    """The text as bytes; null as no bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in the bytes) of runs of rows of about SLICE_BYTES. Nulls have no bytes."""
    arr = batch.column(column)
    n = len(arr)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type) else np.int32
    offs = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + SLICE_BYTES, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for k, base in ((0, _P), (1, inverse)):
            run = np.full(n + n // 4, base, np.uint64)
            run[0] = 1
            _POWERS[k] = np.multiply.accumulate(run)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of bytes in the class, never over a row's end), and each row's first word's index."""
    n = len(data)
    word = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[1:], before[:1] = word[:-1], False
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[:-1], after[-1:] = word[1:], False
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], from prefix sums of a polynomial; length enters too."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
