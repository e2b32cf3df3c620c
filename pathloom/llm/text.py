"""Words and word shingles of a column of texts as 64-bit hashes, computed over the bytes of an Arrow batch.

A word is a run of bytes other than ASCII white space; A-Z are lowered. Hashes depend on the text alone, so they agree
between tasks and runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SHINGLE_WORDS = 5
# Bytes worked on at once; the arrays of a step take about ten times as much.
SEGMENT = 1 << 20
GROUP = 1 << 20
BATCH_BYTES = 4 << 20
_BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Between words of letters: every ASCII character that is no letter.
NO_LETTER = np.arange(256) < 0x80
for _letter in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    NO_LETTER[_letter] = False
_LOWER = np.arange(256)
_LOWER[ord("A"):ord("Z") + 1] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64, endpoint=False)[_LOWER]
_TAP = _RANDOM.integers(0, 2**63, SHINGLE_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def release_memory() -> None:
    """Give back what is not used any more. Python workers outlive their tasks, and executors count their memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most ``BATCH_BYTES``, unless the session names a bound of its own.

    Batches are held by the executor's JVM and by the worker, and 10,000 long texts, the usual batch, take several times their size on both sides.
    """
    if spark.conf.get(_BATCH_BOUND, None) is None:
        spark.conf.set(_BATCH_BOUND, BATCH_BYTES)


def releasing(work: Callable) -> Callable:
    """``work`` over Arrow batches that gives its memory back at the end of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release_memory()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        table = np.full(max(n, SEGMENT + 1), base, np.uint64)
        table[0] = 1
        _powers[base] = np.cumprod(table, dtype=np.uint64)
    return _powers[base][:n]


def row_groups(column: pa.Array, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes of text together; a longer text stands alone."""
    ends = _offsets(column)[1:]
    start = 0
    while start < len(column):
        first = ends[start - 1] if start else _offsets(column)[0]
        stop = max(start + 1, int(np.searchsorted(ends, first + limit, "right")))
        yield start, stop
        start = stop


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (they become empty texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def word_hashes(column: pa.Array, gaps: np.ndarray = _SPACE, starts_of: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts in order, and for each text the number of words before it (one more entry
    at the end holds the number of all words). ``gaps`` tells for each byte value whether it stands between words.

    With ``starts_of`` there is one column per word for its hash and for the hashes of its first bytes, so many each."""
    offsets = _offsets(column).astype(np.int64)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.empty((0, 1 + len(starts_of))[:1 + bool(starts_of)], np.uint64), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    starts = np.flatnonzero(inside & (edge[:-1] | ~before[:-1]))
    after = np.append(inside[1:], False)
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    hashes = np.empty((len(starts), 1 + len(starts_of)), np.uint64)
    word = 0
    while word < len(starts):
        base = starts[word]
        stop = max(word + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
        part = _BYTE[data[base:ends[stop - 1]]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _power(_BASE, len(part)), out=sums[1:])
        s, e = starts[word:stop] - base, ends[word:stop] - base
        back = _power(_INVERSE, len(part))[s]
        hashes[word:stop, 0] = mix((sums[e] - sums[s]) * back + (e - s).astype(np.uint64))
        for column_, size in enumerate(starts_of, 1):
            hashes[word:stop, column_] = mix((sums[np.minimum(s + size, e)] - sums[s]) * back + np.uint64(size << 40))
        word = stop
    return hashes if starts_of else hashes[:, 0], np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``SHINGLE_WORDS`` words. A shorter text that has words is
    one shingle; a text without words has none."""
    k = SHINGLE_WORDS
    for start, stop in row_groups(column):
        hashes, first = word_hashes(column.slice(start, stop - start))
        rolled = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
        for j in range(k):
            rolled += hashes[j:len(rolled) + j] * _TAP[j]
        rolled = mix(rolled)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield np.unique(rolled[a:b - k + 1])
            elif b > a:
                short = (hashes[a:b] * _TAP[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(mix(np.array([short], np.uint64)))
            else:
                yield np.empty(0, np.uint64)
