"""Numpy helpers that run inside tasks: byte views of Arrow text, words, and word hashes.

A batch of texts is one byte array with offsets. Words are [^\\x20\\x09-\\x0D]+
with A-Z lower-cased; a word's 64-bit hash is a polynomial over random byte
values, so hashes of all words of a batch come from one running sum.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SLICE_BYTES = 1_000_000

_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2 ** 64, kept for the next call."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, SLICE_BYTES // 8), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        _powers[base] = got
    return got[:n]


def trim() -> None:
    """Give freed memory back: workers live on from stage to stage, and would keep each one's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each text (one more for the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offs)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans."""
    n = len(data)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n), out=run[1:])
    h = (run[end] - run[start]) * powers(_UNBASE, n + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and the number of words before each text."""
    data = LOWER[data]
    start, end, at = words(data, offs)
    return span_hashes(data, start, end), at


def ngram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbouring words, at each place where n words follow (across texts too: the caller cuts)."""
    m = len(w) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = w[:m].copy()
    for i in range(1, n):
        h *= U(0x9FB21C651E98DF25)
        h += w[i : i + m]
        h ^= h >> U(29)
    return mix(h + U(n))


def shingle_sets(w: np.ndarray, at: np.ndarray, n: int):
    """Per text, the sorted distinct n-word shingles; a shorter text has its whole sequence as one, an empty one none."""
    grams = ngram_hashes(w, n)
    for i in range(len(at) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield ngram_hashes(w[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def lists(values: np.ndarray, offs: np.ndarray, kind=None) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(offs, np.int32)), pa.array(values, type=kind))
