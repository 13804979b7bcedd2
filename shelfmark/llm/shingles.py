"""Words and word shingles of whole texts, hashed with numpy straight from Arrow buffers.

Words are runs of bytes outside space and 0x09-0x0D after A-Z is lower-cased. Nothing here depends on
Spark: the functions take one Arrow string column and return flat arrays, so each caller decides what
to emit. Temporary arrays cover CHUNK bytes at a time however long a text is.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SHINGLE_WORDS = 5

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (shifts and odd multiplications), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
    up, down = np.full(n, _PRIME), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before it (n + 1 values)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each (lower-cased) word."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        base = int(starts[i])
        piece = _LOWER[data[base : int(ends[j - 1])]]
        up, down = _powers(max(CHUNK, len(piece)))
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _STEPS[1]
        i = j
    return mix64(out)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words within a text, in order, and for each text the number before it.

    A text with fewer words, but some, has its whole sequence as its one shingle; one without words has none.
    """
    n = np.diff(counts)
    have = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(have)])
    out = np.empty(int(before[-1]), dtype=np.uint64)
    if len(words) >= size:
        runs = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for k in range(size):
            runs += words[k : k + len(runs)] * _STEPS[k]
        long = n >= size
        take = np.repeat(counts[:-1][long] - np.cumsum(have[long]) + have[long], have[long]) + np.arange(int(have[long].sum()))
        out[np.repeat(long, have)] = mix64(runs[take] + np.uint64(size))
    for i in np.flatnonzero((n > 0) & (n < size)):
        own = words[counts[i] : counts[i + 1]]
        out[before[i]] = mix64(np.sum(own * _STEPS[: len(own)], dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, before


def text_shingles(column: pa.Array, size: int = SHINGLE_WORDS):
    """Yields, text by text, the sorted distinct shingle hashes of an Arrow string column."""
    data, offsets = text_bytes(column)
    starts, ends, counts = word_bounds(data, offsets)
    hashes, before = shingle_hashes(word_hashes(data, starts, ends), counts, size)
    for i in range(len(offsets) - 1):
        yield np.unique(hashes[before[i] : before[i + 1]])
