"""Sets of word shingles as sorted 64-bit hashes, computed on Arrow buffers with numpy.

A word's hash is a polynomial over its bytes (each byte mapped to a random 64-bit value),
taken for all words of a slice at once from running sums; a shingle's hash mixes those of its
words. Two sets are compared by these hashes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _tables():
    base = 0x9E3779B97F4A7C15 | 1
    byte = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return base, byte[lower], byte, space


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n or more; the usual length is kept."""
    size = max(n, SLICE + 1)
    if size in _POWERS:
        return _POWERS[size]
    base = _tables()[0]
    pair = []
    for factor in (base, pow(base, -1, 1 << 64)):
        run = np.full(size, factor, np.uint64)
        run[0] = 1
        pair.append(np.multiply.accumulate(run))
    if size == SLICE + 1:
        _POWERS[size] = pair[0], pair[1]
    return pair[0], pair[1]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row of each word) of a string column, in order; A-Z lower-cased."""
    hashes, rows, _, _, _ = word_spans(column)
    return hashes, rows


def word_spans(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of a string column, in order: hash, row, begin and end in the bytes, which
    come last."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    starts_of_rows = offsets[:-1] - offsets[0]
    _, lowered, exact, space = _tables()
    byte = lowered if lower else exact
    blank = space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets - offsets[0]] = True  # a row begins (or all end) here
    hashes, rows, begins, ends, a = [], [], [], [], 0
    while a < len(data):
        b = min(len(data), a + SLICE)
        if b < len(data) and not (cut[b] or blank[b]):
            rest = blank[b:] | cut[b:-1]
            step = int(rest.argmax())
            b = b + step if rest[step] else len(data)
        part, gap, new = data[a:b], blank[a:b], cut[a:b]
        solid = ~gap
        first = solid.copy()
        first[1:] &= gap[:-1] | new[1:]
        last = solid.copy()
        last[:-1] &= gap[1:] | new[1:]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(begin):
            up, down = _powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(byte[part] * up[: len(part)], out=total[1:])
            hashes.append(mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)))
            rows.append(np.searchsorted(starts_of_rows, begin + a, "right") - 1)
            begins.append(begin + a)
            ends.append(end + a)
        a = b
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, data
    return np.concatenate(hashes), np.concatenate(rows), np.concatenate(begins), np.concatenate(ends), data


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row its distinct k-word shingles as sorted hashes. A row with fewer words has
    one shingle, its whole sequence; a row without words (or null) has none."""
    words, rows = words_of(column)
    counts = np.bincount(rows, minlength=len(column))[: len(column)] if len(column) else np.zeros(0, int)
    ends = np.cumsum(counts)
    odd = [_U(((2 * i + 3) * 0xC2B2AE3D27D4EB4F) & (2**64 - 1) | 1) for i in range(k)]
    if len(words) >= k:
        all_shingles = words[: len(words) - k + 1] * odd[0]
        for i in range(1, k):
            all_shingles = all_shingles + words[i : len(words) - k + 1 + i] * odd[i]
        all_shingles = mix(all_shingles)
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= k:
            s = np.sort(all_shingles[end - n : end - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            own = words[end - n : end]
            total = _U(n)
            for i in range(n):
                total = total + own[i] * odd[i]
            yield mix(np.array([total], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
