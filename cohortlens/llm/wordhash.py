"""Vectorised words and word hashes of a batch of texts (numpy, inside tasks).

A batch is the concatenation of its UTF-8 texts, one separator byte after each.
A word's hash is a polynomial over its bytes modulo 2^64, taken from prefix sums
and mixed with its length; no Python work is done per word.  Batches are cut so
that the buffer stays within ``MAX_BYTES`` unless a single text is longer, and
the prefix sums are taken over slices of whole words of about ``SLICE`` bytes, so
a very long text takes some ten times its size, a word longer than a slice more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAX_BYTES = 4 << 20
SMALL_BYTES = 1 << 20   # for tasks that hold more than the batch
SLICE = 1 << 19
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = _SPACE.copy()
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, int]] = {}


def powers(base: U, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2^64, kept for the next batch."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 12), base, dtype=U)
        out[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; where the slice begins makes no difference."""
    a, n = start[0], int(stop[-1] - start[0])
    total = np.zeros(n + 1, dtype=U)
    np.cumsum((data[a:a + n].astype(U) + U(1)) * powers(_BASE, n), out=total[1:])
    raw = (total[stop - a] - total[start - a]) * powers(_INVERSE, n + 1)[start - a]
    return mix(raw + (stop - start).astype(U) * U(0xD6E8FEB86659FD93))


class Words:
    """Words of a batch: ``hash`` per word, ``first`` (per text, index of its first word; one more at the end)."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, lower: bool, marks: bool = False):
        # ends: for each text, the index of its separator byte in data
        if lower:
            data = _LOWER[data]
        self.data = data
        word = ~(_MARK if marks else _SPACE)[data]
        word[ends] = False
        edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends))).astype(np.int64)
        self.hash = np.empty(len(self.start), dtype=U)
        i = 0
        while i < len(self.start):      # a slice: words i to j
            j = max(i + 1, int(np.searchsorted(self.stop, self.start[i] + SLICE, side="right")))
            self.hash[i:j] = _hashes(data, self.start[i:j], self.stop[i:j])
            i = j

    def __len__(self) -> int:
        return len(self.first) - 1

    def text(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def batches(texts: pa.Array, lower: bool = False, max_bytes: int = MAX_BYTES,
            marks: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of consecutive rows; nulls count as empty texts.

    With ``marks``, ASCII punctuation parts words as white space does.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    body = texts.buffers()[2]
    raw = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        lens = np.diff(offsets[i:j + 1])
        ends = np.cumsum(lens + 1) - 1
        data = np.full(int(ends[-1]) + 1, 32, dtype=np.uint8)
        inside = np.ones(len(data), dtype=bool)
        inside[ends] = False
        data[inside] = raw[offsets[i]:offsets[j]]
        yield i, j, Words(data, ends, lower, marks)
        i = j


_SHINGLE = U(0xA0761D6478BD642F | 1)
_SHINGLE_INV = U(pow(int(_SHINGLE), -1, 1 << 64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rolling (Rabin-Karp) hashes of every ``size`` consecutive words of a batch; a window may span two texts."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, dtype=U)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(hashes * powers(_SHINGLE, n), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(_SHINGLE_INV, n)[:n - size + 1])


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles per text: (hashes sorted within each text, offsets).

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    count = np.diff(w.first)
    rolled = windows(w.hash, size)
    owner = w.owner()[:len(rolled)]
    inside = np.arange(len(rolled)) + size <= w.first[owner + 1] if len(rolled) else np.zeros(0, bool)
    own, val = [owner[inside]], [rolled[inside]]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.array([mix(np.array([_fold(w.hash[w.text(i)])], dtype=U))[0] for i in short], dtype=U)
        own.append(short)
        val.append(whole)
    owner, value = np.concatenate(own), np.concatenate(val)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(value):
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
        owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(w) + 1)).astype(np.int64)


def _fold(hashes: np.ndarray) -> U:
    """Hash of a whole short sequence; its length is part of it, so it equals no longer shingle."""
    h = len(hashes)
    for x in hashes.tolist():
        h = (h * 0xE7037ED1A0B428DB + x) & 0xFFFFFFFFFFFFFFFF
    return U(h)
