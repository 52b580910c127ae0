"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer word is a piece of its own.
PIECE = 1 << 20
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, PIECE), _powers(_INVERSE, PIECE)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text given as bytes; A-Z lower-cased, words as ``[^\\x20\\x09-\\x0D]+``."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            cut = np.flatnonzero(_SPACE[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:
                rest = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else n
        out.append(_hash_piece(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hash_piece(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = (_UP, _DOWN) if len(data) <= PIECE else (_powers(_BASE, len(data)), _powers(_INVERSE, len(data)))
    terms = _BYTE[_LOWER[data]] * up[: len(data)]
    terms[space] = 0
    # over the word, the sum of byte * base^(place in the word)
    sums = np.add.reduceat(terms, starts) * down[starts]
    return mix(sums + (ends - starts).astype(np.uint64) * _M2)


def span_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the spans of at most ``PIECE`` bytes that begin at ``starts`` (the first at 0) and follow each other."""
    terms = _BYTE[data] * _UP[: len(data)]
    lengths = np.diff(np.append(starts, len(data))).astype(np.uint64)
    return mix(np.add.reduceat(terms, starts) * _DOWN[starts] + lengths * _M2)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values (``np.unique`` hashes integers first, which is slower by far)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def shingle_set(data: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of all words as one; none without words."""
    words = word_hashes(data)
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        h = mix(h * _BASE + words[i : n - width + 1 + i])
    return distinct(h)


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each value, a null as none, without copying."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[a:b]
