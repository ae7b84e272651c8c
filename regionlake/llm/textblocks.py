"""Vectorised words, shingles and MinHash values of Arrow batches of texts, used inside tasks.

Texts are handled in blocks of about a megabyte, so memory does not grow with the batch.  Words are what stands between
ASCII white space; a shingle is ``k`` words in a row, or all words of a text that has fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SHINGLE = 5

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_POWERS = 1 << 16


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


_BYTE = _odd(1, 256)
_STEP = _odd(2, 16)
_POW = np.multiply.accumulate(np.full(_POWERS, _odd(3, 1)[0], np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK bytes; a longer text is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hash_words(data: np.ndarray, at: np.ndarray, gaps: np.ndarray = _WS, prefixes: tuple[int, ...] = ()):
    """64-bit hashes of the words of the texts data[at[i]:at[i+1]], and the number of words of each.

    ``gaps`` tells which bytes stand between words.  With ``prefixes``, hashes of the first p bytes of each word follow.
    """
    base, n = at[0], len(at) - 1
    data = data[base:at[-1]]
    ink = ~gaps[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    heads = (at[:-1] - base)[at[1:] > at[:-1]]
    first[heads] = ink[heads]
    starts = np.flatnonzero(first)
    counts = np.zeros(n, np.int64)
    if not len(starts):
        return (np.zeros(0, np.uint64), counts, *(np.zeros(0, np.uint64) for _ in prefixes))
    word = np.cumsum(first)[ink] - 1
    place = np.flatnonzero(ink)
    depth = place - starts[word]
    value = _BYTE[data[place]] * _POW[depth % _POWERS] + (depth // _POWERS).astype(np.uint64)
    heads = np.flatnonzero(first[place])
    counts = np.diff(np.searchsorted(starts, at - base))
    short = (mix(np.add.reduceat(value * (depth < p), heads)) for p in prefixes)
    return (mix(np.add.reduceat(value, heads)), counts, *short)


def distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(counts))


def shingle(hashes: np.ndarray, counts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, repeated ones included, and the number of each text."""
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    if not n.sum():
        return np.zeros(0, np.uint64), n
    ends = np.repeat(np.cumsum(counts), n)
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    padded = np.append(hashes, np.zeros(k, np.uint64))
    out = np.zeros(len(first), np.uint64)
    for j in range(k):
        out += np.where(first + j < ends, padded[first + j] * _STEP[j], np.uint64(j + 1))
    return mix(out), n


def text_shingles(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    data, at = buffers(column)
    for i, j in blocks(at):
        values, n = shingle(*hash_words(data, at[i:j + 1]), k)
        for part in np.split(values, np.cumsum(n)[:-1]):
            yield np.unique(part)


def minhash(values: np.ndarray, starts: np.ndarray, rows: int, seed: int = 7) -> np.ndarray:
    """``rows`` MinHash values (uint32) of each run of ``values`` that begins at ``starts``."""
    mult, add = _odd(seed, rows), _odd(seed + 1, rows)
    out = np.empty((len(starts), rows), np.uint32)
    for r in range(rows):
        h = ((values * mult[r] + add[r]) >> np.uint64(32)).astype(np.uint32)
        out[:, r] = np.minimum.reduceat(h, starts)
    return out
