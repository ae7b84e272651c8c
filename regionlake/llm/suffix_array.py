"""Suffix arrays by induced sorting and permuted common prefixes, in numpy: a step handles all of a bucket's suffixes at once.

Texts are arrays of small numbers that end with a single 0, the least number.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and the places of leftmost such suffixes after a larger one."""
    ends = np.flatnonzero(t[:-1] != t[1:])
    small = np.empty(len(t), bool)
    small[:-1] = np.repeat(t[ends] < t[ends + 1], np.diff(ends, prepend=-1))
    small[-1] = True
    return small, (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)


def _spread(t, places, pointer, array, down):
    """Append places to the buckets of their characters, keeping their order; downwards from the buckets' ends if asked."""
    chars = t[places]
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    count = np.bincount(chars, minlength=len(pointer))
    step = np.arange(len(chars)) - (np.cumsum(count) - count)[chars]
    array[pointer[chars] - 1 - step if down else pointer[chars] + step] = places[order]
    pointer += -count if down else count


def induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes, ordered from the order of the leftmost smaller ones (``seeds``), in two linear passes."""
    count = np.bincount(t)
    ends = np.cumsum(count)
    starts = ends - count
    array = np.zeros(len(t), np.int32)
    chars = np.flatnonzero(count)
    by_char = seeds[np.argsort(t[seeds], kind="stable")]
    cuts = np.searchsorted(t[by_char], np.arange(len(count) + 1))

    def push(from_, pointer, kind, down):
        before = from_[from_ > 0] - 1
        before = before[small[before] == kind]
        if len(before):
            _spread(t, before, pointer, array, down)

    head = starts.copy()
    for ch in chars:  # larger suffixes, from the left
        at = starts[ch]
        while at < head[ch]:
            done, at = at, head[ch]
            push(array[done:at], head, False, False)
        push(by_char[cuts[ch]:cuts[ch + 1]], head, False, False)
    tail = ends.copy()
    for ch in chars[::-1]:  # smaller suffixes, from the right
        at = ends[ch]
        while at > tail[ch]:
            done, at = at, tail[ch]
            push(array[at:done][::-1], tail, True, True)
        push(array[starts[ch]:head[ch]][::-1], tail, True, True)
    array[0] = len(t) - 1
    return array


def _packed(t: np.ndarray) -> np.ndarray:
    """Four 16-bit numbers from each place on, as one."""
    wide = np.zeros(len(t) + 3, np.uint64)
    wide[:len(t)] = t
    n = len(t)
    return wide[:n] | wide[1:n + 1] << np.uint64(16) | wide[2:n + 2] << np.uint64(32) | wide[3:n + 3] << np.uint64(48)


def _named(t: np.ndarray, sorted_places: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ranks of the substrings between neighbouring ``places``, in text order; equal substrings have equal ranks."""
    length = np.ones(len(t), np.int32)
    length[places[:-1]] = np.diff(places) + 1
    a, b = sorted_places[:-1], sorted_places[1:]
    size = length[a]
    same = size == length[b]
    words, live, k = _packed(t), np.flatnonzero(same), 0
    last = len(t) - 1
    while len(live):
        x, y = words[np.minimum(a[live] + k, last)], words[np.minimum(b[live] + k, last)]
        rest = np.minimum(size[live] - k, 4).astype(np.uint64)
        differs = (x ^ y) << (np.uint64(64) - np.uint64(16) * rest) != 0
        same[live[differs]] = False
        k += 4
        live = live[~differs & (size[live] > k)]
    rank = np.empty(len(t), np.int32)
    rank[sorted_places] = np.concatenate([[0], np.cumsum(~same)])
    return rank[places]


def order_names(names: np.ndarray, step: int = 1, tied: np.ndarray | None = None) -> np.ndarray:
    """Ranks of the suffixes of a string of ranked names, by naming pairs of twice the length until all names differ.

    ``names`` are numbered with gaps: a name is the number of smaller ones.  ``tied`` are the places still to be told apart.
    """
    if tied is None:
        first = np.bincount(names)
        names = (np.cumsum(first) - first)[names]
        tied = np.arange(len(names))
    count = np.bincount(names[tied], minlength=0)
    tied = tied[count[names[tied]] > 1]
    if not len(tied):
        return names
    after = np.where(tied + step < len(names), names[np.minimum(tied + step, len(names) - 1)] + 1, 0)
    mine = names[tied]
    order = np.argsort(mine.astype(np.int64) * (len(names) + 1) + after)
    a, b = mine[order], after[order]
    at = np.arange(len(a))
    group = np.append(True, a[1:] != a[:-1])
    fresh = group | np.append(True, b[1:] != b[:-1])
    within = np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
    out = names.copy()
    out[tied[order]] = a + within
    return order_names(out, 2 * step, tied)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of ``t`` in order."""
    if len(t) == 1:
        return np.zeros(1, np.int32)
    small, places = classify(t)
    first = induce(t, small, places)
    left = np.zeros(len(t), bool)
    left[places] = True
    names = _named(t, first[left[first]], places)
    ranks = order_names(names)
    seeds = np.empty(len(places), np.int32)
    seeds[ranks] = places
    return induce(t, small, seeds)


def common_prefixes(t: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each place of ``t`` the length that its suffix shares with the one before it in order.

    A place whose left neighbour continues the match to the left has one less than that neighbour; only the others are
    compared.
    """
    n = len(t)
    before = np.empty(n, np.int32)
    before[array[1:]] = array[:-1]
    before[array[0]] = -1
    at = np.arange(n, dtype=np.int32)
    other = before
    fresh = (at == 0) | (other <= 0)
    inner = np.flatnonzero(~fresh)
    fresh[inner] = t[inner - 1] != t[other[inner] - 1]
    live = np.flatnonzero(fresh & (other >= 0))
    words, size = _packed(t), np.zeros(n, np.int32)
    lane = np.uint64(0xFFFF)
    while len(live):
        i, j = live + size[live], other[live] + size[live]
        # the single 0 at the end stops every match
        x = words[i] ^ words[j]
        same = np.where(x & lane, 0, np.where(x >> np.uint64(16) & lane, 1, np.where(x >> np.uint64(32) & lane, 2, np.where(x, 3, 4))))
        size[live] += same.astype(np.int32)
        live = live[same == 4]
    reach = np.where(fresh, size + at, -1)
    return np.maximum.accumulate(reach) - at
