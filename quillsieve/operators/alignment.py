"""Alignment of two word sequences by their longest common blocks."""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher

import numpy as np

#: Regions of up to this many cells are cheaper to compare outright.
_SMALL = 400


class _Windows:
    """Equal numbers for equal windows of any length in one sequence: ranks of windows whose lengths are powers of two, each made of two of the rank before."""

    def __init__(self, words: np.ndarray):
        self.ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]

    def of(self, length: int) -> np.ndarray:
        k = length.bit_length() - 1
        while len(self.ranks) <= k:
            last, half = self.ranks[-1], 1 << (len(self.ranks) - 1)
            self.ranks.append(np.unique(last[:-half] * (last.max() + 1) + last[half:], return_inverse=True)[1].astype(np.int64))
        rank, rest = self.ranks[k], length - (1 << k)
        return rank[: len(rank) - rest] * (rank.max() + 1) + rank[rest:] if rest else rank


def _numbered(own: list[str], new: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each word as a number; empty ones get numbers of their own and so match nothing."""
    seen: dict[str, int] = {}
    numbers = [seen.setdefault(w, len(seen)) if w else -1 - k for k, w in enumerate([*own, *new])]
    return np.array(numbers[: len(own)], np.int64), np.array(numbers[len(own) :], np.int64)


def matching_blocks(own: list[str], new: list[str]) -> list[tuple[int, int, int]]:
    """Blocks (i, j, length) in order: the longest common one, then the same on what stands before and after it.

    Of equally long ones the first in ``own`` is taken, then the first in ``new``; empty words
    match nothing. All blocks of a region's greatest length are found in one pass,
    so a round costs about a sort of the region, and every round has shorter blocks: 20,000 equal
    words take well under a second.
    """
    a, b = _numbered(own, new)
    if not len(a) or not len(b):
        return []
    apart = np.array([max(a.max(), b.max()) + 1])  # windows over it are equal to none
    shift, windows = len(a) + 1, _Windows(np.concatenate([a, apart, b]))
    listed_a, listed_b = a.tolist(), b.tolist()
    found: list[tuple[int, int, int]] = []
    regions = [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while regions:
        i1, i2, j1, j2, most = regions.pop()
        if (i2 - i1) * (j2 - j1) <= _SMALL:
            inner = SequenceMatcher(None, listed_a[i1:i2], listed_b[j1:j2], autojunk=False).get_matching_blocks()
            found += [(i1 + i, j1 + j, n) for i, j, n in inner if n]
            continue

        def sides(length: int, at: tuple[int, int, int, int] = (i1, i2, j1, j2)) -> tuple[np.ndarray, np.ndarray]:
            keys = windows.of(length)
            return keys[at[0] : at[1] - length + 1], keys[shift + at[2] : shift + at[3] - length + 1]

        low, high = 0, min(most, i2 - i1, j2 - j1)
        step = 1
        while step <= high and np.isin(*sides(step)).any():  # windows of a common block's length are common at half of it too
            low, step = step, step * 2
        high = min(high, step - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if np.isin(*sides(middle)).any():
                low = middle
            else:
                high = middle - 1
        if not low:
            continue
        left, right = sides(low)
        places: dict[int, list[int]] = {}
        for j, key in enumerate(right.tolist()):
            places.setdefault(key, []).append(j1 + j)
        keys = left.tolist()
        next_i, next_j = i1, j1
        for k in np.flatnonzero(np.isin(left, right)).tolist():
            i = i1 + k
            if i < next_i:
                continue
            at = bisect_left(places[keys[k]], next_j)
            if at == len(places[keys[k]]):
                continue
            j = places[keys[k]][at]
            found.append((i, j, low))
            if i > next_i and j > next_j:
                regions.append((next_i, i, next_j, j, low - 1))
            next_i, next_j = i + low, j + low
        if next_i < i2 and next_j < j2:
            regions.append((next_i, i2, next_j, j2, low - 1))
    return sorted(found)


def matching_words(own: list[str], new: list[str]) -> list[tuple[int, int]]:
    """The pairs of places in ``matching_blocks``."""
    if own == new:  # every block of such is at the same place in both
        return [(i, i) for i, w in enumerate(own) if w]
    return [(i + k, j + k) for i, j, n in matching_blocks(own, new) for k in range(n)]
