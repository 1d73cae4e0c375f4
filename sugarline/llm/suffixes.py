"""Suffix arrays of sets of byte segments, in numpy.

A segment is a byte string; a suffix ends where its segment ends, and equal suffixes of different
segments are ordered by place. So no common prefix runs across segments.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the first sort looks at; a byte takes 9 bits, as 0 stands for the end of a segment.
FIRST = 7


class Segments:
    """Segments side by side in ``data``; ``left[i]`` is the number of bytes from i to the end of
    its segment."""

    def __init__(self, segments: list[bytes]):
        lengths = np.array([len(s) for s in segments], np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        self.data = np.frombuffer(b"".join(segments), np.uint8)
        self.left = np.repeat(self.starts[1:], lengths) - np.arange(len(self.data))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self.words = np.zeros(len(self.data), np.uint64)  # 8 bytes from each place, big-endian
        for k in range(8):
            self.words = (self.words << np.uint64(8)) | padded[k : k + len(self.data)]

    def common(self, a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and at ``b``, at most ``most``."""
        limit = np.minimum(self.left[a], self.left[b])
        if most is not None:
            limit = np.minimum(limit, most)
        length = np.zeros(len(a), np.int64)
        active = np.flatnonzero(limit > 0)
        while len(active):
            at = length[active]
            differ = self.words[a[active] + at] ^ self.words[b[active] + at]
            equal = differ == 0
            # Leading equal bytes of a word
            alike = equal.astype(np.int64)
            for k in range(1, 8):
                alike += differ < np.uint64(1 << (8 * k))
            bound = limit[active]
            reached = np.minimum(at + alike, bound)
            length[active] = reached
            active = active[equal & (reached < bound)]
        return length


def suffix_array(s: Segments) -> np.ndarray:
    """Places of all suffixes in order, by Larsson-Sadakane refinement.

    Suffixes are sorted by their first bytes; then only groups of equal ones are sorted again, by
    the group of the suffix that starts where the compared part ends, which doubles that part.
    """
    n = len(s.data)
    places = np.arange(n)
    value = np.zeros(n, np.uint64)
    padded = np.concatenate([s.data.astype(np.uint64) + np.uint64(1), np.zeros(FIRST, np.uint64)])
    for k in range(FIRST):
        value = (value << np.uint64(9)) | np.where(s.left > k, padded[k : k + n], np.uint64(0))
    value = (value << np.uint64(1)) | (s.left > FIRST).astype(np.uint64)
    sa = np.argsort(value)
    ordered = value[sa]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    # Suffixes that are compared to their end are told apart by place alone
    new |= s.left[sa] <= FIRST
    group = np.empty(n, np.int64)
    group[sa] = np.maximum.accumulate(np.where(new, places, 0))
    depth = FIRST
    while True:
        # Slots in groups of two or more
        lone = new & np.concatenate([new[1:], [True]]) if n else new
        slots = np.flatnonzero(~lone)
        if not len(slots):
            return sa
        suffixes = sa[slots]
        further = np.where(s.left[suffixes] > depth, group[np.minimum(suffixes + depth, n - 1)] + n, suffixes)
        # An ended suffix comes before longer ones of its group, hence place below n
        key = group[suffixes] * (2 * n) + further
        order = np.argsort(key)
        suffixes, key = suffixes[order], key[order]
        sa[slots] = suffixes
        first = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] = first
        group[suffixes] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        depth *= 2


def neighbour_prefixes(s: Segments, sa: np.ndarray, least: int = 0) -> np.ndarray:
    """For each slot of ``sa`` the common prefix with the slot before (0 for the first).

    Kasai's rule: one place further in the text the common prefix with the neighbour is at most one
    byte shorter. Where neighbour and text move on together it is exactly one shorter, so only the
    places where they part are compared byte by byte. Prefixes below ``least`` may come out shorter
    than they are: a place that cannot reach it, and so those after it, are not compared in full.
    """
    n = len(sa)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    together = np.zeros(n, bool)
    inside = (before[1:] >= 1) & (before[1:] == before[:-1] + 1) & (s.left[1:] == s.left[:-1] - 1)
    inside &= (s.left[before[1:]] == s.left[before[1:] - 1] - 1) & (s.data[:-1] == s.data[before[1:] - 1])
    together[1:] = inside
    heads = np.flatnonzero(~together & (before >= 0))
    if least >= 8:
        heads = heads[np.minimum(s.left[heads], s.left[before[heads]]) >= least]
        for at in (0, least - 8):
            heads = heads[s.words[heads + at] == s.words[before[heads] + at]]
    length = np.zeros(n, np.int64)
    length[heads] = s.common(heads, before[heads])
    head = np.maximum.accumulate(np.where(together, 0, np.arange(n)))
    length = np.where(together, length[head] - (np.arange(n) - head), length)
    return length[sa]


class Shard:
    """Sorted suffixes of some segments and which windows of ``size`` bytes occur again."""

    def __init__(self, segments: list[bytes], size: int):
        self.s, self.size = Segments(segments), size
        self.sa = suffix_array(self.s)
        long = neighbour_prefixes(self.s, self.sa, size) >= size
        again = long.copy()
        again[:-1] |= long[1:]
        self.repeated = np.zeros(len(self.sa), bool)
        self.repeated[self.sa[again]] = True
        #: Sorted places of the windows, one for each content
        windows = self.s.left[self.sa] >= size
        self.distinct = self.sa[windows & ~long]

    def meet(self, other: Shard) -> None:
        """Mark the windows of both shards that occur in the other one, by binary search."""
        mine, theirs = self.distinct, other.distinct
        if not len(mine) or not len(theirs):
            return
        both = Segments.__new__(Segments)
        both.data = np.concatenate([self.s.data, other.s.data])
        both.words = np.concatenate([self.s.words, other.s.words])
        both.left = np.concatenate([self.s.left, other.s.left])
        shift = len(self.s.data)
        low, high = np.zeros(len(theirs), np.int64), np.full(len(theirs), len(mine), np.int64)
        found = np.full(len(theirs), -1, np.int64)
        while True:
            open_ = np.flatnonzero((low < high) & (found < 0))
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            a, b = mine[middle], theirs[open_] + shift
            length = both.common(a, b, self.size)
            equal = length >= self.size
            found[open_[equal]] = middle[equal]
            at = np.minimum(length, self.size - 1)
            less = ~equal & (both.data[a + at] < both.data[b + at])
            low[open_[less]] = middle[less] + 1
            more = ~equal & ~less
            high[open_[more]] = middle[more]
        hit = np.flatnonzero(found >= 0)
        self._mark(self.distinct[found[hit]])
        other._mark(other.distinct[hit])

    def _mark(self, places: np.ndarray) -> None:
        """Mark windows; those with further copies here are marked already."""
        self.repeated[places] = True

    def intervals(self) -> list[list[tuple[int, int]]]:
        """For each segment the runs (first, past) of marked window starts."""
        out = []
        for a, b in zip(self.s.starts[:-1], self.s.starts[1:], strict=True):
            flags = np.concatenate([[0], self.repeated[a:b].astype(np.int8), [0]])
            change = np.diff(flags)
            out.append(list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True)))
        return out
