"""A compressed full-text index of number sequences in numpy: many patterns are searched for at once."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the ``depth`` numbers that follow (or more), ties in the order of the places.

    The text is read as a ring, so it should end with a number that parts to be found don't contain. Prefix doubling: places are ranked by one number, then by 2, 4, ... from pairs of ranks.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, known = np.argsort(rank, kind="stable"), 1
    while known < depth:
        key = rank * n + np.roll(rank, -known)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        known *= 2
        if fresh[-1] == n - 1:
            break
    return order


class WaveletTree:
    """Counts of each number in every prefix of a sequence, from one bit per number and level.

    The bits of a level, packed into 64-bit words with a running count, stand in the order that the levels above
    have sorted the numbers into: all nodes of a level are one array.
    """

    def __init__(self, sequence: np.ndarray, most: int):
        self.levels = max(1, int(most).bit_length())
        self.length = len(sequence)
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((sequence >> level) & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bool)), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(self.length - int(bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def descend(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefixes of these lengths end on the last level, in the run of the number."""
        at = at.astype(np.int64)
        for k in range(self.levels):
            one = self._ones(k, at)
            at = np.where((number >> (self.levels - 1 - k)) & 1, self.zeros[k] + one, at - one)
        return at


class FMIndex:
    """Searches for patterns from their ends: an interval of the suffix order for each part that has been read.

    ``text`` has numbers from 0 to ``most``; parts of up to ``depth`` numbers are found.
    """

    def __init__(self, text: np.ndarray, most: int, depth: int):
        self.order = suffix_order(text, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        before = text[self.order - 1]
        self.tree = WaveletTree(before, most)
        self.begin = self.tree.descend(np.arange(most + 1), np.zeros(most + 1, np.int64))

    def extend(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the parts with one more number in front."""
        both = self.tree.descend(np.concatenate([number, number]), np.concatenate([low, high]))
        base = self.first[number] - self.begin[number]
        return base + both[: len(low)], base + both[len(low) :]

    def least_places(self, text: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
        """For the part of ``size`` numbers of ``text`` before each end: the first place that has it.

        ``text`` is the indexed text, so every part is there at least once. The search of a part stops where only one
        place is left, which is its own.
        """
        least = ends - size
        number = text[ends - 1]
        low, high = self.first[number], self.first[number + 1]
        who = np.arange(len(ends))
        for k in range(1, size):
            many = high - low > 1
            who, low, high = who[many], low[many], high[many]
            if not len(who):
                return least
            low, high = self.extend(text[ends[who] - 1 - k], low, high)
        many = high - low > 1
        who, low, high = who[many], low[many], high[many]
        if len(who):
            # intervals of parts of one size are equal or apart
            starts, which = np.unique(low, return_inverse=True)
            stops = np.empty(len(starts), np.int64)
            stops[which] = high
            edges = np.stack([starts, stops], 1).ravel()
            if edges[-1] == len(self.order):
                edges = edges[:-1]
            least[who] = np.minimum.reduceat(self.order, edges)[::2][which]
        return least
