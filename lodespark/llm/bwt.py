"""Burrows-Wheeler transforms of many strings, merged by iterative interleave refinement.

Strings are read as words of ``q`` bytes, in each of the q phases, so that every byte starts a suffix and a common
prefix of k words is one of k*q bytes. Each shard of strings gets its own transform. The merge never sorts suffixes of
different shards: it keeps, for every place of the merged order, only the shard that the suffix there belongs to. One
round moves every place through the transforms (a stable distribution by the symbol before the suffix); after k rounds
the interleave is right for the first k words, and the places where neighbours began to differ give the lengths of
their common prefixes.
"""

from __future__ import annotations

import numpy as np


#: Rounds of a merge at least: words are as long as this allows.
ROUNDS = 5


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative integers by radix passes of 16 bits."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    high = int(keys.max()) >> 16 if len(keys) else 0
    shift = 16
    while high:
        order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
        high >>= 16
        shift += 16
    return order


class Strings:
    """Strings, end to end, as sequences of word ranks: 0 where a phase's sequence ends, else 1.. in order of the words."""

    def __init__(self, strings: list[bytes], q: int):
        # one byte more ends each string, so that each of its phases has an end of its own
        self.q, self.n = q, sum(map(len, strings)) + len(strings)
        data = np.frombuffer(b"\0".join(strings) + b"\0" * 9, np.uint8)
        lengths = np.array([len(s) + 1 for s in strings], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.owner = np.repeat(np.arange(len(strings), dtype=np.int32), lengths)
        self.at = np.arange(self.n) - self.offsets[self.owner]  # place in the own string
        self.left = lengths[self.owner] - 1 - self.at  # bytes from there to its end
        base = min(q & -q, 8)  # packed into integers first, then joined in pairs up to q bytes
        word = np.zeros(self.n, np.uint64)
        for k in range(base):
            word = (word << np.uint64(8)) | data[k : k + self.n]
        rank, width = self._ranks(word, base), base
        joined, done = np.zeros(self.n, np.int64), 0
        while True:
            if q & width:
                joined = self._ranks(self._pair(joined, rank, done), done + width) if done else rank
                done += width
            if 2 * width > q:
                break
            rank, width = self._ranks(self._pair(rank, rank, width), 2 * width), 2 * width
        self.rank = joined

    def _pair(self, a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        """For each place a number that orders by a there, then by b ``shift`` bytes on."""
        then = np.zeros(self.n, np.int64)
        then[: self.n - shift] = b[shift:]
        return a * (int(b.max(initial=0)) + 1) + then

    def _ranks(self, keys: np.ndarray, width: int) -> np.ndarray:
        """Ranks from 1 of the places with ``width`` bytes left; 0 for the others."""
        full = self.left >= width
        out = np.zeros(self.n, np.int64)
        if full.any():
            out[full] = np.unique(keys[full], return_inverse=True)[1] + 1
        return out

    def before(self, places: np.ndarray) -> np.ndarray:
        """The symbol before each suffix: the rank of the word before it, 0 at a sequence's start."""
        first = self.at[places] < self.q
        return np.where(first, 0, self.rank[places - np.where(first, 0, self.q)])


def shard_transform(s: Strings, low: int, high: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, symbols before them) of bytes low..high, in order of at least ``words`` words; by doubling."""
    rank, place = s.rank[low:high], np.arange(low, high)
    known = 1
    while known < words:
        step = known * s.q
        there = s.left[low:high] >= step
        then = np.zeros(high - low, np.int64)
        then[there] = rank[np.flatnonzero(there) + step] + 1
        key = rank * (int(then.max(initial=0)) + 1) + then
        values, rank = np.unique(key, return_inverse=True)
        known *= 2
        if len(values) == high - low:
            break
    order = stable_order(rank)
    # sequences end in the order of the strings, whatever doubling made of the ends
    ends = rank_is_end(s, place[order])
    order = np.concatenate([np.sort(order[ends]), order[~ends]])
    return place[order], s.before(place[order])


def rank_is_end(s: Strings, places: np.ndarray) -> np.ndarray:
    return s.rank[places] == 0


def merge(s: Strings, bounds: list[int], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the transforms of the shards between ``bounds`` for ``words`` rounds.

    Returns the places in merged order, the block of each (equal numbers: equal first ``words`` words), and the common
    words of each with the one before it (at most ``words``).
    """
    shards = [shard_transform(s, a, b, words) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    places, symbols = (np.concatenate([x[k] for x in shards]) for k in (0, 1))
    of = np.uint8 if len(shards) <= 256 else np.uint16
    which = np.repeat(np.arange(len(shards), dtype=of), np.diff(bounds))
    ends = np.flatnonzero(rank_is_end(s, places))
    n, first = s.n, len(ends)
    z, block = which.copy(), np.zeros(n, np.int32)
    common = np.full(n, -1, np.int32)
    if n:
        common[0] = 0
    for k in range(words + 1):
        # the slot of the j-th suffix of a shard in merged order is the j-th of that shard
        slots = np.empty(n, np.int64)
        slots[np.argsort(z, kind="stable")] = np.arange(n)
        if k == words:
            break
        symbol = symbols[slots]
        inner = np.flatnonzero(symbol)
        moved = inner[stable_order(symbol[inner])]
        symbol, before = symbol[moved], block[moved]
        z = np.concatenate([which[ends], z[moved]])
        new = np.ones(n, bool)  # each sequence's end differs from all others
        if len(moved):
            new[first + 1 :] = (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])
        common[new & (common < 0)] = k
        blocks = np.cumsum(new, dtype=np.int32) - 1
        if (blocks == block).all() and k:
            slots[np.argsort(z, kind="stable")] = np.arange(n)
            break
        block = blocks
    common[common < 0] = words
    return places[slots], block, common


def repeated_starts(strings: list[bytes], length: int, shard_bytes: int = 1 << 17) -> np.ndarray:
    """For every byte of the strings, end to end, whether the ``length`` bytes from it on lie in its string and start at another byte too."""
    q = max(q for q in range(1, length + 1) if length % q == 0 and (q == 1 or length // q >= ROUNDS))
    s = Strings(strings, q)
    if not s.n:
        return np.zeros(0, bool)
    inner = np.searchsorted(s.offsets, np.arange(shard_bytes, s.n, shard_bytes))
    bounds = sorted({0, s.n, *s.offsets[inner].tolist()})
    places, _, common = merge(s, bounds, length // q)
    shared = common >= length // q  # with the suffix before it
    shared[0] = False
    inside = shared.copy()
    inside[:-1] |= shared[1:]
    out = np.zeros(s.n, bool)
    out[places] = inside
    return (out & (s.left >= length))[s.left > 0]
