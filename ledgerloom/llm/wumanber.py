"""Many strings searched for at once, after Wu and Manber.

A window as long as the shortest pattern stands over the text. The block of
bytes at its end tells by the shift table how far the window may move without
missing an occurrence. Where it may not move at all, the block's hash names a
bucket of patterns that have it there; those are compared byte by byte, their
first bytes before the rest.

Windows are independent of each other, so that a text is cut into many lanes
that are searched side by side: each step is an array operation over all lanes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Slots of the shift table and of the buckets.
SLOTS = 1 << 18
#: Bytes of text in one lane.
LANE = 256
#: Patterns from this many bytes on are searched apart from shorter ones, which would shorten their shifts.
LONG = 6


class WuManber:
    """Exact search for ``patterns`` (distinct, two bytes or more each)."""

    def __init__(self, patterns: Sequence[bytes]):
        self.parts = []
        for wanted in (lambda n: n < LONG, lambda n: n >= LONG):
            own = [i for i, p in enumerate(patterns) if wanted(len(p))]
            if own:
                self.parts.append(_Part([patterns[i] for i in own], np.array(own, dtype=np.int64)))

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern number) of all occurrences in ``text`` (UINT8), in no particular order."""
        found = [part.search(text) for part in self.parts]
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])


class _Part:
    """Patterns of like length with their own tables."""

    def __init__(self, patterns: list[bytes], numbers: np.ndarray):
        self.numbers = numbers
        self.sizes = np.array([len(p) for p in patterns], dtype=np.int64)
        self.window = int(self.sizes.min())
        self.block = 3 if self.window >= LONG else 2
        self.bytes = np.zeros((len(patterns), int(self.sizes.max())), dtype=np.uint8)
        for i, p in enumerate(patterns):
            self.bytes[i, : len(p)] = np.frombuffer(p, dtype=np.uint8)
        self.shift = np.full(SLOTS, self.window - self.block + 1, dtype=np.int8)
        for end in range(self.block - 1, self.window):
            at = self._hash(self.bytes, end)
            self.shift[at] = np.minimum(self.shift[at], self.window - 1 - end)
        self.prefix = _packed([self.bytes[:, k] for k in range(self.block)])
        last = self._hash(self.bytes, self.window - 1)
        self.bucket = np.argsort(last, kind="stable")
        self.first = np.searchsorted(last[self.bucket], np.arange(SLOTS + 1))

    def _hash(self, rows: np.ndarray, end: int) -> np.ndarray:
        return _hashed([rows[:, end - k] for k in range(self.block)])

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = self._ends(text)
        slot = _hashed([text[ends - k] for k in range(self.block)])
        begin = ends - self.window + 1
        many = self.first[slot + 1] - self.first[slot]
        entry = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum())) if len(ends) else np.zeros(0, np.int64)
        which = self.bucket[entry]
        begins = _packed([text[begin + k] for k in range(self.block)])
        same = np.flatnonzero(np.repeat(begins, many) == self.prefix[which])
        at, which = np.repeat(begin, many)[same], which[same]
        keep = at + self.sizes[which] <= len(text)
        at, which = at[keep], which[keep]
        for k in range(self.block, self.bytes.shape[1]):
            there = np.minimum(at + k, len(text) - 1)
            same = (k >= self.sizes[which]) | (text[there] == self.bytes[which, k])
            if not same.all():
                at, which = at[same], which[same]
        return at, self.numbers[which]

    def _ends(self, text: np.ndarray) -> np.ndarray:
        """Where windows end that the shift table doesn't move."""
        at = np.arange(self.window - 1, len(text), LANE)
        until = np.minimum(at + LANE, len(text))
        out = [np.zeros(0, dtype=np.int64)]
        while len(at):
            move = self.shift[_hashed([text[at - k] for k in range(self.block)])]
            out.append(at[move == 0])
            at = at + np.maximum(move, 1)
            inside = at < until
            at, until = at[inside], until[inside]
        return np.concatenate(out)


def _hashed(block: list[np.ndarray]) -> np.ndarray:
    """Slot of a block of bytes, the last one first."""
    return _packed(block).astype(np.int64) * 2_654_435_761 >> 14 & (SLOTS - 1)


def _packed(block: list[np.ndarray]) -> np.ndarray:
    """Bytes side by side in one number."""
    code = block[0].astype(np.int32)
    for k, b in enumerate(block[1:], 1):
        code |= b.astype(np.int32) << (8 * k)
    return code
