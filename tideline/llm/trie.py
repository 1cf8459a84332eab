"""Walking pairs of nodes of a binary trie of 64-bit keys.

The keys are kept sorted, so a node is a range of positions; a walk holds many node
pairs at once as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 8
BLOCK = 1_000_000

Walk = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Links:
    """Which keys are known to be linked: a forest over positions 0..n-1."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.refresh()

    def refresh(self) -> None:
        change = np.zeros(len(self.root), np.int64)
        change[1:] = np.cumsum(self.root[1:] != self.root[:-1])
        self.change = change

    def settled(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Node pairs whose keys are all in one component already."""
        same = self.root[alo] == self.root[blo]
        return same & (self.change[alo] == self.change[ahi - 1]) & (self.change[blo] == self.change[bhi - 1])

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                above = self.root[self.root]
                if (above == self.root).all():
                    break
                self.root = above
        self.refresh()


def close_pairs(keys: np.ndarray, start: Walk, depth: int, budget: int, links: Links) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of positions (a, b) whose keys differ in at most ``budget`` bits.

    ``start``: node pairs (from, to, from, to, differing bits so far) at ``depth``.
    Both nodes step down together; a pair goes on while its differing bits fit the
    budget and its keys aren't linked yet."""
    ones: dict[int, np.ndarray] = {}

    def ones_before(level: int) -> np.ndarray:
        if level not in ones:
            bit = (keys >> np.uint64(63 - level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        return ones[level]

    stack = [(depth, start)]
    while stack:
        level, walk = stack.pop()
        if len(walk[0]) > BLOCK:
            half = len(walk[0]) // 2
            stack += [(level, tuple(x[:half] for x in walk)), (level, tuple(x[half:] for x in walk))]
            continue
        alo, ahi, blo, bhi, diff = walk
        go = ~links.settled(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, diff = (x[go] for x in walk)
        small = (ahi - alo <= LEAF) & (bhi - blo <= LEAF)
        if small.any():
            yield from _leaf_pairs(keys, alo[small], ahi[small], blo[small], bhi[small], budget)
        alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        before = ones_before(level)
        amid, bmid = ahi - (before[ahi] - before[alo]), bhi - (before[bhi] - before[blo])
        own = alo == blo
        parts = [
            (alo, amid, blo, bmid, diff, np.ones(len(alo), bool)),
            (amid, ahi, bmid, bhi, diff, np.ones(len(alo), bool)),
            (alo, amid, bmid, bhi, diff + 1, np.ones(len(alo), bool)),
            (amid, ahi, blo, bmid, diff + 1, ~own),
        ]
        parts = [tuple(x[p[5] & (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget)] for x in p[:5]) for p in parts]
        stack.append((level + 1, tuple(np.concatenate(x) for x in zip(*parts))))


def _leaf_pairs(keys, alo, ahi, blo, bhi, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(LEAF):
        for j in range(LEAF):
            both = (alo + i < ahi) & (blo + j < bhi)
            a, b = alo[both] + i, blo[both] + j
            near = (np.bitwise_count(keys[a] ^ keys[b]) <= budget) & (a != b)
            if near.any():
                yield a[near], b[near]


def link_keys(keys: np.ndarray, start: Walk, depth: int, budget: int) -> np.ndarray:
    """For each sorted key the position of the key that stands for its component.

    The budget grows bit by bit: what one bit links is one component when two bits
    are tried, so dense groups of keys never open all their pairs."""
    links = Links(len(keys))
    for allowed in range(min(1, budget), budget + 1):
        for a, b in close_pairs(keys, start, depth, allowed, links):
            links.unite(a, b)
    return links.root
