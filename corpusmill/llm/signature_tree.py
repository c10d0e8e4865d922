"""Signature trees: token sets under nodes with OR-combined bitmaps and size ranges.

A set's bitmap has one bit for each hashed token. Two sets share at most as many tokens
as their bitmaps share bits, plus the smaller of their surpluses (tokens over set bits).
A node's bitmap is the union of its sets', its size range and surplus cover theirs; so
the same sum bounds the overlap of any set below one node with any below another. A dual
traversal, of the tree against itself, goes down only where that bound and the size
ranges allow a link.

Sets lie in the tree by size (in steps of 4/3, the most that linked sets differ by) and
then by their smallest token, which most near copies share: so the sets below a node are
alike where the data are, and their common bitmap stays thin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 4
#: Pairs of nodes that are bounded together.
CHUNK = 4096
#: Bits for each token of the mean set, and the ends of a bitmap's length.
BITS_PER_TOKEN, LEAST_BITS, MOST_BITS = 8, 512, 1 << 16
#: Similarity of a link as a fraction; 100 * intersection >= 75 * union.
SHARE, OF = 75, 100


def needed(sizes):
    """The least overlap of a linked pair, given the sum of its sizes."""
    return -(-SHARE * sizes // (OF + SHARE))


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of 64-bit words for each set."""
    out = np.empty((len(sets), bits // 64), np.uint64)
    for at in range(0, len(sets), 256):
        part = sets[at : at + 256]
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        marks = np.zeros((len(part), bits), bool)
        marks[row, (np.concatenate(part) % np.uint64(bits)).astype(np.int64)] = True
        out[at : at + 256] = np.packbits(marks, axis=1, bitorder="little").view(np.uint64)
    return out


class Level:
    """Nodes of one height. ``low`` and ``high``: the ends of the labels below."""

    def __init__(self, bits: np.ndarray, least: np.ndarray, most: np.ndarray, surplus: np.ndarray):
        self.bits, self.least, self.most, self.surplus = bits, least, most, surplus
        self.low = self.high = np.zeros(len(least), np.int64)

    def above(self) -> Level:
        at = np.arange(0, len(self.least), FANOUT)
        return Level(
            np.bitwise_or.reduceat(self.bits, at, axis=0), np.minimum.reduceat(self.least, at),
            np.maximum.reduceat(self.most, at), np.maximum.reduceat(self.surplus, at),
        )


class SignatureTree:
    """Over sorted token sets (none empty) with labels; sets of one label are connected
    already, and no pair of them is sought."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray):
        sizes = np.array([len(x) for x in sets], np.int64)
        band = np.floor(np.log(sizes) / np.log(OF / SHARE)).astype(np.int64)
        self.order = np.lexsort((sizes, [x[0] for x in sets], band))
        bits = LEAST_BITS
        while bits < min(MOST_BITS, BITS_PER_TOKEN * sizes.mean()):
            bits *= 2
        sizes, leaves = sizes[self.order], bitmaps([sets[i] for i in self.order], bits)
        self.levels = [Level(leaves, sizes, sizes, sizes - np.bitwise_count(leaves).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1].least) > 1:
            self.levels.append(self.levels[-1].above())
        self.relabel(labels)

    def relabel(self, labels: np.ndarray) -> None:
        low = high = labels[self.order]
        for level in self.levels:
            level.low, level.high = low, high
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of pairs that the bounds allow, each pair once, some at a time; the
        caller may relabel in between."""
        root = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, root, root)]
        while stack:
            depth, a, b = stack.pop()
            keep = self._possible(depth, a, b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if depth == 0:
                yield self.order[a], self.order[b]
                continue
            k, size = np.arange(FANOUT), len(self.levels[depth - 1].least)
            x = np.repeat(a[:, None] * FANOUT + k, FANOUT, axis=1).ravel()
            y = np.tile(b[:, None] * FANOUT + k, (1, FANOUT)).ravel()
            keep = ((x < y) | ((x == y) & (depth > 1))) & (y < size)
            x, y = x[keep], y[keep]
            near = np.argsort(y - x, kind="stable")  # neighbours first: they are alike
            x, y = x[near], y[near]
            stack += [(depth - 1, x[at : at + CHUNK], y[at : at + CHUNK]) for at in range(0, len(x), CHUNK)][::-1]

    def _possible(self, depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = self.levels[depth]
        keep = (np.minimum(level.low[a], level.low[b]) != np.maximum(level.high[a], level.high[b]))
        keep &= (OF * level.most[a] >= SHARE * level.least[b]) & (OF * level.most[b] >= SHARE * level.least[a])
        where = np.flatnonzero(keep)
        a, b = a[where], b[where]
        shared = np.bitwise_count(level.bits[a] & level.bits[b]).sum(axis=1, dtype=np.int64)
        # The bound falls short of what any pair below needs: no link there.
        keep[where] = shared + np.minimum(level.surplus[a], level.surplus[b]) >= needed(level.least[a] + level.least[b])
        return keep


def connect(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each label (from 0) the smallest one that links connect it with. The pairs of a
    dual traversal are compared exactly, but for those that earlier links connect."""
    root = list(range(int(labels.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree = SignatureTree(sets, labels)
    for a, b in tree.pairs():
        tied = False
        for x, y, i, j in zip(a.tolist(), b.tolist(), labels[a].tolist(), labels[b].tolist()):
            i, j = find(i), find(j)
            if i != j and _overlap(sets[x], sets[y]) >= needed(len(sets[x]) + len(sets[y])):
                root[max(i, j)] = min(i, j)
                tied = True
        if tied:
            tree.relabel(np.array([find(x) for x in labels.tolist()]))
    return np.array([find(x) for x in range(len(root))])


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges the two runs
    return int((both[1:] == both[:-1]).sum())
