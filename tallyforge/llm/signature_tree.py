"""Similar sets by dual traversal of signature trees.

A node of the tree holds the OR of its sets' token bitmaps, the range of their
sizes, and by how many tokens a set may exceed its bits.  Two nodes are not
followed if their sizes cannot agree, if the bits that both have and the
excess stay below the overlap that the smallest sizes need, or if all their
sets are in one component already.  Leaves are compared exactly.
"""

from __future__ import annotations

import numpy as np

LEAF, FANOUT = 8, 8


class Forest:
    """Union-find over positions."""

    def __init__(self, labels: np.ndarray) -> None:
        self.parent = np.arange(len(labels))
        first: dict[int, int] = {}
        for i, label in enumerate(labels.tolist()):
            self.parent[i] = first.setdefault(label, i)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def roots(self, some: np.ndarray) -> np.ndarray:
        up = self.parent[some]
        while (self.parent[up] != up).any():
            up = self.parent[up]
        return up

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)


def needed(a, b, percent: int):
    """Smallest overlap of sets of sizes a and b whose Jaccard similarity is at least percent / 100."""
    return -(-percent * (a + b) // (100 + percent))


def needed_of_one(a, percent: int):
    """Smallest overlap that a set of size a needs with any partner."""
    return -(-percent * a // 100)


class Tree:
    """Signature tree over some sets, in the order given; ``levels[0]`` are the leaves."""

    def __init__(self, members: np.ndarray, size: np.ndarray, bitmap: np.ndarray, excess: np.ndarray) -> None:
        self.members = members
        self.levels = []
        low, high, bits, more = size[members], size[members], bitmap[members], excess[members]
        width = LEAF
        while True:
            cut = np.arange(0, len(low), width)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            bits, more = np.bitwise_or.reduceat(bits, cut, axis=0), np.maximum.reduceat(more, cut)
            self.levels.append((low, high, bits, more))
            if len(low) == 1:
                break
            width = FANOUT

    def leaf(self, k: int) -> np.ndarray:
        return self.members[k * LEAF:(k + 1) * LEAF]

    def below(self, level: int, k: int) -> np.ndarray:
        span = LEAF * FANOUT ** level
        return self.members[k * span:(k + 1) * span]


def bitmaps(keys: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(keys), bits), dtype=bool)
    for i, k in enumerate(keys):
        out[i, (k >> np.uint64(20)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def links(keys: list[np.ndarray], labels: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of positions that connect all sets which similar pairs connect.

    ``keys`` are sorted distinct tokens.  With ``side``, only pairs of a set of
    side 0 and one of side 1 are compared.  Sets of one label are connected
    already.  Every pair of different components is ruled out by a bound or
    compared exactly.
    """
    n = len(keys)
    size = np.array([len(k) for k in keys])
    forest = Forest(labels)
    found: list[tuple[int, int]] = []
    if n < 2:
        return found
    width = 1 << max(10, int(4 * size.max() - 1).bit_length())
    bitmap = bitmaps(keys, min(width, 1 << 16))
    excess = size - np.bitwise_count(bitmap).sum(axis=1).astype(np.int64)
    order = np.lexsort((size, [k[0] if len(k) else 0 for k in keys]))
    if side is None:
        left = right = Tree(order, size, bitmap, excess)
    else:
        if not (side == 0).any() or not (side == 1).any():
            return found
        left = Tree(order[side[order] == 0], size, bitmap, excess)
        right = Tree(order[side[order] == 1], size, bitmap, excess)
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        low_a, high_a, bits_a, more_a = (x[a] for x in left.levels[la])
        low_b, high_b, bits_b, more_b = (x[b] for x in right.levels[lb])
        if 100 * min(high_a, high_b) < percent * max(low_a, low_b):
            continue
        most = int(np.bitwise_count(bits_a & bits_b).sum()) + min(more_a, more_b)
        if most < needed(low_a, low_b, percent):
            continue
        roots_a, roots_b = forest.roots(left.below(la, a)), forest.roots(right.below(lb, b))
        if (roots_a == roots_a[0]).all() and (roots_b == roots_a[0]).all():
            continue
        if la or lb:
            down_a = range(a * FANOUT, min((a + 1) * FANOUT, len(left.levels[la - 1][0]))) if la >= lb else [a]
            down_b = range(b * FANOUT, min((b + 1) * FANOUT, len(right.levels[lb - 1][0]))) if lb >= la else [b]
            to_a, to_b = (la - 1 if la >= lb else la), (lb - 1 if lb >= la else lb)
            for x in reversed(down_a):
                for y in reversed(down_b):
                    if left is not right or x <= y:
                        stack.append((to_a, x, to_b, y))
            continue
        some_a, some_b = left.leaf(a), right.leaf(b)
        common = np.bitwise_count(bitmap[some_a][:, None, :] & bitmap[some_b][None, :, :]).sum(axis=2, dtype=np.int64)
        bound = common + np.minimum(excess[some_a][:, None], excess[some_b][None, :])
        bound = np.minimum(bound, np.minimum(size[some_a][:, None], size[some_b][None, :]))
        for x, y in np.argwhere(bound >= needed(size[some_a][:, None], size[some_b][None, :], percent)).tolist():
            i, j = int(some_a[x]), int(some_b[y])
            if i == j or forest.root(i) == forest.root(j):
                continue
            overlap = len(np.intersect1d(keys[i], keys[j], assume_unique=True))
            if 100 * overlap >= percent * (size[i] + size[j] - overlap) and size[i]:
                forest.join(i, j)
                found.append((i, j))
    return found
