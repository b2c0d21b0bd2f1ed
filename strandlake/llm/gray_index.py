"""A Gray-order hierarchical index over bit prints.

Prints are sorted by Gray rank, so that neighbours share long masked patterns. A node of the tree above them holds the bits that
all its prints have and the bits that any has; what differs in neither is fixed. Two nodes are left as soon as the differences of
their fixed bits exceed what any of their prints may differ in, and with them all pairs below.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Children of a node; 64-bit words of node pairs that are compared at a time.
FAN, WORDS = 4, 1 << 20


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in Gray order, where neighbours differ in one bit."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class Tree:
    """Levels from the leaves up, over the entries of one or more buckets, each bucket with a root of its own at the top.

    prints: (entries, words), or a pair of such arrays, the bits common to all and set in any of what an entry stands for.
    allow: an entry's share of what a pair may differ in. label: pairs of equal labels aren't asked for.
    """

    def __init__(self, prints, allow: np.ndarray, bucket: np.ndarray | None = None, label: np.ndarray | None = None):
        common, any_ = prints if isinstance(prints, tuple) else (prints, prints)
        own = np.zeros(len(common), np.int64) if bucket is None else bucket
        self.order = np.lexsort((gray_rank(common[:, 0]), own))
        common, any_, allow, own = common[self.order], any_[self.order], allow[self.order], own[self.order]
        low = high = None if label is None else label[self.order]
        self.levels = [(common, any_, allow, low, high, None, None)]
        while True:
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            place = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
            if not place.any():
                break
            first = np.flatnonzero(place % FAN == 0)
            count = np.diff(np.r_[first, len(own)])
            common, any_, allow, own = np.bitwise_and.reduceat(common, first), np.bitwise_or.reduceat(any_, first), np.maximum.reduceat(allow, first), own[first]
            if label is not None:
                low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            self.levels.append((common, any_, allow, low, high, first, count))

    def raised(self, height: int) -> "Tree":
        """The same tree with as many levels as asked for, if it has fewer."""
        while len(self.levels) < height:
            n = len(self.levels[-1][0])
            self.levels.append((*self.levels[-1][:5], np.arange(n), np.ones(n, np.int64)))
        return self


def _near(a: tuple, b: tuple, u: np.ndarray, v: np.ndarray, scale: int) -> np.ndarray:
    fixed = ~((a[0][u] ^ a[1][u]) | (b[0][v] ^ b[1][v]))
    keep = scale * np.bitwise_count((a[0][u] ^ b[0][v]) & fixed).sum(1, dtype=np.int64) <= a[2][u] + b[2][v]
    if a[3] is not None:
        keep &= (a[3][u] != a[4][u]) | (b[3][v] != b[4][v]) | (a[3][u] != b[3][v])
    return keep


def search(a: Tree, b: Tree | None = None, scale: int = 1, selves: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in the order of a and of b) of all pairs of entries with scale * differing bits <= the sum of what both allow.

    Without b: pairs inside the buckets of a, each once; selves: entries with themselves too. With b: both have one bucket.
    """
    same, b = b is None, b or a
    height = max(len(a.levels), len(b.levels))
    a.raised(height), b.raised(height)
    most = max(1, WORDS // (FAN * FAN * a.levels[0][0].shape[1]))
    u, v = np.arange(len(a.levels[-1][0])), np.arange(len(b.levels[-1][0]))
    keep = _near(a.levels[-1], b.levels[-1], u, v, scale) if len(u) and len(v) else np.zeros(0, bool)
    stack = [(height - 1, u[keep], v[keep])]
    while stack:
        at, u, v = stack.pop()
        if at == 0:
            if same and not selves:
                u, v = u[u < v], v[u < v]
            if len(u):
                yield u, v
            continue
        if len(u) > most:
            stack += [(at, u[k : k + most], v[k : k + most]) for k in range(0, len(u), most)]
            continue
        kids, first_b, count_b = a.levels[at][6][u] * b.levels[at][6][v], b.levels[at][5], b.levels[at][6]
        pair = np.repeat(np.arange(len(u)), kids)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(kids) - kids, kids)
        x, y = a.levels[at][5][u][pair] + k // count_b[v][pair], first_b[v][pair] + k % count_b[v][pair]
        if same:
            x, y = x[x <= y], y[x <= y]
        keep = _near(a.levels[at - 1], b.levels[at - 1], x, y, scale)
        if keep.any():
            stack.append((at - 1, x[keep], y[keep]))


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of n entries the pairs (entry, least entry of its tree) that join all that the pairs join."""
    label = np.arange(n)
    for u, v in pairs:
        u, v = label[u], label[v]
        while (open_ := u != v).any():
            u, v = u[open_], v[open_]
            low = np.minimum(u, v)
            np.minimum.at(label, u, low)
            np.minimum.at(label, v, low)
            while (label[label] != label).any():
                label = label[label]
            u, v = label[u], label[v]
    other = np.flatnonzero(label != np.arange(n))
    return other, label[other]
