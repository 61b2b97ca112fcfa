"""Signature trees: OR-combined token bitmaps and size ranges, compared node against node.

A set of n tokens has a bitmap of at least 2 n bits. A node holds the OR of its
members' bitmaps, their smallest and largest size, and the most tokens that
share a bit with others (slack). Members of two nodes can't overlap in more than
popcount(OR & OR) + slack tokens; a pair of nodes whose sizes then can't reach
the wanted similarity is dropped with all pairs below it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

FANOUT = 8
PIVOTS = 4
CHUNK = 200_000


def width(n: int) -> int:
    bits = 64
    while bits < 2 * n:
        bits *= 2
    return bits


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The signature as bytes; a token's bit is its hash modulo the width."""
    w = width(len(tokens))
    bits = np.zeros(w, bool)
    bits[(tokens & np.uint64(w - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) at a smaller power-of-two width."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def needed(na, nb, percent: int):
    """The least overlap that 100 * i >= percent * (na + nb - i) allows."""
    return -(-percent * (na + nb) // (100 + percent))


class Level:
    def __init__(self, bits, least, most, slack, label):
        self.bits, self.least, self.most, self.slack, self.label = bits, least, most, slack, label

    def up(self) -> Level:
        at = np.arange(0, len(self.bits), FANOUT)
        one = np.minimum.reduceat(self.label, at)
        label = np.where(one == np.maximum.reduceat(self.label, at), one, -1)  # -1: members of several components
        return Level(np.bitwise_or.reduceat(self.bits, at, axis=0), np.minimum.reduceat(self.least, at), np.maximum.reduceat(self.most, at), np.maximum.reduceat(self.slack, at), label)


def levels(bits: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> list[Level]:
    slack = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    out = [Level(bits, sizes, sizes, slack, label)]
    while len(out[-1].bits) > FANOUT:
        out.append(out[-1].up())
    return out


def possible(a: Level, b: Level, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a pair of sets that is similar enough and not in one component already."""
    ok = (100 * a.most[i] >= percent * b.least[j]) & (100 * b.most[j] >= percent * a.least[i]) & ((a.label[i] < 0) | (a.label[i] != b.label[j]))
    at = np.flatnonzero(ok)
    step = max(1, (8 << 20) // max(a.bits.shape[1], 1) // 8)
    for k in range(0, len(at), step):
        x, y = i[at[k : k + step]], j[at[k : k + step]]
        common = np.bitwise_count(a.bits[x] & b.bits[y]).sum(axis=1).astype(np.int64)
        ok[at[k : k + step]] = common + np.minimum(a.slack[x], b.slack[y]) >= needed(a.least[x], b.least[y], percent)
    return ok


def dual(a: list[Level], b: list[Level], same: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that may be similar, found from the roots down. same: both trees are one."""
    top = max(len(a), len(b)) - 1
    at = lambda t, d: t[min(d, len(t) - 1)]
    stack = [(top, *np.meshgrid(np.arange(len(at(a, top).bits)), np.arange(len(at(b, top).bits)), indexing="ij"))]
    stack[0] = (top, stack[0][1].ravel(), stack[0][2].ravel())
    while stack:
        depth, i, j = stack.pop()
        if same:
            i, j = i[i <= j], j[i <= j]
        if len(i) > CHUNK:
            stack += [(depth, i[k : k + CHUNK], j[k : k + CHUNK]) for k in range(0, len(i), CHUNK)]
            continue
        ok = possible(at(a, depth), at(b, depth), i, j, percent)
        if same and depth:
            ok |= (i == j) & (at(a, depth).label[i] < 0)
        i, j = i[ok], j[ok]
        if not depth:
            yield (i[i != j], j[i != j]) if same else (i, j)
            continue
        for tree, who in ((a, 0), (b, 1)):
            if depth < len(tree):  # this tree has a level below
                n = len(tree[depth - 1].bits)
                rep = np.repeat(np.arange(len(i)), FANOUT)
                kid = (i, j)[who][rep] * FANOUT + np.tile(np.arange(FANOUT), len(i))
                keep = kid < n
                i, j = (kid[keep], j[rep][keep]) if who == 0 else (i[rep][keep], kid[keep])
        if len(i):
            stack.append((depth - 1, i, j))


def forest(bitmaps: list[bytes], sizes: np.ndarray, percent: int, similar: Callable[[int, int], bool] | None) -> list[tuple[int, int]]:
    """Edges that connect all members which links connect. similar(i, j) decides; without it, the bound does.

    A few pivots are first compared with everyone: a large group of near copies
    falls into one component at once, and nodes that lie in one component are not
    opened again. No pair of different components that may be similar is left out.
    """
    n = len(sizes)
    parent, edges = list(range(n)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b and (similar is None or similar(i, j)):
            parent[max(a, b)] = min(a, b)
            edges.append((i, j))

    words = np.array([len(x) // 8 for x in bitmaps])
    groups = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
    matrix = {w: np.frombuffer(b"".join(bitmaps[k] for k in at), np.uint64).reshape(len(at), w) for w, at in groups.items()}
    for w, at in groups.items():
        flat = Level(matrix[w], sizes[at], sizes[at], sizes[at] - np.bitwise_count(matrix[w]).sum(axis=1).astype(np.int64), np.full(len(at), -1))
        alone = np.ones(len(at), bool)
        for _ in range(PIVOTS if len(at) > 2 * FANOUT else 0):
            left = np.flatnonzero(alone)
            if len(left) < FANOUT:
                break
            p = left[len(left) // 2]
            others = left[left != p]
            for k in others[possible(flat, flat, np.full(len(others), p), others, percent)]:
                join(int(at[p]), int(at[k]))
            alone[p] = False
            alone[[k for k in others if root(int(at[k])) == root(int(at[p]))]] = False
    for w, at in groups.items():
        label = lambda idx: np.array([root(int(k)) for k in idx])
        order = np.lexsort((matrix[w][:, 0], sizes[at], label(at)))
        own = at[order]
        tree = levels(matrix[w][order], sizes[own], label(own))
        for i, j in dual(tree, tree, True, percent):
            for x, y in zip(own[i].tolist(), own[j].tolist()):
                join(x, y)
        if 2 * w in groups:  # similar sizes may lie on both sides of a width
            tree = levels(matrix[w][order], sizes[own], label(own))
            wide = groups[2 * w]
            wide_bits = fold(matrix[2 * w], w)
            order2 = np.lexsort((sizes[wide], label(wide)))
            other = wide[order2]
            for i, j in dual(tree, levels(wide_bits[order2], sizes[other], label(other)), False, percent):
                for x, y in zip(own[i].tolist(), other[j].tolist()):
                    join(x, y)
    return edges
