"""Signature trees: a set join inside one block of documents.

Leaves hold a few documents of similar size, inner nodes the OR of their children's token bitmaps and
the range of their set sizes. Two trees (here: one with itself) are traversed together. A pair of
nodes is left when no pair of documents below can share enough: the sizes are too far apart, or the
tokens that both bitmaps can stand for are fewer than the overlap that the smallest sets need. It is
also left when all documents below are known to be in one component.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF = 16
FAN_OUT = 4


def bitmap_words(size: int, per_token: int) -> int:
    """64-bit words of a bitmap with about ``per_token`` bits for each of ``size`` tokens; a power of two."""
    return 1 << max(2, (max(1, size) * per_token - 1).bit_length() - 6)


def bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    bits = np.zeros(words * 64, dtype=np.uint8)
    bits[(tokens & np.uint64(words * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def signatures(sets: list[np.ndarray], most_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, slack) of the sets of a block. Tokens that only one set has are left out and the others get a bit each,
    so that common bits are the overlap; where that takes more than ``most_bytes``, bits are shared by
    tokens, and slack says how many tokens of a set share one with another of its own."""
    sizes = np.array([len(s) for s in sets])
    tokens, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = counts > 1
    words = max(1, -(-int(own.sum()) // 64))
    if words * 8 * len(sets) > most_bytes:
        words = min(bitmap_words(int(sizes.max()), 4), max(4, 1 << (most_bytes // (8 * len(sets))).bit_length() - 1))
        bits = np.stack([bitmap(s, words) for s in sets])
        return bits, sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    place = (np.cumsum(own) - 1)[at]
    rows, place = np.repeat(np.arange(len(sets)), sizes)[own[at]], place[own[at]]
    bits = np.zeros((len(sets), words * 8), dtype=np.uint8)
    np.bitwise_or.at(bits, (rows, place >> 3), np.left_shift(1, place & 7).astype(np.uint8))
    return bits.view(np.uint64), np.zeros(len(sets), dtype=np.int64)


class Components:
    def __init__(self, labels: list):
        first: dict = {}
        self.parent = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def union(self, i: int, j: int) -> None:
        self.parent[self.find(j)] = self.find(i)


def pairs(sizes: np.ndarray, bits: np.ndarray, slack: np.ndarray, labels: list, percent: int, accept: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs (i, j) in different components for which the bounds leave 100 * overlap >= percent * union
    possible and ``accept`` is true. The two components become one, so what is found links every document
    to its component, without all pairs inside it."""
    n = len(sizes)
    # sizes first, then like bitmaps side by side: leaves of near copies stay sparse
    order = np.lexsort((bits[:, 0], np.array([hash(x) for x in labels], dtype=np.int64), sizes)) if n else np.zeros(0, dtype=np.int64)
    sizes, bits, slack = sizes[order].astype(np.int64), bits[order], slack[order]
    comp = Components([labels[i] for i in order.tolist()])
    levels = []
    starts = np.arange(0, n, LEAF)
    level = (np.bitwise_or.reduceat(bits, starts, axis=0), np.minimum.reduceat(sizes, starts), np.maximum.reduceat(sizes, starts), np.maximum.reduceat(slack, starts)) if n else None
    while level is not None:
        levels.append(level)
        if len(level[1]) == 1:
            break
        starts = np.arange(0, len(level[1]), FAN_OUT)
        level = (np.bitwise_or.reduceat(level[0], starts, axis=0), np.minimum.reduceat(level[1], starts), np.maximum.reduceat(level[2], starts), np.maximum.reduceat(level[3], starts))
    found: list[tuple[int, int]] = []
    if n < 2:
        return found

    def possible(level: int, a: int, b: int) -> bool:
        nodes, least, most, spare = levels[level]
        if 100 * min(most[a], most[b]) < percent * max(least[a], least[b]):
            return False
        shared = int(np.bitwise_count(nodes[a] & nodes[b]).sum()) + min(spare[a], spare[b])
        return (100 + percent) * min(shared, most[a], most[b]) >= percent * (least[a] + least[b])

    def one_component(level: int, a: int, b: int) -> bool:
        span = LEAF * FAN_OUT**level
        root = comp.find(a * span)
        return all(comp.find(i) == root for x in {a, b} for i in range(x * span, min(n, (x + 1) * span)))

    stack = [(len(levels) - 1, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        if (a != b and not possible(level, a, b)) or one_component(level, a, b):
            continue
        if level:
            children = [range(x * FAN_OUT, min(len(levels[level - 1][1]), (x + 1) * FAN_OUT)) for x in (a, b)]
            below = [(level - 1, x, y) for x in children[0] for y in children[1] if a != b or x <= y]
            stack += sorted(below, key=lambda t: t[1] == t[2])  # a node with itself first: near neighbours link early
            continue
        left, right = np.arange(a * LEAF, min(n, (a + 1) * LEAF)), np.arange(b * LEAF, min(n, (b + 1) * LEAF))
        shared = np.bitwise_count(bits[left][:, None, :] & bits[right][None, :, :]).sum(axis=2).astype(np.int64) + np.minimum(slack[left][:, None], slack[right][None, :])
        shared = np.minimum(shared, np.minimum(sizes[left][:, None], sizes[right][None, :]))
        may = (100 + percent) * shared >= percent * (sizes[left][:, None] + sizes[right][None, :])
        for x, y in zip(*(z.tolist() for z in np.nonzero(may))):
            i, j = a * LEAF + x, b * LEAF + y
            if i < j and comp.find(i) != comp.find(j):
                if accept(int(order[i]), int(order[j])):
                    found.append((int(order[i]), int(order[j])))
                    comp.union(i, j)
    return found
