"""Vantage-point trees over 64-bit codes under (masked) Hamming distance.

Two uses: ``BandTree`` deals codes out to shards, ``near_forest`` finds the links inside one shard. Both
split a set by the distance to a vantage point at a radius mu, and both rest on the triangle bound: a
point at distance d from the vantage can only be within r of points at distances d - r to d + r.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np

#: Sets up to this size are compared directly.
LEAF = 384
#: Distances held at once while comparing directly.
CHUNK = 1 << 20


def bands(n_bands: int, bits: int = 64) -> list[np.uint64]:
    """Masks that split the code into n_bands runs of nearly equal width."""
    edges = [round(k * bits / n_bands) for k in range(n_bands + 1)]
    return [np.uint64(sum(1 << b for b in range(lo, hi))) for lo, hi in zip(edges, edges[1:])]


def clean_masks(radius: int, width: int) -> list[np.uint64]:
    """Masks of ``width`` bits or more (at most 32), one of which is clear of any ``radius`` differing bits.

    Of radius + c bands at least c are untouched, so the unions of every c of them will do; c is the least
    that gives the width.
    """
    c = 1
    while 64 * c // (radius + c) < min(width, 32):
        c += 1
    parts = bands(radius + c)
    return [np.bitwise_or.reduce(np.array(some, dtype=np.uint64)) for some in itertools.combinations(parts, c)]


def _points(node: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random 64-bit point for each node number."""
    x = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BandTree:
    """A complete tree of ``depth`` levels over the bits in ``mask``.

    Codes are majorities of hash bits, so any point serves as a vantage point: each node's is computed
    from its number, and the tree needs neither a pass over the data nor memory. mu is the median distance
    of two random points.
    """

    def __init__(self, mask: np.uint64, depth: int, seed: int):
        self.mask, self.depth, self.seed = mask, depth, seed
        self.mu = (int(mask).bit_count() - 1) // 2

    def visit(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that can hold a point within ``radius`` of the row's code.

        At radius 0 that is one leaf a row; otherwise rows near a boundary go to the leaves on both sides.
        """
        rows, node = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        for _ in range(self.depth):
            far = np.bitwise_count((codes[rows] ^ _points(node, self.seed)) & self.mask).astype(np.int64)
            inner, outer = far - radius <= self.mu, far + radius > self.mu
            rows, node = np.concatenate([rows[inner], rows[outer]]), np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
        return rows, node - ((1 << self.depth) - 1)


def tree_depth(total: int, shard: int) -> int:
    """Levels at which ``total`` codes make shards of ``shard`` codes, and a fifth more, as levels split unevenly."""
    return math.ceil(1.2 * max(0.0, math.log2(max(1, total) / shard)))


class Union:
    """Union-find over 0..n-1, merged by arrays of pairs; ``root`` is always fully compressed."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _direct(codes: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, CHUNK // max(1, len(b)))
    for lo in range(0, len(a), step):
        part = a[lo : lo + step]
        i, j = np.nonzero(np.bitwise_count(codes[part][:, None] ^ codes[b][None, :]) <= radius)
        yield part[i], b[j]


def near_pairs(codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of index pairs of all codes within ``radius`` of each other, each pair at least once.

    A vantage-point self-join: inside against inside, outside against outside, and across the boundary
    only the points whose distances to the vantage differ by no more than the radius.
    """
    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(codes)), None)]
    while todo:
        a, b = todo.pop()
        other = a if b is None else b
        if len(a) == 0 or len(other) == 0:
            continue
        if len(a) * len(other) <= LEAF * LEAF:
            yield from _direct(codes, a, other, radius)
            continue
        vantage = codes[(a if len(a) >= len(other) else other)[0]]
        da = np.bitwise_count(codes[a] ^ vantage).astype(np.int64)
        db = da if b is None else np.bitwise_count(codes[b] ^ vantage).astype(np.int64)
        mu = int(np.median(da if len(a) >= len(other) else db))
        a_in, a_out = da <= mu, da > mu
        o_in, o_out = db <= mu, db > mu
        if (a_in.all() or a_out.all()) and (o_in.all() or o_out.all()):  # the vantage splits nothing
            if a_in.all() == o_in.all() or b is None:
                yield from _direct(codes, a, other, radius)
            else:
                close_a, close_b = np.abs(da - mu) <= radius, np.abs(db - mu) <= radius
                yield from _direct(codes, a[close_a], other[close_b], radius)
            continue
        rim_a, rim_b = (da > mu - radius) & (da <= mu + radius), (db > mu - radius) & (db <= mu + radius)
        if b is None:
            todo += [(a[a_in], None), (a[a_out], None), (a[a_in & rim_a], a[a_out & rim_a])]
        else:
            todo += [(a[a_in], b[o_in]), (a[a_out], b[o_out]), (a[a_in & rim_a], b[o_out & rim_b]), (a[a_out & rim_a], b[o_in & rim_b])]


def near_forest(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) codes: a spanning star for each class of codes linked within ``radius``."""
    union = Union(len(codes))
    for i, j in near_pairs(codes, radius):
        union.add(i, j)
    moved = np.nonzero(union.root != np.arange(len(codes)))[0]
    return codes[moved], codes[union.root[moved]]
