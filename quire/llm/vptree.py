"""Vantage-point trees over 64-bit fingerprints under Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 48


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int16)


class Tree:
    """Points in the order of `order`; a node is (vantage point, radius, inner child, outer child) or (first, last) for a leaf."""

    def __init__(self, points: np.ndarray, seed: int = 7) -> None:
        self.points, self.order = points, np.arange(len(points))
        self.random = np.random.default_rng(seed)
        self.root = self._build(0, len(points))

    def _build(self, a: int, z: int):
        own = self.order[a:z]
        if z - a <= LEAF:
            return (a, z)
        vantage = self.points[own[self.random.integers(z - a)]]
        d = distance(self.points[own], vantage)
        radius = int(np.median(d))
        inner = d <= radius
        if inner.all():  # most points alike
            inner = d < radius
            radius -= 1
            if not inner.any():
                return (a, z)
        self.order[a:z] = np.concatenate([own[inner], own[~inner]])
        m = a + int(inner.sum())
        return (vantage, radius, self._build(a, m), self._build(m, z))

    def within(self, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, point numbers) at a distance of `reach` or less. A branch is left out for the queries that the triangle inequality keeps out of it."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, who = stack.pop()
            if not len(who):
                continue
            if len(node) == 2:
                own = self.order[node[0] : node[1]]
                block = max(1, 2_000_000 // max(1, len(own)))
                for i in range(0, len(who), block):
                    part = who[i : i + block]
                    q, p = np.nonzero(distance(queries[part][:, None], self.points[own][None, :]) <= reach)
                    yield part[q], own[p]
                continue
            vantage, radius, inner, outer = node
            d = distance(queries[who], vantage)
            stack.append((inner, who[d <= radius + reach]))
            stack.append((outer, who[d > radius - reach]))


def close_pairs(points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of points at a distance of `reach` or less."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, p in Tree(points).within(points, reach):
        keep = q < p
        left.append(q[keep])
        right.append(p[keep])
    return np.concatenate(left), np.concatenate(right)
