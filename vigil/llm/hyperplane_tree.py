"""A multiway tree of split points over vectors, for searches by inner product within windows of scores.

Vectors are lifted by one component so that all have the same length; then a high inner product with a query is a small
distance to it, and a window of scores is an annulus of distances. Each inner node has a few split points far apart, and a
vector belongs to the nearest one. For each split point and each child the node keeps the least and the greatest distance
from the point to the vectors below the child. A child whose range doesn't meet what the triangle inequality leaves of the
annulus holds no answer. Split points come from a bounded sample; ranges and leaves cover every vector.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Split points of an inner node.
FANOUT = 8
#: Part of the radius of the lifted sphere by which an annulus is widened: far above the rounding of a distance.
SLACK = 4e-6


def distances(a: np.ndarray, b: np.ndarray, radius2: float) -> np.ndarray:
    """Distances between the lifted rows of two matrices of whole numbers, none longer than the root of `radius2`."""
    lift = lambda x: np.sqrt(np.maximum(radius2 - np.einsum("ij,ij->i", x, x), 0))
    return np.sqrt(np.maximum(2 * (radius2 - a @ b.T - np.outer(lift(a), lift(b))), 0))


def to_query(q: np.ndarray, scores: np.ndarray, radius2: float) -> np.ndarray:
    """Distances of queries, which are lifted by nothing, to the vectors that have these inner products with them."""
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q).reshape(-1, *[1] * (scores.ndim - 1)) + radius2 - 2 * scores, 0))


@dataclass
class Node:
    points: np.ndarray
    #: For each point the index of an inner node, or -1 - leaf.
    children: list[int]
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))


class Tree:
    """Inner nodes, parents before children; leaves are numbered."""

    def __init__(self, sample: np.ndarray, rows: int, radius2: float, leaf_rows: int):
        """sample: distinct vectors in random order, which stand for `rows` vectors."""
        self.radius2, self.nodes, self.leaves, self.share = radius2, [], 0, []
        self.paths: list[list[tuple[int, int]]] = []
        self._grow(np.asarray(sample, float), max(rows, 1) / max(len(sample), 1), leaf_rows, [])

    def _grow(self, sample: np.ndarray, each: float, leaf_rows: int, path: list[tuple[int, int]]) -> int:
        if len(sample) < 2 * FANOUT or len(sample) * each <= leaf_rows:
            self.paths.append(path)
            self.share.append(len(sample) * each)
            self.leaves += 1
            return -self.leaves
        candidates = sample[: 4 * FANOUT]
        between = distances(candidates, candidates, self.radius2)
        chosen = [0]
        while len(chosen) < FANOUT:  # the candidate farthest from those chosen
            chosen.append(int(np.argmax(between[chosen].min(axis=0))))
        node, at = Node(candidates[chosen], [0] * FANOUT), len(self.nodes)
        self.nodes.append(node)
        nearest = np.argmin(distances(sample, node.points, self.radius2), axis=1)
        for j in range(FANOUT):
            node.children[j] = self._grow(sample[nearest == j], each, leaf_rows, [*path, (at, j)])
        return at

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int32)
        todo = [(0, np.arange(len(vectors)))] if self.nodes else []
        for at, rows in todo:
            nearest = np.argmin(distances(vectors[rows], self.nodes[at].points, self.radius2), axis=1)
            for j, child in enumerate(self.nodes[at].children):
                own = rows[nearest == j]
                if child < 0:
                    out[own] = -1 - child
                elif len(own):
                    todo.append((child, own))
        return out

    def reach(self, leaf: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distances from each split point above a leaf to vectors of the leaf, level by level."""
        found = [distances(self.nodes[at].points, vectors, self.radius2) for at, _ in self.paths[leaf]]
        flat = np.concatenate(found) if found else np.zeros((0, len(vectors)))
        return flat.min(axis=1, initial=np.inf), flat.max(axis=1, initial=-np.inf)

    def set_ranges(self, reached: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """reached: of each leaf that has vectors what `reach` says of all of them. Other children's ranges are empty."""
        for node in self.nodes:
            node.low, node.high = np.full((FANOUT, FANOUT), np.inf), np.full((FANOUT, FANOUT), -np.inf)
        for leaf, (low, high) in reached.items():
            for level, (at, j) in enumerate(self.paths[leaf]):
                own, node = slice(level * FANOUT, (level + 1) * FANOUT), self.nodes[at]
                node.low[:, j], node.high[:, j] = np.minimum(node.low[:, j], low[own]), np.maximum(node.high[:, j], high[own])

    def visits(self, queries: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Boolean, queries by leaves: the leaves that may hold a vector whose distance to the query lies in one of its
        annuli. near, far: queries by annuli; a far below near is no annulus."""
        alive = np.zeros((len(queries), self.leaves), bool)
        slack = SLACK * np.sqrt(self.radius2)
        near, far = near - slack, np.where(far < near, -np.inf, far + slack)
        if not self.nodes:
            alive[:] = (far >= near).any(axis=1)[:, None]
            return alive
        todo = [(0, np.arange(len(queries)), far >= near)]
        for at, rows, open_ in todo:
            node = self.nodes[at]
            d = to_query(queries[rows], queries[rows] @ node.points.T, self.radius2)[:, :, None]
            # By the triangle inequality a vector at distance r of the query is at |d - r| to d + r from the split point.
            least = np.maximum(np.maximum(d - far[rows][:, None, :], near[rows][:, None, :] - d), 0)
            most = d + far[rows][:, None, :]
            for j, child in enumerate(node.children):
                low, high = node.low[:, j][None, :, None] - slack, node.high[:, j][None, :, None] + slack
                left = open_ & ((least <= high) & (most >= low)).all(axis=1)
                some = left.any(axis=1)
                if child < 0:
                    alive[rows[some], -1 - child] = True
                elif some.any():
                    todo.append((child, rows[some], left[some]))
        return alive
