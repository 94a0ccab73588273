"""Sums of plain distances to every cluster, without all pairs where cells of rows lie far apart.

Rows are cut into cells by a tree of their coordinates. Between two cells whose gap is large beside their sides the distance is a smooth function
of both places: interpolated in Chebyshev nodes it differs by less than 1e-12 of itself, which is the rounding of a sum. A cell then stands for its
rows by one weight a node and cluster. Pairs of near cells are summed row by row. What is far and what is near follows from the cells' bounds only,
so every pair of rows counts once whatever the cells are; a poor cut costs time, not accuracy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: (gap in sides of the larger cell at least, nodes a dimension), the farthest first.
ORDERS = ((6.0, 9), (1.5, 17))
#: Distances that are formed at once.
AT_ONCE = 1 << 17


def nodes_of(low: np.ndarray, high: np.ndarray, p: int) -> np.ndarray:
    """The Chebyshev nodes of a box, one line each; a side of no length has one."""
    sides = [(a + b) / 2 + (b - a) / 2 * np.cos(np.pi * (np.arange(p) + 0.5) / p) if b > a else np.array([a]) for a, b in zip(low, high)]
    return np.stack(np.meshgrid(*sides, indexing="ij"), axis=-1).reshape(-1, len(low))


def shares_of(x: np.ndarray, low: np.ndarray, high: np.ndarray, p: int) -> np.ndarray:
    """One line per line of ``x``: how much each node of its box counts for it."""
    out = np.ones((len(x), 1))
    k, at = np.arange(1, p), np.pi * (np.arange(p) + 0.5) / p
    for j, (a, b) in enumerate(zip(low, high)):
        if b > a:
            angle = np.arccos(np.clip((x[:, j] - (a + b) / 2) / ((b - a) / 2), -1, 1))
            one = (1 + 2 * np.cos(angle[:, None] * k) @ np.cos(k[:, None] * at)) / p
            out = (out[:, :, None] * one[:, None, :]).reshape(len(x), -1)
    return out


def weighted_sums(p: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each line of ``p`` the sums over ``q`` of distance times the weights ``w``."""
    out, step = np.zeros((len(p), w.shape[1])), max(1, AT_ONCE // max(len(p), 1))
    for s in range(0, len(q), step):
        d = np.zeros((len(p), len(q[s:s + step])))
        for k in range(p.shape[1]):
            h = p[:, k, None] - q[None, s:s + step, k]
            d += h * h
        out += np.sqrt(d, out=d) @ w[s:s + step]
    return out


@dataclass
class Tree:
    """Cells by cuts: rows of a node go left up to ``cut`` in ``dim``. A leaf has dim -1, its first cell in ``left`` and its number of cells in ``right``."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @property
    def cells(self) -> int:
        return int(self.right[self.dim < 0].sum())

    def cell_of(self, x: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """The cell of each line of ``x``; rows of a leaf with several cells are dealt by the hash ``spread``."""
        at = np.zeros(len(x), np.int64)
        while len(inner := np.flatnonzero(self.dim[at] >= 0)):
            node = at[inner]
            at[inner] = np.where(x[inner, self.dim[node]] <= self.cut[node], self.left[node], self.right[node])
        return self.left[at] + (spread.view(np.uint64) >> np.uint64(20)).astype(np.int64) % self.right[at]


def grown(x: np.ndarray, most: int) -> Tree:
    """A tree over sampled rows: the longest side is halved by rows until ``most`` of the sample are left; equal rows can't be cut and make several cells."""
    dim, cut, left, right, cells = [-1], [0.0], [0], [1], 0
    todo = [(0, np.arange(len(x)))]
    while todo:  # left sides first, so that cells of near numbers are near
        at, rows = todo.pop()
        k = value = None
        if len(rows) > most:
            side = np.ptp(x[rows], axis=0)
            if np.isfinite(side).all() and side.max() > 0:
                k = int(side.argmax())
                own = np.sort(x[rows, k])
                value = own[(len(own) - 1) // 2]
                if value == own[-1]:  # more than half are the largest
                    value = own[np.searchsorted(own, value) - 1]
        if k is None:
            left[at], right[at] = cells, max(1, -(-len(rows) // (2 * most)))
            cells += right[at]
            continue
        low = x[rows, k] <= value
        dim[at], cut[at], left[at], right[at] = k, value, len(dim), len(dim) + 1
        for column, new in ((dim, -1), (cut, 0.0), (left, 0), (right, 1)):
            column += [new, new]
        todo += [(right[at], rows[~low]), (left[at], rows[low])]
    return Tree(np.array(dim), np.array(cut), np.array(left), np.array(right))


@dataclass
class Cells:
    """Bounds and rows of the cells, and per order the nodes and weights of all cells, one cell after the other."""

    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    nodes: list[np.ndarray]
    weights: list[np.ndarray]

    def sizes(self, order: int) -> np.ndarray:
        """Nodes of each cell."""
        return np.where(self.rows[:, None] > 0, np.where(self.high > self.low, ORDERS[order][1], 1), 0).prod(axis=1)

    def order_of(self, a: int) -> np.ndarray:
        """Of each cell the order in which it is summed for cell ``a``, or -1 where rows are summed one by one. The same from both sides."""
        with np.errstate(invalid="ignore"):
            gap = np.sqrt((np.maximum(0.0, np.maximum(self.low - self.high[a], self.low[a] - self.high)) ** 2).sum(axis=1))
            side = np.maximum((self.high - self.low).max(axis=1), (self.high[a] - self.low[a]).max())
            out = np.full(len(self.rows), -1)
            for k in reversed(range(len(ORDERS))):
                n = self.sizes(k)
                out[np.isfinite(gap) & np.isfinite(side) & (gap >= ORDERS[k][0] * side) & (n * n[a] < self.rows * self.rows[a])] = k
        return out

    def far_sums(self, a: int, x: np.ndarray) -> np.ndarray:
        """For rows ``x`` of cell ``a`` the sums of distances to the clusters of all cells that are far."""
        order, out = self.order_of(a), 0.0
        for k, (_, p) in enumerate(ORDERS):
            some = np.repeat(order == k, self.sizes(k))
            if some.any():
                local = weighted_sums(nodes_of(self.low[a], self.high[a], p), self.nodes[k][some], self.weights[k][some])
                out = out + shares_of(x, self.low[a], self.high[a], p) @ local
        return out + np.zeros((len(x), self.weights[0].shape[1]))


def weights_of(x: np.ndarray, code: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bounds of the rows of a cell, and per order the weight of each node and cluster."""
    low, high = x.min(axis=0), x.max(axis=0)
    if not (np.isfinite(low).all() and np.isfinite(high).all()):  # never far; nodes are not read
        return low, high, [np.zeros((int(np.where(high > low, p, 1).prod()), levels)) for _, p in ORDERS]
    member = np.eye(levels)[code]
    return low, high, [shares_of(x, low, high, p).T @ member for _, p in ORDERS]
