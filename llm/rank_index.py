"""A learned index from rank to offset: piecewise-linear segments with bounded errors, made exact by stored residuals."""

from __future__ import annotations

import numpy as np

#: Residuals fit a signed byte: segments are cut until no offset is further from its line.
ERROR = 127
#: Ranks of one segment at most.
SEGMENT = 4096


def fitted(offsets: np.ndarray, error: int = ERROR, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first rank, start, slope, residuals) of segments over ascending offsets; every residual is within +-error.

    A segment starts as the line through its first and last offset, moved to the middle of its errors. A segment with
    a larger error is halved; one or two offsets lie on their line.
    """
    n = len(offsets)
    residual = np.zeros(n, np.int8)
    first, start, slope = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    low = np.arange(0, n, segment)
    high = np.minimum(low + segment, n)
    while len(low):
        size = high - low
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        step = np.arange(int(size.sum())) - np.repeat(begin, size)
        rank = np.repeat(low, size) + step
        rise = (offsets[high - 1] - offsets[low]) / np.maximum(size - 1, 1)
        off = offsets[rank] - np.repeat(offsets[low], size) - np.rint(np.repeat(rise, size) * step).astype(np.int64)
        least, most = np.minimum.reduceat(off, begin), np.maximum.reduceat(off, begin)
        middle = (least + most) // 2
        good = most - middle <= error
        good &= middle - least <= error
        inside = np.repeat(good, size)
        residual[rank[inside]] = (off - np.repeat(middle, size))[inside]
        first.append(low[good])
        start.append(offsets[low[good]] + middle[good])
        slope.append(rise[good])
        low, high = low[~good], high[~good]
        half = (low + high) // 2
        low, high = np.concatenate([low, half]), np.concatenate([half, high])
    first, start, slope = np.concatenate(first), np.concatenate(start), np.concatenate(slope)
    order = np.argsort(first, kind="stable")
    return first[order], start[order], slope[order], residual


class RankIndex:
    """Offsets by rank. They are put in block by block, in ascending order; an offset takes one byte beside the segments."""

    def __init__(self, error: int = ERROR):
        self.error, self.size = error, 0
        self._blocks: list[tuple[np.ndarray, ...]] = []

    def extend(self, offsets: np.ndarray) -> None:
        first, start, slope, residual = fitted(np.asarray(offsets, np.int64), self.error)
        self._blocks.append((first + self.size, start, slope, residual))
        self.size += len(residual)

    def closed(self) -> RankIndex:
        """The index after the last block."""
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int8))
        self.first, self.start, self.slope, self.residual = map(np.concatenate, zip(empty, *self._blocks))
        self._blocks = []
        return self

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        """The line's offset, within ``error`` of the true one."""
        at = np.searchsorted(self.first, ranks, "right") - 1
        return self.start[at] + np.rint(self.slope[at] * (ranks - self.first[at])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offset of each rank."""
        return self.predicted(ranks) + self.residual[ranks]
