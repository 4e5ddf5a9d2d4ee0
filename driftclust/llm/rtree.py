"""An R-tree over vectors of counts, searched by an upper bound of the overlap of the sets behind them."""

from __future__ import annotations

import numpy as np


class CountTree:
    """Points are counts of set members by hash group. The overlap of two sets is at most the sum of the coordinate minima,
    and for all points below a node at most the sum of minima with the upper corner of the node's box.

    Bulk-loaded by sort and tile: by set size first, then, within a tile, by the coordinate that varies most.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fanout: int = 16):
        n = len(points)
        order = np.argsort(sizes, kind="stable")
        tile = fanout * fanout
        for at in range(0, n, tile):
            part = order[at : at + tile]
            order[at : at + tile] = part[np.argsort(points[part, np.argmax(points[part].var(axis=0))], kind="stable")] if len(part) > fanout else part
        self.order, self.points, self.sizes, self.fanout = order, points[order], sizes[order].astype(np.int64), fanout
        self.levels = []  # from the leaves up: upper corners, least and greatest set size
        high, low_n, high_n = self.points, self.sizes, self.sizes
        while len(high) > fanout:
            cuts = np.arange(0, len(high), fanout)
            high, low_n, high_n = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low_n, cuts), np.maximum.reduceat(high_n, cuts)
            self.levels.append((high, low_n, high_n))

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the points whose bound lets them reach a Jaccard similarity of num / den with the query, and the bounds."""
        levels = [(self.points, self.sizes, self.sizes), *self.levels]
        at = np.arange(len(levels[-1][0]))
        for depth in range(len(levels) - 1, -1, -1):
            high, low_n, high_n = levels[depth]
            bound = np.minimum(high[at], point).sum(axis=1, dtype=np.int64)
            # the smallest set below decides how much overlap is needed at least; sizes bound the rest
            fits = (bound * (num + den) >= num * (size + low_n[at])) & (high_n[at] * den >= size * num) & (low_n[at] * num <= size * den)
            at, bound = at[fits], bound[fits]
            if not depth or not len(at):
                break
            below = (at[:, None] * self.fanout + np.arange(self.fanout)).ravel()
            at = below[below < len(levels[depth - 1][0])]
        return self.order[at], bound
