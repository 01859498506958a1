"""A k-d tree over a bounded sample of places: its leaves deal places to tasks, whatever their density and outliers."""

from __future__ import annotations

import numpy as np


class Tree:
    """Leaves of about `leaf` places each: places with a coordinate at most the cut go left."""

    def __init__(self, x: np.ndarray, y: np.ndarray, leaf: int):
        self.axis: list[int] = []  # -1: a leaf
        self.cut: list[float] = []
        self.right: list[int] = []  # the left child follows its parent
        self.box: list[tuple[float, float, float, float]] = []
        inf = float("inf")
        todo = [(np.arange(len(x)), (-inf, -inf, inf, inf), -1)]
        while todo:
            at, box, parent = todo.pop()
            if parent >= 0:
                self.right[parent] = len(self.axis)
            node = len(self.axis)
            self.axis.append(-1)
            self.cut.append(0.0)
            self.right.append(-1)
            self.box.append(box)
            if len(at) <= leaf:
                continue
            spread = [np.ptp(v[at]) for v in (x, y)]
            axis = int(spread[1] > spread[0])
            v = (x, y)[axis][at]
            cut = float(np.median(v))
            left = v <= cut
            if left.all():  # many equal values: they go left, and the cut is just under the largest
                cut = float(v[v < v.max()].max()) if (v < v.max()).any() else cut
                left = v <= cut
            if left.all():
                continue
            self.axis[node], self.cut[node] = axis, cut
            low, high = list(box), list(box)
            low[2 + axis], high[axis] = cut, cut
            todo.append((at[~left], tuple(high), node))
            todo.append((at[left], tuple(low), -1))
        self.arrays = np.array(self.axis), np.array(self.cut), np.array(self.right), np.array(self.box)

    @property
    def leaves(self) -> int:
        return sum(a < 0 for a in self.axis)

    def leaf_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        axis, cut, right, _ = self.arrays
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(axis[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            v = np.where(axis[at] == 0, x[inner], y[inner])
            node[inner] = np.where(v <= cut[at], at + 1, right[at])

    def reached(self, x: float, y: float, r2: float, own: int) -> list[int]:
        """Leaves other than own that have a point within the squared distance r2."""
        axis, _, right, box = self.arrays
        out, todo = [], [0]
        while todo:
            n = todo.pop()
            x0, y0, x1, y1 = box[n]
            dx, dy = max(x0 - x, 0.0, x - x1), max(y0 - y, 0.0, y - y1)
            if dx * dx + dy * dy > r2:
                continue
            if axis[n] < 0:
                if n != own:
                    out.append(int(n))
            else:
                todo += [n + 1, int(right[n])]
        return out
