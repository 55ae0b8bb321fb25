"""A vantage-point tree over points of integers, and exact nearest points of many vectors by branch and bound."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points of a leaf at most
LEAF = 8
#: Bounds come from square roots of exact integers; a branch goes only if it is farther by more than this share.
_SLACK = 1e-9
_EXACT = 1 << 53
_LONG = 1 << 63


class TooLargeError(OverflowError):
    """A component whose squared distances do not fit 64 bits."""


def squared_distances(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact, as 64-bit integers. Where every partial sum is below 2^53 the products are taken in floating point, which
    is exact there, too."""
    if not len(vectors) or not len(points):
        return np.zeros((len(vectors), len(points)), np.int64)
    largest = sum(max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (vectors, points))
    bound = vectors.shape[1] * largest * largest
    if bound >= _LONG:
        raise TooLargeError(f"components of {largest} have squared distances beyond 64 bits")
    if bound < _EXACT:
        v, p = vectors.astype(np.float64), points.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ p.T) + (p * p).sum(1)).astype(np.int64)
    out = np.empty((len(vectors), len(points)), np.int64)
    for j, point in enumerate(points):
        out[:, j] = ((vectors - point) ** 2).sum(1)
    return out


@dataclass
class Node:
    """A vantage point with the nearer and the farther half of the other points, each in a shell around it; or a leaf."""

    points: np.ndarray                              # one vantage point, or the points of a leaf
    children: tuple[int, ...] = ()
    shells: tuple[tuple[float, float], ...] = ()    # least and largest distance of each child's points


class VantageTree:
    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = np.ascontiguousarray(points, np.int64)
        self.nodes: list[Node] = []
        if len(self.points):
            self._build(np.arange(len(self.points)), leaf)

    def _build(self, members: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        if len(members) <= leaf:
            self.nodes.append(Node(members))
            return at
        # the point farthest from the middle sees the others at the most different distances
        around = self.points[members] - self.points[members].sum(0) // len(members)
        top = int(np.argmax((around.astype(np.float64) ** 2).sum(1)))
        vantage, rest = members[top], np.delete(members, top)
        self.nodes.append(Node(members[top:top + 1]))
        far = np.sqrt(squared_distances(self.points[rest], self.points[[vantage]])[:, 0].astype(np.float64))
        order = np.argsort(far, kind="stable")
        halves = [h for h in (order[:len(order) // 2], order[len(order) // 2:]) if len(h)]
        shells = tuple((float(far[h].min()), float(far[h].max())) for h in halves)
        children = tuple(self._build(np.sort(rest[h]), leaf) for h in halves)
        self.nodes[at] = Node(members[top:top + 1], children, shells)
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest point, squared distance) of each vector; ties go to the smaller number.

        Every vector has its own queue of branches with the least distance that their points can have, and takes the
        best one first until all that are left are farther than its nearest point. A branch that may hold a point at the
        same distance is still visited, for the sake of ties. Vectors that take the same branch in a turn share its
        distances.
        """
        if not self.nodes:
            raise ValueError("a tree without points has no nearest one")
        out = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
        most = max(1, (1 << 21) // len(self.nodes))
        for i in range(0, len(vectors), most):
            found = self._nearest(np.ascontiguousarray(vectors[i:i + most], np.int64))
            out[0][i:i + most], out[1][i:i + most] = found
        return out

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(vectors)
        best, least = np.full(n, len(self.points)), np.full(n, np.iinfo(np.int64).max)
        radius = np.full(n, np.inf)
        queue = np.full((n, len(self.nodes)), np.inf)
        queue[:, 0] = 0
        active = np.arange(n)
        while len(active):
            branch = queue[active].argmin(1)
            bound = queue[active, branch]
            open_ = bound <= radius[active]     # inclusive
            active, branch, bound = active[open_], branch[open_], bound[open_]
            queue[active, branch] = np.inf
            order = np.argsort(branch, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(branch[order])) + 1):
                if not len(group):
                    continue
                node, who = self.nodes[branch[group[0]]], active[group]
                squared = squared_distances(vectors[who], self.points[node.points])
                near = squared.argmin(1)        # members ascend: the smaller number first
                d, point = squared[np.arange(len(who)), near], node.points[near]
                closer = (d < least[who]) | ((d == least[who]) & (point < best[who]))
                won = who[closer]
                best[won], least[won] = point[closer], d[closer]
                radius[won] = np.sqrt(d[closer].astype(np.float64))
                away = np.sqrt(squared[:, 0].astype(np.float64))
                for child, (low, high) in zip(node.children, node.shells):
                    gap = np.maximum(low - away, away - high) - _SLACK * (away + high)
                    queue[who, child] = np.maximum(np.maximum(gap, 0), bound[group])
        return best, least
