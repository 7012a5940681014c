"""Validity and simplicity of long rings: edges meet other edges cell by cell, so the work follows the number of corners."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

Ring = np.ndarray


def _edges(ring: Ring) -> np.ndarray:
    e = np.concatenate([ring[:-1], ring[1:]], axis=1)
    return e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])]


def _orient(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _near_pairs(e: np.ndarray):
    """Blocks of index pairs ``(i < j)`` of edges that pass through one cell; a pair may come more than once."""
    from geoloom.operators.cover import _touched
    extent = max(float(np.ptp(e[:, [0, 2]])), float(np.ptp(e[:, [1, 3]])))
    if extent == 0:
        return
    size = max(extent / max(1.0, np.sqrt(len(e))), extent * 1e-12)
    low = e.reshape(-1, 2).min(0)
    n = int(extent / size) + 1
    k, cx, cy = _touched(e - np.tile(low, 2), size, (0, n, 0, n))        # an edge's cells have a margin wider than rounding
    cell = cx * (n + 1) + cy
    order = np.lexsort((k, cell))
    k, cell = k[order], cell[order]
    d = 1
    while True:
        same = cell[d:] == cell[:-d]
        if not same.any():
            return
        yield k[:-d][same], k[d:][same]
        d += 1


def _sides(s: np.ndarray, t: np.ndarray):
    c = lambda a, i: a[:, i]
    return (_orient(c(t, 0), c(t, 1), c(t, 2), c(t, 3), c(s, 0), c(s, 1)), _orient(c(t, 0), c(t, 1), c(t, 2), c(t, 3), c(s, 2), c(s, 3)),
            _orient(c(s, 0), c(s, 1), c(s, 2), c(s, 3), c(t, 0), c(t, 1)), _orient(c(s, 0), c(s, 1), c(s, 2), c(s, 3), c(t, 2), c(t, 3)))


def _boxes_meet(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    lo, hi = np.minimum, np.maximum
    return ((lo(s[:, 0], s[:, 2]) <= hi(t[:, 0], t[:, 2])) & (lo(t[:, 0], t[:, 2]) <= hi(s[:, 0], s[:, 2]))
            & (lo(s[:, 1], s[:, 3]) <= hi(t[:, 1], t[:, 3])) & (lo(t[:, 1], t[:, 3]) <= hi(s[:, 1], s[:, 3])))


def meets_itself(ring: Ring, closed: bool) -> bool:
    """Two edges meet other than at the corner neighbours share, or one neighbour folds back onto the other."""
    e = _edges(ring)
    n = len(e)

    def folds(u, v, w) -> np.ndarray:
        return (_orient(u[:, 0], u[:, 1], v[:, 0], v[:, 1], w[:, 0], w[:, 1]) == 0) & (
            (u[:, 0] - v[:, 0]) * (w[:, 0] - v[:, 0]) + (u[:, 1] - v[:, 1]) * (w[:, 1] - v[:, 1]) > 0)
    if n > 1 and folds(e[:-1, :2], e[:-1, 2:], e[1:, 2:]).any():
        return True
    # of two edges only, the second one is the first one's neighbour in the other direction too, and counted above
    if closed and n > 2 and folds(e[:1, 2:], e[:1, :2], e[-1:, :2]).any():
        return True
    for i, j in _near_pairs(e):
        apart = (j != i + 1) & ~(closed & (i == 0) & (j == n - 1))
        s, t = e[i[apart]], e[j[apart]]
        if len(s):
            a, b, c, d = _sides(s, t)
            if (_boxes_meet(s, t) & (np.sign(a) * np.sign(b) <= 0) & (np.sign(c) * np.sign(d) <= 0)).any():
                return True
    return False


def _cross_each_other(rings: list[Ring]) -> bool:
    parts = [_edges_all(r) for r in rings]
    e, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    for i, j in _near_pairs(e):
        other = of[i] != of[j]
        s, t = e[i[other]], e[j[other]]
        if len(s):
            a, b, c, d = _sides(s, t)
            if (_boxes_meet(s, t) & (np.sign(a) * np.sign(b) < 0) & (np.sign(c) * np.sign(d) < 0)).any():
                return True
    return False


def _edges_all(ring: Ring) -> np.ndarray:
    return np.concatenate([ring[:-1], ring[1:]], axis=1) if len(ring) > 1 else np.empty((0, 4))


class _Area:
    """Where points lie in the area of one ring, looked up in its cover."""

    def __init__(self, ring: Ring):
        from geoloom.operators.cover import cover_cells
        e = _edges(ring)
        self.cells = {(lv, cx, cy): (side, own) for lv, cx, cy, side, own in cover_cells(e)} if len(e) else {}
        self.levels = sorted({k[0] for k in self.cells})

    def locate(self, x: float, y: float) -> int:
        from geoloom.operators.cover import _left
        for lv in self.levels:
            size = 2.0 ** lv
            key = (lv, int(np.floor(x / size)), int(np.floor(y / size)))
            if key in self.cells:
                side, e = self.cells[key]
                if e is None:
                    return 1
                on = (_orient(e[:, 0], e[:, 1], e[:, 2], e[:, 3], x, y) == 0) & (np.minimum(e[:, 0], e[:, 2]) <= x) & (x <= np.maximum(e[:, 0], e[:, 2])) & (
                    np.minimum(e[:, 1], e[:, 3]) <= y) & (y <= np.maximum(e[:, 1], e[:, 3]))
                if on.any():
                    return 0
                cx, cy = key[1] * size, key[2] * size
                left = lambda px, py: _left(e, np.array([[px]]), py)[:, 0]
                corner = left(cx, y)
                ways = (((e[:, 1] > y) != (e[:, 3] > y)) & (left(x, y) != corner)).sum() + (((e[:, 0] > cx) != (e[:, 2] > cx)) & (corner != left(cx, cy))).sum()
                return 1 if (side + ways) % 2 else -1
        return -1


def valid_polygon(rings: list[Ring], parts: list[int]) -> bool:
    """Rings closed and of four points at least, none meets itself, none cross, holes in their shell, no shell in another."""
    if not rings:
        return True
    for r in rings:
        if len(r) < 4 or (r[0] != r[-1]).any() or meets_itself(r[:, :2], True):
            return False
    rings = [r[:, :2] for r in rings]
    if len(rings) == 1:
        return True
    if _cross_each_other(rings):
        return False
    shell = [i == 0 or parts[i] != parts[i - 1] for i in range(len(rings))]
    areas = {i: _Area(r) for i, (r, s) in enumerate(zip(rings, shell)) if s}
    for h, ring in enumerate(rings):
        if not shell[h]:
            own = [i for i in areas if parts[i] == parts[h]]
            if any(areas[i].locate(*v) == -1 for i in own for v in ring.tolist()):
                return False
        elif any(i != h and all(a.locate(*v) == 1 for v in ring.tolist()) for i, a in areas.items()):
            return False
    return True


def simple_lines(paths: list[Ring]) -> bool:
    return not any(meets_itself(p[:, :2], bool((p[0] == p[-1]).all())) for p in paths if len(p))


def _rings(column) -> list[Ring]:
    return [np.array(r, float).reshape(len(r), -1) for r in column]


def valid_batch(rings: pa.Array, parts: pa.Array) -> pa.Array:
    return pa.array([None if r is None else valid_polygon(_rings(r), p) for r, p in zip(rings.to_pylist(), parts.to_pylist())], pa.bool_())


def simple_batch(rings: pa.Array) -> pa.Array:
    return pa.array([None if r is None else simple_lines(_rings(r)) for r in rings.to_pylist()], pa.bool_())
