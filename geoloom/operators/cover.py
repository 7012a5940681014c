"""Quadtree covers of polygons: what a point needs to know of a polygon, cell by cell.

A polygon's plane is cut into cells whose size follows its extent and its number of edges. A cell that no edge touches
lies inside as a whole or is left out. A border cell holds only the edges that touch it, and says on which side its lower left corner
lies; a point in it is on the same side if the way from that corner to it crosses an even number of the cell's own
edges. Cells that still hold many edges are cut again, so what is looked at per point doesn't grow with the polygon.

Edges that pass exactly through the corner of that way are decided as if it lay a little up and, far less, to the right; all
tests read the same signs, so cells agree with the even-odd rule over the whole polygon.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G

EDGES = 24                   # of a cell, aimed at
AGAIN = 3                    # levels that a cell with four times as many is cut down by
DEEPEST = 30                 # levels below the polygon's own, where edges that meet in one point are no longer told apart
SCHEMA = "pid long, lv int, cx long, cy long, side int, edges array<struct<x1 double, y1 double, x2 double, y2 double>>"


def _left(e: np.ndarray, x, y) -> np.ndarray:
    """Whether points lie to the left of edges; on an edge as if a little above it."""
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    o = dx[:, None] * (y - e[:, 1][:, None]) - dy[:, None] * (x - e[:, 0][:, None])
    return (o > 0) | ((o == 0) & ((dx > 0) | ((dx == 0) & (dy < 0)))[:, None])


def _touched(e: np.ndarray, size: float, window: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(edge, cx, cy)`` of all cells of the window that edges pass through."""
    cx0, cx1, cy0, cy1 = window
    lo, hi = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    a = np.clip(np.floor(lo / size).astype(np.int64), cx0, cx1 + 1)
    b = np.clip(np.floor(hi / size).astype(np.int64), cx0 - 1, cx1)
    n = np.maximum(b - a + 1, 0)
    k = np.repeat(np.arange(len(e)), n)
    cx = np.repeat(a, n) + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    dx, dy = e[k, 2] - e[k, 0], e[k, 3] - e[k, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = lambda x: np.where(dx == 0, 0.0, (np.clip(x, lo[k], hi[k]) - e[k, 0]) / dx)
        u, v = at(cx * size), np.where(dx == 0, 1.0, at((cx + 1) * size))
    ya, yb = e[k, 1] + u * dy, e[k, 1] + v * dy
    pad = 1e-9 * size + 4e-16 * np.maximum(np.abs(e[k, 1]), np.abs(e[k, 3]))
    low = np.maximum(np.minimum(ya, yb) - pad, np.minimum(e[k, 1], e[k, 3]))
    high = np.minimum(np.maximum(ya, yb) + pad, np.maximum(e[k, 1], e[k, 3]))
    c = np.clip(np.floor(low / size).astype(np.int64), cy0, cy1 + 1)
    d = np.clip(np.floor(high / size).astype(np.int64), cy0 - 1, cy1)
    m = np.maximum(d - c + 1, 0)
    j = np.repeat(np.arange(len(k)), m)
    return k[j], cx[j], np.repeat(c, m) + np.arange(len(j)) - np.repeat(np.cumsum(m) - m, m)


def _sides(e: np.ndarray, size: float, window: tuple) -> np.ndarray:
    """1 for every cell of the window (by row, then column) whose lower left corner lies inside, by the even-odd rule."""
    cx0, cx1, cy0, cy1 = window
    x = np.arange(cx0, cx1 + 1) * size
    out = np.zeros((cy1 - cy0 + 1, len(x)), np.int64)
    for row, cy in enumerate(range(cy0, cy1 + 1)):
        y = cy * size
        span = e[(e[:, 1] > y) != (e[:, 3] > y)]
        if len(span):
            out[row] = (_left(span, x[None, :], y) != (span[:, 3] > span[:, 1])[:, None]).sum(0) % 2
    return out


def cover_cells(e: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray | None]]:
    """``(level, cx, cy, side, edges)`` of one polygon with edges ``(x1, y1, x2, y2)``; inner cells have no edges."""
    low = np.minimum(e[:, :2], e[:, 2:]).min(0)
    high = np.maximum(e[:, :2], e[:, 2:]).max(0)
    extent = float((high - low).max())
    top = int(np.ceil(np.log2(extent))) if extent > 0 else 0
    first = top - max(0, int(np.ceil(np.log2(max(len(e), 1) / EDGES) / 2)) + 1 if len(e) > EDGES else 0)
    size = 2.0 ** first
    bounds = [int(np.floor(v / size)) for v in (low[0], high[0], low[1], high[1])]
    todo = [(first, tuple(bounds), np.arange(len(e)))]
    while todo:
        lv, window, own = todo.pop()
        size = 2.0 ** lv
        k, cx, cy = _touched(e[own], size, window)
        side = _sides(e, size, window)
        width = window[1] - window[0] + 1
        cell = (cy - window[2]) * width + cx - window[0]
        order = np.argsort(cell, kind="stable")
        cells, starts = np.unique(cell[order], return_index=True)
        border = np.zeros(side.size, bool)
        border[cells] = True
        for c, edges in zip(cells.tolist(), np.split(own[k[order]], starts[1:]) if len(cells) else ()):
            y, x = divmod(c, width)
            x, y = x + window[0], y + window[2]
            if len(edges) > 4 * EDGES and top - lv < DEEPEST:
                n = 1 << AGAIN
                todo.append((lv - AGAIN, (x * n, x * n + n - 1, y * n, y * n + n - 1), edges))
            else:
                yield lv, x, y, int(side[y - window[2], x - window[0]]), e[edges]
        for c in np.flatnonzero(~border & (side.ravel() == 1)).tolist():
            y, x = divmod(c, width)
            yield lv, x + window[0], y + window[2], 1, None


def cover(polygons: DataFrame, pid: str, geom: str = "geom") -> DataFrame:
    """The cells of every polygon as ``(pid, lv, cx, cy, side, edges)``; a cell of level ``lv`` is ``2 ** lv`` wide.

    Other kinds, null and empty geometries have no cells. A polygon is one value, so its edges pass through one task.
    """
    flat = polygons.where(F.col(geom)["kind"] == "POLYGON").select(F.col(pid).alias("pid"), F.filter(
        G.segments(F.col(geom)), lambda s: (s["x1"] != s["x2"]) | (s["y1"] != s["y2"])).alias("s")).where("size(s) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for pid_, s in zip(batch.column("pid").to_pylist(), batch.column("s")):
                v = s.values
                e = np.stack([v.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")], axis=1)
                for cell in cover_cells(e):
                    rows.append((pid_, *cell))
                    held += 1 if cell[-1] is None else 1 + len(cell[-1])
                    if held > 100_000:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)
    return flat.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    pid, lv, cx, cy, side, edges = zip(*rows)
    sizes = [0 if e is None else len(e) for e in edges]
    there = [e for e in edges if e is not None]
    flat = np.concatenate(there) if there else np.empty((0, 4))
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(4)], names=["x1", "y1", "x2", "y2"])
    lists = pa.ListArray.from_arrays(ends, values, mask=pa.array([e is None for e in edges]))
    return pa.RecordBatch.from_arrays([pa.array(pid, pa.int64()), pa.array(lv, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()),
                                       pa.array(side, pa.int32()), lists], names=["pid", "lv", "cx", "cy", "side", "edges"])


def side_in_cell(x: Column, y: Column, corner_x: Column, corner_y: Column, side: Column, edges: Column) -> Column:
    """1 strictly inside, 0 on the boundary, -1 outside, for a point in a cell of a cover."""
    def left(s, px, py):
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        o = dx * (py - s["y1"]) - dy * (px - s["x1"])
        return F.when(o != 0, o > 0).otherwise((dx > 0) | ((dx == 0) & (dy < 0)))
    # the way goes from the point straight to the left, then down along the cell's own edge
    along = F.size(F.filter(edges, lambda s: ((s["y1"] > y) != (s["y2"] > y)) & (left(s, x, y) != left(s, corner_x, y))))
    down = F.size(F.filter(edges, lambda s: ((s["x1"] > corner_x) != (s["x2"] > corner_x)) & (left(s, corner_x, y) != left(s, corner_x, corner_y))))
    return F.when(edges.isNull(), 1).when(F.exists(edges, lambda s: G.on_segment(s, x, y)), 0).when((side + along + down) % 2 == 1, 1).otherwise(-1)
