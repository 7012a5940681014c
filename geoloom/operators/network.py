"""Line networks: graph tables, free ends, reach and what lies within it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators.graph import service_area
from geoloom.operators.spatial import nearest

SNAP_TOLERANCE = 500.0     # metres between a point and the network node it stands for
MAX_START_KM = 50.0        # an origin farther than this from the network is taken for swapped coordinates


def snap(x: Column, y: Column, tolerance: float = 0.0) -> Column:
    """Node key of a line end: rounded to the tolerance, or to six decimals."""
    if tolerance > 0:
        return F.struct((F.bround(x / tolerance) * tolerance).alias("x"), (F.bround(y / tolerance) * tolerance).alias("y"))
    return F.struct(F.bround(x, 6).alias("x"), F.bround(y, 6).alias("y"))


def _paths(lines: DataFrame, geom: str) -> DataFrame:
    g = F.col(geom)
    return lines.where(g["kind"] == "LINE").select(F.explode(g["rings"]).alias("path")).where(F.size("path") >= 2)


def dangles(lines: DataFrame, tolerance: float = 0.0, max_length: float | None = None, geom: str = "geom") -> DataFrame:
    """One row: lines, nodes, free ends, lines with a free end, and those of them no longer than ``max_length``.

    A line's two ends and their degrees meet through two equi-joins on the node key; a hub node is one row of degrees.
    """
    p = _paths(lines, geom)
    length = F.aggregate(G._pairs(F.col("path")), F.lit(0.0), lambda a, s: a + G.seg_length(s))
    first, last = F.col("path")[0], F.element_at("path", -1)
    t = p.select(snap(first[0], first[1], tolerance).alias("a"), snap(last[0], last[1], tolerance).alias("b"),
                 length.alias("len"))
    # per line end: the end's degree comes from counting ends per node; only nodes of degree 1 matter further on,
    # and those have exactly one line end, so a node's lone end can carry its line's data along
    ends = t.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("o"), "len", F.lit(0).alias("k")),
                                      F.struct(F.col("b").alias("n"), F.col("a").alias("o"), "len", F.lit(1).alias("k")))).alias("e")).select("e.*")
    nodes = ends.groupBy("n").agg(F.count("*").alias("deg"), F.first("o").alias("o"), F.first("len").alias("len"))
    free = nodes.where("deg = 1").select("n", "o", "len")
    # a line free at both ends appears twice: count it from its lesser end only
    other = free.select(F.col("n").alias("o"), F.lit(True).alias("both"))
    lines_free = free.join(other, "o", "left").where(F.coalesce(F.col("both"), F.lit(False)) == F.lit(False)).unionByName(
        free.join(other, "o").where(F.col("n") < F.col("o")), allowMissingColumns=True)
    s1 = t.agg(F.count("*").alias("line_count"))
    s2 = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("deg") == 1).alias("free_ends"))
    short = F.count_if(F.col("len") <= max_length) if max_length is not None else F.lit(None).cast("long")
    s3 = lines_free.agg(F.count("*").alias("free_end_lines"), short.alias("short_dangles"))
    one = lambda d, c: d.select(c).scalar().alias(c)
    return s1.select("line_count", one(s2, "nodes"), one(s2, "free_ends"), one(s3, "free_end_lines"), one(s3, "short_dangles"))


def network_from_lines(lines: DataFrame, tolerance: float = 0.0, geom: str = "geom",
                       cost: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``nodes(node, x, y)`` and ``edges(src, dst, cost)`` of a line layer: one undirected edge per segment.

    Node ids are hashes of the snapped position, so no numbering pass is needed.
    """
    seg = lines.where(F.col(geom)["kind"] == "LINE").select(F.explode(G.segments(F.col(geom))).alias("s"))
    a, b = snap(F.col("s.x1"), F.col("s.y1"), tolerance), snap(F.col("s.x2"), F.col("s.y2"), tolerance)
    t = seg.select(a.alias("a"), b.alias("b"), (cost if cost is not None else G.seg_length(F.col("s"))).alias("cost"))
    ident = lambda c: F.xxhash64(f"{c}.x", f"{c}.y")
    edges = t.select(ident("a").alias("src"), ident("b").alias("dst"), "cost").where("src <> dst")
    edges = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("cost").alias("cost"))
    nodes = t.select(F.explode(F.array("a", "b")).alias("p")).distinct().select(
        F.xxhash64("p.x", "p.y").alias("node"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return nodes, edges


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    rest = [c for c in edges.columns if c not in (src, dst)]
    return edges.select(src, dst, *rest).unionByName(edges.select(F.col(dst).alias(src), F.col(src).alias(dst), *rest))


def start_guard(origins: DataFrame, nodes: DataFrame, x: str = "x", y: str = "y", max_km: float = MAX_START_KM) -> DataFrame:
    """Origins with their distance to the network's extent and whether they are accepted."""
    e = nodes.agg(F.struct(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))).scalar()
    out = lambda v, lo, hi: F.greatest(lo - v, v - hi, F.lit(0.0))
    d = F.hypot(out(F.col(x), e["x0"], e["x1"]), out(F.col(y), e["y0"], e["y1"]))
    return origins.withColumn("extent_distance", d).withColumn("accepted", d <= max_km * 1000.0)


def reach(lines_nodes: DataFrame, edges: DataFrame, origins: DataFrame, max_cost: float, origin: str = "origin",
          tolerance: float = SNAP_TOLERANCE, min_nodes: int = 3) -> DataFrame:
    """Reached nodes with cost and position for point origins ``(origin, x, y)``; origins are snapped to their nearest
    node. An origin reaching fewer than ``min_nodes`` nodes comes out with ``enough = false``."""
    at = nearest(origins, lines_nodes, tolerance, origin, "node").select(origin, "node")
    got = service_area(undirected(edges), at, max_cost, origin=origin).join(lines_nodes, "node")
    n = got.groupBy(origin).agg(F.count("*").alias("_n"))
    return got.join(n, origin).withColumn("enough", F.col("_n") >= min_nodes).drop("_n")


def _hull(points) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the least point; fewer than three where the points span no area."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(q):
        out: list = []
        for v in q:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (v[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (v[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(v)
        return out
    return half(p)[:-1] + half(p[::-1])[:-1]


SLICE_POINTS = 64            # a group with more points than that in one batch goes on with its corners there only


def _corners(keys: list[pa.Array], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of a batch that may be corners of their group's hull; groups of few points keep all of them."""
    code = np.zeros(len(x), np.int64)
    for k in keys:
        code = np.unique(code * (len(x) + 1) + k.dictionary_encode("encode").indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(code[order])) + 1, len(order))
    sizes = np.diff(ends, prepend=0)
    kept = [order[np.repeat(sizes <= SLICE_POINTS, sizes)]]
    for e, n in zip(ends[sizes > SLICE_POINTS].tolist(), sizes[sizes > SLICE_POINTS].tolist()):
        rows = order[e - n:e]
        row_of = dict(zip(zip(x[rows].tolist(), y[rows].tolist()), rows.tolist()))
        kept.append(np.array([row_of[v] for v in _hull(row_of)], np.int64))
    return np.concatenate(kept)


def hull_reduce(points: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Convex hull per group as ``geom``, its vertices counter-clockwise; rows without a position take no part.

    Two levels: batches of points keep only what may be a corner, then the hull of those, so a group of any size sends
    only corner points to its last task. Both go through whole batches of groups, as most groups are small.
    """
    slim = points.select(*by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).where(
        F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))

    def reduced(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.take(pa.array(_corners([batch.column(c) for c in by], batch.column(x).to_numpy(), batch.column(y).to_numpy())))

    def last(batches):
        for batch in batches:
            p = batch.column("_p")
            xy, ends = p.flatten(), np.cumsum(p.value_lengths().to_numpy()).tolist()
            v = list(zip(xy.field(0).to_pylist(), xy.field(1).to_pylist()))
            rings = [[*h, h[0]] if len(h := _hull(v[a:e])) > 2 else None for a, e in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(rings, pa.list_(pa.list_(pa.float64())))], names=[*by, "ring"])

    types = dict(slim.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in by)
    got = slim.mapInArrow(reduced, slim.schema).groupBy(*by).agg(F.collect_list(F.struct(x, y)).alias("_p")).mapInArrow(
        last, schema + "ring array<array<double>>")
    return got.where("ring is not null").select(*by, G.make_geom("POLYGON", F.array("ring")).alias("geom"))


def isochrone(reached: DataFrame, origin: str = "origin") -> DataFrame:
    """Hull polygon and its area per origin over the reached nodes."""
    return hull_reduce(reached, [origin]).withColumn("area", G.area(F.col("geom")))


def destinations_reached(reached: DataFrame, places: DataFrame, place_key: str, nodes: DataFrame, origin: str = "origin",
                         kind: str | None = None, tolerance: float = SNAP_TOLERANCE) -> DataFrame:
    """Places per origin (and per ``kind``) whose nearest node is reached."""
    from geoloom.operators.skew import salted_join
    at = nearest(places, nodes, tolerance, place_key, "node").select(place_key, "node")
    keyed = places.select(place_key, *([kind] if kind else [])).join(at, place_key)
    per_node = keyed.groupBy("node", *([kind] if kind else [])).agg(F.count("*").alias("k"))
    hit = salted_join(reached.select(origin, "node"), per_node, ["node"], [origin])
    return hit.groupBy(origin, *([kind] if kind else [])).agg(F.sum("k").alias("places"))
