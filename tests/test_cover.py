"""Quadtree covers against the even-odd rule over whole polygons."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import spatial as J


def star(rnd, n, cx, cy, r, lattice, least=0.3):
    pts = []
    for i in range(n):
        a, d = 2 * math.pi * i / n, r * (least + (1 - least) * rnd.random())
        x, y = cx + d * math.cos(a), cy + d * math.sin(a)
        pts.append([float(round(x)), float(round(y))] if lattice else [x, y])
    return [*pts, pts[0]]


def square(x, y, s):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


@pytest.fixture(scope="module")
def shapes():
    rnd = random.Random(2)
    out = [[star(rnd, n, rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.uniform(5, 60), lattice)] for n in (3, 5, 30, 300) for lattice in (True, False) for _ in range(3)]
    out += [[square(0.0, 0.0, 64.0), square(16.0, 16.0, 32.0)], [square(-8.0, -8.0, 16.0)], [square(0.0, 0.0, 1.0)], [square(1e-6, 1e-6, 3e-5)],
            [[[0.0, 0.0], [40.0, 40.0], [40.0, 0.0], [0.0, 40.0], [0.0, 0.0]]], [[[5.0, 5.0], [5.0, 5.0], [5.0, 5.0], [5.0, 5.0]]]]
    # many edges through one corner of a cell, and a comb of teeth thinner than any cell
    out.append([[p for k in range(150) for p in ([0.0, 0.0], [math.cos(k / 24) * 30, math.sin(k / 24) * 30])] + [[0.0, 0.0]]])
    out.append([[p for k in range(400) for p in ([k * 0.1, 0.0], [k * 0.1 + 0.05, 40.0])] + [[40.0, 0.0], [40.0, -1.0], [0.0, -1.0], [0.0, 0.0]]])
    return out


def test_cover_equals_whole_polygons(spark, shapes):
    rnd = random.Random(3)
    pts = [(float(x), float(y)) for x in range(-72, 73, 8) for y in range(-72, 73, 8)]
    pts += [(rnd.uniform(-80, 80), rnd.uniform(-80, 80)) for _ in range(400)] + [(rnd.uniform(0, 4e-5), rnd.uniform(0, 4e-5)) for _ in range(50)]
    corners = [tuple(p) for rings in shapes for r in rings for p in r]
    exact = [c for c in corners if all(float(v).is_integer() for v in c)]           # halfway points of others are off their edge by rounding
    pts += rnd.sample(corners, 200) + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(exact[:200], exact[1:201])]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, x double, y double")
    polys = spark.createDataFrame([(i, r) for i, r in enumerate(shapes)], "k int, rings array<array<array<double>>>").select(
        "k", G.make_geom("POLYGON", F.col("rings")).alias("geom"))
    got = {(r["l_id"], r["r_k"]) for r in J.points_in_polygons(points, polys).select("l_id", "r_k").collect()}
    strict = {(r["l_id"], r["r_k"]) for r in J.points_in_polygons(points, polys, boundary=False).select("l_id", "r_k").collect()}
    every = points.crossJoin(F.broadcast(polys.select("k", G.segments(F.col("geom")).alias("s")))).select(
        "id", "k", G.locate(F.filter("s", lambda s: (s["x1"] != s["x2"]) | (s["y1"] != s["y2"])), F.col("x"), F.col("y")).alias("at")).where("at >= 0").collect()
    assert got == {(r["id"], r["k"]) for r in every}
    assert strict == {(r["id"], r["k"]) for r in every if r["at"] == 1}


def test_cells_stay_small(shapes):
    import numpy as np
    from geoloom.operators.cover import EDGES, cover_cells
    ring = np.array(star(random.Random(1), 100_000, 0.0, 0.0, 1_000.0, False, 0.99))
    cells = list(cover_cells(np.concatenate([ring[:-1], ring[1:]], axis=1)))
    assert max(len(e) for *_, e in cells if e is not None) <= 4 * EDGES and len(cells) < 200_000


def test_nothing_and_odd_shapes(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "id long, x double, y double")
    none = spark.createDataFrame([(1, None)], "k int, rings array<array<array<double>>>").select(
        "k", F.when(F.col("rings").isNotNull(), G.make_geom("POLYGON", F.col("rings"))).alias("geom"))
    assert J.points_in_polygons(points, none).count() == 0
    assert J.points_in_polygons(points.where("false"), none).count() == 0


def test_nearest_in_growing_rings(spark):
    rnd = random.Random(8)
    right = [(i, rnd.uniform(0, 10), rnd.uniform(0, 10)) for i in range(200)] + [(500, 300.0, 0.0), (501, 300.0, 0.0), (502, None, 1.0)]
    left = [(i, rnd.uniform(-5, 15), rnd.uniform(-5, 15)) for i in range(300)] + [(900, 290.0, 0.0), (901, 5_000.0, 0.0), (None, 1.0, 1.0), (902, None, None)]
    schema = "k int, x double, y double"
    got = {r["k"]: (r["j"], r["dist"]) for r in J.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumnRenamed("k", "j"), 500.0, "k", "j").collect()}
    want = {}
    for k, x, y in left:
        near = [(math.hypot(x - a, y - b), j) for j, a, b in right if x is not None and a is not None]
        if near and min(near)[0] <= 500.0:
            want[k] = min(near)[::-1]
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert J.nearest(spark.createDataFrame(left, schema), spark.createDataFrame([], "j int, x double, y double"), 5.0, "k", "j").count() == 0
