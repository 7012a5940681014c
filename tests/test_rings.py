"""Validity by cells against the plain rules on short rings, and its time on a long one."""

from __future__ import annotations

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions.rings import meets_itself, simple_lines, valid_polygon


def test_same_answers_as_the_column_rules(spark):
    rnd = random.Random(4)
    at = lambda: [float(rnd.randrange(7)), float(rnd.randrange(7))]
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    shapes = []
    for n in (3, 4, 5, 6, 8):
        for _ in range(60):
            ring = [at() for _ in range(n)]
            shapes.append(([ring + ring[:1]], [0]))
    for _ in range(150):
        shapes.append(([square(0.0, 0.0, 6.0), square(*at(), float(rnd.randrange(1, 4)))], [0, rnd.choice([0, 1])]))
        shapes.append(([square(*at(), 3.0), square(*at(), 2.0), square(*at(), 1.0)], [0, 0, 1]))
    shapes += [([[[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], [0]), ([square(0.0, 0.0, 6.0)[:-1]], [0]), ([], [])]
    df = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(shapes)], "i int, r array<array<array<double>>>, p array<int>").repartition(8)
    kinds = df.select("i", G._is_valid_short(G.make_geom("POLYGON", F.col("r"), None, F.col("p"))).alias("valid"),
                      G._is_simple_short(G.make_geom("LINE", F.col("r"), None, F.col("p"))).alias("simple")).collect()
    arrays = [[np.array(r) for r in rings] for rings, _ in shapes]
    assert {r["i"]: r["valid"] for r in kinds} == {i: valid_polygon(a, p) for i, (a, (_, p)) in enumerate(zip(arrays, shapes))}
    assert {r["i"]: r["simple"] for r in kinds} == {i: simple_lines(a) for i, a in enumerate(arrays)}


def ring(n):
    rnd = random.Random(1)
    pts = [[math.cos(a) * r, math.sin(a) * r] for a, r in ((2 * math.pi * i / n, 1000 + rnd.random() * 0.01) for i in range(n))]
    return np.array([*pts, pts[0]])


def test_long_rings_in_linear_time(spark):
    took = []
    for n in (25_000, 100_000):
        start = time.process_time()
        assert not meets_itself(ring(n), True)
        took.append(time.process_time() - start)
    assert took[1] < 12 * max(took[0], 0.05)
    bad = ring(100_000)
    bad[[500, 520]] = bad[[520, 500]]
    assert meets_itself(bad, True)
    rows = [(1, [ring(5_000).tolist()]), (2, [np.concatenate([bad[400:700], bad[400:401]]).tolist()]), (3, [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]])]
    df = spark.createDataFrame(rows, "i int, r array<array<array<double>>>").withColumn("g", G.make_geom("POLYGON", F.col("r")))
    assert {r["i"]: r["v"] for r in df.select("i", G.is_valid(F.col("g")).alias("v")).collect()} == {1: True, 2: False, 3: True}
    line = df.withColumn("g", G.make_geom("LINE", F.col("r")))
    assert {r["i"]: r["v"] for r in line.select("i", G.is_simple(F.col("g")).alias("v")).collect()} == {1: True, 2: False, 3: True}
    assert df.agg(F.count_if(~F.coalesce(G.is_valid(F.col("g")), F.lit(True))).alias("n")).first()["n"] == 1
