"""Measures, predicates and validity on small shapes with known answers."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from geoloom.functions import formats as FM
from geoloom.functions import geometry as G
from geoloom.operators import spatial as J


def layer(spark, *wkt, srid=25832):
    df = spark.createDataFrame(list(enumerate(wkt)), "id int, wkt string")
    return df.select("id", FM.from_wkt(F.col("wkt"), srid).alias("geom"))


SQUARE = "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"
DONUT = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
BOWTIE = "POLYGON ((0 0, 1 1, 1 0, 0 1, 0 0))"


def col(df, expr):
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


def test_measures(spark):
    d = layer(spark, SQUARE, DONUT, "LINESTRING (0 0, 3 4)", "POINT (1 2)",
              "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0), (0.5 0.5, 1 0.5, 1 1, 0.5 1, 0.5 0.5)), ((5 5, 6 5, 6 6, 5 6, 5 5)))")
    g = F.col("geom")
    assert col(d, G.area(g)) == [1.0, 96.0, 0.0, 0.0, 4.75]
    assert col(d, G.length(g)) == [4.0, 48.0, 5.0, 0.0, 14.0]
    assert col(d, G.count_holes(g)) == [0, 1, 0, 0, 1]
    assert col(d, G.num_parts(g)) == [1, 1, 1, 1, 2]
    c = d.orderBy("id").select(G.centroid(g).alias("c")).collect()
    assert [v for r in c[:4] for v in r[0]] == pytest.approx([0.5, 0.5, 5.0, 5.0, 1.5, 2.0, 1.0, 2.0])
    # translation leaves the area alone
    far = d.withColumn("geom", g.withField("rings", F.transform(g["rings"], lambda r: F.transform(
        r, lambda v: F.array(v[0] + 512345.0, v[1] + 5412345.0)))))
    assert col(far, G.area(g)) == pytest.approx([1.0, 96.0, 0.0, 0.0, 4.75])


def test_validity(spark):
    d = layer(spark, SQUARE, BOWTIE, DONUT, "POLYGON ((0 0, 1 0, 1 1, 0 0))", "POLYGON ((0 0, 2 0, 2 2, 0 2))",
              "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (5 5, 6 5, 6 6, 5 6, 5 5))", "POLYGON ((0 0, 4 0, 2 0, 2 2, 0 0))")
    assert col(d, G.is_valid(F.col("geom"))) == [True, False, True, True, False, False, False]
    l = layer(spark, "LINESTRING (0 0, 1 1, 1 0, 0 1)", "LINESTRING (0 0, 1 0, 1 1)", "LINESTRING (0 0, 1 0, 1 1, 0 0)",
              "LINESTRING (0 0, 2 0, 1 0)")
    assert col(l, G.is_simple(F.col("geom"))) == [False, True, True, False]


def test_empty_and_null(spark):
    d = layer(spark, "POLYGON EMPTY", SQUARE, None)
    assert col(d, G.is_empty(F.col("geom"))) == [True, False, False]
    assert col(d, F.col("geom").isNull()) == [False, False, True]


def test_parts_and_buffer(spark):
    d = layer(spark, "MULTIPOINT ((1 1), (2 2), (3 3))")
    from geoloom.operators.measures import explode_parts
    assert explode_parts(d).count() == 3
    b = spark.range(1).select(G.buffer_point(F.lit(0.0), F.lit(0.0), 10.0).alias("geom"))
    r = b.select(G.area(F.col("geom")).alias("a"), G.num_vertices(F.col("geom")).alias("n")).first()
    assert r.n == 21 and r.a == pytest.approx(10 * 100 * math.sin(math.pi / 10))


CASES = {
    "square": "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))",
    "inner": "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))",
    "shifted": "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))",
    "beside": "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))",
    "corner": "POLYGON ((4 4, 8 4, 8 8, 4 8, 4 4))",
    "far": "POLYGON ((20 20, 21 20, 21 21, 20 21, 20 20))",
    "same": "POLYGON ((4 4, 0 4, 0 0, 4 0, 4 4))",
    "through": "LINESTRING (-1 2, 5 2)",
    "inside_line": "LINESTRING (1 1, 3 3)",
    "edge_line": "LINESTRING (0 0, 4 0)",
    "outside_line": "LINESTRING (4 2, 9 2)",
    "pt_in": "POINT (2 2)", "pt_edge": "POINT (4 2)", "pt_out": "POINT (9 9)",
}
# relation of the square to the other shape
EXPECT = {
    "inner": {"intersects", "contains"}, "shifted": {"intersects", "overlaps"}, "beside": {"intersects", "touches"},
    "corner": {"intersects", "touches"}, "far": set(), "same": {"intersects", "contains", "within", "equals"},
    "through": {"intersects", "crosses"}, "inside_line": {"intersects", "contains"}, "edge_line": {"intersects", "touches"},
    "outside_line": {"intersects", "touches"}, "pt_in": {"intersects", "contains"}, "pt_edge": {"intersects", "touches"}, "pt_out": set(),
}


def test_predicates(spark):
    a = layer(spark, CASES["square"])
    names = [k for k in CASES if k != "square"]
    b = layer(spark, *[CASES[n] for n in names]).withColumnRenamed("id", "other")
    preds = ("intersects", "contains", "equals", "touches", "overlaps", "within", "crosses")
    got: dict[str, set] = {n: set() for n in names}
    for r in J.relate(a, b, preds, cell=3.0).select("r_other", "predicate").collect():
        got[names[r[0]]].add(r[1])
    assert got == EXPECT
    # the mirrored relations
    back = {"contains": "within", "within": "contains"}
    rev: dict[str, set] = {n: set() for n in names}
    for r in J.relate(b, a, preds, cell=3.0).select("l_other", "predicate").collect():
        rev[names[r[0]]].add(back.get(r[1], r[1]))
    assert rev == EXPECT


def test_line_relations(spark):
    a = layer(spark, "LINESTRING (0 0, 4 0)")
    b = layer(spark, "LINESTRING (2 -1, 2 1)", "LINESTRING (4 0, 6 0)", "LINESTRING (2 0, 6 0)", "LINESTRING (1 0, 2 0)", "POINT (2 0)",
              "POINT (4 0)").withColumnRenamed("id", "o")
    got = {}
    for r in J.relate(a, b, ("crosses", "touches", "overlaps", "contains"), cell=5.0).select("r_o", "predicate").collect():
        got.setdefault(r[0], set()).add(r[1])
    assert got == {0: {"crosses"}, 1: {"touches"}, 2: {"overlaps"}, 3: {"contains"}, 4: {"contains"}, 5: {"touches"}}


def test_overlap_area_matches_clipping(spark):
    tri = "POLYGON ((0 0, 4 0, 2 3, 0 0))"
    box = "POLYGON ((1 1, 5 1, 5 2, 1 2, 1 1))"
    d = layer(spark, tri, DONUT).crossJoin(layer(spark, box, "POLYGON ((3 3, 7 3, 7 7, 3 7, 3 3))").toDF("i2", "g2"))
    got = {(r[0], r[1]): r[2] for r in d.select("id", "i2", G.overlap_area(F.col("geom"), F.col("g2"))).collect()}
    # triangle between y 1 and 2 right of x 1: the left flank is at x = 2y/3, the right one at 4 - 2y/3
    assert got[(0, 0)] == pytest.approx(sum(4 - 2 * y / 3 - max(1, 2 * y / 3) for y in [1 + (i + .5) / 1e4 for i in range(10000)]) / 1e4, abs=1e-6)
    assert got[(1, 1)] == pytest.approx(16 - 4) and got[(1, 0)] == pytest.approx(4.0)


def test_formats(spark):
    texts = [SQUARE, DONUT, "LINESTRING (0 0, 3 4)", "POINT (1.5 2)", "MULTIPOINT ((1 1), (2 2))",
             "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0), (0.5 0.2, 1 0.2, 1 0.4, 0.5 0.2)), ((5 5, 6 5, 6 6, 5 5)))"]
    d = layer(spark, *texts)
    assert col(d, FM.to_wkt(F.col("geom"))) == texts
    assert all(col(d, FM.from_wkb(FM.to_wkb(F.col("geom")), 25832) == F.col("geom")))
    j = d.withColumn("j", FM.to_geojson(F.col("geom")))
    back = FM.from_geojson(F.get_json_object("j", "$.type"), F.get_json_object("j", "$.coordinates"), 25832)
    assert all(col(j, back == F.col("geom")))


def test_cell_join_equals_brute_force(spark):
    """Sizes from points to half the plane, many levels: the cell join must give what comparing all pairs gives."""
    import random
    rnd = random.Random(7)
    boxes = []
    for i in range(60):
        s = 2.0 ** rnd.randint(-2, 7)
        x, y = rnd.randint(-100, 100), rnd.randint(-100, 100)
        boxes.append((i, float(x), float(y), x + s, y + s * rnd.choice([0.25, 1, 3])))
    df = spark.createDataFrame(boxes, "id int, a double, b double, c double, d double")
    l = df.select("id", G.box("a", "b", "c", "d", 1).alias("geom"))
    for cell in (1.0, 30.0, 1000.0):
        got = sorted((r[0], r[1]) for r in J.predicate_pairs(l, l, "intersects", cell, kinds=(("POLYGON",),) * 2).select("l_id", "r_id").collect())
        want = sorted((p[0], q[0]) for p, q in itertools.product(boxes, boxes) if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
        assert got == want


def test_salting_changes_nothing(spark):
    from geoloom.operators.cells import pair_points
    from geoloom.operators.skew import salted_join
    pts = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("y"))
    polys = layer(spark, "POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0))", "POLYGON ((0 0, 8 0, 8 3, 0 3, 0 0))").withColumnRenamed("id", "p")
    a = pair_points(pts, polys, "x", "y", G.bbox(F.col("geom")), 10.0)
    b = pair_points(pts, polys, "x", "y", G.bbox(F.col("geom")), 10.0, rows_per_salt=20)
    key = lambda d: sorted((r[0], r[1]) for r in d.select("l_id", "r_p").collect())
    assert key(a) == key(b) and len(key(a)) > 500
    left = spark.range(300).select("id", F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 5).alias("k"))
    right = spark.range(6).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v")).where("k <> 4")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, "k", how).collect()))
        got = sorted(map(str, salted_join(left, right, ["k"], ["id"], how, rows_per_salt=30).select(left.join(right, "k", how).columns).collect()))
        assert got == want, how
