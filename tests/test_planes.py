"""Overlay, dissolve, topology, rasters, networks and buildings on shapes with known answers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from geoloom.functions import formats as FM
from geoloom.functions import geometry as G
from geoloom.functions import projection as P
from geoloom.operators import city as C
from geoloom.operators import graph as GR
from geoloom.operators import network as N
from geoloom.operators import overlay as O
from geoloom.operators import polygonize as PZ
from geoloom.operators import quality as Q
from geoloom.operators import raster as R
from geoloom.operators import spatial as J


def layer(spark, *wkt, srid=25832, key="id"):
    df = spark.createDataFrame(list(enumerate(wkt)), f"{key} int, wkt string")
    return df.select(key, FM.from_wkt(F.col("wkt"), srid).alias("geom"))


def box(x0, y0, x1, y1):
    return f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"


A = [box(0, 0, 4, 4), "POLYGON ((6 0, 10 0, 10 4, 6 4, 6 0), (7 1, 9 1, 9 3, 7 3, 7 1))"]
B = [box(2, 2, 8, 6), box(20, 20, 21, 21)]


@pytest.mark.parametrize("how,want", [
    ("intersection", {(0, 0): 4.0, (1, 0): 4.0 - 1.0}),
    ("difference", {(0, None): 12.0, (1, None): 12.0 - 3.0}),
    ("identity", {(0, 0): 4.0, (1, 0): 3.0, (0, None): 12.0, (1, None): 9.0}),
    ("union", {(0, 0): 4.0, (1, 0): 3.0, (0, None): 12.0, (1, None): 9.0, (None, 0): 24.0 - 7.0, (None, 1): 1.0}),
    ("symmetric_difference", {(0, None): 12.0, (1, None): 9.0, (None, 0): 17.0, (None, 1): 1.0}),
])
def test_overlay(spark, how, want):
    a, b = layer(spark, *A, key="a"), layer(spark, *B, key="b")
    got = {(r.a, r.b): r for r in O.overlay(a, b, how, "a", "b", cell=4.0).select(
        "a", "b", G.area(F.col("geom")).alias("area"), G.is_valid(F.col("geom")).alias("ok"), "geom").collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: r.area for k, r in got.items()}
    assert all(r.ok for r in got.values())


def test_overlay_of_slanted_shapes_keeps_area(spark):
    a = layer(spark, "POLYGON ((0 0, 10 1, 9 9, 1 8, 0 0))", key="a")
    b = layer(spark, "POLYGON ((5 -2, 12 5, 5 12, -2 5, 5 -2))", key="b")
    total = a.select(G.area(F.col("geom"))).first()[0]
    parts = O.overlay_areas(a, b, "identity", "a", "b", cell=3.0).agg(F.sum("area")).first()[0]
    exact = J.overlap_areas(a, b, "a", "b", cell=3.0).first().area
    inter = O.overlay_areas(a, b, "intersection", "a", "b", cell=3.0).first().area
    assert parts == pytest.approx(total, abs=0.05) and inter == pytest.approx(exact, abs=0.05)


def test_clip(spark):
    a, m = layer(spark, *A), layer(spark, box(3, -1, 8, 2), box(3, 1, 8, 3))
    got = {r.id: r.a for r in O.clip_polygons(a, m, "id", cell=4.0).select("id", G.area(F.col("geom")).alias("a")).collect()}
    # square: 1 x 3 strip; donut: 2 x 3 strip without the 1 x 2 part of its hole
    assert got == {0: pytest.approx(3.0), 1: pytest.approx(4.0)}
    l = layer(spark, "LINESTRING (-2 2, 12 2)", "LINESTRING (20 0, 21 0)")
    pieces = O.clip_lines(l, layer(spark, A[1]), "id", cell=4.0).collect()
    assert sorted((r.x1, r.x2) for r in pieces) == [(6.0, 7.0), (9.0, 10.0)]
    w = O.clip_to_box(a, (3, 1, 8, 3)).select("id", G.area(F.col("geom")).alias("a")).collect()
    assert {r.id: r.a for r in w} == {0: pytest.approx(2.0), 1: pytest.approx(4.0 - 2.0)}


def test_dissolve(spark):
    cover = layer(spark, *[box(x, y, x + 1, y + 1) for x in range(3) for y in range(3) if (x, y) != (1, 1)])
    for clean in (True, False):
        d = O.dissolve(cover, cell=1.0, clean=clean).select(
            G.area(F.col("geom")).alias("a"), G.count_holes(F.col("geom")).alias("h"), G.num_vertices(F.col("geom")).alias("v")).first()
        assert (d.a, d.h, d.v) == (8.0, 1, 10)
        assert [r.area for r in O.coverage_holes(cover, cell=1.0, clean=clean).collect()] == [1.0]
    over = layer(spark, box(0, 0, 2, 2), box(1, 1, 3, 3), box(10, 0, 11, 1)).withColumn("g", F.when(F.col("id") < 2, "x").otherwise("y"))
    got = {r.g: r.a for r in O.dissolve(over, "g", cell=2.0).select("g", G.area(F.col("geom")).alias("a")).collect()}
    assert got == {"x": pytest.approx(7.0), "y": pytest.approx(1.0)}


def test_dissolve_of_corner_contacts(spark):
    """Squares that touch at corners stay apart; holes that touch at a corner stay two holes."""
    apart = O.dissolve(layer(spark, box(0, 0, 1, 1), box(1, 1, 2, 2)), cell=1.0, clean=True)
    assert apart.select(G.num_parts(F.col("geom"))).first()[0] == 2
    ring = layer(spark, *[box(x, y, x + 1, y + 1) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 2))])
    d = O.dissolve(ring, cell=1.0, clean=True).select(G.count_holes(F.col("geom")).alias("h"), G.area(F.col("geom")).alias("a")).first()
    assert (d.h, d.a) == (2, 14.0)


def test_walked_and_doubled_rings_agree(spark):
    """Two shells meeting at a corner, one with two holes meeting at a corner: both ways of stitching give four rings."""
    cells = [(x, y) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 2))] + [(4, 4)]
    e, g = O.dissolve_edges(layer(spark, *[box(x, y, x + 1, y + 1) for x, y in cells]), clean=True)
    rings = lambda k: sorted((r.signed_area, sorted(map(tuple, r.vertices[1:]))) for r in GR.rings_to_table(
        GR.stitch_rings(e, g, walk_edges=k), g).collect())
    assert rings(1000) == rings(0) and [a for a, _ in rings(1000)] == [-1.0, -1.0, 1.0, 16.0]


@pytest.mark.parametrize("extra", [(1.0, 1.0, 5.0, 5.0), (5.0, 5.0, 1.0, 1.0)])
@pytest.mark.parametrize("walk_edges", [1000, 0])
def test_open_boundaries_are_refused(spark, extra, walk_edges):
    """An edge that leads nowhere and one that comes from nowhere, in small groups and in large ones."""
    e = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 0.0, 0.0), (1, *extra)], "g int, x1 double, y1 double, x2 double, y2 double")
    with pytest.raises(Exception, match="boundary is open"):
        GR.stitch_rings(e, ["g"], walk_edges=walk_edges).collect()


def test_topology_verdict(spark):
    good = Q.check_topology(layer(spark, box(0, 0, 1, 1), box(1, 0, 2, 1)), "id", cell=1.0).first()
    assert good.ok and (good.self_overlaps, good.invalid, good.union_holes) == (0, 0, 0)
    bad = Q.check_topology(layer(spark, box(0, 0, 1, 1), box(0.5, 0.5, 1.5, 1.5), box(0, 0, 1, 1), "POLYGON ((5 5, 6 6, 6 5, 5 6, 5 5))",
                                 "LINESTRING (0 0, 1 1, 1 0, 0 1)"), "id", cell=1.0).first()
    assert not bad.ok and (bad.invalid, bad.not_simple, bad.duplicates, bad.self_overlaps) == (1, 1, 1, 2)


def test_dangles(spark):
    net = layer(spark, "LINESTRING (0 0, 10 0)", "LINESTRING (10 0, 20 0)", "LINESTRING (10 0, 10 5)")
    d = N.dangles(net, max_length=6.0).first()
    assert (d.line_count, d.nodes, d.free_ends, d.free_end_lines, d.short_dangles) == (3, 4, 3, 3, 1)
    lone = N.dangles(layer(spark, "LINESTRING (0 0, 1 0)")).first()
    assert (lone.free_ends, lone.free_end_lines, lone.short_dangles) == (2, 1, None)
    snapped = N.dangles(layer(spark, "LINESTRING (0 0, 10 0)", "LINESTRING (10.2 0.1, 20 0)"), tolerance=1.0).first()
    assert (snapped.nodes, snapped.free_ends) == (3, 2)


# ---------------------------------------------------------------- rasters


def grid_of(spark, h, w, fn):
    return spark.range(h * w).select(F.floor(F.col("id") / w).alias("row"), (F.col("id") % w).alias("col")).withColumn(
        "value", fn(F.col("row"), F.col("col")).cast("double"))


def test_water(spark):
    block = lambda r, c: r.between(20, 39) & c.between(20, 39)
    green = grid_of(spark, 60, 60, lambda r, c: F.when(block(r, c), 0.30).otherwise(0.20))
    nir = grid_of(spark, 60, 60, lambda r, c: F.when(block(r, c), 0.10).otherwise(0.40))
    z = R.zip_bands(green, nir).withColumn("i", R.normalized_difference(F.col("a"), F.col("b")))
    mask = z.where(R.threshold_mask(F.col("i"), 0.0) == 1).select("row", "col")
    g = R.Grid(500000.0, 5400060.0, 1.0, 1.0, 60, 60, 25832)
    p = PZ.polygonize(mask, g).select("area", G.area(F.col("geom")).alias("a2"), G.num_vertices(F.col("geom")).alias("v"), G.bbox(F.col("geom")).alias("b")).collect()
    assert len(p) == 1 and p[0].area == 400.0 and p[0].a2 == 400.0 and p[0].v == 5
    assert (p[0].b.xmin, p[0].b.ymin, p[0].b.xmax, p[0].b.ymax) == (500020.0, 5400020.0, 500040.0, 5400040.0)
    with pytest.raises(ValueError, match="shape mismatch"):
        R.zip_bands(green, nir, grids=(g, R.Grid(0, 0, 1, 1, 59, 60)))
    assert spark.range(1).select(R.normalized_difference(F.lit(0.0), F.lit(0.0))).first()[0] == 0.0


def test_regions_against_flood_fill(spark):
    import random
    rnd = random.Random(11)
    cells = {(r, c) for r in range(25) for c in range(25) if rnd.random() < 0.55}
    left, want = set(cells), []
    while left:
        todo, comp = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            comp.add((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        want.append(frozenset(comp))
    df = spark.createDataFrame(sorted(cells), "row bigint, col bigint")
    got: dict = {}
    for r in PZ.mask_regions(df).collect():
        got.setdefault(r.region, set()).add((r.row, r.col))
    assert {frozenset(v) for v in got.values()} == set(want)
    polys = PZ.polygonize(df, R.Grid(0.0, 25.0, 1.0, 1.0, 25, 25)).select("area", G.area(F.col("geom")).alias("a")).collect()
    assert sorted(p.area for p in polys) == sorted(float(len(c)) for c in want) == sorted(p.a for p in polys)


def test_terrain(spark):
    dem = grid_of(spark, 40, 40, lambda r, c: c)
    t = R.terrain(dem)
    inner = t.where("row between 1 and 38 and col between 1 and 38")
    s = inner.agg(F.min("slope"), F.max("slope"), F.min("aspect"), F.max("aspect"), F.count("slope")).first()
    assert (s[0], s[1]) == (pytest.approx(45.0), pytest.approx(45.0)) and (s[2], s[3], s[4]) == (270.0, 270.0, 38 * 38)
    assert t.where("row in (0, 39) or col in (0, 39)").where("slope is not null").count() == 0


def test_building_heights_workflow(spark):
    """Surface minus terrain, greatest value per footprint, then the buildings above 15 m."""
    spec = [("Klein", 20, 20, 20, 20, 8), ("Mittel", 70, 40, 24, 24, 18), ("Hoch", 120, 80, 30, 20, 25)]
    b = spark.createDataFrame([(n, x, y, x + w, y + h, z) for n, x, y, w, h, z in spec], "name string, x0 int, y0 int, x1 int, y1 int, h int").select(
        "name", "h", G.box("x0", "y0", "x1", "y1", 25832).alias("geom"))
    grid = R.Grid(0.0, 140.0, 1.0, 1.0, 180, 140, 25832)
    built = R.rasterize(b, "h", grid, cell=32.0)
    terrain = built.withColumn("value", F.lit(50.0))
    surface = built.withColumn("value", F.col("value") + 50.0)
    heights = R.with_centres(R.raster_calc(surface, terrain, "A - B"), grid)
    z = R.zonal_stats(b, heights, "name", ("max", "count", "majority", "minority", "variety"), cell=32.0)
    assert {r.name: (r._max, r._count) for r in z.collect()} == {"Klein": (8.0, 400), "Mittel": (18.0, 576), "Hoch": (25.0, 600)}
    assert z.where("_max > 15").count() == 2


def test_raster_helpers(spark):
    g = R.Grid(100.0, 200.0, 10.0, 10.0, 10, 10)
    r = grid_of(spark, 10, 10, lambda a, b: a * 10 + b)
    w, wg = R.raster_window(r, g, (120.0, 150.0, 150.0, 180.0))
    assert w.count() == 9 and (wg.x0, wg.y0, wg.width, wg.height) == (120.0, 180.0, 3, 3)
    assert w.where("row = 0 and col = 0").first().value == 22.0
    with pytest.raises(ValueError, match="does not overlap"):
        R.raster_window(r, g, (900, 900, 950, 950))
    same = R.resample(r, 10, 10, 10, 10).join(r.withColumnRenamed("value", "v"), ["row", "col"])
    assert same.where("abs(value - v) > 1e-9").count() == 0
    holes = R.resample(r.withColumn("value", F.when(F.col("row") == 0, -9999.0).otherwise(F.col("value"))), 10, 10, 10, 10, nodata=-9999.0)
    assert holes.where("value < 0 or value is null").count() == 0
    # a warp onto the same grid changes nothing
    wg2 = R.Grid(500000.0, 5400100.0, 10.0, 10.0, 10, 10, 25832)
    for how in ("nearest", "bilinear"):
        out = R.warp(r, wg2, wg2, how).join(r.withColumnRenamed("value", "v"), ["row", "col"])
        assert out.where("abs(value - v) > 1e-6 or value is null").count() == 0


# ---------------------------------------------------------------- projections


def test_projections(spark):
    def one(x, y, a, b):
        r = spark.range(1).select(P.project(F.lit(x), F.lit(y), a, b).alias("p")).first().p
        return r.x, r.y
    assert one(9.0, 49.0, 4326, 25832)[0] == pytest.approx(500000.0, abs=1e-6)
    assert one(12.1016, 49.0134, 4326, 25832) == pytest.approx((726783, 5433581), abs=1.0)
    # published centre of the Swiss grid, and of the European one
    assert one(7.438632495, 46.951082877, 4326, 2056) == pytest.approx((2600000.0, 1200000.0), abs=0.5)
    assert one(10.0, 52.0, 4326, 3035) == pytest.approx((4321000.0, 3210000.0), abs=1e-3)
    for srid, lo, la in ((25832, 11.3, 48.2), (25833, 13.4, 52.5), (2056, 8.55, 47.37), (3035, 16.4, 48.2), (3857, -70.0, -33.0)):
        x, y = one(lo, la, 4326, srid)
        assert one(x, y, srid, 4326) == pytest.approx((lo, la), abs=1e-8)
    with pytest.raises(ValueError, match="unsupported"):
        one(0.0, 0.0, 4326, 31287)
    b = spark.range(1).select(P.reproject_bbox(F.struct(F.lit(12.0).alias("xmin"), F.lit(49.0).alias("ymin"), F.lit(12.2).alias("xmax"), F.lit(49.1).alias("ymax")), 4326, 25832).alias("b")).first().b
    corners = [one(x, y, 4326, 25832) for x in (12.0, 12.2) for y in (49.0, 49.1)]
    assert b.xmin <= min(c[0] for c in corners) and b.ymax >= max(c[1] for c in corners)
    km2 = spark.range(1).select(P.bbox_area_km2(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).first()[0]
    assert km2 == pytest.approx(12308.8, abs=0.2)


# ---------------------------------------------------------------- networks


def test_service_area_against_dijkstra(spark):
    import heapq
    import random
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60), float(rnd.randint(1, 9))) for _ in range(140)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, cost double").where("src <> dst")
    adj: dict = {}
    for a, b, c in edges:
        if a != b:
            adj.setdefault(a, []).append((b, c))
            adj.setdefault(b, []).append((a, c))
    want = {}
    for o in (0, 1, 2):
        dist, heap = {o: 0.0}, [(0.0, o)]
        while heap:
            d, n = heapq.heappop(heap)
            if d > dist[n]:
                continue
            for m, c in adj.get(n, ()):
                if d + c <= 12 and d + c < dist.get(m, 1e9):
                    dist[m] = d + c
                    heapq.heappush(heap, (d + c, m))
        want.update({(o, n): d for n, d in dist.items()})
    origins = spark.createDataFrame([(o, o) for o in (0, 1, 2)], "origin bigint, node bigint")
    got = {(r.origin, r.node): r.cost for r in GR.service_area(N.undirected(df), origins, 12.0).collect()}
    assert got == want


def test_components(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (20, 20), *[(100, i) for i in range(101, 160)]], "src bigint, dst bigint")
    got = {r.node: r.component for r in GR.connected_components(df).collect()}
    assert got[3] == 1 and got[12] == 10 and got[20] == 20 and all(got[i] == 100 for i in range(100, 160))


def test_reach_and_isochrone(spark):
    lines = [f"LINESTRING ({x} {y}, {x + 100} {y})" for x in range(0, 2000, 100) for y in range(0, 2001, 100)]
    lines += [f"LINESTRING ({x} {y}, {x} {y + 100})" for x in range(0, 2001, 100) for y in range(0, 2000, 100)]
    nodes, edges = N.network_from_lines(layer(spark, *lines))
    nodes, edges = nodes.persist(), edges.persist()
    walk = spark.range(1).select(*[F.lit(v).alias(k) for k, v in (("m", 15), ("w", "walk"))])
    from geoloom.functions.scalars import reach_distance
    d = walk.select(reach_distance(F.col("m"), F.col("w"))).first()[0]
    assert d == pytest.approx(1125.0)
    o = spark.createDataFrame([("mid", 1004.0, 998.0), ("far", 1004.0, 60000.0)], "origin string, x double, y double")
    r = N.reach(nodes, edges, o, 400.0, tolerance=60.0)
    assert r.count() == 41 and r.select("enough").distinct().first()[0] is True
    iso = N.isochrone(r).first()
    assert iso.area == pytest.approx(2 * 400.0 ** 2)
    assert [x.accepted for x in N.start_guard(o, nodes).orderBy("y").collect()] == [True, False]


# ---------------------------------------------------------------- buildings


def test_city_tables(spark):
    s = spark.createDataFrame([("b1", "GroundSurface", [[[0.0, 0.0, 100.0], [0.0, 10.0, 100.0], [10.0, 10.0, 100.0], [10.0, 0.0, 100.0], [0.0, 0.0, 100.0]]]),
                               ("b1", "RoofSurface", [[[0.0, 0.0, 110.0], [10.0, 0.0, 110.0], [10.0, 10.0, 120.0], [0.0, 10.0, 120.0], [0.0, 0.0, 110.0]]])],
                              "building_id string, surface_type string, rings array<array<array<double>>>")
    assert C.footprint_height(s).first().height == 20.0
    o = C.face_orientation(s).first()
    assert (o.slope, o.azimuth) == (pytest.approx(45.0), pytest.approx(180.0))
    m = C.faces_to_multipolygon_z(s).first().geom
    assert m.ring_part == [0, 1] and len(m.rings[0][0]) == 3
    v = spark.createDataFrame([(1.00001, 2.0, 3.0), (1.0, 2.0, 3.0), (500.0, 2.0, 3.0), (1.0, 700.0, 3.0)], "x double, y double, z double")
    ids = C.dedupe_vertices(v).orderBy("vid").collect()
    assert [r.vid for r in ids] == [0, 1, 2]
    q = C.dequantize(C.quantize(v)).where("abs(dx - x) > 0.0006").count()
    assert q == 0 and math.isclose(C.model_summary(s).first().maxz, 120.0)


def test_overlay_refuses_what_has_no_answer(spark):
    metric, degrees = layer(spark, box(0, 0, 4, 4), key="a"), layer(spark, box(1, 1, 2, 2), key="b", srid=4326)
    for how in ("intersection", "union"):
        with pytest.raises(ValueError, match="one reference system"):
            O.overlay(metric, degrees, how, "a", "b")
    with pytest.raises(ValueError, match="one reference system"):
        O.clip_polygons(metric, degrees, "a")
    with pytest.raises(ValueError, match="no region"):
        O.overlay_areas(metric, layer(spark, box(9, 9, 10, 10), key="b"), "intersection", "a", "b")


def test_small_shapes_in_degrees(spark):
    """Buildings of about nine metres, next to each other and overlapping, in degrees."""
    s = 8e-5
    shapes = layer(spark, box(10, 50, 10 + s, 50 + s), box(10 + s / 2, 50, 10 + 1.5 * s, 50 + s), box(11, 50, 11 + s, 50 + s), srid=4326)
    d = O.dissolve(shapes).select(G.area(F.col("geom")).alias("a")).first().a
    assert math.isclose(d, 2.5 * s * s, rel_tol=1e-3)
    cut = O.overlay_areas(shapes.withColumnRenamed("id", "a"), layer(spark, box(10, 50, 10 + s / 4, 50 + s), key="b", srid=4326), "intersection", "a", "b")
    assert [(r.a, round(r.area / (s * s), 3)) for r in cut.collect()] == [(0, 0.25)]


def test_clip_lines_and_polygons_to_slanted_mask(spark):
    mask = layer(spark, "POLYGON ((0 0, 10 0, 0 10, 0 0))", key="m")
    poly = layer(spark, box(1, 1, 9, 9), key="a")
    assert math.isclose(O.clip_polygons(poly, mask, "a", cell=5.0).select(G.area(F.col("geom")).alias("s")).first().s, 32.0, rel_tol=1e-6)
    line = layer(spark, "LINESTRING (1 1, 9 1, 9 9)", key="a")
    got = O.clip_lines(line, mask, "a", cell=5.0).select(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("n")).agg(F.sum("n")).first()[0]
    assert math.isclose(got, 8.0, rel_tol=1e-6)


def test_zonal_variance_of_large_values(spark):
    zones = layer(spark, box(0, 0, 10, 10), key="z")
    cells = spark.createDataFrame([(1.5, 1.5, 1e8 + 0.05), (2.5, 2.5, 1e8 - 0.05)], "x double, y double, value double")
    r = R.zonal_stats(zones, cells, "z", ("count", "variance", "stdev")).first()
    assert r["_count"] == 2 and math.isclose(r["_variance"], 0.0025, rel_tol=1e-4) and math.isclose(r["_stdev"], 0.05, rel_tol=1e-4)
