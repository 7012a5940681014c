"""Steps whose memory or time must not outgrow their input: no unbounded broadcasts, slim rows, work spread by rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import city as C
from geoloom.operators import joins as J
from geoloom.operators import network as N
from geoloom.operators import overlay as O
from geoloom.operators import raster as R
from geoloom.operators import spatial as S
from geoloom.operators.graph import ring_areas
from geoloom.operators.spatial import points_in_polygons
from geoloom.session import cut_lineage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dataset_names_are_never_broadcast(spark):
    d = spark.createDataFrame([("d/a.gpkg", "x"), ("d/a.gpkg", "y"), ("e/a.gpkg", "x"), ("e/b.gpkg", "z")], "path string, layer string")
    w = spark.createDataFrame([("d/a.gpkg::y",), ("e/a.gpkg",), ("f/b.gpkg",), ("f/b.gpkg",), ("none",), (None,)], "name string")
    # written tables have sizes Spark can judge, and these are small enough to be broadcast
    out = J.match_dataset(cut_lineage(w), cut_lineage(d))
    assert "Broadcast" not in plan(out)
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([("d/a.gpkg::y", "d/a.gpkg::y"), ("e/a.gpkg", "e/a.gpkg::x"), ("f/b.gpkg", "e/b.gpkg::z"), ("f/b.gpkg", "e/b.gpkg::z"),
                          ("none", None), (None, None)], key=repr)


def test_solids_are_sorted_without_their_rings(spark):
    s = spark.range(40).select((F.col("id") % 4).alias("building_id"), F.array(F.array(*[
        F.array(F.lit(0.0), F.lit(0.0), F.col("id") * h) for h in (1.0, 2.0)])).alias("rings"), F.when(F.col("id") > 7, "a").otherwise("").alias("OBJEKTART"))
    out = C.solid_heights(s)
    assert sorted((r.building_id, r.measured_height, r.faces, r.objektart) for r in out.collect()) == [(k, 72.0 + k, 10, "a") for k in range(4)]
    sorts = [x.split("\n")[0] for x in plan(C.solid_heights(cut_lineage(s))).split("SortAggregate")[-1:]]
    below = plan(C.solid_heights(cut_lineage(s)))
    last = below[below.rindex("Sort ["):]                  # what is sorted comes from a projection that drops the rings
    assert sorts and "Project [building_id" in last.split("FileScan")[0] and "rings" not in last.split("Project")[0]


def test_burning_does_not_look_cells_up(spark):
    """Every centre as the join of points and polygons has it, corners and edges included; a ring of many edges and a hole."""
    n = 60
    turn = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.array(
        50 + 33 * F.cos(2 * F.pi() * (i % n) / n), 50 + 33 * F.sin(2 * F.pi() * (i % n) / n)))
    one = spark.range(1)
    p = one.select(F.lit(1.0).alias("v"), G.box(5.0, 5.0, 35.0, 25.0).alias("geom")).unionByName(
        one.select(F.lit(-2.0).alias("v"), G.box(-50.0, 85.0, 12.0, 300.0).alias("geom"))).unionByName(
        one.select(F.lit(3.0).alias("v"), G.make_geom("POLYGON", F.array(turn)).alias("geom"))).unionByName(
        one.select(F.lit(4.0).alias("v"), G.make_geom("POLYGON", F.array(G.box_ring(60.0, 60.0, 95.0, 95.0), F.reverse(G.box_ring(70.0, 70.0, 80.0, 80.0)))).alias("geom"))).unionByName(
        one.select(F.lit(None).cast("double").alias("v"), G.box(0.0, 0.0, 100.0, 100.0).alias("geom")))
    grid = R.Grid(0.0, 100.0, 2.0, 2.5, 50, 40)
    cells = R.with_centres(R.grid_cells(spark, grid), grid)
    want = {(r.l_row, r.l_col): r.m for r in points_in_polygons(cells, p, "x", "y").groupBy("l_row", "l_col").agg(F.max("r_v").alias("m")).collect()}
    burnt = R.rasterize(p, "v", grid)
    got = {(r.row, r.col): r.value for r in burnt.collect()}
    assert len(got) == 2000 and all(got[k] == (want.get(k) or 0.0) for k in got)
    assert plan(R.rasterize(p, "v", grid)).count("Range (") == 1               # the grid is neither repeated by level nor joined


def squares(spark, rows, name):
    t = spark.createDataFrame(rows, f"{name} long, x double, y double, s double")
    return t.select(name, G.box("x", "y", F.col("x") + F.col("s"), F.col("y") + F.col("s"), 25832).alias("geom"))


def test_features_that_meet_nothing_are_not_arranged(spark, monkeypatch):
    def no(*_a, **_k):
        raise AssertionError("arranged")
    monkeypatch.setattr(O, "pieces_of", no)
    a = squares(spark, [(1, 0.0, 0.0, 10.0), (1, 30.0, 0.0, 10.0), (2, 10.0, 0.0, 10.0)], "u")
    e, g = O.dissolve_edges(a, "u")
    assert {r.u: r.area for r in ring_areas(e, g).collect()} == {1: 200.0, 2: 100.0}
    b = squares(spark, [(7, 500.0, 0.0, 10.0)], "v")
    got = O.overlay_areas(squares(spark, [(1, 0.0, 0.0, 10.0), (2, 5.0, 0.0, 10.0)], "u"), b, "symmetric_difference", "u", "v")
    assert {(r.u, r.v): r.area for r in got.collect()} == {(1, None): 100.0, (2, None): 100.0, (None, 7): 100.0}


def test_features_apart_and_arranged_together(spark):
    """Rows of one key, neighbours that touch, and one alone; some of them beside the other layer."""
    a = squares(spark, [(1, 0.0, 0.0, 10.0), (1, 5.0, 0.0, 10.0), (2, 100.0, 0.0, 10.0), (3, 200.0, 0.0, 10.0)], "u")
    b = squares(spark, [(7, 205.0, 5.0, 10.0), (8, 300.0, 0.0, 10.0)], "v")
    e, g = O.dissolve_edges(a, "u")
    assert {r.u: r.area for r in ring_areas(e, g).collect()} == {1: 150.0, 2: 100.0, 3: 100.0}
    got = O.overlay_areas(a, b, "union", "u", "v")
    assert {(r.u, r.v): round(r.area, 6) for r in got.collect()} == {
        (1, None): 150.0, (2, None): 100.0, (3, None): 75.0, (3, 7): 25.0, (None, 7): 75.0, (None, 8): 100.0}


def test_vertices_are_never_broadcast(spark):
    v = cut_lineage(spark.range(300).select((F.col("id") % 30 * 10.0).alias("x"), (F.col("id") % 20 * 25.0).alias("y"), F.lit(1.0).alias("z")))
    out = C.dedupe_vertices(v)
    assert "Broadcast" not in plan(out)
    got = sorted((r.x // 100, r.y // 100, r.x, r.y, r.vid) for r in out.collect())
    assert [r[-1] for r in got] == list(range(60))


def test_hulls_go_through_batches_of_groups(spark):
    """No task or frame per group; a large group, a small one, ones without area, a null key and points without position."""
    import math
    ring = [(math.cos(k / 50 * math.pi) * 100, math.sin(k / 50 * math.pi) * 100) for k in range(100)]
    rows = [("a", x * s, y * s) for x, y in ring for s in (1.0, 0.5, 0.25)] + [("b", x, y) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3), (2, 0), (1, 1), (0, 0))]
    rows += [("line", float(k), float(k)) for k in range(90)] + [("one", 1.0, 1.0)] + [(None, x, y) for x, y in ((0, 0), (2, 0), (0, 2))] + [("b", None, 9.0), ("b", float("nan"), 9.0)]
    points = spark.createDataFrame([(k, *(v if v is None else float(v) for v in p)) for k, *p in rows], "k string, x double, y double").repartition(3)
    out = N.hull_reduce(points, ["k"])
    assert "InPandas" not in plan(out)
    got = {r.k: [tuple(v) for v in r.geom.rings[0]] for r in out.collect()}
    assert got["b"] == [(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)] and got[None] == [(0, 0), (2, 0), (0, 2), (0, 0)] and set(got) == {"a", "b", None}
    assert set(got["a"]) == set(ring) and got["a"][0] == got["a"][-1] == min(ring) and len(got["a"]) == 101


def test_validity_of_four_corners_is_plain_arithmetic(spark):
    """Boxes need no comparison edge by edge, and the short cut never says yes where the full test says no."""
    import random
    rng = random.Random(5)
    rows = [[[float(rng.randint(0, 3)), float(rng.randint(0, 3))] for _ in range(4)] for _ in range(3000)]
    rows = [[r + r[:1]] for r in rows] + [[], [[]], [[[0.0, 0.0]] * 5], [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [1.0, 0.0]]]]
    g = G.make_geom("POLYGON", F.col("r"))
    d = cut_lineage(spark.createDataFrame([(r,) for r in rows], "r array<array<array<double>>>"))
    got = d.select(F.coalesce(G._sound_quad(g), F.lit(False)).alias("quick"), G._is_valid_short(g).alias("full"), G.is_valid(g).alias("v")).where(
        "v is not distinct from full").agg(F.count("*").alias("n"), F.count_if(F.col("quick")).alias("quick"), F.count_if(F.col("quick") & ~F.col("full")).alias("wrong")).first()
    assert got.n == len(rows) and got.quick > 300 and got.wrong == 0
    box = G.box(F.col("id") * 3.0, F.lit(5.0), F.col("id") * 3.0 + 2, F.lit(9.5))
    assert spark.range(50).where(G._sound_quad(box)).count() == 50


def test_validity_is_worked_out_after_the_layer_is_dealt(spark, monkeypatch):
    seen, cut = [], cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: seen.append(plan(df)) or cut(df))
    layer = squares(spark, [(1, 0.0, 0.0, 10.0), (2, 5.0, 5.0, 10.0), (3, 40.0, 0.0, 10.0), (4, None, 0.0, 1.0)], "u")
    bad = spark.range(1).select(F.lit(5).cast("long").alias("u"), G.make_geom("POLYGON", F.array(F.array(
        G.vertex(0, 0), G.vertex(9, 9), G.vertex(9, 0), G.vertex(0, 9), G.vertex(0, 0))), 25832).alias("geom"))
    got = S.self_overlaps(cut(layer.unionByName(bad)).repartition(3, "u"), "u")
    assert {tuple(r) for r in got.collect()} == {(1, 2)}
    assert "Exchange" in seen[0] and "- Filter" not in seen[0]


def test_lines_are_sorted_once(spark):
    """The points of a line are put in order once, not again for each of its points."""
    n = 400
    p = F.transform(F.sequence(F.lit(n), F.lit(1), F.lit(-1)), lambda i: F.struct(i.alias("o"), (i - i % 2).cast("double").alias("x"), F.lit(0.0).alias("y")))
    kept = G.line_from_points(p, 25832)
    stored = cut_lineage(spark.range(1).select(p.alias("p")))
    assert plan(stored.select(G.line_from_points(F.col("p")).alias("g"))).count("sort_array(") == 1
    v = spark.range(1).select(kept.alias("g")).first().g.rings[0]
    assert v == [[2.0 * k, 0.0] for k in range(n // 2 + 1)]
    short = F.array(F.struct(F.lit(1).alias("o"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y")))
    assert spark.range(1).select(G.line_from_points(short).alias("g"), G.line_from_points(F.slice(short, 1, 0)).alias("e")).first() == (None, None)
