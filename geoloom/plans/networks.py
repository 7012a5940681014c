"""Network and building-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions.scalars import reach_distance
from geoloom.operators import city as C
from geoloom.operators import network as N
from geoloom.operators.graph import service_area
from geoloom.operators.skew import spread
from geoloom.plans.registry import query
from geoloom.plans.views import street_layer, view

MAX_COST = 340


def _edges(spark, sf):
    s = view(spark, sf, "streets").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("cost").cast("double").alias("cost"))
    return N.undirected(s)


def _origins(spark, sf):
    return view(spark, sf, "supplier").select(F.col("s_suppkey").alias("origin"), F.col("s_suppkey").alias("node"))


_REACH = f"""WITH RECURSIVE e AS (SELECT a AS src, b AS dst, cost FROM streets UNION ALL SELECT b, a, cost FROM streets),
walk AS (SELECT s_suppkey AS origin, s_suppkey AS node, CAST(0 AS BIGINT) AS cost FROM supplier
  UNION SELECT w.origin, e.dst, CAST(w.cost + e.cost AS BIGINT) FROM walk w JOIN e ON e.src = w.node WHERE w.cost + e.cost <= {MAX_COST}),
best AS (SELECT origin, node, CAST(min(cost) AS DOUBLE) AS cost FROM walk GROUP BY origin, node)"""


@query("service_area", f"{_REACH} SELECT origin, node, cost FROM best")
def service_area_query(spark, sf):
    return service_area(_edges(spark, sf), _origins(spark, sf), float(MAX_COST))


@query("destinations_reached", f"""{_REACH}, p AS (SELECT c_custkey AS home, c_custkey AS node, c_mktsegment AS segment FROM customer)
SELECT origin, segment, count(*) AS places FROM best JOIN p ON p.node = best.node GROUP BY origin, segment""")
def destinations_reached(spark, sf):
    reached = service_area(_edges(spark, sf), _origins(spark, sf), float(MAX_COST))
    k = F.col("c_custkey")
    xy = [(k % 100 * 100 + 3.0).alias("x"), (F.floor(k / 100) * 100 + 2.0).alias("y")]
    homes = view(spark, sf, "customer").select(k.alias("home"), F.col("c_mktsegment").alias("segment"), *xy)
    nodes = view(spark, sf, "streets").select(F.explode(F.array("a", "b")).alias("node")).distinct().select(
        "node", (F.col("node") % 100 * 100.0).alias("x"), (F.floor(F.col("node") / 100) * 100.0).alias("y"))
    return N.destinations_reached(reached, homes, "home", nodes, kind="segment", tolerance=50.0)


@query("network_tables", """WITH n AS (SELECT a AS n FROM streets UNION SELECT b FROM streets)
SELECT (SELECT count(*) FROM n) AS nodes, count(*) AS edges, CAST(count(*) * 100 AS DOUBLE) AS total FROM streets""")
def network_tables(spark, sf):
    nodes, edges = N.network_from_lines(street_layer(spark, sf))
    return edges.agg(F.count("*").alias("edges"), F.sum("cost").alias("total")).select(
        nodes.agg(F.count("*")).scalar().alias("nodes"), "edges", "total")


# an edge of the hull runs between two nodes that no node lies to the right of, and none beyond its ends on its line
@query("isochrones", f"""{_REACH}, p AS (SELECT origin, node % 100 * 100 AS x, CAST(floor(node / 100.0) AS BIGINT) * 100 AS y FROM best),
h AS (SELECT a.origin, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON b.origin = a.origin AND (a.x <> b.x OR a.y <> b.y)
 WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.origin = a.origin AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
  OR (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND ((c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0))))
SELECT origin, CAST(sum(x1 * y2 - x2 * y1) AS DOUBLE) / 2 AS area, CAST(count(*) + 1 AS INTEGER) AS vertices FROM h GROUP BY origin HAVING sum(x1 * y2 - x2 * y1) > 0""")
def isochrones(spark, sf):
    reached = service_area(_edges(spark, sf), _origins(spark, sf), float(MAX_COST))
    xy = reached.select("origin", (F.col("node") % 100 * 100.0).alias("x"), (F.floor(F.col("node") / 100) * 100.0).alias("y"))
    return N.isochrone(xy).select("origin", "area", G.num_vertices(F.col("geom")).alias("vertices"))


@query("start_guard", """WITH e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM homes),
d AS (SELECT site_id, greatest(x0 - 3 * x + 1000000, 3 * x - 1000000 - x1, 0) AS dx, greatest(y0 - y, y - y1, 0) AS dy FROM sites, e)
SELECT site_id, round(sqrt(CAST(dx * dx + dy * dy AS DOUBLE)), 4) AS extent_distance, sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) <= 20000 AS accepted FROM d""")
def start_guard(spark, sf):
    o = view(spark, sf, "sites").select("site_id", (F.col("x") * 3 - 1_000_000).alias("x"), "y")
    g = N.start_guard(o, view(spark, sf, "homes"), max_km=20.0)
    return g.select("site_id", F.round("extent_distance", 4).alias("extent_distance"), "accepted")


@query("reach_distance", """SELECT c_custkey, round(CASE c_custkey % 3 WHEN 0 THEN 4.5 WHEN 1 THEN 15 ELSE 50 END * 1000 / 60 * (c_nationkey + 5), 4)::DOUBLE AS metres FROM customer""")
def reach_distance_query(spark, sf):
    k = F.col("c_custkey") % 3
    mode = F.when(k == 0, "walk").when(k == 1, "bike").otherwise("drive")
    return view(spark, sf, "customer").select("c_custkey", F.round(reach_distance(F.col("c_nationkey") + 5, mode), 4).alias("metres"))


# ---------------------------------------------------------------- buildings in 3-D


def surfaces(spark, sf):
    """Five faces per building: ground, two walls, and two roof faces meeting at a ridge."""
    f = spread(view(spark, sf, "footprints"), "bldg_id")
    x0, y0, s, h = F.col("x0").cast("double"), F.col("y0").cast("double"), F.col("side").cast("double"), F.col("height")
    v = lambda x, y, z: F.array(x, y, F.lit(100.0) + z)
    x1, y1, xm, z = x0 + s, y0 + s, x0 + s / 2, F.lit(0.0)
    face = lambda kind, *vs: F.struct(F.lit(kind).alias("surface_type"), F.array(F.array(*vs, vs[0])).alias("rings"))
    faces = F.array(
        face("GroundSurface", v(x0, y0, z), v(x0, y1, z), v(x1, y1, z), v(x1, y0, z)),
        face("WallSurface", v(x0, y0, z), v(x0, y0, h / 2), v(x0, y1, h / 2), v(x0, y1, z)),
        face("WallSurface", v(x1, y0, z), v(x1, y1, z), v(x1, y1, h / 2), v(x1, y0, h / 2)),
        face("RoofSurface", v(x0, y0, h / 2), v(xm, y0, h), v(xm, y1, h), v(x0, y1, h / 2)),
        face("RoofSurface", v(xm, y0, h), v(x1, y0, h / 2), v(x1, y1, h / 2), v(xm, y1, h)))
    return f.select(F.col("bldg_id").alias("building_id"), F.explode(faces).alias("f")).select("building_id", "f.*")


@query("footprint_height", """SELECT bldg_id AS building_id, CASE WHEN bldg_id % 3 = 0 THEN side / 2.0 ELSE round(100.0 + height - 100.0, 2) END AS height, CAST(side * side AS DOUBLE) AS ground FROM footprints""")
def footprint_height(spark, sf):
    f = view(spark, sf, "footprints")
    attrs = f.select(F.col("bldg_id").alias("building_id"), F.when(F.col("bldg_id") % 3 == 0, F.col("side") / 2.0).alias("measured_height"))
    b = C.footprint_height(surfaces(spark, sf), attrs)
    flat = F.transform("ground", lambda r: F.transform(r, lambda p: F.slice(p, 1, 2)))
    return b.select("building_id", "height", G.area(G.make_geom("POLYGON", flat)).alias("ground"))


@query("solid_heights", """SELECT bldg_id AS building_id, round(100.0 + height - 100.0, 2) AS measured_height, 5 AS faces, nullif(street, 'Brand#1') AS objektart FROM footprints""")
def solid_heights(spark, sf):
    f = view(spark, sf, "footprints").select(F.col("bldg_id").alias("building_id"), F.when(F.col("street") != "Brand#1", F.col("street")).otherwise("").alias("OBJEKTART"))
    return C.solid_heights(surfaces(spark, sf).join(f, "building_id")).select("building_id", "measured_height", F.col("faces").cast("int").alias("faces"), "objektart")


@query("building_window", "SELECT bldg_id AS building_id, count(*) * 5 AS faces FROM footprints WHERE x0 <= 506010 AND x0 + side >= 501000 AND y0 <= 5400130 AND y0 + side >= 5400041 GROUP BY bldg_id")
def building_window(spark, sf):
    return C.subset_bbox(surfaces(spark, sf), (501000, 5400041, 506010, 5400130)).groupBy("building_id").agg(F.count("*").alias("faces"))


@query("model_summary", """SELECT CAST(min(x0) AS DOUBLE) AS minx, CAST(min(y0) AS DOUBLE) AS miny, 100.0::DOUBLE AS minz, CAST(max(x0 + side) AS DOUBLE) AS maxx, CAST(max(y0 + side) AS DOUBLE) AS maxy,
 100.0 + max(height) AS maxz, count(*) AS buildings, count(*) * 5 AS faces, count(*) * 25 AS vertices FROM footprints""")
def model_summary(spark, sf):
    return C.model_summary(surfaces(spark, sf))


@query("roof_orientation", """SELECT bldg_id AS building_id, round(degrees(atan2(height / 2, side / 2.0)), 5) AS slope, 270.0::DOUBLE AS azimuth FROM footprints UNION ALL
SELECT bldg_id, round(degrees(atan2(height / 2, side / 2.0)), 5), 90.0 FROM footprints""")
def roof_orientation(spark, sf):
    o = C.face_orientation(surfaces(spark, sf))
    return o.select("building_id", F.round("slope", 5).alias("slope"), F.round("azimuth", 5).alias("azimuth"))


@query("multipolygon_z", """SELECT bldg_id AS building_id, 5 AS parts, 25 AS vertices, round(100.0 + height, 6) AS top FROM footprints""")
def multipolygon_z(spark, sf):
    g = C.faces_to_multipolygon_z(surfaces(spark, sf), srid=25832)
    return g.select("building_id", G.num_parts(F.col("geom")).alias("parts"), G.num_vertices(F.col("geom")).alias("vertices"),
                    F.round(F.array_max(F.transform(G.vertices(F.col("geom")), lambda v: v[2])), 6).alias("top"))


@query("dedupe_vertices", """WITH c AS (SELECT x0 AS x, y0 AS y, height FROM footprints UNION ALL SELECT x0 + side, y0, height FROM footprints
  UNION ALL SELECT x0 + side, y0 + side, height FROM footprints UNION ALL SELECT x0, y0 + side, height FROM footprints),
v AS (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, 100.0::DOUBLE AS z FROM c UNION SELECT x, y, round(100.0 + height / 2, 3) FROM c
  UNION SELECT x0 + side / 2.0, y0, round(100.0 + height, 3) FROM footprints UNION SELECT x0 + side / 2.0, y0 + side, round(100.0 + height, 3) FROM footprints)
SELECT x, y, z, row_number() OVER (ORDER BY floor(x / 100), floor(y / 100), x, y, z) - 1 AS vid FROM v""")
def dedupe_vertices(spark, sf):
    s = surfaces(spark, sf).select(F.explode(F.flatten("rings")).alias("p"))
    return C.dedupe_vertices(s.select(*[F.col("p")[i].alias(c) for i, c in enumerate("xyz")]), cell=100.0)


@query("quantize", """WITH o AS (SELECT min(z) AS oz FROM points) SELECT key, part_key, CAST((x - (SELECT min(x) FROM points)) * 1000 AS BIGINT) AS ix, CAST(round((z - oz) / 0.001) AS BIGINT) AS iz, round(round((z - oz) / 0.001) * 0.001 + oz, 6) AS dz FROM points, o""")
def quantize(spark, sf):
    p = view(spark, sf, "points")
    q = C.dequantize(C.quantize(p))
    return q.select("key", "part_key", "ix", "iz", F.round("dz", 6).alias("dz"))
