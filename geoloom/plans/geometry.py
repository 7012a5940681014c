"""Geometry, filter and spatial-join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import tiles
from geoloom.operators import filters as S
from geoloom.operators import measures as M
from geoloom.operators import network as N
from geoloom.operators import overlay as O
from geoloom.operators import spatial as J
from geoloom.operators.skew import spread
from geoloom.plans.registry import query
from geoloom.plans.views import (SRID, ZONE_INSIDE, ZONE_MEETS, footprint_layer, home_layer, site_layer, street_layer,
                                 view, zone_layer)

ZONE_AREA = "CASE z.variant WHEN 0 THEN 16000000.0 ELSE 12000000.0 END"


@query("bbox", "SELECT zone_id, CAST(x0 AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin, x0 + 4000.0 AS xmax, y0 + 4000.0 AS ymax FROM zones")
def bbox(spark, sf):
    b = G.with_bbox(zone_layer(spark, sf))
    return b.select("zone_id", "xmin", "ymin", "xmax", "ymax")


@query("layer_bounds", """SELECT CAST(min(x0) AS DOUBLE) AS xmin, CAST(min(y0) AS DOUBLE) AS ymin,
  CAST(max(x0 + side) AS DOUBLE) AS xmax, CAST(max(y0 + side) AS DOUBLE) AS ymax FROM footprints""")
def layer_bounds(spark, sf):
    b = G.with_bbox(footprint_layer(spark, sf))
    return b.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


@query("area", f"SELECT zone_id, {ZONE_AREA} + 0.0::DOUBLE AS area FROM zones z")
def area(spark, sf):
    return zone_layer(spark, sf).select("zone_id", G.area(F.col("geom")).alias("area"))


@query("perimeter", "SELECT zone_id, CAST(CASE variant WHEN 2 THEN 24000 ELSE 16000 END AS DOUBLE) AS perimeter FROM zones")
def perimeter(spark, sf):
    return zone_layer(spark, sf).select("zone_id", G.length(F.col("geom")).alias("perimeter"))


@query("centroid", """SELECT zone_id, round(x0 + CASE variant WHEN 1 THEN 10000.0 / 6 ELSE 2000 END, 4) AS cx,
  round(y0 + CASE variant WHEN 1 THEN 10000.0 / 6 ELSE 2000 END, 4) AS cy FROM zones""")
def centroid(spark, sf):
    c = zone_layer(spark, sf).withColumn("c", G.centroid(F.col("geom")))
    return c.select("zone_id", F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"))


@query("holes", "SELECT zone_id, CASE variant WHEN 2 THEN 1 ELSE 0 END AS holes FROM zones")
def holes(spark, sf):
    return zone_layer(spark, sf).select("zone_id", G.count_holes(F.col("geom")).alias("holes"))


@query("null_and_empty", """SELECT count(*) FILTER (WHERE p_size % 7 = 0) AS nulls, count(*) FILTER (WHERE p_size % 7 = 1) AS empties,
  count(*) FILTER (WHERE p_size % 7 > 1) AS filled FROM part""")
def null_and_empty(spark, sf):
    f = footprint_layer(spark, sf)
    none = F.array().cast("array<array<array<double>>>")
    g = F.when(F.col("side") % 7 == 1, G.make_geom("POLYGON", none, SRID)).when(F.col("side") % 7 > 1, F.col("geom"))
    t = f.select(g.alias("geom"))
    return t.agg(F.count_if(F.col("geom").isNull()).alias("nulls"), F.count_if(G.is_empty(F.col("geom"))).alias("empties"),
                 F.count_if(F.col("geom").isNotNull() & ~G.is_empty(F.col("geom"))).alias("filled"))


@query("explode_parts", """SELECT unit, CAST(3 * count(*) AS BIGINT) AS parts, CAST(sum(3 * x + 3) AS DOUBLE) AS sx FROM sites GROUP BY unit""")
def explode_parts(spark, sf):
    """Every site as a point of three parts, a metre from one another."""
    parts = F.array(*[F.array(G.vertex(F.col("x") + i, F.col("y"))) for i in range(3)])
    multi = view(spark, sf, "sites").withColumn("geom", G.make_geom("POINT", parts, SRID, F.array(*map(F.lit, range(3)))))
    single = M.explode_parts(multi.select("unit", "geom"))
    return single.groupBy("unit").agg(F.count("*").alias("parts"), F.sum(F.col("geom")["rings"][0][0][0]).alias("sx"))


@query("split_by_kind", """SELECT 'POINT' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 'LINE', count(*) FROM streets
  UNION ALL SELECT 'POLYGON', count(*) FROM part""")
def split_by_kind(spark, sf):
    mixed = site_layer(spark, sf).select("geom").unionByName(street_layer(spark, sf).select("geom")).unionByName(
        footprint_layer(spark, sf).select("geom"))
    out = None
    for kind, df in M.promote_multi(mixed).items():
        n = df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("region_point", """SELECT bldg_id, CAST(x0 + side / 2.0 AS DOUBLE) AS lon, CAST(y0 + side / 2.0 AS DOUBLE) AS lat FROM footprints
  UNION ALL SELECT -1 - site_id, CAST(x AS DOUBLE), CAST(y AS DOUBLE) FROM sites""")
def region_point(spark, sf):
    b = view(spark, sf, "footprints").select("bldg_id", F.array(*[F.col(c).cast("double") for c in ("x0", "y0")], (
        F.col("x0") + F.col("side")).cast("double"), (F.col("y0") + F.col("side")).cast("double")).alias("v"))
    p = view(spark, sf, "sites").select((-1 - F.col("site_id")).alias("bldg_id"), G.vertex("x", "y").alias("v"))
    c = b.unionByName(p).withColumn("c", tiles.region_point(F.col("v")))
    return c.select("bldg_id", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"))


_LL = "5.0 + (c_custkey * 37 % 1300) / 100.0"


@query("metric_srid", f"""WITH p AS (SELECT c_custkey AS id, {_LL} AS lon, c_mktsegment AS seg FROM customer)
SELECT id, CASE seg WHEN 'BUILDING' THEN CASE WHEN lon >= 12 THEN 25833 ELSE 25832 END WHEN 'AUTOMOBILE' THEN 2056
  WHEN 'MACHINERY' THEN 31287 ELSE 4326 END AS srid FROM p""")
def metric_srid(spark, sf):
    country = F.when(F.col("c_mktsegment") == "BUILDING", "DE").when(F.col("c_mktsegment") == "AUTOMOBILE", "CH").when(
        F.col("c_mktsegment") == "MACHINERY", "AT")
    lon = 5.0 + F.pmod(F.col("c_custkey") * 37, F.lit(1300)) / 100.0
    return view(spark, sf, "customer").select(F.col("c_custkey").alias("id"), tiles.metric_srid(country, lon).alias("srid"))


@query("slippy_tile", """WITH p AS (SELECT c_custkey AS id, -179.5 + (c_custkey * 37 % 35900) / 100.0 AS lon,
  -80.0 + (c_custkey * 53 % 16000) / 100.0 AS lat, CAST(2 + c_custkey % 14 AS INT) AS z FROM customer)
SELECT id, round((lon + 180.0) / 360.0 * pow(2, z), 6) AS tx,
  round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z), 6) AS ty FROM p""")
def slippy_tile(spark, sf):
    k = F.col("c_custkey")
    t = view(spark, sf, "customer").select(k.alias("id"), tiles.slippy_tile(
        -80.0 + k * 53 % 16000 / 100.0, -179.5 + k * 37 % 35900 / 100.0, 2 + k % 14).alias("t"))
    return t.select("id", F.round("t.x", 6).alias("tx"), F.round("t.y", 6).alias("ty"))


@query("grid_tiles", """WITH w AS (SELECT bldg_id, x0, y0, x0 + side * 60 AS x1, y0 + side * 60 AS y1 FROM footprints),
t AS (SELECT bldg_id, unnest(range(CAST(floor(x0 / 2000.0) AS BIGINT) * 2, CAST(floor(x1 / 2000.0) AS BIGINT) * 2 + 1, 2)) AS e, y0, y1 FROM w),
u AS (SELECT bldg_id, e, unnest(range(CAST(floor(y0 / 2000.0) AS BIGINT) * 2, CAST(floor(y1 / 2000.0) AS BIGINT) * 2 + 1, 2)) AS n FROM t)
SELECT bldg_id, e, n, e || '_' || n || '.gml' AS tile FROM u""")
def grid_tiles(spark, sf):
    f = view(spark, sf, "footprints")
    w = f.select("bldg_id", F.struct(
        F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), (F.col("x0") + F.col("side") * 60).alias("xmax"),
        (F.col("y0") + F.col("side") * 60).alias("ymax")).alias("b"))
    t = w.select("bldg_id", F.explode(tiles.grid_tiles(F.col("b"), 2)).alias("t"))
    return t.select("bldg_id", "t.e", "t.n", tiles.tile_name("%d_%d.gml", F.col("t.e"), F.col("t.n")).alias("tile"))


@query("degree_tiles", """WITH w AS (SELECT c_custkey AS id, -170.0 + (c_custkey * 37 % 34000) / 100.0 AS w,
  -60.0 + (c_custkey * 53 % 12000) / 100.0 AS s, (c_custkey % 5) / 2.0 AS dx, (c_custkey % 3) / 2.0 AS dy FROM customer),
a AS (SELECT id, unnest(range(CAST(floor(w) AS BIGINT), greatest(CAST(ceil(w + dx) AS BIGINT), CAST(floor(w) AS BIGINT) + 1))) AS lon, s, dy FROM w),
b AS (SELECT id, lon, unnest(range(CAST(floor(s) AS BIGINT), greatest(CAST(ceil(s + dy) AS BIGINT), CAST(floor(s) AS BIGINT) + 1))) AS lat FROM a)
SELECT id, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || '_00_' ||
  CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') AS tile FROM b""")
def degree_tiles(spark, sf):
    k = F.col("c_custkey")
    west, south = -170.0 + k * 37 % 34000 / 100.0, -60.0 + k * 53 % 12000 / 100.0
    c = view(spark, sf, "customer").select(k.alias("id"), tiles.degree_tiles(
        west, south, west + k % 5 / 2.0, south + k % 3 / 2.0).alias("t"))
    return c.select("id", F.explode("t").alias("tile"))


@query("buffer_circle", """SELECT site_id, CAST(21 AS INT) AS vertices, round(10 * 300.0 * 300.0 * sin(pi() / 10), 3) AS area FROM sites""")
def buffer_circle(spark, sf):
    b = S.require_metric(site_layer(spark, sf)).withColumn("geom", G.buffer_point("x", "y", 300.0, SRID))
    return b.select("site_id", G.num_vertices(F.col("geom")).alias("vertices"), F.round(G.area(F.col("geom")), 3).alias("area"))


@query("newell_normal", """SELECT bldg_id, CAST(0 AS DOUBLE) AS nx, round(-side * height, 6) AS ny, CAST(side * side AS DOUBLE) AS nz,
  round(degrees(atan2(height, side)), 6) AS slope, CAST(180 AS DOUBLE) AS azimuth FROM footprints""")
def newell_normal(spark, sf):
    f = view(spark, sf, "footprints")
    s, h = F.col("side").cast("double"), F.col("height")
    x, y = F.col("x0") * 0.0, F.col("y0") * 0.0
    v = lambda a, b, c: F.array(a, b, c)
    # a roof face rising northwards: it looks south
    ring = F.array(v(x, y, x), v(x + s, y, x), v(x + s, y + s, h), v(x, y + s, h), v(x, y, x))
    t = f.withColumn("r", ring).withColumn("n", G.newell_normal(F.col("r"))).withColumn("o", G.face_orientation(F.col("r")))
    return t.select("bldg_id", (F.col("n.nx") / 2 + 0.0).alias("nx"), F.round(F.col("n.ny") / 2, 6).alias("ny"),
                    (F.col("n.nz") / 2).alias("nz"), F.round("o.slope", 6).alias("slope"), F.round("o.azimuth", 6).alias("azimuth"))


# ---------------------------------------------------------------- filters

@query("filter_expr", "SELECT bldg_id, height FROM footprints WHERE height > 15 AND street IN ('Brand#1', 'Brand#3')")
def filter_expr(spark, sf):
    f = view(spark, sf, "footprints").withColumnRenamed("street", "addr:street")
    return S.filter_expr(f, "height > 15 and addr:street in ('Brand#1', 'Brand#3')").select("bldg_id", "height")


@query("filter_report", "SELECT count(*) AS before, count(*) FILTER (WHERE height > 1000) AS after, count(*) FILTER (WHERE height > 1000) = 0 AS empty FROM footprints")
def filter_report(spark, sf):
    return S.filter_report(view(spark, sf, "footprints"), "height > 1000")


@query("extract_by_attribute", """SELECT 'begins' AS op, count(*) AS n FROM part WHERE starts_with(p_type, 'ECO')
 UNION ALL SELECT 'contains', count(*) FROM part WHERE p_name LIKE '%ring%' UNION ALL SELECT 'without', count(*) FROM part WHERE p_name NOT LIKE '%ring%'
 UNION ALL SELECT 'ge', count(*) FROM part WHERE p_size >= 25 UNION ALL SELECT 'ne', count(*) FROM part WHERE p_brand <> 'Brand#2'
 UNION ALL SELECT 'null', count(*) FROM part WHERE p_name IS NULL UNION ALL SELECT 'not-null', count(*) FROM part WHERE p_name IS NOT NULL""")
def extract_by_attribute(spark, sf):
    p = view(spark, sf, "part")
    asks = (("begins", "p_type", "begins-with", "ECO"), ("contains", "p_name", "contains", "ring"),
            ("without", "p_name", "does-not-contain", "ring"), ("ge", "p_size", ">=", 25), ("ne", "p_brand", "!=", "Brand#2"),
            ("null", "p_name", "is-null", None), ("not-null", "p_name", "is-not-null", None))
    out = None
    for tag, field, op, v in asks:
        n = S.extract_by_attribute(p, field, op, v).agg(F.lit(tag).alias("op"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("apply_where", "SELECT p_partkey, p_type FROM part WHERE lower(trim(p_brand)) = 'brand#2' AND CAST(p_size AS VARCHAR) = '11'")
def apply_where(spark, sf):
    rows, missing = S.apply_where(view(spark, sf, "part"), {"p_brand": " BRAND#2 ", "p_size": 11})
    assert not missing
    return rows.select("p_partkey", "p_type")


@query("bbox_filter", """SELECT 'site' AS layer, site_id AS id FROM sites WHERE x BETWEEN 502000 AND 509000 AND y BETWEEN 5403000 AND 5411000
 UNION ALL SELECT 'zone', zone_id FROM zones z WHERE x0 <= 507500 AND x0 + 4000 >= 502500 AND y0 <= 5407500 AND y0 + 4000 >= 5402500
  AND NOT (variant = 1 AND x0 + 2000 < 502500 AND y0 + 2000 < 5402500)
  AND NOT (variant = 2 AND x0 + 1000 < 502500 AND x0 + 3000 > 507500 AND y0 + 1000 < 5402500 AND y0 + 3000 > 5407500)""")
def bbox_filter(spark, sf):
    s = J.bbox_filter(view(spark, sf, "sites"), (502000, 5403000, 509000, 5411000))
    z = J.bbox_filter(G.with_bbox(zone_layer(spark, sf)), (502500, 5402500, 507500, 5407500), geom="geom", kinds=("POLYGON",))
    return s.select(F.lit("site").alias("layer"), F.col("site_id").alias("id")).unionByName(
        z.select(F.lit("zone").alias("layer"), F.col("zone_id").cast("long").alias("id")))


@query("match_units", "SELECT code, name FROM zones WHERE starts_with(code, '02') OR contains(lower(name), '_1')")
def match_units(spark, sf):
    z = view(spark, sf, "zones")
    return S.match_units(z, "02", "code", "name").select("code", "name").unionByName(
        S.match_units(z, "N_1", "code", "name").select("code", "name")).distinct()


@query("unit_filters", """SELECT n_nationkey AS unit, n_name AS name FROM nation WHERE n_regionkey = (SELECT min(r_regionkey) FROM region
  WHERE contains(lower(r_name), 'asi')) UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 4""")
def unit_filters(spark, sf):
    n = view(spark, sf, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name"),
                                         F.col("n_regionkey").alias("kantonsnummer"))
    r = view(spark, sf, "region").select(F.col("r_regionkey").alias("kantonsnummer"), F.col("r_name").alias("name"))
    by_name = S.in_canton(n, "Asi", r)
    by_number = S.land_only(S.in_canton(n, "4"), "kantonsnummer", 4)
    return by_name.unionByName(by_number, allowMissingColumns=True).select("unit", "name")


@query("keep_columns", "SELECT code, name FROM zones")
def keep_columns(spark, sf):
    return S.keep_columns(zone_layer(spark, sf), ["code", "name", "NUTS"]).drop("geom")


@query("street_filter", "SELECT bldg_id, street FROM footprints WHERE starts_with(lower(coalesce(street, '')), 'brand#1')")
def street_filter(spark, sf):
    return S.street_filter(view(spark, sf, "footprints"), "BRAND#1").select("bldg_id", "street")


@query("stringify_tags", """SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, CASE WHEN p_retailprice = floor(p_retailprice)
  THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS price,
  p_size || ';' || (p_size + 1) AS levels, p_size > 25 AS big FROM part""")
def stringify_tags(spark, sf):
    p = view(spark, sf, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
                                       F.array("p_size", F.col("p_size") + 1).alias("levels"), (F.col("p_size") > 25).alias("big"))
    return S.stringify_columns(p, ["size", "price", "levels", "big"])


@query("field_calc", "SELECT bldg_id, round(side * side * height, 6) AS volume FROM footprints")
def field_calc(spark, sf):
    f = S.field_calc(view(spark, sf, "footprints"), "volume", "round(side * side * height, 6)")
    return f.select("bldg_id", "volume")


@query("check_crs", """SELECT 25832 AS srid, count(*) AS features, false AS is_geographic, true AS safe FROM zones UNION ALL
  SELECT 4326, count(*), true, false FROM sites""")
def check_crs(spark, sf):
    z = zone_layer(spark, sf).select("geom")
    s = site_layer(spark, sf).select(G.point("x", "y", 4326).alias("geom"))
    return S.check_crs(z.unionByName(s)).drop("note")


# ---------------------------------------------------------------- spatial joins

@query("points_in_zones", f"SELECT z.zone_id, p.site_id FROM zones z JOIN sites p ON {ZONE_MEETS}")
def points_in_zones(spark, sf):
    pairs = J.points_in_polygons(view(spark, sf, "sites"), zone_layer(spark, sf), cell=4000)
    return pairs.select(F.col("r_zone_id").alias("zone_id"), F.col("l_site_id").alias("site_id"))


@query("count_points", f"SELECT z.zone_id, count(p.home_id) AS numpoints FROM zones z LEFT JOIN homes p ON {ZONE_INSIDE} GROUP BY z.zone_id")
def count_points(spark, sf):
    return J.count_points_in_polygon(zone_layer(spark, sf), view(spark, sf, "homes"), "zone_id", cell=4000).select(
        "zone_id", "numpoints")


@query("spatial_join", f"SELECT p.site_id, z.code, z.name FROM sites p JOIN zones z ON {ZONE_INSIDE}")
def spatial_join(spark, sf):
    return J.spatial_join(site_layer(spark, sf), zone_layer(spark, sf).select("code", "name", "geom"), "within",
                          cell=4000).select("site_id", "code", "name")


@query("extract_by_location", f"""SELECT 'inside' AS how, home_id FROM homes p WHERE EXISTS (SELECT 1 FROM zones z WHERE {ZONE_MEETS})
  UNION ALL SELECT 'outside', home_id FROM homes p WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE {ZONE_MEETS})""")
def extract_by_location(spark, sf):
    h, z = home_layer(spark, sf), zone_layer(spark, sf)
    one = lambda how, pred: J.extract_by_location(h, z, pred, "home_id", cell=4000).select(F.lit(how).alias("how"), "home_id")
    return one("inside", "intersects").unionByName(one("outside", "disjoint"))


_BOX = """WITH z AS (SELECT zone_id, x0 - 600 AS x0, y0 - 600 AS y0, x0 + 600 AS x1, y0 + 600 AS y1 FROM zones),
f AS (SELECT bldg_id, x0, y0, x0 + side AS x1, y0 + side AS y1 FROM footprints),
p AS (SELECT z.zone_id, f.bldg_id, least(z.x1, f.x1) - greatest(z.x0, f.x0) AS w, least(z.y1, f.y1) - greatest(z.y0, f.y0) AS h,
  f.x0 >= z.x0 AND f.x1 <= z.x1 AND f.y0 >= z.y0 AND f.y1 <= z.y1 AS inside FROM z, f
  WHERE f.x0 <= z.x1 AND f.x1 >= z.x0 AND f.y0 <= z.y1 AND f.y1 >= z.y0) """


def _boxes(spark, sf):
    z = view(spark, sf, "zones")
    blocks = z.select("zone_id", G.box(F.col("x0") - 600, F.col("y0") - 600, F.col("x0") + 600, F.col("y0") + 600, SRID).alias("geom"))
    return blocks, footprint_layer(spark, sf).select("bldg_id", "geom")


@query("box_predicates", _BOX + """SELECT 'intersects' AS predicate, zone_id, bldg_id FROM p
  UNION ALL SELECT 'contains', zone_id, bldg_id FROM p WHERE inside
  UNION ALL SELECT 'touches', zone_id, bldg_id FROM p WHERE w = 0 OR h = 0
  UNION ALL SELECT 'overlaps', zone_id, bldg_id FROM p WHERE w > 0 AND h > 0 AND NOT inside""")
def box_predicates(spark, sf):
    a, b = _boxes(spark, sf)
    names = ("intersects", "contains", "touches", "overlaps", "within", "equals", "crosses")
    hit = J.relate(a, b, names, cell=1200, kinds=(("POLYGON",), ("POLYGON",)))
    return hit.select("predicate", F.col("l_zone_id").alias("zone_id"), F.col("r_bldg_id").alias("bldg_id"))


@query("overlap_area", _BOX + "SELECT zone_id, bldg_id, CAST(w * h AS DOUBLE) AS area FROM p WHERE w > 0 AND h > 0")
def overlap_area(spark, sf):
    a, b = _boxes(spark, sf)
    return J.overlap_areas(a, b, "zone_id", "bldg_id", cell=1200).withColumn("area", F.round("area", 6))


@query("coverage_share", _BOX + ", s AS (SELECT zone_id, sum(w * h) AS built FROM p WHERE w > 0 AND h > 0 GROUP BY zone_id) "
       "SELECT z.zone_id, round(coalesce(built, 0) / 1440000.0, 9) AS share FROM zones z LEFT JOIN s ON s.zone_id = z.zone_id")
def coverage_share(spark, sf):
    from geoloom.operators.joins import overlap_share
    a, b = _boxes(spark, sf)
    built = J.overlap_areas(a, b, "zone_id", "bldg_id", cell=1200).groupBy("zone_id").agg(F.sum("area").alias("built"))
    out = a.join(built, "zone_id", "left")
    return out.select("zone_id", F.round(overlap_share(F.coalesce("built", F.lit(0.0)), G.area(F.col("geom"))), 9).alias("share"))


@query("self_overlaps", """WITH f AS (SELECT bldg_id, x0, y0, x0 + side AS x1, y0 + side AS y1 FROM footprints)
SELECT a.bldg_id AS a, b.bldg_id AS b FROM f a JOIN f b ON a.bldg_id < b.bldg_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
WHERE NOT (a.x0 <= b.x0 AND a.x1 >= b.x1 AND a.y0 <= b.y0 AND a.y1 >= b.y1) AND NOT (b.x0 <= a.x0 AND b.x1 >= a.x1 AND b.y0 <= a.y0 AND b.y1 >= a.y1)""")
def self_overlaps(spark, sf):
    return J.self_overlaps(footprint_layer(spark, sf), "bldg_id", cell=50)


@query("within_distance", """SELECT s.site_id, h.home_id, round(sqrt(CAST((s.x - h.x) * (s.x - h.x) + (s.y - h.y) * (s.y - h.y) AS DOUBLE)), 6) AS dist
FROM sites s JOIN homes h ON (s.x - h.x) * (s.x - h.x) + (s.y - h.y) * (s.y - h.y) <= 500 * 500""")
def within_distance(spark, sf):
    d = J.within_distance(view(spark, sf, "homes"), view(spark, sf, "sites"), 500)
    return d.select(F.col("r_site_id").alias("site_id"), F.col("l_home_id").alias("home_id"), F.round("dist", 6).alias("dist"))


@query("nearest_site", """WITH d AS (SELECT h.home_id, s.site_id, (s.x - h.x) * (s.x - h.x) + (s.y - h.y) * (s.y - h.y) AS d2 FROM homes h
  JOIN sites s ON (s.x - h.x) * (s.x - h.x) + (s.y - h.y) * (s.y - h.y) <= 2000 * 2000),
r AS (SELECT *, row_number() OVER (PARTITION BY home_id ORDER BY d2, site_id) AS rn FROM d)
SELECT home_id, site_id, round(sqrt(CAST(d2 AS DOUBLE)), 6) AS dist FROM r WHERE rn = 1""")
def nearest_site(spark, sf):
    n = J.nearest(view(spark, sf, "homes"), view(spark, sf, "sites"), 2000, "home_id", "site_id")
    return n.withColumn("dist", F.round("dist", 6))


# distance to a zone: to its square, and where the point lies in the part a variant lacks, to that part's edges
_BESIDE = "sqrt(CAST(pow(greatest(z.x0 - p.x, p.x - z.x0 - 4000, 0), 2) + pow(greatest(z.y0 - p.y, p.y - z.y0 - 4000, 0), 2) AS DOUBLE))"
_QUARTER = ("sqrt(CAST(least(pow(p.x - z.x0 - 2000, 2) + pow(greatest(p.y - z.y0 - 4000, 0), 2), pow(p.y - z.y0 - 2000, 2) + pow(greatest(p.x - z.x0 - 4000, 0), 2)) AS DOUBLE))")
_HOLE = "CAST(least(p.x - z.x0 - 1000, z.x0 + 3000 - p.x, p.y - z.y0 - 1000, z.y0 + 3000 - p.y) AS DOUBLE)"


@query("near_zone_edge", f"""WITH d AS (SELECT p.site_id, z.zone_id, CASE WHEN {ZONE_MEETS} THEN 0
  WHEN z.variant = 1 AND p.x > z.x0 + 2000 AND p.y > z.y0 + 2000 THEN {_QUARTER}
  WHEN z.variant = 2 AND p.x > z.x0 + 1000 AND p.x < z.x0 + 3000 AND p.y > z.y0 + 1000 AND p.y < z.y0 + 3000 THEN {_HOLE} ELSE {_BESIDE} END AS dist
FROM sites p JOIN zones z ON greatest(z.x0 - p.x, p.x - z.x0 - 4000) <= 800 AND greatest(z.y0 - p.y, p.y - z.y0 - 4000) <= 800)
SELECT site_id, zone_id, round(dist, 6) AS dist FROM d WHERE dist <= 800""")
def near_zone_edge(spark, sf):
    """Zones of every shape: squares, squares without a quarter, squares with a hole."""
    d = J.within_distance_of(view(spark, sf, "sites"), zone_layer(spark, sf), 800.0, cell=4000)
    return d.select(F.col("l_site_id").alias("site_id"), F.col("r_zone_id").alias("zone_id"), F.round("dist", 6).alias("dist"))


@query("detect_area", f"""WITH h AS (SELECT p.home_id, min(z.zone_id) AS zone_id FROM homes p JOIN zones z ON {ZONE_INSIDE} GROUP BY p.home_id)
SELECT p.home_id, z.name FROM homes p LEFT JOIN h ON h.home_id = p.home_id LEFT JOIN zones z ON z.zone_id = h.zone_id""")
def detect_area(spark, sf):
    return J.detect_area(view(spark, sf, "homes"), zone_layer(spark, sf), "home_id", "name", "zone_id", cell=4000).select(
        "home_id", "name")


@query("region_profile", """WITH o AS (SELECT n_nationkey AS ord, CASE n_nationkey % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'CH' ELSE 'AT' END AS code, 5 + 2 * (n_nationkey % 5) AS w, 45 + 2 * CAST(floor(n_nationkey / 5.0) AS BIGINT) AS s FROM nation),
p AS (SELECT c_custkey, 4.52 + (c_custkey % 113) * 0.1 AS lon, 44.54 + (c_custkey % 127) * 0.1 + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 0.25 END AS lat FROM customer),
h AS (SELECT p.c_custkey, arg_min(o.code, o.ord) AS code FROM p JOIN o ON p.lon > o.w AND p.lon < o.w + 1.97 AND p.lat > o.s AND p.lat < o.s + 1.97 GROUP BY 1)
SELECT p.c_custkey, h.code AS country, CASE WHEN h.code = 'DE' AND lon >= 12 THEN 25833 WHEN h.code = 'DE' THEN 25832 WHEN h.code = 'CH' THEN 2056 WHEN h.code = 'AT' THEN 31287 ELSE 4326 END AS srid,
 round(CAST(lon AS DOUBLE), 6) AS lon, round(CAST(lat AS DOUBLE), 6) AS lat FROM p LEFT JOIN h USING (c_custkey)""")
def region_profile(spark, sf):
    """Points and boxes among square countries with gaps between them."""
    n = F.col("n_nationkey")
    w, s = (n % 5 * 2 + 5).cast("double"), (F.floor(n / 5) * 2 + 45).cast("double")
    o = view(spark, sf, "nation").select(n.alias("ord"), F.when(n % 3 == 0, "DE").when(n % 3 == 1, "CH").otherwise("AT").alias("code"),
                                         G.box(w, s, w + 1.97, s + 1.97, 4326).alias("geom"))
    k = F.col("c_custkey")
    lon, lat = k % 113 * 0.1 + 4.52, k % 127 * 0.1 + 44.54
    place = F.when(k % 2 == 0, F.array(lon, lat)).otherwise(F.array(lon - 0.5, lat, lon + 0.5, lat + 0.5))
    return J.region_profile(view(spark, sf, "customer").select(k, place.alias("place")), o, "c_custkey", "place", "code", "ord")


@query("clip_points", f"SELECT DISTINCT p.home_id, p.segment FROM homes p JOIN zones z ON {ZONE_MEETS}")
def clip_points(spark, sf):
    return O.clip_points(view(spark, sf, "homes"), zone_layer(spark, sf), "home_id", cell=4000).select(
        "home_id", "segment")


@query("clip_to_box", """WITH f AS (SELECT bldg_id, greatest(x0, 500500) AS a, greatest(y0, 5400020) AS b, least(x0 + side, 509010) AS c, least(y0 + side, 5400105) AS d FROM footprints)
SELECT bldg_id, CAST((c - a) * (d - b) AS DOUBLE) AS area FROM f WHERE c > a AND d > b""")
def clip_to_box(spark, sf):
    c = O.clip_to_box(footprint_layer(spark, sf), (500500, 5400020, 509010, 5400105))
    return c.select("bldg_id", F.round(G.area(F.col("geom")), 6).alias("area"))


# ---------------------------------------------------------------- overlay family

@query("overlay_areas", _BOX + """SELECT 'both' AS part, zone_id, bldg_id, CAST(w * h AS DOUBLE) AS area FROM p WHERE w > 0 AND h > 0""")
def overlay_areas(spark, sf):
    a, b = _boxes(spark, sf)
    d = O.overlay_areas(a, b, "intersection", "zone_id", "bldg_id", cell=200)
    return d.select(F.lit("both").alias("part"), "zone_id", "bldg_id", F.round("area", 3).alias("area"))


def _plots(spark, sf):
    """Blocks of 1,200 m that don't meet, and squares of 30 m on a lattice of 50 m, which lie in a block, across its edge or outside."""
    blocks = _boxes(spark, sf)[0]
    x, y = F.lit(499_190) + 50 * (F.col("p_partkey") % 40), F.lit(5_399_285) + 50 * F.floor(F.col("p_partkey") / 40)
    plots = spread(view(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("plot_id"), G.box(x, y, x + 30, y + 30, SRID).alias("geom"))
    return blocks, plots


_PLOTS = """WITH z AS (SELECT zone_id, x0 - 600 AS x0, y0 - 600 AS y0 FROM zones),
p AS (SELECT p_partkey AS plot_id, 499190 + 50 * (p_partkey % 40) AS x0, 5399285 + 50 * CAST(floor(p_partkey / 40.0) AS BIGINT) AS y0 FROM part),
i AS (SELECT zone_id, plot_id, CAST((least(z.x0 + 1200, p.x0 + 30) - greatest(z.x0, p.x0)) * (least(z.y0 + 1200, p.y0 + 30) - greatest(z.y0, p.y0)) AS DOUBLE) AS area
      FROM z JOIN p ON p.x0 < z.x0 + 1200 AND p.x0 + 30 > z.x0 AND p.y0 < z.y0 + 1200 AND p.y0 + 30 > z.y0),
a AS (SELECT z.zone_id, CAST(NULL AS BIGINT) AS plot_id, 1440000 - coalesce(sum(i.area), 0) AS area FROM z LEFT JOIN i USING (zone_id) GROUP BY z.zone_id),
b AS (SELECT CAST(NULL AS INTEGER) AS zone_id, p.plot_id, 900 - coalesce(sum(i.area), 0) AS area FROM p LEFT JOIN i ON i.plot_id = p.plot_id GROUP BY p.plot_id) """


def _overlay(spark, sf, how):
    blocks, plots = _plots(spark, sf)
    return O.overlay_areas(blocks, plots, how, "zone_id", "plot_id", cell=400).select("zone_id", "plot_id", F.round("area", 3).alias("area"))


@query("overlay_union", _PLOTS + "SELECT * FROM i UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b WHERE area > 0")
def overlay_union(spark, sf):
    return _overlay(spark, sf, "union")


@query("overlay_difference", _PLOTS + "SELECT * FROM a")
def overlay_difference(spark, sf):
    return _overlay(spark, sf, "difference")


@query("overlay_symmetric_difference", _PLOTS + "SELECT * FROM a UNION ALL SELECT * FROM b WHERE area > 0")
def overlay_symmetric_difference(spark, sf):
    return _overlay(spark, sf, "symmetric_difference")


@query("overlay_identity", _PLOTS + "SELECT * FROM i UNION ALL SELECT * FROM a")
def overlay_identity(spark, sf):
    return _overlay(spark, sf, "identity")


_SLANTED = """WITH z AS (SELECT zone_id, x0 + y0 AS u, x0 - y0 AS v FROM zones),
p AS (SELECT p_partkey AS plot_id, 499205 + 50 * (p_partkey % 40) AS x, 5399300 + 50 * CAST(floor(p_partkey / 40.0) AS BIGINT) AS y FROM part),
i AS (SELECT zone_id, plot_id, (least(z.u + 600, p.x + p.y + 20) - greatest(z.u - 600, p.x + p.y - 20)) * (least(z.v + 600, p.x - p.y + 20) - greatest(z.v - 600, p.x - p.y - 20)) / 2.0 AS area
      FROM z JOIN p ON p.x + p.y - 20 < z.u + 600 AND p.x + p.y + 20 > z.u - 600 AND p.x - p.y - 20 < z.v + 600 AND p.x - p.y + 20 > z.v - 600) """


def _diamond(x, y, r):
    corner = lambda dx, dy: F.array((x + dx * r).cast("double"), (y + dy * r).cast("double"))
    return G.make_geom("POLYGON", F.array(F.array(*[corner(*c) for c in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))])), SRID)


@query("overlay_slanted", _SLANTED + """SELECT zone_id, plot_id, CAST(area AS DOUBLE) AS area FROM i
  UNION ALL SELECT z.zone_id, NULL, CAST(720000 - coalesce(sum(i.area), 0) AS DOUBLE) FROM z LEFT JOIN i USING (zone_id) GROUP BY z.zone_id""")
def overlay_slanted(spark, sf):
    """Squares standing on their corners: every edge is slanted, every crossing lies between two of them."""
    blocks = view(spark, sf, "zones").select("zone_id", _diamond(F.col("x0"), F.col("y0"), 600).alias("geom"))
    k = F.col("p_partkey")
    plots = spread(view(spark, sf, "part"), "p_partkey").select(k.alias("plot_id"), _diamond(F.lit(499_205) + 50 * (k % 40), F.lit(5_399_300) + 50 * F.floor(k / 40), 20).alias("geom"))
    return O.overlay_areas(blocks, plots, "identity", "zone_id", "plot_id").select("zone_id", "plot_id", F.round("area", 3).alias("area"))


@query("clip_polygons", _PLOTS + "SELECT plot_id, sum(area) AS area FROM i GROUP BY plot_id")
def clip_polygons(spark, sf):
    blocks, plots = _plots(spark, sf)
    return O.clip_polygons(plots, blocks, "plot_id", cell=400).select("plot_id", F.round(G.area(F.col("geom")), 3).alias("area"))


@query("dissolve_degrees", """SELECT p_partkey % 5 AS unit, round(count(*) * 1.0, 3) AS squares FROM part GROUP BY 1""")
def dissolve_degrees(spark, sf):
    """Buildings of about nine metres in degrees, none touching another of its unit: merged areas in squares."""
    k, s = F.col("p_partkey"), 8e-5
    x, y = F.lit(10.0) + (k % 500) * 2 * s, F.lit(50.0) + F.floor(k / 500) * 2 * s
    p = spread(view(spark, sf, "part"), "p_partkey").select((k % 5).alias("unit"), G.box(x, y, x + s, y + s, 4326).alias("geom"))
    from geoloom.operators.graph import ring_areas
    e, g = O.dissolve_edges(p, "unit", cell=0.004)
    shift = e.select("unit", (F.col("x1") - 10).alias("x1"), (F.col("y1") - 50).alias("y1"), (F.col("x2") - 10).alias("x2"), (F.col("y2") - 50).alias("y2"))
    return ring_areas(shift, g).select("unit", F.round(F.col("area") / (s * s), 3).alias("squares"))


@query("dissolve_by_region", """SELECT n_regionkey AS region, CAST(sum(CASE n_nationkey % 3 WHEN 0 THEN 16000000 ELSE 12000000 END) AS DOUBLE) AS area
FROM nation GROUP BY n_regionkey""")
def dissolve_by_region(spark, sf):
    z = zone_layer(spark, sf).join(view(spark, sf, "nation").select(
        F.col("n_nationkey").alias("zone_id"), F.col("n_regionkey").alias("region")), "zone_id")
    from geoloom.operators.graph import ring_areas
    e, g = O.dissolve_edges(z, "region", cell=4000)
    return ring_areas(e, g).withColumn("area", F.round("area", 3))


@query("dangles", """WITH e AS (SELECT a AS n, b AS o, CASE WHEN b = a + 1 THEN 100 ELSE 100 END AS len FROM streets UNION ALL SELECT b, a, 100 FROM streets),
d AS (SELECT n, count(*) AS deg FROM e GROUP BY n)
SELECT (SELECT count(*) FROM streets) AS line_count, (SELECT count(*) FROM d) AS nodes, (SELECT count(*) FROM d WHERE deg = 1) AS free_ends,
 (SELECT count(*) FROM streets s WHERE EXISTS (SELECT 1 FROM d WHERE d.n IN (s.a, s.b) AND deg = 1)) AS free_end_lines,
 (SELECT count(*) FROM streets s WHERE EXISTS (SELECT 1 FROM d WHERE d.n IN (s.a, s.b) AND deg = 1)) AS short_dangles""")
def dangles(spark, sf):
    return N.dangles(street_layer(spark, sf), max_length=100.0)
