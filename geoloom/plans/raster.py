"""Raster and point-cloud queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import city as C
from geoloom.operators import raster as R
from geoloom.operators.graph import connected_components
from geoloom.functions.scalars import las_class_colour
from geoloom.plans.registry import query
from geoloom.plans.views import footprint_layer, view, zone_layer


def band(spark, sf, odd: int):
    c = view(spark, sf, "cells").where(F.col("raster_id") % 2 == odd)
    return c.select(F.floor(F.col("raster_id") / 2).alias("pair"), "row", "col", "value")


BANDS = """a AS (SELECT raster_id // 2 AS pair, row, col, value AS a FROM cells WHERE raster_id % 2 = 0),
b AS (SELECT raster_id // 2 AS pair, row, col, value AS b FROM cells WHERE raster_id % 2 = 1),
z AS (SELECT a.pair, a.row, a.col, a, b FROM a JOIN b ON a.pair = b.pair AND a.row = b.row AND a.col = b.col)"""
IDX = "coalesce(round((a - b) / nullif(a + b, 0), 9), 0.0)"


@query("zip_bands", f"WITH {BANDS} SELECT pair, row, col, a, b FROM z")
def zip_bands(spark, sf):
    return R.zip_bands(band(spark, sf, 0), band(spark, sf, 1), ["pair"])


@query("normalized_difference", f"WITH {BANDS} SELECT pair, row, col, {IDX} AS idx FROM z")
def normalized_difference(spark, sf):
    z = R.zip_bands(band(spark, sf, 0), band(spark, sf, 1), ["pair"])
    return z.select("pair", "row", "col", F.round(R.normalized_difference(F.col("a"), F.col("b")), 9).alias("idx"))


@query("raster_calc", f"WITH {BANDS} SELECT pair, row, col, a - b AS value FROM z")
def raster_calc(spark, sf):
    a, b = band(spark, sf, 0), band(spark, sf, 1)
    return R.raster_calc(a, b, "A - B", ["pair"])


@query("threshold_mask", f"""WITH {BANDS} SELECT pair, round(avg(CASE WHEN {IDX} > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS fraction,
  count(*) FILTER (WHERE {IDX} > 0.1) AS cells FROM z GROUP BY pair""")
def threshold_mask(spark, sf):
    z = R.zip_bands(band(spark, sf, 0), band(spark, sf, 1), ["pair"])
    m = R.threshold_mask(R.normalized_difference(F.col("a"), F.col("b")), 0.1)
    return z.groupBy("pair").agg(F.round(F.avg(m), 6).alias("fraction"), F.sum(m).alias("cells"))


@query("raster_stats", """SELECT raster_id, min(value) AS min, round(avg(value), 6) AS mean, max(value) AS max, count(*) AS count
FROM cells WHERE value <> 0 GROUP BY raster_id""")
def raster_stats(spark, sf):
    s = R.raster_stats(view(spark, sf, "cells"), nodata=0.0, by=["raster_id"])
    return s.withColumn("mean", F.round("mean", 6))


@query("raster_window", """SELECT row - 12 AS row, col - 20 AS col, value FROM dem WHERE row BETWEEN 12 AND 29 AND col BETWEEN 20 AND 90""")
def raster_window(spark, sf):
    g = R.Grid(500000.0, 5400000.0, 10.0, 10.0, 200, 1_000_000, 25832)
    # the window's edges fall inside cells; whole cells by centre remain
    w, _ = R.raster_window(view(spark, sf, "dem"), g, (500203.0, 5399701.0, 500907.0, 5399877.0))
    return w.select("row", "col", "value")


@query("mosaic", """WITH t AS (SELECT raster_id, (raster_id % 40) * 4 + row AS row, col + (raster_id // 40) * 6 AS col, value FROM cells WHERE value <> 0),
r AS (SELECT row, col, value, row_number() OVER (PARTITION BY row, col ORDER BY raster_id) AS rn FROM t)
SELECT row, col, value FROM r WHERE rn = 1 AND row >= 3 AND col >= 2""")
def mosaic(spark, sf):
    c = view(spark, sf, "cells")
    t = c.select("raster_id", (F.col("raster_id") % 40 * 4 + F.col("row")).alias("row"),
                 (F.col("col") + F.floor(F.col("raster_id") / 40) * 6).alias("col"), "value")
    return R.mosaic(t, "raster_id", nodata=0.0, bounds=(3, 2, 1 << 30, 1 << 30))


def _placed(spark, sf):
    """The mosaic laid over the zones: 100 m cells from the north-west corner, new rows going south."""
    g = R.Grid(500000.0, 5420000.0, 100.0, 100.0, 200, 200)
    return R.with_centres(view(spark, sf, "dem"), g)


ZCELLS = """c AS (SELECT 500000 + (col + 0.5) * 100 AS x, 5420000 - (row + 0.5) * 100 AS y, value FROM dem),
h AS (SELECT z.zone_id, p.value FROM zones z JOIN c p ON (p.x > z.x0 AND p.x < z.x0 + 4000 AND p.y > z.y0 AND p.y < z.y0 + 4000
  AND NOT (z.variant = 1 AND p.x > z.x0 + 2000 AND p.y > z.y0 + 2000)
  AND NOT (z.variant = 2 AND p.x > z.x0 + 1000 AND p.x < z.x0 + 3000 AND p.y > z.y0 + 1000 AND p.y < z.y0 + 3000)))"""


@query("zonal_stats", f"""WITH {ZCELLS}, m AS (SELECT zone_id, value, count(*) AS k FROM h GROUP BY zone_id, value),
mm AS (SELECT zone_id, first(value ORDER BY k DESC, value) AS majority, first(value ORDER BY k, value) AS minority FROM m GROUP BY zone_id),
s AS (SELECT zone_id, count(*) AS n, sum(value) AS s, round(avg(value), 6) AS mean, median(value) AS median, round(stddev_pop(value), 6) AS stdev,
  min(value) AS lo, max(value) AS hi, max(value) - min(value) AS span, count(DISTINCT value) AS variety, round(var_pop(value), 4) AS variance FROM h GROUP BY zone_id)
SELECT z.zone_id, n AS _count, s AS _sum, mean AS _mean, median AS _median, stdev AS _stdev, lo AS _min, hi AS _max, span AS _range,
  minority AS _minority, majority AS _majority, variety AS _variety, variance AS _variance
FROM zones z LEFT JOIN s ON s.zone_id = z.zone_id LEFT JOIN mm ON mm.zone_id = z.zone_id""")
def zonal_stats(spark, sf):
    out = R.zonal_stats(zone_layer(spark, sf), _placed(spark, sf), "zone_id", R.ZONAL, cell=4000)
    places = {"mean": 6, "stdev": 6, "variance": 4}
    return out.select("zone_id", *[(F.round(f"_{s}", places[s]) if s in places else F.col(f"_{s}")).alias(f"_{s}") for s in R.ZONAL])


@query("rasterize", """WITH n AS (SELECT CAST(ceil(max(y0 + 50 - 5400000) / 10.0) AS BIGINT) AS h FROM footprints),
g AS (SELECT unnest(range(h)) AS row FROM n), gc AS (SELECT row, unnest(range(2005)) AS col FROM g),
m AS (SELECT CAST(floor((x0 - 500000) / 10.0) AS BIGINT) AS cx, * FROM footprints),
b AS (SELECT bldg_id, height, x0, y0, side, unnest(range((x0 - 500000) // 10, (x0 + side - 500000) // 10 + 1)) AS col FROM footprints),
b2 AS (SELECT *, unnest(range((y0 - 5400000) // 10, (y0 + side - 5400000) // 10 + 1)) AS up FROM b),
hit AS (SELECT (SELECT h FROM n) - 1 - up AS row, col, max(height) AS v FROM b2
  WHERE 500000 + col * 10 + 5 BETWEEN x0 AND x0 + side AND 5400000 + up * 10 + 5 BETWEEN y0 AND y0 + side GROUP BY ALL)
SELECT row // 10 AS block, count(*) AS cells, count(*) FILTER (WHERE coalesce(v, 0) > 0) AS built, round(sum(coalesce(v, 0)), 4) AS total
FROM gc LEFT JOIN hit USING (row, col) GROUP BY row // 10""")
def rasterize(spark, sf):
    f = footprint_layer(spark, sf)
    top = f.agg(F.ceil(F.max(F.col("y0") + 50 - 5400000) / 10.0)).first()[0]      # one number: the height of the grid
    grid = R.Grid(500000.0, 5400000.0 + 10.0 * top, 10.0, 10.0, 2005, top)
    burnt = R.rasterize(f, "height", grid, cell=50)
    return burnt.groupBy(F.floor(F.col("row") / 10).alias("block")).agg(
        F.count("*").alias("cells"), F.count_if(F.col("value") > 0).alias("built"), F.round(F.sum("value"), 4).alias("total"))


@query("terrain", """WITH n AS (SELECT c.row, c.col, c.value AS e,
  max(CASE WHEN o.row = c.row - 1 AND o.col = c.col - 1 THEN o.value END) AS a, max(CASE WHEN o.row = c.row - 1 AND o.col = c.col THEN o.value END) AS b,
  max(CASE WHEN o.row = c.row - 1 AND o.col = c.col + 1 THEN o.value END) AS c_, max(CASE WHEN o.row = c.row AND o.col = c.col - 1 THEN o.value END) AS d,
  max(CASE WHEN o.row = c.row AND o.col = c.col + 1 THEN o.value END) AS f, max(CASE WHEN o.row = c.row + 1 AND o.col = c.col - 1 THEN o.value END) AS g,
  max(CASE WHEN o.row = c.row + 1 AND o.col = c.col THEN o.value END) AS h, max(CASE WHEN o.row = c.row + 1 AND o.col = c.col + 1 THEN o.value END) AS i
  FROM dem c JOIN (SELECT row, col, value FROM dem) o ON o.row >= c.row - 1 AND o.row <= c.row + 1 AND o.col - c.col IN (-1, 0, 1) GROUP BY c.row, c.col, c.value),
pq AS (SELECT *, ((c_ + 2 * f + i) - (a + 2 * d + g)) / 800.0 AS p, ((a + 2 * b + c_) - (g + 2 * h + i)) / 800.0 AS q FROM n)
SELECT row, col, round(degrees(atan(sqrt(p * p + q * q))), 5) AS slope,
  round(CASE WHEN p = 0 AND q = 0 THEN NULL ELSE fmod(degrees(atan2(-p, -q)) + 360, 360) END, 4) AS aspect,
  round(greatest(0, 255 * (cos(radians(50)) / sqrt(1 + p * p + q * q) + sin(radians(50)) * (-(p * sin(radians(300.0)) + q * cos(radians(300.0)))) / sqrt(1 + p * p + q * q))), 4) AS hillshade,
  round(sqrt(pow(a - e, 2) + pow(b - e, 2) + pow(c_ - e, 2) + pow(d - e, 2) + pow(f - e, 2) + pow(g - e, 2) + pow(h - e, 2) + pow(i - e, 2)), 5) AS ruggedness
FROM pq WHERE a + b + c_ + d + f + g + h + i IS NOT NULL""")
def terrain(spark, sf):
    t = R.terrain(view(spark, sf, "dem"), 100.0, 100.0).where("slope is not null and ruggedness is not null")
    return t.select("row", "col", F.round("slope", 5).alias("slope"), F.round("aspect", 4).alias("aspect"),
                    F.round("hillshade", 4).alias("hillshade"), F.round("ruggedness", 5).alias("ruggedness"))


@query("stretch", """WITH p AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM cells WHERE value <> 0)
SELECT raster_id, row, col, CASE WHEN value <> 0 THEN round(greatest(least((value - lo) / (hi - lo + 1e-9) * 255, 255), 0), 4) END AS stretched,
  CASE WHEN value <> 0 THEN 255 ELSE 0 END AS alpha FROM cells, p""")
def stretch(spark, sf):
    s = R.stretch(view(spark, sf, "cells"), nodata=0.0)
    return s.select("raster_id", "row", "col", F.when(F.col("alpha") > 0, F.round("stretched", 4)).alias("stretched"), "alpha")


# each run of set cells takes the least run it can reach; a run is known by its row and first column
@query("mask_regions", """WITH RECURSIVE m AS (SELECT DISTINCT row, col FROM dem WHERE value > 20),
s AS (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS g FROM m),
r AS (SELECT row, min(col) AS a, max(col) AS b, row * 2147483648 + min(col) AS id, count(*) AS n FROM s GROUP BY row, g),
e AS (SELECT u.id AS x, v.id AS y FROM r u JOIN r v ON abs(v.row - u.row) = 1 AND v.a <= u.b AND v.b >= u.a),
w AS (SELECT id, id AS region FROM r UNION SELECT e.y, w.region FROM w JOIN e ON e.x = w.id WHERE w.region < e.y),
l AS (SELECT id, min(region) AS region FROM w GROUP BY id)
SELECT CAST(region AS BIGINT) AS region, CAST(sum(n) AS BIGINT) AS cells FROM l JOIN r USING (id) GROUP BY region""")
def mask_regions(spark, sf):
    """Connected regions of high ground: region id, cells and area."""
    from geoloom.operators.polygonize import mask_regions as regions
    mask = view(spark, sf, "dem").where("value > 20").select("row", "col")
    return regions(mask).groupBy("region").agg(F.count("*").alias("cells"))


@query("points_to_dtm", """SELECT CAST(floor(x / 25.0) AS BIGINT) AS cx, CAST(floor(y / 25.0) AS BIGINT) AS cy, min(z) AS z, count(*) AS n
FROM points WHERE classification = 2 GROUP BY ALL""")
def points_to_dtm(spark, sf):
    return R.points_to_dtm(view(spark, sf, "points"), 25.0)


@query("classify_ground", """WITH p AS (SELECT *, CAST(floor(x / 25.0) AS BIGINT) AS cx, CAST(floor(y / 25.0) AS BIGINT) AS cy FROM points),
low AS (SELECT cx, cy, min(z) AS s FROM p GROUP BY cx, cy), o AS (SELECT i, j FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
er AS (SELECT l.cx, l.cy, min(k.s) AS s FROM low l, o JOIN low k ON k.cx = l.cx + i AND k.cy = l.cy + j GROUP BY l.cx, l.cy),
di AS (SELECT l.cx, l.cy, max(k.s) AS s FROM er l, o JOIN er k ON k.cx = l.cx + i AND k.cy = l.cy + j GROUP BY l.cx, l.cy)
SELECT p.classification, count(*) AS n, count(*) FILTER (WHERE z - s <= 8) AS ground FROM p JOIN di ON di.cx = p.cx AND di.cy = p.cy GROUP BY p.classification""")
def classify_ground(spark, sf):
    g = R.classify_ground(view(spark, sf, "points"), 25.0, 8.0)
    return g.groupBy("classification").agg(F.count("*").alias("n"), F.count_if("ground").alias("ground"))


@query("decimate", """WITH t AS (SELECT greatest(1, CAST(round(count(*) / 5000.0) AS INT)) AS n FROM points),
r AS (SELECT key, part_key, supp_key, classification, z, row_number() OVER (PARTITION BY key % 64 ORDER BY key, classification, part_key, supp_key, z) - 1 AS i FROM points)
SELECT key, part_key, classification, z FROM r, t WHERE i % n = 0""")
def decimate(spark, sf):
    p = view(spark, sf, "points")
    d = C.decimate(p, 5000, ["key", "classification", "part_key", "supp_key", "z"], F.col("key") % 64)
    return d.select("key", "part_key", "classification", "z")


@query("point_colours", """SELECT classification, count(*) AS n, CASE classification WHEN 2 THEN 0.55 WHEN 3 THEN 0.6 WHEN 4 THEN 0.4 WHEN 5 THEN 0.2
  WHEN 6 THEN 0.86 ELSE 0.62 END::DOUBLE AS red FROM points GROUP BY classification""")
def point_colours(spark, sf):
    n = view(spark, sf, "points").groupBy("classification").agg(F.count("*").alias("n"))
    return n.withColumn("red", las_class_colour(F.col("classification"))[0])


@query("resample", """WITH dims AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM dem),
t AS (SELECT r.row, c.col, greatest(0.0, least((r.row + 0.5) * h / 60.0 - 0.5, h - 1.0)) AS fr, greatest(0.0, least((c.col + 0.5) * w / 96.0 - 0.5, w - 1.0)) AS fc, h, w
  FROM dims, (SELECT unnest(range(60)) AS row) r, (SELECT unnest(range(96)) AS col) c),
s AS (SELECT row, col, value FROM dem WHERE value <> 0),
k AS (SELECT t.row, t.col, least(floor(fr) + i, h - 1) AS r, least(floor(fc) + j, w - 1) AS c, abs((1 - i) - (fr - floor(fr))) * abs((1 - j) - (fc - floor(fc))) AS wt
  FROM t, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
g AS (SELECT k.row, k.col, sum(wt * value) / nullif(sum(CASE WHEN value IS NOT NULL THEN wt END), 0) AS v FROM k LEFT JOIN s ON s.row = k.r AND s.col = k.c GROUP BY k.row, k.col)
SELECT row, col, round(coalesce(v, (SELECT median(v) FROM g)), 5) AS value FROM g""")
def resample(spark, sf):
    dem = view(spark, sf, "dem")
    h, w = dem.agg(F.max("row") + 1, F.max("col") + 1).first()                    # two numbers: the raster's shape
    return R.resample(dem, h, w, 60, 96, nodata=0.0).withColumn("value", F.round("value", 5))
