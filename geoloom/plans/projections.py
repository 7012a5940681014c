"""Projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import formats as FM
from geoloom.functions import geometry as G
from geoloom.functions import projection as P
from geoloom.plans.registry import query
from geoloom.plans.views import footprint_layer, view, zone_layer

_LL = """SELECT c_custkey AS id, -179.0 + (c_custkey * 37 % 35800) / 100.0 AS lon, -80.0 + (c_custkey * 53 % 16000) / 100.0 AS lat FROM customer"""


def _lonlat(spark, sf):
    k = F.col("c_custkey")
    return view(spark, sf, "customer").select(k.alias("id"), (-179.0 + k * 37 % 35800 / 100.0).alias("lon"), (-80.0 + k * 53 % 16000 / 100.0).alias("lat"))


@query("web_mercator", f"""WITH p AS ({_LL}) SELECT id, round(radians(lon) * 6378137, 3) AS x, round(6378137 * ln(tan(radians(lat)) + 1 / cos(radians(lat))), 3) AS y FROM p""")
def web_mercator(spark, sf):
    p = _lonlat(spark, sf).withColumn("p", P.project(F.col("lon"), F.col("lat"), 4326, 3857))
    return p.select("id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("bbox_area", f"""WITH p AS ({_LL}), e AS (SELECT sqrt(2 / 298.257223563 - 1 / (298.257223563 * 298.257223563)) AS e, pow(6378137 * (1 - 1 / 298.257223563), 2) AS b2),
s AS (SELECT id, e, b2, sin(radians(lat)) AS s1, sin(radians(lat + 0.5)) AS s2 FROM p, e),
q AS (SELECT id, b2, 1 / (1 - e * e) + ln((1 + e) / (1 - e)) / (2 * e) AS pole, s1 / (1 - e * e * s1 * s1) + ln((1 + e * s1) / (1 - e * s1)) / (2 * e) AS q1,
 s2 / (1 - e * e * s2 * s2) + ln((1 + e * s2) / (1 - e * s2)) / (2 * e) AS q2 FROM s)
SELECT id, round(abs(atan(tan(radians(0.375)) * q2 / pole) - atan(tan(radians(0.375)) * q1 / pole)) * b2 * pole / 1e6, 4) AS km2 FROM q""")
def bbox_area(spark, sf):
    p = _lonlat(spark, sf)
    return p.select("id", F.round(P.bbox_area_km2(F.col("lon"), F.col("lat"), F.col("lon") + 0.75, F.col("lat") + 0.5), 4).alias("km2"))


@query("reproject_round_trip", """SELECT bldg_id, 0.0::DOUBLE AS off_mm FROM footprints""")
def reproject_round_trip(spark, sf):
    f = footprint_layer(spark, sf).select("bldg_id", "geom", F.col("geom").alias("g2"))
    there = P.reproject(P.reproject(f, 25832, 4326, "g2"), 4326, 3035, "g2")
    back = P.reproject(P.reproject(there, 3035, 4326, "g2"), 4326, 25832, "g2")
    d = back.select("bldg_id", F.array_max(F.zip_with(
        G.vertices(F.col("geom")), G.vertices(F.col("g2")), lambda a, b: F.hypot(a[0] - b[0], a[1] - b[1]))).alias("d"))
    return d.select("bldg_id", F.floor(F.col("d") * 1000).cast("double").alias("off_mm"))


def _utm32_sql() -> tuple[str, str, str]:
    """Longitude and latitude of ``e, n`` in zone 32 by the third-order series in the ellipsoid's third flattening."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    radius = 0.9996 * 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    b = (n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96, n ** 2 / 48 + n ** 3 / 15, 17 * n ** 3 / 480)
    d = (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3, 7 * n ** 2 / 3 - 8 * n ** 3 / 5, 56 * n ** 3 / 15)
    sinh, cosh = "((exp({0}) - exp(-({0}))) / 2)", "((exp({0}) + exp(-({0}))) / 2)"
    xi, eta = f"(n / {radius!r})", f"((e - 500000) / {radius!r})"
    u = xi + "".join(f" - {v!r} * sin({2 * k} * {xi}) * {cosh.format(f'{2 * k} * {eta}')}" for k, v in enumerate(b, 1))
    w = eta + "".join(f" - {v!r} * cos({2 * k} * {xi}) * {sinh.format(f'{2 * k} * {eta}')}" for k, v in enumerate(b, 1))
    chi = f"asin(sin({u}) / {cosh.format(w)})"
    return f"9 + degrees(atan2({sinh.format(w)}, cos({u})))", "degrees(chi" + "".join(f" + {v!r} * sin({2 * k} * chi)" for k, v in enumerate(d, 1)) + ")", chi


_LON, _LAT, _CHI = _utm32_sql()


@query("reproject_bbox", f"""WITH i AS (SELECT unnest(range(21)) AS i),
p AS (SELECT zone_id, x0 + 4000 * i / 20.0 AS e, y0 + 0.0 AS n FROM zones, i UNION ALL SELECT zone_id, x0 + 4000 * i / 20.0, y0 + 4000.0 FROM zones, i
  UNION ALL SELECT zone_id, x0 + 0.0, y0 + 4000 * i / 20.0 FROM zones, i UNION ALL SELECT zone_id, x0 + 4000.0, y0 + 4000 * i / 20.0 FROM zones, i),
c AS (SELECT zone_id, {_LON} AS lon, {_CHI} AS chi FROM (SELECT zone_id, CAST(e AS DOUBLE) AS e, CAST(n AS DOUBLE) AS n FROM p)),
l AS (SELECT zone_id, lon, {_LAT} AS lat FROM c)
SELECT zone_id, round(min(lon), 6) AS xmin, round(min(lat), 6) AS ymin, round(max(lon), 6) AS xmax, round(max(lat), 6) AS ymax FROM l GROUP BY zone_id""")
def reproject_bbox(spark, sf):
    b = G.with_bbox(zone_layer(spark, sf)).withColumn("w", P.reproject_bbox(F.struct("xmin", "ymin", "xmax", "ymax"), 25832, 4326))
    return b.select("zone_id", "w.*")


@query("wkt_round_trip", """SELECT zone_id, CASE variant WHEN 2 THEN 2 ELSE 1 END AS rings, true AS same, 'POLYGON ((' || x0 || ' ' || y0 || ', ' AS head FROM zones""")
def wkt_round_trip(spark, sf):
    z = zone_layer(spark, sf).withColumn("t", FM.to_wkt(F.col("geom")))
    z = z.withColumn("back", FM.from_wkt(F.col("t"), 25832)).withColumn("b2", FM.from_wkb(FM.to_wkb(F.col("geom")), 25832))
    same = (F.col("back") == F.col("geom")) & (F.col("b2") == F.col("geom"))
    return z.select("zone_id", F.size("geom.rings").alias("rings"), same.alias("same"),
                    F.concat(F.substring_index("t", ",", 1), F.lit(", ")).alias("head"))
