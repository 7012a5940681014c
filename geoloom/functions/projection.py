"""Map projections as closed-form column expressions.

Longitude/latitude (4326, 4258), UTM zones 32 and 33 on ETRS89 (25832, 25833), Swiss LV95 (2056), the European equal-area
grid (3035) and web Mercator (3857). Axis order is always easting/longitude first. WGS84 and ETRS89 are taken as one
datum. Transverse Mercator uses the sixth-order Krueger series (sub-millimetre within a zone); LV95 is the exact
oblique Mercator on the Bessel ellipsoid with its published shift. Other codes are refused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: ellipsoids and projection constants ------------------------------------------------------

GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
BESSEL_A, BESSEL_F = 6377397.155, 1 / 299.1528128
UTM_CENTRAL = {25832: 9.0, 25833: 15.0, 32632: 9.0, 32633: 15.0}
UTM_K0, UTM_E0 = 0.9996, 500000.0
LAEA_LAT0, LAEA_LON0, LAEA_E0, LAEA_N0 = 52.0, 10.0, 4321000.0, 3210000.0
LV95_LAT0, LV95_LON0, LV95_E0, LV95_N0 = 46 + 57 / 60 + 8.66 / 3600, 7 + 26 / 60 + 22.5 / 3600, 2600000.0, 1200000.0
CH1903_SHIFT = (674.374, 15.056, 405.346)          # CH1903+ to WGS84, metres
SUPPORTED = (4326, 4258, 25832, 25833, 32632, 32633, 2056, 3035, 3857)

# -------------------------------------------------------------------------------------------------------------


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _with(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn``."""
    return F.transform(F.array(value), fn)[0]


def _krueger(f: float):
    n = f / (2 - f)
    a = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4 - 127 / 288 * n**5 + 7891 / 37800 * n**6,
         13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4 + 281 / 630 * n**5 - 1983433 / 1935360 * n**6,
         61 / 240 * n**3 - 103 / 140 * n**4 + 15061 / 26880 * n**5 + 167603 / 181440 * n**6,
         49561 / 161280 * n**4 - 179 / 168 * n**5 + 6601661 / 7257600 * n**6,
         34729 / 80640 * n**5 - 3418889 / 1995840 * n**6, 212378941 / 319334400 * n**6]
    b = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4 - 81 / 512 * n**5 + 96199 / 604800 * n**6,
         1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4 + 46 / 105 * n**5 - 1118711 / 3870720 * n**6,
         17 / 480 * n**3 - 37 / 840 * n**4 - 209 / 4480 * n**5 + 5569 / 90720 * n**6,
         4397 / 161280 * n**4 - 11 / 504 * n**5 - 830251 / 7257600 * n**6,
         4583 / 161280 * n**5 - 108847 / 3991680 * n**6, 20648693 / 638668800 * n**6]
    scale = (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) / (1 + n)
    return a, b, scale


def _conformal_tangent(lat: Column, e: float) -> Column:
    """Tangent of the conformal latitude."""
    t = F.tan(lat)
    s = F.sinh(F.lit(e) * F.atanh(F.lit(e) * F.sin(lat)))
    return t * F.sqrt(1 + s * s) - s * F.sqrt(1 + t * t)


def _latitude(tau1: Column, e: float) -> Column:
    """Latitude from the tangent of the conformal latitude: four Newton steps, far below a micrometre."""
    e2 = e * e

    def step(tau):
        s = F.sinh(F.lit(e) * F.atanh(F.lit(e) * tau / F.sqrt(1 + tau * tau)))
        got = tau * F.sqrt(1 + s * s) - s * F.sqrt(1 + tau * tau)
        slope = F.sqrt((1 + got * got) * (1 + tau * tau)) * (1 - e2) / (1 + (1 - e2) * tau * tau)
        return tau + (tau1 - got) / slope

    tau = tau1 / (1 - e2)
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(4)), tau, lambda t, _i: step(t))
    return F.atan(steps)


def _tm_forward(lon: Column, lat: Column, lon0: float, a: float, f: float, k0: float, e0: float) -> Column:
    alpha, _, scale = _krueger(f)
    e = math.sqrt(f * (2 - f))

    def sphere(p):
        dl = F.radians(lon - lon0)
        return _xy(F.atan2(p, F.cos(dl)), F.asinh(F.sin(dl) / F.hypot(p, F.cos(dl))))

    def series(s):
        xi = s["x"] + sum((F.lit(c) * F.sin(2 * j * s["x"]) * F.cosh(2 * j * s["y"]) for j, c in enumerate(alpha, 1)), F.lit(0.0))
        eta = s["y"] + sum((F.lit(c) * F.cos(2 * j * s["x"]) * F.sinh(2 * j * s["y"]) for j, c in enumerate(alpha, 1)), F.lit(0.0))
        return _xy(e0 + k0 * scale * a * eta, k0 * scale * a * xi)

    return _with(_with(_conformal_tangent(F.radians(lat), e), sphere), series)


def _tm_inverse(x: Column, y: Column, lon0: float, a: float, f: float, k0: float, e0: float) -> Column:
    _, beta, scale = _krueger(f)
    e = math.sqrt(f * (2 - f))
    s = _xy((x - e0) / (k0 * scale * a), y / (k0 * scale * a))

    def sphere(p):                                   # p.x = eta, p.y = xi
        xi = p["y"] - sum((F.lit(c) * F.sin(2 * j * p["y"]) * F.cosh(2 * j * p["x"]) for j, c in enumerate(beta, 1)), F.lit(0.0))
        eta = p["x"] - sum((F.lit(c) * F.cos(2 * j * p["y"]) * F.sinh(2 * j * p["x"]) for j, c in enumerate(beta, 1)), F.lit(0.0))
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def back(q):
        tau1 = F.sin(q["xi"]) / F.hypot(F.sinh(q["eta"]), F.cos(q["xi"]))
        lon = lon0 + F.degrees(F.atan2(F.sinh(q["eta"]), F.cos(q["xi"])))
        return _xy(lon, F.degrees(_with(tau1, lambda t: _latitude(t, e))))

    return _with(_with(s, sphere), back)


def _authalic_q(sin_lat: Column, e: float) -> Column:
    return (1 - e * e) * (sin_lat / (1 - e * e * sin_lat * sin_lat) + F.atanh(F.lit(e) * sin_lat) / e)


def _laea(forward: bool, x: Column, y: Column) -> Column:
    a, f = GRS80_A, GRS80_F
    e = math.sqrt(f * (2 - f))
    q_of = lambda s: (1 - e * e) * (s / (1 - e * e * s * s) + math.atanh(e * s) / e)
    qp, s0 = q_of(1.0), math.sin(math.radians(LAEA_LAT0))
    b0 = math.asin(q_of(s0) / qp)
    rq = a * math.sqrt(qp / 2)
    d = a * math.cos(math.radians(LAEA_LAT0)) / math.sqrt(1 - e * e * s0 * s0) / (rq * math.cos(b0))
    if forward:
        def plane(b):
            dl = F.radians(x - LAEA_LON0)
            k = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(b) + math.cos(b0) * F.cos(b) * F.cos(dl)))
            return _xy(LAEA_E0 + k * d * F.cos(b) * F.sin(dl),
                       LAEA_N0 + k / d * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(dl)))
        return _with(F.asin(_authalic_q(F.sin(F.radians(y)), e) / qp), plane)

    # authalic to geodetic latitude, series in e^2
    e2 = e * e
    c = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)

    def angles(p):
        rho = F.hypot(p["x"] / d, p["y"] * d)
        ce = 2 * F.asin(rho / (2 * rq))
        sb = F.cos(ce) * math.sin(b0) + F.coalesce(F.try_divide(p["y"] * d * F.sin(ce) * math.cos(b0), rho), F.lit(0.0))
        lon = F.atan2(p["x"] * F.sin(ce), d * rho * math.cos(b0) * F.cos(ce) - d * d * p["y"] * math.sin(b0) * F.sin(ce))
        return _xy(LAEA_LON0 + F.degrees(lon), F.asin(sb))

    return _with(_with(_xy(x - LAEA_E0, y - LAEA_N0), angles), lambda p: _xy(p["x"], F.degrees(
        p["y"] + c[0] * F.sin(2 * p["y"]) + c[1] * F.sin(4 * p["y"]) + c[2] * F.sin(6 * p["y"]))))


def _web_mercator(forward: bool, x: Column, y: Column) -> Column:
    if forward:
        return _xy(F.radians(x) * WGS84_A, F.asinh(F.tan(F.radians(y))) * WGS84_A)
    return _xy(F.degrees(x / WGS84_A), F.degrees(F.atan(F.sinh(y / WGS84_A))))


def _shift(lon: Column, lat: Column, src: tuple, dst: tuple, move: tuple) -> Column:
    """Longitude/latitude on one ellipsoid to another through geocentric coordinates (height 0)."""
    (a1, f1), (a2, f2) = src, dst
    e1, e2 = f1 * (2 - f1), f2 * (2 - f2)
    la, lo = F.radians(lat), F.radians(lon)
    n = a1 / F.sqrt(1 - e1 * F.sin(la) * F.sin(la))
    geo = F.struct((n * F.cos(la) * F.cos(lo) + move[0]).alias("x"), (n * F.cos(la) * F.sin(lo) + move[1]).alias("y"),
                   (n * (1 - e1) * F.sin(la) + move[2]).alias("z"))

    def back(g):
        p = F.hypot(g["x"], g["y"])
        it = lambda t: F.atan2(g["z"] + e2 * a2 * F.sin(t) / F.sqrt(1 - e2 * F.sin(t) * F.sin(t)), p)
        lat2 = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.atan2(g["z"], p * (1 - e2)), lambda t, _i: it(t))
        return _xy(F.degrees(F.atan2(g["y"], g["x"])), F.degrees(lat2))

    return _with(geo, back)


def _lv95(forward: bool, x: Column, y: Column) -> Column:
    a, f = BESSEL_A, BESSEL_F
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    p0 = math.radians(LV95_LAT0)
    r = a * math.sqrt(1 - e2) / (1 - e2 * math.sin(p0) ** 2)
    al = math.sqrt(1 + e2 / (1 - e2) * math.cos(p0) ** 4)
    b0 = math.asin(math.sin(p0) / al)
    k = (math.log(math.tan(math.pi / 4 + b0 / 2)) - al * math.log(math.tan(math.pi / 4 + p0 / 2))
         + al * e / 2 * math.log((1 + e * math.sin(p0)) / (1 - e * math.sin(p0))))
    if forward:
        def plane(g):
            la = F.radians(g["y"])
            s = al * F.log(F.tan(math.pi / 4 + la / 2)) - al * e * F.atanh(e * F.sin(la)) + k
            b = 2 * (F.atan(F.exp(s)) - math.pi / 4)
            li = al * (F.radians(g["x"]) - math.radians(LV95_LON0))
            return F.struct(b.alias("b"), li.alias("l"))

        def turn(q):
            lb = F.atan2(F.sin(q["l"]), math.sin(b0) * F.tan(q["b"]) + math.cos(b0) * F.cos(q["l"]))
            bb = F.asin(math.cos(b0) * F.sin(q["b"]) - math.sin(b0) * F.cos(q["b"]) * F.cos(q["l"]))
            return _xy(LV95_E0 + r * lb, LV95_N0 + r * F.atanh(F.sin(bb)))

        move = tuple(-v for v in CH1903_SHIFT)
        return _with(_with(_shift(x, y, (WGS84_A, WGS84_F), (a, f), move), plane), turn)

    q = F.struct(((x - LV95_E0) / r).alias("l"), (2 * (F.atan(F.exp((y - LV95_N0) / r)) - math.pi / 4)).alias("b"))

    def untwist(p):
        b = F.asin(math.cos(b0) * F.sin(p["b"]) + math.sin(b0) * F.cos(p["b"]) * F.cos(p["l"]))
        li = F.atan2(F.sin(p["l"]), math.cos(b0) * F.cos(p["l"]) - math.sin(b0) * F.tan(p["b"]))
        return F.struct(b.alias("b"), li.alias("l"))

    def geodetic(p):
        base = (F.log(F.tan(math.pi / 4 + p["b"] / 2)) - k) / al
        it = lambda t: 2 * F.atan(F.exp(base + e * F.atanh(e * F.sin(t)))) - math.pi / 2
        lat = F.aggregate(F.sequence(F.lit(1), F.lit(8)), p["b"], lambda t, _i: it(t))
        return _xy(LV95_LON0 + F.degrees(p["l"] / al), F.degrees(lat))

    def to_wgs84(g):
        # the shift drops the ellipsoid height, so it does not undo itself: one correction makes it the forward way's inverse
        there = _shift(g["x"], g["y"], (a, f), (WGS84_A, WGS84_F), CH1903_SHIFT)
        again = lambda w: _shift(w["x"], w["y"], (WGS84_A, WGS84_F), (a, f), tuple(-v for v in CH1903_SHIFT))
        return _with(there, lambda w: _with(again(w), lambda b: _xy(w["x"] + g["x"] - b["x"], w["y"] + g["y"] - b["y"])))

    return _with(_with(_with(q, untwist), geodetic), to_wgs84)


def _one_way(x: Column, y: Column, srid: int, forward: bool) -> Column:
    if srid in UTM_CENTRAL:
        a, f = (GRS80_A, GRS80_F) if srid < 30000 else (WGS84_A, WGS84_F)
        fn = _tm_forward if forward else _tm_inverse
        return fn(x, y, UTM_CENTRAL[srid], a, f, UTM_K0, UTM_E0)
    return {3035: _laea, 3857: _web_mercator, 2056: _lv95}[srid](forward, x, y)


def project(x: Column, y: Column, src: int, dst: int) -> Column:
    """``struct<x, y>`` in ``dst`` of a point given in ``src``."""
    for s in (src, dst):
        if s not in SUPPORTED:
            raise ValueError(f"unsupported reference system {s}; use one of {SUPPORTED}")
    geographic = (4326, 4258)
    if src == dst or (src in geographic and dst in geographic):
        return _xy(x.cast("double"), y.cast("double"))
    p = _xy(x.cast("double"), y.cast("double"))
    if src not in geographic:
        p = _with(p, lambda v: _one_way(v["x"], v["y"], src, False))
    return p if dst in geographic else _with(p, lambda v: _one_way(v["x"], v["y"], dst, True))


def reproject_geom(g: Column, src: int, dst: int) -> Column:
    """Every vertex projected; heights are kept."""
    def move(v):
        return _with(project(v[0], v[1], src, dst), lambda p: F.when(
            F.size(v) > 2, F.array(p["x"], p["y"], F.get(v, 2))).otherwise(F.array(p["x"], p["y"])))
    rings = F.transform(g["rings"], lambda r: F.transform(r, move))
    return F.struct(g["kind"].alias("kind"), F.lit(dst).cast("int").alias("srid"), rings.alias("rings"), g["ring_part"].alias("ring_part"))


def reproject(df: DataFrame, src: int, dst: int, geom: str = "geom") -> DataFrame:
    return df.withColumn(geom, reproject_geom(F.col(geom), src, dst))


def reproject_bbox(box: Column, src: int, dst: int, edge_points: int = 21) -> Column:
    """Window in another reference system: points along its edges are projected, then their extent is taken.

    Longitudes and latitudes come out rounded to six decimals, and unchanged when the source is geographic too.
    """
    n = edge_points - 1
    at = lambda lo, hi, i: lo + (hi - lo) * i / n
    seq = F.sequence(F.lit(0), F.lit(n))
    w, s, e, t = (box[k] for k in ("xmin", "ymin", "xmax", "ymax"))
    pts = F.concat(F.transform(seq, lambda i: _xy(at(w, e, i), s + 0.0 * i)), F.transform(seq, lambda i: _xy(at(w, e, i), t + 0.0 * i)),
                   F.transform(seq, lambda i: _xy(w + 0.0 * i, at(s, t, i))), F.transform(seq, lambda i: _xy(e + 0.0 * i, at(s, t, i))))
    moved = F.transform(pts, lambda p: project(p["x"], p["y"], src, dst))

    def extent(m):
        xs, ys = F.transform(m, lambda p: p["x"]), F.transform(m, lambda p: p["y"])
        vals = (("xmin", F.array_min(xs)), ("ymin", F.array_min(ys)), ("xmax", F.array_max(xs)), ("ymax", F.array_max(ys)))
        return F.struct(*[(F.round(v, 6) if dst in (4326, 4258) else v).alias(k) for k, v in vals])

    if src in (4326, 4258) and dst in (4326, 4258):
        return F.struct(*[F.round(box[k], 6).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")])
    return F.when(box.isNotNull(), _with(moved, extent))


def bbox_area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Area in km2 of the polygon through a box's four corners, its sides shortest lines on the WGS84 ellipsoid.

    Worked out on the sphere of equal area: the strip between the equator and a great circle through two points of
    one latitude. For boxes narrower than 180 degrees; a one-degree cell at the equator is tested.
    """
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    b2 = (WGS84_A * (1 - WGS84_F)) ** 2
    pole = 1 / (1 - e * e) + math.atanh(e) / e
    q = lambda lat: (lambda s: s / (1 - e * e * s * s) + F.atanh(e * s) / e)(F.sin(F.radians(lat))) / pole
    half = F.tan(F.radians(east - west) / 2.0)
    return F.abs(F.atan(half * q(north)) - F.atan(half * q(south))) * (b2 * pole) / 1e6
