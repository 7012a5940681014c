"""Geometry as plain columns: constructors, measures and exact predicates.

A geometry is the struct of :data:`geoloom.types.GEOM`. Everything here is a Catalyst expression over the
vertex arrays, so it runs inside the executor JVM and can be used in any ``select``, ``where`` or join residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.types import GEOM

_GEOM_DDL = GEOM.simpleString()


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)


# ---------------------------------------------------------------- constructors

def make_geom(kind: str | Column, rings: Column, srid=None, ring_part: Column | None = None) -> Column:
    """Geometry struct from its rings; without ``ring_part`` all rings belong to part 0."""
    part = ring_part if ring_part is not None else F.transform(rings, lambda r: F.lit(0))
    return F.struct(
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
        (srid if isinstance(srid, Column) else F.lit(srid)).cast("int").alias("srid"),
        rings.cast("array<array<array<double>>>").alias("rings"),
        part.cast("array<int>").alias("ring_part"),
    )


def vertex(x, y) -> Column:
    return F.array(_c(x).cast("double"), _c(y).cast("double"))


def point(x, y, srid=None) -> Column:
    return make_geom("POINT", F.array(F.array(vertex(x, y))), srid)


def box_ring(x0, y0, x1, y1) -> Column:
    """Counter-clockwise closed ring of an axis-parallel box."""
    return F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0))


def box(x0, y0, x1, y1, srid=None) -> Column:
    return make_geom("POLYGON", F.array(box_ring(x0, y0, x1, y1)), srid)


def line(*xy: tuple, srid=None) -> Column:
    return make_geom("LINE", F.array(F.array(*[vertex(x, y) for x, y in xy])), srid)


def line_from_points(seq_points: Column, srid=None) -> Column:
    """Polyline from an array of ``struct(order, x, y)``: ordered, consecutive repeats dropped, NULL below 2 points."""
    # plain sorting is compiled, sorting by a comparator is not; they differ in where missing points go
    points = F.when(F.exists(seq_points, lambda s: s.isNull()), F.array_sort(seq_points)).otherwise(F.sort_array(seq_points))
    ordered = F.transform(points, lambda s: F.array(s["x"].cast("double"), s["y"].cast("double")))
    return _bound(drop_repeats(ordered), lambda kept: F.when(F.size(kept) >= 2, make_geom("LINE", F.array(kept), srid)))


def drop_repeats(vertices: Column) -> Column:
    return _bound(vertices, lambda v: F.filter(v, lambda p, i: (i == 0) | (p != F.get(v, i - 1))))


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once: inside a lambda it would be worked out again for every element."""
    return F.transform(F.array(value), then)[0]


def buffer_point(x, y, distance, srid=None, segments_per_quarter: int = 5) -> Column:
    """Circle polygon around a point."""
    n = 4 * segments_per_quarter
    step = F.lit(2.0) * F.pi() / n
    ring = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.array(
        _c(x) + _c(distance) * F.cos((i % n) * step), _c(y) + _c(distance) * F.sin((i % n) * step)))
    return make_geom("POLYGON", F.array(ring), srid)


# ---------------------------------------------------------------- structure

def rings(g: Column) -> Column:
    return g["rings"]


def _pairs(ring: Column) -> Column:
    return F.zip_with(
        F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.size(ring)),
        lambda p, q: F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")))


def segments(g: Column) -> Column:
    """All segments of all rings/paths as ``array<struct<x1,y1,x2,y2>>``."""
    return F.flatten(F.transform(rings(g), _pairs))


def vertices(g: Column) -> Column:
    return F.flatten(rings(g))


def is_shell(g: Column, i: Column) -> Column:
    return (i == 0) | (F.get(g["ring_part"], i) != F.get(g["ring_part"], i - 1))


def bbox(g: Column) -> Column:
    v = vertices(g)
    xs, ys = F.transform(v, lambda p: p[0]), F.transform(v, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def with_bbox(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Add plain ``xmin..ymax`` columns, so window filters reach the Parquet scan of a stored layer."""
    b = df.withColumn("_b", bbox(F.col(geom)))
    return b.select(*df.columns, *[F.col("_b")[k].alias(k) for k in ("xmin", "ymin", "xmax", "ymax")])


def num_parts(g: Column) -> Column:
    return F.size(F.array_distinct(g["ring_part"]))


def num_vertices(g: Column) -> Column:
    return F.aggregate(rings(g), F.lit(0), lambda a, r: a + F.size(r))


def count_holes(g: Column) -> Column:
    return F.when(g["kind"] == "POLYGON", F.size(rings(g)) - num_parts(g)).otherwise(0)


def is_empty(g: Column) -> Column:
    return g.isNotNull() & (F.size(F.filter(rings(g), lambda r: F.size(r) > 0)) == 0)


def parts(g: Column) -> Column:
    """Single-part geometries of ``g`` as an array."""
    return F.transform(F.array_distinct(g["ring_part"]), lambda p: make_geom(
        g["kind"], F.filter(rings(g), lambda r, i: F.get(g["ring_part"], i) == p), g["srid"]))


# ---------------------------------------------------------------- measures

def _ring_area2(ring: Column) -> Column:
    """Twice the signed area of a closed ring, taken relative to its first vertex."""
    x0, y0 = ring[0][0], ring[0][1]
    return F.aggregate(_pairs(ring), F.lit(0.0), lambda a, s: a + (
        (s["x1"] - x0) * (s["y2"] - y0) - (s["x2"] - x0) * (s["y1"] - y0)))


def ring_area(ring: Column) -> Column:
    return F.abs(_ring_area2(ring)) / 2.0


def area(g: Column) -> Column:
    """Shell areas minus hole areas; 0 for points and lines."""
    signed = F.transform(rings(g), lambda r, i: F.when(is_shell(g, i), ring_area(r)).otherwise(-ring_area(r)))
    return F.when(g["kind"] == "POLYGON", F.aggregate(signed, F.lit(0.0), lambda a, v: a + v)).when(
        g["kind"].isNotNull(), F.lit(0.0))


def seg_length(s: Column) -> Column:
    return F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"])


def length(g: Column) -> Column:
    """Line length, or the perimeter including hole rings."""
    return F.when(g["kind"] == "POINT", F.lit(0.0)).otherwise(
        F.aggregate(segments(g), F.lit(0.0), lambda a, s: a + seg_length(s)))


def centroid(g: Column) -> Column:
    """``struct<x, y>``: area-weighted for polygons, length-weighted for lines, mean for points."""
    ox, oy = rings(g)[0][0][0], rings(g)[0][0][1]

    def add(acc, w, x, y):
        return F.struct((acc["w"] + w).alias("w"), (acc["x"] + w * x).alias("x"), (acc["y"] + w * y).alias("y"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def ring_moment(r, i):
        sign = F.signum(_ring_area2(r)) * F.when(is_shell(g, i), 1.0).otherwise(-1.0)
        return F.transform(_pairs(r), lambda s: F.struct(
            (sign * ((s["x1"] - ox) * (s["y2"] - oy) - (s["x2"] - ox) * (s["y1"] - oy))).alias("w"),
            ((s["x1"] - ox + s["x2"] - ox) / 3.0).alias("x"), ((s["y1"] - oy + s["y2"] - oy) / 3.0).alias("y")))

    poly = F.flatten(F.transform(rings(g), ring_moment))
    lin = F.transform(segments(g), lambda s: F.struct(
        seg_length(s).alias("w"), ((s["x1"] + s["x2"]) / 2.0 - ox).alias("x"),
        ((s["y1"] + s["y2"]) / 2.0 - oy).alias("y")))
    pts = F.transform(vertices(g), lambda p: F.struct(
        F.lit(1.0).alias("w"), (p[0] - ox).alias("x"), (p[1] - oy).alias("y")))
    terms = F.when(g["kind"] == "POLYGON", poly).when(g["kind"] == "LINE", lin).otherwise(pts)
    total = F.aggregate(terms, zero, lambda a, t: add(a, t["w"], t["x"], t["y"]))
    # one aggregate evaluated once: bind it through a one-element array
    return F.transform(F.array(total), lambda t: F.struct(
        (ox + F.try_divide(t["x"], t["w"])).alias("x"), (oy + F.try_divide(t["y"], t["w"])).alias("y")))[0]


def newell_normal(ring: Column) -> Column:
    """Un-normalised facet normal of a closed 3-D ring (Newell's method); length = twice the facet area."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring)),
                       lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    zero = F.struct(F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nz"))
    return F.aggregate(pairs, zero, lambda a, s: F.struct(
        (a["nx"] + (s["p"][1] - s["q"][1]) * (s["p"][2] + s["q"][2])).alias("nx"),
        (a["ny"] + (s["p"][2] - s["q"][2]) * (s["p"][0] + s["q"][0])).alias("ny"),
        (a["nz"] + (s["p"][0] - s["q"][0]) * (s["p"][1] + s["q"][1])).alias("nz")))


def face_orientation(ring: Column) -> Column:
    """``struct<slope, azimuth>`` in degrees; slope 0 = flat, azimuth clockwise from north, NULL when flat."""
    return F.transform(F.array(newell_normal(ring)), lambda n: F.struct(
        F.degrees(F.atan2(F.hypot(n["nx"], n["ny"]), F.abs(n["nz"]))).alias("slope"),
        F.when(F.hypot(n["nx"], n["ny"]) > 1e-12, F.pmod(F.degrees(F.atan2(
            n["nx"] * F.signum(n["nz"] + 1e-300), n["ny"] * F.signum(n["nz"] + 1e-300))) + 360.0, F.lit(360.0))
        ).alias("azimuth")))[0]


# ---------------------------------------------------------------- segment tests

def _orient(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def on_segment(s: Column, x, y) -> Column:
    return ((_orient(s["x1"], s["y1"], s["x2"], s["y2"], x, y) == 0)
            & (x >= F.least(s["x1"], s["x2"])) & (x <= F.greatest(s["x1"], s["x2"]))
            & (y >= F.least(s["y1"], s["y2"])) & (y <= F.greatest(s["y1"], s["y2"])))


def _let(value: Column, test) -> Column:
    """``test(value)`` with ``value`` evaluated once: higher-order functions do not share common subexpressions."""
    return F.exists(F.array(value), test)


def _sides(s: Column, t: Column) -> Column:
    """Which side of each segment the other's ends lie on."""
    return F.struct(
        _orient(t["x1"], t["y1"], t["x2"], t["y2"], s["x1"], s["y1"]).alias("a"),
        _orient(t["x1"], t["y1"], t["x2"], t["y2"], s["x2"], s["y2"]).alias("b"),
        _orient(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"]).alias("c"),
        _orient(s["x1"], s["y1"], s["x2"], s["y2"], t["x2"], t["y2"]).alias("d"))


def _boxes_meet(s: Column, t: Column) -> Column:
    lo, hi = F.least, F.greatest
    return ((lo(s["x1"], s["x2"]) <= hi(t["x1"], t["x2"])) & (lo(t["x1"], t["x2"]) <= hi(s["x1"], s["x2"]))
            & (lo(s["y1"], s["y2"]) <= hi(t["y1"], t["y2"])) & (lo(t["y1"], t["y2"]) <= hi(s["y1"], s["y2"])))


def segments_meet(s: Column, t: Column) -> Column:
    """The closed segments share at least one point: boxes meet and neither lies strictly to one side of the other."""
    return _boxes_meet(s, t) & _let(_sides(s, t), lambda d: (
        F.signum(d["a"]) * F.signum(d["b"]) <= 0) & (F.signum(d["c"]) * F.signum(d["d"]) <= 0))


def segments_cross(s: Column, t: Column) -> Column:
    """The open segments cross at one interior point of both."""
    return _boxes_meet(s, t) & _let(_sides(s, t), lambda d: (
        F.signum(d["a"]) * F.signum(d["b"]) < 0) & (F.signum(d["c"]) * F.signum(d["d"]) < 0))


def locate(segs: Column, x, y) -> Column:
    """1 = strictly inside the area bounded by ``segs``, 0 = on the boundary, -1 = outside (even-odd rule)."""
    crossings = F.size(F.filter(segs, lambda s: ((s["y1"] > y) != (s["y2"] > y)) & (
        x < (s["x2"] - s["x1"]) * (y - s["y1"]) / F.nullif(s["y2"] - s["y1"], F.lit(0.0)) + s["x1"])))
    return F.when(F.exists(segs, lambda s: on_segment(s, x, y)), 0).when(crossings % 2 == 1, 1).otherwise(-1)


def point_in_polygon(g: Column, x, y) -> Column:
    return locate(segments(g), _c(x), _c(y))


def point_segment_distance(s: Column, x, y) -> Column:
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    t = F.coalesce(F.try_divide((x - s["x1"]) * dx + (y - s["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - s["x1"] - t * dx, y - s["y1"] - t * dy)


def distance_to_point(g: Column, x, y) -> Column:
    """Distance from a geometry to a point; 0 inside a polygon."""
    x, y = _c(x), _c(y)
    segs = segments(g)
    to_vertices = F.array_min(F.transform(vertices(g), lambda p: F.hypot(p[0] - x, p[1] - y)))
    to_segments = F.array_min(F.transform(segs, lambda s: point_segment_distance(s, x, y)))
    return F.when(g["kind"] == "POINT", to_vertices).when(
        (g["kind"] == "POLYGON") & (locate(segs, x, y) >= 0), F.lit(0.0)).otherwise(to_segments)


# ---------------------------------------------------------------- pairwise area and length

def _trapezoid(s: Column, y0) -> Column:
    """Edge as left-to-right ``struct<xa, ya, xb, yb, sign>`` over the base line ``y0``."""
    fwd = s["x1"] <= s["x2"]
    return F.struct(
        F.least(s["x1"], s["x2"]).alias("xa"), (F.when(fwd, s["y1"]).otherwise(s["y2"]) - y0).alias("ya"),
        F.greatest(s["x1"], s["x2"]).alias("xb"), (F.when(fwd, s["y2"]).otherwise(s["y1"]) - y0).alias("yb"),
        F.when(fwd, -1.0).otherwise(1.0).alias("sign"))


def oriented_segments(g: Column) -> Column:
    """Segments with shells counter-clockwise and holes clockwise, so the interior lies to the left."""
    def turned(r, i):
        want = F.when(is_shell(g, i), 1.0).otherwise(-1.0)
        return _pairs(F.when(F.signum(_ring_area2(r)) == want, r).otherwise(F.reverse(r)))
    return F.flatten(F.transform(rings(g), turned))


def overlap_area_segments(a: Column, b: Column) -> Column:
    """Exact shared area of two polygons given as oriented segments.

    Each polygon is the signed sum of the trapezoids under its edges, so the shared area is the signed sum,
    over all edge pairs, of the area below both edges - the integral of the smaller of two linear functions.
    """
    y0 = F.least(F.array_min(F.transform(a, lambda s: F.least(s["y1"], s["y2"]))),
                 F.array_min(F.transform(b, lambda s: F.least(s["y1"], s["y2"]))))

    def at(t, x):
        return t["ya"] + (t["yb"] - t["ya"]) * (x - t["xa"]) / (t["xb"] - t["xa"])

    def under_both(p, q):
        """Area below both edges where their spans meet: heights at both ends of the common span, then the smaller."""
        span = F.struct(F.greatest(p["xa"], q["xa"]).alias("lo"), F.least(p["xb"], q["xb"]).alias("hi"))
        ends = F.transform(F.filter(F.array(span), lambda s: s["lo"] < s["hi"]), lambda s: F.struct(
            (s["hi"] - s["lo"]).alias("w"), at(p, s["lo"]).alias("pl"), at(p, s["hi"]).alias("ph"),
            at(q, s["lo"]).alias("ql"), at(q, s["hi"]).alias("qh")))
        # edges that cross inside the span meet a share t of the way along
        tt = lambda e: (e["pl"] - e["ql"]) / (e["pl"] - e["ql"] - e["ph"] + e["qh"])
        area_of = lambda e: F.when(
            (e["pl"] - e["ql"]) * (e["ph"] - e["qh"]) < 0,
            F.aggregate(F.transform(F.array(tt(e)), lambda t: F.struct(
                t.alias("t"), (e["pl"] + (e["ph"] - e["pl"]) * t).alias("m"))), F.lit(0.0), lambda z, k: z + e["w"] * (
                k["t"] * (F.least(e["pl"], e["ql"]) + k["m"]) + (1.0 - k["t"]) * (k["m"] + F.least(e["ph"], e["qh"]))) / 2.0)
        ).otherwise(e["w"] * (F.least(e["pl"], e["ql"]) + F.least(e["ph"], e["qh"])) / 2.0)
        return F.aggregate(ends, F.lit(0.0), lambda z, e: z + p["sign"] * q["sign"] * area_of(e))

    tb = F.transform(F.filter(b, lambda s: s["x1"] != s["x2"]), lambda s: _trapezoid(s, y0))
    ta = F.transform(F.filter(a, lambda s: s["x1"] != s["x2"]), lambda s: _trapezoid(s, y0))
    return F.aggregate(ta, F.lit(0.0), lambda acc, p: acc + F.aggregate(
        tb, F.lit(0.0), lambda part, q: part + under_both(p, q)))


def overlap_area(a: Column, b: Column) -> Column:
    return F.when((a["kind"] == "POLYGON") & (b["kind"] == "POLYGON"),
                  overlap_area_segments(oriented_segments(a), oriented_segments(b))).otherwise(0.0)


def _cut_params(s: Column, others: Column) -> Column:
    """Positions 0..1 along ``s`` at which any segment of ``others`` meets it, including both ends."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    len2 = dx * dx + dy * dy

    def params(o):
        den = dx * (o["y2"] - o["y1"]) - dy * (o["x2"] - o["x1"])
        t = ((o["x1"] - s["x1"]) * (o["y2"] - o["y1"]) - (o["y1"] - s["y1"]) * (o["x2"] - o["x1"])) / F.nullif(den, F.lit(0.0))
        along = lambda x, y: ((x - s["x1"]) * dx + (y - s["y1"]) * dy) / F.nullif(len2, F.lit(0.0))
        return F.when(segments_meet(s, o), F.when(den != 0, F.array(t)).otherwise(
            F.array(along(o["x1"], o["y1"]), along(o["x2"], o["y2"])))).otherwise(F.array().cast("array<double>"))

    inner = F.flatten(F.transform(others, params))
    return F.array_sort(F.array_distinct(F.concat(
        F.array(F.lit(0.0), F.lit(1.0)), F.filter(inner, lambda t: (t > 0) & (t < 1)))))


def line_shares(segs: Column, poly: Column) -> Column:
    """``struct<inside, edge, outside>``: lengths of a line inside, along and outside a polygon's boundary."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("inside", "edge", "outside")])

    def pieces(s):
        ts = _cut_params(s, poly)
        return F.transform(F.zip_with(F.slice(ts, 1, F.size(ts) - 1), F.slice(ts, 2, F.size(ts)),
                                      lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                           lambda p: F.struct(
                               ((p["b"] - p["a"]) * seg_length(s)).alias("len"),
                               _locate_soft(poly, s["x1"] + (p["a"] + p["b"]) / 2.0 * (s["x2"] - s["x1"]),
                                            s["y1"] + (p["a"] + p["b"]) / 2.0 * (s["y2"] - s["y1"])).alias("at")))

    return F.aggregate(F.flatten(F.transform(segs, pieces)), zero, lambda acc, p: F.struct(
        (acc["inside"] + F.when(p["at"] == 1, p["len"]).otherwise(0.0)).alias("inside"),
        (acc["edge"] + F.when(p["at"] == 0, p["len"]).otherwise(0.0)).alias("edge"),
        (acc["outside"] + F.when(p["at"] == -1, p["len"]).otherwise(0.0)).alias("outside")))


def _locate_soft(segs: Column, x, y) -> Column:
    """Like :func:`locate`, with a boundary 1e-9 wide: midpoints of cut pieces carry rounding."""
    return F.when(F.exists(segs, lambda s: point_segment_distance(s, x, y) <= 1e-9), 0).otherwise(locate(segs, x, y))


# ---------------------------------------------------------------- spatial predicates on prepared sides

PREDICATES = ("intersects", "contains", "disjoint", "equals", "touches", "overlaps", "within", "crosses")


PREPARED = ("kind", "pts", "segs", "area", "length", "bbox")


def prepared(g: Column) -> Column:
    """What the pair predicates need of one geometry, computed once per row before a join."""
    return F.struct(
        g["kind"].alias("kind"), vertices(g).alias("pts"),
        F.when(g["kind"] == "POLYGON", oriented_segments(g)).otherwise(segments(g)).alias("segs"),
        area(g).alias("area"), length(g).alias("length"), bbox(g).alias("bbox"))


def _any_vertex(p: Column, other: Column, where) -> Column:
    return F.exists(p["pts"], lambda v: where(locate(other["segs"], v[0], v[1])))


def _points_meet(a: dict, b: dict) -> Column:
    return F.exists(a["pts"], lambda p: F.exists(b["pts"], lambda q: (p[0] == q[0]) & (p[1] == q[1])))


def _point_meets(p: dict, o: dict, kind: str) -> Column:
    if kind == "POLYGON":
        return _any_vertex(p, o, lambda at: at >= 0)
    return F.exists(p["pts"], lambda v: F.exists(o["segs"], lambda s: on_segment(s, v[0], v[1])))


def _meets(a: dict, b: dict, ka: str, kb: str) -> Column:
    """The two geometries, of the given kinds, share at least one point."""
    if ka == kb == "POINT":
        return _points_meet(a, b)
    if ka == "POINT":
        return _point_meets(a, b, kb)
    if kb == "POINT":
        return _point_meets(b, a, ka)
    out = F.exists(a["segs"], lambda s: F.exists(b["segs"], lambda t: segments_meet(s, t)))
    if kb == "POLYGON":
        out = out | _any_vertex(a, b, lambda at: at >= 0)
    if ka == "POLYGON":
        out = out | _any_vertex(b, a, lambda at: at >= 0)
    return out


def pair_intersects(a: Column, b: Column) -> Column:
    return pair_predicate("intersects", a, b)


def _same(u: Column, v: Column) -> Column:
    return F.abs(u - v) <= 1e-9 * F.greatest(F.abs(u), F.abs(v), F.lit(1.0))


def _shared_length(a: Column, b: Column) -> Column:
    """Length that two lines have in common."""
    def common(s, t):
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        n = F.nullif(dx * dx + dy * dy, F.lit(0.0))
        u = ((t["x1"] - s["x1"]) * dx + (t["y1"] - s["y1"]) * dy) / n
        v = ((t["x2"] - s["x1"]) * dx + (t["y2"] - s["y1"]) * dy) / n
        col = ((_orient(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"]) == 0)
               & (_orient(s["x1"], s["y1"], s["x2"], s["y2"], t["x2"], t["y2"]) == 0))
        span = F.least(F.greatest(u, v), F.lit(1.0)) - F.greatest(F.least(u, v), F.lit(0.0))
        return F.when(col, F.greatest(F.coalesce(span, F.lit(0.0)), F.lit(0.0)) * seg_length(s)).otherwise(0.0)
    return F.aggregate(a["segs"], F.lit(0.0), lambda x, s: x + F.aggregate(
        b["segs"], F.lit(0.0), lambda y, t: y + common(s, t)))


KINDS = ("POINT", "LINE", "POLYGON")


def pair_predicate(name: str, a, b, a_kinds=KINDS, b_kinds=KINDS) -> Column:
    """One of :data:`PREDICATES` between two :func:`prepared` sides (structs, or dicts of their fields).

    Boundary contact alone is ``touches``; ``contains``/``within`` need shared interior; ``overlaps`` needs equal
    dimension and excludes containment and equality; ``crosses`` is for line/line and line/polygon pairs. Rules are
    built for the listed kinds only.
    """
    if name not in PREDICATES:
        raise ValueError(f"unknown predicate {name!r}; use one of {PREDICATES}")
    if name == "disjoint":
        return ~pair_predicate("intersects", a, b, a_kinds, b_kinds)
    if name == "within":
        return pair_predicate("contains", b, a, b_kinds, a_kinds)
    rule = None
    for ka in a_kinds:
        for kb in b_kinds:
            test = (a["kind"] == ka) & (b["kind"] == kb)
            value = _rule(name, a, b, ka, kb)
            rule = F.when(test, value) if rule is None else rule.when(test, value)
    return F.coalesce(rule, F.lit(False)) if rule is not None else F.lit(False)


def _rule(name: str, a, b, ka: str, kb: str) -> Column:
    dim = {"POINT": 0, "LINE": 1, "POLYGON": 2}
    if name == "intersects":
        return _meets(a, b, ka, kb)
    if name == "touches":
        return _meets(a, b, ka, kb) & _interiors_apart(a, b, ka, kb)
    if name == "contains":
        return _contains(a, b, ka, kb) if dim[ka] >= dim[kb] else F.lit(False)
    if name == "crosses":
        if {ka, kb} == {"LINE", "POLYGON"}:
            l, p = (a, b) if ka == "LINE" else (b, a)
            return _with_shares(l, p, lambda s: (s["outside"] > 1e-9) & (s["inside"] > 1e-9))
        return _lines_cross(a, b) & (_shared_length(a, b) <= 1e-9) if ka == kb == "LINE" else F.lit(False)
    if ka != kb:
        return F.lit(False)
    if ka == "POINT":
        all_a = F.forall(a["pts"], lambda q: F.array_contains(b["pts"], q))
        all_b = F.forall(b["pts"], lambda q: F.array_contains(a["pts"], q))
        return all_a & all_b if name == "equals" else _points_meet(a, b) & ~all_a & ~all_b
    shared = _shared_length(a, b) if ka == "LINE" else overlap_area_segments(a["segs"], b["segs"])
    whole = "length" if ka == "LINE" else "area"
    bound = F.transform(F.array(shared), lambda v: F.struct(
        (v > 1e-9 * F.least(a[whole], b[whole])).alias("some"), _same(v, a[whole]).alias("a"), _same(v, b[whole]).alias("b")))[0]
    test = (lambda r: r["some"] & r["a"] & r["b"]) if name == "equals" else (lambda r: r["some"] & ~r["a"] & ~r["b"])
    return _let(bound, test)


def _with_shares(l, p, test) -> Column:
    return _let(line_shares(l["segs"], p["segs"]), test)


def _ends(l) -> Column:
    return F.array(l["pts"][0], F.element_at(l["pts"], -1))


def _lines_cross(a, b) -> Column:
    """Two lines meet at a point interior to both."""
    inner = lambda l: F.filter(l["pts"], lambda v: ~F.array_contains(_ends(l), v))
    passes = lambda l, o: F.exists(inner(l), lambda v: F.exists(
        o["segs"], lambda t: on_segment(t, v[0], v[1])) & ~F.array_contains(_ends(o), v))
    return F.exists(a["segs"], lambda s: F.exists(b["segs"], lambda t: segments_cross(s, t))) | passes(a, b) | passes(b, a)


def _contains(a, b, ka: str, kb: str) -> Column:
    if ka == kb == "POLYGON":
        shared = overlap_area_segments(a["segs"], b["segs"])
        return _let(shared, lambda v: (v > 1e-9 * F.least(a["area"], b["area"])) & _same(v, b["area"]))
    if kb == "POINT" and ka == "POLYGON":
        return F.forall(b["pts"], lambda v: locate(a["segs"], v[0], v[1]) >= 0) & _any_vertex(b, a, lambda at: at == 1)
    if ka == "POLYGON":
        return _with_shares(b, a, lambda s: (s["outside"] <= 1e-9) & (s["inside"] > 1e-9))
    if ka == kb == "LINE":
        return _same(_shared_length(a, b), b["length"])
    if ka == "LINE":
        return F.forall(b["pts"], lambda v: F.exists(a["segs"], lambda s: on_segment(s, v[0], v[1]))) & F.exists(
            b["pts"], lambda v: ~F.array_contains(_ends(a), v))
    return F.forall(b["pts"], lambda q: F.array_contains(a["pts"], q))


def _interiors_apart(a, b, ka: str, kb: str) -> Column:
    kinds = {ka, kb}
    if ka == kb == "POLYGON":
        return overlap_area_segments(a["segs"], b["segs"]) <= 1e-9 * F.least(a["area"], b["area"])
    if kinds == {"LINE", "POLYGON"}:
        l, p = (a, b) if ka == "LINE" else (b, a)
        return _with_shares(l, p, lambda s: s["inside"] <= 1e-9)
    if kinds == {"POINT", "POLYGON"}:
        q, p = (a, b) if ka == "POINT" else (b, a)
        return ~_any_vertex(q, p, lambda at: at == 1)
    if kinds == {"POINT", "LINE"}:
        q, l = (a, b) if ka == "POINT" else (b, a)
        on_inner = lambda v: F.exists(l["segs"], lambda s: on_segment(s, v[0], v[1])) & ~F.array_contains(_ends(l), v)
        return ~F.exists(q["pts"], on_inner)
    if ka == kb == "LINE":
        return (_shared_length(a, b) <= 1e-9) & ~_lines_cross(a, b)
    return F.lit(False)


# ---------------------------------------------------------------- validity

def _self_hits(segs: Column, closed: bool) -> Column:
    """Some two segments of one path meet other than at the vertex that neighbours share."""
    n = F.size(segs)

    def bad(a, b):
        s, t, i, j = a["s"], b["s"], a["i"], b["i"]
        # neighbours share one vertex; they are bad only when one folds back onto the other
        next_to = F.when(j == i + 1, F.struct(s["x1"].alias("ux"), s["y1"].alias("uy"), s["x2"].alias("vx"), s["y2"].alias("vy"),
                                              t["x2"].alias("wx"), t["y2"].alias("wy"))).when(
            F.lit(closed) & (i == 0) & (j == n - 1), F.struct(
                s["x2"].alias("ux"), s["y2"].alias("uy"), s["x1"].alias("vx"), s["y1"].alias("vy"),
                t["x1"].alias("wx"), t["y1"].alias("wy")))
        folds = lambda k: ((_orient(k["ux"], k["uy"], k["vx"], k["vy"], k["wx"], k["wy"]) == 0) & (
            (k["ux"] - k["vx"]) * (k["wx"] - k["vx"]) + (k["uy"] - k["vy"]) * (k["wy"] - k["vy"]) > 0))
        return (j > i) & _boxes_meet(s, t) & _let(next_to, lambda k: F.when(k.isNull(), segments_meet(s, t)).otherwise(folds(k)))

    tagged = F.transform(segs, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.exists(tagged, lambda a: F.exists(tagged, lambda b: bad(a, b)))


def _ring_segments(ring: Column) -> Column:
    return F.filter(_pairs(ring), lambda s: (s["x1"] != s["x2"]) | (s["y1"] != s["y2"]))


LONG = 64                    # vertices beyond which edges are compared by cells, in Arrow batches, with the same answers


def _by_cells(name: str, *columns: Column) -> Column:
    from geoloom.functions import rings as long_rings
    return F.arrow_udf(getattr(long_rings, name), "boolean")(*columns)


def is_valid(g: Column) -> Column:
    """Rings closed, at least four points, no ring meets itself, rings do not cross, holes lie in their shell."""
    long = num_vertices(g) > LONG
    only = lambda c: F.when(long, c)
    return F.when(_sound_quad(g), True).when((g["kind"] == "POLYGON") & long, _by_cells(
        "valid_batch", only(g["rings"]), only(g["ring_part"]))).otherwise(_is_valid_short(g))


def _sound_quad(g: Column) -> Column:
    """One closed ring of four corners that turns at each of them and whose opposite edges lie clear of each other.

    Most buildings are such rings. What the full test compares edge by edge is written out here, so that it runs as
    plain arithmetic; only a yes counts, everything else takes the full test.
    """
    ring = F.get(g["rings"], F.lit(0))
    p = [F.get(ring, F.lit(i)) for i in range(5)]
    x, y = [F.get(v, F.lit(0)) for v in p], [F.get(v, F.lit(1)) for v in p]
    turn = lambda a, b, c: _orient(x[a], y[a], x[b], y[b], x[c], y[c])
    clear = lambda a, b, c, d: ((F.signum(turn(c, d, a)) * F.signum(turn(c, d, b)) > 0)
                                | (F.signum(turn(a, b, c)) * F.signum(turn(a, b, d)) > 0))
    out = (g["kind"] == "POLYGON") & (F.size(g["rings"]) == 1) & (F.size(ring) == 5) & (p[0] == p[4])
    for a, b, c in ((0, 1, 2), (1, 2, 3), (2, 3, 4), (1, 0, 3)):
        out = out & (turn(a, b, c) != 0)
    return out & clear(0, 1, 2, 3) & clear(1, 2, 3, 4)


def _is_valid_short(g: Column) -> Column:
    ring_ok = F.forall(rings(g), lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1))
                       & ~_self_hits(_ring_segments(r), True))
    tagged = F.transform(rings(g), lambda r, i: F.struct(
        _pairs(r).alias("segs"), r.alias("ring"), i.alias("i"), is_shell(g, i).alias("shell"),
        F.get(g["ring_part"], i).alias("part")))
    many = F.size(rings(g)) > 1
    cross = many & F.exists(tagged, lambda a: F.exists(tagged, lambda b: (a["i"] < b["i"]) & F.exists(
        a["segs"], lambda s: F.exists(b["segs"], lambda t: segments_cross(s, t)))))
    stray_hole = many & F.exists(tagged, lambda h: ~h["shell"] & F.exists(tagged, lambda s: s["shell"] & (
        s["part"] == h["part"]) & F.exists(h["ring"], lambda v: locate(s["segs"], v[0], v[1]) == -1)))
    nested = many & F.exists(tagged, lambda a: a["shell"] & F.exists(tagged, lambda b: b["shell"] & (a["i"] != b["i"]) & F.forall(
        a["ring"], lambda v: locate(b["segs"], v[0], v[1]) == 1)))
    poly = ring_ok & ~cross & ~stray_hole & (~nested)
    return F.when(g["kind"] == "POLYGON", is_empty(g) | poly).when(
        g["kind"] == "LINE", F.forall(rings(g), lambda r: F.size(F.array_distinct(r)) >= 2) | is_empty(g)).when(
        g["kind"].isNotNull(), F.lit(True))


def is_simple(g: Column) -> Column:
    """No line crosses or touches itself (a closed line may meet at its ends)."""
    long = num_vertices(g) > LONG
    return F.when((g["kind"] == "LINE") & long, _by_cells("simple_batch", F.when(long, g["rings"]))).otherwise(_is_simple_short(g))


def _is_simple_short(g: Column) -> Column:
    def path_ok(r):
        segs = _ring_segments(r)
        return ~F.when(r[0] == F.element_at(r, -1), _self_hits(segs, True)).otherwise(_self_hits(segs, False))
    return F.when(g["kind"] == "LINE", F.forall(rings(g), path_ok)).when(
        g["kind"].isNotNull(), F.lit(True))
