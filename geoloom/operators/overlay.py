"""Polygon overlay, clip, dissolve and coverage checks as one distributed edge arrangement.

All three ask the same question of every piece of boundary: what covers the ground on its left and on its right?
Edges are split where they meet (a cell join of edges), pieces lying on each other become one, the two sides of each
piece are looked up with a point-in-polygon join, and a piece bounds an output region exactly when the region holds one
side only. Everything is joins and grouped aggregates; the plane is never gathered anywhere.

A polygon that nothing of its group or of the other layer comes near keeps its own boundary and takes no part in this.

Coordinates are snapped to a grid of 0.1 mm before splitting, and points beside a piece lie 0.5 mm from it; in layers in
degrees both are given in degrees. Regions narrower than 1 mm are below this resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators.cells import pair_by_cell
from geoloom.operators.filters import GEOGRAPHIC_SRIDS
from geoloom.operators.graph import ring_areas, rings_to_table, stitch_rings
from geoloom.operators.skew import salted_join
from geoloom.operators.spatial import points_in_polygons
from geoloom.session import cut_lineage

# side points must lie farther from a piece than snapping can have moved it
GRID, EPS = 1e-4, 5e-4
CELL = 1000.0
DEGREE = 1e5                 # metres, near enough for choosing steps


def steps(*layers: DataFrame, geom: str = "geom", cell: float | None = None) -> tuple[int | None, float, float, float]:
    """``(srid, cell, grid, eps)`` for layers that lie in one reference system; several are refused."""
    found = None
    for layer in layers:
        one = layer.where(F.col(geom).isNotNull()).select(F.col(geom)["srid"].alias("srid"))
        found = one if found is None else found.unionByName(one)
    srids = [r["srid"] for r in found.distinct().limit(3).collect()]
    if len(srids) > 1:
        raise ValueError(f"layers in one reference system needed, found {sorted(srids, key=str)}")
    srid = srids[0] if srids else None
    unit = DEGREE if srid in GEOGRAPHIC_SRIDS else 1.0
    return srid, cell or CELL / unit, GRID / unit, EPS / unit


def _edges(layer: DataFrame, geom: str, grid: float) -> DataFrame:
    s = layer.where(F.col(geom)["kind"] == "POLYGON").select(F.explode(G.segments(F.col(geom))).alias("s"))
    r = lambda c: F.bround(F.col(c) / grid) * grid
    e = s.select(*[r(f"s.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    swap = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    return e.select(*_left_to_right(swap)).where("x1 <> x2 or y1 <> y2").distinct()


def _left_to_right(swap: Column) -> list[Column]:
    return [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (
        ("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]


def _edge_box() -> Column:
    return F.struct(F.col("x1").alias("xmin"), F.least("y1", "y2").alias("ymin"), F.col("x2").alias("xmax"),
                    F.greatest("y1", "y2").alias("ymax"))


def split_edges(edges: DataFrame, cell: float, grid: float = GRID) -> DataFrame:
    """Edges cut at every point where they meet another edge; each piece once, left-to-right."""
    return pieces_of(edges, cell, grid).select(*_PIECE).distinct()


def pieces_of(edges: DataFrame, cell: float, grid: float = GRID) -> DataFrame:
    """The same with the edge each piece comes from, ``l``, and ``turned`` where the two point in opposite directions."""
    e = cut_lineage(edges)
    # cells of twice the usual edge: few strangers meet in one, and an edge lies in few
    usual = e.agg(F.avg(F.greatest(F.col("x2") - F.col("x1"), F.abs(F.col("y2") - F.col("y1"))))).first()[0]
    cell = min(cell, max(2 * usual, grid)) if usual else cell
    pairs = pair_by_cell(e, e.select("*"), _edge_box(), _edge_box(), cell, salt_by=["x1", "y1", "x2", "y2"])
    whole = lambda p: F.struct(*[F.col(f"{p}{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    pairs = pairs.select(whole("l_").alias("s"), whole("r_").alias("o")).where("s <> o").where(
        G.segments_meet(F.col("s"), F.col("o")))
    r = lambda v: F.bround(v / grid) * grid
    # the meeting point is worked out from the lesser edge for both edges of a pair, so both are cut at the same place
    m = pairs.withColumn("a", F.least("s", "o")).withColumn("b", F.greatest("s", "o"))
    dx, dy = F.col("a.x2") - F.col("a.x1"), F.col("a.y2") - F.col("a.y1")
    ex, ey = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    den = dx * ey - dy * ex
    t = ((F.col("b.x1") - F.col("a.x1")) * ey - (F.col("b.y1") - F.col("a.y1")) * ex) / F.nullif(den, F.lit(0.0))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    meet = F.when(den != 0, F.array(pt(r(F.col("a.x1") + t * dx), r(F.col("a.y1") + t * dy)))).otherwise(
        F.array(pt(F.col("o.x1"), F.col("o.y1")), pt(F.col("o.x2"), F.col("o.y2"))))
    sx, sy = F.col("s.x2") - F.col("s.x1"), F.col("s.y2") - F.col("s.y1")
    along = ((F.col("p.x") - F.col("s.x1")) * sx + (F.col("p.y") - F.col("s.y1")) * sy) / (sx * sx + sy * sy)
    cuts = m.select("s", F.explode(meet).alias("p")).withColumn("t", along).where(
        (F.col("t") > 0) & (F.col("t") < 1) & (F.col("p") != pt(F.col("s.x1"), F.col("s.y1"))) & (
            F.col("p") != pt(F.col("s.x2"), F.col("s.y2"))))
    inner = cuts.groupBy(F.col("s").alias("l")).agg(F.array_sort(F.collect_set(F.struct("t", "p"))).alias("ts"))
    every = e.select(F.struct("x1", "y1", "x2", "y2").alias("l")).join(inner, "l", "left")
    mid = F.coalesce(F.transform("ts", lambda k: k["p"]), F.array().cast("array<struct<x:double,y:double>>"))
    v = every.withColumn("v", F.concat(F.array(pt(F.col("l.x1"), F.col("l.y1"))), mid, F.array(pt(F.col("l.x2"), F.col("l.y2")))))
    p = v.select("l", F.explode(F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v")),
                                           lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    swap = (F.col("p.a.x") > F.col("p.b.x")) | ((F.col("p.a.x") == F.col("p.b.x")) & (F.col("p.a.y") > F.col("p.b.y")))
    a = F.when(swap, F.col("p.b")).otherwise(F.col("p.a"))
    b = F.when(swap, F.col("p.a")).otherwise(F.col("p.b"))
    return p.select("l", swap.alias("turned"), a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")).where(
        "x1 <> x2 or y1 <> y2")


def _owned_edges(layer: DataFrame, key: str, geom: str, grid: float) -> DataFrame:
    """``(key, side, x1, y1, x2, y2)``: edges from left to right with the side on which their feature lies (1 left, -1 right)."""
    s = layer.where(F.col(geom)["kind"] == "POLYGON").select(key, F.explode(G.oriented_segments(F.col(geom))).alias("s"))
    r = lambda c: F.bround(F.col(c) / grid) * grid
    e = s.select(key, *[r(f"s.{c}").alias(c) for c in _PIECE])
    swap = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    return e.select(key, F.when(swap, -1).otherwise(1).alias("side"), *_left_to_right(swap)).where("x1 <> x2 or y1 <> y2")


def _meeting(layer: DataFrame, other: DataFrame, geom: str, cell: float) -> DataFrame:
    """The features whose boxes meet a box of the other layer; each row once."""
    boxed = lambda df: df.where(F.col(geom).isNotNull()).withColumn("_b", G.bbox(F.col(geom)))
    mine = cut_lineage(layer.withColumn("_row", F.monotonically_increasing_id()))
    near = pair_by_cell(boxed(mine).select("_row", "_b"), boxed(other).select("_b"), F.col("_b"), F.col("_b"), cell)
    return mine.join(near.select(F.col("l__row").alias("_row")).distinct(), "_row", "left_semi").drop("_row")


def _set_apart(layer: DataFrame, key: str, geom: str, cell: float, grid: float, eps: float, other: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(near, edges)``: the features that have to be arranged, and the directed boundary ``(key, x1, y1, x2, y2)`` of all others.

    What a group covers depends on its own features and on the other layer alone. A valid polygon of one ring whose box meets
    none of these bounds its part as it is. With another layer a group of one feature counts as apart, without one (dissolving) a
    feature whose box meets no other box of its group.
    """
    g = F.col(geom)
    mine = cut_lineage(layer.select(key, geom).where(g["kind"] == "POLYGON").withColumn("_row", F.monotonically_increasing_id()).withColumn(
        "_b", G.bbox(g)).withColumn("_plain", (F.size(g["rings"]) == 1) & F.coalesce(G.is_valid(g), F.lit(False))))
    plain = mine.where("_plain").select("_row", "_b", F.col(key).alias("_k"))
    margin = 4 * eps
    if other is not None:
        boxes = other.where(F.col(geom)["kind"] == "POLYGON").select(G.bbox(F.col(geom)).alias("_b"))
        met = pair_by_cell(plain, boxes, F.col("_b"), F.col("_b"), cell, margin)
        single = mine.groupBy(key).agg(F.count("*").alias("n"), F.max("_row").alias("_row")).where("n = 1").select("_row")
        plain = plain.join(single, "_row", "left_semi")
    else:
        # cells of twice the usual box: few strangers meet in one
        usual = mine.agg(F.avg(F.greatest(F.col("_b.xmax") - F.col("_b.xmin"), F.col("_b.ymax") - F.col("_b.ymin")))).first()[0]
        boxes = mine.select("_row", "_b", F.col(key).alias("_k"))
        met = pair_by_cell(plain, boxes, F.col("_b"), F.col("_b"), min(cell, max(2 * usual, grid)) if usual else cell, margin).where(
            (F.col("l__row") != F.col("r__row")) & F.col("l__k").eqNullSafe(F.col("r__k")))
    apart = cut_lineage(plain.join(met.select(F.col("l__row").alias("_row")).distinct(), "_row", "left_anti").select("_row"))
    s = mine.join(apart, "_row", "left_semi").select(key, F.explode(G.oriented_segments(g)).alias("s"))
    edges = s.select(key, *[(F.bround(F.col(f"s.{c}") / grid) * grid).alias(c) for c in _PIECE]).where("x1 <> x2 or y1 <> y2")
    return mine.join(apart, "_row", "left_anti").select(key, geom), edges


def _shared_regions(left: DataFrame, right: DataFrame, left_key: str, right_key: str, geom: str, cell: float, grid: float, eps: float) -> DataFrame:
    """Sides of pieces on which a left and a right feature both lie, as ``(left_key, right_key, piece, side)``.

    A piece bounds what two features share only if it is an edge of one of them, and then on that feature's own side.
    So pieces keep their owners through splitting, and only the other layer is looked up, beside one side.
    """
    a, b = cut_lineage(_owned_edges(left, left_key, geom, grid)), cut_lineage(_owned_edges(right, right_key, geom, grid))
    cut = cut_lineage(pieces_of(a.select(*_PIECE).unionByName(b.select(*_PIECE)).distinct(), cell, grid))
    found = None
    for own, key, other, other_key in ((a, left_key, right, right_key), (b, right_key, left, left_key)):
        pieces = own.select(key, F.col("side").alias("was"), F.struct(*_PIECE).alias("l")).join(cut, "l").select(
            key, F.when(F.col("turned"), -F.col("was")).otherwise(F.col("was")).alias("side"), *_PIECE).distinct()
        beside = _beside(pieces, eps)
        hits = points_in_polygons(beside, other.select(other_key, geom), "px", "py", geom)
        one = hits.select(*[F.col(f"l_{c}").alias(c) for c in (key, *_PIECE, "side")], F.col(f"r_{other_key}").alias(other_key))
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def _sides(pieces: DataFrame, eps: float) -> DataFrame:
    """Each piece twice, with a point just to its left (side 1) and just to its right (side -1)."""
    return _beside(pieces.select(*_PIECE, F.explode(F.array(F.lit(1), F.lit(-1))).alias("side")), eps)


def _beside(pieces: DataFrame, eps: float) -> DataFrame:
    """Adds ``px, py``: a point just beside the middle of each piece, on its ``side``."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.hypot(dx, dy)
    return pieces.withColumn("px", (F.col("x1") + F.col("x2")) / 2 - F.col("side") * dy / n * eps).withColumn(
        "py", (F.col("y1") + F.col("y2")) / 2 + F.col("side") * dx / n * eps)


_PIECE = ["x1", "y1", "x2", "y2"]


def _covers(sides: DataFrame, layer: DataFrame, key: str, geom: str, cell: float) -> DataFrame:
    hits = points_in_polygons(sides, layer.select(key, geom), "px", "py", geom, cell)
    return hits.select(*[F.col(f"l_{c}").alias(c) for c in (*_PIECE, "side")], F.col(f"r_{key}").alias(key)).distinct()


def _bounding(members: DataFrame, group: list[str]) -> DataFrame:
    """Pieces with a group on one side only, directed so that the group lies to the left."""
    one = members.groupBy(*group, *_PIECE).agg(F.count("*").alias("n"), F.first("side").alias("side")).where("n = 1")
    left = F.col("side") == 1
    return one.select(*group, *[F.when(left, F.col(a)).otherwise(F.col(b)).alias(o) for a, b, o in (
        ("x1", "x2", "x1"), ("y1", "y2", "y1"), ("x2", "x1", "x2"), ("y2", "y1", "y2"))])


def overlay_edges(left: DataFrame, right: DataFrame, how: str, left_key: str, right_key: str, geom: str = "geom",
                  cell: float | None = None) -> DataFrame:
    """Directed boundary edges of the overlay regions, grouped by ``(left_key, right_key)``; a missing side is NULL.

    Layers in different reference systems and overlays without any region are errors.
    """
    if how not in ("intersection", "union", "difference", "symmetric_difference", "identity"):
        raise ValueError(f"unknown overlay {how!r}")
    _, cell, grid, eps = steps(left, right, geom=geom, cell=cell)
    lt, rt = left.select(left_key, geom), right.select(right_key, geom)
    if how in ("intersection", "difference", "identity"):
        rt = cut_lineage(_meeting(rt, lt, geom, cell))
    if how == "intersection":
        lt = cut_lineage(_meeting(lt, rt, geom, cell))
        return _some_region(_bounding(_shared_regions(lt, rt, left_key, right_key, geom, cell, grid, eps), [left_key, right_key]), how)
    l_type, r_type = dict(lt.dtypes)[left_key], dict(rt.dtypes)[right_key]
    near, far = _set_apart(lt, left_key, geom, cell, grid, eps, rt)
    apart = [far.withColumn(right_key, F.lit(None).cast(r_type))]
    if how in ("union", "symmetric_difference"):
        r_near, r_far = _set_apart(rt, right_key, geom, cell, grid, eps, lt)
        apart.append(r_far.withColumn(left_key, F.lit(None).cast(l_type)))
        rt = cut_lineage(r_near)
    lt = cut_lineage(near)
    if lt.isEmpty() and (len(apart) == 1 or rt.isEmpty()):
        out = apart[0].select(left_key, right_key, *_PIECE)
        return _some_region(out if len(apart) == 1 else out.unionByName(apart[1]), how)
    pieces = cut_lineage(split_edges(_edges(lt, geom, grid).unionByName(_edges(rt, geom, grid)).distinct(), cell, grid))
    sides = _sides(pieces, eps)
    a, b = _covers(sides, lt, left_key, geom, cell), _covers(sides, rt, right_key, geom, cell)
    on = [*_PIECE, "side"]
    both = a.join(b, on)
    only_a = a.join(b.select(*on).distinct(), on, "left_anti")
    only_b = b.join(a.select(*on).distinct(), on, "left_anti")
    parts = {"intersection": [both], "difference": [only_a], "identity": [both, only_a],
             "union": [both, only_a, only_b], "symmetric_difference": [only_a, only_b]}[how]
    m = parts[0]
    for p in parts[1:]:
        m = m.unionByName(p, allowMissingColumns=True)
    for k, src in ((left_key, lt), (right_key, rt)):
        if k not in m.columns:
            m = m.withColumn(k, F.lit(None).cast(dict(src.dtypes)[k]))
    out = _bounding(m, [left_key, right_key])
    for e in apart:
        out = out.unionByName(e)
    return _some_region(out, how)


def _some_region(edges: DataFrame, how: str) -> DataFrame:
    edges = cut_lineage(edges)
    if edges.isEmpty():
        raise ValueError(f"the {how} of these layers has no region")
    return edges


def _assemble(edges: DataFrame, group: list[str], srid=None) -> DataFrame:
    """Directed edges to one (multi)polygon row per group: shells first, each followed by its holes."""
    # NULL group keys would not meet in the ring joins, so groups travel as text while rings are stitched
    keyed = edges.withColumn("_g", F.to_json(F.struct(*group))).select("_g", *_PIECE)
    names = edges.select(F.to_json(F.struct(*group)).alias("_g"), *group).distinct()
    r = rings_to_table(stitch_rings(keyed, ["_g"]), ["_g"]).withColumn("box", G.bbox(G.make_geom("POLYGON", F.array("vertices"))))
    shells, holes = r.where("signed_area > 0"), r.where("signed_area < 0")
    s = shells.select("_g", F.col("ring").alias("shell"), F.col("vertices").alias("outer"), "signed_area", "box")
    h = holes.select("_g", "ring", "vertices", F.col("box").alias("hbox"))
    # a hole belongs to the smallest shell around it; its first corner may lie on that shell, so its box decides too
    v = F.col("vertices")
    inside = F.forall(v, lambda p: G.locate(G._pairs(F.col("outer")), p[0], p[1]) >= 0)
    near = h.join(s, "_g").where((F.col("box.xmin") <= F.col("hbox.xmin")) & (F.col("box.xmax") >= F.col("hbox.xmax")) & (
        F.col("box.ymin") <= F.col("hbox.ymin")) & (F.col("box.ymax") >= F.col("hbox.ymax"))).where(inside)
    owner = near.groupBy("_g", "ring").agg(F.min_by("shell", "signed_area").alias("shell"), F.first("vertices").alias("vertices"))
    hs = owner.groupBy("_g", "shell").agg(F.array_sort(F.collect_list("vertices")).alias("holes"))
    parts = s.join(hs, ["_g", "shell"], "left").select(
        "_g", F.struct("shell", F.concat(F.array("outer"), F.coalesce("holes", F.array().cast("array<array<array<double>>>"))).alias("rings")).alias("p"))
    all_parts = parts.groupBy("_g").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    rings = F.flatten(F.transform("ps", lambda p: p["rings"]))
    part_no = F.flatten(F.transform("ps", lambda p, i: F.transform(p["rings"], lambda q: i)))
    out = all_parts.select("_g", G.make_geom("POLYGON", rings, srid, part_no).alias("geom"))
    return names.join(out, "_g").drop("_g")


def overlay(left: DataFrame, right: DataFrame, how: str, left_key: str, right_key: str, geom: str = "geom",
            cell: float | None = None) -> DataFrame:
    """Overlay of two polygon layers with the attributes of both; ``how`` is one of ``intersection``, ``union``,
    ``difference``, ``symmetric_difference`` and ``identity``."""
    e = overlay_edges(left, right, how, left_key, right_key, geom, cell)
    srid = left.where(F.col(geom).isNotNull()).agg(F.max(F.col(geom)["srid"])).scalar()
    shapes = _assemble(e, [left_key, right_key]).withColumn(
        geom, F.col("geom").withField("srid", srid))
    la = left.drop(geom)
    ra = right.drop(geom)
    ra = ra.select(*[F.col(c).alias(f"{c}_right" if c in la.columns and c != right_key else c) for c in ra.columns])
    out = shapes.join(la, left_key, "left")
    return out.join(ra, right_key, "left")


def overlay_areas(left: DataFrame, right: DataFrame, how: str, left_key: str, right_key: str, geom: str = "geom",
                  cell: float | None = None) -> DataFrame:
    """Area of each overlay region, without assembling shapes."""
    return ring_areas(overlay_edges(left, right, how, left_key, right_key, geom, cell), [left_key, right_key])


def dissolve_edges(layer: DataFrame, by: str | None = None, geom: str = "geom", cell: float | None = None,
                   clean: bool = False) -> tuple[DataFrame, list[str]]:
    """Directed boundary edges of the merged geometry per group.

    ``clean=True`` is for coverages whose neighbours share their edges exactly: an edge seen twice in a group is inner
    and cancels in one aggregate. Otherwise the full arrangement is used.
    """
    _, cell, grid, eps = steps(layer, geom=geom, cell=cell)
    group = by or "_all"
    src = layer if by else layer.withColumn("_all", F.lit(1))
    src = src.where(F.col(geom)["kind"] == "POLYGON")
    if clean:
        r = lambda c: (F.bround(F.col(c) / grid) * grid).alias(c.split(".")[-1])
        e = src.select(group, F.explode(G.oriented_segments(F.col(geom))).alias("s")).select(
            group, *[r(f"s.{c}") for c in _PIECE])
        swap = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
        k = e.select(group, *_left_to_right(swap), F.when(swap, -1).otherwise(1).alias("d"))
        once = k.groupBy(group, *_PIECE).agg(F.sum("d").alias("d")).where("d <> 0")
        return once.select(group, *_left_to_right(F.col("d") < 0)), [group]
    near, apart = _set_apart(src, group, geom, cell, grid, eps)
    near = cut_lineage(near)
    if near.isEmpty():
        return apart, [group]
    pieces = cut_lineage(split_edges(_edges(near, geom, grid), cell, grid))
    members = _covers(_sides(pieces, eps), near, group, geom, cell)
    return _bounding(members, [group]).unionByName(apart), [group]


def dissolve(layer: DataFrame, by: str | None = None, geom: str = "geom", cell: float | None = None, clean: bool = False) -> DataFrame:
    """One (multi)polygon per value of ``by`` (or one for the layer)."""
    e, group = dissolve_edges(layer, by, geom, cell, clean)
    srid = layer.where(F.col(geom).isNotNull()).agg(F.max(F.col(geom)["srid"])).scalar()
    out = _assemble(cut_lineage(e), group).withColumn("geom", F.col("geom").withField("srid", srid))
    return out if by else out.drop("_all")


def coverage_holes(layer: DataFrame, geom: str = "geom", cell: float | None = None, clean: bool = False) -> DataFrame:
    """Interior rings of the merged layer, one row per hole: ``(vertices, area)``."""
    e, group = dissolve_edges(layer, None, geom, cell, clean)
    r = rings_to_table(stitch_rings(cut_lineage(e), group), group)
    return r.where("signed_area < 0").select("vertices", F.abs("signed_area").alias("area"))


def clip_points(points: DataFrame, mask: DataFrame, key: str, x: str = "x", y: str = "y", geom: str = "geom",
                cell: float = 1000.0) -> DataFrame:
    hits = points_in_polygons(points.select(key, x, y), mask.select(geom), x, y, geom, cell).select(
        F.col(f"l_{key}").alias(key)).distinct()
    return points.join(hits, key, "left_semi")


def clip_polygons(layer: DataFrame, mask: DataFrame, key: str, geom: str = "geom", cell: float | None = None) -> DataFrame:
    """Polygons cut to the union of the mask polygons, holes honoured; what lies outside is dropped."""
    _, cell, grid, eps = steps(layer, mask, geom=geom, cell=cell)
    lt = cut_lineage(_meeting(layer.select(key, geom), mask, geom, cell))
    mk = cut_lineage(_meeting(mask.select(F.lit(1).alias("_m"), geom), lt, geom, cell))
    pieces = cut_lineage(split_edges(_edges(lt, geom, grid).unionByName(_edges(mk, geom, grid)).distinct(), cell, grid))
    sides = _sides(pieces, eps)
    a, m = _covers(sides, lt, key, geom, cell), _covers(sides, mk, "_m", geom, cell)
    e = _bounding(a.join(m.drop("_m").distinct(), [*_PIECE, "side"], "left_semi"), [key])
    srid = layer.where(F.col(geom).isNotNull()).agg(F.max(F.col(geom)["srid"])).scalar()
    shapes = _assemble(cut_lineage(e), [key]).withColumn(geom, F.col("geom").withField("srid", srid))
    return layer.drop(geom).join(shapes, key)


def clip_lines(lines: DataFrame, mask: DataFrame, key: str, geom: str = "geom", cell: float | None = None) -> DataFrame:
    """Line pieces inside (or on) the mask: one row per piece, ``(key, path, seq, x1, y1, x2, y2)``.

    Segments are cut at the mask edges that meet them (cell join), and each piece is kept if its midpoint is covered.
    """
    _, cell, _, _ = steps(lines, mask, geom=geom, cell=cell)
    seg = lines.where(F.col(geom)["kind"] == "LINE").select(key, F.posexplode(G.segments(F.col(geom))).alias("seq", "s")).select(
        key, "seq", "s.*")
    box = F.struct(F.least("x1", "x2").alias("xmin"), F.least("y1", "y2").alias("ymin"),
                   F.greatest("x1", "x2").alias("xmax"), F.greatest("y1", "y2").alias("ymax"))
    me = mask.select(F.explode(G.segments(F.col(geom))).alias("s")).select("s.*")
    pairs = pair_by_cell(seg, me, box, box, cell, salt_by=[key, "seq"])
    whole = lambda p: F.struct(*[F.col(f"{p}{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    pairs = pairs.select(F.col(f"l_{key}").alias(key), F.col("l_seq").alias("seq"), whole("l_").alias("l"), whole("r_").alias("r"))
    cuts = pairs.select(key, "seq", F.explode(G._cut_params(F.col("l"), F.array("r"))).alias("t")).groupBy(key, "seq").agg(F.collect_set("t").alias("ts"))
    t = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("ts", F.array().cast("array<double>")))))
    p = seg.join(cuts, [key, "seq"], "left").withColumn("t", t).select(
        key, "seq", "x1", "y1", "x2", "y2", F.posexplode(F.zip_with(
            F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "p"))
    at = lambda c1, c2, k: F.col(c1) + k * (F.col(c2) - F.col(c1))
    q = p.select(key, "seq", "k", at("x1", "x2", F.col("p.a")).alias("x1"), at("y1", "y2", F.col("p.a")).alias("y1"),
                 at("x1", "x2", F.col("p.b")).alias("x2"), at("y1", "y2", F.col("p.b")).alias("y2"),
                 at("x1", "x2", (F.col("p.a") + F.col("p.b")) / 2).alias("mx"),
                 at("y1", "y2", (F.col("p.a") + F.col("p.b")) / 2).alias("my"))
    kept = points_in_polygons(q, mask.select(geom), "mx", "my", geom, cell).select(
        *[F.col(f"l_{c}").alias(c) for c in (key, "seq", "k", "x1", "y1", "x2", "y2")])
    return kept.distinct()


def _bound(cut, *args):
    return lambda ring: cut(ring, *args)


def clip_to_box(layer: DataFrame, window: tuple, geom: str = "geom") -> DataFrame:
    """Polygons cut to an axis-parallel window as column expressions (one half-plane after the other), no join.

    Rings are cut one by one; parts that leave nothing are dropped.
    """
    x0, y0, x1, y1 = (float(v) for v in window)

    def half(ring: Column, axis: int, limit: float, keep_low: bool) -> Column:
        inside = (lambda p: p[axis] <= limit) if keep_low else (lambda p: p[axis] >= limit)
        pairs = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.size(ring)),
                           lambda p, q: F.struct(p.alias("p"), q.alias("q")))

        def cut(s):
            p, q = s["p"], s["q"]
            t = (F.lit(limit) - p[axis]) / F.nullif(q[axis] - p[axis], F.lit(0.0))
            other = p[1 - axis] + t * (q[1 - axis] - p[1 - axis])
            meet = F.array(F.lit(limit), other) if axis == 0 else F.array(other, F.lit(limit))
            return F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(meet)).when(
                inside(q), F.array(meet, q)).otherwise(F.array().cast("array<array<double>>"))

        out = F.flatten(F.transform(pairs, cut))
        return F.when(F.size(out) > 0, F.concat(out, F.slice(out, 1, 1))).otherwise(out)

    g = F.col(geom)
    rings = g["rings"]
    for axis, limit, low in ((0, x0, False), (0, x1, True), (1, y0, False), (1, y1, True)):
        rings = F.transform(rings, _bound(half, axis, limit, low))
    tagged = F.filter(F.arrays_zip(rings.alias("r"), g["ring_part"].alias("p")), lambda z: F.size(z["r"]) >= 4)
    # bind the cut rings once per row before using them three times
    cut = layer.withColumn("_z", tagged)
    names = ("r", "p")
    out = cut.withColumn(geom, G.make_geom(g["kind"], F.transform("_z", lambda z: z[names[0]]), g["srid"],
                                           F.transform("_z", lambda z: z[names[1]]))).drop("_z")
    return out.where(G.area(F.col(geom)) > 0)
