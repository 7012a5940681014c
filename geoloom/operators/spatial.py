"""Spatial joins and selections on the cell grid of :mod:`geoloom.operators.cells`."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions.tiles import metric_srid, region_point
from geoloom.operators.cells import pair_by_cell, side
from geoloom.operators.cover import cover, side_in_cell
from geoloom.operators.skew import salted_join
from geoloom.session import cut_lineage

_SEGS = "_segs"


def _prepare(df: DataFrame, geom: str) -> DataFrame:
    """The parts of each geometry that pair predicates need, as flat ``_kind, _pts, _segs, _area, _length`` columns."""
    p = df.withColumn("_p", G.prepared(F.col(geom)))
    return p.select(*df.columns, *[F.col("_p")[k].alias(f"_{k}") for k in G.PREPARED])


def _prepared_side(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}_{k}") for k in G.PREPARED}


def kinds_of(df: DataFrame, geom: str = "geom") -> list[str]:
    """Geometry kinds of a layer: at most three words, read from one column."""
    return sorted(r[0] for r in df.where(F.col(geom).isNotNull()).select(F.col(geom)["kind"]).distinct().collect())


def _single_points(df: DataFrame, geom: str) -> bool:
    """The layer holds points of one vertex only."""
    g = F.col(geom)
    return bool(df.where(g.isNotNull()).agg(F.bool_and((g["kind"] == "POINT") & (G.num_vertices(g) == 1))).first()[0])


# predicate -> whether the points lie on the left, and whether a point on the boundary counts
_POINT_RULES = {("intersects", "POINT", "POLYGON"): (True, True), ("within", "POINT", "POLYGON"): (True, False),
                ("intersects", "POLYGON", "POINT"): (False, True), ("contains", "POLYGON", "POINT"): (False, False)}


def predicate_pairs(left: DataFrame, right: DataFrame, predicate: str = "intersects", cell: float = 1000.0,
                    geom: str = "geom", right_geom: str | None = None, kinds: tuple | None = None) -> DataFrame:
    """Pairs (``l_*``, ``r_*``) for which ``predicate`` holds between the left and right geometry.

    The test is built for the kinds that occur (``kinds = (left kinds, right kinds)``, looked up when not given), so
    points in polygons never carry the expressions for crossing lines. Single points meet polygons through their covers.
    """
    if predicate == "disjoint":
        raise ValueError("disjoint pairs are nearly all pairs; use extract_by_location(..., 'disjoint')")
    rg = right_geom or geom
    lk, rk = kinds or (kinds_of(left, geom), kinds_of(right, rg))
    rule = _POINT_RULES.get((predicate, *lk, *rk)) if len(lk) == len(rk) == 1 else None
    if rule and _single_points(left if rule[0] else right, geom if rule[0] else rg):
        return _point_pairs(left, right, *rule, geom, rg)
    lp, rp = _prepare(left, geom), _prepare(right, rg)
    pairs = pair_by_cell(lp, rp, F.col("_bbox"), F.col("_bbox"), cell)
    hit = pairs.where(G.pair_predicate(predicate, _prepared_side("l_"), _prepared_side("r_"), lk, rk))
    return hit.drop(*[f"{s}_{k}" for s in ("l_", "r_") for k in G.PREPARED])


def _point_pairs(left: DataFrame, right: DataFrame, points_left: bool, boundary: bool, geom: str, right_geom: str) -> DataFrame:
    points, polygons = (left, right) if points_left else (right, left)
    at, shape = (geom, right_geom) if points_left else (right_geom, geom)
    xy = points.withColumn("_x", F.col(at)["rings"][0][0][0]).withColumn("_y", F.col(at)["rings"][0][0][1])
    got = points_in_polygons(xy, polygons, "_x", "_y", shape, boundary=boundary)
    if points_left:
        return got.drop("l__x", "l__y")
    return got.select(*[F.col(f"r_{c}").alias(f"l_{c}") for c in left.columns], *[F.col(f"l_{c}").alias(f"r_{c}") for c in right.columns])


def spatial_join(left: DataFrame, right: DataFrame, predicate: str = "intersects", cell: float = 1000.0,
                 geom: str = "geom", how: str = "inner", left_key: str | None = None, kinds: tuple | None = None) -> DataFrame:
    """Attributes of ``right`` joined to ``left`` by location; ``how='left'`` keeps unmatched rows (needs ``left_key``)."""
    taken = {c.lower() for c in left.columns}
    pairs = predicate_pairs(left, right, predicate, cell, geom, kinds=kinds)
    out = pairs.select(*[F.col(f"l_{c}").alias(c) for c in left.columns], *[
        F.col(f"r_{c}").alias(c + "_right" if c.lower() in taken else c) for c in right.columns if c != geom])
    if how == "inner":
        return out
    if how != "left" or left_key is None:
        raise ValueError("how must be 'inner', or 'left' with left_key")
    rest = left.join(out.select(left_key).distinct(), left_key, "left_anti")
    return out.unionByName(rest, allowMissingColumns=True)


def extract_by_location(layer: DataFrame, ref: DataFrame, predicate: str, key: str, cell: float = 1000.0,
                        geom: str = "geom") -> DataFrame:
    """Rows of ``layer`` in the given relation to any ``ref`` feature; ``disjoint`` keeps rows that meet none."""
    test = "intersects" if predicate == "disjoint" else predicate
    hits = predicate_pairs(layer.select(key, geom), ref.select(geom), test, cell, geom).select(
        F.col(f"l_{key}").alias(key)).distinct()
    return layer.join(hits, key, "left_anti" if predicate == "disjoint" else "left_semi")


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", geom: str = "geom",
                       cell: float | None = None, boundary: bool = True) -> DataFrame:
    """Pairs (``l_*``, ``r_*``) of points and the polygons that hold them (``boundary`` says whether edges count).

    Polygons are written once with a number each, their covers once by cell; points meet cells, and polygons come back
    by number. Cells follow the polygons, so ``cell`` has no effect any more.
    """
    shapes = cut_lineage(polygons.withColumn("_pid", F.monotonically_increasing_id()))
    cells = cut_lineage(cover(shapes, "_pid", geom))
    levels = [r[0] for r in cells.select("lv").distinct().collect()]                 # a few integers
    lhs = side(points, "l_").withColumn("_px", F.col(f"l_{x}").cast("double")).withColumn("_py", F.col(f"l_{y}").cast("double")).where(
        "_px is not null and _py is not null")
    size = F.pow(F.lit(2.0), F.col("_lv"))
    at = lhs.withColumn("_lv", F.explode(F.lit(levels or [0]).cast("array<int>"))).withColumn("_cx", F.floor(F.col("_px") / size)).withColumn(
        "_cy", F.floor(F.col("_py") / size)).withColumn("_sk", F.xxhash64("_px", "_py", f"l_{points.columns[0]}"))
    rhs = cells.select("pid", F.col("lv").alias("_lv"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "side", "edges")
    met = salted_join(at, rhs, ["_lv", "_cx", "_cy"], ["_sk"])
    where = side_in_cell(F.col("_px"), F.col("_py"), F.col("_cx") * size, F.col("_cy") * size, F.col("side"), F.col("edges"))
    hit = met.where(where >= (0 if boundary else 1)).select(*[f"`l_{c}`" for c in points.columns], "pid")
    return hit.join(side(shapes, "r_").withColumnRenamed("r__pid", "pid"), "pid").select(
        *[f"`l_{c}`" for c in points.columns], *[f"`r_{c}`" for c in polygons.columns])


def count_points_in_polygon(polygons: DataFrame, points: DataFrame, key: str, field: str = "numpoints",
                            x: str = "x", y: str = "y", geom: str = "geom", cell: float = 1000.0) -> DataFrame:
    """``polygons`` with the number of points inside each; polygons without points keep a 0."""
    hits = points_in_polygons(points.select(x, y), polygons.select(key, geom), x, y, geom, cell, boundary=False)
    counts = hits.groupBy(F.col(f"r_{key}").alias(key)).agg(F.count("*").alias(field))
    return polygons.join(counts, key, "left").withColumn(field, F.coalesce(field, F.lit(0)))


def within_distance(left: DataFrame, right: DataFrame, distance: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (``l_*``, ``r_*``, ``dist``) of point rows at most ``distance`` apart."""
    box = lambda: F.struct(*[F.col(c).cast("double").alias(n) for c, n in (
        (x, "xmin"), (y, "ymin"), (x, "xmax"), (y, "ymax"))])
    pairs = pair_by_cell(left, right, box(), box(), cell=2.0 * distance, expand=float(distance), salt_by=[x, y])
    dist = F.hypot(F.col(f"l_{x}") - F.col(f"r_{x}"), F.col(f"l_{y}") - F.col(f"r_{y}"))
    return pairs.withColumn("dist", dist).where(F.col("dist") <= distance)


def within_distance_of(points: DataFrame, layer: DataFrame, distance: float, x: str = "x", y: str = "y",
                       geom: str = "geom", cell: float | None = None) -> DataFrame:
    """Pairs (``l_*``, ``r_*``, ``dist``) of points and geometries (any kind) at most ``distance`` apart."""
    box = F.struct(*[F.col(c).cast("double").alias(n) for c, n in (
        (x, "xmin"), (y, "ymin"), (x, "xmax"), (y, "ymax"))])
    pairs = pair_by_cell(points, layer, box, G.bbox(F.col(geom)), cell or 2.0 * distance, expand=float(distance),
                         salt_by=[x, y])
    return pairs.withColumn("dist", G.distance_to_point(F.col(f"r_{geom}"), F.col(f"l_{x}"), F.col(f"l_{y}"))).where(
        F.col("dist") <= distance)


def nearest(left: DataFrame, right: DataFrame, max_distance: float, left_key: str, right_key: str,
            x: str = "x", y: str = "y") -> DataFrame:
    """Nearest ``right`` row of every ``left`` row within ``max_distance``; ties go to the smaller key.

    Searched in growing rings: the first radius is the usual distance between neighbours on the right, each next one twice as
    large, and a row leaves as soon as it has found any, so the rows compared don't grow with ``max_distance``. Inside a ring one pass
    per left key with map-side combining (``min`` of a struct), no sort of all candidates.
    """
    there = right.select(right_key, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pending = left.select(left_key, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n, w, h = there.agg(F.count("*"), F.max(x) - F.min(x), F.max(y) - F.min(y)).first()
    usual = max(math.sqrt(float(w) * float(h) / n), max(float(w), float(h)) / n) if n else 0.0
    radius = min(usual, max_distance) if usual > 0 else max_distance
    found = None
    while True:
        pairs = within_distance(pending, there, radius, x, y)
        best = pairs.groupBy(F.col(f"l_{left_key}").alias(left_key)).agg(
            F.min(F.struct(F.col("dist"), F.col(f"r_{right_key}").alias("k"))).alias("b")).select(
            left_key, F.col("b.k").alias(right_key), F.col("b.dist").alias("dist"))
        if radius >= max_distance:
            return best if found is None else found.unionByName(best)
        best = cut_lineage(best)
        found = best if found is None else found.unionByName(best)
        done = best.select(F.col(left_key).alias("_done"))
        pending = cut_lineage(pending.join(done, F.col(left_key).eqNullSafe(F.col("_done")), "left_anti"))
        if pending.isEmpty():
            return found
        radius = min(2 * radius, max_distance)


def relate(left: DataFrame, right: DataFrame, predicates: tuple, cell: float = 1000.0, geom: str = "geom",
           kinds: tuple | None = None) -> DataFrame:
    """All the listed relations that hold between meeting features, one row ``(predicate, l_*, r_*)`` each, in one join."""
    lk, rk = kinds or (kinds_of(left, geom), kinds_of(right, geom))
    pairs = pair_by_cell(_prepare(left, geom), _prepare(right, geom), F.col("_bbox"), F.col("_bbox"), cell)
    a, b = _prepared_side("l_"), _prepared_side("r_")
    names = F.array(*[F.when(G.pair_predicate(p, a, b, lk, rk), F.lit(p)) for p in predicates])
    hit = pairs.withColumn("predicate", F.explode(F.array_compact(names)))
    return hit.drop(*[f"{s}_{k}" for s in ("l_", "r_") for k in G.PREPARED])


def self_overlaps(layer: DataFrame, key: str, geom: str = "geom", cell: float = 1000.0) -> DataFrame:
    """Unordered pairs of one layer that partially overlap (contact, containment and equality do not count).

    The checked and prepared layer is written once: both sides of the join, their grid levels and the count of hot
    cells read it back instead of working the geometry out again.
    """
    kinds = kinds_of(layer, geom)
    # validity is a value, not a filter: a filter would sink below the layer's repartitioning and be worked out in few tasks
    sound = layer.select(key, geom).withColumn(geom, F.when(G.is_valid(F.col(geom)), F.col(geom)))
    slim = cut_lineage(_prepare(sound, geom).drop(geom)).where("_kind is not null")
    pairs = pair_by_cell(slim, slim, F.col("_bbox"), F.col("_bbox"), cell).where(F.col(f"l_{key}") < F.col(f"r_{key}"))
    hit = pairs.where(G.pair_predicate("overlaps", _prepared_side("l_"), _prepared_side("r_"), kinds, kinds))
    return hit.select(F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b"))


def overlap_areas(left: DataFrame, right: DataFrame, left_key: str, right_key: str, geom: str = "geom",
                  cell: float = 1000.0) -> DataFrame:
    """Exact shared area of every pair of polygons that share any."""
    lp = left.select(left_key, G.oriented_segments(F.col(geom)).alias(_SEGS), G.bbox(F.col(geom)).alias("_b"))
    rp = right.select(right_key, G.oriented_segments(F.col(geom)).alias(_SEGS), G.bbox(F.col(geom)).alias("_b"))
    pairs = pair_by_cell(lp, rp, F.col("_b"), F.col("_b"), cell)
    return pairs.select(
        F.col(f"l_{left_key}").alias(left_key), F.col(f"r_{right_key}").alias(right_key),
        G.overlap_area_segments(F.col(f"l_{_SEGS}"), F.col(f"r_{_SEGS}")).alias("area")).where(F.col("area") > 1e-9)


def detect_area(points: DataFrame, outlines: DataFrame, key: str, code: str, order: str, x: str = "x", y: str = "y",
                geom: str = "geom", cell: float = 10.0) -> DataFrame:
    """First outline (by ``order``) that strictly contains each point; NULL where none does."""
    hits = points_in_polygons(points.select(key, x, y), outlines.select(code, order, geom), x, y, geom, cell,
                              boundary=False)
    first = hits.groupBy(F.col(f"l_{key}").alias(key)).agg(F.min_by(F.col(f"r_{code}"), F.col(f"r_{order}")).alias(code))
    return points.join(first, key, "left")


def bbox_filter(df: DataFrame, window: tuple, geom: str | None = None, x: str = "x", y: str = "y",
                kinds: tuple = G.KINDS) -> DataFrame:
    """Rows in a window: points by ``x``/``y``; layers by their stored box columns, then by exact geometry."""
    x0, y0, x1, y1 = (float(v) for v in window)
    if geom is None:
        return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    if all(c in df.columns for c in ("xmin", "ymin", "xmax", "ymax")):
        df = df.where((F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1))
    win = G.prepared(G.box(x0, y0, x1, y1))
    p = _prepare(df, geom)
    mine = {k: F.col(f"_{k}") for k in G.PREPARED}
    return p.where(G.pair_predicate("intersects", mine, win, kinds, ("POLYGON",))).select(*df.columns)


def region_profile(places: DataFrame, outlines: DataFrame, key: str, location: str, country: str, order: str, geom: str = "geom",
                   cell: float = 1.0) -> DataFrame:
    """``(key, country, srid, lon, lat)`` of each location, a ``[lon, lat]`` or ``[west, south, east, north]`` array.

    The country is that of the first outline around the centre, the reference system its metric one; outside all outlines
    the country is NULL and the system geographic. Centres are rounded to six decimals; other arrays give NULLs.
    """
    at = places.select(key, region_point(F.col(location)).alias("p")).select(key, F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))
    found = detect_area(at, outlines, key, country, order, "lon", "lat", geom, cell)
    return found.select(key, F.col(country).alias("country"), metric_srid(F.col(country), F.col("lon")).alias("srid"),
                        F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
