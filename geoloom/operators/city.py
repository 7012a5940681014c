"""3-D buildings and point clouds as tables.

``surfaces(building_id, surface_type, rings array<array<array<double>>>)`` holds one face per row, its first ring the
outline and further rings holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geometry as G


def _z(rings: Column) -> Column:
    return F.transform(F.flatten(rings), lambda v: v[2])


def footprint_height(surfaces: DataFrame, attributes: DataFrame | None = None, key: str = "building_id") -> DataFrame:
    """Ground rings and height per building: the measured attribute, else the range of z, rounded to 2."""
    g = surfaces.groupBy(key).agg(
        F.max(F.array_max(_z(F.col("rings")))).alias("_hi"), F.min(F.array_min(_z(F.col("rings")))).alias("_lo"),
        F.flatten(F.array_sort(F.collect_list(F.when(F.col("surface_type") == "GroundSurface", F.col("rings"))))).alias("ground"))
    if attributes is not None:
        g = g.join(attributes.select(key, "measured_height"), key, "left")
    else:
        g = g.withColumn("measured_height", F.lit(None).cast("double"))
    return g.select(key, "ground", F.coalesce("measured_height", F.round(F.col("_hi") - F.col("_lo"), 2)).alias("height"))


def solid_heights(solids: DataFrame, key: str = "building_id", renames: dict | None = None) -> DataFrame:
    """Height per triangulated solid from the range of z; attributes renamed, blanks and NaN dropped to NULL."""
    # fixed values: source attribute -> column
    renames = renames or {"OBJEKTART": "objektart", "DACH_MAX": "roof_max_z", "DACH_MIN": "roof_min_z",
                          "GEBAEUDE_NUTZUNG": "usage", "EGID": "egid"}
    z = _z(F.col("rings"))
    types = dict(solids.dtypes)
    clean = lambda c: F.nanvl(F.col(c), F.lit(None)) if types[c] in ("double", "float") else F.nullif(F.col(c).cast("string"), F.lit(""))
    have = {s: d for s, d in renames.items() if s in solids.columns}
    # texts make the grouping a sort of its input, so a face brings its range of z instead of its rings
    slim = solids.select(key, F.array_max(z).alias("_hi"), F.array_min(z).alias("_lo"), *[clean(s).alias(d) for s, d in have.items()])
    out = slim.groupBy(key).agg(
        F.round(F.max("_hi") - F.min("_lo"), 2).alias("measured_height"), F.count("*").alias("faces"),
        *[F.first(d, ignorenulls=True).alias(d) for d in have.values()])
    return out.withColumn("egid", F.col("egid").try_cast("long")) if "egid" in out.columns else out


def subset_bbox(surfaces: DataFrame, window: tuple, key: str = "building_id") -> DataFrame:
    """All faces of the buildings whose box meets the window."""
    x0, y0, x1, y1 = (float(v) for v in window)
    v = F.flatten("rings")
    xs, ys = F.transform(v, lambda p: p[0]), F.transform(v, lambda p: p[1])
    b = surfaces.groupBy(key).agg(F.min(F.array_min(xs)).alias("a"), F.min(F.array_min(ys)).alias("b"),
                                  F.max(F.array_max(xs)).alias("c"), F.max(F.array_max(ys)).alias("d"))
    keep = b.where((F.col("c") >= x0) & (F.col("a") <= x1) & (F.col("d") >= y0) & (F.col("b") <= y1))
    return surfaces.join(keep.select(key), key, "left_semi")


def quantize(vertices: DataFrame, scale: float = 0.001) -> DataFrame:
    """Vertices as whole millimetres from the least corner (``ix, iy, iz`` and the corner as ``ox, oy, oz``)."""
    o = vertices.agg(F.struct(F.min("x").alias("x"), F.min("y").alias("y"), F.min("z").alias("z"))).scalar()
    t = vertices.withColumn("_o", o)
    return t.select(*vertices.columns, *[F.bround((F.col(c) - F.col(f"_o.{c}")) / scale).cast("long").alias(f"i{c}") for c in "xyz"],
                    *[F.col(f"_o.{c}").alias(f"o{c}") for c in "xyz"])


def dequantize(vertices: DataFrame, scale: float = 0.001) -> DataFrame:
    return vertices.select("*", *[(F.col(f"i{c}") * scale + F.col(f"o{c}")).alias(f"d{c}") for c in "xyz"])


def faces_to_multipolygon_z(surfaces: DataFrame, key: str = "building_id", srid=None) -> DataFrame:
    """One multi-polygon with heights per building: every face is a part, its rings closed."""
    closed = F.transform("rings", lambda r: F.when(r[0] == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))))
    f = surfaces.groupBy(key).agg(F.array_sort(F.collect_list(closed)).alias("faces"))
    part = F.flatten(F.transform("faces", lambda f, i: F.transform(f, lambda r: i)))
    return f.select(key, G.make_geom("POLYGON", F.flatten("faces"), srid, part).alias("geom"))


def face_orientation(surfaces: DataFrame, surface_type: str = "RoofSurface") -> DataFrame:
    return surfaces.where(F.col("surface_type") == surface_type).withColumn(
        "_o", G.face_orientation(F.col("rings")[0])).select(
        *surfaces.columns, F.col("_o.slope").alias("slope"), F.col("_o.azimuth").alias("azimuth"))


def model_summary(surfaces: DataFrame, key: str = "building_id") -> DataFrame:
    """Extent, building, face and vertex counts in one pass (vertices are counted as written, shared or not)."""
    v = F.flatten("rings")
    c = lambda i, f: f(F.transform(v, lambda p: p[i]))
    return surfaces.agg(
        *[F.min(c(i, F.array_min)).alias(f"min{a}") for i, a in enumerate("xyz")],
        *[F.max(c(i, F.array_max)).alias(f"max{a}") for i, a in enumerate("xyz")],
        F.count_distinct(key).alias("buildings"), F.count("*").alias("faces"), F.sum(F.size(v)).alias("vertices"))


def dedupe_vertices(vertices: DataFrame, cell: float = 100.0) -> DataFrame:
    """Distinct vertices (equal to the millimetre) with dense ids ``vid`` from 0 in (cell, x, y, z) order.

    Ids are numbered inside each cell and shifted by the vertices of the cells before it; the shifts are themselves
    summed per column of cells, so neither step is one global sort.
    """
    r = lambda c: F.bround(F.col(c), 3).alias(c)
    d = vertices.select(r("x"), r("y"), r("z")).distinct().withColumn("cx", F.floor(F.col("x") / cell)).withColumn(
        "cy", F.floor(F.col("y") / cell))
    inside = F.row_number().over(Window.partitionBy("cx", "cy").orderBy("x", "y", "z")) - 1
    by_cell = d.groupBy("cx", "cy").agg(F.count("*").alias("k"))
    by_col = by_cell.groupBy("cx").agg(F.sum("k").alias("k"))
    # one row per column of cells: its number is the width of the model in cells
    before_col = F.coalesce(F.sum("k").over(Window.orderBy("cx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cols = by_col.select("cx", before_col.alias("b1"))
    before_cell = F.coalesce(F.sum("k").over(Window.partitionBy("cx").orderBy("cy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = by_cell.withColumn("b2", before_cell).join(cols.hint("merge"), "cx").select("cx", "cy", (F.col("b1") + F.col("b2")).alias("b"))
    # sizes are estimated without the rows that faces are exploded to, so the joins are asked to shuffle
    return d.withColumn("_i", inside).join(shift.hint("merge"), ["cx", "cy"]).select("x", "y", "z", (F.col("_i") + F.col("b")).alias("vid"))


def decimate(points: DataFrame, max_points: int, order: list[str], slices: Column | None = None) -> DataFrame:
    """Every n-th point, n = total / max rounded (at least 1), counted inside slices (hashed unless given) in a stable
    order, so the points never pass through one task."""
    total = points.agg(F.count("*")).scalar()
    slices = slices if slices is not None else F.pmod(F.xxhash64(*order), F.lit(1024))
    t = points.withColumn("_n", F.greatest(F.lit(1), F.round(total / max_points).cast("int"))).withColumn("_s", slices)
    i = F.row_number().over(Window.partitionBy("_s").orderBy(*order))
    return t.withColumn("_i", i - 1).where(F.pmod(F.col("_i"), F.col("_n")) == 0).drop("_n", "_s", "_i")
