"""Raster algebra on long cell tables ``(row, col, value)`` (plus ``raster_id`` / ``band`` where several are held).

Row 0 is the north edge. A meta row ``(x0, y0, dx, dy, width, height, srid, nodata)`` gives the upper left corner and
positive cell sizes, so the centre of a cell is ``(x0 + (col + .5) dx, y0 - (row + .5) dy)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators.cover import EDGES, cover, side_in_cell
from geoloom.operators.ranks import exact_median, exact_quantiles
from geoloom.operators.spatial import points_in_polygons
from geoloom.session import cut_lineage


@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    srid: int | None = None
    nodata: float | None = None


def with_centres(cells: DataFrame, grid: Grid) -> DataFrame:
    return cells.withColumn("x", grid.x0 + (F.col("col") + 0.5) * grid.dx).withColumn(
        "y", grid.y0 - (F.col("row") + 0.5) * grid.dy)


def grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """All cells of a grid, generated on the executors, a million to a task."""
    total = grid.width * grid.height
    n = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, total // 1_000_000 + 1))
    return n.select(F.floor(F.col("id") / grid.width).alias("row"), (F.col("id") % grid.width).alias("col"))


def valid(value: Column, nodata: float | None = None) -> Column:
    v = F.when(~F.isnan(value), value)
    return v if nodata is None else F.when(v != nodata, v)


def raster_window(cells: DataFrame, grid: Grid, bbox: tuple) -> tuple[DataFrame, Grid]:
    """Cells whose centre lies in the window, renumbered from the window's corner; plain row/col ranges reach the scan."""
    import math
    x0, y0, x1, y1 = bbox
    c0 = max(0, math.ceil((x0 - grid.x0) / grid.dx - 0.5))
    c1 = min(grid.width - 1, math.floor((x1 - grid.x0) / grid.dx - 0.5))
    r0 = max(0, math.ceil((grid.y0 - y1) / grid.dy - 0.5))
    r1 = min(grid.height - 1, math.floor((grid.y0 - y0) / grid.dy - 0.5))
    if c1 < c0 or r1 < r0:
        raise ValueError("window does not overlap the raster")
    out = cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    shifted = out.withColumn("row", F.col("row") - r0).withColumn("col", F.col("col") - c0)
    return shifted, Grid(grid.x0 + c0 * grid.dx, grid.y0 - r0 * grid.dy, grid.dx, grid.dy, c1 - c0 + 1, r1 - r0 + 1,
                         grid.srid, grid.nodata)


def zip_bands(a: DataFrame, b: DataFrame, keys: list[str] | None = None, grids: tuple | None = None) -> DataFrame:
    """Two bands cell by cell as ``a`` and ``b``; differing shapes are refused when both grids are given."""
    if grids and (grids[0].width, grids[0].height) != (grids[1].width, grids[1].height):
        raise ValueError("band shape mismatch")
    k = [*(keys or []), "row", "col"]
    return a.select(*k, F.col("value").alias("a")).join(b.select(*k, F.col("value").alias("b")), k)


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), and 0 where the sum is 0."""
    return F.coalesce(F.try_divide(a - b, a + b), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def raster_calc(a: DataFrame, b: DataFrame, expr: str, keys: list[str] | None = None) -> DataFrame:
    """Cell expression over the bands ``A`` and ``B`` (``A - B`` gives heights from surface and terrain)."""
    z = zip_bands(a, b, keys)
    return z.select(*(keys or []), "row", "col", F.expr(expr).alias("value"))


def threshold_mask(value: Column, threshold: float) -> Column:
    return F.when(value > threshold, 1).otherwise(0)


def raster_stats(cells: DataFrame, nodata: float | None = None, by: list[str] | None = None) -> DataFrame:
    v = valid(F.col("value"), nodata)
    return cells.groupBy(*(by or [])).agg(F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"),
                                         F.count(v).alias("count"))


def mosaic(tiles: DataFrame, order: str, nodata: float | None = None, bounds: tuple | None = None) -> DataFrame:
    """Cells of overlapping tiles on one grid: the first tile with a value wins; ``bounds = (r0, c0, r1, c1)`` clips."""
    t = tiles.where(valid(F.col("value"), nodata).isNotNull())
    if bounds:
        r0, c0, r1, c1 = bounds
        t = t.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return t.groupBy("row", "col").agg(F.min_by("value", order).alias("value"))


def zonal_join(zones: DataFrame, cells: DataFrame, key: str, cell: float = 1000.0, geom: str = "geom") -> DataFrame:
    """``(key, value)`` of every cell (with ``x, y`` centres) whose centre lies in a zone."""
    hits = points_in_polygons(cells.select("x", "y", "value"), zones.select(key, geom), "x", "y", geom, cell)
    return hits.select(F.col(f"r_{key}").alias(key), F.col("l_value").alias("value"))


ZONAL = ("count", "sum", "mean", "median", "stdev", "min", "max", "range", "minority", "majority", "variety", "variance")


def zonal_stats(zones: DataFrame, cells: DataFrame, key: str, stats: tuple = ("count", "sum", "mean"), prefix: str = "_",
                nodata: float | None = None, cell: float = 1000.0) -> DataFrame:
    """Statistics of the cells in each zone (cell centres, population variance); zones without cells keep NULLs.

    Cells are first reduced to one row per (zone, value). Variances are merged from deviations around each zone's mean, so
    large values don't cancel. Medians are searched for by value ranges, exactly.
    """
    unknown = [s for s in stats if s not in ZONAL]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}; use {ZONAL}")
    hits = zonal_join(zones, cells, key, cell)
    v = hits.withColumn("value", valid(F.col("value"), nodata)).where("value is not null")
    counted = cut_lineage(v.groupBy(key, "value").agg(F.count("*").alias("k")))       # the spatial join runs once
    val, k = F.col("value"), F.col("k")
    n, s = F.sum(k), F.sum(val * k)
    made = {
        "count": n, "sum": s, "mean": s / n, "min": F.min(val), "max": F.max(val), "range": F.max(val) - F.min(val),
        "variety": F.count("*"),
        "majority": F.max(F.struct(k.alias("k"), (-val).alias("v"))), "minority": F.min(F.struct(k.alias("k"), val.alias("v"))),
    }
    out = counted.groupBy(key).agg(n.alias("zone_n"), (s / n).alias("zone_mean"), *[made[x].alias(f"{prefix}{x}") for x in stats if x in made])
    if {"variance", "stdev"} & set(stats):
        means = out.select(F.col(key).alias("_key"), "zone_n", "zone_mean")
        around = counted.join(means, F.col(key).eqNullSafe(F.col("_key"))).groupBy(key).agg(
            (F.sum(k * (val - F.col("zone_mean")) * (val - F.col("zone_mean"))) / F.first("zone_n")).alias(f"{prefix}variance"))
        around = around.withColumn(f"{prefix}stdev", F.sqrt(f"{prefix}variance")).withColumnRenamed(key, "_key")
        out = out.join(around, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    if "median" in stats:
        mid = exact_quantiles(v, "value", [0.5], key).select(F.col(key).alias("_key"), F.col("quantiles")[0].alias(f"{prefix}median"))
        out = out.join(mid, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    out = out.select(key, *[f"{prefix}{x}" for x in stats])
    for x in ("majority", "minority"):
        if x in stats:
            got = F.col(f"{prefix}{x}.v")
            out = out.withColumn(f"{prefix}{x}", -got if x == "majority" else got)
    return zones.join(out, key, "left")


def rasterize(polygons: DataFrame, value: str, grid: Grid, geom: str = "geom", cell: float = 1000.0) -> DataFrame:
    """Grid cells with the greatest value of the polygons over their centre, 0 elsewhere.

    Polygons name the cells whose centres lie in their box, or in the cells of their cover where they have many edges, and
    each centre is tested against the edges there. The grid itself takes part in one grouping only, so the work follows the area
    covered. ``cell`` has no effect any more.
    """
    g = F.col(geom)
    edges = F.filter(G.segments(g), lambda s: (s["x1"] != s["x2"]) | (s["y1"] != s["y2"]))
    shapes = cut_lineage(polygons.where(g["kind"] == "POLYGON").select(
        F.col(value).alias("value"), g.alias("geom"), edges.alias("edges"), G.bbox(g).alias("b")).where("size(edges) > 0").withColumn(
        "pid", F.monotonically_increasing_id()))
    no = lambda kind: F.lit(None).cast(kind)
    # with a corner left of and below the polygon, its whole box is one cell of a cover
    few = shapes.where(F.size("edges") <= EDGES).select(
        "value", "b", "edges", (F.col("b.xmin") - 1).alias("ox"), (F.col("b.ymin") - 1).alias("oy"), F.lit(0).alias("side"),
        no("double").alias("size"), no("long").alias("cx"), no("long").alias("cy"))
    many = shapes.where(F.size("edges") > EDGES)
    size = F.pow(F.lit(2.0), F.col("lv"))
    covers = cover(many, "pid").join(many.select("pid", "value", "b"), "pid").select(
        "value", "b", "edges", (F.col("cx") * size).alias("ox"), (F.col("cy") * size).alias("oy"), "side", size.alias("size"), "cx", "cy")
    own = few.unionByName(covers)
    low = lambda box, at: F.when(F.col("size").isNull(), box).otherwise(F.greatest(box, at))
    high = lambda box, at: F.when(F.col("size").isNull(), box).otherwise(F.least(box, at + F.col("size")))
    # a little more than the box, since centres are rounded; the test decides
    def inside(first, last, count):
        a, z = F.greatest(F.ceil(first - 0.501), F.lit(0)), F.least(F.floor(last - 0.499), F.lit(count - 1))
        return F.explode(F.when(a <= z, F.sequence(a, z)))
    rows = own.withColumn("row", inside((grid.y0 - high(F.col("b.ymax"), F.col("oy"))) / grid.dy, (grid.y0 - low(F.col("b.ymin"), F.col("oy"))) / grid.dy, grid.height))
    at = with_centres(rows.withColumn("col", inside((low(F.col("b.xmin"), F.col("ox")) - grid.x0) / grid.dx, (
        high(F.col("b.xmax"), F.col("ox")) - grid.x0) / grid.dx, grid.width)), grid)
    mine = F.col("size").isNull() | ((F.floor(F.col("x") / F.col("size")) == F.col("cx")) & (F.floor(F.col("y") / F.col("size")) == F.col("cy")))
    hits = at.where(mine).where(side_in_cell(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"), F.col("side"), F.col("edges")) >= 0)
    every = grid_cells(polygons.sparkSession, grid).withColumn("value", no(dict(shapes.dtypes)["value"]))
    return every.unionByName(hits.select("row", "col", "value")).groupBy("row", "col").agg(
        F.coalesce(F.max("value").cast("double"), F.lit(0.0)).alias("value"))


def points_to_dtm(points: DataFrame, res: float, how: str = "min", ground: int = 2) -> DataFrame:
    """Ground points to cell heights: ``min`` or ``mean`` of z per cell (cells numbered from the origin)."""
    g = points.where(F.col("classification") == ground)
    agg = {"min": F.min, "mean": F.avg}[how]("z")
    return g.groupBy(F.floor(F.col("x") / res).alias("cx"), F.floor(F.col("y") / res).alias("cy")).agg(
        agg.alias("z"), F.count("*").alias("n"))


def stretch(cells: DataFrame, low: float = 0.02, high: float = 0.98, nodata: float | None = None) -> DataFrame:
    """2-98 percentile stretch to 0..255 with an ``alpha`` of 0 for missing cells."""
    v = valid(F.col("value"), nodata)
    p = exact_quantiles(cells, v, [low, high]).select("quantiles").scalar()
    scaled = (v - p[0]) / (p[1] - p[0] + 1e-9) * 255.0
    return cells.withColumn("stretched", F.greatest(F.least(scaled, F.lit(255.0)), F.lit(0.0))).withColumn(
        "alpha", F.when(v.isNotNull(), 255).otherwise(0))


# ---------------------------------------------------------------- neighbourhoods

def neighbours(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cells with ``n`` = the 3 x 3 values ``[nw, n, ne, w, c, e, sw, s, se]``, NULL where a neighbour is missing.

    Two window passes (along rows, then along columns over the row triples), so a partition is one line of cells.
    """
    by = by or []
    wr, wc = Window.partitionBy(*by, "row").orderBy("col"), Window.partitionBy(*by, "col").orderBy("row")
    west = F.when(F.lag("col").over(wr) == F.col("col") - 1, F.lag("value").over(wr))
    east = F.when(F.lead("col").over(wr) == F.col("col") + 1, F.lead("value").over(wr))
    t = cells.withColumn("_t", F.array(west, F.col("value"), east))
    none = F.array(*[F.lit(None).cast("double")] * 3)
    north = F.when(F.lag("row").over(wc) == F.col("row") - 1, F.lag("_t").over(wc)).otherwise(none)
    south = F.when(F.lead("row").over(wc) == F.col("row") + 1, F.lead("_t").over(wc)).otherwise(none)
    return t.withColumn("n", F.concat(north, F.col("_t"), south)).drop("_t")


def terrain(cells: DataFrame, dx: float = 1.0, dy: float = 1.0, by: list[str] | None = None, azimuth: float = 300.0,
            altitude: float = 40.0) -> DataFrame:
    """Slope and aspect in degrees (Horn), hillshade 0..255 and ruggedness; NULL at edges and next to missing cells."""
    t = neighbours(cells, by)
    n = [F.col("n")[i] for i in range(9)]
    t = t.withColumn("_p", ((n[2] + 2 * n[5] + n[8]) - (n[0] + 2 * n[3] + n[6])) / (8.0 * dx)).withColumn(
        "_q", ((n[0] + 2 * n[1] + n[2]) - (n[6] + 2 * n[7] + n[8])) / (8.0 * dy)).withColumn(
        "_r", F.sqrt(sum(((n[i] - n[4]) * (n[i] - n[4]) for i in range(9) if i != 4), F.lit(0.0))))
    p, q = F.col("_p"), F.col("_q")
    slope = F.atan(F.hypot(p, q))
    # compass direction the surface faces: opposite to the gradient, clockwise from north
    aspect = F.pmod(F.degrees(F.atan2(-p, -q)) + 360.0, F.lit(360.0))
    zen, az = F.radians(F.lit(90.0 - altitude)), F.radians(F.lit(azimuth))
    shade = F.cos(zen) * F.cos(slope) + F.sin(zen) * F.sin(slope) * F.cos(az - F.radians(aspect))
    flat = (p == 0) & (q == 0)
    return t.select(*(by or []), "row", "col", F.degrees(slope).alias("slope"),
                    F.when(~flat, aspect).alias("aspect"),
                    F.greatest(F.lit(0.0), F.lit(255.0) * F.when(flat, F.cos(zen)).otherwise(shade)).alias("hillshade"),
                    F.col("_r").alias("ruggedness"))


def spread_extreme(cells: DataFrame, value: str, keep_max: bool) -> DataFrame:
    """3 x 3 minimum or maximum for sparse cells ``(cx, cy, value)``: each cell offers its value to its neighbours."""
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    e = cells.select("cx", "cy", F.col(value).alias("v"), F.explode(offs).alias("o"))
    agg = (F.max if keep_max else F.min)("v")
    return e.groupBy((F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy")).agg(
        agg.alias(value), F.max((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("_own")).where("_own").drop("_own")


def classify_ground(points: DataFrame, res: float, tolerance: float) -> DataFrame:
    """Points with ``ground``: no more than ``tolerance`` above the opened cell-minimum surface."""
    from geoloom.operators.skew import salted_join
    keyed = points.withColumn("cx", F.floor(F.col("x") / res)).withColumn("cy", F.floor(F.col("y") / res))
    low = keyed.groupBy("cx", "cy").agg(F.min("z").alias("surface"))
    opened = spread_extreme(spread_extreme(low, "surface", False), "surface", True)
    return salted_join(keyed, opened, ["cx", "cy"], ["x", "y", "z"]).withColumn(
        "ground", F.col("z") - F.col("surface") <= tolerance).drop("cx", "cy")


def resample(cells: DataFrame, height: int, width: int, rows: int, cols: int, nodata: float | None = None) -> DataFrame:
    """Bilinear resampling to ``rows`` x ``cols``; missing cells and those below -1000 take the median of the result."""
    spark = cells.sparkSession
    src = cells.withColumn("value", valid(F.col("value"), nodata)).where("value is not null and value >= -1000")
    t = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    at = lambda i, n, m: F.greatest(F.lit(0.0), F.least((F.col(i) + 0.5) * n / m - 0.5, F.lit(n - 1.0)))
    t = t.withColumn("fr", at("row", height, rows)).withColumn("fc", at("col", width, cols))
    corner = lambda dr, dc: F.struct(
        F.least(F.floor("fr") + dr, F.lit(height - 1)).alias("r"), F.least(F.floor("fc") + dc, F.lit(width - 1)).alias("c"),
        (F.abs(F.lit(1.0 - dr) - (F.col("fr") - F.floor("fr"))) * F.abs(F.lit(1.0 - dc) - (F.col("fc") - F.floor("fc")))).alias("w"))
    four = t.withColumn("s", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])))
    j = four.select("row", "col", F.col("s.w").alias("w"), F.col("s.r").alias("_r"), F.col("s.c").alias("_c")).join(
        src.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value"), ["_r", "_c"], "left")
    got = j.groupBy("row", "col").agg(
        F.try_divide(F.sum(F.when(F.col("value").isNotNull(), F.col("w") * F.col("value"))),
                     F.sum(F.when(F.col("value").isNotNull(), F.col("w")))).alias("value"))
    got = cut_lineage(got)
    fill = exact_median(got, "value")
    return got.select("row", "col", F.coalesce("value", fill).alias("value"))


def warp(cells: DataFrame, grid: Grid, target: Grid, method: str = "nearest") -> DataFrame:
    """Raster on ``target``'s grid and reference system: target centres are projected back and looked up."""
    from geoloom.functions.projection import project
    spark = cells.sparkSession
    t = with_centres(grid_cells(spark, target), target)
    xy = project(F.col("x"), F.col("y"), target.srid, grid.srid)
    t = t.withColumn("_p", xy).select("row", "col", ((F.col("_p.x") - grid.x0) / grid.dx - 0.5).alias("fc"),
                                      ((F.lit(grid.y0) - F.col("_p.y")) / grid.dy - 0.5).alias("fr"))
    src = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), valid(F.col("value"), grid.nodata).alias("value"))
    if method == "nearest":
        j = t.withColumn("_r", F.floor(F.col("fr") + 0.5)).withColumn("_c", F.floor(F.col("fc") + 0.5))
        return j.join(src, ["_r", "_c"], "left").select("row", "col", "value")
    if method != "bilinear":
        raise ValueError("method must be nearest or bilinear")
    corner = lambda dr, dc: F.struct(
        (F.floor("fr") + dr).alias("r"), (F.floor("fc") + dc).alias("c"),
        (F.abs(F.lit(1.0 - dr) - (F.col("fr") - F.floor("fr"))) * F.abs(F.lit(1.0 - dc) - (F.col("fc") - F.floor("fc")))).alias("w"))
    four = t.withColumn("s", F.explode(F.array(*[corner(i, k) for i in (0, 1) for k in (0, 1)])))
    j = four.select("row", "col", F.col("s.w").alias("w"), F.col("s.r").alias("_r"), F.col("s.c").alias("_c")).join(
        src, ["_r", "_c"], "left")
    have = F.col("value").isNotNull()
    return j.groupBy("row", "col").agg(F.try_divide(
        F.sum(F.when(have, F.col("w") * F.col("value"))), F.sum(F.when(have, F.col("w")))).alias("value"))
