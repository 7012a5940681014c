"""Mask regions and their outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.graph import connected_components, ring_areas, rings_to_table, stitch_rings
from geoloom.operators.raster import Grid
from geoloom.session import cut_lineage


def mask_regions(mask: DataFrame) -> DataFrame:
    """``(row, col, region)`` for the set cells ``(row, col)`` of a mask, regions by shared cell edges.

    Cells of one row are first joined to runs, which shrinks the graph by the typical run length; runs of neighbouring
    rows that share a column are its edges. The region is its least run id.
    """
    w = Window.partitionBy("row").orderBy("col")
    starts = F.when(F.coalesce(F.lag("col").over(w) == F.col("col") - 1, F.lit(False)), 0).otherwise(1)
    run = mask.select("row", "col").distinct().withColumn("_s", starts).withColumn(
        "_k", F.max(F.when(F.col("_s") == 1, F.col("col"))).over(w))
    # the run id packs its row and first column; both stay below 2^31
    cells = cut_lineage(run.select("row", "col", (F.shiftleft(F.col("row").cast("long"), 31) + F.col("_k")).alias("run")))
    below = cells.select((F.col("row") - 1).alias("row"), "col", F.col("run").alias("other"))
    edges = cells.join(below, ["row", "col"]).select(F.col("run").alias("src"), F.col("other").alias("dst")).distinct()
    comp = connected_components(edges)
    from geoloom.operators.skew import salted_join
    return salted_join(cells, comp.withColumnRenamed("node", "run"), ["run"], ["row", "col"], "left").select(
        "row", "col", F.coalesce("component", "run").alias("region"))


def region_edges(regions: DataFrame, grid: Grid) -> DataFrame:
    """Directed outline edges per region: cell sides met from one side only, the region to their left."""
    x = lambda c: grid.x0 + c * grid.dx
    y = lambda r: grid.y0 - r * grid.dy
    c, r = F.col("col"), F.col("row")
    side = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    # counter-clockwise in map coordinates; rows count southwards
    four = F.array(side(x(c), y(r + 1), x(c + 1), y(r + 1)), side(x(c + 1), y(r + 1), x(c + 1), y(r)),
                   side(x(c + 1), y(r), x(c), y(r)), side(x(c), y(r), x(c), y(r + 1)))
    e = regions.select("region", F.explode(four).alias("e")).select("region", "e.*")
    back = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    canon = e.select("region", F.when(back, -1).otherwise(1).alias("d"),
                     F.least("x1", "x2").alias("xa"), F.greatest("x1", "x2").alias("xb"),
                     F.least("y1", "y2").alias("ya"), F.greatest("y1", "y2").alias("yb"))
    once = canon.groupBy("region", "xa", "ya", "xb", "yb").agg(F.sum("d").alias("d")).where("d <> 0")
    f = F.col("d") > 0
    pick = lambda a, b, n: F.when(f, F.col(a)).otherwise(F.col(b)).alias(n)
    return once.select("region", pick("xa", "xb", "x1"), pick("ya", "yb", "y1"), pick("xb", "xa", "x2"), pick("yb", "ya", "y2"))


def polygonize_rings(mask: DataFrame, grid: Grid) -> DataFrame:
    """Outline rings ``(region, ring, vertices, signed_area)`` of the mask's regions; holes have negative area."""
    e = cut_lineage(region_edges(mask_regions(mask), grid))
    return rings_to_table(stitch_rings(e, ["region"]), ["region"])


def polygonize(mask: DataFrame, grid: Grid) -> DataFrame:
    """One polygon row per region with its area."""
    from geoloom.operators.overlay import _assemble
    e = cut_lineage(region_edges(mask_regions(mask), grid))
    shapes = _assemble(e, ["region"], grid.srid)
    return shapes.join(ring_areas(e, ["region"]), "region")
