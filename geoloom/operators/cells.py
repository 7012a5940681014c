"""Grid cells for spatial joins.

Every feature is filed at the grid level whose cells are at least as large as the feature, so it touches at most
2 x 2 cells however large it is: a country and a manhole cover both cost four rows. Two features meet at the
coarser of their two levels, and a pair is kept only in the cell that holds the lower-left corner of the common
part of their boxes, so each pair comes out exactly once without a ``distinct``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.skew import ROWS_PER_SALT, salted_join

MAX_LEVEL = 40


def level_of(b: Column, cell: float, expand=0.0) -> Column:
    extent = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]) + 2 * expand
    return F.least(F.when(extent > cell, F.ceil(F.log2(extent / cell))).otherwise(0).cast("int"), F.lit(MAX_LEVEL))


def cell_size(level: Column, cell: float) -> Column:
    return F.lit(float(cell)) * F.pow(F.lit(2.0), level)


def covering_cells(b: Column, levels: Column, cell: float) -> Column:
    """Array of ``struct<lv, cx, cy>`` of the cells a box touches at each of ``levels``."""
    def at(lv):
        size = cell_size(lv, cell)
        def ids(lo, hi):
            return F.sequence(F.floor(lo / size), F.floor(hi / size))
        return F.flatten(F.transform(ids(b["xmin"], b["xmax"]), lambda cx: F.transform(
            ids(b["ymin"], b["ymax"]), lambda cy: F.struct(lv.alias("lv"), cx.alias("cx"), cy.alias("cy")))))
    return F.flatten(F.transform(levels, at))


def _levels(df: DataFrame) -> Column:
    # at most MAX_LEVEL + 1 integers, evaluated inside the query as a scalar subquery
    return df.agg(F.collect_set("_lv")).scalar()


def side(df: DataFrame, prefix: str) -> DataFrame:
    """Columns of one side of a pair under a prefix (``l_`` or ``r_``), flat so that unused ones are pruned early."""
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def pair_by_cell(left: DataFrame, right: DataFrame, left_box: Column, right_box: Column, cell: float,
                 expand: float = 0.0, salt_by: list[str] | None = None,
                 rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Pairs of rows whose boxes meet, each pair once, with the input columns as ``l_*`` and ``r_*``.

    ``expand`` grows the left boxes (for distance joins). ``salt_by`` names left columns that spread hot cells.
    At a coarse level only pairs with a feature of that level meet: a left feature of the level meets all on the right, a finer one
    only those of the level. Small features never meet each other in the cells of large ones.
    """
    salt_by = salt_by or [left.columns[0]]
    b = F.struct((left_box["xmin"] - expand).alias("xmin"), (left_box["ymin"] - expand).alias("ymin"),
                 (left_box["xmax"] + expand).alias("xmax"), (left_box["ymax"] + expand).alias("ymax"))
    lhs, rhs = _boxed(left, b, "l_", "_lb", cell), _boxed(right, right_box, "r_", "_rb", cell)

    def filed(df, box, other_levels, meets):
        own = F.col("_lv")
        coarser = F.array_intersect(other_levels, F.sequence(own + 1, F.lit(MAX_LEVEL + 1)))
        at = df.withColumn("_at", F.explode(F.array_append(coarser, own)))
        out = at.withColumn("_c", F.explode(covering_cells(
            {k: F.col(f"{box}_{k}") for k in ("xmin", "ymin", "xmax", "ymax")}, F.array("_at"), cell)))
        return out.select(*[c for c in df.columns if c != "_lv"], own.alias(f"{box}_lv"), meets(F.col("_c.lv") == own, own).alias("_meets"),
                          F.col("_c.lv").alias("_lv"), F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))

    left_levels, right_levels = _levels(lhs), _levels(rhs)
    lf = filed(lhs, "_lb", right_levels, lambda own, lv: F.when(own, 0).otherwise(1)).withColumn("_sk", F.xxhash64(*[f"l_{c}" for c in salt_by]))
    both = lambda own, lv: F.explode(F.when(own & (F.array_min(left_levels) < lv), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))))
    rf = filed(rhs, "_rb", left_levels, both)
    joined = salted_join(lf, rf, ["_lv", "_cx", "_cy", "_meets"], ["_sk"], rows_per_salt=rows_per_salt)
    a, c = (lambda k: F.col(f"_lb_{k}")), (lambda k: F.col(f"_rb_{k}"))
    size = cell_size(F.col("_lv"), cell)
    return joined.where(
        (F.col("_lv") == F.greatest("_lb_lv", "_rb_lv"))
        & (a("xmin") <= c("xmax")) & (c("xmin") <= a("xmax")) & (a("ymin") <= c("ymax")) & (c("ymin") <= a("ymax"))
        & (F.floor(F.greatest(a("xmin"), c("xmin")) / size) == F.col("_cx"))
        & (F.floor(F.greatest(a("ymin"), c("ymin")) / size) == F.col("_cy"))).select(*_pair_columns(left, right))


def _pair_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [f"`l_{c}`" for c in left.columns] + [f"`r_{c}`" for c in right.columns]


def _boxed(df: DataFrame, box: Column, prefix: str, name: str, cell: float) -> DataFrame:
    """One side with its box as plain columns and its grid level; rows without a box meet nothing."""
    t = df.withColumn("_box", box)
    t = t.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns],
                 *[F.col("_box")[k].cast("double").alias(f"{name}_{k}") for k in ("xmin", "ymin", "xmax", "ymax")])
    t = t.where(F.col(f"{name}_xmin").isNotNull())
    return t.withColumn("_lv", level_of({k: F.col(f"{name}_{k}") for k in ("xmin", "ymin", "xmax", "ymax")}, cell))


def pair_points(points: DataFrame, polygons: DataFrame, x: str, y: str, poly_box: Column, cell: float,
                salt_by: list[str] | None = None, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Pairs (``l_*``, ``r_*``) of a point and a polygon whose box holds it: one cell row per point and polygon level."""
    rhs = _boxed(polygons, poly_box, "r_", "_rb", cell)
    b = {k: F.col(f"_rb_{k}") for k in ("xmin", "ymin", "xmax", "ymax")}
    rf = rhs.withColumn("_c", F.explode(covering_cells(b, F.array("_lv"), cell))).withColumn(
        "_cx", F.col("_c.cx")).withColumn("_cy", F.col("_c.cy")).drop("_c")
    size = cell_size(F.col("_lv"), cell)
    lf = side(points, "l_").withColumn("_px", F.col(f"l_{x}").cast("double")).withColumn(
        "_py", F.col(f"l_{y}").cast("double")).where("_px is not null and _py is not null")
    lf = lf.withColumn("_lv", F.explode(_levels(rhs))).withColumn("_cx", F.floor(F.col("_px") / size)).withColumn(
        "_cy", F.floor(F.col("_py") / size)).withColumn(
        "_sk", F.xxhash64(*[f"l_{c}" for c in (salt_by or [points.columns[0]])]))
    return salted_join(lf, rf, ["_lv", "_cx", "_cy"], ["_sk"], rows_per_salt=rows_per_salt).where(
        (F.col("_px") >= b["xmin"]) & (F.col("_px") <= b["xmax"]) & (F.col("_py") >= b["ymin"]) & (
            F.col("_py") <= b["ymax"])).select(*_pair_columns(points, polygons))
