"""Selections and projections on feature tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.scalars import stringify_tag

ATTRIBUTE_OPS = ("=", "!=", ">", ">=", "<", "<=", "begins-with", "contains", "is-null", "is-not-null",
                 "does-not-contain")


def quote_special(expr: str, columns: list[str]) -> str:
    """Back-tick column names that are no plain identifiers (``addr:street``) where ``expr`` uses them bare."""
    special = sorted((c for c in columns if not re.fullmatch(r"[A-Za-z_]\w*", c)), key=len, reverse=True)
    for c in special:
        expr = re.sub(rf"(?<![\w`:'\"]){re.escape(c)}(?![\w`:'\"])", f"`{c}`", expr)
    return expr


def filter_expr(df: DataFrame, expr: str) -> DataFrame:
    """Rows for which a boolean SQL expression holds (``==`` is accepted for ``=``)."""
    return df.where(F.expr(quote_special(expr, df.columns)))


def filter_report(df: DataFrame, expr: str) -> DataFrame:
    """One row ``before, after, empty`` for :func:`filter_expr`, in one pass."""
    hit = F.expr(quote_special(expr, df.columns))
    return df.agg(F.count("*").alias("before"), F.count_if(hit).alias("after")).withColumn(
        "empty", F.col("after") == 0)


def extract_by_attribute(df: DataFrame, field: str, op: str, value=None) -> DataFrame:
    c = F.col(f"`{field}`")
    text = c.cast("string")
    tests: dict[str, callable] = {
        "=": lambda: c == value, "!=": lambda: c != value, ">": lambda: c > value, ">=": lambda: c >= value,
        "<": lambda: c < value, "<=": lambda: c <= value, "begins-with": lambda: text.startswith(str(value)),
        "contains": lambda: text.contains(str(value)), "does-not-contain": lambda: ~text.contains(str(value)),
        "is-null": c.isNull, "is-not-null": c.isNotNull}
    if op not in tests:
        raise ValueError(f"unknown operator {op!r}; use one of {ATTRIBUTE_OPS}")
    return df.where(tests[op]())


def apply_where(df: DataFrame, where: dict) -> tuple[DataFrame, list[str]]:
    """Rows matching every ``column: value`` pair (trimmed, case-blind text equality) and the unknown columns."""
    missing = [c for c in where if c not in df.columns]
    if missing:
        return df, missing
    for name, value in where.items():
        df = df.where(F.coalesce(F.lower(F.trim(F.col(f"`{name}`").cast("string"))) == str(value).strip().lower(),
                                 F.lit(False)))
    return df, []


def match_units(df: DataFrame, match: str, key: str, name: str) -> DataFrame:
    """Units whose key starts with ``match`` or whose name contains it (case-blind, literal)."""
    m = match.strip()
    return df.where(F.col(key).cast("string").startswith(m) | F.lower(F.col(name)).contains(m.lower()))


def land_only(df: DataFrame, column: str = "GF", value: int = 4) -> DataFrame:
    return df.where(F.col(column) == value)


def in_canton(units: DataFrame, canton, cantons: DataFrame | None = None, number: str = "kantonsnummer",
              name: str = "name") -> DataFrame:
    """Units of a canton given by number, or by part of its name looked up in ``cantons`` (smallest match)."""
    text = str(canton).strip()
    if text.isdigit():
        return units.where(F.col(number) == int(text))
    hit = cantons.where(F.lower(F.col(name)).contains(text.lower())).agg(F.min(number).alias(number))
    return units.join(hit, number, "left_semi")


def keep_columns(df: DataFrame, columns: list[str], geom: str | None = "geom") -> DataFrame:
    wanted = [c for c in columns if c in df.columns] + ([geom] if geom and geom in df.columns else [])
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def cap_features(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """At most ``n`` rows, and one row ``total, returned, truncated`` saying whether rows were left out."""
    total = df.agg(F.count("*").alias("total"))
    return df.limit(n), total.select("total", F.least("total", F.lit(n)).alias("returned"),
                                     (F.col("total") > n).alias("truncated"))


def street_filter(df: DataFrame, prefix: str, column: str = "street") -> DataFrame:
    return df.where(F.lower(F.coalesce(F.col(column), F.lit(""))).startswith(prefix.lower()))


def stringify_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Tag columns as text (see :func:`geoloom.functions.scalars.stringify_tag`); booleans stay booleans."""
    types = dict(df.dtypes)
    chosen = columns or df.columns
    return df.select(*[
        stringify_tag(F.col(f"`{c}`"), types[c]).alias(c) if c in chosen and types[c] != "boolean" else F.col(f"`{c}`")
        for c in df.columns])


def coalesce_case_collisions(df: DataFrame) -> DataFrame:
    """Merge columns equal but for case: the first spelling stays, later ones fill its NULLs.

    Needs ``spark.sql.caseSensitive=true`` while such a table is read and merged.
    """
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(c.casefold(), []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cols]).alias(cols[0]) for cols in groups.values()])


def field_calc(df: DataFrame, name: str, expr: str) -> DataFrame:
    return df.withColumn(name, F.expr(quote_special(expr, df.columns)))


def scene_filter(scenes: DataFrame, bbox: tuple, start: str | None = None, end: str | None = None,
                 max_cloud: float | None = None, limit: int | None = None) -> DataFrame:
    """Scenes whose footprint box meets the window, inside the date range, below the cloud share."""
    w, s, e, n = (float(v) for v in bbox)
    b = F.col("bbox")
    out = scenes.where((b[0] <= e) & (b[2] >= w) & (b[1] <= n) & (b[3] >= s))
    if start:
        out = out.where(F.col("datetime") >= start)
    if end:
        out = out.where(F.col("datetime") <= end)
    if max_cloud is not None:
        out = out.where(F.col("cloud_cover") < max_cloud)
    return out.orderBy(F.desc("datetime"), "id").limit(limit) if limit else out


def tile_assets(items: DataFrame, resolution: float, suffix: str = ".tif", assets: str = "assets") -> DataFrame:
    """First asset of each item with the suffix and ground resolution; items without one are left out."""
    hit = F.filter(F.map_values(F.col(assets)), lambda a: a["href"].endswith(suffix) & (a["gsd"] == float(resolution)))
    return items.withColumn("href", F.get(hit, 0)["href"]).where(F.col("href").isNotNull())


# ---------------------------------------------------------------- reference-system safety

GEOGRAPHIC_SRIDS = (4326, 4258, 4269)


def is_geographic(srid: Column) -> Column:
    return srid.isin(*GEOGRAPHIC_SRIDS)


def crs_note(srid: Column) -> Column:
    """``unknown``, ``degrees`` or ``metres``."""
    return F.when(srid.isNull(), "unknown").when(is_geographic(srid), "degrees").otherwise("metres")


def check_crs(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row per reference system found: feature count, whether it is geographic, and whether measuring is safe."""
    srid = F.col(geom)["srid"]
    return df.groupBy(srid.alias("srid")).agg(F.count("*").alias("features")).select(
        "srid", "features", F.coalesce(is_geographic(F.col("srid")), F.lit(False)).alias("is_geographic"),
        (F.col("srid").isNotNull() & ~F.coalesce(is_geographic(F.col("srid")), F.lit(False))).alias("safe"),
        crs_note(F.col("srid")).alias("note"))


def require_metric(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Pass rows through, failing the job on the first geometry in degrees or without a reference system."""
    srid = F.col(geom)["srid"]
    ok = F.col(geom).isNull() | (srid.isNotNull() & ~is_geographic(srid))
    checked = F.when(ok, F.col(geom)).otherwise(F.raise_error(F.concat(
        F.lit("metric CRS required, got srid "), F.coalesce(srid.cast("string"), F.lit("none")))))
    return df.withColumn(geom, checked)
