"""Writers: layers with provenance, GeoJSON lines, statistical CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import formats as FM
from geoloom.functions import geometry as G


def stable_json(values: dict) -> Column:
    """JSON text of literal values with sorted keys."""
    import json
    return F.lit(json.dumps(values, sort_keys=True, default=str))


def provenance(source: str, tool: str, query: dict | str | None = None, crs: str | None = None, licence: str | None = None,
               ttl_days: int | None = None, acquired: str | None = None, created_at: Column | None = None) -> Column:
    """Where a dataset came from, as a struct column; the query is kept as text with sorted keys."""
    q = stable_json(query) if isinstance(query, dict) else F.lit(query)
    made = created_at if created_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.struct(
        F.lit(source).alias("source"), F.lit(tool).alias("tool"), made.alias("created_at"), q.cast("string").alias("query"),
        F.lit(crs).cast("string").alias("crs"), F.lit(licence).cast("string").alias("licence"),
        F.lit(acquired).cast("string").alias("acquired"), F.lit(ttl_days).cast("int").alias("ttl_days"))


def write_layer(df: DataFrame, path: str, prov: Column, cell: float = 10_000.0, geom: str = "geom", mode: str = "overwrite") -> None:
    """Parquet with box columns, provenance, and rows ordered by grid cell, so window reads skip row groups.

    Rows are range-partitioned on the cell, which splits a crowded cell over several files instead of piling it on one
    task, and no folder per cell is made.
    """
    b = G.with_bbox(df, geom) if geom in df.columns else df
    b = b.withColumn("provenance", prov)
    if geom in df.columns:
        b = b.withColumn("cell_x", F.floor(F.col("xmin") / cell)).withColumn("cell_y", F.floor(F.col("ymin") / cell))
        b = b.repartitionByRange("cell_x", "cell_y", "xmin", "ymin").sortWithinPartitions("cell_x", "cell_y")
    b.write.mode(mode).parquet(path)


def write_geojson(df: DataFrame, path: str, geom: str = "geom", mode: str = "overwrite") -> None:
    """One feature per line, written in parallel."""
    attrs = [c for c in df.columns if c != geom]
    props = F.to_json(F.struct(*[F.col(f"`{c}`") for c in attrs])) if attrs else F.lit("{}")
    line = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'),
                    F.coalesce(FM.to_geojson(F.col(geom)), F.lit("null")), F.lit("}"))
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_stat_csv(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    df.withColumn(key, F.col(key).cast("string")).write.mode(mode).csv(path, header=True)
