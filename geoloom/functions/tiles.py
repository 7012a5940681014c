"""Tile numbering and location profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# country -> metric reference system; Germany splits at 12 degrees east
COUNTRY_SRID = {"DE": 25832, "CH": 2056, "AT": 31287}
DE_EAST_SRID, DE_SPLIT_LON = 25833, 12.0
FALLBACK_SRID = 4326


def region_point(v: Column) -> Column:
    """Centre of ``[lon, lat]`` or ``[west, south, east, north]``; NULL for any other length."""
    return F.when(F.size(v) == 2, F.struct(F.get(v, 0).alias("lon"), F.get(v, 1).alias("lat"))).when(
        F.size(v) == 4, F.struct(((F.get(v, 0) + F.get(v, 2)) / 2.0).alias("lon"), ((F.get(v, 1) + F.get(v, 3)) / 2.0).alias("lat")))


def metric_srid(country: Column, lon: Column) -> Column:
    out = F.when((country == "DE") & (lon >= DE_SPLIT_LON), DE_EAST_SRID)
    for code, srid in COUNTRY_SRID.items():
        out = out.when(country == code, srid)
    return out.otherwise(FALLBACK_SRID)


def slippy_tile(lat: Column, lon: Column, z: Column) -> Column:
    """Fractional web-map tile coordinates at zoom ``z``."""
    n = F.pow(F.lit(2.0), z)
    return F.struct(((lon + 180.0) / 360.0 * n).alias("x"),
                    ((1.0 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2.0 * n).alias("y"))


def grid_tiles(box: Column, step_km: int) -> Column:
    """Lower-left corners in km of the grid tiles a metric box touches, as ``array<struct<e, n>>``."""
    size = step_km * 1000.0
    ids = lambda lo, hi: F.sequence(F.floor(lo / size) * step_km, F.floor(hi / size) * step_km, F.lit(step_km).cast("long"))
    return F.flatten(F.transform(ids(box["xmin"], box["xmax"]), lambda e: F.transform(
        ids(box["ymin"], box["ymax"]), lambda n: F.struct(e.alias("e"), n.alias("n")))))


def tile_name(template: str, *parts: Column) -> Column:
    return F.format_string(template, *parts)


# provider -> (grid step in km, reference system, file name template of easting and northing)
TILE_NAMES = {
    "BY_buildings": (2, 25832, "%d_%d.gml"),
    "NW_buildings": (1, 25832, "LoD2_32_%d_%d_1_NW.gml"),
    "BB_buildings": (1, 25833, "lod2_33%d-%d.zip"),
    "MV_buildings": (2, 25833, "lod2_33_%d_%d_2_gml.zip"),
    "BB_terrain": (1, 25833, "dgm_33%d-%d.zip"),
    "MV_terrain": (2, 25833, "dgm1_33_%d_%d_2_gtiff.tif"),
    "BY_imagery": (1, 25832, "32%d_%d.tif"),
    "BB_imagery": (1, 25833, "dop_33%d-%d.zip"),
    "MV_imagery": (2, 25833, "dop20rgbi_33_%d_%d_2_mv.tif"),
}


def provider_tiles(box: Column, provider: str) -> Column:
    """Tile file names of a provider covering a box given in the provider's own reference system."""
    step, _srid, template = TILE_NAMES[provider]
    return F.transform(grid_tiles(box, step), lambda t: F.format_string(template, t["e"], t["n"]))


def degree_tiles(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Names of the one-degree cells a box covers; a box without extent keeps its cell."""
    ids = lambda lo, hi: F.sequence(F.floor(lo), F.greatest(F.ceil(hi) - 1, F.floor(lo)))
    name = lambda v, pos, neg, w: F.concat(F.when(v >= 0, pos).otherwise(neg), F.lpad(F.abs(v).cast("string"), w, "0"))
    return F.flatten(F.transform(ids(south, north), lambda la: F.transform(ids(west, east), lambda lo: F.concat(
        name(la, "N", "S", 2), F.lit("_00_"), name(lo, "E", "W", 3)))))
