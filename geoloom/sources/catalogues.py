"""Fixed catalogues as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.functions.tiles import TILE_NAMES
from geoloom.operators.measures import BANDS

# ---- fixed values -------------------------------------------------------------------------------------------

# feed, country, title, licence holder, approximate megabytes, gated
FEEDS = (
    ("de_fv", "DE", "Deutschland Schienenfernverkehr", "gtfs.de", 1, False),
    ("de_rv", "DE", "Deutschland Schienenregionalverkehr", "gtfs.de", 10, False),
    ("de_nv", "DE", "Deutschland Nahverkehr", "gtfs.de", 222, False),
    ("de_full", "DE", "Deutschland gesamt", "gtfs.de", 232, False),
    ("ch_rail", "CH", "Schweiz Schienenverkehr", "geOps", 18, False),
    ("ch_bus", "CH", "Schweiz Busverkehr", "geOps", 103, False),
    ("ch_full", "CH", "Schweiz gesamt", "geOps", 149, False),
    ("at_full", "AT", "Österreich gesamt (Mobilitätsverbünde)", "Mobilitätsverbünde", 0, True),
    ("at_oebb", "AT", "Österreich ÖBB (Schiene)", "ÖBB", 0, True),
)

# level, country, dataset, layer, key column, name column, administrative name
BOUNDARY_LEVELS = (
    ("STA", "DE", "vg250", "vg250_sta", "AGS", "GEN", "Staat (Bund)"),
    ("LAN", "DE", "vg250", "vg250_lan", "AGS", "GEN", "Land"),
    ("RBZ", "DE", "vg250", "vg250_rbz", "AGS", "GEN", "Regierungsbezirk"),
    ("KRS", "DE", "vg250", "vg250_krs", "AGS", "GEN", "Kreis / kreisfreie Stadt"),
    ("VWG", "DE", "vg250", "vg250_vwg", "AGS", "GEN", "Verwaltungsgemeinschaft"),
    ("GEM", "DE", "vg250", "vg250_gem", "AGS", "GEN", "Gemeinde"),
    ("NUTS1", "DE", "nuts250", "nuts250_n1", "NUTS_CODE", "NUTS_NAME", "NUTS-1 (Länder-Gruppen)"),
    ("NUTS2", "DE", "nuts250", "nuts250_n2", "NUTS_CODE", "NUTS_NAME", "NUTS-2 (Regierungsbezirke)"),
    ("NUTS3", "DE", "nuts250", "nuts250_n3", "NUTS_CODE", "NUTS_NAME", "NUTS-3 (Kreise)"),
    ("LAND", "CH", "swissboundaries3d", "tlm_landesgebiet", "icc", "name", "Land / Staat"),
    ("KANTON", "CH", "swissboundaries3d", "tlm_kantonsgebiet", "kantonsnummer", "name", "Kanton"),
    ("BEZIRK", "CH", "swissboundaries3d", "tlm_bezirksgebiet", "bezirksnummer", "name", "Bezirk"),
    ("GEMEINDE", "CH", "swissboundaries3d", "tlm_hoheitsgebiet", "bfs_nummer", "name", "Gemeinde (BFS-Nummer)"),
)

# theme, layer, description
TOPOGRAPHIC_THEMES = (
    ("roads", "tlmregio_transportation_road", "road network (lines)"),
    ("railways", "tlmregio_transportation_railway", "railway network (lines)"),
    ("buildings", "tlmregio_buildings_building", "building footprints (polygons)"),
    ("landcover", "tlmregio_landcover_landcover", "land cover (polygons)"),
    ("lakes", "tlmregio_hydrography_lake", "lakes / standing water (polygons)"),
    ("rivers", "tlmregio_hydrography_flowingwater", "rivers / flowing water (lines)"),
    ("builtup", "tlmregio_miscellaneous_buildupp", "built-up areas (points)"),
    ("poi", "tlmregio_miscellaneous_poi", "points of interest (points)"),
    ("names", "tlmregio_names_namedlocation", "named locations / place names (points)"),
)

# country, name, metric reference system
REGIONS = (
    ("DE", "Germany", 25832),
    ("CH", "Switzerland", 2056),
    ("AT", "Austria", 31287),
)

# -------------------------------------------------------------------------------------------------------------


def feeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FEEDS), "feed string, country string, title string, licence string, approx_mb int, gated boolean")


def boundary_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BOUNDARY_LEVELS), "level string, country string, dataset string, layer string, key_column string, name_column string, admin string")


def topographic_themes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOPOGRAPHIC_THEMES), "theme string, layer string, description string")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGIONS), "country string, name string, srid int")


def plausibility_bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in BANDS.items()], "magnitude string, min double, max double, unit string")


def tile_sources(spark: SparkSession) -> DataFrame:
    rows = [(*k.split("_"), *v) for k, v in TILE_NAMES.items()]
    return spark.createDataFrame(rows, "state string, product string, step_km int, srid int, template string")
