"""Readers: feature files, timetables, cubes, building models, rasters, catalogue responses, run history."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom import types as S
from geoloom.functions import formats as FM
from geoloom.functions import geometry as G
from geoloom.functions import scalars as X
from geoloom.operators.statistics import flatten_cube

# ---- fixed values -------------------------------------------------------------------------------------------

RASTER_SUFFIXES = (".tif", ".tiff", ".vrt", ".img", ".asc", ".jp2", ".dem")
VECTOR_SUFFIXES = (".geojson", ".gpkg", ".shp", ".sqlite", ".db", ".gml", ".kml", ".fgb", ".gpx")

# -------------------------------------------------------------------------------------------------------------


def read_geojson(spark: SparkSession, path: str, srid: int = 4326, lines: bool = False,
                 columns: dict[str, str] | None = None) -> DataFrame:
    """Features as rows: ``props`` (or the typed ``columns`` picked from it) and ``geom``.

    ``lines=True`` reads newline-delimited features, which Spark splits; a single FeatureCollection is one value per
    file and parallel over files.
    """
    if lines:
        feats = spark.read.schema(S.GEOJSON_FEATURE).json(path)
    else:
        coll = T.StructType([T.StructField("features", T.ArrayType(S.GEOJSON_FEATURE))])
        feats = spark.read.schema(coll).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*")
    geom = FM.from_geojson(F.col("geometry.type"), F.col("geometry.coordinates"), srid).alias("geom")
    if columns is None:
        return feats.select(F.col("properties").alias("props"), geom)
    return feats.select(*[F.try_element_at("properties", F.lit(c)).try_cast(t).alias(c) for c, t in columns.items()], geom)


def read_stat_csv(spark: SparkSession, path: str, key: str, columns: dict[str, str]) -> DataFrame:
    """Statistical table with a text key (leading zeros survive) and typed value columns."""
    schema = ", ".join([f"`{key}` string", *[f"`{c}` {t}" for c, t in columns.items()]])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def read_jsonstat(spark: SparkSession, path: str, dims: list[str]) -> DataFrame:
    cubes = spark.read.text(path, wholetext=True).select(F.from_json("value", S.JSONSTAT).alias("cube"))
    return flatten_cube(cubes, dims)


def _headed(spark: SparkSession, pattern: str, schema, base: str | None) -> DataFrame | None:
    """CSV files that name their columns in any order, and with extras; None if there is no such file.

    Files are grouped by their header line and each group is read with its own names, so a column never takes another's
    place. Finding the headers scans the text once for lines that name the table's first column.
    """
    mark = schema.fields[0].name
    try:
        text = spark.read.option("basePath", base or pattern.rsplit("/", 1)[0]).text(pattern)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    cells = F.transform(F.split(F.regexp_replace("value", "^\ufeff", ""), ","), lambda c: F.trim(F.translate(c, '"\r', "")))
    heads = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
                        cells.alias("names")).where(F.array_contains("names", mark))
    groups: dict[tuple, list[str]] = {}
    for r in heads.groupBy("file").agg(F.min_by("names", F.struct("block", "at")).alias("names")).orderBy("file").collect():   # one row a file
        groups.setdefault(tuple(r["names"]), []).append(r["file"])
    out = None
    for names, files in groups.items():
        r = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(", ".join(f"`{n}` string" for n in names))
        raw = (r.option("basePath", base) if base else r).csv(files)
        one = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in names
                           else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], *(["feed"] if base else []))
        out = one if out is None else out.unionByName(one)
    return out


def read_gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a timetable feed by name; optional tables that are absent are left out.

    ``folder`` holds one feed, or many feeds as ``feed=<name>`` subfolders (``feed`` then becomes a column).
    """
    out = {}
    for name, schema in S.GTFS.items():
        for pattern, base in ((f"{folder}/{name}.txt", None), (f"{folder}/feed=*/{name}.txt", folder)):
            if (found := _headed(spark, pattern, schema, base)) is not None:
                out[name] = found
                break
    missing = [n for n in ("stops", "routes", "trips", "stop_times") if n not in out]
    if missing:
        raise FileNotFoundError(f"no timetable feed in {folder}: missing {missing}")
    if "calendar" not in out and "calendar_dates" not in out:
        raise FileNotFoundError(f"no timetable feed in {folder}: needs calendar or calendar_dates")
    return out


_BLDG = "bldg:Building"


def _ring3d(text: Column) -> Column:
    n = F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.try_cast("double"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 3).cast("int") - 1), lambda i: F.slice(n, i * 3 + 1, 3))


def read_citygml_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """Semantic faces of buildings (and building parts): ``(building_id, surface_type, rings)``; holes follow the outline.

    A file is the unit of reading, so keep models tiled; buildings and faces are then exploded and spread like any rows.
    """
    rows = _buildings(spark, path)
    out = None
    for kind in ("GroundSurface", "WallSurface", "RoofSurface"):
        surf = F.regexp_extract_all("xml", F.lit(rf"(?s)<(?:\w+:)?{kind}\b.*?</(?:\w+:)?{kind}>"), F.lit(0))
        polys = F.flatten(F.transform(surf, lambda s: F.regexp_extract_all(s, F.lit(r"(?s)<(?:\w+:)?Polygon\b.*?</(?:\w+:)?Polygon>"), F.lit(0))))
        part = rows.select("building_id", F.lit(kind).alias("surface_type"), F.explode(polys).alias("p"))
        out = part if out is None else out.unionByName(part)
    rings = F.transform(F.regexp_extract_all("p", F.lit(r"(?s)<(?:\w+:)?posList\b[^>]*>(.*?)</(?:\w+:)?posList>"), F.lit(1)), _ring3d)
    return out.select("building_id", "surface_type", rings.alias("rings"))


def _buildings(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True, lineSep=None)
    each = raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<(?:\w+:)?Building\b.*?</(?:\w+:)?Building>"), F.lit(0))).alias("xml"))
    return each.withColumn("building_id", F.nullif(F.regexp_extract("xml", r'(?:gml:)?id="([^"]*)"', 1), F.lit("")))


def read_citygml(spark: SparkSession, path: str) -> DataFrame:
    """One row per building: ``measured_height`` (the greatest), ``street``, ``housenumber``, ``gml_id`` and footprint ``geom``."""
    b = _buildings(spark, path)
    heights = F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)measuredHeight\b[^>]*>\s*([^<]+?)\s*<"), F.lit(1)), lambda v: v.try_cast("double"))
    text = lambda tag: F.nullif(F.trim(F.regexp_extract("xml", rf"(?s)<(?:\w+:)?{tag}\b[^>]*>(.*?)<", 1)), F.lit(""))
    base = b.select("building_id", F.array_max(heights).alias("measured_height"), text("ThoroughfareName").alias("street"),
                    text("ThoroughfareNumber").alias("housenumber"), X.epsg_from_srs(F.regexp_extract("xml", r'srsName="([^"]*)"', 1)).alias("srid"), "xml")
    ground = F.regexp_extract_all("xml", F.lit(r"(?s)<(?:\w+:)?GroundSurface\b.*?</(?:\w+:)?GroundSurface>"), F.lit(0))
    polys = F.flatten(F.transform(ground, lambda s: F.regexp_extract_all(s, F.lit(r"(?s)<(?:\w+:)?Polygon\b.*?</(?:\w+:)?Polygon>"), F.lit(0))))
    rings = F.transform(polys, lambda p: F.transform(F.regexp_extract_all(
        p, F.lit(r"(?s)<(?:\w+:)?posList\b[^>]*>(.*?)</(?:\w+:)?posList>"), F.lit(1)), lambda t: F.transform(_ring3d(t), lambda v: F.slice(v, 1, 2))))
    t = base.withColumn("_r", rings)
    part = F.flatten(F.transform("_r", lambda p, i: F.transform(p, lambda r: i)))
    return t.select(F.col("building_id").alias("gml_id"), "measured_height", "street", "housenumber",
                    F.when(F.size("_r") > 0, G.make_geom("POLYGON", F.flatten("_r"), F.col("srid"), part)).alias("geom"))


def read_cityjson(spark: SparkSession, path: str) -> DataFrame:
    """Faces of building objects: ``(building_id, attributes, surface_type, rings, srid)``, vertices de-quantised.

    A CityJSON file shares one vertex pool, so a file is the unit of parallelism; a model is a folder of tiles.
    """
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", S.CITYJSON).alias("c"))
    v = F.transform(F.col("c.vertices"), lambda p: F.when(F.col("c.transform").isNull(), p).otherwise(F.zip_with(
        F.zip_with(p, F.col("c.transform.scale"), lambda a, b: a * b), F.col("c.transform.translate"), lambda a, b: a + b)))
    o = d.select(v.alias("v"), X.epsg_from_reference(F.col("c.metadata.referenceSystem")).alias("srid"), F.explode("c.CityObjects").alias("id", "o"))
    g = o.where(F.col("o.type").startswith("Building")).select("v", "srid", F.col("id").alias("building_id"), F.col("o.attributes").alias("attributes"),
                                                              F.explode("o.geometry").alias("g"))
    # a solid nests its shells one level deeper than a multi-surface
    solid = F.flatten(F.from_json("g.boundaries", "array<array<array<array<int>>>>"))
    multi = F.from_json("g.boundaries", "array<array<array<int>>>")
    is_solid = F.col("g.type") == "Solid"
    values = F.when(is_solid, F.flatten(F.from_json("g.semantics.values", "array<array<int>>"))).otherwise(F.from_json("g.semantics.values", "array<int>"))
    f = g.select("v", "srid", "building_id", "attributes", F.col("g.semantics.surfaces").alias("s"), values.alias("vals"),
                 F.posexplode(F.when(is_solid, solid).otherwise(multi)).alias("i", "face"))
    rings = F.transform("face", lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda k: F.get(F.col("v"), k)))
    kind = F.get(F.col("s"), F.get(F.col("vals"), F.col("i")))["type"]
    return f.select("building_id", "attributes", kind.alias("surface_type"), rings.alias("rings"), "srid")


def read_table_window(spark: SparkSession, url: str, table: str, catalogue: DataFrame, bbox: tuple, bbox_srid: int = 4326,
                      where: dict | None = None, options: dict | None = None) -> DataFrame:
    """Rows of a database table whose box meets a window; window and equality filters are pushed to the database.

    ``catalogue(table, srid)`` lists the readable spatial tables; anything else is refused. The window is moved to the
    table's reference system, never the data. The table holds its boxes as ``xmin, ymin, xmax, ymax``.
    """
    from geoloom.functions.projection import reproject_bbox
    hit = catalogue.where(F.col("table") == table).select("srid").first()
    if hit is None:
        raise ValueError(f"table {table!r} is not in the catalogue")
    w = spark.range(1).select(F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(S.BBOX, bbox)]).alias("b")).select(
        reproject_bbox(F.col("b"), bbox_srid, hit["srid"]).alias("w")).first()["w"]
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()
    names = {c.lower(): c for c in df.columns}
    col = lambda c: F.col(names[c.lower()])
    out = df.where((col("xmax") >= w["xmin"]) & (col("xmin") <= w["xmax"]) & (col("ymax") >= w["ymin"]) & (col("ymin") <= w["ymax"]))
    for c, v in (where or {}).items():
        if c.lower() not in names:
            raise ValueError(f"no column {c!r} in {table}")
        out = out.where(col(c) == v)
    return out


def describe_layers(layers: dict[str, DataFrame], geom: str = "geom") -> DataFrame:
    """One row per layer: rows, kinds, reference systems, extent and columns; one aggregate each."""
    out = None
    for name, df in layers.items():
        g = F.col(geom)
        b = df.withColumn("_b", G.bbox(g))
        row = b.agg(F.lit(name).alias("layer"), F.count("*").alias("features"), F.array_sort(F.collect_set(g["kind"])).alias("kinds"),
                    F.array_sort(F.collect_set(g["srid"])).alias("srids"), F.min("_b.xmin").alias("xmin"), F.min("_b.ymin").alias("ymin"),
                    F.max("_b.xmax").alias("xmax"), F.max("_b.ymax").alias("ymax"),
                    F.array(*[F.lit(f"{c} {t}") for c, t in df.dtypes if c != geom]).cast("array<string>").alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


def describe_folder(spark: SparkSession, root: str, geom: str = "geom") -> DataFrame:
    """The same for every GeoJSON file and Parquet layer below a folder, named by their path in it.

    Only the listing (one name a file) passes through the driver. Layers without a geometry column have empty kinds and no extent.
    """
    found = read_file_facts(spark, root, (".geojson", ".parquet")).select("path").collect()
    base = root.rstrip("/").split("/")[-1]
    layers = {}
    for path in sorted({re.sub(r"(\.parquet)/.*", r"\1", r["path"]) for r in found}):
        df = spark.read.parquet(path) if path.endswith(".parquet") else read_geojson(spark, path)
        layers[path.rsplit(f"/{base}/", 1)[-1]] = df if geom in df.columns else df.withColumn(geom, F.lit(None).cast(S.GEOM))
    if not layers:
        raise ValueError(f"no layers below {root}")
    return describe_layers(layers, geom)


def read_file_facts(spark: SparkSession, root: str, suffixes: tuple = RASTER_SUFFIXES + VECTOR_SUFFIXES) -> DataFrame:
    """Path, size and change time of the data files below a folder; folders starting with ``_`` are skipped."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    name = F.lower(F.substring_index("path", "/", -1))
    kept = F.lit(False)
    for s in suffixes:
        kept = kept | name.endswith(s)
    return f.where(kept & ~F.col("path").rlike("/_[^/]*/"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one JSON object per line; blank and broken lines are skipped."""
    return spark.read.schema(S.HISTORY).json(path, mode="DROPMALFORMED")


def read_stac_items(spark: SparkSession, path: str, assets: list[str] | None = None) -> DataFrame:
    f = spark.read.schema(S.STAC_ITEMS).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*")
    hrefs = F.transform_values("assets", lambda k, v: v["href"])
    if assets is not None:
        hrefs = F.map_filter(hrefs, lambda k, v: k.isin(*assets))
    return f.select("id", F.col("properties.datetime").alias("datetime"), "collection",
                    F.col("properties")["eo:cloud_cover"].alias("cloud_cover"), hrefs.alias("assets"), "bbox")


def read_ckan_packages(spark: SparkSession, path: str) -> DataFrame:
    """Open-data packages with classified resources, in catalogue order (``position``)."""
    r = spark.read.schema(S.CKAN_RESULT).json(path, multiLine=True).select(F.posexplode("result.results").alias("position", "d"))
    res = F.filter(F.transform(F.coalesce("d.resources", F.array().cast(S.CKAN_RESULT["result"].dataType["results"].dataType.elementType["resources"].dataType)),
                               lambda x: F.struct(X.resource_url(x).alias("url"), x["format"].alias("format"))),
                   lambda x: F.coalesce(x["url"], F.lit("")) != "")

    def classified(x):
        kind = X.classify_resource(x["url"], x["format"])
        w = F.when(kind == "WFS", X.wfs_split(x["url"]))
        return F.struct(kind.alias("service"), x["url"].alias("url"), w["base"].alias("wfs_url"), w["typename"].alias("typename"))

    return r.select("position", "d.title", X.publisher(F.col("d.organization.title")).alias("publisher"),
                    X.licence(F.col("d.license_title"), F.col("d.license_id"), F.col("d.resources")).alias("license"),
                    F.transform(res, classified).alias("resources"))


def read_osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements as features ``(osm_type, osm_id, tags, geom)``: tagged nodes, ways, and multipolygon relations.

    Ways are put together by one node join and an ordered collect per way; a closed way is a polygon. A relation takes
    its outer and inner member ways as rings, closed ones as they are and open ones linked at their end nodes; each inner
    ring goes to the least outer ring around it. Open ways that close with no others, and inner rings in no outer one, drop out.
    """
    e = spark.read.schema(S.OSM_RESPONSE).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    return assemble_osm(e)


def assemble_osm(e: DataFrame) -> DataFrame:
    nodes = e.where("type = 'node'").select(F.col("id").alias("node"), "lon", "lat", "tags")
    tagged = nodes.where(F.size(F.coalesce(F.map_keys("tags"), F.array().cast("array<string>"))) > 0)
    pts = tagged.select(F.lit("node").alias("osm_type"), F.col("node").alias("osm_id"), "tags", G.point("lon", "lat", 4326).alias("geom"))
    way = e.where("type = 'way'").select("id", "tags", F.posexplode("nodes").alias("pos", "node"))
    shape = way.join(nodes.select("node", "lon", "lat"), "node").groupBy("id").agg(
        F.first("tags").alias("tags"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))),
                                                   lambda s: F.array(s["lon"], s["lat"])).alias("v"),
        F.min_by("node", "pos").alias("a"), F.max_by("node", "pos").alias("b"))
    closed = (F.size("v") >= 4) & (F.col("v")[0] == F.element_at("v", -1))
    ways = shape.where(F.size("v") >= 2).select(
        F.lit("way").alias("osm_type"), F.col("id").alias("osm_id"), "tags",
        G.make_geom(F.when(closed, "POLYGON").otherwise("LINE"), F.array("v"), 4326).alias("geom"))
    rel = e.where("type = 'relation' and tags['type'] in ('multipolygon', 'boundary')").select("id", "tags", F.posexplode("members").alias("k", "m"))
    member = rel.where("m.type = 'way'").groupBy("id", F.col("m.ref").alias("ref"), F.coalesce(F.col("m.role") == "inner", F.lit(False)).alias("inner")).agg(
        F.min("k").alias("k")).join(shape.select(F.col("id").alias("ref"), "v", "a", "b"), "ref")
    linked = _link_ways(member.where(~closed & (F.size("v") >= 2)).select("id", "inner", "k", "a", "b")).join(member, ["id", "inner", "k"])
    turned = F.when(F.col("back"), F.reverse("v")).otherwise(F.col("v"))
    # a way starts where the one before it ended
    joined = linked.withColumn("v", turned).groupBy("id", "inner", F.col("ring").alias("k")).agg(F.array_sort(F.collect_list(F.struct("seq", "v"))).alias("s")).select(
        "id", "inner", "k", F.flatten(F.transform("s", lambda x: F.when(x["seq"] == 0, x["v"]).otherwise(F.slice(x["v"], 2, F.size(x["v"]))))).alias("v"))
    rings = member.where(closed).select("id", "inner", "k", "v").unionByName(joined.where(closed)).withColumn("size", F.abs(G.ring_area(F.col("v")))).withColumn(
        "box", G.bbox(G.make_geom("POLYGON", F.array("v"))))
    outer = rings.where("not inner").select("id", F.col("k").alias("part"), F.lit(0).alias("inner"), "k", "v", "size", "box")
    around = outer.select("id", "part", F.col("v").alias("ov"), F.col("size").alias("osize"), F.col("box").alias("obox"))
    segs = G.segments(G.make_geom("POLYGON", F.array("ov")))
    inside = rings.where("inner").join(around, "id").where(
        "osize > size and obox.xmin <= box.xmin and obox.ymin <= box.ymin and obox.xmax >= box.xmax and obox.ymax >= box.ymax").where(
        F.forall("v", lambda p: G.locate(segs, p[0], p[1]) >= 0))
    holes = inside.groupBy("id", "k").agg(F.min_by("part", F.struct("osize", "part")).alias("part"), F.first("v").alias("v")).select(
        "id", "part", F.lit(1).alias("inner"), "k", "v")
    every = outer.select("id", "part", "inner", "k", "v").unionByName(holes).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("part", "inner", "k", "v"))).alias("r"))
    starts = F.transform(F.filter("r", lambda x: x["inner"] == 0), lambda x: x["part"])
    part = F.transform("r", lambda x: (F.array_position(starts, x["part"]) - 1).cast("int"))
    tags = e.where("type = 'relation'").groupBy("id").agg(F.first("tags").alias("tags"))
    rels = every.join(tags, "id").select(F.lit("relation").alias("osm_type"), F.col("id").alias("osm_id"), "tags", G.make_geom(
        "POLYGON", F.transform("r", lambda x: x["v"]), 4326, part).alias("geom"))
    return pts.unionByName(ways).unionByName(rels)


def _link_ways(ends: DataFrame) -> DataFrame:
    """``(id, inner, ring, seq, k, back)`` of ways ``(id, inner, k, a, b)`` that close to rings at their end nodes.

    A relation becomes one row anyway, so its ways, without their vertices, are walked in one task. A walk is cut wherever
    it comes back to a node, so no ring meets itself; a way that leads nowhere is given up.
    """
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        at: dict = {}
        for k, a, b in pdf[["k", "a", "b"]].sort_values("k", ascending=False).itertuples(index=False):
            at.setdefault(a, []).append((k, b, False))
            at.setdefault(b, []).append((k, a, True))
        used, rows = set(), []
        for start in at:
            path, where = [(start, None, False)], {start: 0}
            while path:
                here = path[-1][0]
                while at[here] and at[here][-1][0] in used:
                    at[here].pop()
                if not at[here]:
                    del where[path.pop()[0]]
                    continue
                k, there, back = at[here].pop()
                used.add(k)
                if there in where:
                    cut = where[there] + 1
                    ring = [*((n, b) for _, n, b in path[cut:]), (k, back)]
                    for node, _, _ in path[cut:]:
                        del where[node]
                    del path[cut:]
                    rows += [(min(n for n, _ in ring), i, n, b) for i, (n, b) in enumerate(ring)]
                else:
                    where[there] = len(path)
                    path.append((there, k, back))
        out = pd.DataFrame(rows, columns=["ring", "seq", "k", "back"])
        out.insert(0, "inner", pdf["inner"].iloc[0])
        out.insert(0, "id", pdf["id"].iloc[0])
        return out
    return ends.groupBy("id", "inner").applyInPandas(lambda pdf: walk(pdf), "id long, inner boolean, ring int, seq int, k int, back boolean")


def read_asc_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells ``(path, row, col, value, x, y)`` of text grids; nodata cells have a NULL value.

    Each file is one tile and one task; the header rides along with its rows.
    """
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "").alias("l"))
    is_head = lambda s: F.trim(s).rlike(r"^[A-Za-z]")
    head = F.map_from_entries(F.transform(F.filter("l", is_head), lambda s: F.struct(
        F.lower(F.substring_index(F.trim(s), " ", 1)), F.regexp_extract(s, r"\s([-+0-9.eE]+)\s*$", 1).cast("double"))))
    h = t.select("path", head.alias("h"), F.posexplode(F.filter("l", lambda s: ~is_head(s))).alias("row", "line"))
    c = h.select("path", "h", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    get = lambda k: F.try_element_at("h", F.lit(k))
    size, v = get("cellsize"), F.col("v").try_cast("double")
    x0 = F.coalesce(get("xllcorner"), get("xllcenter") - size / 2)
    y0 = F.coalesce(get("yllcorner"), get("yllcenter") - size / 2)
    return c.select("path", "row", "col", F.when(~F.coalesce(v == get("nodata_value"), F.lit(False)), v).alias("value"),
                    (x0 + (F.col("col") + 0.5) * size).alias("x"), (y0 + (get("nrows") - F.col("row") - 0.5) * size).alias("y"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Point table from Parquet, or from text with a header."""
    if path.rstrip("/").endswith((".csv", ".txt", ".xyz")):
        return spark.read.csv(path, header=True, schema=S.POINTS)
    return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.POINTS])
