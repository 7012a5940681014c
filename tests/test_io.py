"""Readers and writers on small files."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.sources import readers as RD
from geoloom.sources import writers as WR


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_geojson(spark, folder):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "a", "h": 5}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}},
        {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "MultiPoint", "coordinates": [[1, 1], [2, 2]]}},
        {"type": "Feature", "properties": {"name": "c"}, "geometry": None}]}
    p = put(folder, "x.geojson", json.dumps(fc, indent=1))
    d = RD.read_geojson(spark, p, columns={"name": "string", "h": "int"}).orderBy("name")
    rows = d.select("name", "h", "geom.kind", G.area(F.col("geom")).alias("a")).collect()
    assert [tuple(r) for r in rows] == [("a", 5, "POLYGON", 4.0), ("b", None, "POINT", 0.0), ("c", None, None, None)]
    out = os.path.join(folder, "out")
    WR.write_geojson(d, out)
    back = RD.read_geojson(spark, out, lines=True, columns={"name": "string", "h": "int"}).orderBy("name").collect()
    assert back == d.collect()


def test_layer_with_provenance(spark, folder):
    d = spark.range(200).select("id", G.box(F.col("id") * 100, F.lit(0), F.col("id") * 100 + 50, F.lit(50), 25832).alias("geom"))
    out = os.path.join(folder, "layer")
    WR.write_layer(d, out, WR.provenance("connector/osm", "read_osm", {"place": "x", "tags": {"b": 1, "a": 2}}, "EPSG:25832", "ODbL", 30))
    back = spark.read.parquet(out)
    r = back.first().provenance
    assert (r.source, r.ttl_days, r.query) == ("connector/osm", 30, '{"place": "x", "tags": {"a": 2, "b": 1}}')
    w = back.where("xmax >= 500 and xmin <= 720")
    assert w.count() == 3 and "PushedFilters: [IsNotNull(xmax), IsNotNull(xmin), GreaterThanOrEqual(xmax,500.0)" in w._jdf.queryExecution().toString()


def test_jsonstat(spark, folder):
    # three crops, two soils, two seasons: the last dimension runs fastest
    cube = {"id": ["crop", "soil", "season"], "size": [3, 2, 2], "dimension": {
        "crop": {"category": {"index": ["rye", "oat", "pea"], "label": {"rye": "Winter rye", "oat": "Oats", "pea": "Field peas"}}},
        "soil": {"category": {"index": {"clay": 1, "sand": 0}}},
        "season": {"category": {"index": ["s1", "s2"], "label": {"s1": "first", "s2": "s2"}}}}}
    names = ["crop", "soil", "season"]
    sparse = put(folder, "s.json", json.dumps({**cube, "value": {"0": 4.5, "7": 6.25, "10": 1, "11": 0}}))
    dense = put(folder, "d.json", json.dumps({**cube, "value": [n / 2 for n in range(12)]}))
    s, d = RD.read_jsonstat(spark, sparse, names), RD.read_jsonstat(spark, dense, names)
    assert s.count() == 4 and d.count() == 12
    at = lambda df, *k: df.where(" and ".join(f"{n} = '{v}'" for n, v in zip(names, k))).first()
    assert at(s, "oat", "clay", "s2").value == 6.25 and at(d, "pea", "sand", "s2").value == 4.5 and at(s, "pea", "clay", "s2").value == 0.0
    assert at(s, "rye", "sand", "s1").crop_label == "Winter rye"


def test_stat_csv_keeps_zeros(spark, folder):
    p = put(folder, "t.csv", "ags,name,population,area_km2\n01001,Nordhof,512,7.5\n01002,Südhof,2048,30.25\n")
    d = RD.read_stat_csv(spark, p, "ags", {"name": "string", "population": "int", "area_km2": "double"})
    assert [r.ags for r in d.orderBy("ags").collect()] == ["01001", "01002"] and d.columns == ["ags", "name", "population", "area_km2"]
    WR.write_stat_csv(d, os.path.join(folder, "o"), "ags")
    assert RD.read_stat_csv(spark, os.path.join(folder, "o"), "ags", {"name": "string", "population": "int", "area_km2": "double"}).count() == 2


GTFS = {"stops.txt": "stop_id,stop_name,stop_lat,stop_lon\ns1,Alpha,49.01,12.09\ns2,Beta,49.02,12.10\n",
        "routes.txt": "route_id,agency_id,route_short_name,route_long_name,route_type\nr1,a,1,One,3\n",
        "trips.txt": "trip_id,route_id,service_id\nt1,r1,wk\n",
        "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type\nt1,08:00:00,08:00:00,s1,1,0\nt1,08:10:00,08:10:00,s2,2,0\n",
        "calendar_dates.txt": "service_id,date,exception_type\nwk,20260602,1\n"}


def test_gtfs(spark, folder):
    from geoloom.operators.transit import stop_service
    for n, t in GTFS.items():
        put(folder, f"one/{n}", t)
        put(folder, f"many/feed=a/{n}", t)
        put(folder, f"many/feed=b/{n}", t)
    f = RD.read_gtfs(spark, os.path.join(folder, "one"))
    assert "calendar" not in f and f["stop_times"].schema["stop_sequence"].dataType.simpleString() == "int"
    assert sorted(r.num_trips for r in stop_service(f, "2026-06-02").collect()) == [1, 1]
    assert RD.read_gtfs(spark, os.path.join(folder, "many"))["stops"].groupBy("feed").count().count() == 2
    with pytest.raises(FileNotFoundError):
        RD.read_gtfs(spark, folder)


def test_gtfs_feeds_with_other_headers(spark, folder):
    """Each feed's columns are taken by its own names; a date that is none costs its row only."""
    from geoloom.operators.transit import active_services, rejected_dates
    for n, t in GTFS.items():
        put(folder, f"feed=a/{n}", t)
        put(folder, f"feed=b/{n}", t)
    put(folder, "feed=b/stops.txt", '\ufeff"stop_lat","stop_id","extra","stop_lon","stop_name"\r\n12.5,z9,x,7.25,Gamma\r\n')
    put(folder, "feed=b/calendar_dates.txt", "exception_type,service_id,date\n1,wk,20260602\n1,no,00000000\n")
    f = RD.read_gtfs(spark, folder)
    got = {(r.feed, r.stop_id, r.stop_name, r.stop_lat, r.stop_lon) for r in f["stops"].collect()}
    assert got == {("a", "s1", "Alpha", 49.01, 12.09), ("a", "s2", "Beta", 49.02, 12.10), ("b", "z9", "Gamma", 12.5, 7.25)}
    assert [r.service_id for r in active_services(f, "2026-06-02").collect()] == ["wk"]
    assert [(r.file, r.column, r.rejected) for r in rejected_dates(f).collect()] == [("calendar_dates", "date", 1)]


GML = """<?xml version="1.0"?><core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g" xmlns:xal="x"><core:cityObjectMember>
<bldg:Building gml:id="hall-3"><bldg:measuredHeight uom="m">9.25</bldg:measuredHeight><xal:ThoroughfareNumber>41a</xal:ThoroughfareNumber>
<xal:ThoroughfareName>Am Speicher</xal:ThoroughfareName><bldg:boundedBy><bldg:GroundSurface><gml:Polygon srsName="urn:adv:crs:ETRS89_UTM32"><gml:exterior><gml:LinearRing>
<gml:posList>0 0 100 10 0 100 10 10 100 0 10 100 0 0 100</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></bldg:GroundSurface></bldg:boundedBy>
<bldg:boundedBy><bldg:RoofSurface><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 112 10 0 112 10 10 112 0 10 112 0 0 112</gml:posList>
</gml:LinearRing></gml:exterior></gml:Polygon></bldg:RoofSurface></bldg:boundedBy></bldg:Building></core:cityObjectMember></core:CityModel>"""


def test_citygml(spark, folder):
    p = put(folder, "t.gml", GML)
    r = RD.read_citygml(spark, p).select("*", G.area(F.col("geom")).alias("a")).first()
    assert (r.gml_id, r.measured_height, r.street, r.housenumber, r.a, r.geom.srid) == ("hall-3", 9.25, "Am Speicher", "41a", 100.0, 25832)
    s = RD.read_citygml_surfaces(spark, p)
    assert sorted((x.surface_type, x.rings[0][0][2]) for x in s.collect()) == [("GroundSurface", 100.0), ("RoofSurface", 112.0)]


def test_cityjson(spark, folder):
    cj = {"type": "CityJSON", "version": "1.1", "transform": {"scale": [0.001, 0.001, 0.001], "translate": [100.0, 200.0, 10.0]},
          "metadata": {"referenceSystem": "https://www.opengis.net/def/crs/EPSG/0/25832"},
          "vertices": [[0, 0, 0], [1000, 0, 0], [1000, 1000, 0], [0, 1000, 0], [0, 0, 5000], [1000, 0, 5000]],
          "CityObjects": {"b": {"type": "Building", "attributes": {"measuredHeight": 5.0}, "geometry": [{
              "type": "MultiSurface", "lod": "2", "boundaries": [[[0, 1, 2, 3]], [[0, 1, 5, 4]]],
              "semantics": {"surfaces": [{"type": "GroundSurface"}, {"type": "WallSurface"}], "values": [0, 1]}}]},
              "tree": {"type": "PlantCover"}}}
    d = RD.read_cityjson(spark, put(folder, "c.json", json.dumps(cj)))
    rows = {r.surface_type: r for r in d.collect()}
    assert set(rows) == {"GroundSurface", "WallSurface"} and rows["GroundSurface"].srid == 25832
    assert rows["WallSurface"].rings[0][2] == [101.0, 200.0, 15.0] and len(rows["GroundSurface"].rings[0]) == 5
    from geoloom.operators.city import footprint_height
    assert footprint_height(d).first().height == 5.0


def test_catalogue_responses(spark, folder):
    stac = {"features": [{"id": "s1", "collection": "c", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2025-01-01", "eo:cloud_cover": 3.5},
                          "assets": {"B03": {"href": "g.tif"}, "other": {"href": "o"}}}]}
    r = RD.read_stac_items(spark, put(folder, "stac.json", json.dumps(stac)), ["B03"]).first()
    assert (r.id, r.cloud_cover, r.assets) == ("s1", 3.5, {"B03": "g.tif"})
    ckan = {"result": {"count": 1, "results": [{"title": "T", "license_title": "", "license_id": None, "organization": {"title": {"fr": "Service des eaux", "en": "Water board"}},
            "resources": [{"access_url": "[https://m.org/s?map=x&SERVICE=WFS&TYPENAME=a:b]", "format": "CSV", "license": "dl-de"}, {"format": "PDF"}]}]}}
    c = RD.read_ckan_packages(spark, put(folder, "ckan.json", json.dumps(ckan))).first()
    assert (c.publisher, c.license) == ("Water board", "dl-de") and len(c.resources) == 1
    assert (c.resources[0].service, c.resources[0].wfs_url, c.resources[0].typename) == ("WFS", "https://m.org/s?map=x", "a:b")


def test_osm(spark, folder):
    el = [{"type": "node", "id": i, "lon": x, "lat": y} for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4), (1, 1), (2, 1), (2, 2), (1, 2)])]
    el[1]["tags"] = {"amenity": "bench"}
    el += [{"type": "way", "id": 1, "nodes": [0, 1, 2, 3, 0]}, {"type": "way", "id": 2, "nodes": [4, 5, 6, 7, 4]}, {"type": "way", "id": 3, "nodes": [0, 2], "tags": {"highway": "path"}},
           {"type": "relation", "id": 9, "tags": {"type": "multipolygon"}, "members": [{"type": "way", "ref": 1, "role": "outer"}, {"type": "way", "ref": 2, "role": "inner"}]}]
    d = RD.read_osm_elements(spark, put(folder, "osm.json", json.dumps({"elements": el})))
    got = {(r.osm_type, r.osm_id): (r.kind, r.a) for r in d.select("osm_type", "osm_id", "geom.kind", G.area(F.col("geom")).alias("a")).collect()}
    assert got == {("node", 1): ("POINT", 0.0), ("way", 1): ("POLYGON", 16.0), ("way", 2): ("POLYGON", 1.0), ("way", 3): ("LINE", 0.0), ("relation", 9): ("POLYGON", 15.0)}


def test_osm_rings_of_several_ways(spark, folder):
    """Outer rings over several ways in either direction, two parts, each with a hole of its own, an island in a hole, an open way."""
    corners = {}

    def square(x, y, side):
        ids = [corners.setdefault(p, len(corners)) for p in ((x, y), (x + side, y), (x + side, y + side), (x, y + side))]
        return [*ids, ids[0]]
    a, b, hole_a, hole_b, island = square(0, 0, 10), square(20, 0, 6), square(1, 1, 6), square(21, 1, 2), square(2, 2, 1)
    ways = {1: a[:3], 2: a[2:][::-1], 3: b[:2], 4: b[3:][::-1], 5: b[1:4], 6: hole_a[:3], 7: hole_a[2:], 8: hole_b, 9: island, 10: square(40, 0, 1)[:3]}
    el = [{"type": "node", "id": i, "lon": x, "lat": y} for (x, y), i in corners.items()] + [{"type": "way", "id": w, "nodes": n} for w, n in ways.items()]
    roles = {6: "inner", 7: "inner", 8: "inner"}
    el.append({"type": "relation", "id": 90, "tags": {"type": "boundary", "name": "n"}, "members": [
        {"type": "way", "ref": w, "role": roles.get(w, "outer")} for w in (8, 2, 4, 7, 1, 3, 9, 5, 10, 6)]})
    d = RD.read_osm_elements(spark, put(folder, "osm2.json", json.dumps({"elements": el}))).where("osm_type = 'relation'")
    r = d.select("tags", G.area(F.col("geom")).alias("area"), G.num_parts(F.col("geom")).alias("parts"), G.count_holes(F.col("geom")).alias("holes"),
                 F.transform(G.parts(F.col("geom")), lambda p: G.area(p)).alias("each")).collect()
    assert len(r) == 1 and r[0].tags["name"] == "n"
    assert (r[0].area, r[0].parts, r[0].holes, sorted(r[0].each)) == (100 + 36 - 36 - 4 + 1, 3, 2, [1, 32, 64])


def test_asc_grid(spark, folder):
    p = put(folder, "g.asc", "ncols 3\nnrows 2\nxllcorner 100\nyllcorner 200\ncellsize 10\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    rows = {(r.row, r.col): (r.value, r.x, r.y) for r in RD.read_asc_grid(spark, p).collect()}
    assert rows[(0, 0)] == (1.0, 105.0, 215.0) and rows[(1, 1)][0] is None and len(rows) == 6


def test_history_skips_broken_lines(spark, folder):
    p = put(folder, "h.jsonl", '{"test_id": "a", "model": "m", "passed": true}\n\n{broken\n{"test_id": "b", "model": "m"}\n')
    assert sorted(r.test_id for r in RD.read_history(spark, p).collect()) == ["a", "b"]


def test_file_facts_and_descriptions(spark, folder):
    put(folder, "a.geojson", "{}")
    put(folder, "_cache/b.gml", "x")
    put(folder, "sub/c.tif", "xyz")
    put(folder, "note.md", "x")
    got = {os.path.basename(r.path): r.size_bytes for r in RD.read_file_facts(spark, folder).collect()}
    assert got == {"a.geojson": 2, "c.tif": 3}
    d = spark.range(3).select("id", G.point(F.col("id"), F.lit(1), 4326).alias("geom"))
    r = RD.describe_layers({"pts": d}).first()
    assert (r.features, r.kinds, r.srids, r.xmax, r["columns"]) == (3, ["POINT"], [4326], 2.0, ["id bigint"])


def test_points(spark, folder):
    p = put(folder, "p.csv", "x,y,z,classification\n1,2,3,2\n4,5,6,6\n")
    assert RD.read_points(spark, p).agg(F.sum("z")).first()[0] == 9.0


def test_a_folder_described(spark, folder):
    shapes = spark.createDataFrame([(1,), (2,)], "k int").withColumn("geom", G.box(F.col("k") * 10, 0, F.col("k") * 10 + 5, 4, 25832))
    WR.write_layer(shapes, f"{folder}/in/sub/parks.parquet", F.lit("x"))
    spark.createDataFrame([(1, "a")], "k int, name string").write.parquet(f"{folder}/in/names.parquet")
    put(folder + "/in", "one.geojson", json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"n": 3}, "geometry": {"type": "Point", "coordinates": [7.5, 48.25]}}]}))
    got = {r["layer"]: r for r in RD.describe_folder(spark, f"{folder}/in").collect()}
    assert got.keys() == {"sub/parks.parquet", "names.parquet", "one.geojson"}
    assert (got["sub/parks.parquet"]["features"], got["sub/parks.parquet"]["kinds"], got["sub/parks.parquet"]["xmax"]) == (2, ["POLYGON"], 25.0)
    assert (got["names.parquet"]["features"], got["names.parquet"]["kinds"], got["names.parquet"]["xmin"]) == (1, [], None)
    assert (got["one.geojson"]["features"], got["one.geojson"]["xmin"], got["one.geojson"]["ymax"]) == (1, 7.5, 48.25)
