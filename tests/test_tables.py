"""Small tables with known answers: timetables, statistics, profiles, inventory, telemetry."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from geoloom.functions import scalars as X
from geoloom.operators import filters as S
from geoloom.operators import joins as J
from geoloom.operators import measures as M
from geoloom.operators import statistics as ST
from geoloom.operators import telemetry as TL
from geoloom.operators import transit as T


def timetable(spark, calendar=True):
    mk = spark.createDataFrame
    feed = {
        "stops": mk([("s1", "Alpha", 49.010, 12.090), ("s2", "Beta", 49.020, 12.100), ("s3", "Gamma", 49.030, 12.110)],
                    "stop_id string, stop_name string, stop_lat double, stop_lon double"),
        "routes": mk([("r1", "1", "Line one", 3)], "route_id string, route_short_name string, route_long_name string, route_type int"),
        "trips": mk([("r1", "wk", "t1"), ("r1", "wk", "t2")], "route_id string, service_id string, trip_id string"),
        "stop_times": mk([(t, f"0{h}:{m}0:00", s, i) for t, h in (("t1", 8), ("t2", 9)) for i, (m, s) in enumerate(((0, "s1"), (1, "s2"), (2, "s3")))],
                         "trip_id string, departure_time string, stop_id string, stop_sequence int"),
    }
    if calendar:
        feed["calendar"] = mk([("wk", 1, 1, 1, 1, 1, 0, 0, "20260601", "20260630")], "service_id string, monday int, tuesday int, wednesday int, "
                              "thursday int, friday int, saturday int, sunday int, start_date string, end_date string")
    else:
        feed["calendar_dates"] = mk([("wk", "20260602", 1)], "service_id string, date string, exception_type int")
    return feed


@pytest.mark.parametrize("calendar", [True, False])
def test_stop_service(spark, calendar):
    rows = {r.stop_id: r for r in T.stop_service(timetable(spark, calendar), "2026-06-02").collect()}
    assert {k: (r.num_trips, r.num_routes, r.mean_headway) for k, r in rows.items()} == {s: (2, 1, 60.0) for s in ("s1", "s2", "s3")}
    assert (rows["s2"].start_time, rows["s2"].end_time) == ("08:10:00", "09:10:00")


def test_service_off_day_and_default_date(spark):
    f = timetable(spark)
    assert T.stop_service(f, "20260606").where("num_trips > 0").count() == 0
    assert spark.range(1).select(T.service_date(f).cast("string")).first()[0] == "2026-06-02"
    window = T.stop_service(f, "20260602", window=(12.085, 49.005, 12.095, 49.015)).collect()
    assert [(r.stop_id, r.num_trips) for r in window] == [("s1", 2)]


def test_route_service(spark):
    r = T.route_service(timetable(spark), "20260602").first()
    assert (r.num_trips, r.num_stops, r.mean_headway, r.geom.kind, len(r.geom.rings[0])) == (2, 3, 60.0, "LINE", 3)


def test_headway_of_single_and_equal_departures(spark):
    d = spark.createDataFrame([("a", 30000), ("b", 30000), ("b", 30000), ("b", 30600)], "s string, dep int")
    got = {r.s: (r.mean_headway, r.min_headway, r.max_headway) for r in T.headways(d, ["s"], "dep", "07:00:00", "19:00:00").collect()}
    assert got == {"a": (None, None, None), "b": (5.0, 0.0, 10.0)}


def test_clock_beyond_midnight(spark):
    d = spark.createDataFrame([("25:10:05",), ("bad",), (None,)], "t string").select(X.hms_to_seconds(F.col("t")).alias("s"))
    assert [r.s for r in d.collect()] == [90605, None, None]
    assert d.select(X.seconds_to_hms(F.col("s"))).first()[0] == "25:10:05"


def test_attribute_profile_and_placeholders(spark):
    d = spark.createDataFrame([(10.0, "x"), (-9999.0, "NULL"), (None, "y"), (500.0, "z")], "h double, name string")
    p = {r.field: r for r in M.attribute_profile(d, ranges={"h": (0, 200)}).collect()}
    assert (p["h"]["null"], p["h"].placeholder, p["h"].out_of_range, p["name"].placeholder) == (1, 1, 2, 1)
    w = spark.createDataFrame([("NULL",), (" none ",), ("NaN",), ("N/A",), ("#N/A",), ("",)], "v string")
    assert w.where(M.is_placeholder(F.col("v"))).count() == 6
    assert w.where(M.is_placeholder(F.col("v"), M.STRICT_PLACEHOLDER_TEXT)).count() == 5


def test_two_method(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "k int, h double")
    b = spark.createDataFrame([(1, 11.0), (2, 19.0), (3, 31.0)], "k int, h double")
    s = J.difference_stats(J.compare_layers(a, b, "k", "h", "h")).first()
    assert (s.matched, s.compared, s.max_abs_diff) == (3, 3, 1.0)
    none = J.compare_layers(a, b.withColumn("k", F.col("k") + 10), "k", "h", "h")
    assert J.difference_stats(none).first().matched == 0
    nulls = J.compare_layers(a.union(spark.createDataFrame([(None, 1.0)], a.schema)), b.union(spark.createDataFrame([(None, 4.0)], b.schema)), "k", "h", "h")
    assert J.difference_stats(nulls).first().matched == 4


def test_cross_check_of_zero(spark):
    d = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (104.0, 100.0)], "v double, e double")
    assert [(r.relative, r.ok) for r in M.cross_check_value(d, "v", "e").collect()] == [
        (float("inf"), False), (float("inf"), False), (0.04, True)]


def test_stored_area(spark):
    from geoloom.functions import geometry as G
    g = G.box(F.lit(0), F.lit(0), F.lit(1000), F.lit(1000), 25832).alias("geom")
    ok = spark.range(1).select(F.lit(1e6).alias("area_m2"), g)
    assert M.area_length_consistency(ok).first().median_rel_diff < 0.01
    assert M.area_length_consistency(ok.withColumn("area_m2", F.lit(2e6))).first().median_rel_diff > 0.5
    assert M.area_length_consistency(ok.drop("area_m2")) is None
    deg = ok.withColumn("geom", F.col("geom").withField("srid", F.lit(4326)))
    assert M.area_length_consistency(deg).first().n == 0
    m = M.measure(ok.union(ok.withColumn("geom", F.lit(None).cast(ok.schema["geom"].dataType))), "$area").first()
    assert (m["sum"], m["count"]) == (1e6, 1)
    assert tuple(M.measure(ok.limit(0), "$area").first()) == (0.0, 0, None, None, None)


def test_metric_guard(spark):
    from geoloom.functions import geometry as G
    deg = spark.range(1).select(G.point(F.lit(12.0), F.lit(49.0), 4326).alias("geom"))
    with pytest.raises(Exception, match="metric CRS required"):
        S.require_metric(deg).collect()
    assert S.check_crs(deg).first().safe is False


def test_filters(spark):
    d = spark.createDataFrame([(1, " Main St ", 20.0), (2, None, 5.0), (3, "main st", 16.0)], ["id", "addr:street", "height"])
    assert [r.id for r in S.filter_expr(d, "height > 15 and addr:street == 'main st'").collect()] == [3]
    rows, missing = S.apply_where(d, {"addr:street": "MAIN ST"})
    assert [r.id for r in rows.orderBy("id").collect()] == [1, 3] and missing == []
    assert S.apply_where(d, {"nope": 1})[1] == ["nope"]
    part, note = S.cap_features(d, 2)
    assert part.count() == 2 and tuple(note.first()) == (3, 2, True)
    tags = spark.createDataFrame([(8, 2.0, [1, 2], True)], "admin_level int, floor double, levels array<int>, building boolean")
    assert tuple(S.stringify_columns(tags).first()) == ("8", "2", "1;2", True)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        c = spark.createDataFrame([("a", None, 1), (None, "b", 2)], "fixme string, FIXME string, n int")
        m = S.coalesce_case_collisions(c)
        assert m.columns == ["fixme", "n"] and [r.fixme for r in m.orderBy("n").collect()] == ["a", "b"]
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_tile_assets_and_scenes(spark):
    d = spark.createDataFrame([("t1", {"a": ("x_2.tif", 2.0), "b": ("x_05.tif", 0.5)}), ("t2", {"a": ("y.xyz", 0.5)})],
                              "id string, assets map<string, struct<href:string, gsd:double>>")
    assert [(r.id, r.href) for r in S.tile_assets(d, 0.5).collect()] == [("t1", "x_05.tif")]


def test_ttl_rules(spark):
    d = spark.createDataFrame([("a", "connector/osm", None, None), ("b", "connector/stac-cog", None, None), ("c", "local", None, None),
                               ("d", "connector/osm", 3, None), ("e", "connector/osm", None, 9)], "id string, source string, pinned_ttl int, rec int")
    rules = spark.createDataFrame([("connector/osm", 7), ("connector/*", 14), ("connector/stac*", 90)], "pattern string, days int")
    got = {r.id: r.ttl_days for r in J.resolve_ttl(d, rules, recorded="rec").collect()}
    assert got == {"a": 7, "b": 90, "c": 30, "d": 3, "e": 9}


def test_container_goes_when_all_layers_expired(spark):
    d = spark.createDataFrame([("f", "2026-01-01", "x"), ("f", "2026-03-01", "x"), ("g", "2026-01-01", "x"), ("u", "2020-01-01", "user")],
                              "path string, d string, source string").select("path", F.to_date("d").alias("last_used"), "source", F.lit(30).alias("ttl_days"))
    gone = J.expired_files(d, F.to_date(F.lit("2026-03-02")))
    assert [r.path for r in gone.collect()] == ["g"]


def test_region_hierarchy(spark):
    d = spark.createDataFrame([("09375117",), ("09375",), ("DE232",), ("09",), ("X1",)], "c string").select("c", X.region_hierarchy(F.col("c")).alias("h"))
    got = {r.c: (r.h.key, r.h.level, [e.code for e in r.h.escalation or []]) for r in d.collect()}
    assert got["09375117"] == ("ags", "Gemeinde", ["09375", "093", "09", ""])
    assert got["09375"] == ("ags", "Kreis", ["093", "09", ""])
    assert got["DE232"] == ("nuts", "NUTS3 (Kreis)", ["DE23", "DE2", "DE"])
    assert got["09"] == ("ags", "Land", [""]) and got["X1"][0] is None


def test_catalogue_urls(spark):
    u = "https://maps.example.org/cgi?map=/a.map&SERVICE=WFS&VERSION=2.0.0&REQUEST=GetFeature&TYPENAME=ns:layer"
    d = spark.createDataFrame([(u, "CSV"), ("https://x.org/a.zip", ""), ("https://x.org/doc", "WMS server"), ("https://x.org/doc", "odd")], "u string, f string")
    got = [r[0] for r in d.select(X.classify_resource(F.col("u"), F.col("f"))).collect()]
    assert got == ["WFS", "Shapefile", "WMS", "odd"]
    w = d.limit(1).select(X.wfs_split(F.col("u")).alias("w")).first().w
    assert (w.base, w.typename) == ("https://maps.example.org/cgi?map=/a.map", "ns:layer")


def test_names_and_claims(spark):
    d = spark.createDataFrame([("ws/innenstadt_boundary.gpkg", "Altstadt von Regensburg mit Stadtamhof", True), ("districts_innenstadt.gpkg", "Innenstadt", False),
                               ("clip_mask.gpkg", "Altstadt", False), ("muenchen.gpkg", "München", False)], "p string, n string, want boolean")
    assert all(r.want == r.got for r in d.select("want", X.area_identity_conflict(F.col("p"), F.col("n")).alias("got")).collect())
    t = spark.createDataFrame([("saved out/map.html and roads.gpkg; see https://e.org/data.tif",)], "t string")
    assert t.select(X.claimed_files(F.col("t"))).first()[0] == ["map.html", "roads.gpkg"]


def test_tools(spark):
    d = spark.createDataFrame([(["a", "b|c", "d"], ["c", "a", "a", "x"]), ([], ["x"])], "want array<string>, called array<string>")
    r = d.select(X.tool_coverage(F.col("want"), F.col("called")).alias("cov"), X.missing_tools(F.col("want"), F.col("called")).alias("miss"),
                 X.tool_effort(F.col("want"), F.col("called")).alias("e")).collect()
    assert r[0].cov == pytest.approx(2 / 3) and r[0].miss == ["d"] and r[1].cov is None
    assert (r[0].e.calls, r[0].e.distinct, r[0].e.per_step, r[0].e.offplan) == (4, 3, 1.3, ["x"])


def test_shards_and_latest(spark):
    d = spark.range(34).select("id")
    sizes = [r["count"] for r in TL.shard(d, "id", 8).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [5, 5, 4, 4, 4, 4, 4, 4]
    h = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("s", 1, "c")], "test_id string, seq int, model string")
    assert sorted((r.test_id, r.model) for r in TL.latest_per_test(h, ["seq"]).collect()) == [("s", "c"), ("t", "b")]


def test_natural_breaks(spark):
    d = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 50, 51, 52, 200, 201)], "v double")
    assert M.class_breaks(d, "v", "NaturalBreaks", 3).first().breaks == [3.0, 52.0, 201.0]
    two = spark.createDataFrame([(1.0,), (1.0,), (9.0,)], "v double")
    for scheme in ("NaturalBreaks", "Quantiles", "EqualInterval"):
        r = M.class_breaks(two, "v", scheme, 5).first()
        assert r.k == 2 and r.breaks[-1] == 9.0


def test_gini(spark):
    import random
    rnd = random.Random(3)
    v = sorted(float(rnd.randint(1, 30)) for _ in range(400))
    want = 2 * sum(i * x for i, x in enumerate(v, 1)) / (len(v) * sum(v)) - (len(v) + 1) / len(v)
    assert M.gini(spark.createDataFrame([(x,) for x in v], "v double"), "v").first().gini == pytest.approx(want)


def test_tile_cap(spark):
    d = spark.range(5)
    assert ST.within_tile_cap(d, 5).count() == 5
    with pytest.raises(Exception, match="narrow the area"):
        ST.within_tile_cap(d, 4).collect()


def test_registry(spark):
    from geoloom.operators import registry as R
    assert R.describe("stop_service")["parameters"]["headway_start"] == "07:00:00"
    d = spark.createDataFrame([(1, 20.0), (2, 5.0)], "id int, height double")
    assert R.run("filter_expr", d, "height > 15").count() == 1
    with pytest.raises(KeyError):
        R.run("nothing_like_it", d)
    assert R.map_features(d, lambda p: p.assign(h2=p.height * 2), "id int, height double, h2 double").agg(F.sum("h2")).first()[0] == 50.0
    import pandas as pd
    agg = R.aggregate_features(d.withColumn("g", F.lit("a")), ["g"], lambda p: pd.DataFrame({"g": [p.g.iloc[0]], "s": [p.height.sum()]}),
                               lambda p: pd.DataFrame({"g": [p.g.iloc[0]], "s": [p.s.sum()]}), "g string, s double", "g string, s double")
    assert agg.first().s == 25.0
    R.register_sql_functions(spark)
    assert spark.sql("select count(*) from grid_tiles(500000, 5400000, 503999, 5401999, 2)").first()[0] == 2


def test_catalogues(spark):
    from geoloom.sources import catalogues as C
    assert C.feeds(spark).where("gated").count() == 2
    assert C.boundary_levels(spark).where("level = 'GEM'").first().key_column == "AGS"
    assert C.plausibility_bands(spark).count() == 8 and C.topographic_themes(spark).count() == 9
    assert C.regions(spark).count() == 3 and C.tile_sources(spark).where("state = 'BY'").count() == 2


def test_unique_names_with_taken_suffixes(spark):
    rows = [(1, "a"), (2, "a"), (3, "a_2"), (4, "a_2"), (5, "a"), (6, "a__2"), (7, None), (8, None)]
    got = {r["i"]: r["name"] for r in ST.unique_names(spark.createDataFrame(rows, "i int, name string"), "name", ["i"]).collect()}
    assert got[1] == "a" and got[3] == "a_2" and got[6] == "a__2" and got[4] == "a_2_2" and got[5] == "a_3"
    assert len({v for v in got.values() if v}) == len([v for v in got.values() if v]) and len(got) == len(rows)


def test_gazetteer_options(spark):
    """All places of an ambiguous name up to ``top``, with box and area, beside the full count."""
    rows = [(i, "Neustadt", 0.5 - i / 100, (8.0, 49.0, 8.0 + i / 10, 49.1)) for i in range(1, 8)] + [(9, "Halle", 0.1, None), (10, "neustadt ", None, None)]
    places = spark.createDataFrame(rows, "place_id long, name string, importance double, bbox struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    names = spark.createDataFrame([(" NEUSTADT",), ("halle",), ("nowhere",)], "name string")
    got = {r.name: r for r in J.match_gazetteer(names, places).collect()}
    many = got[" NEUSTADT"]
    assert (many.place_id, many.candidates, many.ambiguous) == (1, 8, True)
    assert [o.place_id for o in many.options] == [1, 2, 3, 4, 5] and many.options[1].bbox.xmax == 8.2
    assert 75 < many.options[0].area_km2 < 85 and abs(many.options[1].area_km2 / many.options[0].area_km2 - 2) < 0.01
    assert [(o.place_id, o.area_km2) for o in got["halle"].options] == [(9, None)] and got["nowhere"].options == []
    assert [o.place_id for o in {r.name: r for r in J.match_gazetteer(names, places, top=8).collect()}[" NEUSTADT"].options][-1] == 10
