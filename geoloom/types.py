"""Schemas shared by readers and operators."""

from __future__ import annotations

from pyspark.sql import types as T

RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))

GEOM = T.StructType([
    T.StructField("kind", T.StringType()),              # POINT | LINE | POLYGON
    T.StructField("srid", T.IntegerType()),
    T.StructField("rings", RINGS),                      # ring -> vertex -> [x, y(, z)]
    T.StructField("ring_part", T.ArrayType(T.IntegerType())),  # part of each ring; first ring of a part is its shell
])

BBOX = ["xmin", "ymin", "xmax", "ymax"]

_s, _i, _d = T.StringType(), T.IntegerType(), T.DoubleType()


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


GTFS = {
    "agency": _schema(agency_id=_s, agency_name=_s, agency_url=_s, agency_timezone=_s),
    "stops": _schema(stop_id=_s, stop_name=_s, stop_lat=_d, stop_lon=_d),
    "routes": _schema(route_id=_s, agency_id=_s, route_short_name=_s, route_long_name=_s, route_type=_i),
    "trips": _schema(route_id=_s, service_id=_s, trip_id=_s),
    "stop_times": _schema(trip_id=_s, arrival_time=_s, departure_time=_s, stop_id=_s, stop_sequence=_i),
    "calendar": _schema(service_id=_s, monday=_i, tuesday=_i, wednesday=_i, thursday=_i, friday=_i,
                        saturday=_i, sunday=_i, start_date=_s, end_date=_s),
    "calendar_dates": _schema(service_id=_s, date=_s, exception_type=_i),
}

POINTS = _schema(x=_d, y=_d, z=_d, classification=_i)

HISTORY = T.StructType([
    T.StructField("ts", _s), T.StructField("test_id", _s), T.StructField("category", _s),
    T.StructField("lang", _s), T.StructField("model", _s), T.StructField("judge_model", _s),
    T.StructField("duration_s", _d), T.StructField("judge_duration_s", _d),
    T.StructField("tool_coverage", _d), T.StructField("tool_calls", T.LongType()),
    T.StructField("tools_distinct", T.LongType()), T.StructField("calls_per_step", _d),
    T.StructField("tools_offplan", T.ArrayType(_s)), T.StructField("tools_called", T.ArrayType(_s)),
    T.StructField("tools_expected", T.ArrayType(_s)), T.StructField("log", _s),
    T.StructField("criteria", T.ArrayType(T.StructType([
        T.StructField("text", _s), T.StructField("passed", T.BooleanType())]))),
    T.StructField("passed", T.BooleanType()), T.StructField("reason", _s),
])

TRACE = T.ArrayType(T.StructType([
    T.StructField("timestamp", _s), T.StructField("instructions", _s),
    T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("part_kind", _s), T.StructField("tool_name", _s),
        T.StructField("content", _s), T.StructField("args", _s)]))),
]))

# GeoJSON coordinates differ in depth per geometry type, so they are read as text and parsed per type.
GEOJSON_FEATURE = T.StructType([
    T.StructField("type", _s),
    T.StructField("properties", T.MapType(_s, _s)),
    T.StructField("geometry", T.StructType([
        T.StructField("type", _s), T.StructField("coordinates", _s)])),
])

JSONSTAT = T.StructType([
    T.StructField("id", T.ArrayType(_s)),
    T.StructField("size", T.ArrayType(_i)),
    T.StructField("dimension", T.MapType(_s, T.StructType([
        T.StructField("category", T.StructType([
            T.StructField("index", _s),                 # map or list, resolved after parsing
            T.StructField("label", T.MapType(_s, _s))]))]))),
    T.StructField("value", _s),                         # sparse map or dense list
])

CITYJSON = T.StructType([
    T.StructField("transform", T.StructType([
        T.StructField("scale", T.ArrayType(_d)), T.StructField("translate", T.ArrayType(_d))])),
    T.StructField("metadata", T.StructType([T.StructField("referenceSystem", _s)])),
    T.StructField("vertices", T.ArrayType(T.ArrayType(_d))),
    T.StructField("CityObjects", T.MapType(_s, T.StructType([
        T.StructField("type", _s),
        T.StructField("attributes", T.MapType(_s, _s)),
        T.StructField("geometry", T.ArrayType(T.StructType([
            T.StructField("type", _s), T.StructField("lod", _s),
            T.StructField("boundaries", _s),
            T.StructField("semantics", T.StructType([
                T.StructField("surfaces", T.ArrayType(T.StructType([T.StructField("type", _s)]))),
                T.StructField("values", _s)]))])))]))),
])

STAC_ITEMS = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("id", _s), T.StructField("collection", _s),
        T.StructField("bbox", T.ArrayType(_d)),
        T.StructField("properties", T.StructType([
            T.StructField("datetime", _s), T.StructField("eo:cloud_cover", _d)])),
        T.StructField("assets", T.MapType(_s, T.StructType([T.StructField("href", _s)])))]))),
])

CKAN_RESULT = T.StructType([
    T.StructField("result", T.StructType([
        T.StructField("count", T.LongType()),
        T.StructField("results", T.ArrayType(T.StructType([
            T.StructField("title", _s), T.StructField("license_title", _s), T.StructField("license_id", _s),
            T.StructField("organization", T.StructType([T.StructField("title", _s)])),
            T.StructField("resources", T.ArrayType(T.StructType([
                T.StructField("url", _s), T.StructField("access_url", _s), T.StructField("download_url", _s),
                T.StructField("format", _s), T.StructField("license", _s)])))])))])),
])

OSM_RESPONSE = T.StructType([
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("type", _s), T.StructField("id", T.LongType()),
        T.StructField("lat", _d), T.StructField("lon", _d),
        T.StructField("nodes", T.ArrayType(T.LongType())),
        T.StructField("members", T.ArrayType(T.StructType([
            T.StructField("type", _s), T.StructField("ref", T.LongType()), T.StructField("role", _s)]))),
        T.StructField("tags", T.MapType(_s, _s))]))),
])
