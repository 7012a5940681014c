"""Geometry interchange: WKT, WKB and GeoJSON coordinates."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.geometry import make_geom
from geoloom.types import GEOM

_NAMES = {"POINT": "POINT", "LINESTRING": "LINE", "POLYGON": "POLYGON", "MULTIPOINT": "POINT", "MULTILINESTRING": "LINE",
          "MULTIPOLYGON": "POLYGON"}
_KIND = lambda c: F.element_at(F.create_map(*[F.lit(v) for kv in _NAMES.items() for v in kv]), c)


def _vertex(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.try_cast("double"))


def from_wkt(text: Column, srid=None) -> Column:
    """Geometry from WKT; NULL for text that is none. EMPTY gives a geometry without rings."""
    t = F.upper(F.trim(text))
    name = F.regexp_extract(t, r"^(MULTI)?(POINT|LINESTRING|POLYGON)", 0)
    body = F.regexp_replace(F.regexp_extract(t, r"^[A-Z ]+?(\(.*\))\s*$", 1), r"\s*,\s*", ",")
    multi_point = name == "MULTIPOINT"
    ring_texts = F.regexp_extract_all(body, F.lit(r"\(([^()]+)\)"), F.lit(1))
    points = F.split(F.regexp_replace(body, r"[()]", ""), ",")
    rings = F.when(multi_point, F.transform(points, lambda p: F.array(_vertex(p)))).otherwise(
        F.transform(ring_texts, lambda r: F.transform(F.split(r, ","), _vertex)))
    # in a multi-polygon a part ends where two brackets close
    pieces = F.transform(F.split(body, r"\)\),\(\("), lambda p: F.size(F.split(p, r"\),\(")))
    part_of = F.flatten(F.transform(pieces, lambda n, i: F.array_repeat(i, n)))
    counted = F.when(name == "MULTIPOLYGON", part_of).when(
        multi_point | (name == "MULTILINESTRING"), F.transform(rings, lambda r, i: i)).otherwise(F.transform(rings, lambda r: F.lit(0)))
    empty = t.rlike(r"\bEMPTY$")
    none = F.array().cast("array<array<array<double>>>")
    return F.when(name != "", F.when(empty, make_geom(_KIND(name), none, srid)).when(
        F.size(rings) > 0, make_geom(_KIND(name), rings, srid, counted)))


def _num(v: Column) -> Column:
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def to_wkt(g: Column) -> Column:
    vert = lambda v: F.array_join(F.transform(v, _num), " ")
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, vert), ", "), F.lit(")"))
    parts = F.array_distinct(g["ring_part"])
    texts = F.transform(parts, lambda p: F.array_join(F.transform(
        F.filter(g["rings"], lambda r, i: F.get(g["ring_part"], i) == p), ring), ", "))
    multi = F.size(parts) > 1
    name = F.when(g["kind"] == "LINE", "LINESTRING").otherwise(g["kind"])
    poly = F.transform(texts, lambda t: F.concat(F.lit("("), t, F.lit(")")))
    body = F.when(g["kind"] == "POLYGON", F.array_join(poly, ", ")).otherwise(F.array_join(texts, ", "))
    return F.when(g.isNotNull(), F.when(F.size(g["rings"]) == 0, F.concat(name, F.lit(" EMPTY"))).when(
        multi, F.concat(F.lit("MULTI"), name, F.lit(" ("), body, F.lit(")"))).otherwise(F.concat(name, F.lit(" "), body)))


def from_geojson(kind: Column, coordinates: Column, srid: int | None = 4326) -> Column:
    """Geometry from a GeoJSON type and its coordinates as JSON text."""
    depth = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}
    read = lambda n: F.from_json(coordinates, "array<" * n + "double" + ">" * n)
    own = F.transform
    forms = {
        "Point": (F.array(F.array(read(1))), None),
        "MultiPoint": (own(read(2), lambda p: F.array(p)), "each"),
        "LineString": (F.array(read(2)), None),
        "MultiLineString": (read(3), "each"),
        "Polygon": (read(3), None),
        "MultiPolygon": (F.flatten(read(4)), "nested"),
    }
    out = None
    for name, (rings, parts) in forms.items():
        part = None
        if parts == "each":
            part = own(rings, lambda r, i: i)
        elif parts == "nested":
            part = F.flatten(own(read(depth[name]), lambda p, i: own(p, lambda r: i)))
        g = make_geom(_NAMES[name.upper()], rings, srid, part)
        out = F.when(kind == name, g) if out is None else out.when(kind == name, g)
    return out


def to_geojson(g: Column) -> Column:
    """GeoJSON geometry object as text."""
    parts = F.array_distinct(g["ring_part"])
    multi = F.size(parts) > 1
    nested = F.transform(parts, lambda p: F.filter(g["rings"], lambda r, i: F.get(g["ring_part"], i) == p))
    r = g["rings"]
    coords = F.when(g["kind"] == "POLYGON", F.when(multi, F.to_json(nested)).otherwise(F.to_json(r))).when(
        g["kind"] == "LINE", F.when(multi, F.to_json(r)).otherwise(F.to_json(F.get(r, 0)))).otherwise(
        F.when(multi, F.to_json(F.transform(r, lambda x: x[0]))).otherwise(F.to_json(F.get(F.get(r, 0), 0))))
    name = F.concat(F.when(multi, "Multi").otherwise(""), F.when(g["kind"] == "POLYGON", "Polygon").when(
        g["kind"] == "LINE", "LineString").otherwise("Point"))
    return F.when(g.isNotNull(), F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), F.coalesce(coords, F.lit("[]")), F.lit("}")))


_WKB = {"POINT": 1, "LINE": 2, "POLYGON": 3}


def _write_wkb(kind, rings, ring_part) -> bytes:
    code = _WKB[kind]
    dim = len(rings[0][0]) if len(rings) and len(rings[0]) else 2
    z = 1000 if dim > 2 else 0
    put = lambda vs: b"".join(struct.pack(f"<{dim}d", *v[:dim]) for v in vs)
    parts: dict[int, list] = {}
    for r, p in zip(rings, ring_part):
        parts.setdefault(int(p), []).append(r)

    def one(rs):
        head = struct.pack("<BI", 1, code + z)
        if code == 1:
            return head + put(rs[0][:1])
        if code == 2:
            return head + struct.pack("<I", len(rs[0])) + put(rs[0])
        return head + struct.pack("<I", len(rs)) + b"".join(struct.pack("<I", len(r)) + put(r) for r in rs)

    if len(parts) == 1:
        return one(next(iter(parts.values())))
    return struct.pack("<BII", 1, code + 3 + z, len(parts)) + b"".join(one(rs) for rs in parts.values())


def _to_wkb(kind: pd.Series, rings: pd.Series, part: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else _write_wkb(k, r, p) for k, r, p in zip(kind, rings, part)])


def to_wkb(g: Column) -> Column:
    return F.pandas_udf(_to_wkb, "binary")(g["kind"], g["rings"], g["ring_part"])


def _read_wkb(data: bytes) -> tuple:
    pos = 0

    def take(fmt):
        nonlocal pos
        v = struct.unpack_from(order + fmt, data, pos)
        pos += struct.calcsize(order + fmt)
        return v

    rings, part, kind = [], [], None
    order = "<"

    def geometry(p):
        nonlocal order, pos, kind
        order = "<" if data[pos] == 1 else ">"
        pos += 1
        (code,) = take("I")
        srid_flag, z_flag = code & 0x20000000, code & 0x80000000
        base = code & 0xFFFF
        dim = 3 if base // 1000 or z_flag else 2
        base %= 1000
        if srid_flag:
            take("I")
        points = lambda n: [list(take(f"{dim}d")) for _ in range(n)]
        if base in (4, 5, 6):
            for i in range(take("I")[0]):
                geometry(i)
            return
        kind = {1: "POINT", 2: "LINE", 3: "POLYGON"}[base]
        if base == 1:
            rings.append(points(1))
            part.append(p)
        elif base == 2:
            rings.append(points(take("I")[0]))
            part.append(p)
        else:
            for _ in range(take("I")[0]):
                rings.append(points(take("I")[0]))
                part.append(p)

    geometry(0)
    return kind, rings, part


def _from_wkb(data: pd.Series, srid: pd.Series) -> pd.DataFrame:
    got = [(None, None, None) if d is None else _read_wkb(d) for d in data]
    return pd.DataFrame({"kind": [g[0] for g in got], "srid": pd.array(srid, dtype="Int32"), "rings": [g[1] for g in got],
                         "ring_part": [g[2] for g in got]})


def from_wkb(data: Column, srid: int | None = None) -> Column:
    return F.pandas_udf(_from_wkb, GEOM)(data, F.lit(srid).cast("int"))
