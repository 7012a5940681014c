"""Geodata views over the star-schema tables.

The test tables hold no geometry, timetable or raster, so these views derive them with integer arithmetic that reads
the same in Spark SQL and in ANSI SQL. Layouts grow with the key range (new blocks, new rows of a lattice), so feature
density, trips per stop and cells per tile stay level as the tables grow.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators.skew import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# name -> SQL over the base tables and earlier views
VIEWS: dict[str, str] = {
    # 5 x 5 grid of 4 km squares; variant 1 lacks its upper right quarter, variant 2 has a 2 km hole
    "zones": """
        SELECT n_nationkey AS zone_id,
               concat(lpad(CAST(n_regionkey + 1 AS VARCHAR(9)), 2, '0'), '3', lpad(CAST(n_nationkey % 4 AS VARCHAR(9)), 2, '0'),
                      lpad(CAST(n_nationkey AS VARCHAR(9)), 3, '0')) AS code,
               n_name AS name, n_nationkey % 3 AS variant,
               CAST(500000 + 4000 * (n_nationkey % 5) AS BIGINT) AS x0,
               CAST(5400000 + 4000 * CAST(floor(n_nationkey / 5.0) AS BIGINT) AS BIGINT) AS y0
        FROM nation""",
    "sites": """
        SELECT s_suppkey AS site_id, s_nationkey AS unit, s_acctbal AS balance,
               CAST(500000 + (s_suppkey * 7919) % 20000 AS BIGINT) AS x,
               CAST(5400000 + (s_suppkey * 104729) % 20000 + 20000 * CAST(floor(s_suppkey / 20000.0) AS BIGINT) AS BIGINT) AS y
        FROM supplier""",
    "homes": """
        SELECT c_custkey AS home_id, c_nationkey AS unit, c_acctbal AS balance, c_mktsegment AS segment,
               CAST(500000 + (c_custkey * 6113) % 20000 AS BIGINT) AS x,
               CAST(5400000 + (c_custkey * 3571) % 20000 + 20000 * CAST(floor(c_custkey / 20000.0) AS BIGINT) AS BIGINT) AS y
        FROM customer""",
    # boxes of side p_size on a 40 m street lattice: neighbours overlap where the side passes 40
    "footprints": """
        SELECT p_partkey AS bldg_id, p_size AS side, p_retailprice / 100 + p_size % 17 + 0.00003 AS height, p_brand AS street, p_type AS use,
               CAST(500000 + 40 * (p_partkey % 500) AS BIGINT) AS x0,
               CAST(5400000 + 40 * CAST(floor(p_partkey / 500.0) AS BIGINT) AS BIGINT) AS y0
        FROM part""",
    "trips": """
        SELECT CAST(o_custkey % 40 AS VARCHAR(20)) AS route_id, o_custkey AS service_id, o_orderkey AS trip_id
        FROM orders""",
    "stop_times": """
        SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, l_linenumber AS stop_sequence,
               (l_partkey * 37 + l_linenumber * 420) % 93600 AS dep
        FROM lineitem""",
    # one service per customer, running from the first to the last order day
    "calendar": """
        SELECT o_custkey AS service_id, CAST(min(o_orderdate) AS DATE) AS start_date,
               CAST(max(o_orderdate) AS DATE) AS end_date,
               CASE WHEN o_custkey % 3 <> 2 THEN 1 ELSE 0 END AS weekday_flag,
               CASE WHEN o_custkey % 3 <> 0 THEN 1 ELSE 0 END AS weekend_flag
        FROM orders GROUP BY o_custkey""",
    "calendar_dates": """
        SELECT DISTINCT o_custkey AS service_id, CAST(o_orderdate AS DATE) AS day,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS exception_type
        FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""",
    # every vector is an 8 x 8 tile; 25 tiles to a row of the mosaic
    "cells": """
        SELECT vec_id AS raster_id, pos, CAST(floor(pos / 8.0) AS INT) AS row, pos % 8 AS col,
               CAST(round(CAST(v AS DOUBLE) * 1000) AS DOUBLE) AS value
        FROM embedding_values""",
    "dem": """
        SELECT CAST(floor(raster_id / 25.0) AS BIGINT) * 8 + row AS row, (raster_id % 25) * 8 + col AS col, value
        FROM cells""",
    # lattice of 100 m streets, 100 nodes to a row; the cost of a street depends on its owner
    "streets": """
        SELECT c_custkey AS a, c_custkey + 1 AS b, 100 + c_nationkey AS cost FROM customer WHERE c_custkey % 100 <> 99
        UNION ALL
        SELECT c_custkey AS a, c_custkey + 100 AS b, 110 + c_nationkey AS cost FROM customer""",
    "history": """
        SELECT event_id, ts, event_type AS model, user_id AS test_id, value AS duration_s, value > 10 AS passed,
               CASE WHEN value > 50 THEN NULL ELSE event_id % 5 END AS tool_calls,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 8) / 8.0 END AS tool_coverage
        FROM events""",
    "messages": """
        SELECT conv_id, turn, role, text,
               CASE WHEN length(text) % 5 = 0 THEN NULL ELSE conv_id * 1000 + turn * 60 + length(text) % 60 END AS sent
        FROM conversations""",
    "points": """
        SELECT 500000 + (l_orderkey * 37 + l_partkey) % 1000 AS x,
               5400000 + CAST(floor(l_orderkey / 100.0) AS BIGINT) + l_suppkey % 7 AS y,
               floor(l_extendedprice) / 1000.0 AS z, l_linenumber AS classification, l_orderkey AS key,
               l_partkey AS part_key, l_suppkey AS supp_key
        FROM lineitem""",
    "inventory": """
        SELECT o_orderkey AS ds_id, concat('dir', CAST(o_custkey % 50 AS VARCHAR(20)), '/file', CAST(o_custkey AS VARCHAR(20)), '.gpkg') AS path,
               concat('layer', CAST(o_orderkey AS VARCHAR(20))) AS layer,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'user' WHEN '2-HIGH' THEN 'connector/osm'
                    WHEN '3-MEDIUM' THEN 'connector/gtfs' WHEN '4-NOT SPECIFIED' THEN 'connector/stac-cog'
                    ELSE 'local' END AS source,
               CAST(o_orderdate AS DATE) AS last_used,
               CASE WHEN o_orderstatus = 'P' THEN 7 END AS pinned_ttl,
               CAST(round(o_totalprice * 37) AS BIGINT) AS size_bytes
        FROM orders""",
}

DEPENDS = {"dem": ("cells",), "cells": ("embedding_values",)}

# array access is the one place where the dialects differ
_SPARK_ONLY = {"embedding_values": "SELECT vec_id, pos, v FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v"}
_ORACLE_ONLY = {"embedding_values":
                "SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings"}


def _needs(name: str) -> list[str]:
    out: list[str] = []
    for d in DEPENDS.get(name, ()):
        out += _needs(d)
    return out + [name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or derived view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = _SPARK_ONLY.get(name) or VIEWS[name]
    used = [t for t in (*TABLES, *VIEWS, *_SPARK_ONLY) if t != name and re.search(rf"\bFROM {t}\b", sql)]
    text = sql
    for t in used:
        text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
    return spark.sql(text, **{t: view(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """``sql`` preceded by the definitions of the views it names."""
    names: list[str] = []
    for v in (*_ORACLE_ONLY, *VIEWS):
        if re.search(rf"\b{v}\b", sql):
            for n in _needs(v):
                if n not in names:
                    names.append(n)
    if not names:
        return sql
    order = [n for n in (*_ORACLE_ONLY, *VIEWS) if n in names]
    ctes = ", ".join(f"{n} AS ({_ORACLE_ONLY.get(n) or VIEWS[n]})" for n in order)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


# ---------------------------------------------------------------- geometry of the views

SRID = 25832


def zone_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = view(spark, sf_dir, "zones")
    x, y = F.col("x0"), F.col("y0")
    v = G.vertex
    square = G.box_ring(x, y, x + 4000, y + 4000)
    ell = F.array(v(x, y), v(x + 4000, y), v(x + 4000, y + 2000), v(x + 2000, y + 2000), v(x + 2000, y + 4000),
                  v(x, y + 4000), v(x, y))
    hole = F.reverse(G.box_ring(x + 1000, y + 1000, x + 3000, y + 3000))
    rings = F.when(F.col("variant") == 1, F.array(ell)).when(
        F.col("variant") == 2, F.array(square, hole)).otherwise(F.array(square))
    return z.withColumn("geom", G.make_geom("POLYGON", rings, SRID))


def site_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sites").withColumn("geom", G.point("x", "y", SRID))


def home_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "homes").withColumn("geom", G.point("x", "y", SRID))


def footprint_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spread(view(spark, sf_dir, "footprints"), "bldg_id")
    return f.withColumn("geom", G.box("x0", "y0", F.col("x0") + F.col("side"), F.col("y0") + F.col("side"), SRID))


def street_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "streets")
    at = lambda c: (F.col(c) % 100 * 100, F.floor(F.col(c) / 100) * 100)
    return s.withColumn("geom", G.line(at("a"), at("b"), srid=SRID))


def feed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The views as a timetable feed (departures already in seconds)."""
    cal = view(spark, sf_dir, "calendar")
    days = ("monday", "tuesday", "wednesday", "thursday", "friday")
    fmt = lambda c: F.date_format(c, "yyyyMMdd").alias(c)
    trips = view(spark, sf_dir, "trips")
    return {
        "stops": view(spark, sf_dir, "sites").select(
            F.col("site_id").alias("stop_id"), F.col("x").alias("stop_lon"), F.col("y").alias("stop_lat")),
        "routes": trips.select("route_id").distinct(),
        "trips": trips,
        "stop_times": view(spark, sf_dir, "stop_times"),
        "calendar": cal.select(
            "service_id", *[F.col("weekday_flag").alias(d) for d in days],
            *[F.col("weekend_flag").alias(d) for d in ("saturday", "sunday")], fmt("start_date"), fmt("end_date")),
        "calendar_dates": view(spark, sf_dir, "calendar_dates").select(
            "service_id", F.date_format("day", "yyyyMMdd").alias("date"), "exception_type"),
    }


# in-zone test in plain SQL, for the oracles: strictly inside / boundary included
ZONE_INSIDE = """(p.x > z.x0 AND p.x < z.x0 + 4000 AND p.y > z.y0 AND p.y < z.y0 + 4000
  AND NOT (z.variant = 1 AND p.x >= z.x0 + 2000 AND p.y >= z.y0 + 2000)
  AND NOT (z.variant = 2 AND p.x >= z.x0 + 1000 AND p.x <= z.x0 + 3000 AND p.y >= z.y0 + 1000 AND p.y <= z.y0 + 3000))"""
ZONE_MEETS = """(p.x >= z.x0 AND p.x <= z.x0 + 4000 AND p.y >= z.y0 AND p.y <= z.y0 + 4000
  AND NOT (z.variant = 1 AND p.x > z.x0 + 2000 AND p.y > z.y0 + 2000)
  AND NOT (z.variant = 2 AND p.x > z.x0 + 1000 AND p.x < z.x0 + 3000 AND p.y > z.y0 + 1000 AND p.y < z.y0 + 3000))"""
