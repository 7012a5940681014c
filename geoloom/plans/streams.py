"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.plans.registry import query
from geoloom.plans.views import footprint_layer, view
from geoloom.streaming import streams as ST


@query("run_sessions", """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT user_id, ts, value, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, count(*) AS calls, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""")
def run_sessions(spark, sf):
    e = view(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = ST.run_sessions(e)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("user_id", "calls", fmt("first"), fmt("last"), F.round("total", 4).alias("total"))


@query("departure_board", """WITH w AS (SELECT event_type, ts, unnest(range(4)) AS k FROM events), b AS (SELECT event_type, ts, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start FROM w)
SELECT event_type AS stop_id, strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS departures, round(CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 END, 6) AS span_s FROM b GROUP BY event_type, start""".replace(" GROUP BY event_type, start", " GROUP BY event_type, b.start"))
def departure_board(spark, sf):
    e = view(spark, sf, "events").select(F.col("event_type").alias("stop_id"), F.col("ts").cast("timestamp").alias("ts"))
    b = ST.departure_board(e)
    return b.select("stop_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "departures",
                    F.round(F.col("mean_headway") * 60 * (F.col("departures") - 1), 6).alias("span_s"))


@query("feature_findings", """SELECT bldg_id, CASE bldg_id % 3 WHEN 0 THEN 'invalid_shape' ELSE 'no_srid' END AS message FROM footprints WHERE bldg_id % 3 < 2""")
def feature_findings(spark, sf):
    from geoloom.functions import geometry as G
    from geoloom.operators.quality import feature_findings as ff
    f = footprint_layer(spark, sf)
    x, y, s = F.col("x0"), F.col("y0"), F.col("side")
    bow = G.make_geom("POLYGON", F.array(F.array(G.vertex(x, y), G.vertex(x + s, y + s), G.vertex(x + s, y), G.vertex(x, y + s), G.vertex(x, y))), 25832)
    g = F.when(F.col("bldg_id") % 3 == 0, bow).when(F.col("bldg_id") % 3 == 1, F.col("geom").withField("srid", F.lit(None).cast("int"))).otherwise(F.col("geom"))
    f = f.withColumn("geom", g)
    return f.select("bldg_id", F.explode(ff(f)).alias("message"))
