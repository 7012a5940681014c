"""Timetable queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.scalars import hms_to_seconds, seconds_to_hms
from geoloom.operators import transit as T
from geoloom.plans.registry import query
from geoloom.plans.views import feed, view

# a Thursday inside nearly every service range, with services added and removed
DAY = "1997-03-13"

ACTIVE = f"""active_services AS (
  SELECT service_id FROM (
    SELECT service_id FROM calendar WHERE weekday_flag = 1 AND DATE '{DAY}' BETWEEN start_date AND end_date
    UNION SELECT service_id FROM calendar_dates WHERE day = DATE '{DAY}' AND exception_type = 1) s
  WHERE service_id NOT IN (SELECT service_id FROM calendar_dates WHERE day = DATE '{DAY}' AND exception_type = 2)),
active AS (SELECT t.* FROM trips t WHERE service_id IN (SELECT service_id FROM active_services))"""

HMS = "lpad(CAST({0} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"


@query("stop_service", f"""WITH {ACTIVE},
st AS (SELECT s.stop_id, s.trip_id, a.route_id, s.dep FROM stop_times s JOIN active a ON a.trip_id = s.trip_id),
agg AS (SELECT stop_id, count(*) AS num_trips, count(DISTINCT route_id) AS num_routes, min(dep) AS lo, max(dep) AS hi
        FROM st GROUP BY stop_id),
gaps AS (SELECT stop_id, dep - lag(dep) OVER (PARTITION BY stop_id ORDER BY dep) AS gap
         FROM st WHERE dep BETWEEN 25200 AND 68400),
hw AS (SELECT stop_id, avg(gap) / 60.0 AS mean_headway, min(gap) / 60.0 AS min_headway, max(gap) / 60.0 AS max_headway
       FROM gaps GROUP BY stop_id)
SELECT p.site_id AS stop_id, coalesce(num_trips, 0) AS num_trips, num_routes, round(mean_headway, 6) AS mean_headway,
       round(min_headway, 6) AS min_headway, round(max_headway, 6) AS max_headway,
       {HMS.format('lo')} AS start_time, {HMS.format('hi')} AS end_time
FROM sites p LEFT JOIN agg ON agg.stop_id = p.site_id LEFT JOIN hw ON hw.stop_id = p.site_id""")
def stop_service(spark, sf):
    out = T.stop_service(feed(spark, sf), DAY)
    return out.select("stop_id", "num_trips", "num_routes",
                      *[F.round(c, 6).alias(c) for c in ("mean_headway", "min_headway", "max_headway")],
                      "start_time", "end_time")


@query("active_trips", f"WITH {ACTIVE} SELECT trip_id, route_id, service_id FROM active")
def active_trips(spark, sf):
    return T.active_trips(feed(spark, sf), DAY).select("trip_id", "route_id", "service_id")


@query("service_exceptions_only", f"""SELECT service_id FROM calendar_dates WHERE day = DATE '{DAY}' AND exception_type = 1
  EXCEPT SELECT service_id FROM calendar_dates WHERE day = DATE '{DAY}' AND exception_type = 2""")
def service_exceptions_only(spark, sf):
    f = feed(spark, sf)
    del f["calendar"]
    return T.active_services(f, DAY)


@query("service_date", """WITH d AS (SELECT min(CAST(o_orderdate AS DATE)) AS f FROM orders)
SELECT strftime(f + CAST((8 - isodow(f)) % 7 AS INTEGER) + 1, '%Y-%m-%d') AS service_date FROM d""")
def service_date(spark, sf):
    f = feed(spark, sf)
    first = view(spark, sf, "calendar").agg(F.min("start_date").alias("d"))
    return first.select(F.date_format(T.service_date(f), "yyyy-MM-dd").alias("service_date"))


@query("restrict_to_area", """WITH kept AS (SELECT DISTINCT s.trip_id FROM stop_times s JOIN sites p ON p.site_id = s.stop_id
  WHERE p.x BETWEEN 500000 AND 506000 AND p.y BETWEEN 5400000 AND 5406000)
SELECT stop_id, count(*) AS n, count(DISTINCT s.trip_id) AS trips FROM stop_times s JOIN kept k ON k.trip_id = s.trip_id
GROUP BY stop_id""")
def restrict_to_area(spark, sf):
    f = T.restrict_to_area(feed(spark, sf), (500000, 5400000, 506000, 5406000))
    per_trip = f["stop_times"].groupBy("stop_id", "trip_id").agg(F.count("*").alias("k"))
    return per_trip.groupBy("stop_id").agg(F.sum("k").alias("n"), F.count("*").alias("trips"))


@query("headways", """WITH gaps AS (SELECT stop_id, dep - lag(dep) OVER (PARTITION BY stop_id ORDER BY dep) AS gap
  FROM stop_times WHERE dep BETWEEN 25200 AND 68400)
SELECT stop_id, round(avg(gap) / 60.0, 6) AS mean_headway, round(min(gap) / 60.0, 6) AS min_headway,
       round(max(gap) / 60.0, 6) AS max_headway FROM gaps GROUP BY stop_id""")
def headways(spark, sf):
    h = T.headways(view(spark, sf, "stop_times"), ["stop_id"], "dep", "07:00:00", "19:00:00")
    return h.select("stop_id", *[F.round(c, 6).alias(c) for c in ("mean_headway", "min_headway", "max_headway")])


@query("representative_trip", """WITH n AS (SELECT t.route_id, s.trip_id, count(*) AS n FROM stop_times s
  JOIN trips t ON t.trip_id = s.trip_id GROUP BY t.route_id, s.trip_id),
r AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY n DESC, trip_id DESC) AS rn FROM n)
SELECT route_id, trip_id, n AS n_stops FROM r WHERE rn = 1""")
def representative_trip(spark, sf):
    st = view(spark, sf, "stop_times").join(view(spark, sf, "trips").select("trip_id", "route_id"), "trip_id")
    return T.representative_trips(st)


@query("route_service", f"""WITH {ACTIVE},
st AS (SELECT s.trip_id, s.stop_id, s.stop_sequence, s.dep, a.route_id FROM stop_times s JOIN active a ON a.trip_id = s.trip_id),
per_trip AS (SELECT route_id, trip_id, count(*) AS n, min(dep) AS dep FROM st GROUP BY route_id, trip_id),
gaps AS (SELECT route_id, dep - lag(dep) OVER (PARTITION BY route_id ORDER BY dep) AS gap
         FROM per_trip WHERE dep BETWEEN 25200 AND 68400),
hw AS (SELECT route_id, avg(gap) / 60.0 AS mean_headway, min(gap) / 60.0 AS min_headway, max(gap) / 60.0 AS max_headway
       FROM gaps GROUP BY route_id),
nt AS (SELECT route_id, count(DISTINCT trip_id) AS num_trips FROM active GROUP BY route_id),
ns AS (SELECT route_id, count(DISTINCT stop_id) AS num_stops FROM st GROUP BY route_id),
rep AS (SELECT route_id, trip_id FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY n DESC, trip_id DESC) AS rn
        FROM per_trip) WHERE rn = 1),
pts AS (SELECT r.route_id, p.x, p.y, lag(p.x) OVER w AS px, lag(p.y) OVER w AS py
        FROM rep r JOIN st ON st.trip_id = r.trip_id JOIN sites p ON p.site_id = st.stop_id
        WINDOW w AS (PARTITION BY r.route_id ORDER BY st.stop_sequence, st.stop_id)),
line AS (SELECT route_id, 1 + count(*) FILTER (WHERE px IS NOT NULL AND (px <> x OR py <> y)) AS vertices,
         round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 4) AS line_length FROM pts GROUP BY route_id)
SELECT l.route_id, num_trips, num_stops, round(mean_headway, 6) AS mean_headway, round(min_headway, 6) AS min_headway,
       round(max_headway, 6) AS max_headway, vertices, line_length
FROM line l JOIN nt ON nt.route_id = l.route_id JOIN ns ON ns.route_id = l.route_id LEFT JOIN hw ON hw.route_id = l.route_id
WHERE vertices >= 2""")
def route_service(spark, sf):
    from geoloom.functions import geometry as G
    out = T.route_service(feed(spark, sf), DAY)
    return out.select("route_id", "num_trips", "num_stops",
                      *[F.round(c, 6).alias(c) for c in ("mean_headway", "min_headway", "max_headway")],
                      G.num_vertices(F.col("geom")).cast("long").alias("vertices"),
                      F.round(G.length(F.col("geom")), 4).alias("line_length"))


@query("clock_times", f"""SELECT dep, {HMS.format('dep')} AS clock, dep AS back, count(*) AS n FROM stop_times GROUP BY dep""")
def clock_times(spark, sf):
    t = view(spark, sf, "stop_times").groupBy("dep").agg(F.count("*").alias("n"))
    t = t.withColumn("clock", seconds_to_hms(F.col("dep")))
    return t.select("dep", "clock", hms_to_seconds(F.col("clock")).cast("long").alias("back"), "n")


@query("ordered_line", """WITH p AS (SELECT s.trip_id, q.x, q.y, lag(q.x) OVER w AS px, lag(q.y) OVER w AS py
  FROM stop_times s JOIN sites q ON q.site_id = s.stop_id
  WINDOW w AS (PARTITION BY s.trip_id ORDER BY s.stop_sequence, s.stop_id)),
g AS (SELECT trip_id, 1 + count(*) FILTER (WHERE px IS NOT NULL AND (px <> x OR py <> y)) AS vertices,
  round(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 4) AS line_length FROM p GROUP BY trip_id)
SELECT * FROM g WHERE vertices >= 2""")
def ordered_line(spark, sf):
    from geoloom.functions import geometry as G
    f = feed(spark, sf)
    st = f["stop_times"].join(f["stops"], "stop_id")
    lines = st.groupBy("trip_id").agg(G.line_from_points(F.collect_list(F.struct(
        F.struct("stop_sequence", "stop_id").alias("o"), F.col("stop_lon").alias("x"), F.col("stop_lat").alias("y"))),
        25832).alias("geom")).where("geom is not null")
    return lines.select("trip_id", G.num_vertices(F.col("geom")).cast("long").alias("vertices"),
                        F.round(G.length(F.col("geom")), 4).alias("line_length"))
