"""Timetable service statistics.

A feed is a dict of DataFrames (see :func:`geoloom.sources.gtfs.read_gtfs`). A busy stop may hold a large share of
all departures, so headways never sort raw rows: departures are first counted per (key, second of day) with map-side
combining, which bounds what any one key can bring to the gap window by the seconds of a service day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import line_from_points
from geoloom.functions.scalars import hms_to_seconds, seconds_to_hms

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _date(c) -> Column:
    """The date of a feed's column; null where it is none, so that one bad row doesn't stop a feed."""
    return F.try_to_date(F.regexp_replace(F.col(c).cast("string"), "-", ""), "yyyyMMdd")


def rejected_dates(feed: dict[str, DataFrame]) -> DataFrame:
    """``(file, column, rejected)``: how many dates of the service calendars can't be read."""
    out = None
    for name, columns in (("calendar", ("start_date", "end_date")), ("calendar_dates", ("date",))):
        for c in columns if name in feed else ():
            bad = feed[name].select(F.lit(name).alias("file"), F.lit(c).alias("column"), F.count_if(
                F.col(c).isNotNull() & _date(c).isNull()).alias("rejected"))
            out = bad if out is None else out.unionByName(bad)
    return out


def _as_date(date) -> Column:
    return date if isinstance(date, Column) else F.to_date(F.lit(str(date).replace("-", "")), "yyyyMMdd")


def service_date(feed: dict[str, DataFrame], date: str | None = None) -> Column:
    """The caller's date, else the second day (Tuesday) of the feed's first Monday-based week, as a scalar column."""
    if date:
        return _as_date(date)
    days = None
    if "calendar" in feed:
        days = feed["calendar"].select(_date("start_date").alias("d"))
    if "calendar_dates" in feed:
        extra = feed["calendar_dates"].select(_date("date").alias("d"))
        days = extra if days is None else days.unionByName(extra)
    first = F.min("d")
    monday = F.when(F.dayofweek(first) == 2, first).otherwise(F.next_day(first, "MON"))
    return days.agg(F.date_add(monday, 1)).scalar()


def active_services(feed: dict[str, DataFrame], date) -> DataFrame:
    """Service ids running on ``date``: weekday flag inside the range, plus added and minus removed exceptions."""
    day = _as_date(date)
    base = None
    if "calendar" in feed:
        flag = F.element_at(F.array(*[F.col(d) for d in WEEKDAYS]), F.weekday(day) + 1)
        base = feed["calendar"].where((flag == 1) & (_date("start_date") <= day) & (_date("end_date") >= day)).select(
            "service_id")
    if "calendar_dates" in feed:
        on_day = feed["calendar_dates"].where(_date("date") == day)
        added = on_day.where("exception_type = 1").select("service_id")
        base = added if base is None else base.unionByName(added)
        base = base.join(on_day.where("exception_type = 2").select("service_id"), "service_id", "left_anti")
    return base.distinct()


def active_trips(feed: dict[str, DataFrame], date) -> DataFrame:
    return feed["trips"].join(active_services(feed, date), "service_id", "left_semi")


def restrict_to_area(feed: dict[str, DataFrame], window: tuple) -> dict[str, DataFrame]:
    """Keep whole trips that call at a stop in the window, with all their stop times, stops and routes."""
    w, s, e, n = (float(v) for v in window)
    inside = feed["stops"].where(F.col("stop_lon").between(w, e) & F.col("stop_lat").between(s, n)).select("stop_id")
    kept = feed["stop_times"].join(inside, "stop_id", "left_semi").select("trip_id").distinct()
    out = dict(feed)
    out["trips"] = feed["trips"].join(kept, "trip_id", "left_semi")
    out["stop_times"] = feed["stop_times"].join(kept, "trip_id", "left_semi")
    out["stops"] = feed["stops"].join(out["stop_times"].select("stop_id").distinct(), "stop_id", "left_semi")
    if "routes" in feed:
        out["routes"] = feed["routes"].join(out["trips"].select("route_id").distinct(), "route_id", "left_semi")
    return out


def headways(departures: DataFrame, keys: list[str], dep: str, start, end) -> DataFrame:
    """Mean, least and greatest gap in minutes between departures in the inclusive window; a lone one gives NULL."""
    lo, hi = (hms_to_seconds(F.lit(v)) if isinstance(v, str) else F.lit(v) for v in (start, end))
    per_second = departures.where(F.col(dep).between(lo, hi)).groupBy(*keys, F.col(dep).alias("_t")).agg(
        F.count("*").alias("_n"))
    gap = F.col("_t") - F.lag("_t").over(Window.partitionBy(*keys).orderBy("_t"))
    g = per_second.withColumn("_gap", gap).groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.min("_t").alias("first"), F.max("_t").alias("last"),
        F.max("_n").alias("most"), F.min("_gap").alias("least_gap"), F.max("_gap").alias("top_gap"))
    many = F.col("n") > 1
    return g.select(
        *keys,
        # consecutive gaps telescope: their mean is the span over the number of gaps
        F.when(many, (F.col("last") - F.col("first")) / (F.col("n") - 1) / 60.0).alias("mean_headway"),
        F.when(many, F.when(F.col("most") > 1, F.lit(0.0)).otherwise(F.col("least_gap") / 60.0)).alias("min_headway"),
        F.when(many, F.coalesce(F.col("top_gap"), F.lit(0)) / 60.0).alias("max_headway"))


def _timed(feed: dict[str, DataFrame], trips: DataFrame) -> DataFrame:
    st = feed["stop_times"]
    dep = F.col("dep") if "dep" in st.columns else hms_to_seconds(F.col("departure_time"))
    return st.withColumn("dep", dep).join(trips.select("trip_id", "route_id"), "trip_id")


def stop_service(feed: dict[str, DataFrame], date=None, headway_start: str = "07:00:00",
                 headway_end: str = "19:00:00", window: tuple | None = None) -> DataFrame:
    """Per stop: trips, routes, headways and service span on one day; stops without service keep 0 trips."""
    stops = feed["stops"]
    if window:
        feed = restrict_to_area(feed, window)
        w, s, e, n = (float(v) for v in window)
        stops = stops.where(F.col("stop_lon").between(w, e) & F.col("stop_lat").between(s, n))
    st = _timed(feed, active_trips(feed, service_date(feed, date))).select("stop_id", "trip_id", "route_id", "dep")
    per_route = st.groupBy("stop_id", "route_id").agg(
        F.count("trip_id").alias("n"), F.min("dep").alias("lo"), F.max("dep").alias("hi"))
    span = per_route.groupBy("stop_id").agg(
        F.sum("n").alias("num_trips"), F.count("route_id").alias("num_routes"),
        seconds_to_hms(F.min("lo")).alias("start_time"), seconds_to_hms(F.max("hi")).alias("end_time"))
    hw = headways(st, ["stop_id"], "dep", headway_start, headway_end)
    out = stops.join(span, "stop_id", "left").join(hw, "stop_id", "left")
    return out.withColumn("num_trips", F.coalesce("num_trips", F.lit(0)))


def representative_trips(stop_times: DataFrame) -> DataFrame:
    """Longest trip of each route (most stop times, ties to the greatest trip id), without sorting a route's trips."""
    n = stop_times.groupBy("route_id", "trip_id").agg(F.count("*").alias("n"))
    return n.groupBy("route_id").agg(F.max(F.struct("n", "trip_id")).alias("b")).select(
        "route_id", F.col("b.trip_id").alias("trip_id"), F.col("b.n").alias("n_stops"))


def route_service(feed: dict[str, DataFrame], date=None, headway_start: str = "07:00:00",
                  headway_end: str = "19:00:00") -> DataFrame:
    """Per route: distinct trips and stops, headways between trip starts, and the line of its longest trip."""
    trips = active_trips(feed, service_date(feed, date)).select("trip_id", "route_id")
    st = _timed(feed, trips)
    per_trip = st.groupBy("route_id", "trip_id").agg(F.count("*").alias("n"), F.min("dep").alias("dep"))
    num_trips = trips.distinct().groupBy("route_id").agg(F.count("trip_id").alias("num_trips"))
    num_stops = st.select("route_id", "stop_id").distinct().groupBy("route_id").agg(F.count("*").alias("num_stops"))
    hw = headways(per_trip, ["route_id"], "dep", headway_start, headway_end)
    rep = per_trip.groupBy("route_id").agg(F.max(F.struct("n", "trip_id")).alias("b")).select(
        "route_id", F.col("b.trip_id").alias("trip_id"))
    seq = st.drop("route_id").join(rep, "trip_id").join(
        feed["stops"].select("stop_id", "stop_lon", "stop_lat"), "stop_id").where(
        "stop_lon is not null and stop_lat is not null")
    lines = seq.groupBy("route_id").agg(line_from_points(F.collect_list(F.struct(
        F.struct("stop_sequence", "stop_id").alias("o"), F.col("stop_lon").alias("x"), F.col("stop_lat").alias("y"))),
        4326).alias("geom")).where("geom is not null")
    routes = feed["routes"].select(*[
        F.col(c) if c in feed["routes"].columns else F.lit(None).alias(c)
        for c in ("route_id", "route_short_name", "route_long_name", "route_type")])
    return routes.join(lines, "route_id").join(num_trips, "route_id", "left").join(
        num_stops, "route_id", "left").join(hw, "route_id", "left").select(
        *routes.columns, F.coalesce("num_trips", F.lit(0)).alias("num_trips"),
        F.coalesce("num_stops", F.lit(0)).alias("num_stops"), "mean_headway", "min_headway", "max_headway", "geom")
