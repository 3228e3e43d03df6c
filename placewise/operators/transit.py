"""Timetables: service days, per-stop statistics, stop categories."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.norm import half_even
from .spatial import radius_join, within_radius

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def seconds(t: Column) -> Column:
    """H:M:S to seconds; hours may exceed 24."""
    p = F.split(F.trim(t), ":")
    return (p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")).cast("int")


def is_peak(sec: Column) -> Column:
    return (sec >= 7 * 3600) & (sec < 9 * 3600)


def is_night(sec: Column) -> Column:
    h = sec % 86400
    return (h >= 23 * 3600) | (h < 5 * 3600)


def mode_of(t: Column) -> Column:
    """Basic and extended route types."""
    return (F.when((t == 0) | t.between(900, 999), "tram").when((t == 1) | t.between(400, 499), "metro")
            .when((t == 2) | t.between(100, 199), "rail").when(t.isin(3, 11) | t.between(700, 899), "bus")
            .when((t == 4) | t.between(1000, 1099) | (t == 1200), "ferry")
            .when(t.isin(5, 6, 7, 12) | t.between(1300, 1499), "cable").otherwise("other"))


def service_days(calendar: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """(feed, date): weekly service expanded over its range plus added dates.  Removed dates are not subtracted here."""
    runs = F.array(*[F.col(d) for d in DAYS])
    days = (calendar.withColumn("date", F.explode(F.sequence("start_date", "end_date")))
            .where(runs[F.weekday("date")] == 1).select("feed", "date"))
    return days.unionByName(calendar_dates.where("exception_type = 1").select("feed", "date")).distinct()


def common_days(days: DataFrame, n_feeds: int) -> DataFrame:
    """Dates on which every feed runs."""
    return days.distinct().groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") == n_feeds).select("date")


def pick_day(days: DataFrame, n_feeds: int, after: str, weekday: int = 1, horizon: int = 60) -> DataFrame:
    """First common date on the weekday within the horizon after a date, else the first common working day."""
    c = common_days(days, n_feeds)
    wd, start = F.weekday("date"), F.lit(after).cast("date")
    wanted = (wd == weekday) & (F.col("date") > start) & (F.col("date") <= F.date_add(start, horizon))
    return c.agg(F.coalesce(F.min(F.when(wanted, F.col("date"))), F.min(F.when(wd < 5, F.col("date")))).alias("day"))


def active_services(calendar: DataFrame, calendar_dates: DataFrame, day: DataFrame) -> DataFrame:
    """(feed, service_id) in force on the day: weekly calendar, plus added, minus removed."""
    runs = F.array(*[F.col(d) for d in DAYS])
    base = (calendar.crossJoin(F.broadcast(day)).where("day BETWEEN start_date AND end_date")   # one row
            .where(runs[F.weekday("day")] == 1).select("feed", "service_id"))
    ex = calendar_dates.join(F.broadcast(day), F.col("date") == F.col("day"))
    added = ex.where("exception_type = 1").select("feed", "service_id")
    removed = ex.where("exception_type = 2").select("feed", "service_id")
    return base.unionByName(added).distinct().join(removed, ["feed", "service_id"], "left_anti")


def departures(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, services: DataFrame) -> DataFrame:
    """Departures of the active trips with route, mode, time flags and low-floor flag."""
    t = trips.join(services, ["feed", "service_id"], "left_semi")
    st = stop_times.where("departure_time <> ''").join(t, ["feed", "trip_id"])
    st = st.join(routes.select("feed", "route_id", "route_type"), ["feed", "route_id"], "left")
    st = st.withColumn("sec", seconds(F.col("departure_time")))
    return st.select("feed", "stop_id", "trip_id", "route_id", mode_of(F.coalesce("route_type", F.lit(3))).alias("mode"),
                     "sec", is_peak(F.col("sec")).alias("peak"), is_night(F.col("sec")).alias("night"),
                     F.coalesce(F.col("wheelchair_accessible") == "1", F.lit(False)).alias("low_floor"))


def stop_stats(dep: DataFrame) -> DataFrame:
    """Per stop: departures, lines, peak and peak low-floor departures per hour, night departures, modes."""
    one = lambda c: F.sum(c.cast("long"))
    return dep.groupBy("feed", "stop_id").agg(
        F.count("*").alias("departures_day"), F.count_distinct("route_id").alias("lines"),
        F.array_sort(F.collect_set("mode")).alias("modes"),     # seven modes at most
        (one(F.col("peak")) / 2.0).alias("dep_peak_per_h"),
        (one(F.col("peak") & F.col("low_floor")) / 2.0).alias("dep_peak_wc_per_h"), one(F.col("night")).alias("dep_night"))


def stop_items(dep: DataFrame) -> DataFrame:
    """Distinct (stop, kind, item): routes, peak trips and night trips, ids tagged with their feed.

    Kept as rows instead of a list per stop, so that no stop's list has to fit a task."""
    tag = lambda c: F.concat("feed", F.lit(":"), F.col(c).cast("string"))
    kinds = F.array(F.struct(F.lit("route").alias("kind"), tag("route_id").alias("item")),
                    F.when(F.col("peak"), F.struct(F.lit("peak_trip").alias("kind"), tag("trip_id").alias("item"))),
                    F.when(F.col("night"), F.struct(F.lit("night_trip").alias("kind"), tag("trip_id").alias("item"))))
    return (dep.select("feed", "stop_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
            .select("feed", "stop_id", "k.kind", "k.item").distinct())


def stop_categories(stats: DataFrame, stops: DataFrame, feed_source: Mapping[str, str]) -> DataFrame:
    """Stops with service as points of interest: one row per category the stop's modes give it."""
    src = F.create_map(*[F.lit(x) for kv in feed_source.items() for x in kv])
    cats = F.array(F.lit("transit_stop"), *[F.when(F.array_contains("modes", m), c) for m, c in
                                            (("tram", "tram_stop"), ("bus", "bus_stop"), ("metro", "metro_station"),
                                             ("rail", "rail_station"))])
    s = stats.where("departures_day > 0").join(stops, ["feed", "stop_id"])
    return s.select(F.explode(F.filter(cats, lambda c: c.isNotNull())).alias("category"), F.col("stop_name").alias("name"),
                    "lat", "lon", src[F.col("feed")].alias("source"),
                    F.to_json(F.struct("stop_id", "dep_peak_per_h")).alias("extra_json"))


def parent_names(stops: DataFrame) -> DataFrame:
    """An empty stop name is filled from the parent station, then from the id."""
    p = stops.select("feed", F.col("stop_id").alias("parent_station"), F.col("stop_name").alias("__pn"))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return (stops.join(p, ["feed", "parent_station"], "left")
            .withColumn("stop_name", F.coalesce(blank("stop_name"), blank("__pn"), F.col("stop_id").cast("string"))).drop("__pn"))


def tidy_minutes(pairs: DataFrame, limit: float = 120.0) -> DataFrame:
    """Routed minutes: unknown and longer than the limit are unreachable (no row); half-even whole minutes."""
    return (pairs.where(F.col("minutes").isNotNull() & ~F.isnan(F.col("minutes").cast("double")) & (F.col("minutes") <= limit))
            .withColumn("minutes", half_even(F.col("minutes").cast("double")).cast("smallint")))


def distinct_within(cells: DataFrame, stops: DataFrame, items: DataFrame, radius: float, ids: Sequence[str],
                    keys: Sequence[str] = ("city",)) -> DataFrame:
    """Distinct peak trips per hour, lines and night trips over the stops within the radius of each cell: a vehicle
    that serves three platforms is one departure.  (cell, item) pairs are made distinct map-side before they count."""
    pairs = radius_join(cells.select(*dict.fromkeys([*ids, *keys, "x", "y"])), stops, radius, keys)
    it = items.select(F.col("feed").alias("t_feed"), F.col("stop_id").alias("t_stop_id"), "kind", "item")
    got = pairs.select(*ids, "t_feed", "t_stop_id").join(it, ["t_feed", "t_stop_id"]).select(*ids, "kind", "item").distinct()
    n = lambda k: F.count_if(F.col("kind") == k)
    per = got.groupBy(*ids).agg((n("peak_trip") / 2.0).alias("departures_per_h"), n("route").alias("lines"), n("night_trip").alias("night"))
    return cells.select(*ids).join(per, list(ids), "left").fillna(0, ["departures_per_h", "lines", "night"])


def shares_within(cells: DataFrame, stops: DataFrame, radius: float, ids: Sequence[str], keys: Sequence[str] = ("city",)) -> DataFrame:
    """Share of accessible stops and of low-floor departures within the radius; NULL without stops or departures."""
    acc = F.avg(F.when(F.col("t_wb") == "1", 1.0).when(F.col("t_wb").isNotNull(), 0.0)) * 100.0
    low = F.try_divide(F.sum("t_depwc"), F.nullif(F.sum("t_dep"), F.lit(0.0))) * 100.0
    return within_radius(cells, stops, radius, ids, [acc.alias("accessible_share"), low.alias("lowfloor_share")], keys)
