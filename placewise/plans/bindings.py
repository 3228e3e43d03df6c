"""The given tables seen as the library's inputs.

``part`` stands for grid cells, ``lineitem`` for observations and travel times, ``supplier`` for destinations and
stations, ``customer`` for points of interest, ``events`` for timetable rows, incidents and readings, ``embeddings``
for pooled vectors.  Positions are arithmetic on the keys, so density stays the same at any scale factor.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import BY_KEY, CITIES, INDICATORS, PERSONAS, Indicator
from ..operators.scoring import REQUEST
from ..session import configure

DX, DY = 300.0, 259.8076211353316      # spacing of hexagon centres (x, y), 300 m apart
LAT0, M_LAT, M_LON = 50.0, 111200.0, 71478.0
LON0 = {"praha": 14.2, "krakow": 19.8}

# indicator column -> expression over the per-part aggregates below (valid in Spark SQL and ANSI SQL alike)
BOUND = {
    "transit.stop_walk_min": "CASE WHEN cnt >= 20 THEN sq / cnt / 4.0D END",
    "transit.departures_per_h_500m": "cnt * 1.0D",
    "transit.night_departures_500m": "CASE WHEN cnt >= 18 THEN nr * 1.0D END",
    "active.cycleway_km_1km": "sq / 100.0D",
    "green.green_share_500m": "CASE WHEN cnt >= 22 THEN sd * 10.0D / cnt END",
    "green.park_walk_min": "mnq + 2.0D",
    "education.primary_school_walk_min": "CASE WHEN cnt >= 24 THEN sq / cnt - 12.0D END",
    "education.library_walk_min": "CASE WHEN nr >= 8 THEN (sq % 19) * 1.0D END",
    "family.playgrounds_500m": "ns * 1.0D",
    "safety.crime_per_1000": "nf * 1.0D",
    "price.buy_per_m2": "CASE WHEN cnt >= 21 THEN sp / 100.0D / sq END",
    "price.rent_per_m2": "CASE WHEN cnt >= 21 THEN sp / 1000.0D / sq END",
    "shops.supermarket_walk_min": "(cnt % 13) + 1.0D",
    "health.gp_walk_min": "(ns % 23) + 1.0D",
    "health.pharmacy_walk_min": "CASE WHEN nf >= 7 THEN (sq % 17) + 1.0D END",
    "environment.noise_db": "CASE WHEN cnt % 19 = 0 THEN 150.0D ELSE 30.0D + st * 5.0D / cnt END",
    "environment.pm25": "sd * 3.0D / cnt",
    "leisure.food_10min": "na * 1.0D",
    "leisure.nightlife_10min": "CASE WHEN cnt < 0 THEN 1.0D END",
    "accessibility.slope_pct": "st * 2.0D / cnt",
}
POI_CATEGORIES = ("bus_stop", "tram_stop", "metro_station", "rail_station", "supermarket", "pharmacy", "park",
                  "playground", "nursery", "gp_clinic", "shop", "hospital")
SPECS: tuple[Indicator, ...] = tuple(i for i in INDICATORS if i.column in BOUND)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: str) -> str:
    """SQL: the value at ``index`` modulo their number (same text runs in both engines)."""
    arms = " ".join(f"WHEN {i} THEN {_v(x)}" for i, x in enumerate(values))
    return f"CASE {index} % {len(values)} {arms} END"


def _position(df: DataFrame, q: str, r: str, x: str = "0.0D", y: str = "0.0D") -> DataFrame:
    df = df.withColumn("q", F.expr(q)).withColumn("r", F.expr(r))
    df = df.withColumn("x", F.expr(f"{DX}D * (q + r / 2.0D) + {x}")).withColumn("y", F.expr(f"{DY}D * r + {y}"))
    lon0 = F.when(F.col("city") == "praha", LON0["praha"]).otherwise(LON0["krakow"])
    return df.withColumn("lat", F.lit(LAT0) + F.col("y") / M_LAT).withColumn("lon", lon0 + F.col("x") / M_LON)


def _city(key: str):
    return F.expr(f"CASE WHEN {key} % 2 = 0 THEN 'praha' ELSE 'krakow' END")


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("city", _city("p_partkey"))
    p = _position(p, "(p_partkey div 2) % 64", "(p_partkey div 2) div 64")
    return p.select(
        "city", F.col("p_partkey").alias("cell_id"), "q", "r", "x", "y", "lat", "lon",
        (F.col("p_size") >= 3).alias("habitable"), F.col("p_brand").alias("district_id"),
        F.concat(F.lit("District "), "p_brand").alias("district_name"),
        F.when(F.col("p_size") % 11 == 0, "").otherwise(F.concat_ws("/", "p_brand", "p_type")).alias("neighborhood"),
        F.col("p_size").cast("int").alias("population_est"))


def part_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("cell_id")).agg(
        *[F.expr(e) for e in (
            "count(*) AS cnt", "sum(cast(l_quantity AS long)) AS sq", "min(l_quantity) AS mnq",
            "sum(cast(round(l_discount * 100) AS long)) AS sd", "sum(cast(round(l_tax * 100) AS long)) AS st",
            "sum(cast(round(l_extendedprice * 100) AS long)) AS sp", "count(DISTINCT l_suppkey) AS ns",
            "count_if(l_returnflag = 'R') AS nr", "count_if(l_returnflag = 'A') AS na",
            "count_if(l_linestatus = 'F') AS nf")])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell table: identity columns and one column per bound indicator."""
    a = part_aggregates(spark, sf_dir)
    feats = a.select("cell_id", *[F.expr(e).alias(c) for c, e in BOUND.items()])
    return grid_cells(spark, sf_dir).join(feats, "cell_id", "left")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of interest from customers."""
    c = table(spark, sf_dir, "customer").withColumn("city", _city("c_custkey"))
    c = _position(c, "(c_custkey div 2) % 64", "((c_custkey div 2) div 64) * 4 div 3", "(c_custkey * 37) % 300 - 150.0D",
                  "(c_custkey * 53) % 260 * 1.0D")
    return c.select("city", F.col("c_custkey").alias("poi_id"), F.expr(pick(POI_CATEGORIES, "c_nationkey")).alias("category"),
                    F.col("c_name").alias("name"), "x", "y", "lat", "lon", F.col("c_acctbal").alias("value"),
                    F.col("c_nationkey").alias("nation"))


def dests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations: every supplier, placed in both cities."""
    s = table(spark, sf_dir, "supplier").withColumn("city", F.explode(F.array(*[F.lit(c) for c in CITIES])))
    s = _position(s, "(s_suppkey * 13) % 64", "s_suppkey div 6")
    return s.select("city", F.col("s_suppkey").alias("dest"), F.col("s_name").alias("name"), "x", "y", "lat", "lon",
                    F.col("s_acctbal").alias("value"), F.col("s_nationkey").alias("nation"))


def travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    mode = F.expr("CASE l_returnflag WHEN 'A' THEN 'transit' WHEN 'N' THEN 'bike' ELSE 'walk' END")
    return (li.groupBy(_city("l_partkey").alias("city"), mode.alias("mode"), F.col("l_partkey").alias("origin"),
                       F.col("l_suppkey").alias("dest"))
            .agg(F.min(F.col("l_quantity").cast("int")).alias("minutes")))


def _anchor(aid, dest, mode, level, lim=None, label=None):
    return {"id": aid, "dest": dest, "mode": mode, "level": level, "maxMinutes": lim, "label": label}


# A small table of user requests; each is evaluated against every cell of its city.
REQUESTS = [
    dict(request_id=1, city="praha", persona="student"),
    dict(request_id=2, city="krakow", persona="working", maxPrice=1900.0),
    dict(request_id=3, city="praha", persona="parent", maxPrice=200.0, maxNoise=52.0,
         must=[("supermarket", 10.0), ("park", 6.0)]),
    dict(request_id=4, city="krakow", persona="senior", must=[("pharmacy", 12.0), ("metro_station", 5.0)], limit=5),
    dict(request_id=5, city="praha", persona="expecting", weights={"green": 5, "price": 0, "commute": 5},
         anchors=[_anchor("work", 7, "transit", 5), _anchor("school", 21, "bike", 2, 45, "School")]),
    dict(request_id=6, city="krakow", persona="custom", rankBy="environment", budget=400000.0),
    dict(request_id=7, city="krakow", persona=None, weights={}),
    dict(request_id=8, city="praha", persona=None, weights={"leisure": 3, "accessibility": 2, "commute": 4}, limit=10),
    dict(request_id=9, city="krakow", persona="expat", maxPrice=1.0, must=[("supermarket", 12.0)]),
    dict(request_id=10, city="praha", persona="custom", rankBy="anchor:gym", maxCommute=40,
         anchors=[_anchor("gym", 33, "walk", 3, None, "Gym")]),
    dict(request_id=11, city="krakow", persona="custom", indicatorWeights={"health.gp_walk_min": 0.0,
                                                                             "shops.pharmacy_walk_min": 4.0,
                                                                             "green.park_walk_min": -1.0},
         weights={c: 5 for c in ("health", "shops", "green")}, district="Brand#7"),
    dict(request_id=12, city="praha", persona="working", aggregate="district", budget=25000.0),
]

# Persona defaults without anchors: the static export, default criteria and twins read these.
REQUESTS += [dict(request_id=101 + 10 * i + k, city=c, persona=p.id, weights=dict(p.levels))
             for i, p in enumerate(PERSONAS) for k, c in enumerate(CITIES)]
CUSTOM_ID = {c: 101 + 10 * (len(PERSONAS) - 1) + k for k, c in enumerate(CITIES)}


def requests(spark: SparkSession, sf_dir: str, rows: list[dict] | None = None) -> DataFrame:
    """The request table; an anchor's position is the position of a destination, read from the data."""
    rows = REQUESTS if rows is None else rows
    flat = []
    for r in rows:
        price = r.get("maxPrice")
        flat.append({
            "request_id": r["request_id"], "city": r["city"], "v": 1, "lang": None, "persona": r.get("persona"),
            "weights": r.get("weights", {}), "indicatorWeights": r.get("indicatorWeights", {}),
            "filters": {"maxPricePerM2": price if r["city"] == "krakow" else None,
                        "maxRentPerM2": price if r["city"] == "praha" else None,
                        "maxCommuteMinutes": r.get("maxCommute"), "maxNoiseDb": r.get("maxNoise"),
                        "mustHave": [{"category": c, "maxWalkMin": m} for c, m in r.get("must", [])]},
            "budget": {"total": r.get("budget") if r["city"] == "krakow" else None,
                       "monthlyRent": r.get("budget") if r["city"] == "praha" else None},
            "aggregate": r.get("aggregate", "hex"), "limit": r.get("limit", 20), "includeCells": True,
            "rankBy": r.get("rankBy"), "district": r.get("district"), "__anchors": r.get("anchors", [])})
    fields = {f.name: f.dataType.simpleString() for f in REQUEST.fields if f.name != "anchors"}
    schema = "request_id long, city string, " + ", ".join(f"`{n}` {t}" for n, t in fields.items())
    schema += ", __anchors array<struct<id:string,dest:long,mode:string,level:int,maxMinutes:int,label:string>>"
    base = spark.createDataFrame(flat, schema)
    a = base.select("request_id", "city", F.posexplode("__anchors").alias("pos", "a"))
    at = dests(spark, sf_dir).select("city", "dest", "lat", "lon")
    a = (a.select("request_id", "city", "pos", "a.*").join(at, ["city", "dest"])
         .groupBy("request_id").agg(F.array_sort(F.collect_list(
             F.struct("pos", "id", "label", "lat", "lon", "mode", "level", "maxMinutes"))).alias("l")))
    anchors = F.transform("l", lambda s: F.struct(*[s[n].alias(n) for n in
                                                    ("id", "label", "lat", "lon", "mode", "level", "maxMinutes")]))
    a = a.select("request_id", anchors.alias("anchors"))
    empty = F.expr("array()").cast(REQUEST["anchors"].dataType)
    return (base.drop("__anchors").join(a, "request_id", "left")
            .withColumn("anchors", F.coalesce("anchors", empty)))


def _v(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)


def values_cte(name: str, cols: str, rows: list[tuple]) -> str:
    return f"{name}({cols}) AS (VALUES " + ", ".join("(" + ", ".join(_v(c) for c in r) + ")" for r in rows) + ")"


__all__ = ["BOUND", "BY_KEY", "REQUESTS", "SPECS", "cells", "dests", "grid_cells", "part_aggregates", "points",
           "pick", "requests", "table", "travel", "values_cte"]
