"""Registered queries: sources and sinks, quality checks, search, catalogue, address matching, exports."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BY_KEY, CITIES, CRITERIA, EXPECTED_RANGE, MUST_HAVE, PERSONAS, POI_VOCAB, PRICE, expected_columns
from ..functions import geo, text as T
from ..functions.norm import half_even as he
from ..operators import adapters as AD, catalog as CA, cells as C, explain as X, quality as QA, ranking as R, registers as RG, scoring as S, search as SE, transit as TR
from ..session import scratch_path, stored
from ..sources import readers as RD, writers as WR
from . import bindings as B
from .function_queries import ADDR, FOLD, NUM_SQL, SIZE, STREET_SQL, STREETS
from .oracle import CITY, CTES, cte, half_even, q
from .registry import query
from .relational_queries import TT_SQL, timetable, filled_long, rnd
from .scoring_queries import prepared, scores
from .spatial_queries import cells as grid, polygons


def io(spark, d, name):
    return scratch_path(spark, d, f"io_{name}")


# ------------------------------------------------------------------ sources and sinks
@query("S10_write_cells", q("SELECT city, CAST(cell_id AS VARCHAR) AS cell_id, habitable, round(f.\"transit.departures_per_h_500m\", 6) AS departures FROM cells JOIN feats f USING (cell_id)"))
def write_cells(spark, d):
    c = B.cells(spark, d).withColumn("cell_id", F.col("cell_id").cast("string"))
    path = io(spark, d, "cells")
    WR.write_cells(c, path, list(B.BOUND))
    return RD.read_cells(spark, path, ["transit.departures_per_h_500m"]).select(
        "city", "cell_id", "habitable", F.round("`transit.departures_per_h_500m`", 6).alias("departures"))


@query("S01_read_cells", q("""SELECT city, habitable, count(*) AS n, round(sum(f."green.park_walk_min"), 4) AS park FROM cells JOIN feats f USING (cell_id) GROUP BY 1, 2"""))
def read_cells(spark, d):
    c = B.cells(spark, d).withColumn("cell_id", F.col("cell_id").cast("string"))
    path = io(spark, d, "cells_read")
    WR.write_cells(c, path, list(B.BOUND))
    df = RD.read_cells(spark, path, ["green.park_walk_min"])
    return df.groupBy("city", "habitable").agg(F.count("*").alias("n"), F.round(F.sum("`green.park_walk_min`"), 4).alias("park"))


@query("S02_read_pois", q("SELECT category, count(*) AS n, min(name) AS first FROM pois WHERE category IN ('park', 'pharmacy') GROUP BY 1"))
def read_pois(spark, d):
    path = io(spark, d, "pois")
    p = B.points(spark, d).select("category", "name", "lat", "lon", F.col("poi_id").cast("string").alias("h3_9"),
                                  F.lit("base").alias("source"), F.lit("{}").alias("extra_json"))
    p.write.mode("overwrite").partitionBy("category").parquet(path)
    return RD.read_pois(spark, path, ["park", "pharmacy"]).groupBy("category").agg(F.count("*").alias("n"), F.min("name").alias("first"))


TIMETABLE = {"stops": ["stop_id", "stop_name", "wheelchair_boarding"], "routes": ["route_id", "route_type"], "trips": ["route_id", "service_id", "trip_id", "wheelchair_accessible"],
             "stop_times": ["trip_id", "stop_id", "departure_time"], "calendar": ["service_id", *TR.DAYS, "start_date", "end_date"], "calendar_dates": ["service_id", "date", "exception_type"]}
ON = "1996-03-05"


@query("S03_read_gtfs_csv", q("""SELECT s.feed, CAST(s.stop_id AS VARCHAR) AS stop_id, 'stop ' || CAST(s.stop_id AS VARCHAR) AS stop_name, count(*) AS departures, count(DISTINCT t.route_id) AS lines,
 count(*) FILTER (WHERE t.wc) AS accessible FROM st s JOIN trip t ON t.feed = s.feed AND t.trip_id = s.trip_id WHERE t.service_id <> 4 GROUP BY 1, 2, 3""", **TT_SQL))
def read_gtfs_csv(spark, d):
    """All six tables of two feeds from CSV, joined to the departures of one day. Service 5 runs on no weekday but is added on the
    day, service 4 is removed; a seventh table is absent and empty."""
    st, trips, routes, _ = timetable(spark, d)
    services = trips.select("feed", "service_id").distinct()
    week = services.select("*", *[F.when(F.col("service_id") == 5, "0").otherwise("1").alias(day) for day in TR.DAYS], F.lit("19960101").alias("start_date"), F.lit("19961231").alias("end_date"))
    dates = services.where("service_id IN (4, 5)").select("*", F.lit(ON.replace("-", "")).alias("date"), F.when(F.col("service_id") == 4, "2").otherwise("1").alias("exception_type"))
    stops = st.select("feed", F.col("stop_id").alias(" stop_id"), F.concat(F.lit("stop "), "stop_id").alias("stop_name")).distinct()      # a blank in the header
    folders = {f: io(spark, d, f"gtfs-{f}") for f in ("feed0", "feed1")}
    for name, df in (("stops", stops), ("routes", routes), ("trips", trips), ("stop_times", st), ("calendar", week), ("calendar_dates", dates)):
        for feed, folder in folders.items():
            df.where(F.col("feed") == feed).drop("feed").write.mode("overwrite").csv(f"{folder}/{name}.txt", header=True)
    read = {name: RD.read_gtfs(spark, folders, name, columns) for name, columns in TIMETABLE.items()}
    day = spark.range(1).select(F.lit(ON).cast("date").alias("day"))
    date = lambda c: F.to_date(c, "yyyyMMdd").alias(c)
    active = TR.active_services(read["calendar"].select("feed", "service_id", *[F.col(x).cast("int").alias(x) for x in TR.DAYS], date("start_date"), date("end_date")),
                                read["calendar_dates"].select("feed", "service_id", date("date"), F.col("exception_type").cast("int").alias("exception_type")), day)
    dep = TR.departures(read["stop_times"], read["trips"], read["routes"].withColumn("route_type", F.col("route_type").cast("int")), active)
    gone = RD.read_gtfs(spark, folders, "frequencies", ["trip_id"])
    dep = dep.join(gone, "trip_id", "left_anti").join(read["stops"], ["feed", "stop_id"])
    return dep.groupBy("feed", "stop_id", "stop_name").agg(F.count("*").alias("departures"), F.count_distinct("route_id").alias("lines"), F.count_if("low_floor").alias("accessible"))


@query("S04_read_delimited_legacy", f"SELECT street, count(*) AS n FROM (SELECT {', '.join(ADDR)} FROM customer) GROUP BY 1")
def read_delimited_legacy(spark, d):
    path = io(spark, d, "cp1250")
    B.table(spark, d, "customer").selectExpr(*ADDR).write.mode("overwrite").csv(path, header=True, sep=";", encoding="windows-1250")
    df = RD.read_delimited(spark, path, "street string, number string", encoding="windows-1250")
    return df.groupBy("street").agg(F.count("*").alias("n"))


@query("S05_read_geojson_features", q("SELECT city, dest, 'Polygon' AS geometry_type, 5 AS points, round(x1, 6) AS x0 FROM poly_e WHERE i = 0"))
def read_geojson_features(spark, d):
    path = io(spark, d, "geojson")
    p = polygons(spark, d).selectExpr("dest AS id", "struct(city) AS properties",
                                      "struct('Polygon' AS type, array(transform(ring, p -> array(p.x, p.y))) AS coordinates) AS geometry")
    p.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    df = RD.read_geojson_lines(spark, path, "city: string")
    ring = F.col("coordinates")[0]
    return df.select("city", F.col("id").alias("dest"), "geometry_type", F.size(ring).alias("points"), F.round(ring[0][0], 6).alias("x0"))


FACILITY = {"fac": """SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'A00' WHEN 1 THEN 'B00' WHEN 2 THEN 'C00' ELSE 'Z99' END AS druh, l_partkey, l_suppkey FROM lineitem"""}


@query("S06_read_nested_json_register", q("""SELECT CASE druh WHEN 'A00' THEN 'kindergarten' WHEN 'B00' THEN 'primary_school' ELSE 'secondary_school' END AS category,
 'Entity ' || CAST(l_orderkey AS VARCHAR) AS name, CAST(CASE WHEN l_suppkey % 3 = 0 THEN l_orderkey ELSE l_suppkey + k END AS VARCHAR) AS adm, CAST(l_partkey AS VARCHAR) AS izo, CAST(l_orderkey AS VARCHAR) AS redizo
 FROM fac JOIN (VALUES (0), (1)) AS t(k) ON k = 0 OR l_suppkey % 3 = 1 WHERE druh <> 'Z99'""", **FACILITY))
def read_nested_json_register(spark, d):
    path = io(spark, d, "register")
    adr = "named_struct('adresa', named_struct('kodRUIAN', cast({} AS string)))"
    places = f"CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN array({adr.format('l_suppkey')}, {adr.format('l_suppkey + 1')}) ELSE array({adr.format('l_suppkey')}) END"
    fac = B.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", f"struct({B.pick(('A00', 'B00', 'C00', 'Z99'), 'l_linenumber')} AS druh, cast(l_partkey AS string) AS izo, {places} AS mistaVyuky) AS f")
    ent = fac.groupBy("l_orderkey").agg(F.collect_list("f").alias("fs"))     # an order's few lines
    doc = ent.selectExpr("to_json(struct(array(struct(concat('Entity ', l_orderkey) AS zkracenyNazev, cast(l_orderkey AS string) AS redIzo, "
                         "struct(cast(l_orderkey AS string) AS kodRUIAN) AS adresa, fs AS skolyAZarizeni)) AS list)) AS value")
    doc.write.mode("overwrite").text(path)
    return RD.explode_register(spark.read.schema(RD.SCHOOLS).json(path))


@query("S07_read_xml_features", "SELECT CAST(l_orderkey AS VARCHAR) AS TRAN_ID, l_linenumber AS LOK_NR, l_quantity AS y, l_extendedprice AS x, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4")
def read_xml_features(spark, d):
    path = io(spark, d, "xml")
    B.table(spark, d, "lineitem").select(F.format_string(
        "<member><lokale><TRAN_ID>%s</TRAN_ID><LOK_NR>%s</LOK_NR><msGeometry><Point><pos>%s %s</pos></Point></msGeometry></lokale></member>",
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"))).write.mode("overwrite").text(path)
    df = RD.read_xml_features(spark, path, "TRAN_ID: string, LOK_NR: int", lines=True)
    return df.groupBy("TRAN_ID", "LOK_NR", "y", "x").agg(F.count("*").alias("n"))


@query("S08_read_monthly_partitions", """SELECT month, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y%m') AS month FROM orders) WHERE month IN
 (SELECT DISTINCT strftime(o_orderdate, '%Y%m') FROM orders ORDER BY 1 DESC LIMIT 12) GROUP BY 1""")
def read_monthly_partitions(spark, d):
    path = io(spark, d, "months")
    o = B.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyyMM'.csv'").alias("m"))
    o.repartition("m").write.mode("overwrite").partitionBy("m").csv(path, header=True)
    return RD.read_monthly(spark, path, "o_orderkey long, o_custkey long", 12).groupBy("month").agg(F.count("*").alias("n"))


@query("S09_read_travel_times", q("SELECT city, mode, count(*) AS pairs, sum(minutes) AS minutes FROM travel GROUP BY 1, 2"))
def read_travel_times(spark, d):
    path = io(spark, d, "travel")
    t = B.travel(spark, d).withColumn("origin", F.col("origin").cast("string")).withColumn("dest", F.col("dest").cast("string"))
    WR.write_travel_times(t, path)
    return (RD.read_travel_times(spark, path).groupBy("city", "mode")
            .agg(F.count("*").alias("pairs"), F.sum("minutes").alias("minutes")))


PERSONA_SQL = f"(SELECT request_id, persona FROM req WHERE request_id > 100)"


@query("S11_export_static_scores", q(f"""SELECT c.city, r.persona, c.cell_id, c.criterion, CAST({half_even('c.sc')} AS INTEGER) AS score FROM crit c JOIN {PERSONA_SQL} r USING (request_id)
 UNION ALL SELECT req.city, r.persona, NULL, criterion, CAST({half_even('med')} AS INTEGER) FROM crit_median JOIN {PERSONA_SQL} r USING (request_id) JOIN req USING (request_id)"""))
def export_static_scores(spark, d):
    """The offline export, written and read back: whole scores per cell, and the city's medians (no cell)."""
    sc = scores(spark, d).where("request_id > 100")
    path, at = io(spark, d, "static"), io(spark, d, "static-medians")
    WR.static_scores(sc).write.mode("overwrite").partitionBy("city", "persona").json(path)
    WR.static_medians(sc).write.mode("overwrite").partitionBy("city", "persona").json(at)
    schema = "cell_id long, habitable boolean, " + ", ".join(f"{c} int" for c in CRITERIA) + ", city string, persona string"
    df = spark.read.schema(schema).json(path)
    df = df.unpivot(["city", "persona", "cell_id"], list(CRITERIA), "criterion", "score").where("score IS NOT NULL")
    med = spark.read.schema("criterion string, median int, city string, persona string").json(at)
    return df.unionByName(med.select("city", "persona", F.lit(None).cast("long").alias("cell_id"), "criterion", F.col("median").alias("score")))


@query("S12_export_grid_geojson", q("""SELECT city, row_number() OVER (PARTITION BY city ORDER BY cell_id) - 1 AS id, CAST(cell_id AS VARCHAR) AS h3, district_id, habitable, population_est, 6 AS corners FROM cells"""))
def export_grid_geojson(spark, d):
    path = io(spark, d, "grid")
    c = B.grid_cells(spark, d)
    ring = F.array(*[F.array(F.round(x, 6), F.round(y, 6)) for x, y in geo.hex_corners(F.col("x"), F.col("y"), SIZE)])
    WR.write_features(WR.grid_features(c, ring), path)
    schema = ("id long, geometry struct<coordinates: array<array<array<double>>>>, properties struct<h3: string, district_id: string, habitable: boolean, "
              "population_est: int>, city string")
    df = spark.read.schema(schema).json(path)
    return df.select("city", "id", "properties.h3", "properties.district_id", "properties.habitable", "properties.population_est",
                     F.size(F.col("geometry.coordinates")[0]).alias("corners"))


MAN = {"man_old": """SELECT n_name AS key, 'http://old/' || n_name AS url, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE '2024-01-0' || CAST(n_nationkey % 9 + 1 AS VARCHAR) END AS "fetchedAt",
 'free' AS licence, CAST(n_nationkey AS BIGINT) AS rows, CASE WHEN n_nationkey % 4 = 0 THEN 'missing' ELSE 'ok' END AS status, CASE WHEN n_nationkey % 5 = 0 THEN 'fetch failed: x' ELSE '' END AS note FROM nation""",
       "man_new": """SELECT 'NATION_' || CAST(c_nationkey * 2 AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS url, '2024-02-01' AS "fetchedAt", CAST(NULL AS VARCHAR) AS licence,
 CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE count(*) END AS rows, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'ok' END AS status, CAST(NULL AS VARCHAR) AS note FROM customer GROUP BY c_nationkey""",
       "man": """SELECT coalesce(n.key, o.key) AS key, coalesce(n.url, o.url) AS url, coalesce(n."fetchedAt", o."fetchedAt") AS "fetchedAt", coalesce(n.licence, o.licence) AS licence,
 CASE WHEN n.key IS NOT NULL THEN n.rows ELSE o.rows END AS rows, coalesce(n.status, o.status, 'missing') AS status, coalesce(n.note, o.note, '') AS note FROM man_old o FULL JOIN man_new n ON n.key = o.key"""}


def manifests(spark, d):
    old = B.table(spark, d, "nation").selectExpr(
        "n_name AS key", "concat('http://old/', n_name) AS url", "CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('2024-01-0', n_nationkey % 9 + 1) END AS fetchedAt",
        "'free' AS licence", "cast(n_nationkey AS long) AS rows", "CASE WHEN n_nationkey % 4 = 0 THEN 'missing' ELSE 'ok' END AS status",
        "CASE WHEN n_nationkey % 5 = 0 THEN 'fetch failed: x' ELSE '' END AS note")
    new = B.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).selectExpr(
        "concat('NATION_', c_nationkey * 2) AS key", "cast(NULL AS string) AS url", "'2024-02-01' AS fetchedAt", "cast(NULL AS string) AS licence",
        "CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE n END AS rows", "CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'ok' END AS status", "cast(NULL AS string) AS note")
    return old, new


@query("S13_source_manifest_upsert", q("SELECT * FROM man", **MAN))
def source_manifest_upsert(spark, d):
    return WR.upsert_manifest(*manifests(spark, d))


@query("S14_manifest_hygiene", q("""SELECT key, rows, status, n || CASE WHEN status = 'missing' AND use <> '' THEN ' [' || use || ']' ELSE '' END AS note FROM (SELECT m.*, k.use,
 CASE WHEN status = 'ok' AND rows IS NULL AND n0 = '' THEN 'reachable (verified ' || substr(coalesce("fetchedAt", 'None'), 1, 10) || '); not used for features — ' || coalesce(nullif(k.use, ''), 'reference') ELSE n0 END AS n
 FROM (SELECT *, CASE WHEN status = 'ok' AND starts_with(note, 'fetch failed') THEN '' ELSE note END AS n0 FROM man) m JOIN (SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'noise' END AS use FROM nation) k USING (key))""", **MAN))
def manifest_hygiene(spark, d):
    known = B.table(spark, d, "nation").selectExpr("n_name AS key", "CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'noise' END AS use")
    return WR.manifest_hygiene(WR.upsert_manifest(*manifests(spark, d)), known).select("key", "rows", "status", "note")


@query("S15_features_to_points", q("""SELECT m.city, m.dest, round(m.mx, 4) AS x, round(m.my, 4) AS y, 'park' AS category, 'register' AS source FROM (SELECT city, dest, avg(x1) AS mx, avg(y1) AS my FROM poly_e GROUP BY 1, 2) m"""))
def features_to_points(spark, d):
    return RD.features_to_points(polygons(spark, d), ["city", "dest"], "park", "register").select("city", "dest", *rnd("x", "y", digits=4), "category", "source")


# ------------------------------------------------------------------ address matching
@query("J04_lookup_by_code_fallback_name", """SELECT c.c_custkey, coalesce(a.v, b.v) AS rent, CASE WHEN a.v IS NOT NULL THEN 'code' WHEN b.v IS NOT NULL THEN 'name' ELSE 'none' END AS how FROM
 (SELECT c_custkey, CAST(c_custkey % 150 AS VARCHAR) AS code, lower(c_mktsegment) || CAST(c_nationkey AS VARCHAR) AS name_key FROM customer) c LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS code, s_acctbal AS v FROM supplier) a ON a.code = c.code
 LEFT JOIN (SELECT 'building' || CAST(s_nationkey AS VARCHAR) AS name_key, arg_min(s_acctbal, CAST(s_suppkey AS VARCHAR)) AS v FROM supplier GROUP BY 1) b ON b.name_key = c.name_key""")
def lookup_by_code_fallback_name(spark, d):
    base = B.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 150).cast("string").alias("code"),
                                                T.alnum_key(F.concat("c_mktsegment", F.lit(" "), "c_nationkey")).alias("name_key"))
    tab = B.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("code"), T.alnum_key(F.concat(F.lit("Búilding-"), "s_nationkey")).alias("name_key"),
                                               F.col("s_acctbal").alias("rent"))
    return RG.lookup_code_or_name(base, tab, "rent").select("c_custkey", "rent", "how")


def addresses(spark, d):
    a = B.table(spark, d, "customer").selectExpr("c_custkey AS addr_id", *ADDR)
    return a.join(B.points(spark, d).select(F.col("poi_id").alias("addr_id"), "lat", "lon"), "addr_id")


TARGET = ["o_orderkey", B.pick(STREETS + ("Nikde", "Maczka"), "o_custkey") + " AS street", "cast(o_orderkey % 90 + 1 AS string) AS number"]
GEO_SQL = {"adr": f"SELECT addr_id, lat, lon, {STREET_SQL.format('street')} AS k, {NUM_SQL.format('number')} AS n FROM (SELECT c_custkey AS addr_id, {', '.join(ADDR)} FROM customer) JOIN (SELECT poi_id AS addr_id, lat, lon FROM pois) USING (addr_id)",
           "tgt": f"SELECT o_orderkey, {STREET_SQL.format('street')} AS k, {NUM_SQL.format('number')} AS n FROM (SELECT {', '.join(TARGET).replace('string', 'varchar')} FROM orders)",
           "hit": """SELECT t.o_orderkey, coalesce(f.lat, l.lat, s.lat) AS lat, coalesce(f.lon, l.lon, s.lon) AS lon, CASE WHEN coalesce(f.lat, l.lat) IS NOT NULL THEN 'exact' WHEN s.lat IS NOT NULL THEN 'street' ELSE 'none' END AS how FROM tgt t
 LEFT JOIN (SELECT k, n, arg_min(lat, addr_id) AS lat, arg_min(lon, addr_id) AS lon FROM adr GROUP BY 1, 2) f ON f.k = t.k AND f.n = t.n
 LEFT JOIN (SELECT regexp_extract(k, '[^ ]*$') AS k2, n, arg_min(lat, addr_id) AS lat, arg_min(lon, addr_id) AS lon FROM adr GROUP BY 1, 2) l ON l.k2 = regexp_extract(t.k, '[^ ]*$') AND l.n = t.n
 LEFT JOIN (SELECT k, median(lat) AS lat, median(lon) AS lon FROM adr GROUP BY 1) s ON s.k = t.k"""}


@query("J05_address_geocode_cascade", q("SELECT o_orderkey, round(lat, 6) AS lat, round(lon, 6) AS lon, how FROM hit", **GEO_SQL))
def address_geocode_cascade(spark, d):
    rows = B.table(spark, d, "orders").selectExpr(*TARGET)
    return RG.geocode_cascade(rows, addresses(spark, d)).select("o_orderkey", *rnd("lat", "lon"), "how")


@query("J27_coords_or_geocode", q("""SELECT category, round(lat, 6) AS lat, round(lon, 6) AS lon, count(*) AS n FROM (SELECT DISTINCT category, lat, lon FROM (SELECT o.o_orderpriority AS category, CASE WHEN o.o_orderkey % 4 = 0 THEN 50.0 + o.o_custkey / 64.0 ELSE h.lat END AS lat,
 CASE WHEN o.o_orderkey % 4 = 0 THEN 14.0 ELSE h.lon END AS lon FROM orders o JOIN hit h USING (o_orderkey)) WHERE lat IS NOT NULL) GROUP BY 1, 2, 3""", **GEO_SQL))
def coords_or_geocode(spark, d):
    o = B.table(spark, d, "orders").selectExpr(*TARGET, "o_orderpriority AS category", "CASE WHEN o_orderkey % 4 = 0 THEN 50.0D + o_custkey / 64.0D END AS lat",
                                               "CASE WHEN o_orderkey % 4 = 0 THEN 14.0D END AS lon")
    out = RG.coords_or_geocode(o, addresses(spark, d), ["category"])
    return out.groupBy("category", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")).agg(F.count("*").alias("n"))


VAR = {"va": """SELECT c_custkey AS addr_id, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'dlouha' || CAST(c_nationkey % 5 AS VARCHAR) END AS st, 'part' || CAST(c_nationkey % 4 AS VARCHAR) AS part, CAST(c_custkey % 200 AS VARCHAR) AS cp,
 CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 70 AS VARCHAR) END AS co, p.lat FROM customer JOIN pois p ON p.poi_id = c_custkey""",
       "vt": """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'part' || CAST(o_custkey % 4 AS VARCHAR) ELSE 'dlouha' || CAST(o_custkey % 5 AS VARCHAR) END AS st, CAST(o_orderkey % 300 AS VARCHAR) AS cp,
 CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 90 AS VARCHAR) END AS co FROM orders"""}


@query("J06_address_geocode_variants", q("""SELECT t.o_orderkey, round(coalesce(a.lat, b.lat, c.lat), 6) AS lat, CASE WHEN a.lat IS NOT NULL THEN 'cp' WHEN b.lat IS NOT NULL THEN 'co' WHEN c.lat IS NOT NULL THEN 'part' ELSE 'none' END AS how FROM vt t
 LEFT JOIN (SELECT st, cp, arg_min(lat, addr_id) AS lat FROM va GROUP BY 1, 2) a ON a.st = t.st AND a.cp = t.cp LEFT JOIN (SELECT st, co, arg_min(lat, addr_id) AS lat FROM va WHERE co IS NOT NULL GROUP BY 1, 2) b ON b.st = t.st AND b.co = coalesce(t.co, t.cp)
 LEFT JOIN (SELECT part, cp, arg_min(lat, addr_id) AS lat FROM va GROUP BY 1, 2) c ON c.part = t.st AND c.cp = t.cp""", **VAR))
def address_geocode_variants(spark, d):
    a = B.table(spark, d, "customer").selectExpr("c_custkey AS addr_id", "CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE concat('dlouha', c_nationkey % 5) END AS st", "concat('part', c_nationkey % 4) AS part",
                                                 "cast(c_custkey % 200 AS string) AS cp", "CASE WHEN c_custkey % 2 = 0 THEN cast(c_custkey % 70 AS string) END AS co")
    a = a.join(B.points(spark, d).select(F.col("poi_id").alias("addr_id"), "lat", "lon"), "addr_id")
    rows = B.table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_custkey % 3 = 0 THEN concat('part', o_custkey % 4) ELSE concat('dlouha', o_custkey % 5) END AS st", "cast(o_orderkey % 300 AS string) AS cp",
                                                  "CASE WHEN o_orderkey % 4 = 0 THEN cast(o_orderkey % 90 AS string) END AS co")
    return RG.geocode_variants(rows, a).select("o_orderkey", *rnd("lat"), "how")


@query("J07_geocode_by_id", q("""SELECT o.o_orderpriority AS category, count(*) AS n, count(p.lat) AS matched, count(*) - count(p.lat) AS missing FROM orders o LEFT JOIN pois p ON p.poi_id = o.o_custkey * 2 GROUP BY 1"""))
def geocode_by_id(spark, d):
    rows = B.table(spark, d, "orders").select(F.col("o_orderpriority").alias("category"), (F.col("o_custkey") * 2).alias("adm"))
    lut = B.points(spark, d).select(F.col("poi_id").alias("adm"), "lat", "lon")
    return rows.join(lut, "adm", "left").groupBy("category").agg(F.count("*").alias("n"), F.count("lat").alias("matched"), F.count_if(F.col("lat").isNull()).alias("missing"))


# ------------------------------------------------------------------ search
LABELS = {"labels0": f"""SELECT 'district:' || city || ':' || district_id AS entry_id, district_name AS label, 'district' AS kind, avg(lat) AS lat, avg(lon) AS lon FROM cells GROUP BY city, district_id, district_name
 UNION ALL SELECT 'place:' || city || ':' || neighborhood, neighborhood, 'place', avg(lat), avg(lon) FROM cells WHERE neighborhood <> '' GROUP BY city, neighborhood
 UNION ALL SELECT 'poi:' || CAST(poi_id AS VARCHAR), name, 'poi', lat, lon FROM pois
 UNION ALL SELECT 'address:' || CAST(a.addr_id AS VARCHAR), a.street || ' ' || a.number, 'address', p.lat, p.lon FROM (SELECT c_custkey AS addr_id, {', '.join(ADDR)} FROM customer) a JOIN pois p ON p.poi_id = a.addr_id""",
          "entry": f"SELECT *, string_split(folded, ' ') AS tokens FROM (SELECT *, {FOLD.format('label')} AS folded FROM labels0) WHERE folded <> ''",
          "qs": f"""SELECT query_id, fq, string_split(fq, ' ') AS qt FROM (SELECT query_id, {FOLD.format('q')} AS fq FROM (SELECT row_number() OVER (ORDER BY q) AS query_id, q FROM (SELECT DISTINCT p_brand || ' ' || substr(p_type, 1, 4) AS q FROM part
 UNION SELECT * FROM (VALUES ('Rakowicka 1'), ('zizkovo'), ('ŁOBZ'), ('customer 00000014'), ('tisch 5/12'), ('sloneczne 2')) AS t(q))))""",
          "found": """SELECT query_id, entry_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM (SELECT query_id, score, entry_id, row_number() OVER (PARTITION BY query_id, folded, kind, round(lat, 3), round(lon, 3) ORDER BY score DESC, entry_id) AS one
 FROM (SELECT q.query_id, e.*, round(CASE e.kind WHEN 'district' THEN 30 WHEN 'place' THEN 25 WHEN 'poi' THEN 10 ELSE 0 END + CASE WHEN e.folded = q.fq THEN 100 WHEN starts_with(e.folded, q.fq) THEN 60 ELSE 0 END - length(e.folded) * CAST(0.1 AS DOUBLE), 6) AS score FROM qs q JOIN entry e
 ON (SELECT bool_and((SELECT bool_or(starts_with(u.et, t.tok)) FROM (SELECT unnest(e.tokens) AS et) u)) FROM (SELECT unnest(q.qt) AS tok) t))) WHERE one = 1"""}


def labels(spark, d):
    c = B.grid_cells(spark, d)
    dist = c.groupBy("city", "district_id", "district_name").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")) \
        .selectExpr("concat('district:', city, ':', district_id) AS entry_id", "district_name AS label", "'district' AS kind", "lat", "lon")
    place = c.where("neighborhood <> ''").groupBy("city", "neighborhood").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")) \
        .selectExpr("concat('place:', city, ':', neighborhood) AS entry_id", "neighborhood AS label", "'place' AS kind", "lat", "lon")
    poi = B.points(spark, d).selectExpr("concat('poi:', poi_id) AS entry_id", "name AS label", "'poi' AS kind", "lat", "lon")
    adr = addresses(spark, d).selectExpr("concat('address:', addr_id) AS entry_id", "concat(street, ' ', number) AS label", "'address' AS kind", "lat", "lon")
    return dist.unionByName(place).unionByName(poi).unionByName(adr)


@query("E10_search_index", q("SELECT prefix, count(*) AS n FROM (SELECT DISTINCT entry_id, substr(tok, 1, 2) AS prefix FROM (SELECT entry_id, unnest(tokens) AS tok FROM entry)) GROUP BY 1", **LABELS))
def search_index(spark, d):
    return SE.postings(SE.entries(labels(spark, d))).groupBy("prefix").agg(F.count("*").alias("n"))


TREE = {"tok": "SELECT t, count(*) AS n FROM (SELECT DISTINCT entry_id, unnest(tokens) AS t FROM entry) WHERE t <> '' GROUP BY 1",
        "pre": "SELECT t, n, k, substr(t, 1, k) AS p FROM (SELECT t, n, unnest(range(1, least(length(t), 12) + 1)) AS k FROM tok)",
        "deep": "SELECT t, max(k) AS d FROM pre JOIN (SELECT p FROM pre GROUP BY 1 HAVING sum(n) > 50) h USING (p) GROUP BY 1",
        "lf": "SELECT substr(t, 1, least(coalesce(d, 0) + 1, length(t), 12)) AS leaf, coalesce(d, 0) = length(t) AND coalesce(d, 0) < 12 AS ended, n FROM tok LEFT JOIN deep USING (t)"}


@query("E10_search_tree", q("SELECT leaf, ended, CAST(sum(n) AS BIGINT) AS n, CAST(ceil(sum(n) / 50.0) AS INTEGER) AS shards FROM lf GROUP BY 1, 2", **LABELS, **TREE))
def search_tree(spark, d):
    return SE.leaves(SE.prefix_tree(SE.entries(labels(spark, d)), 50), 50)


def search_queries(spark, d):
    more = spark.createDataFrame([(x,) for x in ("Rakowicka 1", "zizkovo", "ŁOBZ", "customer 00000014", "tisch 5/12", "sloneczne 2")], "q string")
    qs = B.table(spark, d, "part").select(F.concat("p_brand", F.lit(" "), F.substring("p_type", 1, 4)).alias("q")).union(more).distinct()
    return R.global_positions(qs, [], [F.asc("q")], "query_id")


@query("E11_search_rank", q("SELECT query_id, rank, entry_id, score FROM found WHERE rank <= 8", **LABELS))
def search_rank(spark, d):
    index = stored(spark, d, "search-entries", lambda: SE.entries(labels(spark, d)))
    tree = stored(spark, d, "search-tree", lambda: SE.prefix_tree(index))
    return SE.search(search_queries(spark, d), index, 8, tree=tree).select("query_id", "rank", "entry_id", "score")


# a nation's customers and suppliers are hits of queries of very different size: one query of nation 0, up to 961 of nation 24
ASKS = "{n} * 1000 + {k} % (1 + {n} * 40)"
MERGE = {"prim": f"SELECT {ASKS.format(n='c_nationkey', k='c_custkey')} AS query_id, row_number() OVER (PARTITION BY {ASKS.format(n='c_nationkey', k='c_custkey')} ORDER BY c_acctbal, c_custkey) AS rank, 'place ' || CAST(c_custkey % 3 AS VARCHAR) AS folded, p.lat, p.lon FROM customer JOIN pois p ON p.poi_id = c_custkey",
         "sec": f"SELECT {ASKS.format(n='nation', k='dest')} AS query_id, row_number() OVER (PARTITION BY {ASKS.format(n='nation', k='dest')} ORDER BY city, dest) AS rank, 'place ' || CAST(dest % 3 AS VARCHAR) AS folded, lat, lon FROM dests",
         "sec1": "SELECT s.* FROM sec s WHERE coalesce((SELECT count(*) FROM prim p WHERE p.query_id = s.query_id), 0) < 3 AND NOT EXISTS (SELECT 1 FROM prim p WHERE p.query_id = s.query_id AND p.folded = s.folded AND abs(s.lat - p.lat) < 0.003 AND abs(s.lon - p.lon) < 0.0045)",
         "sec2": "SELECT s.* FROM sec1 s WHERE NOT EXISTS (SELECT 1 FROM sec1 p WHERE p.query_id = s.query_id AND p.rank < s.rank AND p.folded = s.folded AND abs(s.lat - p.lat) < 0.003 AND abs(s.lon - p.lon) < 0.0045)"}


@query("E12_search_merge_dedup", q("""SELECT query_id, rank, src, folded, round(lat, 6) AS lat FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, r0) AS rank FROM (SELECT query_id, rank AS r0, folded, lat, 0 AS src FROM prim UNION ALL SELECT query_id, rank, folded, lat, 1 FROM sec2)) WHERE rank <= 8""", **MERGE))
def search_merge_dedup(spark, d):
    """All hits of both sources, merged to the best eight per query."""
    p = B.table(spark, d, "customer").join(B.points(spark, d).select(F.col("poi_id").alias("c_custkey"), "lat", "lon"), "c_custkey")
    p = p.select(F.expr(ASKS.format(n="c_nationkey", k="c_custkey")).alias("query_id"), "c_acctbal", "c_custkey", F.concat(F.lit("place "), F.col("c_custkey") % 3).alias("folded"), "lat", "lon")
    p = R.global_positions(p, ["query_id"], [F.asc("c_acctbal"), F.asc("c_custkey")], "rank")
    s = B.dests(spark, d).select(F.expr(ASKS.format(n="nation", k="dest")).alias("query_id"), "city", "dest", F.concat(F.lit("place "), F.col("dest") % 3).alias("folded"), "lat", "lon")
    s = R.global_positions(s, ["query_id"], [F.asc("city"), F.asc("dest")], "rank")
    cols = lambda df: df.select("query_id", "rank", F.col("folded").alias("label"), "folded", "lat", "lon")
    return SE.merge(cols(p), cols(s), 8).select("query_id", "rank", "src", "folded", *rnd("lat"))


# ------------------------------------------------------------------ catalogue
@query("E08_region_overview", q(f"""SELECT s.city, p.criterion, {half_even('sum(p.base_w * s.coverage) / sum(p.base_w)', 3)} AS coverage, CASE s.city WHEN 'praha' THEN 'CZK' ELSE 'PLN' END AS currency,
 CASE s.city WHEN 'praha' THEN 'rent' ELSE 'buy' END AS price_mode, m.cells FROM stats s JOIN spec p USING (j) JOIN (SELECT city, count(*) AS cells FROM cells GROUP BY 1) m ON m.city = s.city
 WHERE NOT p.is_alias AND p.base_w > 0 AND (p.only_city IS NULL OR p.only_city = s.city) GROUP BY s.city, p.criterion, m.cells"""))
def region_overview(spark, d):
    stats = filled_long(spark, d).where("habitable").groupBy("city", "j").agg(F.avg(F.col("v").isNotNull().cast("double")).alias("coverage"))
    return CA.region_overview(stats, B.grid_cells(spark, d), B.SPECS)


@query("E09_indicator_catalog", q(f"""SELECT 'indicator' AS section, s.city, p.ikey AS indicator, {half_even('s.coverage', 3)} AS coverage, s.coverage > 0 AS available, p.base_w AS weight, p.norm, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high
 FROM stats s JOIN spec p USING (j) WHERE p.only_city IS NULL OR p.only_city = s.city
 UNION ALL SELECT 'mustHave', c.city, m.category, CAST(NULL AS DOUBLE), coalesce(st.coverage > 0 AND (m.only_city IS NULL OR m.only_city = c.city), FALSE), CAST(NULL AS DOUBLE), NULL, NULL, NULL, NULL FROM must_have m CROSS JOIN price_col c
 LEFT JOIN spec p ON p.ikey = m.col LEFT JOIN stats st ON st.city = c.city AND st.j = p.j
 UNION ALL SELECT 'price', r.city, p.pcol, NULL, TRUE, NULL, NULL, round(median(v), 6), round(min(v), 6), round(max(v), 6) FROM raw_long r JOIN price_col p ON p.city = r.city AND p.pcol = r.ikey WHERE habitable AND v IS NOT NULL GROUP BY 2, 3"""))
def indicator_catalog(spark, d):
    """What a city offers: its indicators, the categories a request can demand, and the spread of its prices."""
    hab = filled_long(spark, d).where("habitable").select("city", "indicator", "v")
    stats = hab.groupBy("city", "indicator").agg(F.avg(F.col("v").isNotNull().cast("double")).alias("coverage"))
    return CA.whole_catalog(stats, hab, B.SPECS).select("section", "city", "indicator", "coverage", "available", "weight", "norm", *rnd("median", "low", "high"))


@query("E13_static_score", q(f"""SELECT c.city, c.persona, c.cell_id, c.score, CAST(least(greatest({half_even('m.mf')}, 0), 100) AS INTEGER) AS exact, abs(c.score - CAST(least(greatest({half_even('m.mf')}, 0), 100) AS INTEGER)) <= 1 AS within_one FROM (
 SELECT c.request_id, c.city, r.persona, c.cell_id, CAST(floor(CASE WHEN sum(lw.lw) > 0 THEN sum(lw.lw * {half_even('c.sc')}) / sum(lw.lw) ELSE avg({half_even('c.sc')}) END + 0.5) AS INTEGER) AS score
 FROM crit c JOIN {PERSONA_SQL} r USING (request_id) JOIN persona_level pl ON pl.persona = r.persona AND pl.criterion = c.criterion JOIN level_weight lw ON lw.level = pl.level GROUP BY 1, 2, 3, 4) c
 JOIN mf m ON m.request_id = c.request_id AND m.cell_id = c.cell_id"""))
def static_score(spark, d):
    """The match from the offline export beside the exact one: whole criterion scores cost a point at most."""
    sc = scores(spark, d).where("request_id > 100")
    out = CA.static_match(WR.static_scores(sc)).select("city", "persona", "cell_id", "score")
    out = out.join(sc.select("city", "persona", "cell_id", F.col("score").alias("exact")), ["city", "persona", "cell_id"])
    return out.withColumn("within_one", F.abs(F.col("score") - F.col("exact")) <= 1)


# ------------------------------------------------------------------ quality
KEEP = [c for c in B.BOUND]


@query("Q01_check_schema", "SELECT * FROM (VALUES " + ", ".join(
    f"('praha', '{c}', 'missing')" for c in [*[x for x in expected_columns("praha") if x not in B.BOUND], "poi.metro_station_walk_min"]) + ", ('praha', 'price.buy_per_m2', 'unknown'), ('praha', 'cell_id', 'int instead of string')) AS t(city, \"column\", problem)")
def check_schema(spark, d):
    return QA.check_schema(B.cells(spark, d).drop("q", "r", "x", "y"), "praha")


@query("Q02_check_key_unique", q("""SELECT city, 'duplicate' AS problem, count(*) FILTER (WHERE n > 1) AS n FROM (SELECT c.city, x.l_suppkey AS id, count(*) AS n FROM cells c JOIN (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1) x ON x.l_partkey = c.cell_id GROUP BY 1, 2) GROUP BY 1
 UNION ALL SELECT city, 'malformed', count(*) FROM (SELECT DISTINCT c.city, x.l_suppkey AS id FROM cells c JOIN (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1) x ON x.l_partkey = c.cell_id) WHERE NOT regexp_matches(CAST(id AS VARCHAR), '^[0-9a-f]{1,2}$') GROUP BY 1"""))
def check_key_unique(spark, d):
    x = B.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cell_id")).agg(F.min("l_suppkey").alias("sid"))
    c = B.grid_cells(spark, d).select("city", "cell_id").join(x, "cell_id").select("city", F.col("sid").alias("cell_id"))
    return QA.check_keys(c, pattern="^[0-9a-f]{1,2}$").where("problem = 'duplicate' OR n > 0")


values_range = ", ".join(f"('{u}', {lo}, {hi})" for u, (lo, hi) in EXPECTED_RANGE.items())


@query("Q03_check_ranges", q(f"""SELECT r.city, r.ikey AS indicator, r.unit, round(avg(CASE WHEN r.v BETWEEN e.lo AND e.hi THEN 0.0 ELSE 1.0 END), 6) AS outside, round(min(r.v), 6) AS min, round(max(r.v), 6) AS max, r.unit = 'min' AND max(r.v) > 60.0001 AS above_cap
 FROM raw_long r JOIN (VALUES {values_range}) AS e(unit, lo, hi) ON e.unit = r.unit WHERE r.habitable AND r.v IS NOT NULL AND NOT r.is_alias GROUP BY 1, 2, 3"""))
def check_ranges(spark, d):
    out = QA.check_ranges(filled_long(spark, d), B.SPECS)
    return out.select("city", "indicator", "unit", *rnd("outside", "min", "max"), "above_cap")


@query("Q04_check_nulls", q("""SELECT city, ikey AS indicator, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share, CASE WHEN count(v) = 0 THEN 'dropped'
 WHEN avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) > 0.2 THEN 'warning' ELSE 'ok' END AS status FROM raw_long WHERE habitable GROUP BY 1, 2"""))
def check_nulls(spark, d):
    return QA.check_nulls(filled_long(spark, d)).withColumn("null_share", F.round("null_share", 6))


@query("Q05_check_vocab", q("SELECT category, count(*) AS n FROM pois WHERE category IN ('shop', 'hospital') GROUP BY 1"))
def check_vocab(spark, d):
    return QA.check_vocabulary(B.points(spark, d), spark.createDataFrame([(c,) for c in POI_VOCAB], "category string"))


@query("Q06_check_foreign_keys", """SELECT 'events.user' AS name, count(*) AS missing FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier))
 UNION ALL SELECT 'orders.customer', count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))""")
def check_foreign_keys(spark, d):
    a = QA.check_foreign_keys(B.table(spark, d, "events"), B.table(spark, d, "supplier"), ["user_id"], ["s_suppkey"], "events.user")
    b = QA.check_foreign_keys(B.table(spark, d, "orders"), B.table(spark, d, "customer"), ["o_custkey"], ["c_custkey"], "orders.customer")
    return a.unionByName(b)


@query("Q07_check_manifest", "SELECT CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS key, CASE event_type WHEN 'click' THEN 'bad' ELSE 'ok' END AS status, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY 1, 2")
def check_manifest(spark, d):
    m = B.table(spark, d, "events").selectExpr("CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS key", "CASE event_type WHEN 'click' THEN 'bad' ELSE 'ok' END AS status")
    return QA.check_manifest(m).groupBy("key", "status").agg(F.count("*").alias("n"))


@query("J26_order_key_equality_check", """SELECT count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND a.f IS DISTINCT FROM b.f) AS differing
 FROM (SELECT p_partkey AS k, p_size >= 3 AS f FROM part) a FULL JOIN (SELECT l_partkey AS k, max(l_quantity) >= 48 AS f FROM lineitem GROUP BY 1) b ON a.k = b.k""")
def order_key_equality_check(spark, d):
    a = B.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") >= 3).alias("f"))
    b = B.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg((F.max("l_quantity") >= 48).alias("f"))
    return QA.same_flags(a, b, ["k"], "f")


@query("Q09_coverage_report", q(f"""SELECT s.city, p.criterion, {half_even('sum(p.base_w * s.coverage) / sum(p.base_w)', 3)} AS coverage, count(*) FILTER (WHERE s.coverage > 0) AS with_data, count(*) AS total FROM stats s JOIN spec p USING (j)
 WHERE NOT p.is_alias AND p.base_w > 0 AND (p.only_city IS NULL OR p.only_city = s.city) GROUP BY 1, 2"""))
def coverage_report(spark, d):
    stats = filled_long(spark, d).where("habitable").groupBy("city", "j").agg(F.avg(F.col("v").isNotNull().cast("double")).alias("coverage"))
    return QA.coverage_report(stats, B.SPECS)


@query("Q10_health_status", q("SELECT CASE WHEN bool_and(n > 5) THEN 'ok' ELSE 'degraded' END AS status, count(*) AS regions FROM (SELECT city, count(*) AS n FROM cells GROUP BY 1)"))
def health_status(spark, d):
    r = B.grid_cells(spark, d).groupBy("city").agg(F.when(F.count("*") > 5, "real").otherwise("synthetic").alias("source"))
    return QA.health(r)


@query("Q11_check_translations", """SELECT path, count(DISTINCT lang) AS langs, count(DISTINCT vars) AS forms FROM (SELECT 'doc.' || CAST(doc_id % 200 AS VARCHAR) AS path, lang, CASE WHEN n_chars % 2 = 0 THEN 'count' ELSE 'count,value' END AS vars FROM documents)
 GROUP BY 1 HAVING count(DISTINCT lang) < 4 OR count(DISTINCT vars) > 1""")
def check_translations(spark, d):
    t = B.table(spark, d, "documents").selectExpr("concat('doc.', doc_id % 200) AS path", "lang", "CASE WHEN n_chars % 2 = 0 THEN 'x {{count}}' ELSE '{{value}} of {{count}} {{value}}' END AS text")
    return QA.check_translations(t)


@query("Q08_sanity_report", q("""SELECT district_id || ' in the upper half for ' || ikey AS name, CASE WHEN rk <= n // 2 THEN 'PASS' ELSE 'FAIL' END AS result, city || ' rank ' || CAST(rk AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS detail FROM (SELECT city, ikey, district_id,
 row_number() OVER (PARTITION BY city, ikey ORDER BY round(median(v), 9) DESC NULLS LAST, district_id) AS rk, count(*) OVER (PARTITION BY city, ikey) AS n FROM raw_long JOIN cells c USING (city, cell_id) WHERE c.habitable GROUP BY 1, 2, 3)"""))
def sanity_report(spark, d):
    """Every district against every indicator."""
    hab = prepared(spark, d).where("habitable").selectExpr("city", "district_id", "posexplode(raw) AS (j, v)")
    hab = hab.select("city", "district_id", F.array(*[F.lit(s.key) for s in B.SPECS])[F.col("j")].alias("indicator"), "v")
    return QA.sanity([CA.rank_assertions(hab, "district_id")])


# ------------------------------------------------------------------ extension points
@query("U01_adapter_registry", q("""SELECT c.city, c.cell_id, coalesce(n.n, 0) AS pois, CASE WHEN c.city = 'krakow' THEN c.population_est * 2 END AS extra FROM cells c
 LEFT JOIN (SELECT city, hq, hr, count(*) AS n FROM poi_hex GROUP BY 1, 2, 3) n ON n.city = c.city AND n.hq = c.q AND n.hr = c.r"""))
def adapter_registry(spark, d):
    from .spatial_queries import points_per_cell
    reg = AD.Registry()
    reg.add("pois", lambda c: points_per_cell(spark, d).withColumnRenamed("n", "pois"))
    reg.add("extra", lambda c: c.select("city", "cell_id", (F.col("population_est") * 2).alias("extra")), city="krakow")
    return reg.apply(B.grid_cells(spark, d)).select("city", "cell_id", "pois", "extra")


@query("U02_sql_functions", q("""SELECT poi_id, round(6371.0 * 2 * asin(sqrt(least(greatest(pow(sin((radians(50.05) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(50.05)) * pow(sin((radians(14.4) - radians(lon)) / 2), 2), 0.0), 1.0))), 6) AS km,
 round(least(greatest((value - 9000.0) / -8000.0 * 100.0, 0.0), 100.0), 6) AS score, """ + FOLD.format("name") + " AS folded FROM pois"))
def sql_functions(spark, d):
    AD.register_sql_functions(spark)
    B.points(spark, d).createOrReplaceTempView("placewise_points")
    return spark.sql("SELECT poi_id, round(pw_haversine_km(lat, lon, 50.05D, 14.4D), 6) AS km, round(pw_decay(value, 1000D, 9000D), 6) AS score, pw_fold(name) AS folded FROM placewise_points")
