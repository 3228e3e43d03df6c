"""Registered queries: distance joins, polygons, rings, street graph, rasters."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph as GR, overlay as OV, raster as RA, spatial as SP, transit as TR
from . import bindings as B
from .function_queries import SIZE, hex_cte, hex_sql
from .oracle import CTES, cte, q
from .registry import query
from .relational_queries import TT_SQL, TX_SQL, departures, rnd, sales
from .scoring_queries import scores
from ..operators import scoring as S


def cells(spark, d):
    return B.grid_cells(spark, d).select("city", "cell_id", "q", "r", "x", "y", "habitable")


D2 = "({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y)"


def d2(a, b):
    return D2.format(a=a, b=b)


# ------------------------------------------------------------------ nearest and radius joins
@query("J08_nearest_neighbor", q(f"""SELECT city, cell_id, dest, round(sqrt(dd), 6) AS dist FROM (SELECT c.city, c.cell_id, t.dest, {d2('c', 't')} AS dd,
 row_number() OVER (PARTITION BY c.cell_id ORDER BY round(sqrt({d2('c', 't')}), 6), t.dest) AS rn FROM cells c JOIN dests t ON t.city = c.city) WHERE rn = 1"""))
def nearest_neighbor(spark, d):
    t = B.dests(spark, d).select("city", "dest", "x", "y")
    out = SP.nearest(cells(spark, d), t, ["city", "cell_id"], "dest", ["city"])
    return out.select("city", "cell_id", "dest", F.round("dist", 6).alias("dist"))


@query("J09_radius_join_count", q(f"""SELECT c.city, c.cell_id, count(t.poi_id) AS n FROM cells c LEFT JOIN pois t ON t.city = c.city AND {d2('c', 't')} <= 500.0 * 500.0 GROUP BY 1, 2"""))
def radius_join_count(spark, d):
    return SP.count_within(cells(spark, d), B.points(spark, d).select("city", "x", "y"), 500.0, ["city", "cell_id"], ["city"])


@query("J10_radius_join_sum", q(f"""SELECT c.city, c.cell_id, round(coalesce(sum(t.value), 0), 4) AS total FROM cells c LEFT JOIN pois t ON t.city = c.city AND {d2('c', 't')} <= 500.0 * 500.0 GROUP BY 1, 2"""))
def radius_join_sum(spark, d):
    out = SP.sum_within(cells(spark, d), B.points(spark, d), "value", 500.0, ["city", "cell_id"], ["city"])
    return out.withColumn("total", F.round("total", 4))


STOP_POS = {"stop_pos": f"""SELECT DISTINCT feed, stop_id, CASE WHEN stop_id % 2 = 0 THEN 'praha' ELSE 'krakow' END AS city, CASE WHEN stop_id % 3 = 0 THEN '1' ELSE '2' END AS wb,
 300.0 * ((stop_id * 7) % 64 + 0.25) AS x, 259.8076211353316 * (stop_id % 16) + 40.0 AS y FROM st""",
            "stop_agg": """SELECT feed, stop_id, count(*) FILTER (WHERE peak) / 2.0 AS dep, count(*) FILTER (WHERE peak AND wc) / 2.0 AS depwc FROM dep GROUP BY 1, 2""",
            "near_stop": f"""SELECT c.city, c.cell_id, s.feed, s.stop_id, s.wb, a.dep, a.depwc FROM cells c LEFT JOIN (stop_pos s JOIN stop_agg a ON a.feed = s.feed
 AND a.stop_id = s.stop_id) ON s.city = c.city AND {d2('c', 's')} <= 810000.0""",
            "near_items": """SELECT n.city, n.cell_id, count(DISTINCT CASE WHEN d.peak THEN d.feed || ':' || CAST(d.trip_id AS VARCHAR) END) / 2.0 AS departures_per_h,
 count(DISTINCT d.feed || ':' || CAST(d.route_id AS VARCHAR)) AS lines, count(DISTINCT CASE WHEN d.night THEN d.feed || ':' || CAST(d.trip_id AS VARCHAR) END) AS night
 FROM near_stop n LEFT JOIN dep d ON d.feed = n.feed AND d.stop_id = n.stop_id GROUP BY 1, 2""",
            "near_share": """SELECT city, cell_id, round(100.0 * avg(CASE WHEN wb = '1' THEN 1.0 WHEN wb IS NOT NULL THEN 0.0 END), 4) AS accessible_share,
 round(100.0 * sum(depwc) / nullif(sum(dep), 0), 4) AS lowfloor_share FROM near_stop GROUP BY 1, 2"""}


def placed_stops(spark, d):
    return (TR.stop_stats(departures(spark, d)).selectExpr(
        "feed", "stop_id", "CASE WHEN stop_id % 2 = 0 THEN 'praha' ELSE 'krakow' END AS city", "CASE WHEN stop_id % 3 = 0 THEN '1' ELSE '2' END AS wb",
        "300.0D * ((stop_id * 7) % 64 + 0.25D) AS x", "259.8076211353316D * (stop_id % 16) + 40.0D AS y", "dep_peak_per_h AS dep",
        "dep_peak_wc_per_h AS depwc"))


@query("J11_radius_distinct_union", q("SELECT * FROM near_items", **TT_SQL, **STOP_POS))
def radius_distinct_union(spark, d):
    stops = placed_stops(spark, d).select("city", "feed", "stop_id", "x", "y")
    return TR.distinct_within(cells(spark, d), stops, TR.stop_items(departures(spark, d)), 900.0, ["city", "cell_id"], ["city"])


@query("J12_radius_ratio", q("SELECT * FROM near_share", **TT_SQL, **STOP_POS))
def radius_ratio(spark, d):
    out = TR.shares_within(cells(spark, d), placed_stops(spark, d), 900.0, ["city", "cell_id"], ["city"])
    return out.select("city", "cell_id", *rnd("accessible_share", "lowfloor_share", digits=4))


@query("G14_transit_access", q("SELECT i.*, s.accessible_share, s.lowfloor_share FROM near_items i JOIN near_share s USING (city, cell_id)", **TT_SQL, **STOP_POS))
def transit_access(spark, d):
    return radius_distinct_union(spark, d).join(radius_ratio(spark, d), ["city", "cell_id"])


# ------------------------------------------------------------------ polygons
CORNERS = ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (0.0, 0.3), (-1.0, 1.0))
cte("poly_v", "SELECT city, dest, i, x + 7.3 + ox * (500 + (dest % 5) * 150) AS vx, y + 3.1 + oy * (500 + (dest % 5) * 150) AS vy FROM dests CROSS JOIN (VALUES "
    + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(CORNERS)) + ") AS t(i, ox, oy)")
cte("poly_e", """SELECT a.city, a.dest, a.i, a.vx AS x1, a.vy AS y1, b.vx AS x2, b.vy AS y2 FROM poly_v a JOIN poly_v b ON b.city = a.city AND b.dest = a.dest
 AND b.i = (a.i + 1) % 5""")
cte("poly_box", "SELECT city, dest, min(x1) AS x0, max(x1) AS xm, min(y1) AS y0, max(y1) AS ym FROM poly_e GROUP BY 1, 2")


def inside_sql(pts, ids, extra=""):
    return f"""SELECT p.city, {ids}, e.dest FROM {pts} p JOIN poly_box b ON b.city = p.city AND p.x BETWEEN b.x0 AND b.xm AND p.y BETWEEN b.y0 AND b.ym
 JOIN poly_e e ON e.city = b.city AND e.dest = b.dest WHERE (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 {extra}
 GROUP BY ALL HAVING count(*) % 2 = 1"""


def polygons(spark, d):
    ring = F.array(*[F.struct((F.col("x") + 7.3 + F.lit(a) * F.col("rad")).alias("x"), (F.col("y") + 3.1 + F.lit(b) * F.col("rad")).alias("y")) for a, b in CORNERS])
    p = B.dests(spark, d).withColumn("rad", F.expr("500 + (dest % 5) * 150"))
    return p.select("city", "dest", ring.alias("ring"))


def poly_edges(spark, d):
    return SP.edges(polygons(spark, d), ["city", "dest"])


@query("J13_point_in_polygon", q(f"SELECT city, poi_id, min(dest) AS dest FROM ({inside_sql('pois', 'p.poi_id')}) GROUP BY 1, 2"))
def point_in_polygon(spark, d):
    return SP.point_in_polygon(B.points(spark, d), poly_edges(spark, d), ["city", "poi_id"], "dest", 500.0, ["city"])


# Twins of the overlay: corners of one polygon are clipped at the lines of a convex one, one step a line, and the area taken of what is left
def clipped(name, corners, lines, n):
    """CTEs name0..namen. ``corners``: (pid, i, x, y) in ring order; ``lines``: (pid, h, fx, fy, gx, gy), keeping what lies left of them."""
    out = {f"{name}0": f"SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY i) AS i, x, y FROM {corners}"}
    for h in range(n):
        out[f"{name}_s{h}"] = f"""SELECT c.pid, c.i, c.x, c.y, coalesce(lead(c.x) OVER w, first_value(c.x) OVER w) AS nx, coalesce(lead(c.y) OVER w, first_value(c.y) OVER w) AS ny, l.fx, l.fy, l.gx, l.gy
 FROM {name}{h} c JOIN {lines} l ON l.pid = c.pid AND l.h = {h} WINDOW w AS (PARTITION BY c.pid ORDER BY c.i)"""
        out[f"{name}_d{h}"] = f"""SELECT *, (gx - fx) * (y - fy) - (gy - fy) * (x - fx) AS d, (gx - fx) * (ny - fy) - (gy - fy) * (nx - fx) AS nd FROM {name}_s{h}"""
        out[f"{name}{h + 1}"] = f"""SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY i, k) AS i, x, y FROM (SELECT pid, i, 0 AS k, x, y FROM {name}_d{h} WHERE d >= 0 UNION ALL
 SELECT pid, i, 1, x + (nx - x) * d / (d - nd), y + (ny - y) * d / (d - nd) FROM {name}_d{h} WHERE (d >= 0) <> (nd >= 0))"""
    out[f"{name}_area"] = f"""SELECT pid, abs(sum(x * ny - nx * y)) / 2 AS area FROM (SELECT pid, x - x0 AS x, y - y0 AS y, coalesce(lead(x) OVER w, first_value(x) OVER w) - x0 AS nx,
 coalesce(lead(y) OVER w, first_value(y) OVER w) - y0 AS ny FROM (SELECT *, min(x) OVER (PARTITION BY pid) AS x0, min(y) OVER (PARTITION BY pid) AS y0 FROM {name}{n}) WINDOW w AS (PARTITION BY pid ORDER BY i)) GROUP BY 1"""
    return out


HEX = [(0.0, -SIZE), (SIZE * geo.SQRT3 / 2, -SIZE / 2), (SIZE * geo.SQRT3 / 2, SIZE / 2), (0.0, SIZE), (-SIZE * geo.SQRT3 / 2, SIZE / 2), (-SIZE * geo.SQRT3 / 2, -SIZE / 2)]
LABEL_SQL = {
    "hex_pair": f"""SELECT c.cell_id * 100000 + b.dest AS pid, c.city, c.cell_id, b.dest, c.x, c.y FROM cells c JOIN poly_box b ON b.city = c.city
 AND c.x + {SIZE} > b.x0 AND c.x - {SIZE} < b.xm AND c.y + {SIZE} > b.y0 AND c.y - {SIZE} < b.ym""",
    "hex_subject": "SELECT p.pid, v.i, v.vx AS x, v.vy AS y FROM hex_pair p JOIN poly_v v ON v.city = p.city AND v.dest = p.dest",
    "hex_line": "SELECT p.pid, t.h, p.x + t.fx AS fx, p.y + t.fy AS fy, p.x + t.gx AS gx, p.y + t.gy AS gy FROM hex_pair p CROSS JOIN (VALUES "
                + ", ".join(f"({h}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for h, (a, b) in enumerate(zip(HEX, HEX[1:] + HEX[:1]))) + ") AS t(h, fx, fy, gx, gy)",
    **clipped("hexclip", "hex_subject", "hex_line", 6),
    "best": """SELECT city, cell_id, arg_min(dest, (-round(area, 2), dest)) AS dest, max(area) AS area FROM hexclip_area JOIN hex_pair USING (pid) WHERE area > 1e-6 GROUP BY 1, 2"""}


@query("J14_majority_area_label", q(f"""SELECT city, cell_id, dest, 'area' AS how, round(area / {1.5 * geo.SQRT3 * SIZE ** 2}, 6) AS share FROM best UNION ALL
 SELECT city, cell_id, dest, 'nearest', NULL FROM (SELECT c.city, c.cell_id, t.dest,
 row_number() OVER (PARTITION BY c.cell_id ORDER BY round(sqrt({d2('c', 't')}), 6), t.dest) AS rn FROM cells c JOIN dests t ON t.city = c.city WHERE c.cell_id NOT IN (SELECT cell_id FROM best)) WHERE rn = 1""",
    **LABEL_SQL))
def majority_area_label(spark, d):
    centres = B.dests(spark, d).select("city", "dest", "x", "y")
    return OV.majority_label(cells(spark, d), poly_edges(spark, d), ["city", "cell_id"], "dest", 500.0, SIZE, centres, ["city"]).withColumn("share", F.round("share", 6))


cte("poly_px", f"""SELECT b.city, b.dest, ix, iy, (ix + 0.5) * 200.0 AS x, (iy + 0.5) * 200.0 AS y FROM (SELECT *, unnest(generate_series(CAST(floor(y0 / 200.0) AS BIGINT), CAST(floor(ym / 200.0) AS BIGINT))) AS iy
 FROM (SELECT *, unnest(generate_series(CAST(floor(x0 / 200.0) AS BIGINT), CAST(floor(xm / 200.0) AS BIGINT))) AS ix FROM poly_box)) b""")
cte("px_in", """SELECT p.city, p.dest, p.ix, p.iy, p.x, p.y FROM poly_px p JOIN poly_e e ON e.city = p.city AND e.dest = p.dest
 WHERE (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY ALL HAVING count(*) % 2 = 1""")
cte("burnt", "SELECT city, ix, iy, max(40.0 + dest % 30) AS value FROM px_in GROUP BY 1, 2, 3")


def levels(spark, d):
    return B.dests(spark, d).selectExpr("city", "dest", "40.0D + dest % 30 AS level")


def burnt(spark, d):
    return RA.burn(poly_edges(spark, d), levels(spark, d), "dest", "level", 200.0, ["city"])


@query("G09_raster_polygon", q("SELECT * FROM burnt"))
def raster_polygon(spark, d):
    return burnt(spark, d)


def disk_values(radius, res):
    return ", ".join(f"({a}, {b})" for a, b in RA.disk_offsets(radius, res))


def disk_sql(radius, res, px, agg):
    n = len(RA.disk_offsets(radius, res))
    return agg.format(n=float(n), body=f"""(SELECT c.city, c.cell_id, p.value FROM cells c CROSS JOIN (VALUES {disk_values(radius, res)}) AS o(dx, dy) LEFT JOIN {px} p ON p.city = c.city
 AND p.ix = CAST(floor(c.x / {res}) AS BIGINT) + o.dx AND p.iy = CAST(floor(c.y / {res}) AS BIGINT) + o.dy)""")


@query("G10_disk_mean", q(disk_sql(1000.0, 200.0, "burnt", "SELECT city, cell_id, CASE WHEN count(value) >= 0.05 * {n} THEN round(avg(value), 6) END AS value FROM {body} GROUP BY 1, 2")))
def disk_mean(spark, d):
    out = RA.disk_mean(cells(spark, d), burnt(spark, d), 1000.0, 200.0, ["city", "cell_id"], ["city"])
    return out.withColumn("value", F.round("value", 6))


@query("G11_disk_area_share", q(disk_sql(1000.0, 200.0, "burnt", f"SELECT city, cell_id, round(100.0 * count(value) / {{n}}, 6) AS share_pct, round({RA.DISK_1KM_HA} * count(value) / {{n}}, 6) AS ha FROM {{body}} GROUP BY 1, 2")))
def disk_area_share(spark, d):
    s = RA.disk_share(cells(spark, d), burnt(spark, d), 1000.0, 200.0, ["city", "cell_id"], ["city"])
    return s.select("city", "cell_id", F.round(F.col("share") * 100.0, 6).alias("share_pct"), F.round(F.col("share") * RA.DISK_1KM_HA, 6).alias("ha"))


# every corner of a polygon is visible from its fourth one: three triangles, each of them a convex clip
FAN = (3, ((4, 0), (0, 1), (1, 2)))
APPORTION_SQL = {
    "fan": "SELECT m.city, m.dest, t.k, m.vx AS cx, m.vy AS cy, a.vx AS fx, a.vy AS fy, b.vx AS gx, b.vy AS gy FROM (VALUES "
           + ", ".join(f"({k}, {i}, {j})" for k, (i, j) in enumerate(FAN[1])) + f""") AS t(k, i, j) JOIN poly_v a ON a.i = t.i
 JOIN poly_v b ON b.i = t.j AND b.city = a.city AND b.dest = a.dest JOIN poly_v m ON m.i = {FAN[0]} AND m.city = a.city AND m.dest = a.dest""",
    "fan_pair": """SELECT (s.dest * 100000 + f.dest) * 10 + f.k + CASE WHEN f.city = 'praha' THEN 5 ELSE 0 END AS pid, f.*, s.dest AS src FROM fan f JOIN poly_box s ON s.city = f.city
 AND least(f.cx, f.fx, f.gx) < s.xm AND greatest(f.cx, f.fx, f.gx) > s.x0 AND least(f.cy, f.fy, f.gy) < s.ym AND greatest(f.cy, f.fy, f.gy) > s.y0""",
    "fan_subject": "SELECT p.pid, v.i, v.vx AS x, v.vy AS y FROM fan_pair p JOIN poly_v v ON v.city = p.city AND v.dest = p.src",
    "fan_line": """SELECT pid, 0 AS h, cx AS fx, cy AS fy, fx AS gx, fy AS gy FROM fan_pair UNION ALL SELECT pid, 1, fx, fy, gx, gy FROM fan_pair UNION ALL SELECT pid, 2, gx, gy, cx, cy FROM fan_pair""",
    **clipped("fanclip", "fan_subject", "fan_line", 3),
    "poly_area": "SELECT city, dest, abs(sum((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))) / 2 AS whole FROM poly_e JOIN poly_box USING (city, dest) GROUP BY 1, 2"}


@query("J15_area_apportion", q("""SELECT p.city, p.dest AS district, round(sum(s.value * a.area / w.whole), 4) AS value FROM fanclip_area a JOIN fan_pair p USING (pid)
 JOIN dests s ON s.city = p.city AND s.dest = p.src JOIN poly_area w ON w.city = p.city AND w.dest = p.src GROUP BY 1, 2""", **APPORTION_SQL))
def area_apportion(spark, d):
    src = poly_edges(spark, d).withColumnRenamed("dest", "src")
    dis = poly_edges(spark, d).withColumnRenamed("dest", "district")
    val = B.dests(spark, d).select("city", F.col("dest").alias("src"), "value")
    out = OV.apportion(src, val, dis, "src", "district", "value", 500.0, ["city"])
    return out.withColumn("value", F.round("value", 4))


@query("G07_outline_points", q("""SELECT city, dest, i, k, round(x1 + (x2 - x1) * k / n, 4) AS x, round(y1 + (y2 - y1) * k / n, 4) AS y FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM (
 SELECT e.*, greatest(CAST(ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 50.3) AS INTEGER), 1) AS n FROM poly_e e JOIN (SELECT city, dest FROM poly_e GROUP BY 1, 2
 HAVING abs(sum(x1 * y2 - x2 * y1) / 2) >= 1500000) USING (city, dest)))"""))
def outline_points(spark, d):
    e = poly_edges(spark, d)
    big = SP.area(e, ["city", "dest"]).where("area >= 1500000")
    pts = SP.densify(e.join(big.select("city", "dest"), ["city", "dest"], "left_semi"), ["city", "dest"], 50.3)
    return pts.select("city", "dest", "i", "k", *rnd("x", "y", digits=4))


@query("G01_build_grid", q(f"""SELECT city, dest, q, r FROM (SELECT h.city, h.dest, h.q, h.r FROM (SELECT *, 519.6152422706632 * (q + r / 2.0) AS x, 450.0 * r AS y FROM (SELECT *, unnest(generate_series(
 CAST(ceil(x0 / 519.6152422706632 - r / 2.0) AS BIGINT), CAST(floor(xm / 519.6152422706632 - r / 2.0) AS BIGINT))) AS q FROM (SELECT *, unnest(generate_series(CAST(ceil(y0 / 450.0) AS BIGINT),
 CAST(floor(ym / 450.0) AS BIGINT))) AS r FROM poly_box))) h JOIN poly_e e ON e.city = h.city AND e.dest = h.dest WHERE (e.y1 > h.y) <> (e.y2 > h.y)
 AND h.x < (e.x2 - e.x1) * (h.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""))
def build_grid(spark, d):
    return SP.hexagons_inside(poly_edges(spark, d), ["dest"], 300.0, 500.0, ["city"]).select("city", "dest", "q", "r")


@query("G17_group_outline", q(f"""SELECT city, neighborhood, x1, y1, x2, y2 FROM (SELECT city, neighborhood, least(a, b) AS p, greatest(a, b) AS s FROM (SELECT city, neighborhood, unnest([
 {', '.join(f"{{'a': {{'x': round(x + ({ax}), 3), 'y': round(y + ({ay}), 3)}}, 'b': {{'x': round(x + ({bx}), 3), 'y': round(y + ({by}), 3)}}}}" for (ax, ay), (bx, by) in zip(
     [(0.0, SIZE), (SIZE * geo.SQRT3 / 2, SIZE / 2), (SIZE * geo.SQRT3 / 2, -SIZE / 2), (0.0, -SIZE), (-SIZE * geo.SQRT3 / 2, -SIZE / 2), (-SIZE * geo.SQRT3 / 2, SIZE / 2)],
     [(SIZE * geo.SQRT3 / 2, SIZE / 2), (SIZE * geo.SQRT3 / 2, -SIZE / 2), (0.0, -SIZE), (-SIZE * geo.SQRT3 / 2, -SIZE / 2), (-SIZE * geo.SQRT3 / 2, SIZE / 2), (0.0, SIZE)]))}
 ], recursive := false) AS e FROM cells WHERE neighborhood <> '') t, LATERAL (SELECT t.e.a AS a, t.e.b AS b)) z, LATERAL (SELECT z.p.x AS x1, z.p.y AS y1, z.s.x AS x2, z.s.y AS y2) GROUP BY ALL HAVING count(*) = 1"""))
def group_outline(spark, d):
    c = B.grid_cells(spark, d).where("neighborhood <> ''")
    return SP.group_outline(c, ["city", "neighborhood"], SIZE)


# ------------------------------------------------------------------ rings and cells
@query("J19_kring_neighbors", q("""SELECT c.city, c.cell_id, n.cell_id AS neighbor, CAST((abs(n.q - c.q) + abs(n.r - c.r) + abs(n.q - c.q + n.r - c.r)) / 2 AS INTEGER) AS ring FROM cells c
 JOIN cells n ON n.city = c.city AND abs(n.q - c.q) + abs(n.r - c.r) + abs(n.q - c.q + n.r - c.r) <= 4"""))
def kring_neighbors(spark, d):
    c = cells(spark, d)
    other = c.select("city", "q", "r", F.col("cell_id").alias("neighbor"))
    return SP.ring_join(c, other, 2).select("city", "cell_id", "neighbor", "ring")


@query("J20_kring_exclude", q("""SELECT t.request_id, n.cell_id FROM top_cells t JOIN cells c ON c.cell_id = t.cell_id JOIN cells n ON n.city = c.city AND n.habitable
 WHERE t.rank = 1 AND abs(n.q - c.q) + abs(n.r - c.r) + abs(n.q - c.q + n.r - c.r) > 4"""))
def kring_exclude(spark, d):
    c = cells(spark, d)
    best = S.top_cells(scores(spark, d)).where("rank = 1").select("request_id", "city", "cell_id")
    origin = best.join(c.select("city", "cell_id", F.col("q").alias("q0"), F.col("r").alias("r0")), ["city", "cell_id"]).drop("cell_id")
    return (c.where("habitable").join(origin, "city").where(geo.hex_distance(F.col("q") - F.col("q0"), F.col("r") - F.col("r0")) > 2)
            .select("request_id", "cell_id"))


cte("poi_hex", hex_cte("pois", SIZE, "city, poi_id, x, y, value"))


def poi_cells(spark, d):
    p = B.points(spark, d)
    hq, hr = geo.hex_cell(F.col("x"), F.col("y"), SIZE)
    return p.withColumn("q", hq).withColumn("r", hr)


@query("J21_nearest_habitable_ring", q(f"""SELECT p.city, p.poi_id, b.cell_id, CASE WHEN b.ring = 0 THEN NULL WHEN b.ring IS NOT NULL THEN 'nearest' WHEN o.cell_id IS NOT NULL THEN 'noneNearby' ELSE 'outside' END AS status
 FROM poi_hex p LEFT JOIN cells o ON o.city = p.city AND o.q = p.hq AND o.r = p.hr LEFT JOIN (SELECT * FROM (SELECT p.poi_id, c.cell_id, greatest(abs(c.q - p.hq), abs(c.r - p.hr), abs(c.q - p.hq + c.r - p.hr)) AS ring,
 row_number() OVER (PARTITION BY p.poi_id ORDER BY greatest(abs(c.q - p.hq), abs(c.r - p.hr), abs(c.q - p.hq + c.r - p.hr)), {d2('p', 'c')}, c.cell_id) AS rn FROM poi_hex p JOIN cells c ON c.city = p.city AND c.habitable
 AND greatest(abs(c.q - p.hq), abs(c.r - p.hr), abs(c.q - p.hq + c.r - p.hr)) <= 3) WHERE rn = 1) b ON b.poi_id = p.poi_id"""))
def nearest_habitable_ring(spark, d):
    p = poi_cells(spark, d).select("city", "poi_id", "q", "r", "x", "y")
    return SP.nearest_habitable(p, cells(spark, d), ["city", "poi_id"])


@query("A11_points_per_cell", q("""SELECT c.city, c.cell_id, count(p.poi_id) AS n FROM cells c LEFT JOIN poi_hex p ON p.city = c.city AND p.hq = c.q AND p.hr = c.r GROUP BY 1, 2"""))
def points_per_cell(spark, d):
    n = poi_cells(spark, d).groupBy("city", "q", "r").agg(F.count("*").alias("n"))
    return cells(spark, d).join(n, ["city", "q", "r"], "left").select("city", "cell_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("P23_habitable_mask", q("""SELECT c.city, c.cell_id, count(p.poi_id) >= 2 AS habitable FROM cells c LEFT JOIN poi_hex p ON p.city = c.city AND p.hq = c.q AND p.hr = c.r GROUP BY 1, 2"""))
def habitable_mask(spark, d):
    return points_per_cell(spark, d).select("city", "cell_id", (F.col("n") >= 2).alias("habitable"))


@query("P28_poi_finalize", q("""SELECT p.poi_id, p.category, coalesce(nullif(p.name, ''), '') AS name, round_even(round(p.lat, 9), 6) AS lat, round_even(round(p.lon, 9), 6) AS lon, h.hq, h.hr, '{}' AS extra_json
 FROM pois p JOIN poi_hex h USING (city, poi_id) WHERE p.nation <> 3"""))
def poi_finalize(spark, d):
    p = poi_cells(spark, d).withColumn("lat", F.expr("CASE WHEN nation = 3 THEN NULL ELSE lat END")).withColumn("extra_json", F.lit(None).cast("string"))
    from ..operators.registers import finalize_points
    return finalize_points(p).select("poi_id", "category", "name", "lat", "lon", F.col("q").alias("hq"), F.col("r").alias("hr"), "extra_json")


@query("A13_kring_median_expanding", q("""SELECT c.city, c.cell_id, coalesce(k.n, w.n, 0) AS n, round(k.med, 6) AS median FROM cells c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY k) AS rn FROM ringed WHERE n >= 5) WHERE rn = 1) k
 ON k.cell_id = c.cell_id LEFT JOIN ringed w ON w.cell_id = c.cell_id AND w.k = 3""", ringed="""SELECT c.cell_id, k.k, count(*) AS n, median(s.ppm2) AS med FROM cells c JOIN cells o ON o.city = c.city
 AND abs(o.q - c.q) + abs(o.r - c.r) + abs(o.q - c.q + o.r - c.r) <= 6 JOIN kept s ON s.l_partkey = o.cell_id JOIN (VALUES (0), (1), (2), (3)) AS k(k)
 ON abs(o.q - c.q) + abs(o.r - c.r) + abs(o.q - c.q + o.r - c.r) <= 2 * k.k GROUP BY 1, 2""", **TX_SQL))
def kring_median_expanding(spark, d):
    c = cells(spark, d)
    obs = sales(spark, d).select(F.col("l_partkey").alias("cell_id"), "ppm2").join(c.select("city", "cell_id", "q", "r"), "cell_id")
    out = SP.expanding_ring_median(c, obs, "ppm2", ["city", "cell_id"])
    return out.withColumn("median", F.round("median", 6))


@query("J17_anchor_to_dest", q(f"""SELECT p.city, p.poi_id, coalesce(o.dest, n.dest) AS dest FROM poi_far p LEFT JOIN (SELECT city, hq, hr, min(dest) AS dest FROM dest_far GROUP BY 1, 2, 3) o ON o.city = p.city AND o.hq = p.hq AND o.hr = p.hr
 LEFT JOIN (SELECT poi_id, dest FROM (SELECT p.poi_id, t.dest, row_number() OVER (PARTITION BY p.poi_id ORDER BY round(sqrt({d2('p', 't')}), 6), t.dest) AS rn FROM pois p JOIN dests t ON t.city = p.city AND {d2('p', 't')} <= 1500.0 * 1500.0) WHERE rn = 1) n
 ON n.poi_id = p.poi_id""", poi_far=hex_cte("pois", 461.0, "city, poi_id"), dest_far=hex_cte("dests", 461.0, "city, dest")))
def anchor_to_dest(spark, d):
    p = B.points(spark, d).select("city", "poi_id", "x", "y")
    return SP.resolve_destination(p, B.dests(spark, d).select("city", "dest", "x", "y"), ["city", "poi_id"], 461.0, 1500.0)


@query("J18_nearest_by_category", q(f"""SELECT city, cell_id, category, poi_id, round(walk, 4) AS walk_min FROM (SELECT n.*, coalesce(CASE WHEN category = 'supermarket' THEN f."shops.supermarket_walk_min" END,
 n.km * 1.3 / 4.8 * 60.0) AS walk FROM (SELECT c.city, c.cell_id, p.category, p.poi_id, {geo.EARTH_KM} * 2 * asin(sqrt(pow(sin((radians(p.lat) - radians(c.lat)) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat))
 * pow(sin((radians(p.lon) - radians(c.lon)) / 2), 2))) AS km, row_number() OVER (PARTITION BY c.cell_id, p.category ORDER BY round(sqrt({d2('c', 'p')}), 6), p.poi_id) AS rn FROM cells c JOIN pois p ON p.city = c.city) n
 JOIN feats f USING (cell_id) WHERE rn = 1) WHERE walk <= 30"""))
def nearest_by_category(spark, d):
    c = B.grid_cells(spark, d).select("city", "cell_id", "x", "y", "lat", "lon")
    p = B.points(spark, d).select("city", "category", "poi_id", "x", "y", "lat", "lon")
    measured = B.cells(spark, d).select("city", "cell_id", F.lit("supermarket").alias("category"), F.col("`shops.supermarket_walk_min`").alias("measured"))
    out = SP.nearest_per_category(c, p, ["city", "cell_id"], "poi_id", measured)
    return out.select("city", "cell_id", "category", "poi_id", F.round("walk_min", 4).alias("walk_min"))


@query("J22_idw_interpolate", q("""SELECT c.city, c.cell_id, CASE WHEN count(*) >= 2 THEN round(sum(s.value / greatest((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y), 40000.0))
 / sum(1.0 / greatest((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y), 40000.0)), 4) END AS value FROM cells c JOIN (SELECT d.* FROM dests d JOIN (SELECT city, avg(x) AS cx, avg(y) AS cy FROM cells GROUP BY 1) m
 ON m.city = d.city WHERE sqrt((d.x - cx) * (d.x - cx) + (d.y - cy) * (d.y - cy)) < 25000) s ON s.city = c.city GROUP BY 1, 2"""))
def idw_interpolate(spark, d):
    out = SP.inverse_distance(cells(spark, d), B.dests(spark, d), ["city", "cell_id"], "city")
    return out.withColumn("value", F.round("value", 4))


# ------------------------------------------------------------------ streets
WAY_TAGS = {"highway": B.pick(("residential", "primary", "footway", "cycleway", "motorway", "pedestrian", "path"), "p_size"),
            "lit": B.pick(("yes", "no", "", "24/7"), "p_partkey"), "cycleway": B.pick(("", "lane", "", "", "track"), "p_size"),
            "bicycle": B.pick(("", "designated", ""), "p_size"), "foot": B.pick(("", "", "no", "yes", ""), "p_partkey"),
            "access": B.pick(("", "private", "", ""), "p_size")}
cte("way_pts", """SELECT c.city, c.cell_id AS line_id, i, CAST(300.0 AS DOUBLE) * ((c.q + dq) + (c.r + dr) / CAST(2.0 AS DOUBLE)) AS x, CAST(259.8076211353316 AS DOUBLE) * (c.r + dr) AS y,
 """ + ", ".join(f"{e} AS {k}" for k, e in WAY_TAGS.items()) + """ FROM cells c JOIN part p ON p.p_partkey = c.cell_id CROSS JOIN (VALUES (0, 0, 0), (1, 1, 0), (2, 0, 1)) AS o(i, dq, dr)""")
cte("way_e", """SELECT a.city, a.line_id, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, a.highway, a.lit, a.cycleway, a.bicycle, a.foot, a.access,
 sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len FROM way_pts a JOIN way_pts b ON b.line_id = a.line_id AND b.i = a.i + 1""")
cte("way_seg", """SELECT *, x1 + (x2 - x1) * ((k + 0.5) / n) AS x, y1 + (y2 - y1) * ((k + 0.5) / n) AS y, len / n AS length FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM (SELECT *,
 greatest(CAST(ceil(len / 110.0) AS INTEGER), 1) AS n FROM way_e))""")
KEY = "CAST(round({0} * 100) AS BIGINT) * 10000000000 + CAST(round({1} * 100) AS BIGINT)"
cte("walk_e", f"""SELECT city, u, v, sum(len) AS len FROM (SELECT city, {KEY.format('x1', 'y1')} AS u, {KEY.format('x2', 'y2')} AS v, len FROM way_e WHERE highway NOT IN {GR.NO_WALK} AND foot <> 'no'
 AND NOT (access IN ('private', 'no') AND foot NOT IN ('yes', 'designated')) UNION ALL SELECT city, {KEY.format('x2', 'y2')}, {KEY.format('x1', 'y1')}, len FROM way_e WHERE highway NOT IN {GR.NO_WALK} AND foot <> 'no'
 AND NOT (access IN ('private', 'no') AND foot NOT IN ('yes', 'designated'))) WHERE u <> v GROUP BY 1, 2, 3""")


def ways(spark, d):
    c = B.grid_cells(spark, d).select("city", F.col("cell_id").alias("line_id"), "q", "r")
    tags = B.table(spark, d, "part").selectExpr("p_partkey AS line_id", *[f"{e} AS {k}" for k, e in WAY_TAGS.items()])
    pts = ", ".join(f"struct(300.0D * ((q + {a}) + (r + {b}) / 2.0D) AS x, 259.8076211353316D * (r + {b}) AS y)" for a, b in ((0, 0), (1, 0), (0, 1)))
    return c.selectExpr("city", "line_id", f"array({pts}) AS path").join(tags, "line_id")


def street_graph(spark, d):
    return GR.build(ways(spark, d).where(GR.walkable()), ["city"])


@query("W12_line_segments", q("SELECT city, line_id, i, k, round(x, 4) AS x, round(y, 4) AS y, round(length, 6) AS length FROM way_seg"))
def line_segments(spark, d):
    seg = SP.segments(SP.path_edges(ways(spark, d), ["city", "line_id"]), ["city", "line_id", "i"], 110.0)
    return seg.select("city", "line_id", "i", "k", *rnd("x", "y", digits=4), F.round("length", 6).alias("length"))


def way_segments(spark, d, cond, *tags):
    return SP.segments(SP.path_edges(ways(spark, d).where(cond), ["city", "line_id", *tags]), ["city", "line_id", "i", *tags], 110.0)


@query("A16_lit_share", q(f"""SELECT c.city, c.cell_id, round(100.0 * coalesce(sum(s.length) FILTER (WHERE s.lit IN ('yes', '24/7', 'automatic', 'limited')), 0) / sum(s.length), 4) AS lit_share FROM cells c
 LEFT JOIN (SELECT * FROM way_seg WHERE highway IN {GR.STREET}) s ON s.city = c.city AND {d2('c', 's')} <= 250000.0 GROUP BY 1, 2"""))
def lit_share(spark, d):
    seg = way_segments(spark, d, F.col("highway").isin(*GR.STREET), "lit")
    lit = F.col("t_lit").isin("yes", "24/7", "automatic", "limited")
    share = F.try_divide(F.sum(F.when(lit, F.col("t_length")).otherwise(F.when(F.col("t_length").isNotNull(), 0.0))), F.sum("t_length")) * 100.0
    out = SP.within_radius(cells(spark, d), seg.select("city", "x", "y", "length", "lit"), 500.0, ["city", "cell_id"], [share.alias("lit_share")], ["city"])
    return out.withColumn("lit_share", F.round("lit_share", 4))


@query("A17_intersection_density", q(f"""SELECT c.city, c.cell_id, round(count(v.node) / {math.pi * 0.25}, 4) AS density FROM cells c LEFT JOIN (SELECT city, {KEY.format('x', 'y')} AS node, min(x) AS x, min(y) AS y FROM way_pts
 WHERE highway IN {GR.STREET} GROUP BY 1, 2 HAVING sum(CASE WHEN i = 1 THEN 2 ELSE 1 END) >= 3) v ON v.city = c.city AND {d2('c', 'v')} <= 250700.0 GROUP BY 1, 2"""))
def intersection_density(spark, d):
    v = SP.intersections(ways(spark, d).where(F.col("highway").isin(*GR.STREET)), ["city"])
    n = SP.count_within(cells(spark, d), v.select("city", "x", "y"), math.sqrt(250700.0), ["city", "cell_id"], ["city"])
    return n.select("city", "cell_id", F.round(F.col("n") / (math.pi * 0.25), 4).alias("density"))


@query("G13_cycleway_length", q(f"""SELECT c.city, c.cell_id, round(coalesce(sum(s.length), 0) / 1000.0, 4) AS km FROM cells c LEFT JOIN (SELECT * FROM way_seg WHERE highway = 'cycleway' OR cycleway IN ('lane', 'track')
 OR (highway IN ('path', 'footway', 'track') AND bicycle = 'designated')) s ON s.city = c.city AND {d2('c', 's')} <= 1000000.0 GROUP BY 1, 2"""))
def cycleway_length(spark, d):
    seg = way_segments(spark, d, GR.bike_path())
    out = SP.sum_within(cells(spark, d), seg.select("city", "x", "y", "length"), "length", 1000.0, ["city", "cell_id"], ["city"])
    return out.select("city", "cell_id", F.round(F.col("total") / 1000.0, 4).alias("km"))


@query("G08_near_feature_points", q(f"""SELECT city, line_id, i, k, kind FROM (SELECT city, line_id, i, k, 'pedestrian' AS kind FROM way_seg WHERE highway = 'pedestrian'
 UNION ALL SELECT DISTINCT s.city, s.line_id, s.i, s.k, 'waterside' FROM way_seg s JOIN wet w ON w.city = s.city AND {d2('s', 'w')} <= 3600.0 WHERE s.highway IN ('footway', 'path', 'cycleway', 'pedestrian'))""",
    wet="""SELECT city, x1 + (x2 - x1) * k / n AS x, y1 + (y2 - y1) * k / n AS y FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM (
 SELECT *, greatest(CAST(ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 30.3) AS INTEGER), 1) AS n FROM poly_e))"""))
def near_feature_points(spark, d):
    ped = way_segments(spark, d, F.col("highway") == "pedestrian").select("city", "line_id", "i", "k").withColumn("kind", F.lit("pedestrian"))
    mid = way_segments(spark, d, F.col("highway").isin("footway", "path", "cycleway", "pedestrian"))
    bank = SP.densify(poly_edges(spark, d), ["city", "dest"], 30.3).select("city", "x", "y")
    near = SP.radius_join(mid.select("city", "line_id", "i", "k", "x", "y"), bank, 60.0, ["city"]).select("city", "line_id", "i", "k").distinct()
    return ped.unionByName(near.withColumn("kind", F.lit("waterside")))


@query("G02_graph_from_lines", q("SELECT city, u, v, round(len, 6) AS len FROM walk_e"))
def graph_from_lines(spark, d):
    return street_graph(spark, d)[1].withColumn("len", F.round("len", 6))


COMP = {"comp": """SELECT city, node, min(label) AS comp FROM (WITH RECURSIVE reach(city, node, label) AS (SELECT DISTINCT city, u, u FROM walk_e UNION SELECT e.city, e.v, r.label FROM reach r
 JOIN walk_e e ON e.city = r.city AND e.u = r.node WHERE r.label < e.v) SELECT * FROM reach) GROUP BY 1, 2""",
        "big": "SELECT city, arg_min(comp, (-n, comp)) AS comp FROM (SELECT city, comp, count(*) AS n FROM comp GROUP BY 1, 2) GROUP BY 1",
        "main_node": "SELECT c.city, c.node FROM comp c JOIN big b ON b.city = c.city AND b.comp = c.comp"}


@query("G03_largest_component", q("SELECT city, node FROM main_node", **COMP))
def largest_component(spark, d):
    n, e = street_graph(spark, d)
    return GR.largest_component(n, GR.components(n, e, ["city"]), ["city"]).select("city", "node")


def main_graph(spark, d):
    from ..session import stored

    def build_nodes():
        n, e = street_graph(spark, d)
        return GR.largest_component(n, GR.components(n, e, ["city"]), ["city"])
    n = stored(spark, d, "street_nodes", build_nodes)
    e = stored(spark, d, "street_edges", lambda: street_graph(spark, d)[1])
    e = e.join(n.select("city", F.col("node").alias("u")), ["city", "u"], "left_semi")
    return n, e


MAIN = {"main_xy": f"""SELECT m.city, m.node, p.x, p.y FROM main_node m JOIN (SELECT city, {KEY.format('x', 'y')} AS node, min({{'x': x, 'y': y}}).x AS x, min({{'x': x, 'y': y}}).y AS y FROM way_pts GROUP BY 1, 2) p
 ON p.city = m.city AND p.node = m.node""",
        "snap_poi": f"""SELECT * FROM (SELECT p.city, p.poi_id, p.category, n.node, sqrt({d2('p', 'n')}) AS snap, row_number() OVER (PARTITION BY p.poi_id ORDER BY round(sqrt({d2('p', 'n')}), 6), n.node) AS rn FROM pois p JOIN main_xy n ON n.city = p.city) WHERE rn = 1""",
        "snap_cell": f"""SELECT * FROM (SELECT p.city, p.cell_id, n.node, sqrt({d2('p', 'n')}) AS snap, row_number() OVER (PARTITION BY p.cell_id ORDER BY round(sqrt({d2('p', 'n')}), 6), n.node) AS rn FROM cells p JOIN main_xy n ON n.city = p.city) WHERE rn = 1"""}


@query("G04_snap_to_graph", q("SELECT city, poi_id, round(snap, 3) AS snap FROM snap_poi", **COMP, **MAIN))
def snap_to_graph(spark, d):
    n, _ = main_graph(spark, d)
    return GR.snap(B.points(spark, d), n, ["city", "poi_id"], ["city"]).select("city", "poi_id", F.round("snap", 3).alias("snap"))


PATHS = {"walked": """SELECT * FROM (WITH RECURSIVE sp(city, cat, node, dist) USING KEY (city, cat, node) AS (SELECT city, category, node, min(snap) + 1e-3 FROM snap_poi WHERE snap + 1e-3 <= 4800 GROUP BY 1, 2, 3
 UNION SELECT e.city, s.cat, e.v, min(s.dist + e.len) FROM sp s JOIN main_e e ON e.city = s.city AND e.u = s.node LEFT JOIN recurring.sp k ON k.city = s.city AND k.cat = s.cat AND k.node = e.v
 WHERE s.dist + e.len <= 4800 AND (k.dist IS NULL OR s.dist + e.len < k.dist - 1e-9) GROUP BY 1, 2, 3) SELECT * FROM sp)""",
         "main_e": "SELECT e.* FROM walk_e e JOIN main_node n ON n.city = e.city AND n.node = e.u",
         "walk_min": """SELECT c.city, c.cell_id, k.category AS cat, least(coalesce((w.dist + c.snap) / 80.0, 60.0), 60.0) AS minutes FROM snap_cell c JOIN (SELECT DISTINCT city, category FROM pois) k ON k.city = c.city
 LEFT JOIN walked w ON w.city = c.city AND w.cat = k.category AND w.node = c.node"""}


def poi_minutes(spark, d):
    from ..session import stored
    n, e = main_graph(spark, d)
    t = B.points(spark, d).select("city", F.col("category").alias("cat"), F.col("poi_id").alias("target_id"), "x", "y")
    return stored(spark, d, "poi_minutes", lambda: GR.minutes_to_nearest(cells(spark, d), t, n, e, ["city", "cell_id"], ["city"]))


@query("G05_multi_source_shortest_path", q("SELECT city, cell_id, cat, round(minutes, 4) AS minutes FROM walk_min", **COMP, **MAIN, **PATHS))
def multi_source_shortest_path(spark, d):
    return poi_minutes(spark, d).withColumn("minutes", F.round("minutes", 4))


SETS = {c: s for c, s in GR.WALK_SETS.items() if set(s) & set(B.POI_CATEGORIES)}


@query("G06_walk_minutes_by_category", q("""SELECT w.city, w.cell_id, s.col AS "column", round_even(round(min(w.minutes), 9), 1) AS minutes FROM walk_min w JOIN (VALUES """
       + ", ".join(f"('{c}', '{x}')" for c, cs in GR.WALK_SETS.items() for x in cs) + """) AS s(col, cat) ON s.cat = w.cat GROUP BY 1, 2, 3""", **COMP, **MAIN, **PATHS))
def walk_minutes_by_category(spark, d):
    return GR.walk_minutes(poi_minutes(spark, d), ["city", "cell_id"])


# ------------------------------------------------------------------ terrain
cte("dem", "SELECT c.city, c.q AS ix, c.r AS iy, p.p_retailprice / 10.0 AS value FROM cells c JOIN part p ON p.p_partkey = c.cell_id")
SM = [(dx, dy, math.exp(-(dx * dx + dy * dy) / 8.0)) for dx in range(-8, 9) for dy in range(-8, 9)]


@query("G12_terrain_slope", q(f"""SELECT c.city, c.cell_id, round(avg(p.slope), 4) AS value FROM cells c CROSS JOIN (VALUES {disk_values(180.0, 30.0)}) AS o(dx, dy) JOIN sloped p ON p.city = c.city AND p.ix = c.q + o.dx AND p.iy = c.r + o.dy GROUP BY 1, 2""",
    smoothed=f"""SELECT a.city, a.ix, a.iy, sum(b.value * o.w) / sum(o.w) AS z FROM dem a CROSS JOIN (VALUES {', '.join(f'({a}, {b}, CAST({w!r} AS DOUBLE))' for a, b, w in SM)}) AS o(dx, dy, w)
 JOIN dem b ON b.city = a.city AND b.ix = a.ix + o.dx AND b.iy = a.iy + o.dy GROUP BY 1, 2, 3""",
    sloped="""SELECT c.city, c.ix, c.iy, 100.0 * sqrt(pow(CASE WHEN e.z IS NOT NULL AND w.z IS NOT NULL THEN (e.z - w.z) / 60.0 WHEN e.z IS NOT NULL THEN (e.z - c.z) / 30.0 WHEN w.z IS NOT NULL THEN (c.z - w.z) / 30.0 ELSE 0 END, 2)
 + pow(CASE WHEN n.z IS NOT NULL AND s.z IS NOT NULL THEN (n.z - s.z) / 60.0 WHEN n.z IS NOT NULL THEN (n.z - c.z) / 30.0 WHEN s.z IS NOT NULL THEN (c.z - s.z) / 30.0 ELSE 0 END, 2)) AS slope FROM smoothed c
 LEFT JOIN smoothed e ON e.city = c.city AND e.ix = c.ix + 1 AND e.iy = c.iy LEFT JOIN smoothed w ON w.city = c.city AND w.ix = c.ix - 1 AND w.iy = c.iy
 LEFT JOIN smoothed n ON n.city = c.city AND n.ix = c.ix AND n.iy = c.iy + 1 LEFT JOIN smoothed s ON s.city = c.city AND s.ix = c.ix AND s.iy = c.iy - 1"""))
def terrain_slope(spark, d):
    c = cells(spark, d)
    dem = c.join(B.table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), (F.col("p_retailprice") / 10.0).alias("value")), "cell_id") \
        .select("city", F.col("q").alias("ix"), F.col("r").alias("iy"), "value")
    at = c.selectExpr("city", "cell_id", "(q + 0.5D) * 30 AS x", "(r + 0.5D) * 30 AS y")
    out = RA.terrain_slope(at, dem, 30.0, ["city", "cell_id"], ["city"])
    return out.withColumn("value", F.round("value", 4))
