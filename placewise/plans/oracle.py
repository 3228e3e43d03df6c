"""ANSI SQL twins of the bindings and of the long scoring chain, as named common table expressions.

``q(text)`` puts the needed CTEs in front of a statement.  The chain is written the long way round (one row per
request, cell and indicator), independently of the wide form the library uses."""
from __future__ import annotations

import re

from ..config import (COMMUTE_BAD, COMMUTE_GOOD, CRITERIA, LEVEL_WEIGHT, MUST_HAVE, PERSONAS, PLAUSIBLE, PRICE,
                      UNREACHABLE)
from .bindings import BOUND, DX, DY, LAT0, LON0, M_LAT, M_LON, POI_CATEGORIES, REQUESTS, SPECS, _v, pick

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def values(name: str, cols: str, rows: list[tuple]) -> None:
    body = ", ".join("(" + ", ".join(_v(c) for c in r) + ")" for r in rows)
    CTES[name] = f"SELECT * FROM (VALUES {body}) AS t({cols})"


def q(text: str, **extra: str) -> str:
    """Statement with the CTEs it (transitively) names; ``extra`` adds query-local CTEs."""
    pool = {**CTES, **extra}
    order: list[str] = []

    def visit(body: str) -> None:
        for n in dict.fromkeys(re.findall(r"\b[a-z_][a-z_0-9]*\b", body)):
            if n in pool and n not in order and n not in stack:
                stack.append(n)
                visit(pool[n])
                stack.pop()
                order.append(n)
    stack: list[str] = []
    visit(text)
    if not order:
        return text
    return "WITH " + ",\n".join(f"{n} AS ({pool[n]})" for n in order) + "\n" + text


def dbl(expr: str) -> str:
    return re.sub(r"(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", expr)


def half_even(x: str, digits: int = 0) -> str:
    return f"round_even(round({x}, 9), {digits})"


def pos(q_: str, r_: str, x: str = "0.0", y: str = "0.0") -> str:
    fx = f"CAST({DX} AS DOUBLE) * (({q_}) + ({r_}) / CAST(2.0 AS DOUBLE)) + {x}"
    fy = f"CAST({DY} AS DOUBLE) * ({r_}) + {y}"
    return f"({q_}) AS q, ({r_}) AS r, {fx} AS x, {fy} AS y"


LATLON = (f"CAST({LAT0} AS DOUBLE) + y / CAST({M_LAT} AS DOUBLE) AS lat, (CASE city WHEN 'praha' THEN "
          f"CAST({LON0['praha']} AS DOUBLE) ELSE CAST({LON0['krakow']} AS DOUBLE) END) + x / CAST({M_LON} AS DOUBLE) AS lon")
CITY = "CASE WHEN {0} % 2 = 0 THEN 'praha' ELSE 'krakow' END"

cte("cells0", f"SELECT {CITY.format('p_partkey')} AS city, p_partkey AS cell_id, "
    f"{pos('(p_partkey // 2) % 64', '(p_partkey // 2) // 64')}, p_size, p_brand, p_type FROM part")
cte("cells", f"""SELECT city, cell_id, q, r, x, y, {LATLON}, p_size >= 3 AS habitable, p_brand AS district_id,
 'District ' || p_brand AS district_name, CASE WHEN p_size % 11 = 0 THEN '' ELSE p_brand || '/' || p_type END AS neighborhood,
 p_size AS population_est FROM cells0""")
cte("aggs", """SELECT l_partkey AS cell_id, count(*) AS cnt, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sq,
 min(l_quantity) AS mnq, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS sd,
 CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS st,
 CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sp, count(DISTINCT l_suppkey) AS ns,
 count(*) FILTER (WHERE l_returnflag = 'R') AS nr, count(*) FILTER (WHERE l_returnflag = 'A') AS na,
 count(*) FILTER (WHERE l_linestatus = 'F') AS nf FROM lineitem GROUP BY l_partkey""")
cte("feats", "SELECT cell_id, " + ", ".join(f'{dbl(e)} AS "{c}"' for c, e in BOUND.items()) + " FROM aggs")
values("spec", "j, ikey, criterion, col, unit, norm, good, bad, base_w, ws, nowarn, decimals, only_city, is_alias",
       [(j, s.key, s.criterion, s.column, s.unit, s.norm, s.good, s.bad, s.weight, s.walk_scaled, s.no_warning,
         s.decimals, s.city, s.is_alias) for j, s in enumerate(SPECS)])
values("plaus", "unit, lo, hi", [(u, lo, hi) for u, (lo, hi) in PLAUSIBLE.items()])
values("crits", "i, criterion", list(enumerate(CRITERIA)))
cte("raw0", "SELECT c.city, c.cell_id, c.habitable, s.*, CASE s.col " +
    " ".join(f"WHEN '{c}' THEN f.\"{c}\"" for c in BOUND) +
    " END AS v0 FROM cells c LEFT JOIN feats f USING (cell_id) CROSS JOIN spec s")
cte("raw_long", """SELECT r.* EXCLUDE (v0), CASE WHEN only_city IS NOT NULL AND only_city <> city THEN NULL
 WHEN NOT is_alias AND p.lo IS NOT NULL AND NOT (v0 BETWEEN p.lo AND p.hi) THEN NULL ELSE v0 END AS v
 FROM raw0 r LEFT JOIN plaus p ON p.unit = r.unit""")
cte("stats", """SELECT city, j, median(v) AS med, avg(CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END) AS coverage,
 count(v) AS n_values FROM raw_long WHERE habitable GROUP BY city, j""")
cte("filled", """SELECT r.*, coalesce(r.v, s.med) AS f, r.v IS NULL AS imputed, s.med, s.coverage
 FROM raw_long r JOIN stats s USING (city, j)""")
cte("ranked", """SELECT *, CASE WHEN norm IN ('percentile', 'inverse_percentile') AND f IS NOT NULL THEN
 (le + (le - eq)) / 2.0 / n * 100.0 END AS pr FROM (SELECT *,
 sum(CASE WHEN habitable THEN 1 ELSE 0 END) OVER (PARTITION BY city, j ORDER BY f RANGE UNBOUNDED PRECEDING) AS le,
 sum(CASE WHEN habitable THEN 1 ELSE 0 END) OVER (PARTITION BY city, j, f) AS eq,
 sum(CASE WHEN habitable THEN 1 ELSE 0 END) OVER (PARTITION BY city, j) AS n FROM filled)""")

values("persona", "persona, walk_factor", [(p.id, p.walk_factor) for p in PERSONAS])
values("persona_level", "persona, criterion, level", [(p.id, c, lv) for p in PERSONAS for c, lv in p.levels.items()])
values("persona_weight", "persona, ikey, w", [(p.id, k, float(w)) for p in PERSONAS for k, w in p.weights.items()])
values("level_weight", "level, lw", [(k, float(v)) for k, v in LEVEL_WEIGHT.items()])
values("req", "request_id, city, persona, max_price, max_noise, max_commute, budget, agg_level, lim, rank_by, district",
       [(r["request_id"], r["city"], r.get("persona"), r.get("maxPrice"), r.get("maxNoise"), r.get("maxCommute"),
         r.get("budget"), r.get("aggregate", "hex"), r.get("limit", 20), r.get("rankBy"), r.get("district"))
        for r in REQUESTS])
values("req_level", "request_id, criterion, level",
       [(r["request_id"], c, lv) for r in REQUESTS for c, lv in r.get("weights", {}).items()])
values("req_weight", "request_id, ikey, w",
       [(r["request_id"], k, float(w)) for r in REQUESTS for k, w in r.get("indicatorWeights", {}).items()])
values("req_must", "request_id, pos, category, max_min",
       [(r["request_id"], p, c, float(m)) for r in REQUESTS for p, (c, m) in enumerate(r.get("must", []))])
values("req_anchor", "request_id, pos, aid, dest, mode, level, lim, label",
       [(r["request_id"], p, a["id"], a["dest"], a["mode"], a["level"], a["maxMinutes"], a["label"])
        for r in REQUESTS for p, a in enumerate(r.get("anchors", []))])
values("must_have", "category, col, only_city", [(k, c, o) for k, (c, o) in MUST_HAVE.items()])
values("price_col", "city, pcol", [(c, v[0]) for c, v in PRICE.items()])

cte("travel", f"""SELECT {CITY.format('l_partkey')} AS city, CASE l_returnflag WHEN 'A' THEN 'transit' WHEN 'N' THEN 'bike'
 ELSE 'walk' END AS mode, l_partkey AS origin, l_suppkey AS dest, min(CAST(l_quantity AS INTEGER)) AS minutes
 FROM lineitem GROUP BY 1, 2, 3, 4""")
cte("dests0", "SELECT city, s_suppkey AS dest, s_name AS name, s_acctbal AS value, s_nationkey AS nation, "
    + pos("(s_suppkey * 13) % 64", "s_suppkey // 6") +
    " FROM supplier CROSS JOIN (VALUES ('krakow'), ('praha')) AS t(city)")
cte("dests", f"SELECT *, {LATLON} FROM dests0")
cte("pois0", f"SELECT {CITY.format('c_custkey')} AS city, c_custkey AS poi_id, " + pick(POI_CATEGORIES, "c_nationkey") + " AS category, "
    "c_name AS name, c_acctbal AS value, c_nationkey AS nation, " +
    pos("(c_custkey // 2) % 64", "((c_custkey // 2) // 64) * 4 // 3", "(c_custkey * 37) % 300 - CAST(150.0 AS DOUBLE)",
        "(c_custkey * 53) % 260 * CAST(1.0 AS DOUBLE)") + " FROM customer")
cte("pois", f"SELECT *, {LATLON} FROM pois0")

cte("weights", """SELECT r.request_id, r.city, s.j, s.ikey, s.criterion,
 CASE WHEN st.coverage > 0 THEN greatest(coalesce(rw.w, pw.w, s.base_w), 0.0) ELSE 0.0 END AS w
 FROM req r CROSS JOIN spec s JOIN stats st ON st.city = r.city AND st.j = s.j
 LEFT JOIN req_weight rw ON rw.request_id = r.request_id AND rw.ikey = s.ikey
 LEFT JOIN persona_weight pw ON pw.persona = coalesce(r.persona, 'custom') AND pw.ikey = s.ikey""")
cte("usable_anchor", """SELECT a.request_id, r.city, a.pos, a.aid, a.dest, a.mode, a.label, lw.lw AS aw,
 coalesce(a.lim, r.max_commute) AS lim FROM req_anchor a JOIN req r USING (request_id)
 JOIN level_weight lw ON lw.level = a.level
 WHERE EXISTS (SELECT 1 FROM travel t WHERE t.city = r.city AND t.mode = a.mode)
 AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = a.dest)""")
cte("cell_anchor", """SELECT a.request_id, a.city, c.cell_id, c.habitable, a.pos, a.aid, a.aw, a.lim, t.minutes
 FROM usable_anchor a JOIN cells c ON c.city = a.city
 LEFT JOIN travel t ON t.city = a.city AND t.mode = a.mode AND t.dest = a.dest AND t.origin = c.cell_id""")
cte("sub", """SELECT w.request_id, k.city, k.cell_id, k.habitable, k.j, k.ikey, k.criterion, w.w, k.v, k.f, k.imputed, k.med,
 CASE WHEN k.norm = 'decay' THEN coalesce(least(greatest((k.f * CASE WHEN k.ws THEN p.walk_factor ELSE 1.0 END - k.bad)
   / (k.good - k.bad) * 100.0, 0.0), 100.0), 0.0)
   WHEN k.norm = 'percentile' THEN coalesce(k.pr, 0.0) ELSE coalesce(100.0 - k.pr, 0.0) END AS s
 FROM ranked k JOIN weights w ON w.city = k.city AND w.j = k.j JOIN req r ON r.request_id = w.request_id
 JOIN persona p ON p.persona = coalesce(r.persona, 'custom')""")
cte("crit", f"""SELECT request_id, city, cell_id, habitable, criterion, sum(w * s) / sum(w) AS sc FROM sub
 GROUP BY request_id, city, cell_id, habitable, criterion HAVING sum(w) > 0
 UNION ALL SELECT request_id, city, cell_id, habitable, 'commute', sum(aw * least(greatest(
 (coalesce(minutes, {UNREACHABLE}) - {COMMUTE_BAD}) / ({COMMUTE_GOOD} - {COMMUTE_BAD}) * 100.0, 0.0), 100.0)) / sum(aw)
 FROM cell_anchor GROUP BY request_id, city, cell_id, habitable""")
cte("has_crit", "SELECT DISTINCT request_id, criterion FROM crit")
cte("levels", """SELECT r.request_id, c.i, c.criterion, greatest(least(coalesce(l.level, CASE WHEN r.persona IS NOT NULL
 THEN pl.level END, 0), 5), 0) AS level FROM req r CROSS JOIN crits c
 LEFT JOIN req_level l ON l.request_id = r.request_id AND l.criterion = c.criterion
 LEFT JOIN persona_level pl ON pl.persona = r.persona AND pl.criterion = c.criterion""")
cte("cw0", """SELECT l.request_id, l.i, l.criterion, l.level, h.criterion IS NOT NULL AS has,
 CASE WHEN l.level > 0 AND h.criterion IS NOT NULL THEN lw.lw ELSE 0.0 END AS w0
 FROM levels l JOIN level_weight lw USING (level) LEFT JOIN has_crit h
 ON h.request_id = l.request_id AND h.criterion = l.criterion""")
cte("cw", """SELECT *, CASE WHEN sum(w0) OVER (PARTITION BY request_id) > 0 THEN w0 WHEN has THEN 1.0 ELSE 0.0 END AS cw
 FROM cw0""")
cte("mf", """SELECT c.request_id, c.city, c.cell_id, c.habitable, sum(k.cw * c.sc) / sum(k.cw) AS mf
 FROM crit c JOIN cw k ON k.request_id = c.request_id AND k.criterion = c.criterion GROUP BY 1, 2, 3, 4""")
cte("mask", """SELECT r.request_id, f.city, f.cell_id, f.habitable, 'price' AS fkey, 1 AS ord, f.f <= r.max_price AS ok
 FROM req r JOIN price_col p USING (city) JOIN filled f ON f.city = r.city AND f.ikey = p.pcol
 WHERE r.max_price IS NOT NULL AND f.coverage > 0
 UNION ALL SELECT r.request_id, f.city, f.cell_id, f.habitable, 'noise', 2, f.f <= r.max_noise
 FROM req r JOIN filled f ON f.city = r.city AND f.ikey = 'environment.noise_db'
 WHERE r.max_noise IS NOT NULL AND f.coverage > 0
 UNION ALL SELECT r.request_id, f.city, f.cell_id, f.habitable, 'mustHave:' || m.category, 3 + m.pos,
 coalesce(f.v <= m.max_min, FALSE) FROM req_must m JOIN req r USING (request_id) JOIN must_have h USING (category)
 JOIN filled f ON f.city = r.city AND f.ikey = h.col
 WHERE f.coverage > 0 AND (h.only_city IS NULL OR h.only_city = r.city)
 UNION ALL SELECT request_id, city, cell_id, habitable, 'commute:' || aid, 10 + pos, coalesce(minutes <= lim, FALSE)
 FROM cell_anchor WHERE lim > 0""")
cte("pass", """SELECT m.*, m.habitable AND coalesce(k.ok, TRUE) AS passing, round(m.mf, 9) AS m9, c.district_id, c.district_name,
 c.population_est, c.lat, c.lon, coalesce(nullif(c.neighborhood, ''), c.district_name) AS place
 FROM mf m JOIN cells c USING (city, cell_id) LEFT JOIN (SELECT request_id, cell_id, bool_and(ok) AS ok FROM mask
 GROUP BY 1, 2) k ON k.request_id = m.request_id AND k.cell_id = m.cell_id""")
cte("lensed", f"""SELECT *, round(lens, 9) AS l9 FROM (SELECT p.*, CASE WHEN c.sc IS NOT NULL THEN c.sc WHEN a.aid IS NOT NULL THEN
 -coalesce(a.minutes, {UNREACHABLE}) ELSE p.mf END AS lens FROM pass p JOIN req r USING (request_id)
 LEFT JOIN crit c ON c.request_id = p.request_id AND c.cell_id = p.cell_id AND c.criterion = r.rank_by
 LEFT JOIN cell_anchor a ON a.request_id = p.request_id AND a.cell_id = p.cell_id AND 'anchor:' || a.aid = r.rank_by)""")
cte("top_cells", """SELECT request_id, city, cell_id, rank, lens, mf FROM (SELECT t.*, row_number() OVER (PARTITION BY t.request_id
 ORDER BY t.l9 DESC, t.m9 DESC, t.cell_id) AS rank, r.lim FROM (SELECT *, row_number() OVER (PARTITION BY request_id, place
 ORDER BY l9 DESC, m9 DESC, cell_id) AS one FROM lensed l WHERE passing AND EXISTS (SELECT 1 FROM req x WHERE
 x.request_id = l.request_id AND (x.district IS NULL OR x.district = l.district_id))) t JOIN req r USING (request_id)
 WHERE one = 1) WHERE rank <= lim""")
cte("crit_median", """SELECT request_id, criterion, median(sc) AS med FROM crit WHERE habitable GROUP BY 1, 2""")
