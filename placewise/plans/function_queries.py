"""Registered queries: scalar functions, classes, small aggregates."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CITIES, CRITERIA, LANGS
from ..functions import geo, text as T
from ..functions.norm import half_even as he
from ..operators import classes as CL, groups as G, ranking as R, registers as RG, requests as RQ, scoring as S
from ..operators.live import air_level, local_to_utc
from . import bindings as B
from .oracle import half_even, q
from .registry import query
from .relational_queries import KEYS, filled_long, rnd
from .scoring_queries import crit_column, display_sql, fmt_sql, prepared, scores

STRIP = "strip_accents(translate(replace(lower({0}), 'ß', 'ss'), 'łđø', 'ldo'))"
FOLD = "trim(regexp_replace(regexp_replace(" + STRIP + ", '[-–,./()\"''„”]', ' ', 'g'), '\\s+', ' ', 'g'))"
KEEP = "trim(regexp_replace(regexp_replace(" + STRIP + r", '[^\p{{L}}\p{{N}}_\s/.-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("F01_fold_search", f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents")
def fold_search(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query("F02_fold_keep_slash", f"SELECT doc_id, md5({KEEP.format('text')}) AS folded FROM documents")
def fold_keep_slash(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.md5(T.fold_keep_slash(F.col("text"))).alias("folded"))


STREETS = ("ul. Rakowicka", "al. Pokoju", "os. Słoneczne", "pl. gen. Maczka", "Žižkovo náměstí", "ul. św. Jana", "Łobzowska",
           "aleja ks. prof. Tischnera", "Dlouhá třída", "Zabłocie")
ADDR = [B.pick(STREETS, "c_nationkey") + " AS street",
        "concat(c_custkey % 60 + 1, CASE WHEN c_custkey % 7 = 0 THEN '/12' WHEN c_custkey % 11 = 0 THEN ' A' ELSE '' END) AS number"]
STREET_SQL = (r"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(" + STRIP
              + r", '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '{p}', ''), '{p}', ''), '{p}', '')"
              ).replace("{p}", T.STREET_PREFIX)
NUM_SQL = "split_part(regexp_replace(lower({0}), '\\s+', '', 'g'), '/', 1)"


@query("F03_street_norm", f"SELECT c_custkey, {STREET_SQL.format('street')} AS street, {NUM_SQL.format('number')} AS number FROM "
       f"(SELECT c_custkey, {', '.join(ADDR)} FROM customer)")
def street_norm(spark, d):
    a = B.table(spark, d, "customer").selectExpr("c_custkey", *ADDR)
    return a.select("c_custkey", T.street_norm(F.col("street")).alias("street"), T.house_number(F.col("number")).alias("number"))


@query("F04_alnum_key", f"SELECT doc_id, md5(regexp_replace({STRIP.format('text')}, '[^a-z0-9]', '', 'g')) AS k FROM documents")
def alnum_key(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.md5(T.alnum_key(F.col("text"))).alias("k"))


PARTS = ["c_custkey", B.pick(("Nerudova", "", "Husova"), "c_nationkey") + " AS street", "c_mktsegment AS place",
         "cast(c_custkey % 900 AS string) AS cp", "CASE WHEN c_custkey % 3 = 0 THEN cast(c_custkey % 70 AS string) ELSE '' END AS co",
         B.pick(("", "a", ""), "c_custkey") + " AS mark", B.pick(("č.p.", "č.ev."), "c_nationkey") + " AS kind",
         "cast(11000 + c_custkey % 900 AS string) AS zip"]


@query("F05_address_parts", f"""SELECT c_custkey, CASE WHEN street <> '' THEN street ELSE place END AS street, CASE WHEN co || CASE WHEN co <> '' THEN mark ELSE mark END <> ''
 THEN cp || '/' || co || mark WHEN kind = 'č.ev.' THEN 'ev. ' || cp ELSE cp END AS number, substr(zip, 1, 3) || ' ' || substr(zip, 4) AS postcode
 FROM (SELECT {', '.join(PARTS).replace('string', 'varchar')} FROM customer)""")
def address_parts(spark, d):
    a = B.table(spark, d, "customer").selectExpr(*PARTS)
    st, num, zip_ = T.address_parts(*[F.col(c) for c in ("street", "place", "cp", "co", "mark", "kind", "zip")])
    return a.select("c_custkey", st.alias("street"), num.alias("number"), zip_.alias("postcode"))


SPLIT = ["c_custkey", "concat(" + B.pick(("Dlouhá", "Na Příkopě", "U Lesa"), "c_nationkey") + ", ' ', c_custkey % 900, "
         + B.pick(("/12a", "", "/7", " bis"), "c_custkey") + ", ', Praha 1') AS addr"]


@query("F06_address_regex_split", f"""SELECT c_custkey, nullif(regexp_extract(a, p, 1), '') AS street, nullif(regexp_extract(a, p, 2), '') AS cp,
 nullif(regexp_extract(a, p, 3), '') AS co FROM (SELECT c_custkey, trim(split_part(addr, ',', 1)) AS a, '^(.*?)\\s+(\\d+)(?:/(\\d+)\\w*)?$' AS p
 FROM (SELECT {', '.join(SPLIT)} FROM customer))""")
def address_regex_split(spark, d):
    st, cp, co = RG.split_address(F.col("addr"))
    return B.table(spark, d, "customer").selectExpr(*SPLIT).select("c_custkey", st.alias("street"), cp.alias("cp"), co.alias("co"))


WKT = "CASE WHEN c_custkey % 10 = 3 THEN 'n/a' ELSE concat('POINT( ', c_custkey % 90, '.25 ', c_nationkey, '.5)') END"


@query("F07_wkt_point_extract", """SELECT c_custkey, CASE WHEN c_custkey % 10 <> 3 THEN c_custkey % 90 + 0.25 END AS lat,
 CASE WHEN c_custkey % 10 <> 3 THEN c_nationkey + 0.5 END AS lon FROM customer""")
def wkt_point_extract(spark, d):
    lat, lon = T.wkt_point(F.expr(WKT))
    return B.table(spark, d, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"))


@query("F08_render_template", "SELECT c_custkey, c_name || ' has ' || CAST(c_nationkey AS VARCHAR) || ' in ' || c_mktsegment || ', ' || c_name AS text FROM customer")
def render_template(spark, d):
    tpl = F.lit("{{name}} has {{n}} in {{seg}}, {{name}}")
    return B.table(spark, d, "customer").select("c_custkey", T.render(
        tpl, name=F.col("c_name"), n=F.col("c_nationkey"), seg=F.col("c_mktsegment")).alias("text"))


LANG_SQL = "CROSS JOIN (VALUES ('pl'), ('cs'), ('en'), ('ko')) AS l(lang)"


@query("F09_fmt_number_locale", f"""SELECT o_orderkey, lang, {fmt_sql('v', 'lang', '0')} AS whole, {fmt_sql('v', 'lang', '1')} AS tenth
 FROM (SELECT o_orderkey, o_totalprice / 17.0 - 900.0 AS v FROM orders) {LANG_SQL}""")
def fmt_number_locale(spark, d):
    v = F.col("o_totalprice") / 17.0 - 900.0
    o = B.table(spark, d, "orders").select("o_orderkey", v.alias("v"), F.explode(F.array(*map(F.lit, ("pl", "cs", "en", "ko")))).alias("lang"))
    return o.select("o_orderkey", "lang", T.fmt_number(F.col("v"), F.col("lang"), F.lit(0)).alias("whole"),
                    T.fmt_number(F.col("v"), F.col("lang"), F.lit(1)).alias("tenth"))


@query("F10_display_value", f"""SELECT v, unit, lang, {display_sql('v', 'unit', 'lang', '1')} AS text, n FROM (SELECT l_quantity / 20.0 AS v,
 CASE WHEN l_returnflag = 'R' THEN 'min' ELSE 'm' END AS unit, count(*) AS n FROM lineitem GROUP BY 1, 2), (SELECT unnest(['pl', 'cs', 'en', 'ko']) AS lang)""")
def display_value(spark, d):
    li = B.table(spark, d, "lineitem").selectExpr("l_quantity / 20.0D AS v", "CASE WHEN l_returnflag = 'R' THEN 'min' ELSE 'm' END AS unit")
    return (li.groupBy("v", "unit").agg(F.count("*").alias("n")).withColumn("lang", F.explode(F.array(*[F.lit(x) for x in LANGS])))
            .withColumn("text", T.display_value(F.col("v"), F.col("unit"), F.col("lang"), F.lit(1))))


@query("F13_local_to_utc", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 4 THEN strftime((o_orderdate + INTERVAL 90 MINUTE) AT TIME ZONE 'Europe/Warsaw'
 AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM orders""")
def local_to_utc_q(spark, d):
    s = F.expr("CASE WHEN o_orderkey % 10 = 4 THEN 'n/a' ELSE date_format(o_orderdate + INTERVAL 90 MINUTES, 'yyyy-MM-dd HH:mm:ss') END")
    return B.table(spark, d, "orders").select("o_orderkey", local_to_utc(s, "Europe/Warsaw").alias("utc"))


HAV = ("6371.0 * 2 * asin(sqrt(least(greatest(pow(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * "
       "pow(sin((radians({3}) - radians({1})) / 2), 2), 0.0), 1.0)))")


@query("F14_haversine_km", q(f"SELECT city, poi_id, round({HAV.format('lat', 'lon', '50.05', '14.4')}, 6) AS km FROM pois"))
def haversine_km(spark, d):
    return B.points(spark, d).select("city", "poi_id", F.round(geo.haversine_km(
        F.col("lat"), F.col("lon"), F.lit(50.05), F.lit(14.4)), 6).alias("km"))


@query("F15_project_metric", q("""SELECT city, poi_id, round((lon - 14.4) * 111320.0 * cos(radians(50.0)), 4) AS x, round((lat - 50.0) * 111320.0, 4) AS y FROM pois"""))
def project_metric(spark, d):
    x, y = geo.project(F.col("lat"), F.col("lon"), 50.0, 14.4)
    return B.points(spark, d).select("city", "poi_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def hex_sql(x, y, size):
    """Axial cell by cube rounding."""
    s3 = geo.SQRT3
    fq, fr = f"(({x}) * {s3} / 3.0 - ({y}) / 3.0) / {size}", f"(({y}) * 2.0 / 3.0) / {size}"
    return fq, fr


def hex_cte(src, size, cols):
    fq, fr = hex_sql("x", "y", size)
    return f"""SELECT {cols}, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS hq,
 CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS hr FROM (
 SELECT *, abs(rq - fq) AS dq, abs(rr - fr) AS dr, abs(rs - fs) AS ds FROM (SELECT *, floor(fq + 0.5) AS rq, floor(fr + 0.5) AS rr,
 floor(fs + 0.5) AS rs FROM (SELECT *, -fq - fr AS fs FROM (SELECT *, {fq} AS fq, {fr} AS fr FROM {src}))))"""


SIZE = 173.20508075688772


@query("F16_cell_of_point", q(hex_cte("pois", SIZE, "city, poi_id")))
def cell_of_point(spark, d):
    hq, hr = geo.hex_cell(F.col("x"), F.col("y"), SIZE)
    return B.points(spark, d).select("city", "poi_id", hq.alias("hq"), hr.alias("hr"))


@query("F17_cell_parent", q(hex_cte("cells", 800.0, "city, cell_id")))
def cell_parent(spark, d):
    hq, hr = geo.hex_cell(F.col("x"), F.col("y"), 800.0)
    return B.grid_cells(spark, d).select("city", "cell_id", hq.alias("hq"), hr.alias("hr"))


@query("F18_planar_distance_km", q("""SELECT city, cell_id, round(sqrt(pow((lat - 50.01) * 111.2, 2) + pow((lon - 14.3) * 111.2 * cos(radians(50.01)), 2)), 6) AS km FROM cells"""))
def planar_distance_km(spark, d):
    return B.grid_cells(spark, d).select("city", "cell_id", F.round(geo.planar_km(
        F.col("lat"), F.col("lon"), F.lit(50.01), F.lit(14.3)), 6).alias("km"))


@query("F19_axis_flip_validate", q("SELECT city, poi_id, round(-y, 6) AS x, round(-x, 6) AS y FROM pois"))
def axis_flip_validate(spark, d):
    known = F.abs(F.col("lat") - 50.0) < 90
    return geo.axis_flip(B.points(spark, d), "x", "y", known).select("city", "poi_id", *rnd("x", "y"))


STATE = ["o_orderkey", B.pick(("student", "senior", "expat"), "o_custkey") + " AS persona", "cast(o_orderkey % 130 AS int) AS lim",
         "cast(o_custkey % 7 AS int) AS lv", "cast(o_custkey % 200 AS int) AS mins", "o_totalprice - 100000.0 AS budget", "o_custkey % 110 - 5.0 AS lat"]


def states(spark, d):
    o = B.table(spark, d, "orders").selectExpr(*STATE)
    req = F.expr("""struct(persona AS persona, map('green', lv) AS weights, array(named_struct('id', 'work', 'lat', lat, 'lon', 19.9D,
        'mode', 'transit', 'level', lv, 'maxMinutes', mins)) AS anchors, struct(budget AS total) AS budget, 'hex' AS aggregate, lim AS limit)""")
    return o.select("o_orderkey", RQ.decode_state(RQ.encode_state(req)).alias("r"))


@query("F24_decode_request_state", f"""SELECT o_orderkey, persona, lim AS limit, lv AS green, round(lat, 4) AS lat FROM
 (SELECT {', '.join(STATE)} FROM orders)""")
def decode_request_state(spark, d):
    return states(spark, d).select("o_orderkey", "r.persona", "r.limit", F.col("r.weights")["green"].alias("green"),
                                   F.round(F.col("r.anchors")[0]["lat"], 4).alias("lat"))


@query("F25_validate_request", f"""SELECT o_orderkey, valid, errors FROM (SELECT *, errors = '' AS valid FROM (SELECT o_orderkey, concat_ws(',',
 CASE WHEN lat > 90 THEN 'anchor.lat' END, CASE WHEN lv NOT BETWEEN 1 AND 5 THEN 'anchor.level' END,
 CASE WHEN mins NOT BETWEEN 1 AND 120 THEN 'anchor.maxMinutes' END, CASE WHEN budget <= 0 THEN 'budget.total' END,
 CASE WHEN lim NOT BETWEEN 1 AND 100 THEN 'limit' END) AS errors FROM (SELECT {', '.join(STATE)} FROM orders)))""")
def validate_request(spark, d):
    r = states(spark, d).select("o_orderkey", "r.*")
    return RQ.validate(r).select("o_orderkey", "valid", F.array_join("errors", ",").alias("errors"))


@query("F29_air_index_map", """SELECT event_id, CASE WHEN event_id % 9 BETWEEN 1 AND 6 THEN event_id % 9 - 1
 ELSE CASE WHEN greatest(event_id % 7 - 1, user_id % 6 - 1) >= 0 THEN greatest(event_id % 7 - 1, user_id % 6 - 1) END END AS level FROM events""")
def air_index_map(spark, d):
    subs = F.expr("array(cast(event_id % 7 - 1 AS int), cast(user_id % 6 - 1 AS int))")
    return B.table(spark, d, "events").select("event_id", air_level(F.expr("cast(event_id % 9 AS int)"), subs).alias("level"))


# ------------------------------------------------------------------ classes and ranks
@query("W13_quantile_breaks", q("""SELECT request_id, i, CASE WHEN n < 21 THEN round(i * 100 / 7.0) ELSE greatest(CAST(i AS DOUBLE),
 max(v - i) OVER (PARTITION BY request_id ORDER BY i) + i) END AS brk FROM (SELECT request_id, n, i, v FROM (SELECT request_id,
 CAST(least(greatest(round_even(m9, 0), 0), 100) AS DOUBLE) AS v, row_number() OVER (PARTITION BY request_id ORDER BY m9) - 1 AS rn,
 count(*) OVER (PARTITION BY request_id) AS n FROM pass WHERE passing) p, (VALUES (1), (2), (3), (4), (5), (6)) AS k(i)
 WHERE rn = floor(i / 7.0 * (n - 1)))"""))
def quantile_breaks(spark, d):
    v = scores(spark, d).where("passing").select("request_id", F.col("score").cast("double").alias("v"))
    b = CL.quantile_breaks(v, ["request_id"], "v")
    return b.selectExpr("request_id", "posexplode(breaks) AS (i, brk)").select("request_id", (F.col("i") + 1).alias("i"), "brk")


@query("W14_class_bucket", q("""SELECT request_id, pos, cell_id, CASE WHEN minutes <= 10 THEN 0 WHEN minutes <= 20 THEN 1 WHEN minutes <= 30 THEN 2
 WHEN minutes <= 45 THEN 3 WHEN minutes <= 60 THEN 4 ELSE 5 END AS band, CAST(floor(least(greatest(p.mf, 0), 100) / 101.0 * 7) AS INTEGER) AS class
 FROM cell_anchor a JOIN mf p USING (request_id, cell_id)"""))
def class_bucket(spark, d):
    sc = scores(spark, d).where("anchor_slots IS NOT NULL")
    rows = sc.select("request_id", "cell_id", "mf", F.explode(F.map_keys("anchor_slots")).alias("pos"), "minutes")
    even = F.array(*[F.lit(i * 101.0 / 7) for i in range(1, 7)])
    return rows.select("request_id", "pos", "cell_id", CL.commute_band(F.try_element_at("minutes", F.col("pos"))).alias("band"),
                       CL.class_of(F.col("mf"), even).alias("class"))


@query("W15_top_share_cut", q("""SELECT request_id, sc AS cut FROM (SELECT request_id, CAST(least(greatest(round_even(m9, 0), 0), 100) AS DOUBLE) AS sc,
 row_number() OVER (PARTITION BY request_id ORDER BY m9 DESC) - 1 AS rn, count(*) OVER (PARTITION BY request_id) AS n FROM pass WHERE passing)
 WHERE rn = floor(n * 0.15)"""))
def top_share_cut(spark, d):
    v = scores(spark, d).where("passing").select("request_id", F.col("score").cast("double").alias("v"))
    return CL.top_share_cut(v, ["request_id"], "v", 0.15)


@query("W16_compare_best", q(f"""SELECT t.request_id, t.rank, c.criterion, CAST({half_even('c.sc')} AS INTEGER) AS score,
 {half_even('c.sc')} = max({half_even('c.sc')}) OVER (PARTITION BY t.request_id, c.criterion) AS best FROM top_cells t
 JOIN crit c ON c.request_id = t.request_id AND c.cell_id = t.cell_id WHERE t.rank <= 3"""))
def compare_best(spark, d):
    from pyspark.sql import Window as W
    sc = scores(spark, d)
    top = S.top_cells(sc).where("rank <= 3")
    rows = S.criterion_long(sc.join(top.select("request_id", "cell_id"), ["request_id", "cell_id"])) \
            .join(top.select("request_id", "cell_id", "rank"), ["request_id", "cell_id"])
    rows = rows.select("request_id", "rank", "criterion", he(F.col("s")).cast("int").alias("score"))
    best = F.max("score").over(W.partitionBy("request_id", "criterion"))      # three places at most
    return rows.withColumn("best", F.col("score") == best)


@query("W18_row_index", q("SELECT city, cell_id, row_number() OVER (PARTITION BY city ORDER BY cell_id) - 1 AS idx FROM cells"))
def row_index(spark, d):
    p = R.global_positions(B.grid_cells(spark, d).select("city", "cell_id"), ["city"], [F.asc("cell_id")], "idx")
    return p.withColumn("idx", F.col("idx") - 1)


@query("W19_latest_n_months", """SELECT month, count(*) AS n FROM (SELECT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem) WHERE month IN
 (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') FROM lineitem ORDER BY 1 DESC LIMIT 6) GROUP BY 1""")
def latest_n_months(spark, d):
    li = B.table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return RG.latest_months(li, "month", 6).groupBy("month").agg(F.count("*").alias("n"))


def raw_values(spark, d, *more):
    """Known raw values of the habitable cells, a row per indicator."""
    names = F.array(*[F.lit(s.key) for s in B.SPECS])
    return (prepared(spark, d).where("habitable").select("city", *more, F.posexplode("raw").alias("j", "v"))
            .where("v IS NOT NULL").select("city", *more, names[F.col("j")].alias("ikey"), "v"))


@query("W08_percentile_rank_region", q("""SELECT city, ikey, round(median(p), 6) AS median_pct FROM (SELECT city, ikey, cell_id, (rank() OVER w + count(*) OVER
 (PARTITION BY city, ikey, v) / 2.0 - 0.5) / count(*) OVER (PARTITION BY city, ikey) AS p FROM raw_long WHERE habitable AND v IS NOT NULL
 WINDOW w AS (PARTITION BY city, ikey ORDER BY v)) JOIN cells USING (city, cell_id) WHERE sqrt(pow((lat - 50.01) * 111.2, 2)
 + pow((lon - CASE city WHEN 'praha' THEN 14.3 ELSE 19.9 END) * 111.2 * cos(radians(50.01)), 2)) <= 6.0 GROUP BY 1, 2"""))
def percentile_rank_region(spark, d):
    hab = raw_values(spark, d, "lat", "lon")
    rank = R.mean_rank_share(hab, ["city", "ikey"], "v")
    lon0 = F.when(F.col("city") == "praha", 14.3).otherwise(19.9)
    area = hab.where(geo.planar_km(F.col("lat"), F.col("lon"), F.lit(50.01), lon0) <= 6.0)
    m = R.medians(area.join(rank, ["city", "ikey", "v"]), ["city", "ikey"], "pct_rank", "m")
    return m.select("city", "ikey", F.round("m", 6).alias("median_pct"))


@query("W09_rank_of_group", q("""SELECT city, ikey, district_name, rank FROM (SELECT city, ikey, district_name, row_number() OVER (PARTITION BY city, ikey
 ORDER BY round(median(v), 9) DESC, district_name) AS rank FROM raw_long JOIN cells c USING (city, cell_id) WHERE c.habitable
 AND v IS NOT NULL GROUP BY 1, 2, 3)"""))
def rank_of_group(spark, d):
    m = R.medians(raw_values(spark, d, "district_name"), ["city", "ikey", "district_name"], "v", "m")
    order = [F.desc(F.round("m", 9)), F.asc("district_name")]
    return R.global_positions(m, ["city", "ikey"], order, "rank").select("city", "ikey", "district_name", "rank")


# ------------------------------------------------------------------ aggregates
@query("A09_mode_value", "SELECT p_type, arg_min(p_brand, (-n, p_brand)) AS p_brand FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1")
def mode_value(spark, d):
    return CL.mode_value(B.table(spark, d, "part"), ["p_type"], "p_brand")


CRIME = {"crime_w": "SELECT district_id AS district, sum(population_est) AS weight FROM cells GROUP BY 1",
         "crime_t": """SELECT arg_max(n, yr) AS total FROM (SELECT extract('year' FROM o_orderdate) AS yr, count(*) AS n FROM orders
 WHERE o_orderstatus = 'F' GROUP BY 1)"""}


@query("A27_latest_year_total", q("SELECT CAST(total AS BIGINT) AS total FROM crime_t", **CRIME))
def latest_year_total(spark, d):
    by_year = (B.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.year("o_orderdate").alias("yr"))
               .agg(F.count("*").alias("n")))
    return by_year.agg(F.max_by("n", "yr").alias("total"))


@query("A12_rate_per_1000", q("""SELECT w.district, round(coalesce(e.n, 0) / (w.weight / sum(w.weight) OVER () * t.total) * 1000, 2) AS rate
 FROM crime_w w CROSS JOIN crime_t t LEFT JOIN (SELECT 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS district, count(*) AS n FROM events
 GROUP BY 1) e ON e.district = w.district""", **CRIME))
def rate_per_1000(spark, d):
    ev = B.table(spark, d, "events").selectExpr("concat('Brand#', user_id % 25 + 1) AS district")
    w = B.grid_cells(spark, d).groupBy(F.col("district_id").alias("district")).agg(F.sum("population_est").alias("weight"))
    return CL.rate_per_1000(ev, w, latest_year_total(spark, d), "district")


SERIES = ["l_suppkey AS code", "cast(year(l_shipdate) AS int) AS year", "CASE WHEN l_linenumber % 2 = 0 THEN '24g' ELSE '1g' END AS averaging",
          "l_tax * 1000.0 + 40.0 AS completeness", "l_quantity AS mean", "l_orderkey AS k1", "l_linenumber AS k2", "l_partkey AS k3"]
SERIES_SQL = {"series": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY averaging DESC, mean DESC, k1 DESC, k2 DESC, k3 DESC) AS rn FROM (SELECT *, max(year) OVER () AS last
 FROM (SELECT {', '.join(s.replace('string', 'varchar') for s in SERIES)} FROM lineitem) WHERE completeness >= 75) WHERE year > last - 3) WHERE rn = 1"""}


def series(spark, d):
    df = B.table(spark, d, "lineitem").selectExpr(*SERIES)
    return CL.preferred_series(df, ["code", "year"], "averaging", ["mean", "k1", "k2", "k3"])


@query("W10_series_preference_dedup", q("SELECT code, year, averaging, mean FROM series", **SERIES_SQL))
def series_preference_dedup(spark, d):
    return series(spark, d).select("code", "year", "averaging", "mean")


@query("A14_station_annual_mean", q("""SELECT code, round(avg(mean), 6) AS value, CAST(min(year) AS VARCHAR) || '–' || CAST(max(year) AS VARCHAR) AS years
 FROM series GROUP BY 1""", **SERIES_SQL))
def station_annual_mean(spark, d):
    return series(spark, d).groupBy("code").agg(F.round(F.avg("mean"), 6).alias("value"),
                                                F.concat_ws("–", F.min("year"), F.max("year")).alias("years"))


ROW3 = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS a", "l_extendedprice / 1000.0 AS b",
        "CASE WHEN l_linestatus = 'F' THEN l_tax * 300.0 END AS c"]


@query("A15_median_across_columns", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((SELECT median(x) FROM (VALUES (a), (b), (c)) AS t(x)), 6) AS m
 FROM (SELECT {', '.join(ROW3)} FROM lineitem)""")
def median_across_columns(spark, d):
    return B.table(spark, d, "lineitem").selectExpr(*ROW3).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(CL.median_of_columns(["a", "b", "c"]), 6).alias("m"))


@query("A24_null_share_report", q("""SELECT city, ikey AS indicator, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share,
 count(v) = 0 AS all_null FROM raw_long WHERE habitable GROUP BY 1, 2"""))
def null_share_report(spark, d):
    return (filled_long(spark, d).where("habitable").groupBy("city", "indicator")
            .agg(F.round(F.avg(F.col("v").isNull().cast("double")), 6).alias("null_share"), (F.count("v") == 0).alias("all_null")))


@query("A25_distinct_dedup", "SELECT l_suppkey, l_quantity, arg_min(l_orderkey, (l_orderkey, l_linenumber, l_partkey)) AS l_orderkey, arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1, 2")
def distinct_dedup(spark, d):
    li = B.table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey")
    return RG.first_per_key(li, ["l_suppkey", "l_quantity"], ["l_orderkey", "l_linenumber", "l_partkey"]) \
        .select("l_suppkey", "l_quantity", "l_orderkey", "l_partkey")


@query("A26_population_rollup", q("""SELECT city, district_id, neighborhood, sum(population_est) AS population FROM cells
 GROUP BY GROUPING SETS ((city, district_id), (city, neighborhood))"""))
def population_rollup(spark, d):
    c = B.grid_cells(spark, d)
    return (c.groupingSets([["city", "district_id"], ["city", "neighborhood"]], "city", "district_id", "neighborhood")
            .agg(F.sum("population_est").alias("population")).select("city", "district_id", "neighborhood", "population"))


COMPARABLE = sorted({s.column for s in B.SPECS if s.cross_city and not s.is_alias})


@query("A28_pooled_feature_table", q(" UNION ALL ".join(f"""SELECT c.city, c.cell_id, c.habitable, '{c}' AS "column", round(f."{c}", 6) AS value FROM cells c LEFT JOIN feats f USING (cell_id)""" for c in COMPARABLE)))
def pooled_feature_table(spark, d):
    """All comparable columns of all cities, stacked."""
    c = B.cells(spark, d)
    out = G.pooled_features([c.where(F.col("city") == x) for x in CITIES], COMPARABLE)
    arms = ", ".join(f"struct('{x}' AS column, cast(`{x}` AS double) AS value)" for x in COMPARABLE)
    return out.selectExpr("city", "cell_id", "habitable", f"inline(array({arms}))").withColumn("value", F.round("value", 6))
