"""Registered queries: cleaning, normalisation, registers, timetables, set operations, scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CITIES, CRITERIA, INDICATORS, LOG_UNITS, POI_VOCAB
from ..functions import geo, norm as N, text as T
from ..operators import cells as C, quality as QA, registers as RG, transit as TR
from ..operators.runs import rank_runs
from . import bindings as B
from .oracle import CITY, half_even, q
from .registry import query
from .scoring_queries import prepared

KEYS = "array(" + ", ".join(f"'{s.key}'" for s in B.SPECS) + ")"


def filled_long(spark, d):
    return (prepared(spark, d).selectExpr("city", "cell_id", "habitable", "posexplode(arrays_zip(raw, filled, imputed)) AS (j, z)")
            .selectExpr("city", "cell_id", "habitable", "j", f"{KEYS}[j] AS indicator", "z.raw AS v", "z.filled AS filled",
                        "z.imputed AS imputed"))


def rnd(*cols, digits=6):
    return [F.round(c, digits).alias(c) for c in cols]


# ------------------------------------------------------------------ normalisation
@query("W01_midrank_percentile", q("""SELECT city, cell_id, ikey AS indicator, round(pr, 6) AS pct FROM ranked WHERE pr IS NOT NULL"""))
def midrank_percentile(spark, d):
    long = filled_long(spark, d).where(F.col("j").isin([j for j, s in enumerate(B.SPECS) if "percentile" in s.norm]))
    runs = rank_runs(long, ["city", "indicator"], "filled", F.col("habitable"), ["cell_id"])
    return runs.midranks().select("city", "cell_id", "indicator", *rnd("pct"))


@query("W02_decay_norm", q("""SELECT city, cell_id, ikey AS indicator, round(least(greatest((f * CASE WHEN ws THEN 1.35 ELSE 1.0 END - bad)
 / (good - bad) * 100.0, 0.0), 100.0), 6) AS score FROM filled WHERE norm = 'decay' AND f IS NOT NULL"""))
def decay_norm(spark, d):
    arms = [F.struct(F.lit(s.key).alias("indicator"), N.decay(F.col("filled")[j], s.good, s.bad, 1.35 if s.walk_scaled else 1.0)
                     .alias("score")) for j, s in enumerate(B.SPECS) if s.norm == "decay"]
    return (prepared(spark, d).select("city", "cell_id", F.inline(F.array(*arms))).where("score IS NOT NULL")
            .select("city", "cell_id", "indicator", *rnd("score")))


@query("W03_threshold_norm", q("""SELECT city, cell_id, CASE WHEN f >= 50 THEN 100.0 ELSE 0.0 END AS score FROM filled
 WHERE ikey = 'environment.noise_db' AND f IS NOT NULL"""))
def threshold_norm(spark, d):
    j = [s.key for s in B.SPECS].index("environment.noise_db")
    return (prepared(spark, d).select("city", "cell_id", N.threshold(F.col("filled")[j], 50.0).alias("score"))
            .where("score IS NOT NULL"))


@query("P02_null_implausible", q("""SELECT r.city, r.ikey AS indicator, count(*) AS implausible FROM raw0 r JOIN plaus p ON p.unit = r.unit
 WHERE NOT r.is_alias AND r.v0 IS NOT NULL AND NOT (r.v0 BETWEEN p.lo AND p.hi) GROUP BY 1, 2"""))
def null_implausible(spark, d):
    cells = B.cells(spark, d)
    a = C.long_values(cells, B.SPECS, clean=False).withColumnRenamed("v", "v0")
    lims = QA.plausible_table(spark, B.SPECS)
    return (a.join(lims, "j").where("v0 IS NOT NULL AND NOT v0 BETWEEN lo AND hi").groupBy("city", "indicator")
            .agg(F.count("*").alias("implausible")))


@query("P03_impute_group_median", q("SELECT city, cell_id, ikey AS indicator, round(f, 6) AS filled, imputed FROM filled"))
def impute_group_median(spark, d):
    long = C.long_values(B.cells(spark, d), B.SPECS)
    med = rank_runs(long.where("habitable"), ["city", "j"], "v").medians()
    return long.join(med, ["city", "j"], "left").select("city", "cell_id", "indicator", F.round(F.coalesce("v", "median"), 6)
                                                        .alias("filled"), F.col("v").isNull().alias("imputed"))


@query("P04_coverage_share", q("SELECT s.city, p.ikey AS indicator, round(s.coverage, 6) AS coverage FROM stats s JOIN spec p USING (j)"))
def coverage_share(spark, d):
    return (filled_long(spark, d).where("habitable").groupBy("city", "indicator")
            .agg(F.round(F.avg(F.col("v").isNotNull().cast("double")), 6).alias("coverage")))


@query("P05_indicator_available", q("""SELECT s.city, p.ikey AS indicator, s.coverage > 0 AS available FROM stats s JOIN spec p USING (j)"""))
def indicator_available(spark, d):
    return (filled_long(spark, d).where("habitable").groupBy("city", "indicator")
            .agg((F.count("v") > 0).alias("available")))


@query("P06_column_alias_resolve", q("""SELECT a.ikey AS alias, a.col AS column, r.city, count(r.v) AS n_values,
 a.base_w AS weight FROM spec a JOIN raw_long r ON r.ikey = a.ikey WHERE a.is_alias GROUP BY 1, 2, 3, 5"""))
def column_alias_resolve(spark, d):
    al = spark.createDataFrame([(s.key, s.column, s.weight) for s in B.SPECS if s.is_alias], "alias string, column string, weight double")
    src = filled_long(spark, d).select("city", F.col("indicator").alias("column"), "v")
    return src.join(al, "column").groupBy("alias", "column", "city", "weight").agg(F.count("v").alias("n_values"))


OVERRIDES = [("praha", "environment.noise_db", "Noise (LAeq)", None), ("krakow", "price.buy_per_m2", None, 1)]


@query("P07_spec_overrides", q("""SELECT s.city, p.ikey AS indicator, coalesce(o.label, replace(split_part(p.ikey, '.', 2), '_', ' ')) AS label,
 coalesce(o.decimals, p.decimals) AS decimals, s.n_values FROM stats s JOIN spec p USING (j)
 LEFT JOIN (VALUES ('praha', 'environment.noise_db', 'Noise (LAeq)', NULL), ('krakow', 'price.buy_per_m2', NULL, 1))
 AS o(city, ikey, label, decimals) ON o.city = s.city AND o.ikey = p.ikey"""))
def spec_overrides(spark, d):
    spec = spark.createDataFrame([(s.key, s.key.split(".")[1].replace("_", " "), s.decimals) for s in B.SPECS],
                                 "indicator string, label string, decimals int")
    over = spark.createDataFrame(OVERRIDES, "city string, indicator string, o_label string, o_decimals int")
    n = filled_long(spark, d).where("habitable").groupBy("city", "indicator").agg(F.count("v").alias("n_values"))
    return C.with_overrides(n.join(spec, "indicator"), over).select("city", "indicator", "label", "decimals", "n_values")


@query("P01_align_columns", q("""SELECT c.city, c.cell_id, f."transit.departures_per_h_500m" AS departures, CAST(NULL AS DOUBLE) AS lines,
 f.cnt AS aux_extra FROM cells c JOIN (SELECT a.cnt * 1.0 AS cnt, f.* FROM feats f JOIN aggs a USING (cell_id)) f USING (cell_id)"""))
def align_columns(spark, d):
    src = B.cells(spark, d).join(B.part_aggregates(spark, d).select("cell_id", F.col("cnt").alias("extra.rows"),
                                                                    F.lit(None).cast("double").alias("nothing")), "cell_id")
    out = C.align(src, [i.key for i in INDICATORS if not i.is_alias])
    assert "aux.nothing" not in out.columns
    return out.select("city", "cell_id", F.col("`transit.departures_per_h_500m`").alias("departures"),
                      F.col("`transit.lines_500m`").alias("lines"), F.col("`aux.extra_rows`").alias("aux_extra"))


@query("P27_cross_columns", q("""SELECT p.ikey AS indicator, p.unit FROM stats s JOIN spec p USING (j) WHERE NOT p.is_alias AND s.coverage > 0
 AND p.ikey IN (SELECT * FROM (VALUES """ + ", ".join(f"('{s.key}')" for s in B.SPECS if s.cross_city) + """)) GROUP BY 1, 2
 HAVING count(DISTINCT s.city) = 2"""))
def cross_columns(spark, d):
    stats = filled_long(spark, d).where("habitable").groupBy("city", "j").agg(F.count("v").alias("n"))
    spec = QA.spec_table(spark, B.SPECS)
    return (stats.where("n > 0").join(spec, "j").where("cross_city AND NOT is_alias").groupBy("indicator", "unit")
            .agg(F.count_distinct("city").alias("c")).where(F.col("c") == len(CITIES)).select("indicator", "unit"))


@query("F20_log1p_heavy_tail", q(f"""SELECT city, cell_id, ikey AS indicator, round(ln(1 + greatest(f, 0)), 6) AS v FROM filled
 WHERE unit IN {LOG_UNITS} AND f IS NOT NULL"""))
def log1p_heavy_tail(spark, d):
    js = [j for j, s in enumerate(B.SPECS) if s.unit in LOG_UNITS]
    return (filled_long(spark, d).where(F.col("j").isin(js) & F.col("filled").isNotNull())
            .select("city", "cell_id", "indicator", F.round(N.log_heavy(F.col("filled")), 6).alias("v")))


# ------------------------------------------------------------------ transactions
TX_SQL = {"tx": """SELECT l_orderkey AS tx_id, l_linenumber AS flat_id, l_partkey, l_quantity + 10.0 AS area, l_extendedprice / 10.0 AS flat_price0,
 CASE WHEN l_tax > 0.04 THEN NULL ELSE l_extendedprice / 10.0 END AS flat_price, o_totalprice / 10.0 AS tx_price,
 CASE WHEN l_returnflag = 'R' THEN 'dwelling' ELSE 'other' END AS function, CASE WHEN l_linestatus = 'F' THEN 'free' ELSE 'tender' END AS market,
 CASE WHEN l_discount > 0.02 THEN '1/1' ELSE '1/2' END AS share,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'person' ELSE 'company' END AS buyer
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
          "sale": """SELECT *, p / area AS ppm2 FROM (SELECT t.*, CASE WHEN flat_price > 0 THEN flat_price WHEN units = 1 THEN tx_price END AS p
 FROM (SELECT tx.*, count(flat_id) OVER (PARTITION BY tx_id) AS units, sum(CASE WHEN function = 'dwelling' THEN 1 ELSE 0 END)
 OVER (PARTITION BY tx_id) AS flats FROM tx) t) WHERE function = 'dwelling' AND market = 'free' AND share = '1/1' AND flats = 1
 AND buyer = 'person' AND area BETWEEN 15 AND 250 AND p IS NOT NULL""",
          "sale_q": "SELECT quantile_cont(ppm2, 0.25) AS q1, quantile_cont(ppm2, 0.75) AS q3 FROM sale",
          "kept": """SELECT sale.* FROM sale, sale_q WHERE ppm2 >= greatest(q1 - 1.5 * (q3 - q1), 20.0) AND ppm2 <= q3 + 1.5 * (q3 - q1)"""}


def transactions(spark, d):
    li, o = B.table(spark, d, "lineitem"), B.table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).selectExpr(
        "l_orderkey AS tx_id", "l_linenumber AS flat_id", "l_partkey", "l_quantity + 10.0D AS area",
        "CASE WHEN l_tax > 0.04D THEN NULL ELSE l_extendedprice / 10.0D END AS flat_price", "o_totalprice / 10.0D AS tx_price",
        "CASE WHEN l_returnflag = 'R' THEN 'dwelling' ELSE 'other' END AS function",
        "CASE WHEN l_linestatus = 'F' THEN 'free' ELSE 'tender' END AS market",
        "CASE WHEN l_discount > 0.02D THEN '1/1' ELSE '1/2' END AS share",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'person' ELSE 'company' END AS buyer")


def sales(spark, d):
    return RG.iqr_trim(RG.arms_length(transactions(spark, d)), "ppm2", floor=20.0)


@query("P15_arms_length_filter", q("SELECT tx_id, flat_id, round(ppm2, 6) AS ppm2 FROM sale", **TX_SQL))
def arms_length_filter(spark, d):
    return RG.arms_length(transactions(spark, d)).select("tx_id", "flat_id", *rnd("ppm2"))


@query("P14_iqr_trim", q("SELECT tx_id, flat_id, round(ppm2, 6) AS ppm2 FROM kept", **TX_SQL))
def iqr_trim(spark, d):
    return sales(spark, d).select("tx_id", "flat_id", *rnd("ppm2"))


@query("W11_per_transaction_counts", q("""SELECT tx_id, flat_id, count(flat_id) OVER (PARTITION BY tx_id) AS units,
 CAST(sum(CASE WHEN function = 'dwelling' THEN 1 ELSE 0 END) OVER (PARTITION BY tx_id) AS BIGINT) AS flats FROM tx""", **TX_SQL))
def per_transaction_counts(spark, d):
    tx = transactions(spark, d).select("tx_id", "flat_id", "function")
    per = tx.groupBy("tx_id").agg(F.count("flat_id").alias("units"), F.count_if(F.col("function") == "dwelling").alias("flats"))
    return tx.join(per, "tx_id").select("tx_id", "flat_id", "units", "flats")


# ------------------------------------------------------------------ filters and classes
@query("P16_bbox_filter", q("SELECT category, count(*) AS n FROM pois WHERE lon BETWEEN 14.25 AND 19.95 AND lat BETWEEN 50.0 AND 50.02 GROUP BY 1"))
def bbox_filter(spark, d):
    return (B.points(spark, d).where("lon BETWEEN 14.25D AND 19.95D AND lat BETWEEN 50.0D AND 50.02D").groupBy("category")
            .agg(F.count("*").alias("n")))


@query("P17_exclude_entities_by_any", """SELECT event_id // 3 AS incident, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type
 FROM events GROUP BY 1 HAVING NOT bool_or(event_type = 'error')""")
def exclude_entities_by_any(spark, d):
    ev = B.table(spark, d, "events").selectExpr("event_id div 3 AS incident", "event_id", "event_type")
    return RG.exclude_entities(ev, "incident", F.col("event_type") == "error")


@query("P18_hierarchy_top_class", """SELECT CASE WHEN n.n_regionkey = 0 THEN n.n_nationkey ELSE n.n_regionkey END AS top, count(*) AS n
 FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1""")
def hierarchy_top_class(spark, d):
    cls = B.table(spark, d, "nation").selectExpr(
        "n_nationkey AS code", "CASE WHEN n_regionkey <> 0 THEN concat('http://example.org/classes/', n_regionkey) END AS iri")
    top = F.coalesce(F.substring_index("iri", "/", -1).cast("int"), "code")
    rows = B.table(spark, d, "customer").select(F.col("c_nationkey").alias("code"))
    return rows.join(cls, "code").groupBy(top.alias("top")).agg(F.count("*").alias("n"))


AMENITIES = ("pharmacy", "post_office", "parcel_locker", "bank", "atm", "doctors", "clinic", "dentist", "hospital", "childcare",
             "kindergarten", "school", "university", "library", "restaurant", "cafe", "bar", "nightclub", "theatre", "bench",
             "bicycle_parking", "bicycle_rental", "marketplace", "", "")
SHOPS = ("supermarket", "convenience", "bakery", "", "", "", "florist")
LEISURE = ("playground", "park", "sports_centre", "swimming_pool", "water_park", "", "", "", "ice_rink")
HEALTH = ("", "", "", "doctor", "centre", "dentist", "hospital", "", "pharmacy")
SPECIALITY = ("", "", "paediatrics", "gynaecology", "obstetrics", "", "maternity")
NAMES = ("Lidl", "Żłobek nr 4", "Dětská skupina Sluníčko", "Poradnia pediatryczna", "Gynekologie Plus", "Corner", "Netto city")
RAIL = ("", "", "", "tram_stop", "station", "halt", "", "")
TAG_EXPR = {
    "amenity": B.pick(AMENITIES, "p_partkey"), "shop": B.pick(SHOPS, "p_size"), "leisure": B.pick(LEISURE, "p_partkey"),
    "tourism": B.pick(("museum", "gallery", "", "", "", ""), "p_size"), "healthcare": B.pick(HEALTH, "p_size"),
    "name": B.pick(NAMES, "p_partkey"), "brand": "p_name", "speciality": B.pick(SPECIALITY, "p_size"),
    "emergency": B.pick(("yes", "no", ""), "p_size"), "access": B.pick(("private", "", "yes", "customers"), "p_partkey"),
    "railway": B.pick(RAIL, "p_partkey"), "station": B.pick(("subway", "", "light_rail", ""), "p_size"),
    "subway": B.pick(("yes", "", ""), "p_partkey"), "vending": B.pick(("parcel_pickup", "", "", "", ""), "p_size"),
    "atm": B.pick(("yes", "no"), "p_size")}


def duck(rule):
    import re
    rule = re.sub(r"(concat\([^)]*\)|\w+) RLIKE ('[^']*')", r"regexp_matches(\1, \2)", rule)
    return rule.replace('(?iu)', '(?i)')   # RE2 is Unicode-aware by itself


def classify_sql(table, rules):
    arms = ", ".join(f"CASE WHEN {duck(r)} THEN '{c}' END" for c, r in rules.items())
    return f"SELECT * FROM (SELECT *, unnest([{arms}]) AS category FROM {table}) WHERE category IS NOT NULL"


TAGS_SQL = {"tags": "SELECT p_partkey, " + ", ".join(f"{e} AS {c}" for c, e in TAG_EXPR.items()) + ", '' AS tram FROM part"}


@query("P19_poi_classify", q(f"SELECT p_partkey, category FROM ({classify_sql('tags', RG.TAG_RULES)})", **TAGS_SQL))
def poi_classify(spark, d):
    tags = B.table(spark, d, "part").selectExpr("p_partkey", *[f"{e} AS {c}" for c, e in TAG_EXPR.items()])
    return RG.classify(RG.with_optional(tags, RG.TAG_COLUMNS), RG.TAG_RULES).select("p_partkey", "category")


@query("P29_optional_column", "SELECT p_partkey, p_brand AS brand, '' AS tram FROM part")
def optional_column(spark, d):
    df = B.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return RG.with_optional(df, ["brand", "tram"])


SCHOOL_TYPES = RG.KINDERGARTEN_TYPES + RG.PRIMARY_TYPES + RG.SECONDARY_TYPES + ("Przedszkole specjalne",)
AUDIENCE = ("Dzieci lub młodzież", "Dorośli", "Bez kategorii")
SCHOOL = ["c_custkey", B.pick(SCHOOL_TYPES, "c_nationkey") + " AS type", B.pick(AUDIENCE, "c_custkey") + " AS audience"]


@query("P20_register_classify_set", f"""SELECT * FROM (SELECT c_custkey, CASE WHEN type IN {RG.SECONDARY_TYPES} AND audience = 'Dzieci lub młodzież'
 THEN 'secondary_school' WHEN type = 'Szkoła podstawowa' AND audience <> 'Dorośli' THEN 'primary_school'
 WHEN type IN {RG.KINDERGARTEN_TYPES} THEN 'kindergarten' END AS category FROM (SELECT {', '.join(SCHOOL)} FROM customer)) WHERE category IS NOT NULL""")
def register_classify_set(spark, d):
    return RG.classify_schools(B.table(spark, d, "customer").selectExpr(*SCHOOL)).select("c_custkey", "category")


DRUH = ("Fakultní nemocnice", "Nemocnice", "Lékárna", "Samostatná ordinace všeob. prakt. lékaře", "Ordinace stomatologa",
        "Ordinace gynekologa", "Specializovaná nemocnice", "Ordinace prakt. lékaře pro děti a dorost", "Jiné")
OBOR = ("gynekologie a porodnictví", "dětské lékařství", "urgentní medicína", "zubní lékařství", "neonatologie",
        "všeobecné praktické lékařství", "anesteziologie", "praktické lékařství pro děti a dorost")
HEALTH_ROW = ["c_custkey", B.pick(DRUH, "c_nationkey") + " AS druh", B.pick(OBOR, "c_custkey") + " AS obor",
              B.pick(("ambulantní péče", "lůžková péče", ""), "c_nationkey") + " AS forma", "c_mktsegment AS name"]


@query("P21_register_classify_text", f"""SELECT category, name, nation, min(c_custkey) AS c_custkey FROM ({classify_sql('(SELECT ' + ', '.join(HEALTH_ROW)
 + ', c_nationkey AS nation FROM customer)', RG.HEALTH_RULES)}) GROUP BY 1, 2, 3""")
def register_classify_text(spark, d):
    rows = B.table(spark, d, "customer").selectExpr(*HEALTH_ROW, "c_nationkey AS nation")
    hit = RG.classify(rows, RG.HEALTH_RULES).select("category", "name", "nation", "c_custkey")
    return RG.first_per_key(hit, ["category", "name", "nation"], ["c_custkey"])


MODE_SQL = """CASE WHEN t = 0 OR t BETWEEN 900 AND 999 THEN 'tram' WHEN t = 1 OR t BETWEEN 400 AND 499 THEN 'metro'
 WHEN t = 2 OR t BETWEEN 100 AND 199 THEN 'rail' WHEN t IN (3, 11) OR t BETWEEN 700 AND 899 THEN 'bus'
 WHEN t = 4 OR t BETWEEN 1000 AND 1099 OR t = 1200 THEN 'ferry' WHEN t IN (5, 6, 7, 12) OR t BETWEEN 1300 AND 1499 THEN 'cable' ELSE 'other' END"""


@query("P22_route_mode_map", f"SELECT mode, count(*) AS n FROM (SELECT {MODE_SQL} AS mode FROM (SELECT CAST(floor(value * 10) AS INTEGER) AS t FROM events)) GROUP BY 1")
def route_mode_map(spark, d):
    t = F.floor(F.col("value") * 10).cast("int")
    return B.table(spark, d, "events").groupBy(TR.mode_of(t).alias("mode")).agg(F.count("*").alias("n"))


@query("P24_vocab_filter", q("SELECT category, count(*) AS n FROM pois WHERE category NOT IN ('shop', 'hospital') GROUP BY 1"))
def vocab_filter(spark, d):
    vocab = spark.createDataFrame([(c,) for c in POI_VOCAB], "category string")
    return B.points(spark, d).join(vocab, "category", "left_semi").groupBy("category").agg(F.count("*").alias("n"))


@query("P25_authoritative_replace", q("""SELECT category, count(*) AS n, sum(CASE WHEN src = 'register' THEN 1 ELSE 0 END) AS from_register FROM (
 SELECT category, 'base' AS src FROM pois WHERE category NOT IN ('pharmacy', 'gp_clinic')
 UNION ALL SELECT CASE WHEN dest % 2 = 0 THEN 'pharmacy' ELSE 'gp_clinic' END, 'register' FROM dests) GROUP BY 1"""))
def authoritative_replace(spark, d):
    reg = B.dests(spark, d).selectExpr("CASE WHEN dest % 2 = 0 THEN 'pharmacy' ELSE 'gp_clinic' END AS category", "name", "'register' AS src")
    base = B.points(spark, d).selectExpr("category", "name", "'base' AS src")
    out = RG.replace_authoritative(base, reg, reg.select("category"))
    return out.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("src") == "register").alias("from_register"))


BAND = ["p_partkey", "CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 7 = 0 THEN -24 ELSE 30 + 5 * (p_size % 10) END AS lo",
        "CASE WHEN p_size % 7 = 0 THEN 55 WHEN p_size % 8 = 0 THEN 99 WHEN p_size % 11 = 0 THEN NULL ELSE 35 + 5 * (p_size % 10) END AS hi"]


@query("P26_noise_band_value", f"""SELECT p_partkey, CASE WHEN hi IS NULL OR hi >= 99 THEN lo + 2.5 WHEN lo IS NULL OR hi - lo > 10 THEN hi - 5.0
 ELSE (lo + hi) / 2.0 END AS v FROM (SELECT {', '.join(BAND)} FROM part)""")
def noise_band_value(spark, d):
    df = B.table(spark, d, "part").selectExpr(*BAND)
    return df.select("p_partkey", N.band_value(F.col("lo"), F.col("hi")).alias("v"))


# ------------------------------------------------------------------ dates, sets
CAL_SQL = {
    "cal": """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'north' ELSE 'south' END AS feed, o_orderkey AS service_id, CAST(o_orderdate AS DATE) AS d0,
 CAST(o_orderdate AS DATE) + CAST(o_custkey % 40 AS INTEGER) AS d1, o_custkey % 128 AS bits FROM orders""",
    "cal_dates": """SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'north' ELSE 'south' END AS feed, l_orderkey AS service_id, CAST(l_shipdate AS DATE) AS date,
 CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS exception_type FROM lineitem WHERE l_returnflag <> 'N'""",
    "cal_days": """SELECT DISTINCT feed, date FROM (SELECT feed, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date, bits FROM cal)
 WHERE (bits >> (isodow(date) - 1)) & 1 = 1 UNION SELECT feed, date FROM cal_dates WHERE exception_type = 1""",
    "day": """SELECT coalesce(min(CASE WHEN isodow(date) = 2 AND date > DATE '1996-03-01' AND date <= DATE '1996-03-01' + 60 THEN date END),
 min(CASE WHEN isodow(date) < 6 THEN date END)) AS day FROM (SELECT date FROM cal_days GROUP BY date HAVING count(*) = 2)""",
    "active": """SELECT feed, service_id FROM (SELECT feed, service_id FROM cal, day WHERE day BETWEEN d0 AND d1
 AND (bits >> (isodow(day) - 1)) & 1 = 1 UNION SELECT feed, service_id FROM cal_dates, day WHERE date = day AND exception_type = 1)
 EXCEPT SELECT feed, service_id FROM cal_dates, day WHERE date = day AND exception_type = 2"""}


def calendar(spark, d):
    o = B.table(spark, d, "orders").selectExpr(
        "CASE WHEN o_orderkey % 3 = 0 THEN 'north' ELSE 'south' END AS feed", "o_orderkey AS service_id",
        "cast(o_orderdate AS date) AS start_date", "date_add(cast(o_orderdate AS date), cast(o_custkey % 40 AS int)) AS end_date",
        *[f"cast(shiftright(o_custkey % 128, {i}) & 1 AS int) AS {day}" for i, day in enumerate(TR.DAYS)])
    x = B.table(spark, d, "lineitem").where("l_returnflag <> 'N'").selectExpr(
        "CASE WHEN l_orderkey % 3 = 0 THEN 'north' ELSE 'south' END AS feed", "l_orderkey AS service_id",
        "cast(l_shipdate AS date) AS date", "CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS exception_type")
    return o, x


@query("O07_calendar_expand", q("SELECT feed, date FROM cal_days", **CAL_SQL))
def calendar_expand(spark, d):
    return TR.service_days(*calendar(spark, d))


@query("O06_date_intersect_feeds", q("SELECT day FROM day", **CAL_SQL))
def date_intersect_feeds(spark, d):
    return TR.pick_day(TR.service_days(*calendar(spark, d)), 2, "1996-03-01")


@query("O05_date_union_except", q("SELECT feed, service_id FROM active", **CAL_SQL))
def date_union_except(spark, d):
    cal, ex = calendar(spark, d)
    return TR.active_services(cal, ex, TR.pick_day(TR.service_days(cal, ex), 2, "1996-03-01"))


@query("O04_union_all", q("""SELECT source, count(*) AS n, count(extra) AS with_extra FROM (SELECT 'poi' AS source, name, NULL AS extra FROM pois
 UNION ALL SELECT 'dest', name, value FROM dests) GROUP BY 1"""))
def union_all(spark, d):
    a = B.points(spark, d).select(F.lit("poi").alias("source"), "name")
    b = B.dests(spark, d).select(F.lit("dest").alias("source"), "name", F.col("value").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.count("extra").alias("with_extra"))


@query("O08_set_union_lines", "SELECT user_id AS stop, count(DISTINCT event_type || ':' || CAST(event_id % 7 AS VARCHAR)) AS lines FROM events GROUP BY 1")
def set_union_lines(spark, d):
    ev = B.table(spark, d, "events").selectExpr("user_id AS stop", "concat(event_type, ':', event_id % 7) AS line")
    return ev.groupBy("stop").agg(F.count_distinct("line").alias("lines"))


# ------------------------------------------------------------------ timetable on events
TT_SQL = {
    "st": """SELECT 'feed' || CAST(user_id % 2 AS VARCHAR) AS feed, user_id AS stop_id, event_id // 4 AS trip_id,
 CAST(extract('hour' FROM ts) + 2 AS INTEGER) * 3600 + CAST(extract('minute' FROM ts) AS INTEGER) * 60 + CAST(floor(extract('second' FROM ts)) AS INTEGER) AS sec,
 event_id FROM events""",
    "trip": """SELECT DISTINCT 'feed' || CAST(user_id % 2 AS VARCHAR) AS feed, event_id // 4 AS trip_id, (event_id // 4) % 97 AS route_id,
 (event_id // 4) % 6 AS service_id, (event_id // 4) % 3 = 0 AS wc FROM events""",
    "dep": f"""SELECT s.feed, s.stop_id, s.trip_id, t.route_id, t.wc, s.sec, (SELECT {MODE_SQL} FROM (SELECT CAST(t.route_id * 13 AS INTEGER) AS t)) AS mode,
 s.sec >= 25200 AND s.sec < 32400 AS peak, s.sec % 86400 >= 82800 OR s.sec % 86400 < 18000 AS night
 FROM st s JOIN trip t ON t.feed = s.feed AND t.trip_id = s.trip_id WHERE t.service_id <> 5"""}


def timetable(spark, d):
    """Six feeds' worth of timetable rows from events: stop = user, trip = four consecutive events."""
    ev = B.table(spark, d, "events")
    st = ev.selectExpr("concat('feed', user_id % 2) AS feed", "user_id AS stop_id", "event_id div 4 AS trip_id",
                       "concat_ws(':', hour(ts) + 2, date_format(ts, 'mm'), date_format(ts, 'ss')) AS departure_time")
    trips = ev.selectExpr("concat('feed', user_id % 2) AS feed", "event_id div 4 AS trip_id", "(event_id div 4) % 97 AS route_id",
                          "(event_id div 4) % 6 AS service_id",
                          "CASE WHEN (event_id div 4) % 3 = 0 THEN '1' ELSE '2' END AS wheelchair_accessible").distinct()
    routes = trips.selectExpr("feed", "route_id", "cast(route_id * 13 AS int) AS route_type").distinct()
    services = trips.select("feed", "service_id").distinct().where("service_id <> 5")
    return st, trips, routes, services


def departures(spark, d):
    return TR.departures(*timetable(spark, d))


@query("J01_trips_routes_join", q("""SELECT feed, stop_id, trip_id, route_id, mode, sec FROM dep""", **TT_SQL))
def trips_routes_join(spark, d):
    return departures(spark, d).select("feed", "stop_id", "trip_id", "route_id", "mode", "sec")


@query("J02_active_service_semi", q("SELECT s.feed, count(*) AS n FROM st s WHERE EXISTS (SELECT 1 FROM trip t WHERE t.feed = s.feed AND t.trip_id = s.trip_id AND t.service_id <> 5) GROUP BY 1", **TT_SQL))
def active_service_semi(spark, d):
    st, trips, _, services = timetable(spark, d)
    t = trips.join(services, ["feed", "service_id"], "left_semi")
    return st.join(t, ["feed", "trip_id"], "left_semi").groupBy("feed").agg(F.count("*").alias("n"))


STOP_SQL = """SELECT feed, stop_id, count(*) AS departures_day, count(DISTINCT route_id) AS lines,
 count(*) FILTER (WHERE peak) / 2.0 AS dep_peak_per_h, count(*) FILTER (WHERE peak AND wc) / 2.0 AS dep_peak_wc_per_h,
 count(*) FILTER (WHERE night) AS dep_night, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes FROM dep GROUP BY 1, 2"""


@query("A10_stop_stats", q(STOP_SQL, **TT_SQL))
def stop_stats(spark, d):
    return TR.stop_stats(departures(spark, d)).withColumn("modes", F.array_join("modes", ","))


@query("F12_peak_night_flags", q("SELECT feed, count(*) FILTER (WHERE peak) AS peak, count(*) FILTER (WHERE night) AS night FROM dep GROUP BY 1", **TT_SQL))
def peak_night_flags(spark, d):
    return departures(spark, d).groupBy("feed").agg(F.count_if("peak").alias("peak"), F.count_if("night").alias("night"))


@query("F11_gtfs_seconds", q("SELECT event_id, sec FROM st", **TT_SQL))
def gtfs_seconds(spark, d):
    t = F.expr("concat_ws(':', hour(ts) + 2, date_format(ts, 'mm'), date_format(ts, 'ss'))")
    return B.table(spark, d, "events").select("event_id", TR.seconds(t).alias("sec"))


@query("F27_prefix_ids", q("""SELECT DISTINCT feed, stop_id, 'route' AS kind, feed || ':' || CAST(route_id AS VARCHAR) AS item FROM dep
 UNION SELECT feed, stop_id, 'peak_trip', feed || ':' || CAST(trip_id AS VARCHAR) FROM dep WHERE peak
 UNION SELECT feed, stop_id, 'night_trip', feed || ':' || CAST(trip_id AS VARCHAR) FROM dep WHERE night""", **TT_SQL))
def prefix_ids(spark, d):
    return TR.stop_items(departures(spark, d))


STOPS = {"stops": """SELECT 'feed' || CAST(c_custkey % 2 AS VARCHAR) AS feed, c_custkey AS stop_id, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS stop_name,
 c_custkey // 2 * 2 + (c_custkey % 2) - 2 AS parent, c_acctbal AS lat FROM customer"""}


def stops(spark, d):
    return B.table(spark, d, "customer").selectExpr(
        "concat('feed', c_custkey % 2) AS feed", "c_custkey AS stop_id", "CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS stop_name",
        "c_custkey div 2 * 2 + (c_custkey % 2) - 2 AS parent_station", "c_acctbal AS lat", "cast(c_nationkey AS double) AS lon")


@query("J03_stop_attributes_left", q(f"""SELECT a.feed, a.stop_id, a.departures_day, s.stop_name, round(s.lat, 6) AS lat FROM ({STOP_SQL}) a
 LEFT JOIN stops s ON s.feed = a.feed AND s.stop_id = a.stop_id""", **TT_SQL, **STOPS))
def stop_attributes_left(spark, d):
    return (TR.stop_stats(departures(spark, d)).join(stops(spark, d), ["feed", "stop_id"], "left")
            .select("feed", "stop_id", "departures_day", "stop_name", *rnd("lat")))


@query("G15_stop_pois", q(f"""SELECT c.category, a.stop_id, 'gtfs_' || a.feed AS source, a.dep_peak_per_h FROM ({STOP_SQL}) a
 JOIN stops s ON s.feed = a.feed AND s.stop_id = a.stop_id JOIN (VALUES ('transit_stop', NULL), ('tram_stop', 'tram'), ('bus_stop', 'bus'),
 ('metro_station', 'metro'), ('rail_station', 'rail')) AS c(category, mode)
 ON c.mode IS NULL OR list_contains(string_split(a.modes, ','), c.mode) WHERE a.departures_day > 0""", **TT_SQL, **STOPS))
def stop_pois(spark, d):
    out = TR.stop_categories(TR.stop_stats(departures(spark, d)), stops(spark, d), {"feed0": "gtfs_feed0", "feed1": "gtfs_feed1"})
    x = F.from_json("extra_json", "stop_id long, dep_peak_per_h double")
    return out.select("category", x["stop_id"].alias("stop_id"), "source", x["dep_peak_per_h"].alias("dep_peak_per_h"))


@query("J25_parent_station_fill", q("""SELECT s.feed, s.stop_id, coalesce(nullif(trim(s.stop_name), ''), nullif(trim(p.stop_name), ''),
 CAST(s.stop_id AS VARCHAR)) AS stop_name FROM stops s LEFT JOIN stops p ON p.feed = s.feed AND p.stop_id = s.parent""", **STOPS))
def parent_station_fill(spark, d):
    return TR.parent_names(stops(spark, d)).select("feed", "stop_id", "stop_name")


@query("G16_travel_matrix_densify", q(f"""SELECT city, mode, origin, dest, CAST({half_even('m')} AS SMALLINT) AS minutes FROM (SELECT city, mode, origin,
 dest, minutes * 3.0 - 5.5 AS m FROM travel) WHERE m <= 120"""))
def travel_matrix_densify(spark, d):
    return TR.tidy_minutes(B.travel(spark, d).withColumn("minutes", F.col("minutes") * F.lit(3.0) - 5.5))


@query("F23_json_extra", "SELECT user_id, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS k FROM events GROUP BY 1")
def json_extra(spark, d):
    packed = B.table(spark, d, "events").select("user_id", F.to_json(F.struct(F.from_json("props", "k int").alias("p"))).alias("j"))
    return packed.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.from_json("j", "p struct<k: int>")["p"]["k"]).alias("k"))
