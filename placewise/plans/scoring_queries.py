"""Registered queries: scoring of requests."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CITIES, CRITERIA, LANGS
from ..functions.norm import half_even as he
from ..session import broadcast_if_small, stored, written
from ..operators import cells as C, explain as X, groups as G, quality as QA, ranking as R, scoring as S, topk as K
from . import bindings as B
from .oracle import half_even, q
from .registry import query


def prepared(spark, d):
    """Prepared cells: computed once per data version, like a load step, and read by every request batch."""
    return stored(spark, d, "prepared", lambda: C.prepare(B.cells(spark, d), B.SPECS))


def anchors(spark, d, req):
    """Anchors lie on destinations here; resolution of free positions is a query of its own."""
    at = B.dests(spark, d).select("city", "dest", "lat", "lon")
    pos = req.select("request_id", "city", F.posexplode("anchors").alias("pos", "a"))
    hit = (pos.select("request_id", "city", "pos", "a.lat", "a.lon").join(at, ["city", "lat", "lon"])
           .groupBy("request_id", "pos").agg(F.min("dest").alias("dest")))
    modes = B.travel(spark, d).select("city", "mode").distinct()
    return S.resolve_anchors(req, hit, modes)


def tiles(spark, d):
    """Prepared cells by tile and the bounds of their sub-scores: once per data version."""
    cells = stored(spark, d, "tiles", lambda: K.tiled(prepared(spark, d)))
    return K.Tiles(cells, stored(spark, d, "tile-bounds", lambda: K.bounds(cells, B.SPECS)))


def asked(spark, d, rows=None):
    """Compiled requests and the minutes to their anchors."""
    req = B.requests(spark, d, rows)
    anc = written(anchors(spark, d, req), "anchors")
    stats = prepared(spark, d).groupBy("city").agg(F.first("coverage").alias("coverage"))   # constant within a city
    return S.compile_requests(req, stats, anc, B.SPECS), S.anchor_minutes(anc, B.travel(spark, d))


def scored(spark, d, rows=None):
    compiled, minutes = asked(spark, d, rows)
    return S.score_cells(prepared(spark, d), compiled, minutes, B.SPECS)


@query("E01_score_response_hex", q(f"""SELECT t.request_id, t.city, t.cell_id, t.rank, round(t.lens, 6) AS lens,
 CAST({half_even('t.mf')} AS INTEGER) AS score, p.place AS name, p.district_id, p.population_est,
 round(p.lat, 6) AS lat, round(p.lon, 6) AS lon
 FROM top_cells t JOIN pass p ON p.request_id = t.request_id AND p.cell_id = t.cell_id"""))
def score_response_hex(spark, d):
    compiled, minutes = asked(spark, d)
    out = K.top_cells(tiles(spark, d), compiled, minutes, B.SPECS, ["score", "neighborhood", "district_name", "district_id", "population_est", "lat", "lon"])
    return out.select("request_id", "city", "cell_id", "rank", F.round("lens", 6).alias("lens"), "score",
                      S.place_name().alias("name"), "district_id", "population_est", F.round("lat", 6).alias("lat"),
                      F.round("lon", 6).alias("lon"))


def scores(spark, d):
    """Scored cells of all requests, written once; the queries below read it with the columns they need."""
    return stored(spark, d, "scored", lambda: scored(spark, d))


def compiled(spark, d):
    req = B.requests(spark, d)
    cov = prepared(spark, d).groupBy("city").agg(F.first("coverage").alias("coverage"))
    return S.compile_requests(req, cov, anchors(spark, d, req), B.SPECS)


def crit_column(c):
    return F.col("crit")[CRITERIA.index(c)]


@query("A01_criterion_scores", q("""SELECT request_id, city, cell_id, criterion, round(sc, 6) AS score FROM crit"""))
def criterion_scores(spark, d):
    return S.criterion_long(scores(spark, d)).select("request_id", "city", "cell_id", "criterion",
                                                     F.round("s", 6).alias("score"))


@query("A02_effective_weights", q("SELECT request_id, city, ikey AS indicator, w AS weight FROM weights"))
def effective_weights(spark, d):
    names = "array(" + ", ".join(f"'{s.key}'" for s in B.SPECS) + ")"
    return (compiled(spark, d).selectExpr("request_id", "city", "posexplode(w) AS (j, weight)")
            .selectExpr("request_id", "city", f"{names}[j] AS indicator", "weight"))


@query("A03_commute_score", q("""SELECT request_id, cell_id, round(sc, 6) AS commute FROM crit WHERE criterion = 'commute'"""))
def commute_score(spark, d):
    return (scores(spark, d).select("request_id", "cell_id", F.round(crit_column("commute"), 6).alias("commute"))
            .where("commute IS NOT NULL"))


@query("A04_match_score", q(f"""SELECT m.request_id, m.cell_id, round(m.mf, 6) AS mf,
 CAST(least(greatest({half_even('m.mf')}, 0), 100) AS INTEGER) AS score, coalesce(x.excluded, '') AS excluded
 FROM mf m LEFT JOIN (SELECT request_id, string_agg(criterion, ',' ORDER BY i) AS excluded FROM cw
 WHERE level > 0 AND NOT has GROUP BY 1) x USING (request_id)"""))
def match_score(spark, d):
    return scores(spark, d).select("request_id", "cell_id", F.round("mf", 6).alias("mf"), "score",
                                   F.array_join("excluded", ",").alias("excluded"))


@query("A05_city_medians", q("SELECT request_id, criterion, round(med, 6) AS median FROM crit_median"))
def city_medians(spark, d):
    return S.criterion_medians(scores(spark, d)).select("request_id", "criterion", F.round("median", 6).alias("median"))


GROUP_SQL = {
    "grp_member": """SELECT 'district' AS level, city, cell_id, district_id AS group_id, habitable, population_est, lat, lon,
 district_id, district_name FROM cells UNION ALL SELECT 'neighborhood', city, cell_id, neighborhood, habitable, population_est,
 lat, lon, district_id, district_name FROM cells WHERE neighborhood <> ''""",
    "grp_score": """SELECT g.level, p.request_id, p.city, g.group_id, sum(p.mf * (g.population_est + 1.0)) / sum(g.population_est + 1.0) AS score,
 avg(CASE WHEN p.passing THEN 1.0 ELSE 0.0 END) AS share, count(*) AS cell_count,
 sum(x.v * (g.population_est + 1.0)) / sum(CASE WHEN x.v IS NOT NULL THEN g.population_est + 1.0 END) AS price_value
 FROM pass p JOIN grp_member g ON g.city = p.city AND g.cell_id = p.cell_id JOIN price_col pc ON pc.city = p.city
 LEFT JOIN raw_long x ON x.city = p.city AND x.cell_id = p.cell_id AND x.ikey = pc.pcol
 WHERE p.habitable GROUP BY 1, 2, 3, 4 HAVING bool_or(p.passing)""",
    "grp_crit": """SELECT g.level, c.request_id, g.group_id, c.criterion, sum(c.sc * (g.population_est + 1.0)) / sum(g.population_est + 1.0) AS sc
 FROM crit c JOIN grp_member g ON g.city = c.city AND g.cell_id = c.cell_id WHERE c.habitable GROUP BY 1, 2, 3, 4""",
    "grp_min": """SELECT g.level, a.request_id, g.group_id, a.aid, CAST(trunc(median(a.minutes)) AS INTEGER) AS med
 FROM cell_anchor a JOIN grp_member g ON g.city = a.city AND g.cell_id = a.cell_id WHERE a.habitable GROUP BY 1, 2, 3, 4""",
    "grp_key": """SELECT s.*, (CASE WHEN c.sc IS NOT NULL THEN c.sc WHEN r.rank_by LIKE 'anchor:%' AND m.request_id IS NOT NULL
 THEN -coalesce(m.med, 255) ELSE s.score END) AS gkey, r.lim FROM grp_score s JOIN req r USING (request_id)
 LEFT JOIN grp_crit c ON c.level = s.level AND c.request_id = s.request_id AND c.group_id = s.group_id AND c.criterion = r.rank_by
 LEFT JOIN grp_min m ON m.level = s.level AND m.request_id = s.request_id AND m.group_id = s.group_id AND 'anchor:' || m.aid = r.rank_by""",
    "grp_rank": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, request_id ORDER BY round(gkey, 9) DESC,
 round(score, 9) DESC, group_id) AS rank FROM grp_key) WHERE rank <= lim"""}


@query("A06_ranked_groups", q("""SELECT level, request_id, city, group_id, round(score, 6) AS score, round(share, 6) AS share,
 cell_count, round(price_value, 6) AS price_value FROM grp_score""", **GROUP_SQL))
def group_scores(spark, d):
    sc = scores(spark, d)
    parts = [G.group_scores(sc, lv, B.SPECS).select(
        F.lit(lv).alias("level"), "request_id", "city", "group_id", F.round("score", 6).alias("score"),
        F.round("share", 6).alias("share"), "cell_count", F.round("price_value", 6).alias("price_value"))
        for lv in G.LEVELS]
    return parts[0].unionByName(parts[1])


@query("W06_group_topk", q("""SELECT level, request_id, city, group_id, rank, round(gkey, 6) AS group_key FROM grp_rank""", **GROUP_SQL))
def group_topk(spark, d):
    sc = scores(spark, d)
    parts = [G.ranked_groups(sc, lv, B.SPECS).select(F.lit(lv).alias("level"), "request_id", "city", "group_id", "rank",
                                                     F.round("group_key", 6).alias("group_key")) for lv in G.LEVELS]
    return parts[0].unionByName(parts[1])


SUMMARY_SQL = """SELECT level, city, group_id, count(*) AS cells, sum(CASE WHEN habitable THEN 1 ELSE 0 END) AS habitable,
 round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, sum(population_est) AS population FROM grp_member GROUP BY 1, 2, 3"""
PARENT_SQL = """SELECT level, city, group_id, district_id AS parent FROM (SELECT level, city, group_id, district_id,
 row_number() OVER (PARTITION BY level, city, group_id ORDER BY count(*) DESC, district_id) AS rn FROM grp_member
 GROUP BY level, city, group_id, district_id) WHERE rn = 1"""


@query("A07_pool_row", q("""SELECT r.city, r.ikey AS indicator, c.district_id, round(sum(r.v * (c.population_est + 1.0))
 / sum(CASE WHEN r.v IS NOT NULL THEN c.population_est + 1.0 END), 6) AS value, count(r.v) = 0 AS imputed
 FROM raw_long r JOIN cells c USING (city, cell_id) WHERE c.habitable GROUP BY 1, 2, 3"""))
def pool_row(spark, d):
    names = "array(" + ", ".join(f"'{s.key}'" for s in B.SPECS) + ")"
    long = (prepared(spark, d).selectExpr("city", "district_id", "habitable", "population_est", "posexplode(raw) AS (j, v)")
            .withColumn("indicator", F.expr(f"{names}[j]")))
    return G.pool_rows(long, "district_id").withColumn("value", F.round("value", 6))


@query("A08_group_summary", q(f"""SELECT s.*, p.parent FROM ({SUMMARY_SQL}) s JOIN ({PARENT_SQL}) p
 USING (level, city, group_id)""", **GROUP_SQL))
def group_summary(spark, d):
    parts = [G.group_summary(B.grid_cells(spark, d), lv) for lv in G.LEVELS]
    return parts[0].unionByName(parts[1]).select("level", "city", "group_id", "cells", "habitable", F.round("lat", 6).alias("lat"),
                                                 F.round("lon", 6).alias("lon"), "population", "parent")


@query("A18_weighted_coverage", q(f"""SELECT s.city, p.criterion, {half_even('sum(p.base_w * s.coverage) / sum(p.base_w)', 3)} AS coverage,
 {half_even('sum(p.base_w * s.coverage) / sum(p.base_w)', 3)} < 0.5 AS beta
 FROM stats s JOIN spec p USING (j) WHERE NOT p.is_alias AND p.base_w > 0 AND (p.only_city IS NULL OR p.only_city = s.city)
 GROUP BY 1, 2"""))
def weighted_coverage(spark, d):
    return QA.weighted_coverage(C.median_and_coverage(C.long_values(B.cells(spark, d), B.SPECS)), B.SPECS)


@query("A19_price_stats", q("""SELECT r.city, round(median(v), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max
 FROM raw_long r JOIN price_col p ON p.city = r.city AND p.pcol = r.ikey WHERE habitable GROUP BY 1"""))
def price_stats(spark, d):
    p = (prepared(spark, d).where("habitable").select("city", F.expr(X.price_index(B.SPECS, "raw")).alias("v"))
         .where("v IS NOT NULL"))
    ends = p.groupBy("city").agg(F.round(F.min("v"), 6).alias("min"), F.round(F.max("v"), 6).alias("max"))
    return R.medians(p, ["city"], "v").join(ends, "city").withColumn("median", F.round("median", 6))


@query("A20_response_counts", q("""SELECT request_id, city, count(*) AS cells, sum(CASE WHEN habitable THEN 1 ELSE 0 END) AS habitable,
 sum(CASE WHEN passing THEN 1 ELSE 0 END) AS passing FROM pass GROUP BY 1, 2"""))
def response_counts(spark, d):
    return S.response_counts(scores(spark, d))


@query("J24_requests_x_cells", q("""SELECT request_id, city, count(*) AS pairs, round(sum(sc), 4) AS total,
 count(DISTINCT cell_id) AS cells FROM crit WHERE criterion = 'transit' GROUP BY 1, 2"""))
def requests_x_cells(spark, d):
    return (scores(spark, d).where(crit_column("transit").isNotNull()).groupBy("request_id", "city")
            .agg(F.count("*").alias("pairs"), F.round(F.sum(crit_column("transit")), 4).alias("total"),
                 F.count_distinct("cell_id").alias("cells")))


# ------------------------------------------------------------------ filters
def mask_rows(spark, d, prefix):
    return (scores(spark, d).select("request_id", "cell_id", F.inline("masks")).where(F.col("key").startswith(prefix))
            .select("request_id", "cell_id", F.col("key").alias("filter"), "ok"))


def mask_sql(prefix):
    return q(f"SELECT request_id, cell_id, fkey AS filter, ok FROM mask WHERE fkey LIKE '{prefix}%'")


@query("P08_filter_price_max", mask_sql("price"))
def filter_price_max(spark, d):
    return mask_rows(spark, d, "price")


@query("P09_filter_noise_max", mask_sql("noise"))
def filter_noise_max(spark, d):
    return mask_rows(spark, d, "noise")


@query("P10_filter_must_have", mask_sql("mustHave:"))
def filter_must_have(spark, d):
    return mask_rows(spark, d, "mustHave:")


@query("P11_filter_commute_max", mask_sql("commute:"))
def filter_commute_max(spark, d):
    return mask_rows(spark, d, "commute:")


@query("P12_passing_mask", q("SELECT request_id, cell_id, passing FROM pass"))
def passing_mask(spark, d):
    return scores(spark, d).select("request_id", "cell_id", "passing")


@query("P13_relax_hint", q("""SELECT request_id, filter, passing_after FROM (SELECT request_id, filter, passing_after,
 row_number() OVER (PARTITION BY request_id ORDER BY passing_after DESC, ord) AS rn FROM (
 SELECT k.request_id, k.fkey AS filter, k.ord, count(*) FILTER (WHERE o.others) AS passing_after FROM mask k JOIN (
 SELECT a.request_id, a.cell_id, a.fkey, coalesce(bool_and(b.ok) FILTER (WHERE b.fkey <> a.fkey), TRUE) AS others
 FROM mask a JOIN mask b ON b.request_id = a.request_id AND b.cell_id = a.cell_id WHERE a.habitable GROUP BY 1, 2, 3) o
 ON o.request_id = k.request_id AND o.cell_id = k.cell_id AND o.fkey = k.fkey WHERE k.habitable AND k.request_id NOT IN
 (SELECT request_id FROM pass WHERE passing) GROUP BY 1, 2, 3) WHERE passing_after > 0) WHERE rn = 1"""))
def relax_hint(spark, d):
    return S.relax_hints(scores(spark, d))


# ------------------------------------------------------------------ lens, ranking, sorting
@query("W04_rank_lens", q("SELECT request_id, cell_id, round(lens, 6) AS lens FROM lensed"))
def rank_lens(spark, d):
    return scores(spark, d).select("request_id", "cell_id", F.round(S.lens(), 6).alias("lens"))


@query("W05_top_one_per_group", q("SELECT request_id, city, cell_id, rank FROM top_cells"))
def top_one_per_group(spark, d):
    return S.top_cells(scores(spark, d)).select("request_id", "city", "cell_id", "rank")


@query("O01_multi_key_sort", q("""SELECT request_id, cell_id, row_number() OVER (PARTITION BY request_id
 ORDER BY l9 DESC, m9 DESC, cell_id) AS pos FROM lensed WHERE passing"""))
def multi_key_sort(spark, d):
    df = scores(spark, d).where("passing").select("request_id", "cell_id", S.lens().alias("lens"), "mf")
    order = [F.desc(F.round("lens", 9)), F.desc(F.round("mf", 9)), F.asc("cell_id")]
    return R.global_positions(df, ["request_id"], order, "pos").select("request_id", "cell_id", "pos")


@query("O02_limit_topk", q("""SELECT request_id, cell_id, round(mf, 6) AS mf FROM (SELECT *, row_number() OVER (PARTITION BY request_id
 ORDER BY m9 DESC, cell_id) AS pos FROM pass WHERE passing) WHERE pos <= 25"""))
def limit_topk(spark, d):
    df = scores(spark, d).where("passing").select("request_id", "cell_id", "mf")
    return (R.top_per_group(df, ["request_id"], [F.desc(F.round("mf", 9)), F.asc("cell_id")], 25)
            .select("request_id", "cell_id", F.round("mf", 6).alias("mf")))


@query("O03_name_sort", q("""SELECT city, district_name AS name, count(*) AS cells, row_number() OVER (PARTITION BY city
 ORDER BY district_name) AS pos FROM cells GROUP BY 1, 2"""))
def name_sort(spark, d):
    g = G.group_summary(B.grid_cells(spark, d), "district").select("city", "name", "cells")
    return R.global_positions(g, ["city"], [F.asc("name")], "pos")


# ------------------------------------------------------------------ explanations
def top_rows(spark, d):
    sc = scores(spark, d)
    top = written(S.top_cells(sc).select("request_id", "cell_id", "rank"), "top")       # so that scored cells are not shuffled to meet a few of them
    return sc.join(broadcast_if_small(top, 200_000), ["request_id", "cell_id"])


EXPLAIN_SQL = {
    "contrib": """SELECT t.request_id, t.cell_id, k.i, k.criterion, k.cw * (c.sc - m.med) / sum(k.cw) OVER (PARTITION BY t.request_id, t.cell_id) AS k,
 k.level FROM top_cells t JOIN cw k ON k.request_id = t.request_id AND k.cw > 0
 JOIN crit c ON c.request_id = t.request_id AND c.cell_id = t.cell_id AND c.criterion = k.criterion
 JOIN crit_median m ON m.request_id = t.request_id AND m.criterion = k.criterion""",
    "picked": f"""SELECT request_id, cell_id, criterion, kind, indicator, value, unit, decimals, CAST(NULL AS VARCHAR) AS anchor, CAST(NULL AS VARCHAR) AS mode FROM (
 SELECT s.request_id, s.cell_id, s.criterion, x.kind, p.col AS indicator, s.v AS value, p.unit, p.decimals, row_number() OVER (
 PARTITION BY s.request_id, s.cell_id, s.criterion, x.kind ORDER BY CASE WHEN x.kind = 'best' THEN -s.w * s.s ELSE s.s END, -s.w, s.j) AS rn
 FROM sub s JOIN top_cells t ON t.request_id = s.request_id AND t.cell_id = s.cell_id JOIN spec p ON p.j = s.j
 CROSS JOIN (VALUES ('best'), ('worst')) AS x(kind) WHERE s.w > 0 AND NOT s.imputed AND
 ((x.kind = 'best' AND s.s >= 60) OR (x.kind = 'worst' AND s.s <= 40 AND NOT p.nowarn))) WHERE rn = 1
 UNION ALL SELECT request_id, cell_id, 'commute', kind, NULL, CAST(minutes AS DOUBLE), 'min', 0, anchor, mode FROM (
 SELECT a.request_id, a.cell_id, x.kind, a.minutes, coalesce(u.label, u.aid) AS anchor, u.mode, row_number() OVER (PARTITION BY a.request_id,
 a.cell_id, x.kind ORDER BY CASE WHEN x.kind = 'best' THEN a.minutes ELSE -a.minutes END, a.pos) AS rn FROM cell_anchor a
 JOIN top_cells t ON t.request_id = a.request_id AND t.cell_id = a.cell_id
 JOIN usable_anchor u ON u.request_id = a.request_id AND u.pos = a.pos
 CROSS JOIN (VALUES ('best'), ('worst')) AS x(kind) WHERE a.minutes IS NOT NULL) WHERE rn = 1""",
    "explained": """SELECT * FROM (SELECT c.request_id, c.cell_id, CASE WHEN c.k > 0 THEN 'highlight' ELSE 'warning' END AS kind,
 c.criterion, p.indicator, p.value, p.unit, p.decimals, p.anchor, p.mode, c.k, row_number() OVER (PARTITION BY c.request_id, c.cell_id,
 c.k > 0 ORDER BY -abs(round(c.k, 9)), CASE WHEN c.k > 0 THEN c.i ELSE -c.i END) AS pos FROM contrib c
 JOIN picked p ON p.request_id = c.request_id AND p.cell_id = c.cell_id AND p.criterion = c.criterion
 AND p.kind = CASE WHEN c.k > 0 THEN 'best' ELSE 'worst' END WHERE c.level > 0 AND round(c.k, 9) <> 0)
 WHERE pos <= CASE WHEN kind = 'highlight' THEN 2 ELSE 1 END"""}


@query("W17_criterion_contribution", q("""SELECT request_id, cell_id, criterion, round(k, 6) AS k, row_number() OVER (
 PARTITION BY request_id, cell_id ORDER BY round(k, 9) DESC, i) AS pos FROM contrib WHERE level > 0""", **EXPLAIN_SQL))
def criterion_contribution(spark, d):
    sc = scores(spark, d)
    k = X.contributions(top_rows(spark, d), S.criterion_medians(sc))
    return (R.top_per_group(k, ["request_id", "cell_id"], [F.desc(F.round("k", 9)), F.asc("i")], len(CRITERIA), "pos")
            .select("request_id", "cell_id", "criterion", F.round("k", 6).alias("k"), "pos"))


@query("E05_explain_pick", q("""SELECT request_id, cell_id, criterion, kind, indicator, round(value, 6) AS value, unit FROM picked""",
                             **EXPLAIN_SQL))
def explain_pick(spark, d):
    return X.picks(top_rows(spark, d), B.SPECS).select("request_id", "cell_id", "criterion", "kind", "indicator",
                                                       F.round("value", 6).alias("value"), "unit")


def templates(spark):
    """Sentence templates by rule: the indicator's name, its value and unit, per language."""
    rows = [(s.column, lg, f"{s.column.split('.')[1].replace('_', ' ')}: {{{{value}}}} {s.unit} [{lg}]")
            for s in B.SPECS if not s.is_alias for lg in LANGS]
    rows += [(None, lg, "{{anchor}}: {{value}} min {{mode}} [" + lg + "]") for lg in LANGS]
    return spark.createDataFrame(rows, "indicator string, lang string, text string")


def mode_phrases(spark):
    rows = [(m, lg, f"by {m} ({lg})") for m in ("transit", "bike", "walk") for lg in LANGS]
    return spark.createDataFrame(rows, "mode string, lang string, phrase string")


def fmt_sql(v, lang, dec):
    s0 = f"format('{{:,}}', CAST(round_even(round({v}, 9), 0) AS BIGINT))"
    t = f"CAST(round_even(round(abs({v}), 9) * 10, 0) AS BIGINT)"
    whole = f"CASE WHEN {dec} > 0 THEN (CASE WHEN {v} < 0 AND {t} > 0 THEN '-' ELSE '' END) || format('{{:,}}', {t} // 10) ELSE {s0} END"
    frac = f"CASE WHEN {dec} > 0 THEN CAST({t} % 10 AS VARCHAR) END"
    digits = f"length(replace(replace({whole}, ',', ''), '-', ''))"
    grouped = (f"CASE WHEN {digits} >= CASE WHEN {lang} = 'pl' THEN 5 ELSE 4 END THEN replace({whole}, ',', chr(160)) "
               f"ELSE replace({whole}, ',', '') END")
    return (f"CASE WHEN {lang} IN ('pl', 'cs') THEN {grouped} || coalesce(',' || {frac}, '') "
            f"ELSE {whole} || coalesce('.' || {frac}, '') END")


def display_sql(v, unit, lang, dec):
    return f"CASE WHEN {unit} = 'min' AND {v} < 1 THEN '<1' ELSE {fmt_sql(v, lang, dec)} END"


@query("E06_indicator_text", q(f"""SELECT e.request_id, e.cell_id, e.kind, e.pos, e.criterion, {half_even('e.value', 2)} AS value, l.lang,
 CASE WHEN e.indicator IS NOT NULL THEN replace(split_part(e.indicator, '.', 2), '_', ' ') || ': ' || {display_sql('e.value', 'e.unit', 'l.lang', 'e.decimals')}
 || ' ' || e.unit || ' [' || l.lang || ']' ELSE e.anchor || ': ' || {display_sql('e.value', "'min'", 'l.lang', '0')} || ' min by ' || e.mode ||
 ' (' || l.lang || ') [' || l.lang || ']' END AS text FROM explained e CROSS JOIN (VALUES ('pl'), ('cs'), ('en'), ('ko')) AS l(lang)""", **EXPLAIN_SQL))
def indicator_text(spark, d):
    rows = top_rows(spark, d)
    hw = X.highlights_and_warnings(X.contributions(rows, S.criterion_medians(scores(spark, d))), X.picks(rows, B.SPECS))
    hw = hw.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in LANGS])))
    out = X.sentences(hw, templates(spark), mode_phrases(spark), F.col("lang"))
    return out.select("request_id", "cell_id", "kind", "pos", "criterion", he(F.col("value"), 2).alias("value"), "lang", "text")


@query("F21_budget_area", q(f"""SELECT t.request_id, t.cell_id, CAST({half_even(f"r.budget / nullif({half_even('f.f', 1)}, 0)")} AS BIGINT) AS budget_m2
 FROM top_cells t JOIN req r USING (request_id) JOIN price_col p ON p.city = t.city
 JOIN filled f ON f.city = t.city AND f.cell_id = t.cell_id AND f.ikey = p.pcol"""))
def budget_area(spark, d):
    return X.price_and_budget(top_rows(spark, d), B.SPECS).select("request_id", "cell_id", "budget_m2")


@query("F22_price_with_flag", q(f"""SELECT t.request_id, t.cell_id, {half_even('f.f', 1)} AS price, f.imputed AS price_imputed,
 CASE t.city WHEN 'praha' THEN 'CZK' ELSE 'PLN' END AS currency FROM top_cells t JOIN price_col p ON p.city = t.city
 JOIN filled f ON f.city = t.city AND f.cell_id = t.cell_id AND f.ikey = p.pcol"""))
def price_with_flag(spark, d):
    return X.price_and_budget(top_rows(spark, d), B.SPECS).select("request_id", "cell_id", "price", "price_imputed", "currency")


@query("F26_clip_levels", q("SELECT l.request_id, l.criterion, l.level, w.lw AS weight FROM levels l JOIN level_weight w USING (level)"))
def clip_levels(spark, d):
    names = "array(" + ", ".join(f"'{c}'" for c in CRITERIA) + ")"
    return (compiled(spark, d).selectExpr("request_id", "posexplode(lv) AS (i, level)")
            .selectExpr("request_id", f"{names}[i] AS criterion", "level", f"{S.level_weight('level')} AS weight"))


@query("F28_imputed_list", q("""SELECT t.request_id, t.cell_id, coalesce(string_agg(DISTINCT x.col, ',' ORDER BY x.col), '') AS imputed FROM top_cells t
 LEFT JOIN (SELECT s.request_id, s.cell_id, p.col FROM sub s JOIN spec p ON p.j = s.j JOIN cw k ON k.request_id = s.request_id
 AND k.criterion = s.criterion AND k.cw > 0 WHERE s.imputed AND s.w > 0) x ON x.request_id = t.request_id AND x.cell_id = t.cell_id
 GROUP BY 1, 2"""))
def imputed_list(spark, d):
    return top_rows(spark, d).select("request_id", "cell_id", F.array_join(X.imputed_columns(B.SPECS), ",").alias("imputed"))


@query("E04_default_criteria", q(f"""SELECT city, cell_id, criterion, round(sc, 6) AS score FROM crit
 WHERE request_id IN ({', '.join(map(str, B.CUSTOM_ID.values()))})"""))
def default_criteria(spark, d):
    custom = scores(spark, d).where(F.col("request_id").isin(list(B.CUSTOM_ID.values())))
    return S.criterion_long(custom).select("city", "cell_id", "criterion", F.round("s", 6).alias("score"))


@query("E14_no_effective_weights", q("""SELECT request_id, NOT bool_or(level > 0 AND has) AS none_rated FROM cw GROUP BY 1"""))
def no_effective_weights(spark, d):
    return compiled(spark, d).selectExpr(
        "request_id", f"NOT exists(sequence(0, {len(CRITERIA) - 1}), i -> lv[i] > 0 AND den[i] > 0) AS none_rated")


LENS = [c for c in CRITERIA if c != "commute"]          # commute needs anchors


@query("E15_single_criterion_lens", q(f"""SELECT criterion, city, cell_id, CAST({half_even('sc')} AS INTEGER) AS score FROM crit
 WHERE criterion IN ({', '.join(repr(c) for c in LENS)}) AND request_id IN ({', '.join(map(str, B.CUSTOM_ID.values()))})"""))
def single_criterion_lens(spark, d):
    """A request that rates one criterion only returns that criterion's score as its match."""
    rows = [dict(request_id=900 + i * len(LENS) + j, city=c, persona="custom", weights={k: 5 if k == only else 0 for k in CRITERIA})
            for i, c in enumerate(CITIES) for j, only in enumerate(LENS)]
    name = F.array(*[F.lit(c) for c in LENS])[(F.col("request_id") - 900) % len(LENS)]
    return scored(spark, d, rows).where("score IS NOT NULL").select(name.alias("criterion"), "city", "cell_id", "score")


@query("E07_commute_map", q("""SELECT a.request_id, u.aid AS anchor, a.cell_id, a.minutes FROM cell_anchor a JOIN usable_anchor u
 ON u.request_id = a.request_id AND u.pos = a.pos WHERE a.minutes <= 120"""))
def commute_map(spark, d):
    req = B.requests(spark, d)
    a = anchors(spark, d, req).where("usable")
    t = B.travel(spark, d).where("minutes <= 120").withColumnRenamed("origin", "cell_id")
    return a.join(t, ["city", "mode", "dest"]).select("request_id", F.col("id").alias("anchor"), "cell_id", "minutes")


@query("J16_travel_time_to_anchor", q("SELECT request_id, pos, cell_id, minutes FROM cell_anchor"))
def travel_time_to_anchor(spark, d):
    req = B.requests(spark, d)
    a = anchors(spark, d, req).where("usable").select("request_id", "city", "pos", "mode", "dest")
    cells = B.grid_cells(spark, d).select("city", "cell_id")
    t = B.travel(spark, d).withColumnRenamed("origin", "cell_id")
    return (cells.join(a, "city").join(t, ["city", "mode", "dest", "cell_id"], "left")
            .select("request_id", "pos", "cell_id", "minutes"))
