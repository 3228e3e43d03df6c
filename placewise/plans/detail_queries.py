"""Registered queries: whole answers for places and groups, with their explanations."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import CRITERIA
from ..functions.norm import half_even as he
from ..functions.text import display_value
from ..operators import archetypes as AR, explain as X, groups as G, scoring as S, spatial as SP
from ..session import stored
from . import bindings as B
from .model_queries import PSQL, probabilities
from .oracle import half_even, q
from .registry import query
from .scoring_queries import (EXPLAIN_SQL, GROUP_SQL, PARENT_SQL, SUMMARY_SQL, display_sql, mode_phrases, prepared, scores, templates,
                              top_rows)

LANG = "en"
TEXT = """CASE WHEN e.indicator IS NOT NULL THEN replace(split_part(e.indicator, '.', 2), '_', ' ') || ': ' || """ + display_sql("e.value", "e.unit", "'en'", "e.decimals") + """
 || ' ' || e.unit || ' [en]' ELSE e.anchor || ': ' || """ + display_sql("e.value", "'min'", "'en'", "0") + """ || ' min by ' || e.mode || ' (en) [en]' END"""

GROUP_DETAIL_SQL = {
    **GROUP_SQL, **PSQL,
    "grp_sub": """SELECT k.level, k.request_id, k.group_id, s.criterion, s.j, s.w, sum(s.s * (g.population_est + 1.0)) / sum(g.population_est + 1.0) AS s,
 sum(s.v * (g.population_est + 1.0)) / sum(CASE WHEN s.v IS NOT NULL THEN g.population_est + 1.0 END) AS v, count(s.v) = 0 AS imputed
 FROM grp_rank k JOIN grp_member g ON g.level = k.level AND g.city = k.city AND g.group_id = k.group_id
 JOIN sub s ON s.request_id = k.request_id AND s.cell_id = g.cell_id WHERE g.habitable GROUP BY 1, 2, 3, 4, 5, 6""",
    "grp_contrib": """SELECT t.level, t.request_id, t.group_id, k.i, k.criterion, k.cw * (c.sc - m.med) / sum(k.cw) OVER (PARTITION BY t.level, t.request_id, t.group_id) AS k,
 k.level AS lv FROM grp_rank t JOIN cw k ON k.request_id = t.request_id AND k.cw > 0
 JOIN grp_crit c ON c.level = t.level AND c.request_id = t.request_id AND c.group_id = t.group_id AND c.criterion = k.criterion
 JOIN crit_median m ON m.request_id = t.request_id AND m.criterion = k.criterion""",
    "grp_anchor": """SELECT t.level, t.request_id, t.group_id, u.pos, u.aid, u.label, u.mode, m.med AS minutes FROM grp_rank t JOIN usable_anchor u ON u.request_id = t.request_id
 LEFT JOIN grp_min m ON m.level = t.level AND m.request_id = t.request_id AND m.group_id = t.group_id AND m.aid = u.aid""",
    "grp_picked": """SELECT level, request_id, group_id, criterion, kind, indicator, value, unit, decimals, CAST(NULL AS VARCHAR) AS anchor, CAST(NULL AS VARCHAR) AS mode FROM (
 SELECT s.level, s.request_id, s.group_id, s.criterion, x.kind, p.col AS indicator, s.v AS value, p.unit, p.decimals, row_number() OVER (
 PARTITION BY s.level, s.request_id, s.group_id, s.criterion, x.kind ORDER BY CASE WHEN x.kind = 'best' THEN -s.w * s.s ELSE s.s END, -s.w, s.j) AS rn
 FROM grp_sub s JOIN spec p ON p.j = s.j CROSS JOIN (VALUES ('best'), ('worst')) AS x(kind) WHERE s.w > 0 AND NOT s.imputed AND
 ((x.kind = 'best' AND s.s >= 60) OR (x.kind = 'worst' AND s.s <= 40 AND NOT p.nowarn))) WHERE rn = 1
 UNION ALL SELECT level, request_id, group_id, 'commute', kind, NULL, CAST(minutes AS DOUBLE), 'min', 0, anchor, mode FROM (
 SELECT a.level, a.request_id, a.group_id, x.kind, a.minutes, coalesce(a.label, a.aid) AS anchor, a.mode, row_number() OVER (PARTITION BY a.level, a.request_id,
 a.group_id, x.kind ORDER BY CASE WHEN x.kind = 'best' THEN a.minutes ELSE -a.minutes END, a.pos) AS rn FROM grp_anchor a
 CROSS JOIN (VALUES ('best'), ('worst')) AS x(kind) WHERE a.minutes IS NOT NULL) WHERE rn = 1""",
    "grp_explained": f"""SELECT e.*, {TEXT} AS text FROM (SELECT c.level, c.request_id, c.group_id, CASE WHEN c.k > 0 THEN 'highlight' ELSE 'warning' END AS kind,
 c.criterion, p.indicator, p.value, p.unit, p.decimals, p.anchor, p.mode, row_number() OVER (PARTITION BY c.level, c.request_id, c.group_id,
 c.k > 0 ORDER BY -abs(round(c.k, 9)), CASE WHEN c.k > 0 THEN c.i ELSE -c.i END) AS pos FROM grp_contrib c
 JOIN grp_picked p ON p.level = c.level AND p.request_id = c.request_id AND p.group_id = c.group_id AND p.criterion = c.criterion
 AND p.kind = CASE WHEN c.k > 0 THEN 'best' ELSE 'worst' END WHERE c.lv > 0 AND round(c.k, 9) <> 0) e
 WHERE pos <= CASE WHEN kind = 'highlight' THEN 2 ELSE 1 END""",
    "grp_arch": """SELECT level, city, group_id, arg_min(k, (-round(p, 9), k)) AS archetype, round(max(p), 3) AS p FROM (SELECT g.level, g.city, g.group_id, a.k,
 sum(a.p * (g.population_est + 1.0)) / any_value(t.w) AS p FROM grp_member g JOIN pp a ON a.cell_id = g.cell_id JOIN (SELECT level, city, group_id, sum(population_est + 1.0) AS w FROM grp_member
 WHERE habitable GROUP BY 1, 2, 3) t ON t.level = g.level AND t.city = g.city AND t.group_id = g.group_id WHERE g.habitable GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""}


def ranked(spark, d, level):
    """The ranked groups of a level with their pooled rows: written once, read by the answers below."""
    top = stored(spark, d, f"ranked-{level}", lambda: G.ranked_groups(scores(spark, d), level, B.SPECS))
    return top, stored(spark, d, f"pooled-{level}", lambda: G.group_rows(scores(spark, d), top, level, B.SPECS))


def medians(spark, d):
    return stored(spark, d, "criterion-medians", lambda: S.criterion_medians(scores(spark, d)))


def listed(said: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, highlights, warnings): the sentences of each in order."""
    of = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "text")))), lambda t: t["text"]), " | ")
    return said.groupBy(*keys).agg(of("highlight").alias("highlights"), of("warning").alias("warnings"))


def group_archetypes(spark, d, level):
    p = probabilities(spark, d).join(B.grid_cells(spark, d).where("habitable").select("city", "cell_id", "neighborhood"), ["city", "cell_id"])
    p = p.withColumn("group_id", G.group_id(level)).where("group_id IS NOT NULL")
    return AR.group_archetype(p, ["city", "group_id"], F.col("population_est") + F.lit(1.0)).select("city", "group_id", "archetype", F.col("p").alias("archetype_p"))


@query("E02_score_response_group", q(f"""SELECT k.level, k.request_id, k.city, k.group_id, k.rank,
 CAST({half_even('k.score')} AS INTEGER) AS score, {half_even('k.share', 3)} AS share_passing, k.cell_count, s.population,
 s.lat, s.lon, {half_even('coalesce(k.price_value, st.med)', 1)} AS price, k.price_value IS NULL AS price_imputed,
 CASE WHEN k.level = 'neighborhood' THEN p.parent END AS parent,
 CAST({half_even(f"r.budget / nullif({half_even('coalesce(k.price_value, st.med)', 1)}, 0)")} AS BIGINT) AS budget_m2, cr.criteria, coalesce(ex.highlights, '') AS highlights,
 coalesce(ex.warnings, '') AS warnings, coalesce(an.anchors, '') AS anchors, coalesce(im.imputed, '') AS imputed, ga.archetype, ga.p AS archetype_p
 FROM grp_rank k JOIN ({SUMMARY_SQL}) s ON s.level = k.level AND s.city = k.city AND s.group_id = k.group_id
 JOIN ({PARENT_SQL}) p ON p.level = k.level AND p.city = k.city AND p.group_id = k.group_id
 JOIN price_col pc ON pc.city = k.city JOIN spec sp ON sp.ikey = pc.pcol JOIN stats st ON st.city = k.city AND st.j = sp.j JOIN req r ON r.request_id = k.request_id
 JOIN (SELECT level, request_id, group_id, string_agg(criterion || ':' || CAST({half_even('sc')} AS INTEGER), ',' ORDER BY i) AS criteria FROM grp_crit JOIN crits USING (criterion) GROUP BY 1, 2, 3) cr
 ON cr.level = k.level AND cr.request_id = k.request_id AND cr.group_id = k.group_id
 LEFT JOIN (SELECT level, request_id, group_id, string_agg(text, ' | ' ORDER BY pos) FILTER (WHERE kind = 'highlight') AS highlights, string_agg(text, ' | ' ORDER BY pos) FILTER (WHERE kind = 'warning') AS warnings
 FROM grp_explained GROUP BY 1, 2, 3) ex ON ex.level = k.level AND ex.request_id = k.request_id AND ex.group_id = k.group_id
 LEFT JOIN (SELECT level, request_id, group_id, string_agg(aid || ':' || coalesce(CAST(minutes AS VARCHAR), ''), ',' ORDER BY pos) AS anchors FROM grp_anchor GROUP BY 1, 2, 3) an
 ON an.level = k.level AND an.request_id = k.request_id AND an.group_id = k.group_id
 LEFT JOIN (SELECT s.level, s.request_id, s.group_id, string_agg(DISTINCT p.col, ',' ORDER BY p.col) AS imputed FROM grp_sub s JOIN spec p USING (j) JOIN cw c ON c.request_id = s.request_id AND c.criterion = s.criterion
 AND c.cw > 0 WHERE s.imputed AND s.w > 0 GROUP BY 1, 2, 3) im ON im.level = k.level AND im.request_id = k.request_id AND im.group_id = k.group_id
 JOIN grp_arch ga ON ga.level = k.level AND ga.city = k.city AND ga.group_id = k.group_id""", **GROUP_DETAIL_SQL))
def score_response_group(spark, d):
    """Ranked groups with all that a cell's answer has: criteria, sentences, minutes, price, budget, archetype."""
    cells, keys, out = prepared(spark, d), ["request_id", "group_id"], []
    for lv in G.LEVELS:
        top, pooled = ranked(spark, d, lv)
        said = listed(X.spoken(pooled, medians(spark, d), B.SPECS, templates(spark), mode_phrases(spark), F.lit(LANG), keys), keys)
        times = F.array_join(F.transform(X.anchor_times(), lambda a: F.concat(a["id"], F.lit(":"), F.coalesce(a["minutes"].cast("string"), F.lit("")))), ",")
        rows = X.price_and_budget(pooled, B.SPECS).select(*keys, X.rounded_criteria().alias("criteria"), F.when(F.col("anchor_slots").isNotNull(), times).otherwise("").alias("anchors"), "price",
                                                         "price_imputed", "budget_m2", F.array_join(X.imputed_columns(B.SPECS), ",").alias("imputed"))
        rows = top.join(rows, keys).join(said, keys, "left").join(group_archetypes(spark, d, lv), ["city", "group_id"])
        rows = rows.join(G.group_summary(cells, lv).select("city", "group_id", "population", "lat", "lon", "parent"), ["city", "group_id"])
        out.append(rows.select(
            F.lit(lv).alias("level"), "request_id", "city", "group_id", "rank", he(F.col("score")).cast("int").alias("score"), he(F.col("share"), 3).alias("share_passing"), "cell_count", "population",
            F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "price", "price_imputed", (F.col("parent") if lv == "neighborhood" else F.lit(None).cast("string")).alias("parent"), "budget_m2",
            "criteria", F.coalesce("highlights", F.lit("")).alias("highlights"), F.coalesce("warnings", F.lit("")).alias("warnings"), "anchors", "imputed", "archetype", "archetype_p"))
    return out[0].unionByName(out[1])


@query("E16_anchor_times", q("""SELECT 'hex' AS kind, t.request_id, CAST(t.cell_id AS VARCHAR) AS place, u.pos, u.aid AS id, u.label, a.minutes, u.mode FROM top_cells t
 JOIN cell_anchor a ON a.request_id = t.request_id AND a.cell_id = t.cell_id JOIN usable_anchor u ON u.request_id = a.request_id AND u.pos = a.pos
 UNION ALL SELECT level, request_id, group_id, pos, aid, label, minutes, mode FROM grp_anchor""", **GROUP_DETAIL_SQL))
def anchor_times(spark, d):
    """Minutes to the anchors: of ranked places, and as truncated medians of the ranked groups."""
    def told(rows, kind, place):
        return (rows.where("anchor_slots IS NOT NULL").withColumn("a", X.anchor_times()).selectExpr("request_id", f"cast({place} AS string) AS place", "posexplode(a) AS (pos, a)")
                .select(F.lit(kind).alias("kind"), "request_id", "place", "pos", "a.*"))
    out = told(top_rows(spark, d), "hex", "cell_id")
    for lv in G.LEVELS:
        out = out.unionByName(told(ranked(spark, d, lv)[1], lv, "group_id"))
    return out


CELL_TEXT = TEXT.replace("e.indicator", "p.col").replace("e.value", "s.v").replace("e.unit", "p.unit").replace("e.decimals", "p.decimals").replace("e.anchor", "''").replace("e.mode", "''")
DETAIL_SQL = {
    **EXPLAIN_SQL, **PSQL,
    "place1": "SELECT t.request_id, t.city, t.cell_id FROM top_cells t WHERE t.rank = 1",
    "near1": """SELECT city, cell_id, category, name, km * 1.3 / 4.8 * 60.0 AS walk0 FROM (SELECT c.city, c.cell_id, p.category, p.name, 6371.0088 * 2 * asin(sqrt(pow(sin((radians(p.lat) - radians(c.lat)) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat))
 * pow(sin((radians(p.lon) - radians(c.lon)) / 2), 2))) AS km, row_number() OVER (PARTITION BY c.cell_id, p.category ORDER BY round(sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)), 6), p.poi_id) AS rn
 FROM cells c JOIN (SELECT DISTINCT cell_id FROM place1) k ON k.cell_id = c.cell_id JOIN pois p ON p.city = c.city) WHERE rn = 1""",
    "near2": """SELECT city, cell_id, category, name, walk, row_number() OVER (PARTITION BY cell_id ORDER BY category) - 1 AS pos FROM (SELECT n.*, coalesce(CASE WHEN category = 'supermarket' THEN f."shops.supermarket_walk_min" END, walk0) AS walk
 FROM near1 n JOIN feats f USING (cell_id)) WHERE walk <= 30"""}


@query("E03_place_detail", q(f"""SELECT s.request_id, s.cell_id, 'indicator' AS section, CAST(s.j AS INTEGER) AS pos, s.ikey AS name, CASE WHEN s.imputed THEN NULL ELSE round_even(round(s.v, 9), greatest(p.decimals, 2)) END AS value,
 CAST({half_even('s.s')} AS INTEGER) AS score, s.w AS weight, round_even(round(s.med, 9), greatest(p.decimals, 1)) AS median, s.imputed AS flag, CASE WHEN NOT s.imputed AND NOT p.is_alias THEN {CELL_TEXT} END AS text FROM sub s
 JOIN place1 t ON t.request_id = s.request_id AND t.cell_id = s.cell_id JOIN spec p ON p.j = s.j JOIN stats st ON st.city = s.city AND st.j = s.j WHERE st.coverage > 0 AND NOT (p.is_alias AND s.w <= 0)
 UNION ALL SELECT c.request_id, c.cell_id, 'criterion', k.i, c.criterion, CAST(NULL AS DOUBLE), CAST({half_even('c.sc')} AS INTEGER), CAST(NULL AS DOUBLE), {half_even('m.med')}, CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR) FROM crit c JOIN place1 t
 ON t.request_id = c.request_id AND t.cell_id = c.cell_id JOIN crits k USING (criterion) JOIN crit_median m ON m.request_id = c.request_id AND m.criterion = c.criterion
 UNION ALL SELECT t.request_id, t.cell_id, 'nearest', n.pos, n.category, {half_even('n.walk', 1)}, NULL, NULL, NULL, NULL, n.name FROM place1 t JOIN near2 n ON n.city = t.city AND n.cell_id = t.cell_id
 UNION ALL SELECT t.request_id, t.cell_id, 'anchor', u.pos, u.aid, a.minutes, NULL, NULL, NULL, a.minutes IS NOT NULL, u.mode FROM place1 t JOIN cell_anchor a ON a.request_id = t.request_id AND a.cell_id = t.cell_id
 JOIN usable_anchor u ON u.request_id = a.request_id AND u.pos = a.pos
 UNION ALL SELECT t.request_id, t.cell_id, 'price', 0, CASE t.city WHEN 'praha' THEN 'CZK' ELSE 'PLN' END, {half_even('f.f', 1)}, NULL, NULL, {half_even(f"r.budget / nullif({half_even('f.f', 1)}, 0)")}, f.imputed, NULL
 FROM place1 t JOIN req r USING (request_id) JOIN price_col p ON p.city = t.city JOIN filled f ON f.city = t.city AND f.cell_id = t.cell_id AND f.ikey = p.pcol
 UNION ALL SELECT t.request_id, t.cell_id, 'archetype', row_number() OVER (PARTITION BY t.request_id, t.cell_id ORDER BY round(a.p, 9) DESC, a.k) - 1, a.k, round(a.p, 3), NULL, NULL, NULL, NULL, NULL
 FROM place1 t JOIN (SELECT cell_id, k, sum(p) AS p FROM pp GROUP BY 1, 2) a ON a.cell_id = t.cell_id WHERE a.p >= 0.005
 UNION ALL SELECT e.request_id, e.cell_id, e.kind, e.pos, e.criterion, {half_even('e.value', 2)}, NULL, NULL, NULL, NULL, {TEXT} FROM explained e JOIN place1 t ON t.request_id = e.request_id AND t.cell_id = e.cell_id""", **DETAIL_SQL))
def place_detail(spark, d):
    """Everything about the first place of each request, one row per item: indicators, criteria with the city's median, nearest
    places, anchors, price (median: the area the budget buys), archetype, highlights and warnings."""
    first, keys = stored(spark, d, "first-places", lambda: top_rows(spark, d).where("rank = 1")), ["request_id", "cell_id"]
    long = X.indicator_rows(first, B.SPECS, keys).where("coverage > 0 AND NOT (is_alias AND w <= 0)")
    text = templates(spark).where(F.col("lang") == LANG).where("indicator IS NOT NULL").select(F.col("indicator").alias("col"), F.col("text").alias("template"))
    known = F.when(~F.col("imputed"), F.col("v"))
    to = lambda c, least: F.expr(f"CASE decimals {' '.join(f'WHEN {n} THEN bround(round({c}, 9), {max(n, least)})' for n in sorted({s.decimals for s in B.SPECS}))} END")
    said = F.replace("template", F.lit("{{value}}"), display_value(F.col("v"), F.col("unit"), F.lit(LANG), F.col("decimals")))
    parts = [long.join(F.broadcast(text), "col", "left").withColumn("known", known).select(
        *keys, F.lit("indicator").alias("section"), F.col("j").alias("pos"), F.col("ikey").alias("name"), to("known", 2).alias("value"), he(F.col("s")).cast("int").alias("score"), F.col("w").alias("weight"),
        to("med", 1).alias("median"), F.col("imputed").alias("flag"), F.when(~F.col("imputed") & ~F.col("is_alias"), said).alias("text"))]

    def part(df: DataFrame, section: str, **columns) -> None:
        want = {"pos": "int", "name": "string", "value": "double", "score": "int", "weight": "double", "median": "double", "flag": "boolean", "text": "string"}
        sec = F.lit(section) if section != "kind" else F.col("kind")
        parts.append(df.select(*keys, sec.alias("section"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in want.items()]))
    names = F.array(*[F.lit(c) for c in CRITERIA])
    crit = first.select(*keys, F.posexplode("crit").alias("i", "sc")).where("sc IS NOT NULL").join(medians(spark, d).select("request_id", "i", "median"), ["request_id", "i"])
    part(crit, "criterion", pos=F.col("i"), name=names[F.col("i")], score=he(F.col("sc")), median=he(F.col("median")))
    near = nearest(spark, d, first.select("city", "cell_id").distinct())
    part(first.select(*keys, "city").join(near, ["city", "cell_id"]), "nearest", pos=F.col("pos"), name=F.col("category"), value=he(F.col("walk_min"), 1), text=F.col("name"))
    at = first.where("anchor_slots IS NOT NULL").select(*keys, F.posexplode(X.anchor_times()).alias("pos", "a"))
    part(at, "anchor", pos=F.col("pos"), name=F.col("a.id"), value=F.col("a.minutes"), flag=F.col("a.minutes").isNotNull(), text=F.col("a.mode"))
    part(X.price_and_budget(first, B.SPECS), "price", pos=F.lit(0), name=F.col("currency"), value=F.col("price"), median=F.col("budget_m2"), flag=F.col("price_imputed"))
    arch = first.select(*keys, "city").join(probabilities(spark, d).select("city", "cell_id", "probs"), ["city", "cell_id"])
    arch = arch.select(*keys, F.posexplode(F.expr("array_sort(transform(map_entries(map_filter(probs, (k, p) -> p >= 0.005D)), e -> struct(-round(e.value, 9) AS n, e.key AS k, e.value AS p)))")).alias("pos", "a"))
    part(arch, "archetype", pos=F.col("pos"), name=F.col("a.k"), value=F.round("a.p", 3))
    hw = X.spoken(first, medians(spark, d), B.SPECS, templates(spark), mode_phrases(spark), F.lit(LANG))
    part(hw, "kind", pos=F.col("pos"), name=F.col("criterion"), value=he(F.col("value"), 2), text=F.col("text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest(spark, d, places: DataFrame) -> DataFrame:
    """(city, cell_id, pos, category, name, walk_min): the nearest place of each category within half an hour."""
    c = B.grid_cells(spark, d).select("city", "cell_id", "x", "y", "lat", "lon").join(F.broadcast(places), ["city", "cell_id"])       # a place per request at most
    pois = B.points(spark, d)
    measured = B.cells(spark, d).select("city", "cell_id", F.lit("supermarket").alias("category"), F.col("`shops.supermarket_walk_min`").alias("measured"))
    out = SP.nearest_per_category(c, pois.select("city", "category", "poi_id", "x", "y", "lat", "lon"), ["city", "cell_id"], "poi_id", measured)
    order = F.row_number().over(W.partitionBy("city", "cell_id").orderBy("category")) - 1
    return out.join(pois.select("city", "poi_id", "name"), ["city", "poi_id"]).withColumn("pos", order)
