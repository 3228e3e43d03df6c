"""Registered queries: pooled vectors, similarity, archetypes, preferences, live readings."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ARCHETYPES, CRITERIA, LOG_UNITS
from ..operators import archetypes as AR, explain as X, live as L, prefs as PF, ranking as R, scoring as S, similar as SM
from ..session import broadcast_if_small, fingerprint, scratch_path, stored, written
from ..streaming import live as LS
from . import bindings as B
from .oracle import half_even, q
from .registry import query
from .relational_queries import rnd
from .scoring_queries import asked, prepared, scores

SLOTS = SM.cross_slots(B.SPECS, {s.key for s in B.SPECS if s.key != "leisure.nightlife_10min"})
DIMS = [B.SPECS[j].key for j in SLOTS]
D = len(SLOTS)
DIM_VALUES = ", ".join(f"({i}, {j}, '{B.SPECS[j].key}')" for i, j in enumerate(SLOTS))
CUSTOM = ", ".join(map(str, B.CUSTOM_ID.values()))

SQL = {
    "zraw": f"""SELECT f.city, f.cell_id, f.habitable, d.i, d.ikey, CASE WHEN f.unit IN {LOG_UNITS} THEN ln(1 + greatest(f.f, 0)) ELSE f.f END AS v FROM filled f JOIN (VALUES {DIM_VALUES}) AS d(i, j, ikey) ON d.j = f.j""",
    "zfit": "SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM zraw WHERE habitable GROUP BY 1",
    "zl": "SELECT r.city, r.cell_id, r.habitable, r.i, r.ikey, (r.v - f.m) / CASE WHEN f.s > 0 THEN f.s ELSE 1 END AS z FROM zraw r JOIN zfit f USING (i)",
    "zv": "SELECT city, cell_id, habitable, list(z ORDER BY i) AS z FROM zl GROUP BY 1, 2, 3",
    "samp_a": "SELECT city, z, k FROM (SELECT city, z, row_number() OVER (PARTITION BY city ORDER BY (cell_id * 7919 + 17) % 1000003, cell_id) AS k FROM zv WHERE habitable)",
    "samp_b": "SELECT city, z, k FROM (SELECT city, z, row_number() OVER (PARTITION BY city ORDER BY (cell_id * 104729 + 29) % 1000003, cell_id) AS k FROM zv WHERE habitable)",
    "dref": "SELECT a.city AS city_a, b.city AS city_b, median(list_distance(a.z, b.z)) AS d_ref FROM samp_a a JOIN samp_b b USING (k) GROUP BY 1, 2",
    "gz": "SELECT l.city, c.district_id, l.i, sum(l.z * (c.population_est + 1.0)) / sum(c.population_est + 1.0) AS z FROM zl l JOIN cells c USING (city, cell_id) WHERE l.habitable GROUP BY 1, 2, 3",
    "gv": "SELECT city, district_id, list(z ORDER BY i) AS z FROM gz GROUP BY 1, 2",
    "gpair": "SELECT a.city AS city_a, b.city AS city_b, a.district_id AS group_a, b.district_id AS group_b, list_distance(a.z, b.z) AS d FROM gv a, gv b WHERE a.city <> b.city OR a.district_id <> b.district_id",
    "dcrit": f"SELECT city, cell_id, criterion, sc FROM crit WHERE request_id IN ({CUSTOM}) AND criterion <> 'commute'",
    "qry": "SELECT DISTINCT t.city, t.cell_id FROM top_cells t WHERE t.rank = 1"}


def pooled(spark, d):
    """Pooled vectors with position and the default criterion scores: computed once per data version."""
    def build():
        base = SM.pooled_vectors(prepared(spark, d), B.SPECS, SLOTS)
        pos = B.grid_cells(spark, d).select("city", "cell_id", "q", "r")
        crit = scores(spark, d).where(F.col("request_id").isin(list(B.CUSTOM_ID.values()))).select("city", "cell_id", "crit")
        return (base.withColumn("place", S.place_name()).select("city", "cell_id", "habitable", "district_id", "population_est", "place", "z")
                .join(pos, ["city", "cell_id"]).join(crit, ["city", "cell_id"]))
    return stored(spark, d, "pooled", build)


def vectors(spark, d):
    """Row for row the vectors of ``pooled``, without the scores of the requests that others ask of it."""
    def build():
        keys = ["city", "cell_id"]
        compiled, minutes = asked(spark, d)
        met = S.score_cells(prepared(spark, d), compiled.where(F.col("request_id").isin(list(B.CUSTOM_ID.values()))), minutes, B.SPECS).select(*keys)
        base = SM.pooled_vectors(prepared(spark, d), B.SPECS, SLOTS).select(*keys, "habitable", "z")
        return base.join(B.grid_cells(spark, d).select(*keys), keys).join(met, keys)
    return stored(spark, d, "pooled-vectors", build)


@query("M01_pool_standardize", q("SELECT city, cell_id, ikey AS indicator, round(z, 5) AS z FROM zl", **SQL))
def pool_standardize(spark, d):
    names = "array(" + ", ".join(f"'{k}'" for k in DIMS) + ")"
    z = SM.pooled_vectors(prepared(spark, d), B.SPECS, SLOTS)
    return z.selectExpr("city", "cell_id", "posexplode(z) AS (i, v)").selectExpr("city", "cell_id", f"{names}[i] AS indicator", "round(v, 5) AS z")


@query("M07_calibrate_dref", q("SELECT city_a, city_b, round(d_ref, 5) AS d_ref FROM dref", **SQL))
def calibrate_dref(spark, d):
    return d_ref(spark, d).withColumn("d_ref", F.round("d_ref", 5))


def d_ref(spark, d):
    return stored(spark, d, "d-ref", lambda: SM.reference_distances(pooled(spark, d)))


@query("A21_group_vector", q("SELECT city, district_id, i, round(z, 5) AS z FROM gz", **SQL))
def group_vector(spark, d):
    return (SM.group_vectors(pooled(spark, d), D).selectExpr("city", "district_id", "posexplode(z) AS (i, z)")
            .withColumn("z", F.round("z", 5)))


@query("J23_all_pairs_group_distance", q("SELECT city_a, group_a, city_b, group_b, round(d, 5) AS d FROM gpair", **SQL))
def all_pairs_group_distance(spark, d):
    return SM.group_pairs(SM.group_vectors(pooled(spark, d), D)).select("city_a", "group_a", "city_b", "group_b", F.round("d", 5).alias("d"))


def queries_at(spark, d):
    best = S.top_cells(scores(spark, d)).where("rank = 1").select("city", "cell_id").distinct()
    return pooled(spark, d).join(broadcast_if_small(written(best, "queries"), 200_000), ["city", "cell_id"]).withColumn("query_id", F.col("cell_id"))


def cand(spark, d, other):
    p = pooled(spark, d)
    return SM.candidates(queries_at(spark, d), p, F.broadcast(d_ref(spark, d)), other)       # a row per pair of cities


SIM = """SELECT q.cell_id AS query_id, c.cell_id AS match_id, 1 - list_distance(a.z, b.z) / r.d_ref AS sim, coalesce(nullif(c.neighborhood, ''), c.district_name) AS place, q.city AS city_a, c.city AS city_b
 FROM qry q JOIN zv a ON a.cell_id = q.cell_id JOIN cells x ON x.cell_id = q.cell_id JOIN cells c ON c.habitable AND {cond} JOIN zv b ON b.cell_id = c.cell_id JOIN dref r ON r.city_a = q.city AND r.city_b = c.city"""
OWN = SIM.format(cond="c.city = q.city AND abs(c.q - x.q) + abs(c.r - x.r) + abs(c.q - x.q + c.r - x.r) > 4")
OTHER = SIM.format(cond="c.city <> q.city")
TOP = """SELECT query_id, match_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, match_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY round(sim, 6) DESC, match_id) AS one FROM {src}) WHERE one = 1"""
ORDER = [F.desc, F.asc]


def best(df, limit=5):
    return SM.diverse_top(df, ["query_id"], "place", [F.desc(F.round("sim", 6)), F.asc("match_id")], limit)


@query("M06_distance_sim", q(f"SELECT query_id, match_id, round(sim, 5) AS sim FROM ({OWN})", **SQL))
def distance_sim(spark, d):
    return cand(spark, d, False).select("query_id", "match_id", F.round("sim", 5).alias("sim"))


@query("W07_diverse_top", q(f"SELECT query_id, match_id, rank FROM ({TOP.format(src='own')}) WHERE rank <= 10", own=OWN, **SQL))
def diverse_top(spark, d):
    return best(cand(spark, d, False), 10).select("query_id", "match_id", "rank")


TRAITS = """(SELECT t.query_id, t.match_id, string_agg(t.criterion, ',' ORDER BY t.rn) AS traits FROM (SELECT m.query_id, m.match_id, a.criterion, row_number() OVER (PARTITION BY m.query_id, m.match_id
 ORDER BY round(a.sc + b.sc, 9) DESC, k.i) AS rn FROM {src} m JOIN dcrit a ON a.cell_id = m.query_id JOIN dcrit b ON b.cell_id = m.match_id AND b.criterion = a.criterion JOIN crits k ON k.criterion = a.criterion
 WHERE a.sc >= 60 AND b.sc >= 60) t WHERE rn <= 4 GROUP BY 1, 2)"""


def similar_sql(src):
    return f"""SELECT m.query_id, m.match_id, m.rank, round(least(greatest(m.sim, 0), 1), 3) AS similarity, coalesce(t.traits, '') AS traits FROM top m LEFT JOIN {TRAITS.format(src='top')} t USING (query_id, match_id)"""


def similar_rows(df):
    return best(df).select("query_id", "match_id", "rank", F.round(F.least(F.greatest("sim", F.lit(0.0)), F.lit(1.0)), 3).alias("similarity"),
                           F.array_join(SM.shared_traits("crit_a", "crit", CRITERIA), ",").alias("traits"))


@query("M08_similar_places", q(similar_sql("own"), own=OWN, top=f"SELECT * FROM ({TOP.format(src='own')}) WHERE rank <= 5", **SQL))
def similar_places(spark, d):
    return similar_rows(cand(spark, d, False))


@query("M09_twin_cells", q(similar_sql("oth"), oth=OTHER, top=f"SELECT * FROM ({TOP.format(src='oth')}) WHERE rank <= 5", **SQL))
def twin_cells(spark, d):
    return similar_rows(cand(spark, d, True))


@query("O09_common_criteria", q("SELECT query_id, match_id, traits FROM " + TRAITS.format(src="top") + " z", own=OWN, top=f"SELECT * FROM ({TOP.format(src='own')}) WHERE rank <= 5", **SQL))
def common_criteria(spark, d):
    return similar_rows(cand(spark, d, False)).where("traits <> ''").select("query_id", "match_id", "traits")


GTRAIT = """SELECT a.city_a, a.group_a, a.city_b, a.group_b, string_agg(a.criterion, ',' ORDER BY a.rn) AS traits FROM (SELECT p.city_a, p.group_a, p.city_b, p.group_b, x.criterion, row_number() OVER (PARTITION BY p.city_a, p.group_a, p.city_b, p.group_b
 ORDER BY round(x.sc + y.sc, 9) DESC, k.i) AS rn FROM tw p JOIN gc x ON x.city = p.city_a AND x.district_id = p.group_a JOIN gc y ON y.city = p.city_b AND y.district_id = p.group_b AND y.criterion = x.criterion JOIN crits k ON k.criterion = x.criterion
 WHERE x.sc >= 55 AND y.sc >= 55) a WHERE rn <= 4 GROUP BY 1, 2, 3, 4"""


@query("M10_twin_groups", q(f"SELECT t.city_a, t.group_a, t.city_b, t.group_b, t.rank, round(greatest(t.sim, 0), 3) AS similarity, coalesce(g.traits, '') AS traits FROM tw t LEFT JOIN ({GTRAIT}) g USING (city_a, group_a, city_b, group_b)",
    gc="SELECT c.city, x.district_id, c.criterion, avg(c.sc) AS sc FROM dcrit c JOIN cells x USING (city, cell_id) WHERE x.habitable GROUP BY 1, 2, 3",
    gref="SELECT city_a, city_b, median(d) AS d_ref FROM gpair GROUP BY 1, 2",
    tw="SELECT * FROM (SELECT p.*, 1 - p.d / r.d_ref AS sim, row_number() OVER (PARTITION BY p.city_a, p.group_a ORDER BY round(1 - p.d / r.d_ref, 6) DESC, p.group_b) AS rank FROM gpair p JOIN gref r ON r.city_a = p.city_a AND r.city_b = p.city_b WHERE p.city_a <> p.city_b) WHERE rank <= 5", **SQL))
def twin_groups(spark, d):
    p = pooled(spark, d)
    pairs = SM.group_pairs(SM.group_vectors(p, D))
    ref = R.medians(pairs, ["city_a", "city_b"], "d", "d_ref")
    crit = (p.where("habitable").groupBy("city", "district_id").agg(F.array(*[F.avg(F.col("crit")[i]) for i in range(len(CRITERIA))]).alias("crit")))
    t = pairs.where("city_a <> city_b").join(ref, ["city_a", "city_b"]).withColumn("sim", 1 - F.col("d") / F.col("d_ref"))
    t = R.top_per_group(t, ["city_a", "group_a"], [F.desc(F.round("sim", 6)), F.asc("group_b")], 5)
    side = lambda s: crit.select(F.col("city").alias(f"city_{s}"), F.col("district_id").alias(f"group_{s}"), F.col("crit").alias(f"c_{s}"))
    t = t.join(side("a"), ["city_a", "group_a"]).join(side("b"), ["city_b", "group_b"])
    return t.select("city_a", "group_a", "city_b", "group_b", "rank", F.round(F.greatest("sim", F.lit(0.0)), 3).alias("similarity"),
                    F.array_join(SM.shared_traits("c_a", "c_b", CRITERIA, 55.0), ",").alias("traits"))


# ------------------------------------------------------------------ archetypes
def name_sql():
    """Naming rules on the dimensions that exist here (absent ones count as 0)."""
    g = lambda c: f"coalesce(max(z) FILTER (WHERE ikey = '{c}'), 0)"
    dense = f"(({g('leisure.food_10min')} + 0 + 0) / 3)"
    far = f"(({g('health.gp_walk_min')} + {g('health.pharmacy_walk_min')} + {g('shops.supermarket_walk_min')} + {g('education.primary_school_walk_min')} + 0) / 5)"
    green = f"(({g('green.green_share_500m')} + 0) / 2)"
    return f"""CASE WHEN {dense} > 0.8 THEN 'urban_mix' WHEN {far} > 1.0 THEN 'quiet_outskirts' WHEN {green} > 0.5 THEN 'green_residential' WHEN {g('transit.departures_per_h_500m')} > 0.3 THEN 'urban_mix' ELSE 'family_suburb' END"""


@query("M03_name_cluster", q(f"SELECT city, cell_id, {name_sql()} AS archetype FROM zl GROUP BY 1, 2", **SQL))
def name_cluster(spark, d):
    names = "array(" + ", ".join(f"'{k}'" for k in DIMS) + ")"
    return pooled(spark, d).selectExpr("city", "cell_id", f"map_from_arrays({names}, z) AS zm").select("city", "cell_id", AR.name_cluster("zm").alias("archetype"))


CLUSTER_IDS = ARCHETYPES[:6] + ARCHETYPES[1:2]
PROBA = [f"((p_partkey * {i + 3} + p_size) % 17 + 1.0)" for i in range(len(CLUSTER_IDS))]
TOTAL = "(" + " + ".join(PROBA) + ")"
PSQL = {"pp": "SELECT c.city, c.cell_id, c.district_id, c.population_est, t.k, t.p FROM cells c JOIN (" + " UNION ALL ".join(
    f"SELECT p_partkey AS cell_id, '{a}' AS k, CAST({p} AS DOUBLE) / CAST({TOTAL} AS DOUBLE) AS p FROM part" for a, p in zip(CLUSTER_IDS, PROBA)) + ") t USING (cell_id)"}


def probabilities(spark, d):
    p = B.table(spark, d, "part").selectExpr("p_partkey AS cell_id", "array(" + ", ".join(f"cast({x} AS double) / cast({TOTAL} AS double)" for x in PROBA) + ") AS proba")
    c = B.grid_cells(spark, d).select("city", "cell_id", "district_id", "population_est").join(p, "cell_id")
    return AR.merge_probabilities(c, CLUSTER_IDS, ["city", "cell_id", "district_id", "population_est"])


@query("M05_merge_class_probs", q("SELECT city, cell_id, k AS archetype, round(sum(p), 6) AS p FROM pp GROUP BY 1, 2, 3", **PSQL))
def merge_class_probs(spark, d):
    return probabilities(spark, d).select("city", "cell_id", F.explode("probs").alias("archetype", "p")).withColumn("p", F.round("p", 6))


@query("A22_archetype_group", q("""SELECT city, district_id, arg_min(k, (-round(p, 9), k)) AS archetype, round(max(p), 3) AS p, count(*) FILTER (WHERE p >= 0.005) AS listed FROM (SELECT city, district_id, k, sum(p * (population_est + 1.0)) / sum(population_est + 1.0) AS p
 FROM (SELECT city, cell_id, district_id, population_est, k, sum(p) AS p FROM pp GROUP BY ALL) GROUP BY 1, 2, 3) GROUP BY 1, 2""", **PSQL))
def archetype_group(spark, d):
    g = AR.group_archetype(probabilities(spark, d), ["city", "district_id"], F.col("population_est") + F.lit(1.0))
    return g.select("city", "district_id", "archetype", "p", F.size("probs").alias("listed"))


@query("A23_cluster_share_by_city", q(f"""SELECT city, archetype, round(count(*) / sum(count(*)) OVER (PARTITION BY city), 3) AS share FROM (SELECT city, {B.pick(CLUSTER_IDS, 'cell_id')} AS archetype FROM cells WHERE habitable) GROUP BY 1, 2"""))
def cluster_share_by_city(spark, d):
    c = B.grid_cells(spark, d).where("habitable").withColumn("archetype", F.expr(B.pick(CLUSTER_IDS, "cell_id")))
    return AR.share_by_city(c, "archetype")


def clusters(spark, d):
    """Labels, centres and the number of clusters, of one training."""
    return stored(spark, d, "clusters", lambda: AR.train_kmeans(vectors(spark, d)))


@query("M02_kmeans_select_k")
def kmeans_select_k(spark, d):
    out = clusters(spark, d).groupBy("cluster", "k").agg(F.count("*").alias("cells"), F.first("centre").alias("centre"))
    names = F.array(*[F.lit(n) for n in DIMS])
    return out.withColumn("zm", F.map_from_arrays(names, "centre")).select("cluster", "cells", AR.name_cluster("zm").alias("archetype"), "k")


@query("M02_kmeans_nearest_centre", q("""SELECT city, count(*) AS cells, 0 AS elsewhere, TRUE AS k_allowed FROM cells WHERE habitable GROUP BY 1"""))
def kmeans_nearest_centre(spark, d):
    """Every habitable cell belongs to the centre nearest to it, and the number of centres is one of those tried."""
    out = clusters(spark, d)
    centres = out.groupBy("cluster").agg(F.first("centre").alias("centre")).agg(F.collect_list("centre").alias("centres"))       # k rows
    gap = lambda c: F.aggregate(F.zip_with("z", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    rows = out.crossJoin(F.broadcast(centres)).withColumn("off", gap(F.col("centre")) > F.array_min(F.transform("centres", gap)) + 1e-9)     # one row
    return rows.groupBy("city").agg(F.count("*").alias("cells"), F.count_if("off").cast("int").alias("elsewhere"), F.bool_and(F.col("k").isin(6, 7, 8)).alias("k_allowed"))


def membership_model(spark, d):
    from pyspark.ml.functions import array_to_vector
    data = clusters(spark, d).withColumn("features", array_to_vector("z"))
    k = data.first()["k"]
    model, acc = AR.train_membership(data, D, k)
    return model, {"k": k, "holdoutAccuracy": round(acc, 4)}


def membership(spark, d):
    """The model for the content of the input, trained where it has changed."""
    root = scratch_path(spark, d, "model")
    version = fingerprint(prepared(spark, d).select("city", "cell_id", "habitable", "raw"))
    return AR.load_or_train(spark, root, version, lambda: membership_model(spark, d))


@query("M13_model_versioning", q("SELECT city, count(*) AS cells, TRUE AS reused, TRUE AS k_allowed FROM cells GROUP BY 1"))
def model_versioning(spark, d):
    first, again = membership(spark, d), membership(spark, d)
    p = AR.memberships(again[0], vectors(spark, d)).groupBy("city").agg(F.count("*").alias("cells"))
    return p.withColumn("reused", F.lit(again[2])).withColumn("k_allowed", F.lit(first[1]["k"] in (6, 7, 8)))


@query("M04_mlp_soft_membership")
def mlp_soft_membership(spark, d):
    model, metrics, _ = membership(spark, d)
    p = AR.memberships(model, vectors(spark, d))
    return p.select("city", "cell_id", F.round(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                    F.lit(metrics["holdoutAccuracy"]).alias("accuracy"))


@query("M04_mlp_totals", q("SELECT city, cell_id, CAST(1.0 AS DOUBLE) AS total, TRUE AS within FROM cells"))
def mlp_totals(spark, d):
    """The probabilities of each cell lie between 0 and 1 and sum to 1."""
    p = AR.memberships(membership(spark, d)[0], vectors(spark, d))
    return p.select("city", "cell_id", F.round(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.forall("proba", lambda x: x.between(0, 1)).alias("within"))


# ------------------------------------------------------------------ preferences
PAIR_CRIT = tuple(c for c in CRITERIA if c not in ("commute",))


PAIRS_SQL = (f"""SELECT city, pair, arg_min(cell_id, (h, cell_id)) FILTER (WHERE sc >= p80) AS high, arg_min(cell_id, (h, cell_id)) FILTER (WHERE sc <= p20) AS low FROM (SELECT c.city, p.pair, c.cell_id, c.sc, k.p20, k.p80,
 (c.cell_id * 7919 + p.pair * 31 + 7) % 10007 AS h FROM dc c JOIN (VALUES {', '.join(f"({p}, '{PAIR_CRIT[p % len(PAIR_CRIT)]}')" for p in range(10))}) AS p(pair, criterion) USING (criterion)
 JOIN (SELECT city, criterion, quantile_cont(sc, 0.2) AS p20, quantile_cont(sc, 0.8) AS p80 FROM dc GROUP BY 1, 2) k ON k.city = c.city AND k.criterion = c.criterion) GROUP BY 1, 2""")


@query("M11_pref_pairs", q(f"""SELECT p.city, 'p' || CAST(p.pair + 1 AS VARCHAR) AS id, CASE WHEN p.pair % 2 = 0 THEN high ELSE low END AS cell_a, CASE WHEN p.pair % 2 = 0 THEN low ELSE high END AS cell_b, a.scores AS a, b.scores AS b
 FROM pp0 p JOIN shown a ON a.city = p.city AND a.cell_id = CASE WHEN p.pair % 2 = 0 THEN high ELSE low END JOIN shown b ON b.city = p.city AND b.cell_id = CASE WHEN p.pair % 2 = 0 THEN low ELSE high END""",
    pp0=PAIRS_SQL, shown=f"SELECT city, cell_id, string_agg(criterion || ':' || CAST({half_even('sc')} AS INTEGER), ',' ORDER BY i) AS scores FROM crit JOIN crits USING (criterion) WHERE request_id IN ({CUSTOM}) GROUP BY 1, 2",
    dc=f"SELECT city, cell_id, criterion, round(sc, 6) AS sc FROM crit WHERE habitable AND request_id IN ({CUSTOM})"))
def pref_pairs(spark, d):
    long = S.criterion_long(scores(spark, d).where(F.col("request_id").isin(list(B.CUSTOM_ID.values())) & F.col("habitable")))
    pairs = PF.contrasting_pairs(long.select("city", "cell_id", "criterion", F.round("s", 6).alias("s")), 10, PAIR_CRIT)
    told = scores(spark, d).where(F.col("request_id").isin(list(B.CUSTOM_ID.values()))).select("city", "cell_id", X.rounded_criteria().alias("scores"))
    return PF.shown(pairs, told)


def choices(spark, d):
    """Choices from conversations: each turn compares two texts by simple counts."""
    c = B.table(spark, d, "conversations")
    crit = ", ".join(f"'{k}', cast((length(text) * {i + 3} + turn * {i + 1}) % 101 AS double)" for i, k in enumerate(PF.CHOICE_CRITERIA))
    other = ", ".join(f"'{k}', cast((conv_id * {i + 5} + turn * 17) % 101 AS double)" for i, k in enumerate(PF.CHOICE_CRITERIA))
    return c.selectExpr("conv_id % 40 AS user", f"map({crit}) AS a", f"map({other}) AS b",
                        "CASE WHEN (length(text) + turn) % 3 = 0 THEN 'b' ELSE 'a' END AS choice")


@query("M12_pref_fit")
def pref_fit(spark, d):
    return PF.fit_preferences(choices(spark, d)).select("user", F.array_join(F.transform(F.map_entries("levels"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])), ",").alias("levels"), "confidence")


@query("M12_pref_fit_gradient", "SELECT conv_id % 40 AS user, count(*) AS choices, TRUE AS at_optimum FROM conversations GROUP BY 1")
def pref_fit_gradient(spark, d):
    """The gradient of each user's penalised likelihood vanishes at the fitted weights."""
    c = choices(spark, d)
    x = "transform(array(" + ", ".join(f"(coalesce(a['{k}'], 50D) - coalesce(b['{k}'], 50D)) / 100D" for k in PF.CHOICE_CRITERIA) + "), v -> CASE WHEN choice = 'a' THEN v ELSE -v END)"
    rows = c.selectExpr("user", f"{x} AS x").join(PF.fit_preferences(c).select("user", "w"), "user")
    miss = F.expr("1D / (1D + exp(aggregate(zip_with(x, w, (p, q) -> p * q), 0D, (s, v) -> s + v)))")
    n = range(len(PF.CHOICE_CRITERIA))
    g = rows.withColumn("miss", miss).groupBy("user").agg(F.count("*").alias("choices"), F.array(*[F.first("w")[i] - 2 * F.sum(F.col("miss") * F.col("x")[i]) for i in n]).alias("g"))
    return g.select("user", "choices", F.forall("g", lambda v: F.abs(v) < 1e-5).alias("at_optimum"))


# ------------------------------------------------------------------ live readings
LIVE = {"reading": """SELECT event_id AS reading_id, ts, user_id * 10 + CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS registration,
 CASE event_id % 5 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN '148' ELSE '7' END AS value_type, value FROM events""",
        "reg": "SELECT DISTINCT user_id * 10 + k AS registration, user_id AS station, comp AS component FROM events CROSS JOIN (VALUES (1, 'PM10'), (2, 'PM2_5'), (3, 'NO2'), (4, 'INDX')) AS t(k, comp)",
        "decoded": "SELECT r.*, g.station, g.component FROM reading r JOIN reg g USING (registration) WHERE r.value_type IN ('8', '9', '148')"}


@query("T01_readings_decode", q("""SELECT station, max(ts) AS ts, arg_max(value, (ts, reading_id)) FILTER (WHERE component = 'PM10') AS "PM10", arg_max(value, (ts, reading_id)) FILTER (WHERE component = 'PM2_5') AS "PM2_5",
 arg_max(value, (ts, reading_id)) FILTER (WHERE component = 'NO2') AS "NO2", arg_max(value, (ts, reading_id)) FILTER (WHERE component = 'INDX') AS "INDX" FROM decoded GROUP BY 1""", **LIVE))
def readings_decode(spark, d):
    dec = L.decode(LS.readings(B.table(spark, d, "events")), LS.registry(B.table(spark, d, "events")))
    return L.by_station(dec, ["PM10", "PM2_5", "NO2", "INDX"])


@query("T02_latest_per_station", q("SELECT station, arg_max(value, (ts, reading_id)) AS value, max(ts) AS ts FROM decoded GROUP BY 1", **LIVE))
def latest_per_station(spark, d):
    """Runs the stream over the event files until they are consumed and reads its keyed table back."""
    return LS.run_latest(spark, f"{d}/events.parquet", scratch_path(spark, d, "live")).select("station", "value", "ts")


@query("T03_freshness_status", q("""SELECT s.station, CASE WHEN l.ts IS NULL THEN 'unavailable' WHEN date_diff('second', date_trunc('second', l.ts), date_trunc('second', (SELECT max(ts) FROM reading))) <= 43200 THEN 'ok' ELSE 'stale' END AS status
 FROM (SELECT DISTINCT user_id AS station FROM events UNION SELECT s_suppkey + 120 FROM supplier) s LEFT JOIN (SELECT station, max(ts) AS ts FROM decoded GROUP BY 1) l USING (station)""", **LIVE))
def freshness_status(spark, d):
    ev = B.table(spark, d, "events")
    rd = LS.readings(ev)
    latest = L.latest(L.decode(rd, LS.registry(ev)), "station")
    known = ev.select(F.col("user_id").alias("station")).union(B.table(spark, d, "supplier").select(F.col("s_suppkey") + 120)).distinct()
    now = rd.agg(F.max("ts").alias("now"))
    return L.freshness(known.join(latest, "station", "left").crossJoin(F.broadcast(now)), F.col("now"), ttl=43200).select("station", "status")   # one row


@query("T04_nearest_station_live", q("""SELECT city, poi_id, station, round(sqrt(dd), 4) AS dist FROM (SELECT p.city, p.poi_id, s.station, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) AS dd, row_number() OVER (PARTITION BY p.poi_id
 ORDER BY round(sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)), 6), s.station) AS rn FROM pois p JOIN (SELECT d.city, l.station, d.x, d.y FROM (SELECT station FROM decoded WHERE component = 'INDX' GROUP BY 1) l
 JOIN dests d ON d.dest = l.station) s ON s.city = p.city) WHERE rn = 1""", **LIVE))
def nearest_station_live(spark, d):
    from ..operators.spatial import nearest
    ev = B.table(spark, d, "events")
    live = L.decode(LS.readings(ev), LS.registry(ev)).where("component = 'INDX'").select("station").distinct()
    st = B.dests(spark, d).select("city", F.col("dest").alias("station"), "x", "y").join(live, "station")
    out = nearest(B.points(spark, d).select("city", "poi_id", "x", "y"), st, ["city", "poi_id"], "station", ["city"])
    return out.select("city", "poi_id", "station", F.round("dist", 4).alias("dist"))


@query("T05_reading_dedup", q("SELECT count(*) AS n, count(DISTINCT reading_id) AS ids FROM reading", **LIVE))
def reading_dedup(spark, d):
    """Every reading is delivered twice; the stream keeps one."""
    out = LS.run_dedup(spark, f"{d}/events.parquet", scratch_path(spark, d, "dedup"))
    return out.agg(F.count("*").alias("n"), F.count_distinct("reading_id").alias("ids"))
