"""Scoring of a table of requests against prepared cells.

Requests are rows, not calls.  ``compile_requests`` turns each into weight arrays, ``score_cells`` joins them to the
cells of their city (the request side is small and Spark broadcasts it by size) and evaluates every criterion, the
match and the filters in one narrow stage: there is no shuffle per criterion and none per request.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..config import (COMMUTE_BAD, COMMUTE_GOOD, CRITERIA, INDICATORS, LEVEL_WEIGHT, MUST_HAVE, PERSONAS, PRICE,
                      UNREACHABLE, Indicator)
from ..session import BROADCAST_ROWS, broadcast_if_small, is_small, widen, written
from .ranking import global_positions, top_per_group
from .runs import narrowed_medians

ANCHOR = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()), T.StructField("mode", T.StringType()),
    T.StructField("level", T.IntegerType()), T.StructField("maxMinutes", T.IntegerType())])
FILTERS = T.StructType([
    T.StructField("maxPricePerM2", T.DoubleType()), T.StructField("maxRentPerM2", T.DoubleType()),
    T.StructField("maxCommuteMinutes", T.IntegerType()),
    T.StructField("mustHave", T.ArrayType(T.StructType([
        T.StructField("category", T.StringType()), T.StructField("maxWalkMin", T.DoubleType())]))),
    T.StructField("maxNoiseDb", T.DoubleType())])
BUDGET = T.StructType([T.StructField("total", T.DoubleType()), T.StructField("monthlyRent", T.DoubleType())])
REQUEST = T.StructType([
    T.StructField("v", T.IntegerType()), T.StructField("lang", T.StringType()),
    T.StructField("persona", T.StringType()), T.StructField("weights", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("indicatorWeights", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("anchors", T.ArrayType(ANCHOR)), T.StructField("filters", FILTERS), T.StructField("budget", BUDGET),
    T.StructField("aggregate", T.StringType()), T.StructField("limit", T.IntegerType()),
    T.StructField("includeCells", T.BooleanType()), T.StructField("rankBy", T.StringType()),
    T.StructField("district", T.StringType())])
SLOTS = "map<int,struct<id:string,aw:double,lim:int>>"


def persona_table(spark: SparkSession) -> DataFrame:
    schema = "persona string, walk_factor double, p_levels map<string,int>, p_weights map<string,double>"
    return spark.createDataFrame([(p.id, p.walk_factor, p.levels, p.weights) for p in PERSONAS], schema)


def level_weight(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN {lv} THEN {float(w)}D" for lv, w in LEVEL_WEIGHT.items()) + " ELSE 0.0D END"


def with_persona(requests: DataFrame) -> DataFrame:
    """Unknown or absent personas read the walk factor and indicator weights of ``custom``."""
    p = persona_table(requests.sparkSession)
    known = [x.id for x in PERSONAS]
    key = F.when(F.col("persona").isin(known), F.col("persona")).otherwise("custom")
    return (requests.withColumn("__p", key).join(p.withColumnRenamed("persona", "__p"), "__p", "left").drop("__p"))


def effective_weight(spec: Indicator, j: int) -> str:
    """Request weight by indicator key, else persona override, else base weight; never negative, 0 without data."""
    return (f"CASE WHEN coverage[{j}] > 0 THEN greatest(coalesce(indicatorWeights['{spec.key}'], "
            f"p_weights['{spec.key}'], {spec.weight}D), 0.0D) ELSE 0.0D END")


def criterion_level(c: str) -> str:
    return (f"least(greatest(coalesce(weights['{c}'], CASE WHEN persona IS NOT NULL THEN p_levels['{c}'] END, 0), 0), 5)")


def _array(items: list[str]) -> str:
    return "array(" + ", ".join(items) + ")"


def compile_requests(requests: DataFrame, coverage: DataFrame, anchors: DataFrame | None = None,
                     specs: Sequence[Indicator] = INDICATORS) -> DataFrame:
    """``coverage``: (city, coverage array, median array).  ``anchors``: resolved anchors, see ``resolve_anchors``.

    Adds ``w`` (indicator weights), ``den`` (their sum per criterion), ``lv`` (levels), ``cw`` (weight per criterion
    in the match, 0 if not included), ``total_w`` and ``excluded`` (rated criteria without data)."""
    r = with_persona(requests).join(coverage, "city", "left")
    r = r.selectExpr("*", _array([effective_weight(s, j) for j, s in enumerate(specs)]) + " AS w",
                     _array([criterion_level(c) for c in CRITERIA]) + " AS lv")
    if anchors is not None:
        usable = anchors.where("usable").groupBy("request_id").agg(
            F.sum("aw").alias("anchor_w"), F.map_from_entries(F.collect_list(
                F.struct("pos", F.struct("id", "aw", "lim")))).alias("anchor_slots"))
        r = r.join(usable, "request_id", "left")
    else:
        r = r.selectExpr("*", "cast(NULL AS double) AS anchor_w", f"cast(NULL AS {SLOTS}) AS anchor_slots")
    den = []
    for c in CRITERIA:
        js = [f"w[{j}]" for j, s in enumerate(specs) if s.criterion == c]
        den.append("coalesce(anchor_w, 0.0D)" if c == "commute" else " + ".join(js or ["0.0D"]))
    r = r.selectExpr("*", _array(den) + " AS den")
    n = range(len(CRITERIA))
    r = r.selectExpr("*", _array([f"CASE WHEN lv[{i}] > 0 AND den[{i}] > 0 THEN {level_weight(f'lv[{i}]')} ELSE 0.0D END"
                                  for i in n]) + " AS __rated",
                     f"filter({_array([f'CASE WHEN lv[{i}] > 0 AND NOT den[{i}] > 0 THEN {c!r} END' for i, c in enumerate(CRITERIA)])},"
                     " x -> x IS NOT NULL) AS excluded")
    r = r.selectExpr("* EXCEPT (__rated)", "CASE WHEN exists(__rated, x -> x > 0) THEN __rated "
                     "ELSE transform(den, d -> CASE WHEN d > 0 THEN 1.0D ELSE 0.0D END) END AS cw")
    r = r.selectExpr("*", "aggregate(cw, 0.0D, (a, x) -> a + x) AS total_w")
    return fold_coefficients(r, specs)


def fold_coefficients(r: DataFrame, specs: Sequence[Indicator]) -> DataFrame:
    """Everything linear in the sub-scores is multiplied out per request, so a cell needs one sum of products:
    ``e_j`` = share of indicator j in the match, ``e_commute`` that of the commute score; ``rank_e`` the same for the
    criterion the request ranks by.  Filter limits become plain columns, NULL where a filter does not apply."""
    ci = {c: i for i, c in enumerate(CRITERIA)}

    def share(j, s):
        i = ci[s.criterion]
        return f"CASE WHEN total_w > 0 AND den[{i}] > 0 THEN cw[{i}] / total_w * w[{j}] / den[{i}] ELSE 0.0D END AS e_{j}"
    idx = {s.key: j for j, s in enumerate(specs)}
    ranked = [f"CASE WHEN rankBy = '{s.criterion}' THEN w[{j}] / den[{ci[s.criterion]}] ELSE 0.0D END" for j, s in enumerate(specs)]
    can = " OR ".join(f"(rankBy = '{c}' AND den[{i}] > 0)" for i, c in enumerate(CRITERIA) if c != "commute")
    price = " ".join(f"WHEN city = '{c}' AND coverage[{idx[p[0]]}] > 0 THEN filters.{p[1]}" for c, p in PRICE.items() if p[0] in idx)
    noise = idx.get("environment.noise_db")
    known = " OR ".join(f"(m.category = '{cat}' AND coverage[{idx[col]}] > 0" + (f" AND city = '{city}')" if city else ")")
                        for cat, (col, city) in MUST_HAVE.items() if col in idx) or "false"
    limits = [f"array_min(transform(filter(__must, m -> m.category = '{cat}'), m -> m.maxWalkMin)) AS must_{cat}"
              for cat, (col, _) in MUST_HAVE.items() if col in idx]
    i = ci["commute"]
    r = r.selectExpr("*", *[share(j, s) for j, s in enumerate(specs)],
                     f"CASE WHEN total_w > 0 AND den[{i}] > 0 THEN cw[{i}] / total_w ELSE 0.0D END AS e_commute",
                     f"CASE WHEN {can} THEN {_array(ranked)} END AS rank_e",
                     f"CASE {price} END AS price_limit" if price else "cast(NULL AS double) AS price_limit",
                     f"CASE WHEN coverage[{noise}] > 0 THEN filters.maxNoiseDb END AS noise_limit" if noise is not None
                     else "cast(NULL AS double) AS noise_limit",
                     f"filter(filters.mustHave, m -> {known}) AS __must",
                     "exists(map_values(anchor_slots), v -> v.lim > 0) AS has_commute_limit")
    return r.selectExpr("* EXCEPT (__must)", *limits)


def resolve_anchors(requests: DataFrame, dests: DataFrame, modes: DataFrame) -> DataFrame:
    """(request_id, city, pos, id, label, mode, aw, lim, dest, usable).  ``dests`` maps an anchor to its destination
    (request_id, pos, dest); ``modes`` lists the (city, mode) pairs with travel times."""
    a = requests.select("request_id", "city", F.col("filters.maxCommuteMinutes").alias("g"),
                        F.posexplode("anchors").alias("pos", "a"))
    a = a.select("request_id", "city", "pos", "a.id", "a.label", "a.mode", "a.lat", "a.lon",
                 F.expr(level_weight("a.level")).alias("aw"), F.coalesce("a.maxMinutes", "g").alias("lim"))
    a = a.join(dests.select("request_id", "pos", "dest"), ["request_id", "pos"], "left")
    a = a.join(modes.select("city", "mode", F.lit(True).alias("has_mode")), ["city", "mode"], "left")
    return a.withColumn("usable", F.col("dest").isNotNull() & F.coalesce("has_mode", F.lit(False))).drop("has_mode")


def anchor_minutes(anchors: DataFrame, travel: DataFrame) -> DataFrame:
    """(request_id, city, cell_id, minutes map<pos, minutes>); unreachable origins have no entry."""
    t = travel.select("city", "mode", "dest", F.col("origin").alias("cell_id"), "minutes")
    asked = broadcast_if_small(anchors.where("usable").select("request_id", "city", "pos", "mode", "dest"))
    return (t.join(asked, ["city", "mode", "dest"])
            .groupBy("request_id", "city", "cell_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("pos", "minutes"))).alias("minutes")))


def sub_score(spec: Indicator, j: int) -> str:
    """0-100 score of one indicator of a prepared cell for the request's walk factor."""
    if spec.norm == "decay":
        v = f"filled[{j}] * walk_factor" if spec.walk_scaled else f"filled[{j}]"
        v = f"({v} - {spec.bad}D) / {spec.good - spec.bad}D * 100.0D"
    else:
        v = f"pct[{j}]"
    return f"coalesce(least(greatest({v}, 0.0D), 100.0D), 0.0D)"


def criterion_scores(specs: Sequence[Indicator]) -> str:
    """Array over CRITERIA: weighted mean of sub-scores, NULL where the weights are 0."""
    out = []
    for i, c in enumerate(CRITERIA):
        js = [f"w[{j}] * s_{j}" for j, s in enumerate(specs) if s.criterion == c]
        num = "__commute" if c == "commute" else f"({' + '.join(js or ['0.0D'])}) / den[{i}]"
        out.append(f"CASE WHEN den[{i}] > 0 THEN {num} END")
    return _array(out)


def commute_score() -> str:
    """Weighted decay over the usable anchors; an unreachable anchor scores 0."""
    m = f"coalesce(try_element_at(minutes, e.key), {UNREACHABLE})"
    d = f"least(greatest(({m} - {COMMUTE_BAD}D) / {COMMUTE_GOOD - COMMUTE_BAD}D * 100.0D, 0.0D), 100.0D)"
    return f"aggregate(map_entries(anchor_slots), 0.0D, (a, e) -> a + e.value.aw * {d}) / anchor_w"


def match_score(specs: Sequence[Indicator]) -> str:
    terms = " + ".join([f"s_{j} * e_{j}" for j in range(len(specs))] or ["0.0D"])
    return f"CASE WHEN total_w > 0 THEN {terms} + CASE WHEN e_commute > 0 THEN e_commute * __commute ELSE 0.0D END END"


def passes(specs: Sequence[Indicator]) -> str:
    """All filters of the request hold; unknown must-have minutes and unreachable anchors fail."""
    idx = {s.key: j for j, s in enumerate(specs)}
    tests = ["habitable", "(price_limit IS NULL OR coalesce(price_value <= price_limit, false))",
             "(noise_limit IS NULL OR coalesce(noise_value <= noise_limit, false))"]
    tests += [f"(must_{cat} IS NULL OR coalesce(raw[{idx[col]}] <= must_{cat}, false))" for cat, (col, _) in MUST_HAVE.items() if col in idx]
    tests.append("(NOT coalesce(has_commute_limit, false) OR forall(map_entries(anchor_slots), e -> NOT coalesce(e.value.lim > 0, false) "
                 "OR coalesce(try_element_at(minutes, e.key) <= e.value.lim, false)))")
    return " AND ".join(tests)


def filter_masks(specs: Sequence[Indicator]) -> str:
    """Array of (key, ok), in the order price, noise, mustHave, commute.  A filter on a column without data is left
    out; price and noise compare the filled value, a must-have with an unknown value fails."""
    idx = {s.key: j for j, s in enumerate(specs)}

    def limit(key, bound, guard="true"):
        if key not in idx:
            return None
        j = idx[key]
        return (f"WHEN {guard} AND {bound} IS NOT NULL AND coverage[{j}] > 0 THEN "
                "struct('{name}' AS key, " + f"coalesce(filled[{j}] <= {bound}, false) AS ok)")

    price = [limit(col, f"filters.{field}", f"city = '{c}'") for c, (col, field, *_) in PRICE.items()]
    noise = [limit("environment.noise_db", "filters.maxNoiseDb")]
    fixed = [f"CASE {' '.join(p.format(name=n) for p in ps if p)} END"
             for n, ps in (("price", price), ("noise", noise)) if any(ps)]
    known, value = [], []
    for cat, (col, city) in MUST_HAVE.items():
        if col in idx:
            test = f"m.category = '{cat}' AND coverage[{idx[col]}] > 0" + (f" AND city = '{city}'" if city else "")
            known.append(f"({test})")
            value.append(f"WHEN {test} THEN raw[{idx[col]}]")
    must = (f"transform(filters.mustHave, m -> CASE WHEN {' OR '.join(known)} THEN struct(concat('mustHave:', m.category) "
            f"AS key, coalesce((CASE {' '.join(value)} END) <= m.maxWalkMin, false) AS ok) END)")
    commute = ("transform(array_sort(map_entries(anchor_slots)), e -> CASE WHEN e.value.lim > 0 THEN "
               "struct(concat('commute:', e.value.id) AS key, "
               "coalesce(try_element_at(minutes, e.key) <= e.value.lim, false) AS ok) END)")
    parts = [_array(fixed)] if fixed else []
    parts += [f"coalesce({p}, array())" for p in (([must] if known else []) + [commute])]
    return f"filter(concat({', '.join(parts)}), x -> x IS NOT NULL)"


def normalized(prepared: DataFrame, specs: Sequence[Indicator] = INDICATORS) -> DataFrame:
    """Prepared cells once per walk factor, with the sub-scores ``s_j`` and the filter values as plain columns."""
    idx = {s.key: j for j, s in enumerate(specs)}
    factors = sorted({p.walk_factor for p in PERSONAS})
    price = " ".join(f"WHEN city = '{c}' THEN filled[{idx[p[0]]}]" for c, p in PRICE.items() if p[0] in idx)
    noise = idx.get("environment.noise_db")
    df = prepared.selectExpr("*", f"explode(array({', '.join(f'{f}D' for f in factors)})) AS walk_factor")
    return df.selectExpr("*", *[f"{sub_score(s, j)} AS s_{j}" for j, s in enumerate(specs)],
                         f"CASE {price} END AS price_value" if price else "cast(NULL AS double) AS price_value",
                         f"filled[{noise}] AS noise_value" if noise is not None else "cast(NULL AS double) AS noise_value")


def request_blocks(compiled: DataFrame, size: int = BROADCAST_ROWS) -> list[DataFrame]:
    """The requests in blocks of at most ``size`` rows, numbered through, each of which can be broadcast."""
    if is_small(compiled, size):
        return [F.broadcast(compiled)]
    numbered = written(global_positions(compiled, [], [F.asc("request_id")], "__no"), "requests")
    n = numbered.count()
    return [F.broadcast(numbered.where(F.col("__no").between(i + 1, i + size)).drop("__no")) for i in range(0, n, size)]


def score_cells(prepared: DataFrame, compiled: DataFrame, minutes: DataFrame | None = None,
                specs: Sequence[Indicator] = INDICATORS, pairs: DataFrame | None = None) -> DataFrame:
    """One row per (request, cell of its city): ``s`` sub-scores, ``crit``, ``mf`` (float match), ``score``,
    ``masks`` and ``passing``.  Columns a query does not use are pruned, so ranking alone costs a sum of products and
    the filter tests per row.

    A request table that is too large to broadcast is joined block by block, so the cells stay where they are and no row
    meets others by its city. ``pairs`` (request_id, city, walk_factor, tile) limits each request to some tiles of the cells."""
    cells = normalized(widen(prepared, "cell_id"), specs)
    cells = cells if pairs is None else cells.join(pairs, ["city", "walk_factor", "tile"])
    by = ["city", "walk_factor"] if pairs is None else ["city", "walk_factor", "request_id"]
    met = lambda asks: reduce(DataFrame.unionByName, [cells.join(block, by) for block in request_blocks(asks)])
    compiled = compiled.drop("coverage", "median")
    none = "cast(NULL AS map<int,int>) AS minutes"
    if minutes is None:
        df = met(compiled).selectExpr("*", none)
    else:
        # only rows of requests with anchors are shuffled to their minutes
        compiled = written(compiled, "requests")
        df = (met(compiled.where("anchor_slots IS NULL")).selectExpr("*", none)
              .unionByName(met(compiled.where("anchor_slots IS NOT NULL")).join(minutes, ["request_id", "city", "cell_id"], "left")))
    df = df.selectExpr("*", commute_score() + " AS __commute", passes(specs) + " AS passing")
    df = df.selectExpr("*", match_score(specs) + " AS mf", criterion_scores(specs) + " AS crit",
                       _array([f"s_{j}" for j in range(len(specs))]) + " AS s", filter_masks(specs) + " AS masks")
    drop = ["__commute", "price_value", "noise_value", *[f"s_{j}" for j in range(len(specs))], *[f"e_{j}" for j in range(len(specs))]]
    return df.selectExpr("*", "cast(least(greatest(bround(round(mf, 9), 0), 0.0D), 100.0D) AS int) AS score").drop(*drop)


def lens() -> Column:
    """Ordering value of a row: the match, one criterion, or minus the minutes to an anchor."""
    hit = "filter(map_entries(anchor_slots), e -> e.value.id = substring(rankBy, 8))"
    return F.expr("CASE WHEN rankBy IS NULL THEN mf WHEN rank_e IS NOT NULL THEN aggregate(zip_with(s, rank_e, (a, b) -> a * b), 0.0D, (a, x) -> a + x) "
                  f"WHEN rankBy = 'commute' AND den[{CRITERIA.index('commute')}] > 0 THEN crit[{CRITERIA.index('commute')}] "
                  f"WHEN rankBy LIKE 'anchor:%' AND size({hit}) > 0 THEN "
                  f"-cast(coalesce(try_element_at(minutes, {hit}[0].key), {UNREACHABLE}) AS double) ELSE mf END")


def place_name() -> Column:
    """Neighbourhood, else district; an empty neighbourhood counts as missing."""
    return F.coalesce(F.when(F.col("neighborhood") != "", F.col("neighborhood")), F.col("district_name"))


def top_cells(scored: DataFrame) -> DataFrame:
    """Passing cells of a written table of scores by lens, then match, then cell id; one per neighbourhood; the request's limit.
    (``topk.top_cells`` finds them without scoring all cells.)

    The best lens per (request, neighbourhood) is a hash aggregate without a sort; only neighbourhoods that can reach
    the limit (ties included) stay, a few rows per request.  Joined back, they leave the handful of cells among which
    match and id decide."""
    narrow = (scored.where("passing").where("district IS NULL OR district_id = district")
              .select("request_id", "city", "cell_id", place_name().alias("group"), lens().alias("lens"), "mf",
                      F.coalesce("limit", F.lit(20)).alias("limit")).withColumn("l9", F.round("lens", 9)))
    most = narrow.agg(F.max("limit")).first()[0] or 0         # a literal: ranks over it leave in the map tasks
    groups = narrow.groupBy("request_id", "group").agg(F.max("l9").alias("l9"), F.max("limit").alias("limit"))
    by_lens = W.partitionBy("request_id").orderBy(F.desc("l9"))
    reach = groups.withColumn("__r", F.rank().over(by_lens)).where(F.col("__r") <= most).where("__r <= limit")
    reach = broadcast_if_small(written(reach.select("request_id", "group", "l9"), "reach"), 200_000)
    order = [F.desc("l9"), F.desc(F.round("mf", 9)), F.asc("cell_id")]
    best = top_per_group(narrow.join(reach, ["request_id", "group", "l9"]), ["request_id", "group"], order, 1, "__one").drop("__one")
    return top_per_group(best, ["request_id"], order, most).where("rank <= limit").select("request_id", "city", "cell_id", "rank", "lens")


def criterion_long(scored: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(c) for c in CRITERIA])
    return (scored.select("request_id", "city", "cell_id", "habitable", F.posexplode("crit").alias("i", "s"))
            .where("s IS NOT NULL").withColumn("criterion", names[F.col("i")]))


def criterion_medians(scored: DataFrame) -> DataFrame:
    """Median criterion score over the habitable cells, per request."""
    return narrowed_medians(criterion_long(scored).where("habitable"), ["request_id", "i", "criterion"], "s")


def relax_hints(scored: DataFrame) -> DataFrame:
    """Requests where nothing passes: the one filter whose removal lets most cells through, and how many.

    One pass: a cell that fails exactly one filter counts for that filter, a cell that fails none would have passed,
    so the leave-one-out count of a filter is the number of habitable cells whose only failure it is."""
    habitable = scored.where("habitable")
    passing = habitable.groupBy("request_id").agg(F.max(F.col("passing").cast("int")).alias("any_pass"))
    failed = F.filter("masks", lambda m: ~m["ok"])
    only = (habitable.withColumn("__f", failed).where(F.size("__f") == 1)
            .select("request_id", F.col("__f")[0]["key"].alias("filter"),
                    F.array_position(F.transform("masks", lambda m: m["key"]), F.col("__f")[0]["key"]).alias("ord"))
            .groupBy("request_id", "filter", "ord").agg(F.count("*").alias("passing_after")))
    best = top_per_group(only, ["request_id"], [F.desc("passing_after"), F.asc("ord")], 1).drop("rank", "ord")
    return best.join(passing.where("any_pass = 0").select("request_id"), "request_id", "left_semi")


def response_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("request_id", "city").agg(
        F.count("*").alias("cells"), F.sum(F.col("habitable").cast("long")).alias("habitable"),
        F.sum(F.col("passing").cast("long")).alias("passing"))
