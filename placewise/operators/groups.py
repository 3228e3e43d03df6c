"""Districts and neighbourhoods: summaries, scores, pooled rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CRITERIA, PRICE, UNREACHABLE, Indicator
from ..session import broadcast_if_small
from .ranking import medians, top_per_group

LEVELS = {"district": "district_id", "neighborhood": "neighborhood"}


def group_id(level: str) -> Column:
    """Group of a cell; an empty neighbourhood is no group."""
    c = F.col(LEVELS[level])
    return F.when(c != "", c)


def group_summary(cells: DataFrame, level: str) -> DataFrame:
    """Members, habitable members, mean centroid, population; parent = most frequent district (ties: smallest)."""
    g = cells.withColumn("group_id", group_id(level)).where("group_id IS NOT NULL")
    part = g.groupBy("city", "group_id", "district_id").agg(
        F.count("*").alias("n"), F.sum(F.col("habitable").cast("long")).alias("h"), F.sum("lat").alias("slat"),
        F.sum("lon").alias("slon"), F.sum("population_est").alias("pop"), F.min("district_name").alias("dn"))
    out = part.groupBy("city", "group_id").agg(
        F.sum("n").alias("cells"), F.sum("h").alias("habitable"), (F.sum("slat") / F.sum("n")).alias("lat"),
        (F.sum("slon") / F.sum("n")).alias("lon"), F.sum("pop").alias("population"),
        F.expr("min_by(district_id, struct(-n, district_id))").alias("parent"), F.min("dn").alias("district_name"))
    name = F.col("district_name") if level == "district" else F.col("group_id")
    return out.withColumn("name", name).withColumn("level", F.lit(level)).drop("district_name")


def weighted(x: Column, w: Column) -> Column:
    """Weighted mean over the rows where x is known."""
    return F.sum(x * w) / F.sum(F.when(x.isNotNull(), w))


def group_scores(scored: DataFrame, level: str, specs: Sequence[Indicator]) -> DataFrame:
    """Per request and group: (population + 1)-weighted means over all habitable cells; groups without a passing
    cell are dropped."""
    pool = scored.where("habitable").withColumn("group_id", group_id(level)).where("group_id IS NOT NULL") \
                 .withColumn("pw", F.col("population_est") + F.lit(1.0))
    idx = {s.key: j for j, s in enumerate(specs)}
    price = F.expr("CASE " + " ".join(f"WHEN city = '{c}' THEN raw[{idx[p[0]]}]" for c, p in PRICE.items() if p[0] in idx) + " END")
    pw = F.col("pw")
    return (pool.groupBy("request_id", "city", "group_id")
            .agg((F.sum(F.col("mf") * pw) / F.sum(pw)).alias("score"), F.avg(F.col("passing").cast("double")).alias("share"),
                 F.count("*").alias("cell_count"), weighted(price, pw).alias("price_value"),
                 F.array(*[weighted(F.col("crit")[i], pw) for i in range(len(CRITERIA))]).alias("crit"))
            .where("share > 0"))


ASKED = ("cw", "lv", "total_w", "w", "den", "coverage", "median", "anchors", "anchor_slots", "budget")


def group_rows(scored: DataFrame, ranked: DataFrame, level: str, specs: Sequence[Indicator]) -> DataFrame:
    """The ranked groups as if each were a cell: ``crit``, ``s`` and ``raw`` are (population + 1)-weighted means over its habitable
    cells (raw: over those that know the value, ``imputed`` where none does), ``minutes`` the truncated medians of the reachable
    ones. Only cells of ranked groups are pooled. What explains a cell explains these rows too."""
    few = broadcast_if_small(ranked.select("request_id", "group_id"), 200_000)
    pool = (scored.where("habitable").withColumn("group_id", group_id(level)).withColumn("pw", F.col("population_est") + F.lit(1.0))
            .join(few, ["request_id", "group_id"]))
    pw, n = F.col("pw"), range(len(specs))
    rows = pool.groupBy("request_id", "city", "group_id").agg(
        F.array(*[weighted(F.col("crit")[i], pw) for i in range(len(CRITERIA))]).alias("crit"), F.array(*[weighted(F.col("s")[j], pw) for j in n]).alias("s"),
        F.array(*[weighted(F.col("raw")[j], pw) for j in n]).alias("raw"), *[F.first(c).alias(c) for c in ASKED])
    mins = group_minutes(pool, level).groupBy("request_id", "group_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "median"))).alias("minutes"))
    return rows.withColumn("imputed", F.transform("raw", lambda r: r.isNull())).join(mins, ["request_id", "group_id"], "left")


def group_minutes(scored: DataFrame, level: str) -> DataFrame:
    """Truncated median of the reachable minutes per request, group and anchor position."""
    m = (scored.where("habitable AND minutes IS NOT NULL").withColumn("group_id", group_id(level))
         .where("group_id IS NOT NULL").select("request_id", "group_id", F.explode("minutes").alias("pos", "m")))
    return medians(m, ["request_id", "group_id", "pos"], "m").withColumn("median", F.col("median").cast("int"))


def ranked_groups(scored: DataFrame, level: str, specs: Sequence[Indicator]) -> DataFrame:
    """Groups by lens, then score, then id, up to the request's limit."""
    g = group_scores(scored, level, specs)
    req = scored.select("request_id", "rankBy", "limit", "den", "anchor_slots").dropDuplicates(["request_id"])
    aid = "filter(map_entries(anchor_slots), e -> e.value.id = substring(rankBy, 8))"
    req = req.selectExpr("request_id", "rankBy", "coalesce(limit, 20) AS limit", "den",
                         f"CASE WHEN rankBy LIKE 'anchor:%' AND size({aid}) > 0 THEN {aid}[0].key END AS pos")
    mins = group_minutes(scored, level)
    g = g.join(req, "request_id").join(mins, ["request_id", "group_id", "pos"], "left")
    one = " ".join(f"WHEN rankBy = '{c}' AND den[{i}] > 0 THEN crit[{i}]" for i, c in enumerate(CRITERIA))
    g = g.withColumn("group_key", F.expr(f"CASE {one} WHEN pos IS NOT NULL THEN -cast(coalesce(median, {UNREACHABLE}) AS double) ELSE score END"))
    order = [F.desc(F.round("group_key", 9)), F.desc(F.round("score", 9)), F.asc("group_id")]
    most = req.agg(F.max("limit")).first()[0] or 0
    return top_per_group(g, ["request_id"], order, most).where("rank <= limit") \
        .select("request_id", "city", "group_id", "rank", "group_key", "score", "share", "cell_count", "price_value", "crit")


def pool_rows(cells_long: DataFrame, level_col: str) -> DataFrame:
    """(city, group, indicator) -> weighted mean of the known raw values over habitable cells; ``imputed`` without any."""
    w = F.col("population_est") + F.lit(1.0)
    return (cells_long.where("habitable").groupBy("city", level_col, "indicator")
            .agg(weighted(F.col("v"), w).alias("value"), (F.count("v") == 0).alias("imputed")))


def pooled_features(per_city: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Cities' tables stacked on the shared columns, NULL where a city lacks one."""
    keep = ["city", "cell_id", "habitable"]
    parts = [p.select(*keep, *[F.col(f"`{c}`") for c in columns if c in p.columns]) for p in per_city]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
