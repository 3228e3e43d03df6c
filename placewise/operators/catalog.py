"""What a region offers: coverage, indicators, prices; the offline score; named-place assertions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import CRITERIA, LEVEL_WEIGHT, MUST_HAVE, PERSONAS, PRICE, Indicator
from ..functions.norm import half_even
from .quality import spec_table, weighted_coverage
from .runs import rank_runs


def region_overview(stats: DataFrame, cells: DataFrame, specs: Sequence[Indicator]) -> DataFrame:
    """Per city and criterion: coverage, currency, price mode, number of cells.  ``stats``: (city, j, coverage)."""
    cov = weighted_coverage(stats.withColumn("indicator", F.lit("")), specs).drop("beta")
    cur = " ".join(f"WHEN '{c}' THEN '{p[3]}'" for c, p in PRICE.items())
    mode = " ".join(f"WHEN '{c}' THEN '{p[0].split('.')[1].split('_')[0]}'" for c, p in PRICE.items())
    n = cells.groupBy("city").agg(F.count("*").alias("cells"))
    return cov.join(n, "city").selectExpr("city", "criterion", "coverage", f"CASE city {cur} END AS currency", f"CASE city {mode} END AS price_mode", "cells")


def indicator_catalog(stats: DataFrame, specs: Sequence[Indicator]) -> DataFrame:
    """Per city and applicable indicator: coverage, availability, base weight, norm."""
    rows = [(s.key, s.weight, s.norm, s.city) for s in specs]
    spec = stats.sparkSession.createDataFrame(rows, "indicator string, weight double, norm string, only_city string")
    return (stats.join(spec, "indicator").where("only_city IS NULL OR only_city = city")
            .select("city", "indicator", half_even(F.col("coverage"), 3).alias("coverage"), (F.col("coverage") > 0).alias("available"), "weight", "norm"))


def whole_catalog(stats: DataFrame, values: DataFrame, specs: Sequence[Indicator]) -> DataFrame:
    """(section, city, indicator, coverage, available, weight, norm, median, low, high): the indicators of each city, its must-have
    categories (available where their column has data in the city), and the spread of its price indicator.

    ``stats``: (city, indicator, coverage); ``values``: (city, indicator, v) of the habitable cells."""
    spark, none = stats.sparkSession, lambda kind: F.lit(None).cast(kind)
    ind = indicator_catalog(stats, specs).select(F.lit("indicator").alias("section"), "*", *[none("double").alias(c) for c in ("median", "low", "high")])
    wanted = spark.createDataFrame([(cat, col, city, only) for cat, (col, only) in MUST_HAVE.items() for city in PRICE], "category string, indicator string, city string, only string")
    must = wanted.join(stats, ["city", "indicator"], "left").select(
        F.lit("mustHave").alias("section"), "city", F.col("category").alias("indicator"), none("double").alias("coverage"),
        F.coalesce((F.col("coverage") > 0) & (F.col("only").isNull() | (F.col("only") == F.col("city"))), F.lit(False)).alias("available"),
        none("double").alias("weight"), none("string").alias("norm"), *[none("double").alias(c) for c in ("median", "low", "high")])
    price = F.broadcast(spark.createDataFrame([(c, p[0]) for c, p in PRICE.items()], "city string, indicator string"))          # a row per city
    runs = rank_runs(values.join(price, ["city", "indicator"]), ["city", "indicator"], "v")
    spread = runs.quantiles({"median": 0.5, "low": 0.0, "high": 1.0}).select(
        F.lit("price").alias("section"), "city", "indicator", none("double").alias("coverage"), F.lit(True).alias("available"), none("double").alias("weight"), none("string").alias("norm"),
        "median", "low", "high")
    return ind.unionByName(must).unionByName(spread)


def static_match(static: DataFrame) -> DataFrame:
    """The offline client's match from whole criterion scores: level-weighted mean of the known ones, plain mean if
    nothing rated is known; rounds half up."""
    rows = [(p.id, [float(LEVEL_WEIGHT[p.levels[c]]) for c in CRITERIA]) for p in PERSONAS]
    w = static.sparkSession.createDataFrame(rows, "persona string, lw array<double>")
    arr = "array(" + ", ".join(CRITERIA) + ")"
    known = f"filter(zip_with({arr}, lw, (v, w) -> struct(v AS v, w AS w)), t -> t.v IS NOT NULL)"
    df = static.join(w, "persona").selectExpr("*", f"{known} AS t")
    num, den = "aggregate(t, 0D, (a, x) -> a + x.v * x.w)", "aggregate(t, 0D, (a, x) -> a + x.w)"
    mean = "try_divide(aggregate(t, 0D, (a, x) -> a + x.v), size(t))"
    return df.selectExpr("city", "persona", "cell_id", "habitable",
                         f"cast(floor(coalesce(CASE WHEN {den} > 0 THEN {num} / {den} ELSE {mean} END, 0D) + 0.5D) AS int) AS score")


def rank_assertions(values: DataFrame, group: str) -> DataFrame:
    """Which groups lie in the upper half of their city by the median of an indicator: one row per (city, indicator, group).
    ``values``: (city, indicator, group, v). A city has few groups; groups without a value come last."""
    keys = ["city", "indicator", group]
    m = rank_runs(values, keys, "v").medians("m")
    g = values.select(*keys).distinct().join(m, keys, "left")
    w = W.partitionBy("city", "indicator")
    r = g.withColumn("rk", F.row_number().over(w.orderBy(F.desc_nulls_last(F.round("m", 9)), F.asc(group)))).withColumn("n", F.count("*").over(w))
    return r.select(F.concat(group, F.lit(" in the upper half for "), "indicator").alias("name"), (F.col("rk") <= F.floor(F.col("n") / 2)).alias("passed"),
                    F.concat("city", F.lit(" rank "), "rk", F.lit("/"), "n").alias("detail"))
