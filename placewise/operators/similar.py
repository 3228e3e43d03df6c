"""Pooled vectors, reference distances, similar places and twins."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LOG_UNITS, Indicator
from ..session import broadcast_if_small, written
from .ranking import global_positions, top_per_group
from .runs import rank_runs


def cross_slots(specs: Sequence[Indicator], usable: set[str] | None = None) -> list[int]:
    """Positions of the comparable, non-alias indicators, in key order."""
    js = [j for j, s in enumerate(specs) if s.cross_city and not s.is_alias and (usable is None or s.key in usable)]
    return sorted(js, key=lambda j: specs[j].key)


def pooled_vectors(prepared: DataFrame, specs: Sequence[Indicator], slots: Sequence[int]) -> DataFrame:
    """Adds ``z``: filled values, heavy tails on a log scale, standardised with mean and population deviation of the
    habitable cells of all cities.  One aggregate of 2 x d numbers, attached to every row."""
    v = [f"ln(1 + greatest(filled[{j}], 0D))" if specs[j].unit in LOG_UNITS else f"filled[{j}]" for j in slots]
    df = prepared.selectExpr("*", "array(" + ", ".join(v) + ") AS __v")
    fit = df.where("habitable").agg(*[F.avg(F.col("__v")[i]).alias(f"m{i}") for i in range(len(v))],
                                    *[F.stddev_pop(F.col("__v")[i]).alias(f"s{i}") for i in range(len(v))])
    z = "array(" + ", ".join(f"(__v[{i}] - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1D END" for i in range(len(v))) + ")"
    return df.crossJoin(F.broadcast(fit)).withColumn("z", F.expr(z)).select(*prepared.columns, "z")     # one row


def distance(a: str, b: str) -> Column:
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")


def similarity(a: str, b: str, d_ref: Column) -> Column:
    """1 - distance / reference: 1 = identical, 0 = two random places, negative beyond."""
    return F.lit(1.0) - distance(a, b) / d_ref


def weighted_mean_vector(df: DataFrame, keys: Sequence[str], weight: Column, d: int, vec: str = "z") -> DataFrame:
    w = weight
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.col(vec)[i] * w) / F.sum(w) for i in range(d)]).alias(vec), F.count("*").alias("cells"))


def group_vectors(pooled: DataFrame, d: int, key: str = "district_id") -> DataFrame:
    """(population + 1)-weighted mean vector of the habitable cells per city and group."""
    return weighted_mean_vector(pooled.where("habitable"), ["city", key], F.col("population_est") + F.lit(1.0), d)


def _shuffled(df: DataFrame, id_col: str, mul: int, seed: int, side: str) -> DataFrame:
    """The habitable rows of each city numbered in the order of an arithmetic hash: a reproducible permutation."""
    h = F.pmod(F.col(id_col).cast("long") * mul + seed, F.lit(1_000_003))
    rows = df.where("habitable").select("city", id_col, "z").withColumn("__h", h)
    return (global_positions(rows, ["city"], [F.asc("__h"), F.asc(id_col)], "k")
            .select(F.col("city").alias(f"city_{side}"), "k", F.col("z").alias(f"z_{side}")))


def reference_distances(pooled: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """(city_a, city_b, d_ref): median distance of random habitable pairs for every ordered pair of cities.

    Two permutations of each city's rows are laid side by side, so every row of the smaller city stands in a pair: as many
    pairs as rows, whatever their number."""
    a, b = _shuffled(pooled, id_col, 7919, 17, "a"), _shuffled(pooled, id_col, 104729, 29, "b")
    d = a.join(b, "k").select("city_a", "city_b", distance("z_a", "z_b").alias("d"))
    return rank_runs(d, ["city_a", "city_b"], "d").medians("d_ref")


def group_pairs(vectors: DataFrame, key: str = "district_id") -> DataFrame:
    """Every group of one city with every group of another (and of its own, itself excluded): groups are districts, one
    row per district on either side, matched through the list of city pairs."""
    cities = vectors.select("city").distinct()
    pairs = cities.select(F.col("city").alias("city_a")).join(cities.select(F.col("city").alias("city_b")), F.lit(True))
    a = vectors.select(F.col("city").alias("city_a"), F.col(key).alias("group_a"), F.col("z").alias("z_a"))
    b = vectors.select(F.col("city").alias("city_b"), F.col(key).alias("group_b"), F.col("z").alias("z_b"))
    return (a.join(pairs, "city_a").join(b, "city_b").where((F.col("city_a") != F.col("city_b")) | (F.col("group_a") != F.col("group_b")))
            .withColumn("d", distance("z_a", "z_b")))


def diverse_top(df: DataFrame, query: Sequence[str], group: str, order: list[Column], limit: int, per_group: int = 1) -> DataFrame:
    """Best rows per query, at most ``per_group`` from one group."""
    first = top_per_group(df, [*query, group], order, per_group, "__g").drop("__g")
    return top_per_group(first, list(query), order, limit)


def candidates(queries: DataFrame, pooled: DataFrame, d_ref: DataFrame, other_city: bool, rings: int = 2) -> DataFrame:
    """(query_id, cell, similarity) of the habitable cells of the query's own city outside its rings, or of the other
    cities.  Queries carry (query_id, city, cell_id, q, r, z); they are broadcast behind a check of their number."""
    c = pooled.where("habitable").select(F.col("city").alias("city_b"), F.col("cell_id").alias("match_id"), F.col("q").alias("q_b"),
                                         F.col("r").alias("r_b"), F.col("z").alias("z_b"), "place", "crit")
    q = queries.select("query_id", F.col("city").alias("city_a"), F.col("q").alias("q_a"), F.col("r").alias("r_a"), F.col("z").alias("z_a"),
                       F.col("crit").alias("crit_a"))
    q = broadcast_if_small(written(q.join(d_ref, "city_a"), "queries"))         # few: the cells are not shuffled by their city
    q = q.where("city_a <> city_b") if other_city else q.where("city_a = city_b")
    j = c.join(q, "city_b")
    if not other_city:
        dq, dr = F.col("q_a") - F.col("q_b"), F.col("r_a") - F.col("r_b")
        j = j.where((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2 > rings)
    return j.withColumn("sim", similarity("z_a", "z_b", F.col("d_ref")))


def shared_traits(a: str, b: str, names: Sequence[str], threshold: float = 60.0) -> Column:
    """Up to four criteria good in both (commute excluded), best sum first."""
    arms = ", ".join(f"CASE WHEN {a}[{i}] >= {threshold}D AND {b}[{i}] >= {threshold}D THEN struct(-round({a}[{i}] + {b}[{i}], 9) AS n, {i} AS i, '{c}' AS c) END"
                     for i, c in enumerate(names) if c != "commute")
    return F.expr(f"transform(slice(array_sort(filter(array({arms}), x -> x IS NOT NULL)), 1, 4), x -> x.c)")
