"""Order statistics that never put a whole group into one task.

A window over (city, indicator) or an exact ``percentile`` aggregate keeps one group in one task.  Here rows are
first folded to distinct values (map-side combine absorbs hot values), each group is split into value buckets at
boundaries drawn from the values themselves, running sums are taken inside a bucket, and the sums of the lower
buckets are added from a table with one row per bucket.  The boundaries are a deterministic function of the data
(values whose hash is a multiple of ``bound_every``), so a recomputed task sees the same buckets; results are exact
for any choice.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut

BOUND_EVERY = 1 << 20   # expected distinct values per bucket


def cumulative(df: DataFrame, keys: list[str], value: str, weights: dict[str, Column],
               bound_every: int = BOUND_EVERY) -> DataFrame:
    """One row per (keys, value) with, per weight w: ``w`` its sum, ``cum_w`` the running sum over smaller or equal
    values, and ``total_w`` the sum over the group."""
    names = list(weights)
    folded = df.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    bounds = (folded.where(F.pmod(F.xxhash64(value), F.lit(bound_every)) == 0)
              .groupBy(*keys).agg(F.collect_list(value).alias("__bounds")))
    placed = (folded.join(bounds, keys, "left")
              .withColumn("__bucket", F.coalesce(F.size(F.filter("__bounds", lambda b: b < F.col(value))), F.lit(0)))
              .drop("__bounds"))
    placed = placed.withColumn("__bucket", F.greatest("__bucket", F.lit(0)))
    inside = W.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    per_bucket = placed.groupBy(*keys, "__bucket").agg(*[F.sum(n).alias(n) for n in names])
    per_bucket = per_bucket.select(
        *keys, "__bucket",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in names],
        *[F.sum(n).over(whole).alias(f"total_{n}") for n in names])
    return (placed.select("*", *[F.sum(n).over(inside).alias(f"__in_{n}") for n in names])
            .join(per_bucket, [*keys, "__bucket"])
            .select(*keys, value, *names,
                    *[(F.col(f"__in_{n}") + F.col(f"__before_{n}")).alias(f"cum_{n}") for n in names],
                    *[f"total_{n}" for n in names]))


def midrank(df: DataFrame, keys: list[str], value: str, reference: Column, out: str = "pct",
            bound_every: int = BOUND_EVERY) -> DataFrame:
    """(keys, value) -> mid-rank percentile (n< + n<=)/2/N*100 against the rows where ``reference`` holds."""
    c = cumulative(df.where(F.col(value).isNotNull()), keys, value, {"n": reference.cast("long")}, bound_every)
    lt = F.col("cum_n") - F.col("n")
    pct = (lt + F.col("cum_n")) / F.lit(2.0) / F.col("total_n") * 100.0
    return c.select(*keys, value, F.when(F.col("total_n") > 0, pct).alias(out))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float],
              bound_every: int = BOUND_EVERY) -> DataFrame:
    """Exact linearly interpolated quantiles per group (numpy's default), NULLs ignored."""
    c = cumulative(df.where(F.col(value).isNotNull()), keys, value, {"n": F.lit(1).cast("long")}, bound_every)
    aggs, outs = [], []
    for name, q in qs.items():
        pos = (F.col("total_n") - 1) * F.lit(float(q))
        aggs += [F.min(F.when(F.col("cum_n") > F.floor(pos), F.col(value))).alias(f"__lo_{name}"),
                 F.min(F.when(F.col("cum_n") > F.ceil(pos), F.col(value))).alias(f"__hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"__f_{name}")]
        lo, hi, f = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.col(f"__f_{name}")
        outs.append((lo + (hi - lo) * f).alias(name))
    return c.groupBy(*keys).agg(*aggs, F.max("total_n").alias("n")).select(*keys, *outs, "n")


def medians(df: DataFrame, keys: list[str], value: str, out: str = "median",
            bound_every: int = BOUND_EVERY) -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5}, bound_every).drop("n")


def mean_rank_share(df: DataFrame, keys: list[str], value: str, bound_every: int = BOUND_EVERY) -> DataFrame:
    """(keys, value) -> average-of-ties rank divided by the number of non-NULL values."""
    c = cumulative(df.where(F.col(value).isNotNull()), keys, value, {"n": F.lit(1).cast("long")}, bound_every)
    rank = F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)
    return c.select(*keys, value, (rank / F.col("total_n")).alias("pct_rank"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, out: str = "rank") -> DataFrame:
    """First k rows per group; the rank filter on the window prunes inside the map tasks before the shuffle, so a
    hot group reaches its reducer as k rows per map task."""
    return (df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .where(F.col(out) <= k))


def global_positions(df: DataFrame, keys: list[str], order: list[Column], out: str = "pos",
                     partitions: int | None = None) -> DataFrame:
    """1-based position of every row in the order, per group, for groups that do not fit one task.

    Rows are range-partitioned by (keys, order) and written to the checkpoint folder, so the partition numbers are
    fixed; each partition is numbered by its own window and the counts of the earlier partitions are added."""
    cols = [F.asc(k) for k in keys] + order
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    fixed = cut(ranged.withColumn("__part", F.spark_partition_id()))
    inside = W.partitionBy("__part", *keys).orderBy(*order)
    counts = fixed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)),
                        F.lit(0))
    counts = counts.select(*keys, "__part", before.alias("__before"))
    return (fixed.withColumn("__i", F.row_number().over(inside)).join(counts, [*keys, "__part"])
            .withColumn(out, F.col("__i") + F.col("__before")).drop("__i", "__before", "__part"))
