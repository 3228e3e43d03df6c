"""Map classes, thresholds and comparisons drawn from scored cells."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import cumulative

N_CLASSES = 7
COMMUTE_BANDS = (10, 20, 30, 45, 60)


def value_at(df: DataFrame, keys: Sequence[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """Value at 0-based positions (SQL on ``n``) of the ascending order per group, with ``n``."""
    c = cumulative(df, list(keys), value, {"n": F.lit(1).cast("long")}).withColumnRenamed("total_n", "__t")
    aggs = [F.min(F.when(F.col("cum_n") > p, F.col(value))).alias(k) for k, p in positions.items()]
    return c.groupBy(*keys).agg(*aggs, F.max("__t").alias("n"))


def quantile_breaks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, breaks): six thresholds at index quantiles, strictly increasing by at least one; equal widths for
    fewer than three values per class."""
    pos = {f"q{i}": F.floor(F.lit(i) / N_CLASSES * (F.col("__t") - 1)) for i in range(1, N_CLASSES)}
    v = value_at(df, keys, value, pos)
    up = F.array(*[F.greatest(F.lit(float(i)), *[F.col(f"q{j}") + float(i - j) for j in range(1, i + 1)])
                   for i in range(1, N_CLASSES)])
    even = F.array(*[F.lit(float(round(i * 100 / N_CLASSES))) for i in range(1, N_CLASSES)])
    return v.select(*keys, F.when(F.col("n") < 3 * N_CLASSES, even).otherwise(up).alias("breaks"))


def class_of(score: Column, breaks: Column) -> Column:
    return F.size(F.filter(breaks, lambda b: score >= b))


def commute_band(minutes: Column) -> Column:
    """Band index 0..5; unknown counts as the last band."""
    out = F.lit(len(COMMUTE_BANDS))
    for i, b in reversed(list(enumerate(COMMUTE_BANDS))):
        out = F.when(minutes <= b, i).otherwise(out)
    return out


def top_share_cut(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """Score that bounds the top share of the rows (101 when there are none)."""
    v = value_at(df.withColumn("__neg", -F.col(value)), keys, "__neg", {"c": F.floor(F.col("__t") * share)})
    return v.select(*keys, F.coalesce(-F.col("c"), F.lit(101.0)).alias("cut"))


def median_of_columns(cols: Sequence[str]) -> Column:
    """Median of the known values of a row."""
    a = f"array_sort(filter(array({', '.join(cols)}), x -> x IS NOT NULL))"
    n = f"size({a})"
    return F.expr(f"CASE WHEN {n} = 0 THEN NULL WHEN {n} % 2 = 1 THEN {a}[cast(({n} - 1) / 2 AS int)] "
                  f"ELSE ({a}[cast({n} / 2 AS int) - 1] + {a}[cast({n} / 2 AS int)]) / 2 END")


def mode_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per group (ties: smallest)."""
    return (df.groupBy(*keys, value).agg(F.count("*").alias("__n")).groupBy(*keys)
            .agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value)))


def rate_per_1000(events: DataFrame, weights: DataFrame, total: DataFrame, key: str) -> DataFrame:
    """Events per 1,000 residents: a total is split over the groups by weight share.  One row per group throughout."""
    whole = weights.agg(F.sum("weight").alias("__all")).crossJoin(total.select("total"))       # one row
    n = events.groupBy(key).agg(F.count("*").alias("__n"))
    return (weights.crossJoin(F.broadcast(whole)).join(n, key, "left")
            .select(key, F.round(F.try_divide(F.coalesce("__n", F.lit(0)), F.col("weight") / F.col("__all") * F.col("total"))
                                 * 1000, 2).alias("rate")))


def preferred_series(df: DataFrame, keys: Sequence[str], prefer: str, ties: Sequence[str], years: int = 3,
                     complete: float = 75.0) -> DataFrame:
    """Sufficiently complete rows of the last years, one per key: the series with the largest preference value."""
    df = df.where(F.col("completeness") >= complete)
    last = df.agg(F.max("year").alias("__last"))                                   # one row
    df = df.crossJoin(F.broadcast(last)).where(F.col("year") > F.col("__last") - years).drop("__last")
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(prefer, *ties)).alias("__r"))
            .select(*keys, "__r.*"))
