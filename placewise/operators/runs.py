"""Order statistics of rows in one pass: sorted runs, written once, with the counts before each run.

The rows of all groups are range-partitioned together by (group, value) and written; a group may span many partitions and a
partition many groups, so neither a hot group nor a hot value (equal values are parted further) lands in one task. Inside a
partition a window counts; a small table with one row per (group, partition) adds what lies in the partitions before, and what
a value has on the other side of a border. Mid-ranks, counts, medians and quantiles are then read off the rows themselves:
nothing is joined back on a value.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import is_small, written


@dataclass(frozen=True)
class Runs:
    """``rows``: the input's rows with a value, and inside their partition ``__le`` (weight of smaller or equal values) and
    ``__eq``. ``edges``: per (group, partition) ``before``, ``n``, ``total`` and the counts of its first and last value."""
    rows: DataFrame
    edges: DataFrame
    keys: tuple[str, ...]
    value: str
    small: bool = False         # the edges, and so all that has a row per group, can be broadcast

    def hint(self, df: DataFrame) -> DataFrame:
        """Broadcast a table with at most one row per group, if there are few groups."""
        return F.broadcast(df) if self.small else df

    def _placed(self) -> DataFrame:
        return self.rows.join(self.hint(self.edges), [*self.keys, "__part"])

    def ranked(self, lt: str = "lt", le: str = "le", total: str = "total") -> DataFrame:
        """The rows with the weight of smaller, of smaller or equal, and of all values of their group."""
        v = F.col(self.value)
        at_edge = lambda first, last, inside: F.when(v == F.col("first"), first).when(v == F.col("last"), last).otherwise(inside)
        below = at_edge(F.col("lt_first"), F.col("lt_last"), F.col("before") + F.col("__le") - F.col("__eq"))
        equal = at_edge(F.col("eq_first"), F.col("eq_last"), F.col("__eq"))
        names = [c for c in self.rows.columns if not c.startswith("__")]
        return self._placed().select(*names, below.alias(lt), (below + equal).alias(le), F.col("total").alias(total))

    def midranks(self, out: str = "pct") -> DataFrame:
        """The rows with their mid-rank percentile (n< + n<=) / 2 / N * 100; NULL in groups without weight."""
        pct = (F.col("__lt") + F.col("__le")) / F.lit(2.0) / F.col("__n") * 100.0
        return self.ranked("__lt", "__le", "__n").withColumn(out, F.when(F.col("__n") > 0, pct)).drop("__lt", "__le", "__n")

    def quantiles(self, qs: dict[str, float]) -> DataFrame:
        """(keys, one column per quantile, n): linearly interpolated quantiles of the rows with weight (0 or 1)."""
        aggs, outs = [], []
        upto = F.col("before") + F.col("__le")
        for name, q in qs.items():
            pos = (F.col("total") - 1) * F.lit(float(q))
            for side, p in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
                aggs.append(F.min(F.when((p < upto) & (p >= upto - F.col("__eq")), F.col(self.value))).alias(f"__{side}_{name}"))
            aggs.append(F.max(pos - F.floor(pos)).alias(f"__f_{name}"))
            lo, hi, f = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.col(f"__f_{name}")
            outs.append((lo + (hi - lo) * f).alias(name))
        found = self._placed().where("total > 0").groupBy(*self.keys).agg(*aggs, F.max("total").alias("n"))
        return self.hint(found.select(*self.keys, *outs, "n"))

    def medians(self, out: str = "median") -> DataFrame:
        return self.hint(self.quantiles({out: 0.5}).drop("n"))

    def around(self, bounds: DataFrame, bound: str) -> DataFrame:
        """(keys, lt, le): weight of values below, and below or equal to, one bound per group."""
        v, b = F.col(self.value), F.col(bound)
        rows = self.rows.select(*self.keys, self.value, "__w").join(self.hint(bounds.select(*self.keys, bound)), list(self.keys))
        return rows.groupBy(*self.keys).agg(F.sum(F.when(v < b, F.col("__w")).otherwise(0)).alias("lt"), F.sum(F.when(v <= b, F.col("__w")).otherwise(0)).alias("le"))


def rank_runs(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None, payload: Sequence[str] = ()) -> Runs:
    """Sorted runs of ``df`` per group ``keys`` (without NULLs). ``weight`` (boolean or 0/1, default 1) says which rows count;
    the others are ranked among those. ``payload`` names the columns to keep. Rows without a value are left out."""
    keys, w = list(keys), (F.lit(1) if weight is None else weight.cast("long")).cast("long")
    rows = (df.where(F.col(value).isNotNull()).select(*keys, value, *payload, w.alias("__w"))
            .withColumn("__tie", F.monotonically_increasing_id()))
    ranged = rows.repartitionByRange(*keys, value, "__tie").withColumn("__part", F.spark_partition_id()).drop("__tie")
    inside = W.partitionBy("__part", *keys)
    upto = inside.orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = written(ranged.select("*", F.sum("__w").over(upto).alias("__le"),
                                    F.sum("__w").over(W.partitionBy("__part", *keys, value)).alias("__eq")), "runs")
    per = counted.groupBy(*keys, "__part").agg(
        F.sum("__w").alias("n"), F.min(value).alias("first"), F.max(value).alias("last"),
        F.min_by("__eq", value).alias("eq_first"), F.max_by("__eq", value).alias("eq_last"))
    by_key = W.partitionBy(*keys)
    per = per.select("*", F.coalesce(F.sum("n").over(by_key.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                     F.sum("n").over(by_key).alias("total"))
    # a value at a border: what all partitions hold of it, and what lies before the first of them
    ends = per.select("*", F.explode(F.array_distinct(F.array(
        F.struct(F.col("first").alias("x"), F.col("before").alias("lt"), F.col("eq_first").alias("eq")),
        F.struct(F.col("last").alias("x"), (F.col("before") + F.col("n") - F.col("eq_last")).alias("lt"), F.col("eq_last").alias("eq"))))).alias("e"))
    of_value = W.partitionBy(*keys, "e.x")
    ends = ends.select(*keys, "__part", "n", "first", "last", "before", "total", F.col("e.x").alias("x"), F.min("e.lt").over(of_value).alias("lt"), F.sum("e.eq").over(of_value).alias("eq"))
    at = lambda side, what: F.max(F.when(F.col("x") == F.col(side), F.col(what))).alias(f"{what}_{side}")
    edges = ends.groupBy(*keys, "__part").agg(*[F.max(c).alias(c) for c in ("n", "first", "last", "before", "total")],
                                              at("first", "lt"), at("first", "eq"), at("last", "lt"), at("last", "eq"))
    edges = written(edges, "run-edges")
    return Runs(counted, edges, tuple(keys), value, is_small(edges, 200_000))


def narrowed_medians(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", bins: int = 1024, rows: int = 50_000) -> DataFrame:
    """(keys, median): exact medians, linearly interpolated, for few groups of very many rows. ``df`` should be a written table.

    Each group's range is cut into equal bins that are counted by partial aggregates; only the bins that hold the two middle values
    are looked at again, cut anew while they hold more than ``rows`` rows of different values. What is shuffled are counts and the
    rows of the last bins, so neither a task nor a shuffle grows with the input. Rows without a value are left out."""
    keys, v = list(keys), F.col(value)
    rows_of = df.where(v.isNotNull()).select(*keys, value)
    ranges = rows_of.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count("*").alias("__total"))
    ranges = _few(written(ranges.select(*keys, "__lo", "__hi", "__total", F.lit(0).cast("long").alias("__below")), "median-range"))
    first, last = F.floor((F.col("__total") - 1) / 2), F.ceil((F.col("__total") - 1) / 2)
    holds = lambda upto, n: ((first < upto) & (first >= upto - n)) | ((last < upto) & (last >= upto - n))
    of = [*keys, "__lo", "__hi", "__total", "__below"]
    for _ in range(60):                                   # a range of doubles cannot be cut more often
        bin_ = F.least(F.floor((v - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
        inside = rows_of.join(ranges, keys).where(v.between(F.col("__lo"), F.col("__hi")))
        counted = inside.groupBy(*of, F.coalesce(bin_, F.lit(0)).alias("__bin")).agg(F.count("*").alias("__n"), F.min(value).alias("__min"), F.max(value).alias("__max"))
        upto = F.col("__below") + F.sum("__n").over(W.partitionBy(*keys, "__lo").orderBy("__bin"))
        kept = counted.withColumn("__upto", upto).where(holds(F.col("__upto"), F.col("__n")))
        kept = written(kept.select(*keys, F.col("__min").alias("__lo"), F.col("__max").alias("__hi"), "__total", (F.col("__upto") - F.col("__n")).alias("__below"), "__n"), "median-range")
        ranges = _few(kept.drop("__n"))
        if kept.where((F.col("__n") > rows) & (F.col("__lo") < F.col("__hi"))).isEmpty():
            break
    folded = rows_of.join(ranges, keys).where(v.between(F.col("__lo"), F.col("__hi"))).groupBy(*of, value).agg(F.count("*").alias("__n"))
    upto = F.col("__below") + F.sum("__n").over(W.partitionBy(*keys, "__lo").orderBy(value))
    at = folded.withColumn("__upto", upto).where(holds(F.col("__upto"), F.col("__n")))
    ends = at.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__b"), F.max("__total").alias("__total"))
    share = (F.col("__total") - 1) * F.lit(0.5) - first
    return ends.select(*keys, (F.col("__a") + (F.col("__b") - F.col("__a")) * share).alias(out))


def _few(ranges: DataFrame) -> DataFrame:
    return F.broadcast(ranges) if is_small(ranges, 200_000) else ranges
