import random
import statistics

from pyspark.sql import functions as F

from placewise.operators import ranking as R


def rows(n=400):
    rnd = random.Random(1)
    return [("a" if rnd.random() < 0.8 else "b", float(rnd.randint(0, 60)), rnd.random() < 0.7) for _ in range(n)]


def test_cumulative_is_exact_for_any_bucketing(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double, hab boolean")
    for every in (3, 1 << 20):
        got = {(r.g, r.v): (r.n, r.cum_n, r.total_n) for r in
               R.cumulative(df, ["g"], "v", {"n": F.lit(1).cast("long")}, bound_every=every).collect()}
        for (g, v), (n, cum, total) in got.items():
            same = [x[1] for x in data if x[0] == g]
            assert (n, cum, total) == (same.count(v), sum(x <= v for x in same), len(same))


def test_midrank_example(spark):
    df = spark.createDataFrame([("c", 1.0, True), ("c", 1.0, True), ("c", 2.0, False), ("c", 3.0, True)], "g string, v double, hab boolean")
    got = {r.v: round(r.pct, 2) for r in R.midrank(df, ["g"], "v", F.col("hab")).collect()}
    assert got == {1.0: 33.33, 2.0: 66.67, 3.0: 83.33}


def test_median_and_positions(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double, hab boolean")
    for every in (2, 1 << 20):
        got = {r.g: r.m for r in R.medians(df, ["g"], "v", "m", bound_every=every).collect()}
        assert got == {g: statistics.median(x[1] for x in data if x[0] == g) for g in "ab"}
    numbered = spark.range(500).select((F.col("id") * 37 % 501).alias("k"), F.lit("x").alias("g"))
    pos = sorted((r.k, r.pos) for r in R.global_positions(numbered, ["g"], [F.asc("k")], "pos", partitions=5).collect())
    assert [p for _, p in pos] == list(range(1, 501))
