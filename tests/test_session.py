"""Settings that keep large tables out of the driver."""
from pyspark.sql import functions as F

from placewise.operators import spatial as SP
from placewise.session import BROADCAST_BYTES, configure


def test_well_compressed_files_are_not_broadcast(spark, tmp_path):
    """400,000 cells are a small file, but 20 MB of rows: the planner leaves them to a shuffle."""
    spark.range(400_000).select(F.lit("a").alias("city"), "id", (F.col("id") % 64).alias("q"), F.expr("id div 64").alias("r"), F.lit("x" * 40).alias("name")) \
        .coalesce(1).write.parquet(str(tmp_path / "cells"))
    cells = configure(spark).read.parquet(str(tmp_path / "cells"))
    out = SP.ring_join(cells.select("city", "id", "q", "r"), cells.selectExpr("city", "q", "r", "id AS neighbor", "name"), 1)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()


def test_a_lower_limit_of_the_user_stays(spark):
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    try:
        for given, kept in (("256k", 256 << 10), ("-1", -1), ("1g", BROADCAST_BYTES)):
            spark.conf.set(conf, given)
            configure(spark)
            assert int(spark.conf.get(conf)) == kept
    finally:
        spark.conf.set(conf, before)


def test_rows_are_dealt_before_they_multiply(spark):
    """A small file is one task: 37 candidates a row and the way down the tree of targets belong to many."""
    cells = spark.range(1_000).selectExpr("'a' AS city", "id AS cell_id", "id % 30 AS q", "id div 30 AS r", "id % 30 * 1.0D AS x", "id div 30 * 1.0D AS y").coalesce(1)
    assert SP.ring_pairs(cells, 3).rdd.getNumPartitions() >= 4
    plans = []
    written, SP.written = SP.written, lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or written(df, name)
    try:
        out = SP.nearest(cells, cells.selectExpr("city", "cell_id AS t", "x", "y"), ["city", "cell_id"], "t", ["city"])
    finally:
        SP.written = written
    assert "REPARTITION_BY_NUM" in dict(plans)["near-leaves"]
    assert out.where("t <> cell_id").count() == 0
