"""Headline timings on the given tables; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""
from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession, functions as F

from placewise.operators import scoring as S, topk as K
from placewise.plans import bindings as B, load, scoring_queries as SQ

HEADLINE = ("W01_midrank_percentile", "A10_stop_stats", "J08_nearest_neighbor", "J09_radius_join_count", "J13_point_in_polygon",
            "A13_kring_median_expanding", "P14_iqr_trim", "J05_address_geocode_cascade", "M08_similar_places", "E11_search_rank")


def timed(fn):
    t = time.time()
    fn()
    return round(time.time() - t, 3)


def many_requests(spark, d, n):
    """Score n requests (the persona defaults of both cities, repeated) and rank their cells."""
    base = [r for r in B.REQUESTS if r["request_id"] > 100]
    rows = [{**base[i % len(base)], "request_id": 10_000 + i} for i in range(n)]
    cov = SQ.prepared(spark, d).groupBy("city").agg(F.first("coverage").alias("coverage"))
    compiled = S.compile_requests(B.requests(spark, d, rows), cov, None, B.SPECS)
    K.top_cells(SQ.tiles(spark, d), compiled, None, B.SPECS).write.format("noop").mode("overwrite").save()


def main():
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    out = {}
    B.table(spark, d, "part").count()      # start the executors before the first timing
    out["prepare_cells"] = timed(lambda: SQ.tiles(spark, d))         # percentiles, tiles and their bounds
    out["E01_score_response_hex"] = timed(lambda: queries["E01_score_response_hex"](spark, d).write.format("noop").mode("overwrite").save())
    for n in (1, 100, 1000):
        out[f"score_{n}_requests"] = timed(lambda: many_requests(spark, d, n))
    for name in HEADLINE:
        out[name] = timed(lambda: queries[name](spark, d).write.format("noop").mode("overwrite").save())
    cells = B.table(spark, d, "part").count()
    line = {"metric": "headline queries, total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": d.rsplit("sf", 1)[-1],
            "cells_scored_per_sec": round(1000 * (cells / 2) / out["score_1000_requests"]),
            "requests_per_sec": round(1000 / out["score_1000_requests"], 1)}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
