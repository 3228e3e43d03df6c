"""Pruned top-k against the ranking of all scored cells."""
import random

import pytest
from pyspark.sql import functions as F

from placewise.config import CRITERIA
from placewise.operators import cells as C, scoring as S, topk as K
from placewise.plans import bindings as B, scoring_queries as Q
from placewise.session import written

D = "/root/testdata/sf0.01"


def _requests(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        anchors = [B._anchor("work", rng.randint(1, 9), "transit", rng.randint(1, 5), rng.choice([None, 30]))] if rng.random() < 0.3 else []
        out.append(dict(request_id=i, city=rng.choice(["praha", "krakow"]), persona=rng.choice([None, "student", "senior", "custom"]), weights={c: rng.randint(0, 5) for c in CRITERIA},
                        limit=rng.choice([1, 5, 20, 150, 400]), anchors=anchors, rankBy=rng.choice([None, None, "green", "price", "commute", "anchor:work"]),
                        maxPrice=rng.choice([None, None, 900.0, 1.0]), maxNoise=rng.choice([None, 45.0]), must=rng.choice([[], [("supermarket", 9.0)], [("pharmacy", 8.0), ("metro_station", 5.0)]]),
                        district=rng.choice([None, None, "Brand#7"])))
    return out


def _rows(df):
    return sorted((r.request_id, r["rank"], r.cell_id, None if r.lens is None else round(r.lens, 9)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_ranking_of_all_cells(spark, seed):
    compiled, minutes = Q.asked(spark, D, _requests(40, seed))
    every = S.top_cells(written(S.score_cells(Q.prepared(spark, D), compiled, minutes, B.SPECS), "all"))
    assert _rows(K.top_cells(Q.tiles(spark, D), compiled, minutes, B.SPECS)) == _rows(every)
    assert every.agg(F.max("rank")).first()[0] > 100                                   # limits over a hundred are met


def _smooth(spark):
    """Cells whose indicators rise towards one corner of the city: near cells are alike."""
    base = Q.prepared(spark, D).where("city = 'praha'").drop("raw", "filled", "pct", "imputed", "median", "coverage")
    x = (F.col("lat") - 50.0) * 20 + (F.col("lon") - 14.2) * 5 + F.pmod(F.xxhash64("cell_id"), F.lit(100)) / 1e4
    return C.prepare(base.select("*", *[F.when(F.lit(s.norm != "decay"), x).otherwise(x * 3 + s.bad).alias(s.column) for s in B.SPECS if not s.is_alias]), B.SPECS)


def test_reads_only_tiles_that_reach_the_threshold(spark):
    prepared = written(_smooth(spark), "smooth")
    t = K.tiles(prepared, B.SPECS, tile_cells=16)
    rows = [dict(request_id=i, city="praha", persona="custom", weights={c: 5 if c == only else 0 for c in CRITERIA}, limit=3) for i, only in enumerate(["transit", "safety"])]
    req = B.requests(spark, D, rows)
    compiled = S.compile_requests(req, prepared.groupBy("city").agg(F.first("coverage").alias("coverage")), None, B.SPECS)
    want = _rows(S.top_cells(written(S.score_cells(prepared, compiled, None, B.SPECS), "all")))
    assert _rows(K.top_cells(t, compiled, None, B.SPECS)) == want
    first = t.cells.where(F.pmod(F.xxhash64("city", "cell_id"), F.lit(K.PROBE)) == 0)
    floor = K.floors(K._candidates(first, compiled, None, B.SPECS), K.most(compiled))
    read = K.pairs(t, compiled.join(floor, "request_id", "left"), B.SPECS).count()
    assert 0 < read < 0.5 * K.tiles_of(t, compiled)


def test_ranks_are_pruned_in_the_map_tasks(spark):
    compiled, _ = Q.asked(spark, D, _requests(3, 5))
    some = K._candidates(Q.tiles(spark, D).cells, compiled, None, B.SPECS)
    assert "WindowGroupLimit" in K.ranked(some, 20)._jdf.queryExecution().executedPlan().toString()


def test_many_requests_are_joined_in_blocks(spark, monkeypatch):
    """25,000 requests on a few cells: block by block, without a sort-merge join."""
    n = 25_000
    seen = spark.range(n).select(F.col("id").alias("request_id"), F.when(F.col("id") % 3 == 0, "krakow").otherwise("praha").alias("city"))
    one = Q.asked(spark, D, [dict(request_id=0, city=c, persona="custom", weights={"green": 3}, limit=2) for c in ("praha", "krakow")])[0].drop("request_id")
    compiled = written(seen.join(F.broadcast(one), "city"), "many")
    small = Q.tiles(spark, D).cells.where("cell_id < 60")
    scored = S.score_cells(small, compiled, None, B.SPECS)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    per = scored.groupBy("city").agg(F.count("*").alias("n"), F.count_distinct("request_id").alias("r")).collect()
    cells = {r.city: r["count"] for r in small.groupBy("city").count().collect()}
    assert {r.city: r.n for r in per} == {r.city: cells[r.city] * r.r for r in per} and sum(r.r for r in per) == n
