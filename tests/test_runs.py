"""Rank runs against plain Python, and the work they cost."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.operators import cells as C, registers as RG
from placewise.operators.runs import narrowed_medians, rank_runs
from placewise.plans import bindings as B

D = "/root/testdata/sf0.001"


def _rows(n=3000):
    """Group a holds most rows and one value holds a third of all; b has few rows, c one, d none that counts."""
    rng = random.Random(7)
    out = [("a", 5.0 if rng.random() < 0.4 else float(rng.randint(0, 60)), rng.random() < 0.7) for _ in range(n)]
    out += [("b", float(i % 3), i % 2 == 0) for i in range(11)] + [("c", 2.5, True), ("d", 1.0, False), ("a", None, True), (None, 3.0, True), (None, 4.0, True)]
    return [(g, v, h, i) for i, (g, v, h) in enumerate(out)]


@pytest.fixture(scope="module")
def runs(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(_rows(), "g string, v double, hab boolean, id int").repartition(7)
        before, _ = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.set("spark.sql.shuffle.partitions", "13")
        out = rank_runs(df.where("g IS NOT NULL"), ["g"], "v", F.col("hab"), ["id"])
        spark.conf.set("spark.sql.shuffle.partitions", before)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return out


def test_counts_equal_plain_python(runs):
    rows = [r for r in _rows() if r[0] is not None and r[1] is not None]
    assert runs.rows.select("__part").distinct().count() > 6                       # the hot group and value lie in several
    got = {r.id: (r.lt, r.le, r.total) for r in runs.ranked().collect()}
    for g, v, _, i in rows:
        of = [x[1] for x in rows if x[0] == g and x[2]]
        assert got[i] == (sum(x < v for x in of), sum(x <= v for x in of), len(of))
    assert len(got) == len(rows)


def test_quantiles_equal_numpy(runs):
    rows = [r for r in _rows() if r[0] is not None and r[1] is not None and r[2]]
    got = {r.g: r for r in runs.quantiles({"q1": 0.25, "m": 0.5, "q9": 0.9}).collect()}
    assert set(got) == {"a", "b", "c"}                                              # d has no row that counts
    for g, r in got.items():
        of = [x[1] for x in rows if x[0] == g]
        assert (r.q1, r.m, r.q9, r.n) == (*[pytest.approx(float(np.quantile(of, q))) for q in (0.25, 0.5, 0.9)], len(of))


def test_counts_around_a_bound(spark, runs):
    bound = spark.createDataFrame([("a", 5.0), ("b", 1.5)], "g string, x double")
    rows = [r for r in _rows() if r[0] is not None and r[1] is not None and r[2]]
    for r in runs.around(bound, "x").collect():
        x = {"a": 5.0, "b": 1.5}[r.g]
        of = [y[1] for y in rows if y[0] == r.g]
        assert (r["lt"], r["le"]) == (sum(y < x for y in of), sum(y <= x for y in of))


def test_no_rows(spark):
    none = rank_runs(spark.createDataFrame([], "g string, v double"), ["g"], "v")
    assert none.ranked().count() == none.medians().count() == 0


def _work(spark, fn):
    """Exchanges and file scans of the jobs that fn runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = store.executionsCount()
    fn().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    names = []
    runs_ = store.executionsList()
    for i in range(runs_.size()):
        e = runs_.apply(i)
        if e.executionId() >= seen:
            nodes = store.planGraph(e.executionId()).allNodes()
            names += [nodes.apply(j).name() for j in range(nodes.size())]
    return sum(n == "Exchange" for n in names), names


def test_prepare_reads_the_cells_once(spark):
    cells = spark.createDataFrame(B.cells(spark, D).toPandas())
    exchanges, names = _work(spark, lambda: C.prepare(cells, B.SPECS))
    assert exchanges < 15
    assert sum(n.startswith("Scan ExistingRDD") or n.startswith("LocalTableScan") for n in names) <= 2


def test_trim_computes_its_input_once(spark):
    df = spark.createDataFrame([(i, math.sin(i) * 100) for i in range(300)], "id long, x double")
    exchanges, names = _work(spark, lambda: RG.iqr_trim(df, "x", floor=-150.0))
    assert exchanges < 8
    assert sum(n.startswith("Scan ExistingRDD") or n.startswith("LocalTableScan") for n in names) <= 1


def test_narrowed_medians_equal_numpy_and_shuffle_few_rows(spark, tmp_path):
    """Even and odd groups, one value in most rows, two clumps with the middle between them, values within the last digits."""
    rng = random.Random(5)
    groups = {"even": [rng.gauss(50, 20) for _ in range(20_000)], "odd": [rng.random() for _ in range(9_999)], "hot": [3.0] * 5_000 + [float(i) for i in range(4_000)],
              "clumps": [i * 1e-9 for i in range(3_000)] + [100 + i * 1e-9 for i in range(3_000)], "digits": [1 + i * 2.3e-16 for i in range(3_000)] + [1e9], "one": [7.0], "two": [1.0, 4.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    spark.createDataFrame(rows, "g string, v double").repartition(4).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    before = set(_written_shuffles(spark))
    got = {r.g: r.median for r in narrowed_medians(df, ["g"], "v", bins=16, rows=50).collect()}
    assert got == {g: float(np.median(vs)) for g, vs in groups.items()}
    records = sum(n for s, n in _written_shuffles(spark).items() if s not in before)
    assert records < len(rows) / 2                       # sorting would shuffle every row


def _written_shuffles(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}
