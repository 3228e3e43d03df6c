import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from placewise.operators import graph as GR, overlay as OV, spatial as SP


def cloud(n, seed, span=5000.0):
    rnd = random.Random(seed)
    return [("c", i, rnd.random() * span, rnd.random() * span) for i in range(n)]


def test_radius_join_with_hot_bins_equals_brute_force(spark):
    pts, tgt = cloud(60, 1), cloud(200, 2, 900.0) + [("c", 1000 + i, 100.0, 100.0) for i in range(50)]
    p = spark.createDataFrame(pts, "city string, pid long, x double, y double")
    t = spark.createDataFrame(tgt, "city string, tid long, x double, y double")
    want = {a[1]: sum(math.dist(a[2:], b[2:]) <= 700.0 for b in tgt) for a in pts}
    for hot in (7, 50_000):
        got = {r.pid: r.n for r in SP.count_within(p, t, 700.0, ["pid"], ["city"], hot=hot).collect()}
        assert got == want


def test_nearest_reaches_far_targets(spark):
    pts, tgt = cloud(80, 3, 40_000.0), cloud(9, 4, 3000.0)
    p = spark.createDataFrame(pts, "city string, pid long, x double, y double")
    t = spark.createDataFrame(tgt, "city string, tid long, x double, y double")
    got = {r.pid: (r.tid, round(r.dist, 6)) for r in SP.nearest(p, t, ["pid"], "tid", ["city"], full=2, hot=3).collect()}
    for a in pts:
        d, tid = min((math.dist(a[2:], b[2:]), b[1]) for b in tgt)
        assert got[a[1]] == (tid, round(d, 6))


def grid_edges(n):
    rnd = random.Random(5)
    out = []
    for i in range(n):
        for j in range(n):
            for di, dj in ((1, 0), (0, 1)):
                if i + di < n and j + dj < n and rnd.random() < 0.85:
                    out.append((i * n + j, (i + di) * n + j + dj, 50.0 + rnd.random() * 100))
    return out


def test_bounded_paths_equal_dijkstra(spark):
    n, limit = 12, 900.0
    e = grid_edges(n)
    both = [("c", u, v, w) for u, v, w in e] + [("c", v, u, w) for u, v, w in e]
    nodes = spark.createDataFrame([("c", i * n + j, i * 100.0, j * 100.0) for i in range(n) for j in range(n)], "city string, node long, x double, y double")
    edges = spark.createDataFrame(both, "city string, u long, v long, len double")
    src = {"a": {0: 1.0, 77: 5.0}, "b": {140: 0.0}}
    s = spark.createDataFrame([("c", c, k, d) for c, m in src.items() for k, d in m.items()], "city string, cat string, node long, dist double")
    got = {(r.cat, r.node): r.dist for r in GR.distances(nodes, edges, s, ["city"], limit, tile_size=300.0, max_nodes=8).collect()}
    adj = {}
    for _, u, v, w in both:
        adj.setdefault(u, []).append((v, w))
    want = {}
    for c, m in src.items():
        heap, seen = [(d, k) for k, d in m.items()], {}
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if u in seen or d > limit:
                continue
            seen[u] = d
            for v, w in adj.get(u, ()):
                heapq.heappush(heap, (d + w, v))
        want.update({(c, k): d for k, d in seen.items()})
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_nearest_with_a_limit(spark):
    """A target 51 m away is found with a limit of 100 m."""
    p = spark.createDataFrame([("c", 1, 10.0, 10.0)], "city string, pid long, x double, y double")
    t = spark.createDataFrame([("c", 5, 61.0, 10.0), ("c", 6, 490.0, 490.0)], "city string, tid long, x double, y double")
    got = SP.nearest(p, t, ["pid"], "tid", ["city"], max_dist=100.0).collect()
    assert [(r.pid, r.tid, round(r.dist, 6)) for r in got] == [(1, 5, 51.0)]


def _ring(key, points):
    return [("c", key, *p, *q) for p, q in zip(points, points[1:] + points[:1])]


def _square(key, x, y, side, turn=1):
    return _ring(key, [(x, y), (x + side, y), (x + side, y + side), (x, y + side)][::turn])


COLS = "city string, {} long, x1 double, y1 double, x2 double, y2 double"


def test_apportion_is_exact(spark):
    """Small polygons and parts of polygons count by their area; the total is preserved where the districts cover everything."""
    src = spark.createDataFrame(_square(1, 0.0, 0.0, 400.0) + _square(2, 610.0, 610.0, 50.0) + _square(3, 400.0, 100.0, 250.0), COLS.format("src"))
    dis = spark.createDataFrame(_square(7, -500.0, -500.0, 1000.0) + _square(8, 500.0, -500.0, 1000.0, -1) + _square(9, -500.0, 500.0, 1000.0) + _square(10, 500.0, 500.0, 1000.0),
                                COLS.format("district"))
    val = spark.createDataFrame([("c", 1, 100.0), ("c", 2, 500.0), ("c", 3, 50.0)], "city string, src long, value double")
    got = {r.district: r.value for r in OV.apportion(src, val, dis, "src", "district", "value", 300.0, ["city"]).collect()}
    assert got == pytest.approx({7: 120.0, 8: 30.0, 10: 500.0}, abs=1e-6)


def test_shared_areas_by_formula(spark):
    """Two triangles that cross, a ring with a hole, a polygon far from the origin, and shapes that only touch."""
    far = 6.0e6
    a = _ring(1, [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]) + _square(2, 100.0, 100.0, 50.0) + _square(2, 110.0, 110.0, 20.0, -1) + _square(3, far, far, 3.0)
    b = _ring(5, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]) + _square(6, 100.0, 100.0, 30.0) + _square(7, far + 1.0, far + 1.0, 5.0, -1) + _square(8, 150.0, 100.0, 50.0)
    got = OV.shared_area(spark.createDataFrame(a, COLS.format("p")), spark.createDataFrame(b, COLS.format("q")), ["p"], ["q"], 7.0, ["city"]).collect()
    assert {(r.p, r.q): r.area for r in got} == pytest.approx({(1, 5): 25.0, (2, 6): 900.0 - 400.0, (3, 7): 4.0}, abs=1e-6)


def test_overlay_of_a_polygon_with_very_many_edges(spark):
    """A circle of 20,000 edges over a grid of squares: areas sum up to the circle's, each square gets its part."""
    n, r = 20_000, 1000.0
    circle = spark.range(n).select(F.lit("c").alias("city"), F.lit(1).cast("long").alias("p"), *[(f(F.col("id").cast("double") * (2 * math.pi / n) + (2 * math.pi / n) * k) * r).alias(c)
                                                                                                for k in (0, 1) for f, c in ((F.cos, f"x{k + 1}"), (F.sin, f"y{k + 1}"))])
    grid = spark.createDataFrame([e for i in range(-2, 2) for j in range(-2, 2) for e in _square(10 * i + j, i * 500.0, j * 500.0, 500.0)], COLS.format("q"))
    got = {x.q: x.area for x in OV.shared_area(circle, grid, ["p"], ["q"], 100.0, ["city"]).collect()}
    assert sum(got.values()) == pytest.approx(n / 2 * math.sin(2 * math.pi / n) * r * r, rel=1e-9)
    assert got[0] == pytest.approx(500.0 ** 2) and got[11] == pytest.approx(got[-19], abs=1e-3)


def test_majority_label_prefers_the_larger_part(spark):
    """A hexagon cut in two at 60 : 40 by its width, and one that nothing covers."""
    cells = spark.createDataFrame([("c", 1, 0.0, 0.0), ("c", 2, 5000.0, 0.0)], "city string, cell_id long, x double, y double")
    halves = spark.createDataFrame(_ring(4, [(-200.0, -200.0), (10.0, -200.0), (10.0, 200.0), (-200.0, 200.0)]) + _ring(3, [(10.0, -200.0), (200.0, -200.0), (200.0, 200.0), (10.0, 200.0)]), COLS.format("d"))
    centres = spark.createDataFrame([("c", 3, 100.0, 0.0), ("c", 4, -100.0, 0.0)], "city string, d long, x double, y double")
    got = {r.cell_id: r for r in OV.majority_label(cells, halves, ["city", "cell_id"], "d", 500.0, 100.0, centres, ["city"]).collect()}
    whole = 1.5 * 3 ** 0.5 * 100.0 ** 2
    assert (got[1].d, got[1].how) == (4, "area") and got[1].share == pytest.approx(0.5 + (10.0 * 200.0 - 10.0 ** 2 / 3 ** 0.5) / whole)
    assert (got[2].d, got[2].how, got[2].share) == (3, "nearest", None)


def star(n, seed, cx, cy, snap=None):
    """A ring of n points around a centre with changing radius; on a lattice where ``snap`` is given."""
    rnd = random.Random(seed)
    ring = [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n) for r in [rnd.uniform(500, 2500)]]
    return [(round(x / snap) * snap, round(y / snap) * snap) for x, y in ring] if snap else ring


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_polygons_of_all_shapes_equal_brute_force(spark):
    # rings on and off the bins' corners, one with holes by overlap, a box aligned with bins; points on corners and sides too
    rings = {1: star(40, 1, 0, 0), 2: star(30, 2, 900, 300, 250.0), 3: star(60, 3, -700, 100, 500.0), 4: [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1500.0), (0.0, 1500.0)],
             5: star(2000, 4, 200, -300)}
    rows = [("c", k, i, *p, *q) for k, r in rings.items() for i, (p, q) in enumerate(zip(r, r[1:] + r[:1]))]
    e = spark.createDataFrame(rows, "city string, poly long, i int, x1 double, y1 double, x2 double, y2 double")
    rnd = random.Random(9)
    pts = [(rnd.uniform(-3000, 3000), rnd.uniform(-3000, 3000)) for _ in range(500)] + [(x * 250.0, y * 250.0) for x in range(-8, 9) for y in range(-8, 9)]
    p = spark.createDataFrame([("c", i, x, y) for i, (x, y) in enumerate(pts)], "city string, pid long, x double, y double")
    want = {(i, k) for i, (x, y) in enumerate(pts) for k, r in rings.items() if inside(x, y, r)}
    for hot in (5, 50_000):
        got = {(r.pid, r.poly) for r in SP.containing(p, e, ["pid"], ["poly"], 500.0, ["city"], hot=hot).collect()}
        assert got == want


def test_polygon_with_100_000_edges_and_a_third_of_all_points(spark):
    import numpy as np
    n, m = 100_000, 3_000
    a = np.arange(n) * (2 * np.pi / n)
    r = 8000 + 1500 * np.sin(a * 9) + np.random.default_rng(1).uniform(-40, 40, n)
    x, y = r * np.cos(a), r * np.sin(a)
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    import pandas as pd
    e = spark.createDataFrame(pd.DataFrame({"poly": 1, "x1": x, "y1": y, "x2": x2, "y2": y2}))
    g = np.random.default_rng(2)
    t = g.uniform(0, 2 * np.pi, m // 3)
    ring = np.c_[(8000 + 1500 * np.sin(t * 9)) * np.cos(t), (8000 + 1500 * np.sin(t * 9)) * np.sin(t)] + g.uniform(-60, 60, (m // 3, 2))     # at the border
    pts = np.r_[ring, g.uniform(-10_000, 10_000, (m - m // 3, 2))]
    p = spark.createDataFrame(pd.DataFrame({"pid": np.arange(m), "x": pts[:, 0], "y": pts[:, 1]}))
    want = {i for i, (u, v) in enumerate(pts) if ((((y > v) != (y2 > v)) & (u < (x2 - x) * (v - y) / np.where(y2 == y, 1, y2 - y) + x)).sum() % 2)}
    got = {r.pid for r in SP.containing(p, e, ["pid"], ["poly"], 500.0).collect()}
    assert got == want
    parts = SP._bin_edges(SP._row_edges(e, ["poly"], 500.0, SP._levels(e, ["poly"], 500.0))).groupBy("__bx", "__by").agg(F.count("*").alias("n"))
    assert parts.agg(F.max("n")).first()[0] < 100 * SP.BIN_EDGES      # no point meets more than a sliver of the ring


def test_nearest_where_a_third_of_the_targets_crowd_one_spot(spark):
    rnd = random.Random(12)
    crowd = [("c", i, 5000.0 + rnd.random() * 20, 5000.0 + rnd.random() * 20) for i in range(1000)]
    wide = [("c", 1000 + i, rnd.random() * 40_000, rnd.random() * 40_000) for i in range(1600)] + [("c", 3000 + i, 100.0, 100.0) for i in range(200)]   # one place, many targets
    pts = cloud(100, 6, 40_000.0) + [("c", 200 + i, 5000.0 + rnd.random() * 20, 5000.0 + rnd.random() * 20) for i in range(100)] + [("c", 400, -90_000.0, 5.0), ("d", 401, 1.0, 1.0), ("c", 402, None, 1.0)]
    p = spark.createDataFrame(pts, "city string, pid long, x double, y double")
    t = spark.createDataFrame(crowd + wide, "city string, tid long, x double, y double")
    want = {}
    for a in pts:
        if a[0] == "c" and a[2] is not None:
            d, tid = min((round(math.dist(a[2:], b[2:]), 6), b[1]) for b in crowd + wide)
            want[a[1]] = (tid, d)
    for hot in (20, 50_000):
        got = {r.pid: (r.tid, round(r.dist, 6)) for r in SP.nearest(p, t, ["pid"], "tid", ["city"], full=16, hot=hot).collect()}
        assert got == want
    nodes, placed = SP.target_tree(t.select("city", "tid", "x", "y"), ["city"], (0.0, 0.0, 40_000.0), 16, 20)
    assert placed.count() == len(crowd + wide)                              # every target has one leaf
    assert nodes.where("__leaf AND __tier < 7").agg(F.max("__n")).first()[0] <= 16
    assert SP.nearest(p, t.where("tid < 0"), ["pid"], "tid", ["city"]).count() == 0


def test_points_of_long_lines_are_not_broadcast(spark):
    """Few lines become very many targets, which the planner takes for as small as the lines."""
    lines = spark.range(40).selectExpr("id", "0 AS i", "0D AS x1", "id * 100D AS y1", "100000D AS x2", "id * 100D AS y2")
    targets = SP.densify(lines, ["id"], 100.0).select("x", "y")
    points = spark.range(300).selectExpr("id AS p", "id * 300D + 10 AS x", "(id % 50) * 100D AS y")
    joined = SP.radius_join(points, targets, 60.0)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("Generate")]
    assert "SortMergeJoin" in final
    assert joined.count() == sum(1 for p in range(300) if p % 50 < 40)
