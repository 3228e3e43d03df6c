"""Distance joins, nearest neighbours, polygons and rings, all as equi-joins on bins.

No theta join ever reaches Spark as a cartesian product: both sides are keyed by a square bin, one side is expanded
to the neighbouring bins, and the distance is a residual condition.  Bins that hold more than ``HOT`` targets are cut
into shards: targets are spread by hash and the other side is repeated once per shard, so a bin with a third of all
rows is worked on by many tasks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geo import ring_offsets
from ..session import broadcast_if_small, is_small, spread, written

HOT = 50_000     # targets per shard
FULL = 64        # targets of a leaf of the tree that finds nearest targets
TIERS = 7        # tiers of that tree below its root; each cuts a side in eight
BIN_EDGES = 64   # edges of one polygon that a bin should meet
MAX_LEVEL = 10   # halvings of a bin


def with_bin(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return (df.withColumn("__bx", F.floor(F.col(x) / F.lit(float(size))))
            .withColumn("__by", F.floor(F.col(y) / F.lit(float(size)))))


def neighbour_bins(df: DataFrame) -> DataFrame:
    return df.selectExpr("* EXCEPT (__bx, __by)", "explode(array(-1, 0, 1)) AS __dx", "__bx", "__by") \
        .selectExpr("* EXCEPT (__bx, __by, __dx)", "__bx + __dx AS __bx", "explode(array(__by - 1, __by, __by + 1)) AS __by")


def shard(points: DataFrame, targets: DataFrame, keys: Sequence[str], spread: Sequence[str], hot: int = HOT
          ) -> tuple[DataFrame, DataFrame]:
    """Adds ``__shard`` to both sides: hashed on targets, repeated on points, for the keys over the hot limit."""
    counts = targets.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot)
    counts = counts.select(*keys, F.ceil(F.col("__n") / hot).cast("int").alias("__shards"))
    n = F.coalesce("__shards", F.lit(1))
    t = targets.join(counts, list(keys), "left").withColumn("__shard", F.pmod(F.xxhash64(*spread), n).cast("int")).drop("__shards")
    p = points.join(counts, list(keys), "left").withColumn("__shard", F.explode(F.sequence(F.lit(0), n - 1))).drop("__shards")
    return p, t


def radius_join(points: DataFrame, targets: DataFrame, radius: float, keys: Sequence[str] = (), how: str = "inner",
                hot: int = HOT) -> DataFrame:
    """Point columns + target columns (prefixed ``t_``) for every target within the radius; ``dist2`` is the squared
    distance.  With ``how='left'`` a point without targets keeps rows whose target columns are NULL."""
    keys = list(keys)
    t = targets.select(*keys, *[F.col(c).alias(f"t_{c}") for c in targets.columns if c not in keys])
    t = with_bin(t, radius, "t_x", "t_y")
    p = neighbour_bins(with_bin(points, radius))
    on = [*keys, "__bx", "__by"]
    p, t = shard(p, t, on, [c for c in t.columns if c not in on], hot)
    on = on + ["__shard"]
    # the planner does not see how targets have multiplied, and would broadcast all points of a few long lines
    t = F.broadcast(t) if is_small(targets) else t.hint("merge")
    d2 = (F.col("x") - F.col("t_x")) * (F.col("x") - F.col("t_x")) + (F.col("y") - F.col("t_y")) * (F.col("y") - F.col("t_y"))
    a, b = p.alias("a"), t.alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on] + [d2 <= F.lit(float(radius) ** 2)]
    joined = a.join(b, cond, how)
    return joined.select(*[F.col(f"a.{c}") for c in points.columns], *[F.col(f"b.{c}") for c in t.columns if c.startswith("t_")],
                         d2.alias("dist2"))


def within_radius(points: DataFrame, targets: DataFrame, radius: float, ids: Sequence[str], aggs: Sequence[Column],
                  keys: Sequence[str] = (), hot: int = HOT) -> DataFrame:
    """Aggregates over the targets (columns ``t_...``) within the radius of each point; a point without targets keeps
    one row, so counts and sums of coalesced values are 0 for it."""
    return radius_join(points, targets, radius, keys, "left", hot).groupBy(*ids).agg(*aggs)


def count_within(points: DataFrame, targets: DataFrame, radius: float, ids: Sequence[str], keys: Sequence[str] = (),
                 out: str = "n", hot: int = HOT) -> DataFrame:
    """Number of targets within the radius; targets at the same place are folded before the join."""
    folded = targets.groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))
    return within_radius(points, folded, radius, ids, [F.coalesce(F.sum("t_n"), F.lit(0)).alias(out)], keys, hot)


def sum_within(points: DataFrame, targets: DataFrame, value: str, radius: float, ids: Sequence[str],
               keys: Sequence[str] = (), out: str = "total") -> DataFrame:
    folded = targets.groupBy(*keys, "x", "y").agg(F.sum(value).alias("v"))
    return within_radius(points, folded, radius, ids, [F.coalesce(F.sum("t_v"), F.lit(0.0)).alias(out)], keys)


def target_tree(targets: DataFrame, keys: Sequence[str], square: tuple[float, float, float], full: int = FULL, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(nodes, targets with their leaf) of a tree over positions: a node with more than ``full`` targets has up to 64 children.

    Nodes are (keys, tier, bx, by) with their number of targets and the box around them. All tiers are counted in one
    aggregate; a node is kept where its parent is over the bound, so there is one path to every target."""
    x0, y0, span = square
    most = 1 << 3 * TIERS
    fine = lambda c, o: F.least(F.floor((F.col(c) - F.lit(o)) / F.lit(span) * F.lit(most)), F.lit(most - 1)).cast("long")
    node = [*keys, "__tier", "__bx", "__by"]
    at = (targets.withColumn("__fx", fine("x", x0)).withColumn("__fy", fine("y", y0)).withColumn("__tier", F.explode(F.sequence(F.lit(0), F.lit(TIERS))))
          .withColumn("__bx", F.expr(f"shiftright(__fx, 3 * ({TIERS} - __tier))")).withColumn("__by", F.expr(f"shiftright(__fy, 3 * ({TIERS} - __tier))")).drop("__fx", "__fy"))
    every = at.groupBy(*node).agg(F.count("*").alias("__n"), F.min("x").alias("__x0"), F.max("x").alias("__x1"), F.min("y").alias("__y0"), F.max("y").alias("__y1"))
    every = every.withColumn("__leaf", (F.col("__n") <= full) | (F.col("__tier") == TIERS)).withColumn("__px", F.shiftright("__bx", 3)).withColumn("__py", F.shiftright("__by", 3))
    split = every.where("NOT __leaf").select(*keys, (F.col("__tier") + 1).alias("__tier"), F.col("__bx").alias("__px"), F.col("__by").alias("__py"))
    nodes = written(every.where("__tier = 0").unionByName(every.join(split, [*keys, "__tier", "__px", "__py"], "left_semi")), "target-tree")
    # nodes that no task should gather are no leaves: their rows are left out before the join
    crowded = broadcast_if_small(nodes.where((F.col("__n") > hot) & ~F.col("__leaf")).select(*node), 200_000)
    return nodes, at.join(crowded, node, "left_anti").join(nodes.where("__leaf").select(*node), node)


def nearest(points: DataFrame, targets: DataFrame, ids: Sequence[str], target_id: str,
            keys: Sequence[str] = (), max_dist: float | None = None, full: int = FULL, hot: int = HOT) -> DataFrame:
    """Nearest target of each point (ties within a micrometre: smallest id) with its distance; exact at any distance.

    Points go down the tree of targets tier by tier: the farthest corner of the best box bounds the distance from above, and nodes
    whose box lies beyond that bound are left. The tree's tiers are small and broadcast behind a check of their size, so points
    are shuffled once. At the end a point meets the targets of its last leaves, at most ``full`` each; leaves that more than
    ``hot`` points reach are worked on in shards. Rows without a position take no part."""
    keys, ids = [*keys, "__all"], list(ids)
    targets, points = (df.where("x IS NOT NULL AND y IS NOT NULL").withColumn("__all", F.lit(0)) for df in (targets, points))
    tcols = [c for c in targets.columns if c not in (*keys, "x", "y", target_id)]
    folded = targets.groupBy(*keys, "x", "y").agg(F.min(F.struct(target_id, *tcols)).alias("__t")) \
                    .select(*keys, "x", "y", "__t.*")
    ext = folded.agg(F.min("x"), F.min("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()
    nodes, placed = target_tree(folded, keys, (float(ext[0] or 0), float(ext[1] or 0), float(ext[2] or 0) or 1.0), full, hot)
    tiers = {r[0]: r[1] for r in nodes.groupBy("__tier").count().collect()}          # at most TIERS + 1 rows
    px, py, zero = F.col("x"), F.col("y"), F.lit(0.0)
    near = F.hypot(F.greatest(F.col("__x0") - px, px - F.col("__x1"), zero), F.greatest(F.col("__y0") - py, py - F.col("__y1"), zero))
    far = F.hypot(F.greatest(F.abs(px - F.col("__x0")), F.abs(px - F.col("__x1"))), F.greatest(F.abs(py - F.col("__y0")), F.abs(py - F.col("__y1"))))
    at = ["__tier", "__bx", "__by"]
    own = list(dict.fromkeys([*ids, *keys, "x", "y"]))
    c = spread(points.select(*own), *ids)            # before the rows multiply, and as the windows below need them
    for tier in range(max(tiers, default=0) + 1):
        n = nodes.where(F.col("__tier") == tier)
        n = F.broadcast(n) if tiers.get(tier, 0) <= 200_000 else n
        if tier == 0:
            c = c.join(n, keys).select(*own, *at, near.alias("__near"), far.alias("__far"))
        else:
            # a candidate of the tier above becomes its children; leaves found before have none and stay
            kids = n.select(*keys, (F.col("__tier") - 1).alias("__tier"), F.col("__px").alias("__bx"), F.col("__py").alias("__by"), F.struct("__tier", "__bx", "__by").alias("__kid"),
                            "__x0", "__x1", "__y0", "__y1")
            c = c.join(kids, [*keys, *at], "left").select(*own, *[F.coalesce(F.col("__kid")[x], F.col(x)).alias(x) for x in at],
                                                          F.coalesce(F.when(F.col("__kid").isNotNull(), near), "__near").alias("__near"), F.coalesce(F.when(F.col("__kid").isNotNull(), far), "__far").alias("__far"))
            c = c.withColumn("__up", F.min("__far").over(W.partitionBy(*ids))).where(F.col("__near") <= F.col("__up") + 1e-6).drop("__up")
        if max_dist is not None:
            c = c.where(F.col("__near") <= max_dist + 1e-6)
    c = written(c.select(*own, *at), "near-leaves")
    t = placed.withColumnsRenamed({"x": "t_x", "y": "t_y"})
    on = [*keys, *at]
    t, c = shard(t, c, on, ids, hot)
    d = F.sqrt((px - F.col("t_x")) * (px - F.col("t_x")) + (py - F.col("t_y")) * (py - F.col("t_y")))
    best = (c.join(t, [*on, "__shard"]).withColumn("dist", d)
            .groupBy(*ids).agg(F.min(F.struct(F.round("dist", 6).alias("__d"), target_id, *tcols, "dist", "t_x", "t_y")).alias("__b"))
            .select(*ids, "__b.*").drop("__d"))
    return best if max_dist is None else best.where(F.col("dist") <= max_dist)


# ------------------------------------------------------------------ hexagon rings
def ring_pairs(cells: DataFrame, k: int, keys: Sequence[str] = ("city",), min_ring: int = 0) -> DataFrame:
    """(cell, neighbour key nq/nr, ring) for the 1 + 3k(k + 1) offsets; join it with any table keyed by (q, r)."""
    off = ", ".join(f"struct({dq} AS dq, {dr} AS dr, {ring} AS ring)" for dq, dr, ring in ring_offsets(k) if ring >= min_ring)
    return (spread(cells).selectExpr("*", f"inline(array({off}))")
            .selectExpr("* EXCEPT (dq, dr)", "q + dq AS nq", "r + dr AS nr"))


def ring_join(cells: DataFrame, other: DataFrame, k: int, keys: Sequence[str] = ("city",), min_ring: int = 0) -> DataFrame:
    """Cells with the rows of ``other`` (has q, r) within k rings."""
    o = other.withColumnsRenamed({"q": "nq", "r": "nr"})
    return ring_pairs(cells, k, keys, min_ring).join(o, [*keys, "nq", "nr"])


# ------------------------------------------------------------------ polygons
def edges(polygons: DataFrame, keys: Sequence[str], ring: str = "ring") -> DataFrame:
    """Edge table of closed rings: ``ring`` is an array of structs (x, y)."""
    nxt = f"{ring}[(i + 1) % size({ring})]"
    return polygons.selectExpr(*keys, f"posexplode({ring}) AS (i, p)", ring) \
        .selectExpr(*keys, "i", "p.x AS x1", "p.y AS y1", f"{nxt}.x AS x2", f"{nxt}.y AS y2")


def bounds(edge_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edge_table.groupBy(*keys).agg(F.min("x1").alias("x0"), F.max("x1").alias("xmax"), F.min("y1").alias("y0"),
                                         F.max("y1").alias("ymax"))


def area(edge_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shoelace area per polygon."""
    return edge_table.groupBy(*keys).agg(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))


def _levels(edge_table: DataFrame, cols: Sequence[str], size: float) -> DataFrame:
    """(polygon, level) of the polygons that need finer bins: halved ``level`` times until a bin meets about ``BIN_EDGES`` edges,
    as long as the polygon's box has no more bins than four times its edges."""
    st = edge_table.groupBy(*cols).agg(F.count("*").alias("n"), F.sum(edge_length()).alias("len"),
                                       ((F.max("x1") - F.min("x1")) * (F.max("y1") - F.min("y1"))).alias("box"))
    s = F.greatest(F.lit(BIN_EDGES) * F.col("len") / F.col("n"), F.sqrt(F.col("box") / (F.col("n") * 4)))
    level = F.least(F.floor(F.log2(F.lit(float(size)) / s)), F.lit(MAX_LEVEL)).cast("int")
    return st.where(s > 0).select(*cols, level.alias("__lv")).where("__lv > 0")


def _row_edges(edge_table: DataFrame, cols: Sequence[str], size: float, levels: DataFrame | None) -> DataFrame:
    """Every edge once per row of bins that it meets; ``__s`` is the bin size of its polygon (``levels``: those that differ)."""
    e = edge_table.select(*cols, "x1", "y1", "x2", "y2")
    e = e.withColumn("__lv", F.lit(0)) if levels is None else e.join(broadcast_if_small(levels), list(cols), "left").withColumn("__lv", F.coalesce("__lv", F.lit(0)))
    e = e.withColumn("__s", F.lit(float(size)) / F.pow(F.lit(2.0), "__lv"))
    return e.withColumn("__by", F.explode(F.sequence(F.floor(F.least("y1", "y2") / F.col("__s")), F.floor(F.greatest("y1", "y2") / F.col("__s")))))


def _x_at(y: Column) -> Column:
    """Where an edge crosses the height y, kept between its ends."""
    x = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return F.least(F.greatest(x, F.least("x1", "x2")), F.greatest("x1", "x2"))


def _last_bin(y: Column) -> Column:
    """The last bin of the row whose left side lies left of the edge's crossing at height y."""
    return F.ceil(_x_at(y) / F.col("__s")) - 1


def _spans(y: Column) -> Column:
    return (F.col("y1") > y) != (F.col("y2") > y)


def _bin_edges(rows: DataFrame) -> DataFrame:
    """Row edges once per bin that they pass."""
    s, flat = F.col("__s"), F.col("y1") == F.col("y2")
    y0, y1 = F.col("__by") * s, (F.col("__by") + 1) * s
    end = lambda y: F.when(flat, F.col("x1")).otherwise(_x_at(F.least(F.greatest(y, F.least("y1", "y2")), F.greatest("y1", "y2"))))
    other = lambda y: F.when(flat, F.col("x2")).otherwise(end(y))
    a, b = F.least(end(y0), other(y1)), F.greatest(end(y0), other(y1))
    # a bin too many changes nothing: an edge outside a bin contributes an even count
    return rows.withColumn("__bx", F.explode(F.sequence(F.floor(a / s - 1e-9), F.floor(b / s + 1e-9))))


def _odd_corners(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bins whose lower left corner lies inside, as (polygon, level, row, bin): crossings of the row's lower side, counted per bin,
    alternate between entering and leaving; the runs between them are expanded."""
    line = F.col("__by") * F.col("__s")
    row = [*cols, "__lv", "__by"]
    cross = (rows.where(_spans(line)).withColumn("__b", _last_bin(line)).groupBy(*row, "__b").agg(F.count("*").alias("__n")).where("__n % 2 = 1"))
    w = W.partitionBy(*row).orderBy("__b")
    runs = cross.select(*row, "__b", F.lag("__b").over(w).alias("__a"), F.row_number().over(w).alias("__i")).where("__i % 2 = 0")
    return runs.select(*row, F.explode(F.sequence(F.col("__a") + 1, F.col("__b"))).alias("__bx"))


def containing(points: DataFrame, edge_table: DataFrame, ids: Sequence[str], poly: Sequence[str], size: float,
               keys: Sequence[str] = (), hot: int = HOT) -> DataFrame:
    """(point, polygon) pairs where the point lies inside, by crossing parity.

    A point meets the edges of its own bin only. Whether a bin's lower left corner lies inside is known per (polygon, bin); the
    edges of the bin say how often that changes between corner and point: an edge counts where it is crossed right of the
    point, right of the corner, and once for each end above the corner and right of it, up to the point's height. Edges that do
    not pass the bin add up to even numbers and are left out. Bins without edges answer by their corner alone. Polygons with
    many edges get finer bins; bins with more than ``hot`` points are cut into shards."""
    keys, ids, poly = list(keys), list(ids), list(poly)
    cols = [*keys, *poly]
    fine = _levels(edge_table, cols, size)
    used = [r[0] for r in fine.select("__lv").distinct().collect()]     # at most MAX_LEVEL numbers
    rows = _row_edges(edge_table, cols, size, fine if used else None)
    spot = ["__lv", "__bx", "__by"]
    parts = (_bin_edges(rows).select(*cols, *spot, "__s", "x1", "y1", "x2", "y2")
             .unionByName(_odd_corners(rows, cols).select(*cols, *spot), allowMissingColumns=True))
    p = points.select(*dict.fromkeys([*ids, *keys, "x", "y"])).withColumns({"__x": F.col("x"), "__y": F.col("y")}).drop(*[c for c in ("x", "y") if c not in [*ids, *keys]])
    p = p.withColumn("__lv", F.explode(F.array(*[F.lit(v) for v in [0, *used]])))
    at = F.lit(float(size)) / F.pow(F.lit(2.0), "__lv")
    p = p.withColumn("__bx", F.floor(F.col("__x") / at)).withColumn("__by", F.floor(F.col("__y") / at))
    on = [*keys, *spot]
    parts, p = shard(parts, p, on, ids, hot)
    px, py, line = F.col("__x"), F.col("__y"), F.col("__by") * F.col("__s")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    corner = lambda e: (((F.col(f"y{e}") > py) != (F.col(f"y{e}") > line)) & (F.ceil(F.col(f"x{e}") / F.col("__s")) - 1 >= F.col("__bx")))
    turns = one(_spans(py) & (_x_at(py) > px)) + one(_spans(line) & (_last_bin(line) >= F.col("__bx"))) + one(corner(1)) + one(corner(2))
    term = F.when(F.col("x1").isNull(), 1).otherwise(turns)
    met = p.join(parts, [*on, "__shard"]).select(*dict.fromkeys([*ids, *cols]), term.alias("__c"))
    return met.groupBy(*dict.fromkeys([*ids, *cols])).agg(F.sum("__c").alias("__c")).where("__c % 2 = 1").drop("__c")


def point_in_polygon(points: DataFrame, edge_table: DataFrame, ids: Sequence[str], poly: str, size: float,
                     keys: Sequence[str] = ()) -> DataFrame:
    """Smallest id of the polygons that hold the point."""
    return containing(points, edge_table, ids, [poly], size, keys).groupBy(*ids).agg(F.min(poly).alias(poly))


def edge_length() -> Column:
    return F.expr("sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))")


def densify(edge_table: DataFrame, keys: Sequence[str], step: float) -> DataFrame:
    """Points along each edge at most ``step`` apart, start included, end excluded (rings close themselves)."""
    ln = edge_length()
    n = F.greatest(F.ceil(ln / F.lit(float(step))).cast("int"), F.lit(1))
    return (spread(edge_table).withColumn("__n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
            .select(*keys, "i", "k", (F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("k") / F.col("__n")).alias("x"),
                    (F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("k") / F.col("__n")).alias("y")))


def segments(lines: DataFrame, keys: Sequence[str], max_len: float = 50.0) -> DataFrame:
    """Pieces of at most ``max_len`` of consecutive vertex pairs (x1, y1, x2, y2): midpoint and length."""
    ln = edge_length()
    n = F.greatest(F.ceil(ln / F.lit(float(max_len))).cast("int"), F.lit(1))
    mid = (F.col("k") + 0.5) / F.col("__n")
    return (spread(lines).withColumn("__n", n).withColumn("length", ln / F.col("__n"))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
            .select(*keys, "k", (F.col("x1") + (F.col("x2") - F.col("x1")) * mid).alias("x"),
                    (F.col("y1") + (F.col("y2") - F.col("y1")) * mid).alias("y"), "length"))


def path_edges(lines: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """Consecutive vertex pairs of each line (array of structs x, y); no shuffle."""
    return (lines.where(F.size(path) > 1).selectExpr(*keys, f"posexplode(slice({path}, 1, size({path}) - 1)) AS (i, p)", path)
            .selectExpr(*keys, "i", "p.x AS x1", "p.y AS y1", f"{path}[i + 1].x AS x2", f"{path}[i + 1].y AS y2"))


def inverse_distance(cells: DataFrame, stations: DataFrame, ids: Sequence[str], key: str, reach: float = 25_000.0,
                     floor: float = 200.0) -> DataFrame:
    """Inverse-square-distance mean of the stations within reach of the centre of the cells (distances floored at
    200 m); NULL with fewer than two stations.

    The stations near one centre are few and Spark broadcasts them by size, so cells stream past them and are
    summed up map-side; the join key is the region, never a cross join."""
    centre = cells.groupBy(key).agg(F.avg("x").alias("__cx"), F.avg("y").alias("__cy"))
    near = (stations.join(centre, key).where(F.hypot(F.col("x") - F.col("__cx"), F.col("y") - F.col("__cy")) < reach)
            .select(key, F.col("x").alias("__sx"), F.col("y").alias("__sy"), F.col("value").alias("__v")))
    d2 = F.greatest((F.col("x") - F.col("__sx")) * (F.col("x") - F.col("__sx"))
                    + (F.col("y") - F.col("__sy")) * (F.col("y") - F.col("__sy")), F.lit(floor * floor))
    return (cells.join(near, key, "left").groupBy(*ids)
            .agg(F.when(F.count("__v") >= 2, F.sum(F.col("__v") / d2) / F.sum(F.lit(1.0) / d2)).alias("value")))


def expanding_ring_median(cells: DataFrame, observations: DataFrame, value: str, ids: Sequence[str], key: str = "city",
                          rings: int = 3, enough: int = 5) -> DataFrame:
    """Median over the smallest ring neighbourhood (k = 0..rings) with enough observations, and their number; NULL
    (with the number of the widest one) if none has.

    Ring sizes come from counts per cell, so observations are only repeated for the rings a cell really uses."""
    from .ranking import medians
    ids = list(ids)
    n = observations.groupBy(key, "q", "r").agg(F.count("*").alias("__n"))
    per_ring = ring_join(cells.select(*ids, *[c for c in (key, "q", "r") if c not in ids]), n, rings, [key]) \
        .groupBy(*ids, *[c for c in (key, "q", "r") if c not in ids]) \
        .agg(*[F.sum(F.when(F.col("ring") <= k, F.col("__n")).otherwise(0)).alias(f"n{k}") for k in range(rings + 1)])
    k = F.coalesce(*[F.when(F.col(f"n{k}") >= enough, k) for k in range(rings + 1)], F.lit(rings))
    used = per_ring.withColumn("__k", k)
    chosen = used.withColumn("n", F.array(*[f"n{i}" for i in range(rings + 1)])[F.col("__k")])
    rows = ring_join(chosen.where(F.col("n") >= enough), observations.select(key, "q", "r", value), rings, [key]) \
        .where(F.col("ring") <= F.col("__k"))
    med = medians(rows, ids, value, "median")
    return (cells.select(*ids).join(chosen.select(*ids, "n"), ids, "left").join(med, ids, "left")
            .select(*ids, F.coalesce("n", F.lit(0)).alias("n"), "median"))


def pixels_inside(edge_table: DataFrame, poly: Sequence[str], res: float, keys: Sequence[str] = ()) -> DataFrame:
    """(polygon, ix, iy) of the pixels whose centre lies inside: crossing parity per pixel row."""
    keys, poly = list(keys), list(poly)
    s = F.lit(float(res))
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edge_table.withColumn("iy", F.explode(F.sequence(F.floor(lo / s), F.floor(hi / s))))
    cy = (F.col("iy") + 0.5) * s
    e = e.where((F.col("y1") > cy) != (F.col("y2") > cy)).withColumn(
        "__c", (F.col("x2") - F.col("x1")) * (cy - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    # crossings of one polygon with one pixel row: their order alternates entering and leaving
    runs = e.groupBy(*keys, *poly, "iy").agg(F.array_sort(F.collect_list("__c")).alias("__cs"))
    runs = runs.selectExpr(*keys, *poly, "iy", "explode(filter(transform(__cs, (c, i) -> struct(i AS i, c AS a, get(__cs, i + 1) AS b)), "
                           "t -> t.i % 2 = 0)) AS t")
    first, last = f"cast(ceil(t.a / {res}D - 0.5D) AS long)", f"cast(ceil(t.b / {res}D - 0.5D) AS long) - 1"
    return (runs.where(F.expr(f"{last} >= {first}")).selectExpr(*keys, *poly, "iy", f"explode(sequence({first}, {last})) AS ix"))


def hexagons_inside(edge_table: DataFrame, poly: Sequence[str], size: float, bin_size: float, keys: Sequence[str] = ()) -> DataFrame:
    """(polygon, q, r, x, y) of all hexagons whose centre lies inside."""
    keys, poly = list(keys), list(poly)
    w, h = size * 1.7320508075688772, size * 1.5
    cols = [*keys, *poly]
    c = (bounds(edge_table, cols)
         .selectExpr(*cols, "x0", "xmax", f"explode(sequence(cast(ceil(y0 / {h}D) AS long), cast(floor(ymax / {h}D) AS long))) AS r")
         .selectExpr(*cols, "r", f"explode(sequence(cast(ceil(x0 / {w}D - r / 2D) AS long), cast(floor(xmax / {w}D - r / 2D) AS long))) AS q")
         .selectExpr(*cols, "q", "r", f"{w}D * (q + r / 2D) AS x", f"{h}D * r AS y"))
    mine = c.withColumnsRenamed({p: f"__{p}" for p in poly})
    hit = containing(mine, edge_table, [*[f"__{p}" for p in poly], "q", "r", "x", "y"], poly, bin_size, keys)
    same = F.lit(True)
    for p in poly:
        same = same & (F.col(p) == F.col(f"__{p}"))
    return hit.where(same).select(*cols, "q", "r", "x", "y")


def cell_edges(cells: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Six border segments per hexagon, end points rounded to millimetres and in a fixed order."""
    from ..functions.geo import hex_corners
    cs = [F.struct(F.round(x, 3).alias("x"), F.round(y, 3).alias("y")) for x, y in hex_corners(F.col("x"), F.col("y"), size)]
    pairs = F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in zip(cs, cs[1:] + cs[:1])])
    return cells.select(*keys, F.explode(pairs).alias("e")).selectExpr(*keys, "e.a.x AS x1", "e.a.y AS y1", "e.b.x AS x2", "e.b.y AS y2")


def group_outline(cells: DataFrame, group: Sequence[str], size: float) -> DataFrame:
    """Outline of each group: the segments that belong to one of its cells only."""
    e = cell_edges(cells, group, size)
    return e.groupBy(*group, "x1", "y1", "x2", "y2").agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")


def resolve_destination(points: DataFrame, dests: DataFrame, ids: Sequence[str], hex_size: float, max_dist: float,
                        keys: Sequence[str] = ("city",)) -> DataFrame:
    """Destination whose coarse cell holds the point, else the nearest one within ``max_dist``, else NULL."""
    from ..functions.geo import hex_cell
    keys, ids = list(keys), list(ids)

    def coarse(df):
        hq, hr = hex_cell(F.col("x"), F.col("y"), hex_size)
        return df.withColumn("__hq", hq).withColumn("__hr", hr)
    own = coarse(dests).groupBy(*keys, "__hq", "__hr").agg(F.min("dest").alias("__own"))
    p = coarse(points).join(own, [*keys, "__hq", "__hr"], "left")
    rest = p.where("__own IS NULL").select(*points.columns)
    near = nearest(rest, dests.select(*keys, "dest", "x", "y"), ids, "dest", keys, max_dist).select(*ids, F.col("dest").alias("__near"))
    return p.join(near, ids, "left").select(*ids, F.coalesce("__own", "__near").alias("dest"))


def nearest_habitable(points: DataFrame, cells: DataFrame, ids: Sequence[str], rings: int = 3, key: str = "city") -> DataFrame:
    """(ids, cell_id, status): own cell if people live there, else the nearest habitable cell of the first ring that has
    one; status 'nearest', 'noneNearby' (own cell exists) or 'outside'.  Points carry (q, r, x, y)."""
    ids = list(ids)
    lives = cells.where("habitable").selectExpr(key, "q AS nq", "r AS nr", "cell_id", "x AS cx", "y AS cy")
    own = cells.selectExpr(key, "q", "r", "true AS __inside")
    cand = ring_pairs(points, rings, [key]).join(lives, [key, "nq", "nr"])
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    best = cand.groupBy(*ids).agg(F.min(F.struct("ring", d2.alias("d2"), "cell_id")).alias("__b"))
    p = points.join(own, [key, "q", "r"], "left").join(best, ids, "left")
    status = (F.when(F.col("__b.ring") == 0, F.lit(None).cast("string")).when(F.col("__b").isNotNull(), "nearest")
              .when(F.col("__inside"), "noneNearby").otherwise("outside"))
    return p.select(*ids, F.col("__b.cell_id").alias("cell_id"), status.alias("status"))


def intersections(lines: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """Vertices where at least three segment ends meet: an end vertex counts 1, an inner vertex 2."""
    from .graph import node_key
    v = lines.selectExpr(*keys, f"posexplode({path}) AS (i, p)", f"size({path}) AS __n")         .selectExpr(*keys, "p.x AS x", "p.y AS y", "CASE WHEN i = 0 OR i = __n - 1 THEN 1 ELSE 2 END AS w")
    g = v.withColumn("node", node_key(F.col("x"), F.col("y"))).groupBy(*keys, "node").agg(
        F.sum("w").alias("ends"), F.min(F.struct("x", "y")).alias("p"))
    return g.where("ends >= 3").select(*keys, "node", "p.x", "p.y")


def nearest_per_category(cells: DataFrame, points: DataFrame, ids: Sequence[str], target_id: str,
                         measured: DataFrame | None = None, max_min: float = 30.0, key: str = "city") -> DataFrame:
    """Nearest point of each category per cell with walking minutes: the measured network value where there is one, else
    the straight line with a detour factor; farther than ``max_min`` is dropped."""
    from ..config import DETOUR, WALK_KMH
    from ..functions.geo import haversine_km
    ids = list(ids)
    cats = broadcast_if_small(points.select(key, "category").distinct())
    p = cells.join(cats, key).select(*ids, "category", "x", "y", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    near = nearest(p, points, [*ids, "category"], target_id, [key, "category"])
    near = near.join(p.select(*ids, "category", "__lat", "__lon"), [*ids, "category"])
    km = haversine_km(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon"))
    out = near.withColumn("walk_min", km * DETOUR / WALK_KMH * 60.0)
    if measured is not None:
        out = out.join(measured, [*ids, "category"], "left").withColumn("walk_min", F.coalesce("measured", "walk_min")).drop("measured")
    return out.where(F.col("walk_min") <= max_min).drop("__lat", "__lon")
