"""Street graphs as edge tables: building, components, snapping, bounded multi-source shortest paths.

Shortest paths run block by block.  Nodes are grouped into tiles small enough for one task (crowded tiles are cut
further), one round settles every tile that received a better distance, and the edges between tiles carry the results
to their neighbours for the next round.  The search is bounded, so the number of rounds is bounded by the number of
tiles a path of that length can cross, and a city with a third of all nodes is just more tiles.
"""
from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..config import WALK_M_PER_MIN
from ..session import cut
from .spatial import edge_length, nearest, path_edges

# Road classes nobody walks on.
NO_WALK = ("motorway", "motorway_link", "trunk_link", "construction", "proposed", "raceway", "bus_guideway", "abandoned",
           "platform", "elevator", "corridor", "rest_area", "services", "escape")
STREET = ("primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential",
          "living_street", "pedestrian", "trunk")
MAJOR = ("motorway", "trunk", "primary", "motorway_link", "trunk_link")
MAX_TILE = 20_000      # nodes per tile


def walkable() -> Column:
    hw, foot, access = (F.coalesce(c, F.lit("")) for c in ("highway", "foot", "access"))
    return (~hw.isin(*NO_WALK) & (foot != "no") & ~(access.isin("private", "no") & ~foot.isin("yes", "designated")))


def bike_path() -> Column:
    hw, bicycle, cyc = (F.coalesce(c, F.lit("")) for c in ("highway", "bicycle", "cycleway"))
    return (hw == "cycleway") | cyc.rlike("lane|track") | (hw.isin("path", "footway", "track") & (bicycle == "designated"))


def node_key(x: Column, y: Column) -> Column:
    """Vertices with the same centimetre coordinates are one node."""
    return F.round(x * 100).cast("long") * F.lit(10_000_000_000) + F.round(y * 100).cast("long")


def build(lines: DataFrame, keys: Sequence[str], path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (keys, node, x, y); edges in both directions, the lengths of parallel edges added up."""
    keys = list(keys)
    e = path_edges(lines, keys, path).withColumn("u", node_key(F.col("x1"), F.col("y1"))) \
        .withColumn("v", node_key(F.col("x2"), F.col("y2"))).withColumn("len", edge_length())
    ends = e.selectExpr(*keys, "inline(array(struct(u AS node, x1 AS x, y1 AS y), struct(v AS node, x2 AS x, y2 AS y)))")
    nodes = ends.groupBy(*keys, "node").agg(F.min(F.struct("x", "y")).alias("p")).select(*keys, "node", "p.x", "p.y")
    both = e.where("u <> v").selectExpr(*keys, "inline(array(struct(u AS u, v AS v, len AS len), struct(v AS u, u AS v, len AS len)))")
    return nodes, both.groupBy(*keys, "u", "v").agg(F.sum("len").alias("len"))


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], max_rounds: int = 60) -> DataFrame:
    """(keys, node, comp): smallest node of the connected component, by alternating large-star and small-star rounds
    (logarithmic in the size of the graph); every round is written to the checkpoint folder."""
    keys = list(keys)

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            nb = e.selectExpr(*keys, "inline(array(struct(u AS a, v AS b), struct(v AS a, u AS b)))")
        else:
            nb = e.selectExpr(*keys, "greatest(u, v) AS a", "least(u, v) AS b")
        low = nb.groupBy(*keys, "a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        j = nb.join(low, [*keys, "a"])
        out = (j.where("b > a") if large else j).selectExpr(*keys, "b AS u", "m AS v")
        if large:
            return out.where("u <> v")                  # repeated edges go with the small star's
        return out.unionByName(low.selectExpr(*keys, "a AS u", "m AS v")).where("u <> v").distinct()

    e = cut(edges.selectExpr(*keys, "u", "v").where("u > v").distinct())
    mark = None
    for _ in range(max_rounds):
        e = cut(star(star(e, True), False))
        now = e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    label = e.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    return nodes.select(*keys, "node").join(label, [*keys, "node"], "left").withColumn("comp", F.coalesce("comp", "node"))


def largest_component(nodes: DataFrame, comps: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    size = comps.groupBy(*keys, "comp").agg(F.count("*").alias("n"))
    big = size.groupBy(*keys).agg(F.min_by("comp", F.struct(-F.col("n"), F.col("comp"))).alias("comp"))
    return nodes.join(comps.join(big, [*keys, "comp"], "left_semi").select(*keys, "node"), [*keys, "node"], "left_semi")


def snap(points: DataFrame, nodes: DataFrame, ids: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Nearest node of each point and the distance to it."""
    return nearest(points, nodes, ids, "node", keys).select(*ids, "node", F.col("dist").alias("snap"))


def tiles(nodes: DataFrame, keys: Sequence[str], size: float = 2000.0, max_nodes: int = MAX_TILE) -> DataFrame:
    """Adds ``tile``: a square of 2 km, or of a quarter or a sixteenth of that side where it would be too crowded,
    finally spread by hash."""
    keys = list(keys)
    out, names = nodes, []
    for lv, s in enumerate((size, size / 4, size / 16)):
        c = f"__t{lv}"
        out = out.withColumn(c, F.concat_ws("_", F.lit(lv), F.floor(F.col("x") / s), F.floor(F.col("y") / s)))
        names.append(c)
    for c in names:
        n = out.groupBy(*keys, c).agg(F.count("*").alias(f"{c}n")).where(F.col(f"{c}n") > max_nodes)
        out = out.join(n, [*keys, c], "left")
    a, b, c = (F.col(f"{x}n") for x in names)
    spread = F.concat_ws("_", names[2], F.pmod(F.xxhash64("node"), F.greatest(F.ceil(c / max_nodes), F.lit(1))))
    tile = F.when(a.isNull(), F.col(names[0])).when(b.isNull(), F.col(names[1])).when(c.isNull(), F.col(names[2])).otherwise(spread)
    return out.withColumn("tile", tile).select(*nodes.columns, "tile")


def _settle(limit: float, keys: Sequence[str]):
    """One tile: Dijkstra from the offered distances over the tile's own edges, all categories."""
    def run(key, edges: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "tile", "cat", "node", "dist"]
        if offers.empty:
            return pd.DataFrame(columns=cols)
        adj: dict[int, list[tuple[int, float]]] = {}
        for u, v, w in zip(edges["u"].tolist(), edges["v"].tolist(), edges["len"].tolist()):
            adj.setdefault(u, []).append((v, w))
        out = []
        for cat, g in offers.groupby("cat"):
            dist: dict[int, float] = {}
            heap = sorted(zip(g["dist"].tolist(), g["node"].tolist()))
            while heap:
                d, u = heapq.heappop(heap)
                if u in dist:
                    continue
                dist[u] = d
                for v, w in adj.get(u, ()):
                    if v not in dist and d + w <= limit:
                        heapq.heappush(heap, (d + w, v))
            out += [(cat, n, d) for n, d in dist.items()]
        res = pd.DataFrame(out, columns=["cat", "node", "dist"])
        for k, v in zip([*keys, "tile"], key):
            res[k] = v
        return res[cols]
    return run


def distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame, keys: Sequence[str], limit: float, tile_size: float = 2000.0,
              max_nodes: int = MAX_TILE, max_rounds: int = 500) -> DataFrame:
    """(keys, cat, node, dist): network distance to the nearest source of each category, up to ``limit``.
    ``sources``: (keys, cat, node, dist) with the starting distances."""
    keys = list(keys)
    t = cut(tiles(nodes, keys, tile_size, max_nodes))
    place = t.select(*keys, "node", "tile")
    e = (edges.join(place.withColumnsRenamed({"node": "u", "tile": "tile"}), [*keys, "u"])
         .join(place.withColumnsRenamed({"node": "v", "tile": "tile_v"}), [*keys, "v"]))
    e = cut(e.select(*keys, "u", "v", "len", "tile", "tile_v"))
    inner, cross = e.where("tile = tile_v").select(*keys, "tile", "u", "v", "len"), e.where("tile <> tile_v")
    types = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "tile string", "cat string", f"node {types['node']}", "dist double"])
    state = cut(sources.where(F.col("dist") <= limit).groupBy(*keys, "cat", "node").agg(F.min("dist").alias("dist"))
                .join(place, [*keys, "node"]).select(*keys, "tile", "cat", "node", "dist").withColumn("new", F.lit(True)))
    run = _settle(limit, keys)
    for _ in range(max_rounds):
        todo = state.where("new").select(*keys, "tile").distinct()
        if todo.isEmpty():
            return state.select(*keys, "cat", "node", "dist")
        offers = state.join(todo, [*keys, "tile"], "left_semi").drop("new")
        own = inner.join(todo, [*keys, "tile"], "left_semi")
        settled = (own.groupBy(*keys, "tile").cogroup(offers.groupBy(*keys, "tile")).applyInPandas(run, schema))
        settled = cut(settled)
        across = (settled.join(cross.withColumnRenamed("u", "node"), [*keys, "tile", "node"])
                  .select(*keys, F.col("tile_v").alias("tile"), "cat", F.col("v").alias("node"), (F.col("dist") + F.col("len")).alias("dist"))
                  .where(F.col("dist") <= limit))
        tag = lambda df, i: df.select(*keys, "tile", "cat", "node", "dist", F.lit(i).alias("src"))
        merged = tag(state, 0).unionByName(tag(settled, 0)).unionByName(tag(across, 1))
        # a node is new where an offer from another tile beats everything its own tile knows
        merged = merged.groupBy(*keys, "tile", "cat", "node").agg(
            F.min("dist").alias("dist"), F.min(F.when(F.col("src") == 0, F.col("dist"))).alias("known"))
        state = cut(merged.withColumn("new", F.col("known").isNull() | (F.col("dist") < F.col("known") - 1e-9)).drop("known"))
    raise RuntimeError("distances did not settle")


def minutes_to_nearest(points: DataFrame, targets: DataFrame, nodes: DataFrame, edges: DataFrame, ids: Sequence[str],
                       keys: Sequence[str], cap_min: float = 60.0, **tile) -> DataFrame:
    """(ids, cat, minutes): walk to the nearest target of each category over the network, both snap distances
    included, capped.  ``targets``: (keys, cat, target_id, x, y).  A category without targets has no rows."""
    keys, ids = list(keys), list(ids)
    limit = cap_min * WALK_M_PER_MIN
    at = snap(targets, nodes, [*keys, "cat", "target_id"], keys)
    src = at.groupBy(*keys, "cat", "node").agg((F.min("snap") + 1e-3).alias("dist"))
    dist = distances(nodes, edges, src, keys, limit, **tile)
    here = snap(points, nodes, list(dict.fromkeys([*keys, *ids])), keys)
    cats = targets.select(*keys, "cat").distinct()
    j = here.join(cats, keys).join(dist, [*keys, "cat", "node"], "left")
    m = F.least(F.coalesce((F.col("dist") + F.col("snap")) / WALK_M_PER_MIN, F.lit(cap_min)), F.lit(cap_min))
    return j.select(*ids, "cat", m.alias("minutes"))


# Walk-minute column -> point-of-interest categories (nearest of any).
WALK_SETS = {
    "transit.stop_walk_min": ("transit_stop",), "transit.tram_stop_walk_min": ("tram_stop",),
    "transit.rail_station_walk_min": ("metro_station", "rail_station"), "poi.metro_station_walk_min": ("metro_station",),
    "active.car_free_walk_min": ("car_free",), "active.bikeshare_walk_min": ("bikeshare_station",),
    "green.park_walk_min": ("park_2ha",), "education.nursery_walk_min": ("nursery",),
    "education.kindergarten_walk_min": ("kindergarten",), "education.primary_school_walk_min": ("primary_school",),
    "education.secondary_school_walk_min": ("secondary_school",), "education.university_walk_min": ("university",),
    "education.library_walk_min": ("library",), "family.paediatrician_walk_min": ("paediatrician",),
    "family.kids_sports_walk_min": ("kids_sports",), "price.discount_grocery_walk_min": ("discount_grocery",),
    "shops.supermarket_walk_min": ("supermarket",), "shops.post_parcel_walk_min": ("post_office", "parcel_locker"),
    "shops.bakery_walk_min": ("bakery",), "shops.marketplace_walk_min": ("marketplace",), "shops.atm_walk_min": ("atm",),
    "health.gp_walk_min": ("gp_clinic",), "health.pharmacy_walk_min": ("pharmacy",), "health.hospital_er_walk_min": ("hospital_er",),
    "health.maternity_walk_min": ("maternity_ward",), "health.dentist_walk_min": ("dentist",),
    "health.gynaecology_walk_min": ("gynaecology", "maternity_ward"), "leisure.culture_walk_min": ("culture",),
    "leisure.sports_walk_min": ("sports", "kids_sports")}


def walk_minutes(minutes: DataFrame, ids: Sequence[str], sets: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(ids, column, minutes): the nearest of a column's categories, one decimal; columns without any target are absent."""
    rows = [(col, c) for col, cs in (sets or WALK_SETS).items() for c in cs]
    m = minutes.sparkSession.createDataFrame(rows, "column string, cat string")
    return minutes.join(m, "cat").groupBy(*ids, "column").agg(F.bround(F.round(F.min("minutes"), 9), 1).alias("minutes"))
