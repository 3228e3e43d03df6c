"""Exact areas that polygons share, as sums over pairs of edges.

A polygon is the signed sum of the trapezoids under its edges (plus where an edge runs to the right, minus to the left), so the
area of an intersection is the sum, over all pairs of edges of the two polygons, of the product of their signs and the integral of
the lower one over the x both span: where both polygons lie below a common height the height cancels. Edges are cut at the
borders of vertical strips and meet by an equi-join on (polygon, strip), so the pairs stay few and a polygon with very many
edges spreads over its strips. No shape is clipped and nothing is estimated on points.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import hex_corners
from .spatial import bounds, nearest


def strips(edge_table: DataFrame, by: Sequence[str], width: float) -> DataFrame:
    """(by, strip, xl, xr, yl, yr, sign): the edges cut at multiples of ``width``; vertical edges cover nothing."""
    e = edge_table.where("x1 <> x2").select(
        *by, F.least("x1", "x2").alias("__a"), F.greatest("x1", "x2").alias("__b"), F.when(F.col("x1") < F.col("x2"), F.col("y1")).otherwise(F.col("y2")).alias("__ya"),
        F.when(F.col("x1") < F.col("x2"), F.col("y2")).otherwise(F.col("y1")).alias("__yb"), F.when(F.col("x1") < F.col("x2"), 1.0).otherwise(-1.0).alias("sign"))
    w = F.lit(float(width))
    e = e.withColumn("strip", F.explode(F.sequence(F.floor(F.col("__a") / w), F.floor(F.col("__b") / w))))
    e = e.withColumn("xl", F.greatest("__a", F.col("strip") * w)).withColumn("xr", F.least("__b", (F.col("strip") + 1) * w)).where("xl < xr")
    y = lambda x: F.col("__ya") + (F.col("__yb") - F.col("__ya")) * (F.col(x) - F.col("__a")) / (F.col("__b") - F.col("__a"))
    return e.select(*by, "strip", "xl", "xr", y("xl").alias("yl"), y("xr").alias("yr"), "sign")


def touching(a_edges: DataFrame, b_edges: DataFrame, a: Sequence[str], b: Sequence[str], size: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, xl, xr, y0): pairs of polygons whose boxes overlap, the x both span and the lower y of the first box. A pair meets
    in one bin only, that of the corner where the overlap begins."""
    keys, s = list(keys), F.lit(float(size))

    def binned(edge_table: DataFrame, by: Sequence[str], p: str) -> DataFrame:
        box = bounds(edge_table, [*keys, *by]).withColumnsRenamed({c: f"{p}{c}" for c in ("x0", "xmax", "y0", "ymax")})
        return (box.withColumn("__bx", F.explode(F.sequence(F.floor(F.col(f"{p}x0") / s), F.floor(F.col(f"{p}xmax") / s))))
                .withColumn("__by", F.explode(F.sequence(F.floor(F.col(f"{p}y0") / s), F.floor(F.col(f"{p}ymax") / s)))))
    both = binned(a_edges, a, "__p").join(binned(b_edges, b, "__q"), [*keys, "__bx", "__by"])
    xl, xr = F.greatest("__px0", "__qx0"), F.least("__pxmax", "__qxmax")
    yl, yr = F.greatest("__py0", "__qy0"), F.least("__pymax", "__qymax")
    here = (F.floor(xl / s) == F.col("__bx")) & (F.floor(yl / s) == F.col("__by"))
    return both.where((xl < xr) & (yl < yr) & here).select(*keys, *a, *b, xl.alias("xl"), xr.alias("xr"), F.col("__py0").alias("y0"))


def shared_area(a_edges: DataFrame, b_edges: DataFrame, a: Sequence[str], b: Sequence[str], size: float, keys: Sequence[str] = (), least: float = 1e-6) -> DataFrame:
    """(keys, a, b, area) of all pairs of polygons that share more than ``least``.

    Rings may turn either way, but the holes of a polygon against its outline. ``a`` and ``b`` name different columns; ``size`` is
    the width of bins and strips: about a small polygon's diameter."""
    keys, a, b = list(keys), list(a), list(b)
    w = F.lit(float(size))
    pairs = touching(a_edges, b_edges, a, b, size, keys)
    pairs = pairs.withColumn("strip", F.explode(F.sequence(F.floor(F.col("xl") / w), F.floor(F.col("xr") / w)))).drop("xl", "xr")
    side = lambda df, by, p: strips(df, [*keys, *by], size).withColumnsRenamed({c: f"{p}{c}" for c in ("xl", "xr", "yl", "yr", "sign")})
    met = pairs.join(side(a_edges, a, "a_"), [*keys, *a, "strip"]).join(side(b_edges, b, "b_"), [*keys, *b, "strip"])
    met = met.withColumn("l", F.greatest("a_xl", "b_xl")).withColumn("r", F.least("a_xr", "b_xr")).where("l < r")
    y = lambda p, x: F.col(f"{p}yl") - F.col("y0") + (F.col(f"{p}yr") - F.col(f"{p}yl")) * (F.col(x) - F.col(f"{p}xl")) / (F.col(f"{p}xr") - F.col(f"{p}xl"))
    met = met.select(*keys, *a, *b, (F.col("a_sign") * F.col("b_sign")).alias("sign"), (F.col("r") - F.col("l")).alias("wide"),
                     y("a_", "l").alias("al"), y("a_", "r").alias("ar"), y("b_", "l").alias("bl"), y("b_", "r").alias("br"))
    # the mean of the lower line is half the sum of both means, less half the mean distance of the lines
    met = met.withColumn("dl", F.abs(F.col("al") - F.col("bl"))).withColumn("dr", F.abs(F.col("ar") - F.col("br")))
    cross = (F.col("al") - F.col("bl")) * (F.col("ar") - F.col("br")) < 0
    apart = F.when(cross, (F.col("dl") * F.col("dl") + F.col("dr") * F.col("dr")) / (2 * (F.col("dl") + F.col("dr")))).otherwise((F.col("dl") + F.col("dr")) / 2)
    lower = (F.col("al") + F.col("ar") + F.col("bl") + F.col("br")) / 4 - apart / 2
    return (met.groupBy(*keys, *a, *b).agg(F.abs(F.sum(F.col("sign") * F.col("wide") * lower)).alias("area")).where(F.col("area") > least))


def hexagon_edges(cells: DataFrame, ids: Sequence[str], hex_size: float) -> DataFrame:
    """(ids, x1, y1, x2, y2): the six sides of each cell around its centre (x, y)."""
    cs = [F.struct(x.alias("x"), y.alias("y")) for x, y in hex_corners(F.col("x"), F.col("y"), hex_size)]
    sides = F.array(*[F.struct(p.alias("p"), q.alias("q")) for p, q in zip(cs, cs[1:] + cs[:1])])
    return cells.select(*ids, F.explode(sides).alias("e")).selectExpr(*ids, "e.p.x AS x1", "e.p.y AS y1", "e.q.x AS x2", "e.q.y AS y2")


def majority_label(cells: DataFrame, edge_table: DataFrame, ids: Sequence[str], poly: str, size: float, hex_size: float,
                   centres: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Polygon that covers most of a cell (ties on square decimetres: the smaller id), ``share`` of the cell and ``how`` = area;
    cells no polygon touches take the nearest polygon centre, without share."""
    ids = list(ids)
    cols = [c for c in ids if c not in keys]
    hexes = hexagon_edges(cells, list(dict.fromkeys([*keys, *ids])), hex_size)
    whole = 1.5 * 3 ** 0.5 * hex_size ** 2
    part = shared_area(hexes, edge_table, cols, [poly], size, keys)
    best = part.groupBy(*ids).agg(F.min_by(F.struct(poly, "area"), F.struct(-F.round("area", 2), F.col(poly))).alias("b"))
    best = best.select(*ids, f"b.{poly}", (F.col("b.area") / whole).alias("share"), F.lit("area").alias("how"))
    rest = cells.join(best.select(*ids), ids, "left_anti")
    near = nearest(rest, centres, ids, poly, keys).select(*ids, poly)
    return best.unionByName(near.select("*", F.lit(None).cast("double").alias("share"), F.lit("nearest").alias("how")))


def apportion(edge_table: DataFrame, values: DataFrame, districts: DataFrame, source: str, district: str, value: str,
              size: float, keys: Sequence[str] = ()) -> DataFrame:
    """Split a polygon's value over districts by the share of its area that lies in each.

    Where the districts cover a polygon without overlap its whole value is given out; parts outside of all districts are lost,
    and overlapping districts both take theirs."""
    keys = list(keys)
    whole = polygon_area(edge_table, [*keys, source])
    part = shared_area(edge_table, districts, [source], [district], size, keys)
    return (part.join(whole, [*keys, source]).join(values.select(*keys, source, value), [*keys, source])
            .groupBy(*keys, district).agg(F.sum(F.col(value) * F.col("area") / F.col("__whole")).alias(value)))


def polygon_area(edge_table: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, __whole), with coordinates taken from each polygon's own corner so that large ones lose no digits."""
    corner = edge_table.groupBy(*by).agg(F.min("x1").alias("__x"), F.min("y1").alias("__y"))
    x1, y1, x2, y2 = (F.col(c) - F.col(o) for c, o in (("x1", "__x"), ("y1", "__y"), ("x2", "__x"), ("y2", "__y")))
    return edge_table.join(corner, list(by)).groupBy(*by).agg(F.abs(F.sum(x1 * y2 - x2 * y1) / 2).alias("__whole"))
