"""Pixel tables: burning polygons, disk means, terrain slope.  A raster is a sparse table (ix, iy, value)."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .spatial import pixels_inside

DISK_1KM_HA = math.pi * 100.0


def disk_offsets(radius: float, res: float) -> list[tuple[int, int]]:
    k = math.ceil(radius / res)
    return [(dx, dy) for dx in range(-k, k + 1) for dy in range(-k, k + 1) if (dx * dx + dy * dy) * res * res <= radius * radius]


def burn(edge_table: DataFrame, values: DataFrame, poly: str, value: str, res: float, keys: Sequence[str] = ()) -> DataFrame:
    """Loudest value per pixel over all polygons and layers."""
    keys = list(keys)
    px = pixels_inside(edge_table, [poly], res, keys).join(values.select(*keys, poly, value), [*keys, poly])
    return px.groupBy(*keys, "ix", "iy").agg(F.max(value).alias("value"))


def disk_rows(radius: float, res: float) -> list[tuple[int, int]]:
    """(dy, half width) of each pixel row of the disk."""
    rows: dict[int, int] = {}
    for dx, dy in disk_offsets(radius, res):
        rows[dy] = max(rows.get(dy, 0), dx)
    return sorted(rows.items())


def _disk_pairs(cells: DataFrame, pixels: DataFrame, radius: float, res: float, keys: Sequence[str]) -> DataFrame:
    """Cells joined with the pixels of the disk around their own pixel, row by row: one exploded row per pixel row and
    block of columns, the exact column range as residual."""
    keys = list(keys)
    block = max(2 * math.ceil(radius / res) + 1, 1)
    rows = ", ".join(f"struct({dy} AS __dy, {w} AS __w)" for dy, w in disk_rows(radius, res))
    c = cells.withColumn("__cx", F.floor(F.col("x") / res)).withColumn("__cy", F.floor(F.col("y") / res))
    c = c.selectExpr("*", f"inline(array({rows}))")
    c = c.withColumn("__iy", F.col("__cy") + F.col("__dy")).withColumn("__b", F.explode(F.sequence(
        F.floor((F.col("__cx") - F.col("__w")) / block), F.floor((F.col("__cx") + F.col("__w")) / block))))
    p = pixels.withColumn("__b", F.floor(F.col("ix") / block)).withColumnsRenamed({"iy": "__iy"})
    p = p.select(*keys, "__b", "__iy", "ix", F.col("value").alias("__v"))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "__b", "__iy"]]
    on.append(F.col("b.ix").between(F.col("a.__cx") - F.col("a.__w"), F.col("a.__cx") + F.col("a.__w")))
    return c.alias("a").join(p.alias("b"), on, "left")


def disk_mean(cells: DataFrame, pixels: DataFrame, radius: float, res: float, ids: Sequence[str], keys: Sequence[str] = (),
              min_valid: float = 0.05) -> DataFrame:
    """Mean of the valid pixels within the radius; NULL where less than ``min_valid`` of the disk has a value."""
    full = len(disk_offsets(radius, res))
    pairs = _disk_pairs(cells, pixels, radius, res, keys)
    return (pairs.groupBy(*[F.col(f"a.{c}") for c in ids]).agg(F.avg("__v").alias("__m"), F.count("__v").alias("__n"))
            .select(*ids, F.when(F.col("__n") >= min_valid * full, F.col("__m")).alias("value")))


def disk_share(cells: DataFrame, pixels: DataFrame, radius: float, res: float, ids: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Share of the disk covered by the pixels (each counted once)."""
    full = len(disk_offsets(radius, res))
    pairs = _disk_pairs(cells, pixels, radius, res, keys)
    return pairs.groupBy(*[F.col(f"a.{c}") for c in ids]).agg((F.count("__v") / F.lit(float(full))).alias("share"))


def neighbours(pixels: DataFrame, offsets: Sequence[tuple[int, int, float]], keys: Sequence[str]) -> DataFrame:
    """Each pixel sends its value with a weight to the pixels at the offsets."""
    off = ", ".join(f"struct({dx} AS __dx, {dy} AS __dy, {w!r}D AS __w)" for dx, dy, w in offsets)
    return (pixels.selectExpr(*keys, "ix", "iy", "value", f"inline(array({off}))")
            .selectExpr(*keys, "ix + __dx AS ix", "iy + __dy AS iy", "value", "__w"))


def smooth(pixels: DataFrame, sigma_px: float, keys: Sequence[str] = ()) -> DataFrame:
    """Gaussian mean over the pixels within four standard deviations (weights of existing pixels renormalised)."""
    k = int(4 * sigma_px + 0.5)
    offs = [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2 * sigma_px * sigma_px))) for dx in range(-k, k + 1) for dy in range(-k, k + 1)]
    sent = neighbours(pixels, offs, keys).groupBy(*keys, "ix", "iy").agg(
        (F.sum(F.col("value") * F.col("__w")) / F.sum("__w")).alias("value"))
    return sent.join(pixels.select(*keys, "ix", "iy"), [*keys, "ix", "iy"], "left_semi")


def slope(pixels: DataFrame, res: float, keys: Sequence[str] = ()) -> DataFrame:
    """Slope in percent: central differences, one-sided at the border, 0 along an axis without neighbours."""
    offs = [(0, 0, 0.0), (-1, 0, 1.0), (1, 0, 2.0), (0, -1, 3.0), (0, 1, 4.0)]
    at = lambda t: F.max(F.when(F.col("__w") == t, F.col("value")))
    n = neighbours(pixels, offs, keys).groupBy(*keys, "ix", "iy").agg(
        at(0.0).alias("c"), at(1.0).alias("e"), at(2.0).alias("w"), at(3.0).alias("n"), at(4.0).alias("s")).where("c IS NOT NULL")

    def diff(hi, lo):
        return (F.when(F.col(hi).isNotNull() & F.col(lo).isNotNull(), (F.col(hi) - F.col(lo)) / (2 * res))
                .when(F.col(hi).isNotNull(), (F.col(hi) - F.col("c")) / res)
                .when(F.col(lo).isNotNull(), (F.col("c") - F.col(lo)) / res).otherwise(0.0))
    gx, gy = diff("e", "w"), diff("n", "s")
    return n.select(*keys, "ix", "iy", (F.sqrt(gx * gx + gy * gy) * 100.0).alias("value"))


def terrain_slope(cells: DataFrame, dem: DataFrame, res: float, ids: Sequence[str], keys: Sequence[str] = (), sigma: float = 60.0,
                  radius: float = 180.0) -> DataFrame:
    """Mean slope of the smoothed surface within the radius of each cell, 0-100 %."""
    px = slope(smooth(dem, sigma / res, keys), res, keys)
    out = disk_mean(cells, px, radius, res, ids, keys, 0.0)
    return out.withColumn("value", F.least(F.greatest("value", F.lit(0.0)), F.lit(100.0)))
