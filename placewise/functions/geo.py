"""Distances, local projection and hexagonal binning as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
M_PER_DEG = 111320.0
SQRT3 = 1.7320508075688772


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, o1, a2, o2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(EARTH_KM * 2) * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))


def planar_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Equirectangular distance used for place masks (111.2 km per degree)."""
    dy = (lat - lat0) * 111.2
    dx = (lon - lon0) * 111.2 * F.cos(F.radians(lat0))
    return F.sqrt(dx * dx + dy * dy)


def project(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Local equirectangular metres around (lat0, lon0)."""
    x = (lon - F.lit(lon0)) * F.lit(M_PER_DEG) * F.cos(F.radians(F.lit(lat0)))
    return x, (lat - F.lit(lat0)) * F.lit(M_PER_DEG)


def hex_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon with circumradius ``size`` that holds the point (cube rounding)."""
    fq = (x * SQRT3 / 3.0 - y / 3.0) / size
    fr = (y * 2.0 / 3.0) / size
    fs = -fq - fr
    rq, rr, rs = F.floor(fq + 0.5), F.floor(fr + 0.5), F.floor(fs + 0.5)
    dq, dr, ds = F.abs(rq - fq), F.abs(rr - fr), F.abs(rs - fs)
    q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return q.cast("long"), r.cast("long")


def hex_centre(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    return F.lit(size * SQRT3) * (q + r / F.lit(2.0)), F.lit(size * 1.5) * r


def hex_distance(dq: Column, dr: Column) -> Column:
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("int")


def hex_corners(x: Column, y: Column, size: float) -> list[tuple[Column, Column]]:
    half, s = size * SQRT3 / 2, size
    return [(x + dx, y + dy) for dx, dy in ((0.0, s), (half, s / 2), (half, -s / 2), (0.0, -s), (-half, -s / 2),
                                            (-half, s / 2))]


def ring_offsets(k: int) -> list[tuple[int, int, int]]:
    """(dq, dr, ring) of all hexagons within k rings, centre included."""
    return [(dq, dr, max(abs(dq), abs(dr), abs(dq + dr))) for dq in range(-k, k + 1) for dr in range(-k, k + 1)
            if abs(dq + dr) <= k]


def axis_flip(df, x: str, y: str, known: Column | None = None):
    """Southing/westing register coordinates: x = -y, y = -x; ``known`` must hold on every row or the job fails."""
    out = df.withColumn("__x", -F.col(y)).withColumn("__y", -F.col(x))
    if known is not None:
        out = out.where(F.assert_true(known, F.lit("axis flip failed on a known point")).isNull())
    return out.drop(x, y).withColumnsRenamed({"__x": x, "__y": y})
