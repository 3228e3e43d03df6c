"""Normalisation and rounding as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def decay(v: Column, good: float, bad: float, factor: Column | float = 1.0) -> Column:
    """100 at ``good`` falling to 0 at ``bad``; works in both directions.  NULL stays NULL."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.when(v.isNotNull(), clip((v * f - F.lit(float(bad))) / F.lit(float(good) - float(bad)) * 100.0))


def threshold(v: Column, at: float) -> Column:
    return F.when(v >= F.lit(float(at)), 100.0).when(v.isNotNull(), 0.0)


def half_even(x: Column, digits: int = 0) -> Column:
    """Half-even rounding; rounding to nine digits first takes float noise off exact ties."""
    return F.bround(F.round(x, 9), digits)


def log_heavy(v: Column) -> Column:
    return F.log1p(F.greatest(v, F.lit(0.0)))


def band_value(lo: Column, hi: Column) -> Column:
    """Level of a noise band: its middle; open below -> hi - 5; open above -> lo + 2.5."""
    return (F.when(hi.isNull() | (hi >= 99), lo + 2.5).when(lo.isNull() | (hi - lo > 10), hi - 5.0)
            .otherwise((lo + hi) / 2.0))
