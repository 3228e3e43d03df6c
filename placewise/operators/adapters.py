"""Extension points: region-specific column builders, and SQL functions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import fold_sql

Builder = Callable[[DataFrame], DataFrame]


class Registry:
    """Named builders of extra cell columns.  A builder gets the cells (of its city, if bound to one) and returns
    (city, cell_id, columns...); results are joined to the cell table on the key."""

    def __init__(self) -> None:
        self._builders: dict[str, tuple[Builder, str | None]] = {}

    def add(self, name: str, builder: Builder, city: str | None = None) -> None:
        self._builders[name] = (builder, city)

    def apply(self, cells: DataFrame) -> DataFrame:
        out = cells
        for builder, city in self._builders.values():
            part = builder(cells if city is None else cells.where(F.col("city") == city))
            out = out.join(part, ["city", "cell_id"], "left")
        return out


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary SQL functions; Catalyst inlines their bodies."""
    hav = ("6371.0D * 2 * asin(sqrt(least(greatest(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * "
           "cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2), 0.0D), 1.0D)))")
    fold = fold_sql("s")
    for sig, ret, body in (
            ("pw_haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)", "DOUBLE", hav),
            ("pw_decay(v DOUBLE, good DOUBLE, bad DOUBLE)", "DOUBLE", "least(greatest((v - bad) / (good - bad) * 100.0D, 0.0D), 100.0D)"),
            ("pw_fold(s STRING)", "STRING", fold)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sig} RETURNS {ret} RETURN {body}")
