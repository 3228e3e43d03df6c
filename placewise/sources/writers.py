"""Writers, exports and lineage."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CELL_ID_COLUMNS, CRITERIA
from ..functions.norm import half_even
from ..operators.ranking import global_positions, medians


def write_cells(cells: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Contract columns in order, one folder per city; rows are spread by cell, so a large city becomes many files."""
    out = cells.select("city", *CELL_ID_COLUMNS, *[F.col(f"`{c}`") for c in columns])
    out.write.mode("overwrite").partitionBy("city").option("compression", "snappy").parquet(path)


def write_travel_times(times: DataFrame, path: str) -> None:
    times.select("origin", "dest", F.col("minutes").cast("smallint"), "city", "mode").write.mode("overwrite") \
        .partitionBy("city", "mode").parquet(path)


def static_scores(scored: DataFrame) -> DataFrame:
    """Whole criterion scores per persona and cell, NULL where a criterion has no data: the offline export."""
    rounded = F.transform("crit", lambda c: half_even(c).cast("int"))
    return scored.select("city", "cell_id", "habitable", "persona", rounded.alias("r")) \
        .select("city", "cell_id", "habitable", "persona", *[F.col("r")[i].alias(c) for i, c in enumerate(CRITERIA)])


def static_medians(scored: DataFrame) -> DataFrame:
    """Whole median criterion score over habitable cells per city and persona."""
    names = F.array(*[F.lit(c) for c in CRITERIA])
    long = scored.where("habitable").select("city", "persona", F.posexplode("crit").alias("i", "s")).where("s IS NOT NULL")
    return medians(long, ["city", "persona", "i"], "s").select("city", "persona", names[F.col("i")].alias("criterion"),
                                                               half_even(F.col("median")).cast("int").alias("median"))


def grid_features(cells: DataFrame, corners: Column, order: str = "cell_id") -> DataFrame:
    """One GeoJSON feature per cell as text; the numeric id is the row's index in key order."""
    p = global_positions(cells.withColumn("__corners", corners), ["city"], [F.asc(order)], "idx").withColumn("idx", F.col("idx") - 1)
    props = F.struct(F.col(order).cast("string").alias("h3"), "district_id", "district_name", "neighborhood", "habitable", "population_est")
    geom = F.struct(F.lit("Polygon").alias("type"), F.array("__corners").alias("coordinates"))
    return p.select("city", "idx", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("idx").alias("id"), geom.alias("geometry"),
                                                      props.alias("properties"))).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    features.select("city", "value").write.mode("overwrite").partitionBy("city").text(path)


MANIFEST = ("url", "fetchedAt", "licence", "rows", "status", "note")


def upsert_manifest(old: DataFrame, new: DataFrame, fields: Sequence[str] = MANIFEST) -> DataFrame:
    """Merge lineage entries by key: given values win, NULLs do not overwrite (``rows`` always does for a new entry)."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.key") == F.col("n.key"), "full_outer")
    seen = F.col("n.key").isNotNull()
    pick = [F.when(seen, F.col("n.rows")).otherwise(F.col("o.rows")).alias("rows") if f == "rows"
            else F.coalesce(f"n.{f}", f"o.{f}", F.lit({"status": "missing", "note": ""}.get(f))).alias(f) for f in fields]
    return j.select(F.coalesce("n.key", "o.key").alias("key"), *pick)


def manifest_hygiene(manifest: DataFrame, known: DataFrame, derived: Sequence[str] = ()) -> DataFrame:
    """Drop unknown keys, clear the failure notes of sources that work, explain verified but unused and missing ones.
    ``known``: (key, use)."""
    m = manifest.join(known, "key", "left").where(F.col("use").isNotNull() | F.col("key").isin(*derived))
    note = F.coalesce("note", F.lit(""))
    note = F.when((F.col("status") == "ok") & note.startswith("fetch failed"), "").otherwise(note)
    unused = (F.col("status") == "ok") & F.col("rows").isNull() & (note == "")
    note = F.when(unused, F.concat(F.lit("reachable (verified "), F.substring(F.coalesce("fetchedAt", F.lit("None")), 1, 10),
                                   F.lit("); not used for features — "), F.coalesce(F.nullif("use", F.lit("")), F.lit("reference")))).otherwise(note)
    note = F.when((F.col("status") == "missing") & (F.coalesce("use", F.lit("")) != ""), F.concat(note, F.lit(" ["), F.col("use"), F.lit("]"))).otherwise(note)
    return m.withColumn("note", note).drop("use")


__all__ = ["MANIFEST", "grid_features", "manifest_hygiene", "static_medians", "static_scores", "upsert_manifest",
           "write_cells", "write_features", "write_travel_times"]
