"""Readers: explicit schemas, nothing is inferred by an extra pass."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

IDENTITY_SCHEMA = ("cell_id string, lat double, lon double, habitable boolean, district_id string, district_name string, "
                   "neighborhood string, population_est int")
POI_SCHEMA = "category string, name string, lat double, lon double, h3_9 string, source string, extra_json string"
POLYGON = "type string, coordinates array<array<array<double>>>"


def read_cells(spark: SparkSession, path: str, indicators: Sequence[str] = ()) -> DataFrame:
    """Cell table partitioned by city; only the asked-for indicator columns are read."""
    schema = IDENTITY_SCHEMA + "".join(f", `{c}` double" for c in indicators) + ", city string"
    return spark.read.schema(schema).parquet(path)


def read_pois(spark: SparkSession, path: str, categories: Sequence[str] | None = None) -> DataFrame:
    """Points of interest, four columns; categories prune partitions or row groups."""
    df = spark.read.schema(POI_SCHEMA).parquet(path).select("category", "name", "lat", "lon")
    return df.where(F.col("category").isin(*categories)) if categories else df


def _present(spark: SparkSession, path: str) -> bool:
    """Whether the glob matches any file, asked of the path's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_gtfs(spark: SparkSession, feeds: dict[str, str], table: str, columns: Sequence[str]) -> DataFrame:
    """One timetable table over all feeds, every column text, tagged with its feed; a missing file or optional column
    is empty.  Header names are trimmed and a byte-order mark is dropped."""
    out = spark.createDataFrame([], "feed string, " + ", ".join(f"{c} string" for c in columns))
    for feed, folder in feeds.items():
        path = f"{folder}/{table}.txt"
        if not _present(spark, path):
            continue
        df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
        df = df.toDF(*[c.strip().lstrip("﻿").strip() for c in df.columns])
        keep = [c for c in columns if c in df.columns]
        df = df.select(F.lit(feed).alias("feed"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in keep])
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Semicolon-separated registers.  Legacy charsets such as windows-1250 need the session setting
    ``spark.sql.legacy.javaCharsets=true``."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, encoding=encoding, enforceSchema=True)


def read_geojson(spark: SparkSession, path: str, properties: str, geometry: str = POLYGON) -> DataFrame:
    """FeatureCollection -> one row per feature: id, properties and coordinates.  (Line-delimited features: read_geojson_lines.)"""
    schema = f"type string, features array<struct<id: bigint, properties: struct<{properties}>, geometry: struct<{_fields(geometry)}>>>"
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.select(F.explode("features").alias("f")).select("f.id", "f.properties.*", F.col("f.geometry.type").alias("geometry_type"),
                                                              F.col("f.geometry.coordinates").alias("coordinates"))


def read_geojson_lines(spark: SparkSession, path: str, properties: str, geometry: str = POLYGON) -> DataFrame:
    """One feature per line: splittable, the form to use for large layers."""
    schema = f"id bigint, properties struct<{properties}>, geometry struct<{_fields(geometry)}>"
    df = spark.read.schema(schema).json(path)
    return df.select("id", "properties.*", F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("coordinates"))


def _fields(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl))


SCHOOLS = ("list array<struct<zkracenyNazev: string, uplnyNazev: string, redIzo: string, adresa: struct<kodRUIAN: string>, "
           "skolyAZarizeni: array<struct<druh: string, izo: string, mistaVyuky: array<struct<adresa: struct<kodRUIAN: string>>>>>>>")
# School type -> category.
SCHOOL_TYPES = {"A00": "kindergarten", "B00": "primary_school", "C00": "secondary_school"}


def explode_register(df: DataFrame) -> DataFrame:
    """Entity -> facilities -> places; a facility without places takes the entity's own address."""
    e = df.select(F.explode("list").alias("e"))
    f = e.select("e", F.explode("e.skolyAZarizeni").alias("f"))
    places = F.when(F.size("f.mistaVyuky") > 0, F.transform("f.mistaVyuky", lambda m: m["adresa"])).otherwise(F.array("e.adresa"))
    cat = F.create_map(*[F.lit(x) for kv in SCHOOL_TYPES.items() for x in kv])
    return (f.select("e", "f", F.explode(places).alias("a"), F.try_element_at(cat, F.col("f.druh")).alias("category"))
            .where("category IS NOT NULL").select("category", F.coalesce("e.zkracenyNazev", "e.uplnyNazev").alias("name"),
                                                  F.coalesce("a.kodRUIAN", F.lit("")).alias("adm"), F.col("f.izo").alias("izo"),
                                                  F.col("e.redIzo").alias("redizo")))


def read_nested_register(spark: SparkSession, path: str) -> DataFrame:
    return explode_register(spark.read.schema(SCHOOLS).json(path, multiLine=True))


def read_xml_features(spark: SparkSession, path: str, fields: str, feature: str = "lokale", lines: bool = False) -> DataFrame:
    """WFS members -> flat records; the position is 'northing easting' and becomes (x, y).  ``lines``: one member per
    line, which lets Spark split a large file."""
    schema = f"{feature} struct<{fields}, msGeometry: struct<Point: struct<pos: string>>>"
    df = spark.read.format("xml").option("rowTag", "member").option("ignoreNamespace", "true").option("multiLine", str(not lines).lower()).schema(schema).load(path)
    p = F.split(F.trim(F.col(f"{feature}.msGeometry.Point.pos")), r"\s+")
    return df.select(f"{feature}.*", p[1].cast("double").alias("x"), p[0].cast("double").alias("y")).drop("msGeometry")


def read_monthly(spark: SparkSession, path: str, schema: str, months: int | None = None) -> DataFrame:
    """Monthly CSV files (…/202401.csv): adds ``month`` from the file name and keeps the newest months."""
    from ..operators.registers import latest_months
    df = spark.read.schema(schema).csv(path, header=True).withColumn("month", F.regexp_extract(F.input_file_name(), r"(\d{6})\.csv", 1))
    return df if months is None else latest_months(df, "month", months)


def read_travel_times(spark: SparkSession, path: str) -> DataFrame:
    """Long travel times partitioned by (city, mode); unreachable pairs have no row."""
    return spark.read.schema("origin string, dest string, minutes smallint, city string, mode string").parquet(path) \
        .where("minutes <= 120")


def features_to_points(features: DataFrame, keys: Sequence[str], category: str, source: str) -> DataFrame:
    """One representative point per polygon (columns keys, ring): the mean of its vertices, or, where that lies outside,
    the vertex nearest to it."""
    from ..operators.spatial import edges
    keys = list(keys)
    e = edges(features, keys)
    mean = e.groupBy(*keys).agg(F.avg("x1").alias("x"), F.avg("y1").alias("y"))
    j = e.join(mean, keys)
    cross = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (
        F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1"))
    d2 = (F.col("x1") - F.col("x")) * (F.col("x1") - F.col("x")) + (F.col("y1") - F.col("y")) * (F.col("y1") - F.col("y"))
    g = j.groupBy(*keys).agg((F.count_if(cross) % 2 == 1).alias("inside"), F.min("x").alias("mx"), F.min("y").alias("my"),
                             F.min(F.struct(F.round(d2, 6).alias("d"), "i", "x1", "y1")).alias("v"))
    pick = lambda a, b: F.when(F.col("inside"), F.col(a)).otherwise(F.col(b))
    return g.select(*keys, pick("mx", "v.x1").alias("x"), pick("my", "v.y1").alias("y"), F.lit(category).alias("category"),
                    F.lit(source).alias("source"))
