"""Air readings: decoding, latest value per station, freshness.  Batch twins of the streaming job."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

INDEX = {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5}   # fixed values: provider index id -> common scale 0-5
TTL_S = 600
VALUE_TYPES = ("8", "9", "148")


def air_level(code: Column, subs: Column) -> Column:
    """Common level of a provider code; without one, the worst known pollutant sub-index."""
    m = F.create_map(*[F.lit(x) for kv in INDEX.items() for x in kv])
    return F.coalesce(F.try_element_at(m, code), F.array_max(F.filter(subs, lambda s: s >= 0)))


def local_to_utc(s: Column, tz: str) -> Column:
    """'yyyy-MM-dd HH:mm:ss' in a zone -> ISO UTC, NULL if it does not parse."""
    ts = F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.date_format(F.to_utc_timestamp(ts, tz), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def decode(readings: DataFrame, registry: DataFrame) -> DataFrame:
    """Readings of the accepted value types with station and component."""
    return (readings.where(F.col("value_type").isin(*VALUE_TYPES))
            .join(registry.select("registration", "station", "component"), "registration"))


def by_station(decoded: DataFrame, components: list[str]) -> DataFrame:
    """One row per station, a column per component (latest value each) and the latest time."""
    last = lambda c: F.max_by(F.when(F.col("component") == c, F.col("value")),
                              F.when(F.col("component") == c, F.struct("ts", "reading_id"))).alias(c)
    return decoded.groupBy("station").agg(F.max("ts").alias("ts"), *[last(c) for c in components])


def latest(df: DataFrame, key: str) -> DataFrame:
    return (df.groupBy(key).agg(F.max_by(F.struct("value", "ts", "reading_id"), F.struct("ts", "reading_id")).alias("__l"))
            .select(key, "__l.*"))


def freshness(df: DataFrame, now: Column, ts: str = "ts", ttl: int = TTL_S) -> DataFrame:
    """ok within the time to live, stale after it, unavailable without any reading."""
    age = now.cast("timestamp").cast("long") - F.col(ts).cast("timestamp").cast("long")
    return df.withColumn("status", F.when(F.col(ts).isNull(), "unavailable").when(age <= ttl, "ok").otherwise("stale"))


def dedup(df: DataFrame, key: list[str]) -> DataFrame:
    return df.dropDuplicates(key)
