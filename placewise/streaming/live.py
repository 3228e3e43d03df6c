"""Live readings as Structured Streaming jobs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.live import TTL_S, decode, latest

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
COMPONENTS = {"PM10": 1, "PM2_5": 2, "NO2": 3, "INDX": 4}


def readings(events: DataFrame) -> DataFrame:
    """Events as readings; event time as a zoned timestamp, which watermarks need."""
    return events.selectExpr(
        "event_id AS reading_id", "cast(ts AS timestamp) AS ts",
        "user_id * 10 + CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS registration",
        "CASE event_id % 5 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN '148' ELSE '7' END AS value_type", "value")


def registry(events: DataFrame) -> DataFrame:
    """Static registry: registration -> station and component."""
    arms = ", ".join(f"struct({k} AS k, '{c}' AS component)" for c, k in COMPONENTS.items())
    return (events.select(F.col("user_id").alias("station")).distinct().selectExpr("station", f"inline(array({arms}))")
            .selectExpr("station * 10 + k AS registration", "station", "component"))


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Files of that name as a stream of readings (a stream source watches their folder)."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    src = spark.readStream.schema(EVENT_SCHEMA).format("parquet").option("pathGlobFilter", name).load(folder)
    return readings(src)


def merge_latest(target: str, key: str):
    """foreachBatch sink: fold a micro-batch into the latest-per-key table.  Each batch writes a new version, named by
    its id, from the previous one, so a replayed batch gives the same version."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, key)
        if batch_id > 0:
            old = spark.read.schema(new.schema).parquet(f"{target}/v{batch_id - 1}")
            new = latest(old.unionByName(new), key)
        new.write.mode("overwrite").parquet(f"{target}/v{batch_id}")
    return write


def latest_per_station(readings_stream: DataFrame, reg: DataFrame, target: str, checkpoint: str):
    """Start the keyed job: stream joined with the static registry, latest value per station."""
    return (decode(readings_stream, reg).writeStream.foreachBatch(merge_latest(target, "station"))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def newest_version(spark: SparkSession, target: str) -> DataFrame:
    from pyspark.errors import AnalysisException
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    versions = [int(n[1:]) for n in names if n.startswith("v")]
    if not versions:
        raise AnalysisException(f"no version at {target}")
    return spark.read.parquet(f"{target}/v{max(versions)}")


def _run_folder(root: str) -> str:
    import uuid
    return f"{root}/{uuid.uuid4().hex}"


def run_latest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Consume the files once and return the latest value per station."""
    root = _run_folder(root)
    reg = registry(spark.read.schema(EVENT_SCHEMA).parquet(path))
    latest_per_station(stream(spark, path), reg, f"{root}/table", f"{root}/ckpt").awaitTermination()
    return newest_version(spark, f"{root}/table")


def dedup_within(readings_stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Re-delivered readings are dropped while their event time is inside the watermark."""
    return readings_stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["reading_id"])


def run_dedup(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Deliver every reading twice, keep one of each, return the sink's table."""
    root = _run_folder(root)
    twice = stream(spark, path).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    (dedup_within(twice).writeStream.format("parquet").option("path", f"{root}/table").option("checkpointLocation", f"{root}/ckpt")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/table")


def freshness_job(readings_stream: DataFrame, ttl_s: int = TTL_S, delay: str = "0 seconds") -> DataFrame:
    """(station, status, ts): 'ok' with each new reading, 'stale' when none arrives within the time to live (event-time
    timer).  One value per station is kept as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
    import pandas as pd

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            ts, = state.get
            state.remove()
            yield pd.DataFrame({"station": [key[0]], "status": ["stale"], "ts": [pd.Timestamp(ts, unit="ms")]})
            return
        newest = max(b["ts"].max() for b in batches)
        ms = int(newest.timestamp() * 1000)
        if state.exists:
            ms = max(ms, state.get[0])
        state.update((ms,))
        state.setTimeoutTimestamp(max(ms + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"station": [key[0]], "status": ["ok"], "ts": [pd.Timestamp(ms, unit="ms")]})

    return (readings_stream.withWatermark("ts", delay).groupBy("station")
            .applyInPandasWithState(step, "station long, status string, ts timestamp", "ms long", "append", GroupStateTimeout.EventTimeTimeout))
