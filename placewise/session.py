"""Session settings the library relies on."""
from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


BROADCAST_BYTES = 4 << 20       # tables that the planner may broadcast by its own estimate


def configure(spark: SparkSession) -> SparkSession:
    """Settings that change results or plans; safe to apply to a session that is already running."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.codegen.maxFields", "400")         # a request row carries a weight per indicator
    # the JVM never compiles a method above 8000 bytes of bytecode: such a stage runs as separate, compiled projections
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")      # registers in windows-1250
    # the planner takes a file's size for its rows' size; columns that compress well are many times larger in the driver's memory
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "20")
    limit = min(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold(), BROADCAST_BYTES)     # a lower limit of the user stays
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(limit))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is configured (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="placewise-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: ends the lineage of iterative jobs and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: dict[tuple[str, str, str], str] = {}


BROADCAST_ROWS = 20_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table of at most ``max_rows`` rows (counted, stopping at the limit); a larger one is left to
    the planner, which then shuffles both sides."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def widen(df: DataFrame, *by: str) -> DataFrame:
    """Spread a table over all cores where its scan has fewer partitions (a large table is left alone)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *by) if df.rdd.getNumPartitions() < n else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal rows that are about to multiply over the session's shuffle partitions: a fixed number, which is not merged again by the
    size the rows have before."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def scratch_path(spark: SparkSession, data_version: str, name: str) -> str:
    """Folder of a derived table of this application inside the shared folder."""
    tag = hashlib.md5(data_version.encode()).hexdigest()[:12]
    return f"{checkpoint_dir(spark)}/placewise-{spark.sparkContext.applicationId}/{tag}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: later jobs start from files and read the columns they use."""
    path = f"{scratch_path(df.sparkSession, uuid.uuid4().hex, name)}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def data_version(spark: SparkSession, folder: str) -> str:
    """The state of a folder of tables: names, sizes and times of all its files, as its file system lists them. No data is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return folder
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return f"{folder} {hashlib.md5(repr(sorted(found)).encode()).hexdigest()}"


def fingerprint(df: DataFrame) -> str:
    """The content of a table whatever the order of its rows and files: their number and the sum of two hashes of each."""
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    sums = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")) for seed in (1, 2)]
    return "-".join(str(x) for x in df.agg(F.count("*"), *sums).first())


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, computed once per application and state of the input folder, written to the shared folder and read back.

    Later jobs start from files instead of a long lineage, so a lost executor costs a re-read. Tables that change under the
    same path are computed anew."""
    version = data_version(spark, folder)
    key = (spark.sparkContext.applicationId, version, name)
    if key not in _written:
        path = scratch_path(spark, version, name)
        build().write.mode("overwrite").parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])
