"""Helpers the operators of this subpackage share."""
from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from placewise.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the folder all executors share, and read it back: later jobs start from files."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/placewise-llm/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wider(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with more columns (a new object: df.schema itself is kept by the frame)."""
    more = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns.items()))
    return T.StructType([*df.schema.fields, *more.fields])


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n: splits rows into learning and held-out parts."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")), F.lit(n))


def bounded_per(df: DataFrame, key: str, rows: int, by: Column, least: int = 500, seed: int = 17) -> DataFrame:
    """As ``bounded``, but about ``least`` rows of every class ``by`` at the least (all rows of a rarer one), so that a class
    known on a small table stays known on a large one: about ``rows`` + ``least`` times the classes in all."""
    counts = {r["c"]: r["n"] for r in df.groupBy(by.alias("c")).agg(F.count("*").alias("n")).collect()}      # a row per class
    n = sum(counts.values())
    if n <= rows:
        return df
    share = F.lit(0)
    for c, k in counts.items():
        share = F.when(by.eqNullSafe(F.lit(c)), int(min(1.0, max(rows / n, least / k)) * 1_000_000)).otherwise(share)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < share)


def bounded(df: DataFrame, key: str, rows: int, seed: int = 17) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the key; all rows where there are fewer. Only for fitting classifiers and
    indexes: the share is set from the count of all rows, and the rows are the same in every run."""
    n = df.count()
    share = 1.0 if n <= rows else rows / n
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else df


_kept: dict[Hashable, object] = {}      # what tasks leave in a Python worker for later tasks of the same operator


def kept(key: Hashable, build: Callable[[], object]) -> object:
    """One thing a worker: built by the first task that asks for it, until something else is asked for."""
    if key not in _kept:
        release()
        _kept[key] = build()
    return _kept[key]


def release() -> None:
    """Drop what another operator's tasks left in this worker and give the memory back; workers outlive their operator."""
    if not _kept:
        return
    for thing in _kept.values():
        getattr(thing, "forget", lambda: None)()
    _kept.clear()
    gc.unfreeze()
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def arrow_rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup sorted batches so that rows with the same key are never split between two tables."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], "left")) if k[0] != k[-1] else 0
        if cut:
            yield pa.Table.from_batches([*rest, b.slice(0, cut)])
            rest = [b.slice(cut)]
        elif rest and rest[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(rest)
            rest = [b]
        else:
            rest.append(b)
    if rest:
        yield pa.Table.from_batches(rest)
