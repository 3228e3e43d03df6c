"""Near-duplicate vectors by sorted projection passes.

Each pass draws random hyperplanes. The signs of a vector's projections, most significant first, concatenate to its sort key;
sorting by it brings near vectors close together. Every vector is compared with the ``WINDOW`` vectors after it, and pairs of
cosine ``low`` or more are verified in double precision. Passes are independent; their pairs are united. Equal vectors are
one class throughout, so copies fill no window. The number of passes grows with the number of classes, so that an isolated
pair at cosine ``low`` on a uniform background is met with probability ``RECALL``; as real backgrounds are not uniform, a
sample of vectors is then compared with all others, and while less than ``ENOUGH`` of its links lie inside neighbourhoods,
as many passes again are made with windows twice as long.

A dense group is longer than any window, so what the windows find is completed exactly: the pairs of the passes give
neighbourhoods, and inside a neighbourhood all links are counted. A neighbourhood that lies within half the linking angle of
its centre is linked throughout by the triangle inequality and needs no comparison at all; in others, vectors are compared
block by block inside tasks. No pairs leave the tasks, only counts.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from placewise.operators.graph import components

from .common import saved

PASSES = 14          # at least
RECALL = 0.99
ENOUGH = 0.97
QUERIES = 256        # vectors of the sample that is compared with all others
KEY_BITS = 48
WINDOW = 24
BLOCK = 1024
SLACK = 1e-9          # radians by which the shortcut stays inside the linking angle


def usable(v: str) -> Column:
    """A vector takes part if it is not null, holds no null, NaN or infinite component and is not zero."""
    c = F.col(v)
    ok = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok & F.exists(c, lambda x: x != 0), F.lit(False))


def units(t) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that tiny and huge components keep their precision."""
    x = np.array(t.to_pylist() if hasattr(t, "to_pylist") else list(t), dtype=np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng([977, seed, dim]).normal(size=(dim, KEY_BITS))


def passes_for(n: int, low: float) -> int:
    """Passes that meet an isolated pair at cosine ``low`` among ``n`` vectors with probability ``RECALL``. The pair stays
    together for one more bit with probability 1 - angle / pi, and log2(n / (2 * WINDOW)) + 3/2 bits leave a window (the 3/2 fits simulations
    at 10,000 to 1 million vectors)."""
    together = 1 - float(np.arccos(np.clip(low, -1, 1))) / np.pi
    met = together ** max(0.0, np.log2(max(n, 1) / (2 * WINDOW)) + 1.5)
    return max(PASSES, int(np.ceil(np.log(1 - RECALL) / np.log1p(-met)))) if 0 < met < 1 else PASSES


def _keys(passes: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = units(b.column("v"))
            for k in passes:
                bits = (x @ _planes(k, x.shape[1]) > 0).astype(np.int64)
                key = bits @ (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key), b.column("id"), b.column("v")],
                                                 ["pass", "key", "id", "v"])
    return run


def _windows(low: float, window: int):
    """Sorted runs of one pass: each vector against the next ones. The first and last ``window`` vectors of a task's run are
    handed on as well, because their neighbours may be in the next task's run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            if not b.num_rows:
                continue
            p, ids, x = b.column("pass").to_numpy(), b.column("id").to_numpy(), units(b.column("v"))
            if tail is not None:
                p, ids, x = np.concatenate([tail[0], p]), np.concatenate([tail[1], ids]), np.concatenate([tail[2], x])
            for k in range(1, min(window, len(ids) - 1) + 1):
                same = p[:-k] == p[k:]
                cos = np.einsum("ij,ij->i", x[:-k], x[k:])
                at = np.flatnonzero(same & (cos >= low) & (ids[:-k] != ids[k:]))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[at], ids[at + k])), pa.array(np.minimum(ids[at], ids[at + k]))], ["u", "v"])
            tail = (p[-window:], ids[-window:], x[-window:])
    return run


def pass_pairs(vectors: DataFrame, low: float, passes: range, window: int = WINDOW, rows: int | None = None) -> DataFrame:
    """(u, v): distinct pairs u > v with cosine >= low met in the windows of the sorted passes, over ``vectors`` (id, v)."""
    spark = vectors.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if rows is not None:                             # only neighbouring runs meet, so a run is longer than a window
        n = max(1, min(n, rows * len(passes) // (4 * window)))
    keyed = vectors.mapInArrow(_keys(passes), f"pass int, key long, id long, v {vectors.schema['v'].dataType.simpleString()}")
    order = ["pass", "key", "id"]
    # the runs are written, so that every reader sees the same borders between them
    runs = saved(keyed.repartitionByRange(n, *order).withColumn("run", F.spark_partition_id()), "runs")
    inside = runs.repartition(n, "run").sortWithinPartitions("run", *order).drop("run")
    found = inside.mapInArrow(_windows(low, window), "u long, v long")
    # borders: the last vectors of a run with the first of the next one, as many as a window holds
    edge = _edges(runs, window)
    return saved(found.unionByName(edge.repartition(n, "border").sortWithinPartitions("border", *order).drop("border")
                                   .mapInArrow(_windows(low, window), "u long, v long")).distinct(), "window_pairs")


def _edges(runs: DataFrame, window: int) -> DataFrame:
    from pyspark.sql import Window as W
    first = F.row_number().over(W.partitionBy("run").orderBy("pass", "key", "id"))
    last = F.row_number().over(W.partitionBy("run").orderBy(F.desc("pass"), F.desc("key"), F.desc("id")))
    head = runs.withColumn("r", first).where(F.col("r") <= window).withColumn("border", F.col("run"))
    tail = runs.withColumn("r", last).where(F.col("r") <= window).withColumn("border", F.col("run") + 1)
    return head.unionByName(tail).select("border", "pass", "key", "id", "v")


def _against_all(low: float, ids: list, vecs: list, hoods: list):
    """The sample against all vectors: links (n) and links inside the neighbourhood (hit) of each vector of the sample in a
    batch, and the links that were missed as pairs (u, v)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, q_id, q_hood = units(vecs), np.array(ids, np.int64), np.array(hoods, np.int64)
        for d in batches:
            if len(d):
                y_id = d["id"].to_numpy()
                ok = (q @ units(d["v"]).T >= low) & (q_id[:, None] != y_id[None])
                same = q_hood[:, None] == d["hood"].to_numpy()[None]
                a, b = np.nonzero(ok & ~same)
                u, v = np.maximum(q_id[a], y_id[b]), np.minimum(q_id[a], y_id[b])
                yield pd.DataFrame({"q": q_id[a], "u": u, "v": v, "n": 0, "hit": 0})
                yield pd.DataFrame({"q": q_id, "u": -1, "v": -1, "n": ok.sum(1), "hit": (ok & same).sum(1)})
    return run


def neighbour_pairs(vectors: DataFrame, low: float, passes: int | None = None) -> DataFrame:
    """(u, v): pairs of ``vectors`` (id, v; distinct vectors of one length) whose components hold, on a sample of vectors
    compared with all others, at least ``ENOUGH`` of the links."""
    n = vectors.count()
    step, window = passes or passes_for(n, low), WINDOW
    pairs, done = pass_pairs(vectors, low, range(step), window, n), step
    sample = vectors.withColumn("h", F.xxhash64(F.lit(31), "id")).orderBy("h", "id").limit(QUERIES).select("id", "v").collect()
    while sample:
        label = components(pairs.selectExpr("explode(array(u, v)) AS node").distinct(), pairs, [])
        placed = saved(vectors.select("id").join(label.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("comp", "id").alias("hood")), "placed")
        ids = [r.id for r in sample]
        hood = {r.id: r.hood for r in placed.where(F.col("id").isin(ids)).collect()}
        met = saved(vectors.join(placed, "id").mapInPandas(_against_all(low, ids, [r.v for r in sample], [hood[i] for i in ids]),
                                                           "q long, u long, v long, n long, hit long"), "against_all")
        share = met.groupBy("q").agg((F.sum("hit") / F.sum("n")).alias("share"), F.sum("n").alias("n")).where("n > 0").agg(F.avg("share")).first()[0]
        pairs = pairs.unionByName(met.where("n = 0 AND u > v").select("u", "v"))
        if share is None or share >= ENOUGH or window >= n:
            break
        window *= 2
        pairs, done = saved(pairs.unionByName(pass_pairs(vectors, low, range(done, done + step), window, n)).distinct(), "more_pairs"), done + step
    return pairs


def _angles():
    """Angles to the neighbourhood's centre: the largest one decides whether the shortcut holds."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                cos = np.einsum("ij,ij->i", units(d["vec"]), units(d["centre"]))
                yield pd.DataFrame({"hood": d["hood"], "angle": np.arccos(np.clip(cos, -1, 1))})
    return run


def _count_block(low: float):
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        x, y, ids, others = units(a["vec"]), units(b["vec"]), a["id"].to_numpy(), b["id"].to_numpy()
        hood, hoods, copies = a["hood"].to_numpy(), b["hood"].to_numpy(), b["copies"].to_numpy()
        n = np.zeros(len(ids), np.int64)
        for lo in range(0, len(ids), BLOCK):
            s = slice(lo, lo + BLOCK)
            ok = (x[s] @ y.T >= low) & (hood[s, None] == hoods[None]) & (ids[s, None] != others[None])
            n[s] = ok @ copies
        return pd.DataFrame({"id": ids, "n": n})
    return run


def near_duplicates(vectors: DataFrame, low: float = 0.9, passes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other vectors of cosine >= low), component_id (smallest vec_id
    reachable over links, itself included), kept (vec_id = component_id).

    Vectors that are null, zero or hold null or non-finite components link with nothing; neither do vectors of other lengths
    with each other. Equal vectors are ordinary links (counted per copy), repeated ids are one vector (the first by value takes part), a row
    without id takes part in nothing (component_id null). Other columns are ignored."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    every = saved(rows.where(usable("vec") & F.col("id").isNotNull()).groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    good = saved(every.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    of_class = saved(every.join(good.select("vec", F.col("id").alias("class"), "copies"), "vec").select("id", "class", "copies"), "of_class")
    sizes = [r[0] for r in good.select(F.size("vec").alias("d")).distinct().collect()]          # lengths of vectors, one as a rule
    pairs = None
    for d in sorted(sizes):
        p = neighbour_pairs(good.where(F.size("vec") == d).select("id", F.col("vec").alias("v")), low, passes)
        pairs = p if pairs is None else pairs.unionByName(p)
    if pairs is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    label = saved(components(pairs.selectExpr("explode(array(u, v)) AS node").distinct(), pairs, []), "hoods")
    member = saved(good.join(label.select(F.col("node").alias("id"), F.col("comp").alias("hood")), "id"), "members")
    size = member.groupBy("hood").agg(F.count("*").alias("size"), F.sum("copies").alias("held"))
    # any vector is a valid centre: a member chosen by hash
    centre = (member.withColumn("h", F.xxhash64("id")).groupBy("hood").agg(F.min_by("vec", "h").alias("centre")).join(size, "hood"))
    wide = (member.join(centre, "hood").select("hood", "vec", "centre").mapInPandas(_angles(), "hood long, angle double")
            .groupBy("hood").agg(F.max("angle").alias("angle")))
    shape = saved(size.join(wide, "hood").select("hood", "size", "held", (2 * F.col("angle") <= F.lit(float(np.arccos(low) - SLACK))).alias("all")), "shape")
    placed = saved(member.join(shape, "hood"), "placed")
    whole = placed.where("all").select("id", (F.col("held") - F.col("copies")).alias("n"))
    # other neighbourhoods: small ones share bins, large ones are cut into blocks that all meet each other
    total = shape.where("NOT all").agg(F.sum("size")).first()[0] or 0
    bins = max(1, -(-total // BLOCK))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    few = placed.where("NOT all").select("id", "vec", "hood", "copies", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).alias("block"),
                                         F.when(blocks == 1, -1 - F.pmod(F.xxhash64("hood"), F.lit(bins))).otherwise(F.col("hood")).alias("bin"))
    left = few.select(F.col("bin").alias("bin"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), F.col("block").alias("block"),
                      F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("hood").alias("hood"), F.col("copies").alias("copies"))
    right = few.select(F.col("bin").alias("bin"), F.col("block").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                       F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("hood").alias("hood"), F.col("copies").alias("copies"))
    counted = left.groupBy("bin", "block", "other").cogroup(right.groupBy("bin", "block", "other")).applyInPandas(_count_block(low), "id long, n long")
    links = whole.unionByName(counted).groupBy("id").agg(F.sum("n").alias("n"))
    label = label.select(F.col("node").alias("class"), "comp")
    found = saved(of_class.select("id", "class", (F.col("copies") - 1).alias("equal")).join(links.withColumnRenamed("id", "class"), "class", "left").join(label, "class", "left")
                  .select("id", (F.coalesce("n", F.lit(0)) + F.col("equal")).cast("long").alias("n"), F.coalesce("comp", "class").alias("comp")), "found")
    out = rows.select("id").join(found, "id", "left")
    comp = F.coalesce("comp", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), comp.alias("component_id"),
                      F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))
