"""Nearest neighbours by largest inner product, with a hierarchical k-means tree searched best bin first.

Vectors get one more component so that all have the same length (the largest one in the table); with it, the largest inner
product is the smallest distance. A k-means tree is fitted on a bounded sample; every vector of the table goes down to a leaf.
A query visits leaves in the order in which a priority queue of nodes yields them, nearest centre first. How many it visits is
calibrated: for a sample of queries the true neighbours are found by brute force over all rows, and visits are widened until
the wanted share of them lies in the visited leaves.

Leaves are packed into shards of bounded size (a large leaf is split over several), queries into blocks; a task compares one
block with one shard and hands on the best k of each query.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from placewise.operators.ranking import top_per_group

from .common import bounded, saved
from .vector_dedup import usable

SAMPLE = 20_000       # vectors the tree is fitted on, about
FANOUT = 8
LEAF = 48             # sample vectors of a leaf, at most, unless they are all equal
ROUNDS = 8
CALIBRATE = 200       # queries the number of visits is calibrated on, about
TARGET = 0.97         # their recall
SHARD = 8192          # vectors of a shard, about
QUERIES = 2048        # queries of a block, about


class Tree:
    """Nodes in arrays: ``centre`` (n x d), ``children`` (first, last + 1; equal for leaves), ``leaf`` (number or -1)."""

    def __init__(self, sample: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centre, self.children, self.leaf, self.leaves = [sample.mean(0)], [(0, 0)], [-1], 0
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop(0)
            parts = self._split(sample[rows], rng) if len(rows) > LEAF else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            first = len(self.centre)
            self.children[node] = (first, first + len(parts))
            for at in parts:
                todo.append((len(self.centre), rows[at]))
                self.centre.append(sample[rows[at]].mean(0))
                self.children.append((0, 0))
                self.leaf.append(-1)
        self.centre = np.array(self.centre)
        self.norm = (self.centre ** 2).sum(1)

    @staticmethod
    def _split(x: np.ndarray, rng) -> list[np.ndarray]:
        x_distinct = np.unique(x, axis=0)
        k = min(FANOUT, len(x_distinct))
        c = x_distinct[rng.choice(len(x_distinct), k, replace=False)]
        for _ in range(ROUNDS):
            own = ((c ** 2).sum(1) - 2 * x @ c.T).argmin(1)
            c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
        own = ((c ** 2).sum(1) - 2 * x @ c.T).argmin(1)
        return [np.flatnonzero(own == i) for i in range(k) if (own == i).any()]

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            a, b = self.children[node]
            if a == b:
                out[rows] = self.leaf[node]
                continue
            near = (self.norm[a:b] - 2 * x[rows] @ self.centre[a:b].T).argmin(1)
            todo += [(a + i, rows[near == i]) for i in range(b - a) if (near == i).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves for a query, best bin first."""
        heap, out = [(0.0, 0)], []
        far = self.norm - 2 * self.centre @ q
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            a, b = self.children[node]
            if a == b:
                out.append(self.leaf[node])
            for c in range(a, b):
                heapq.heappush(heap, (far[c], c))
        return out


def _array(column) -> np.ndarray:
    return np.array(column.to_pylist() if hasattr(column, "to_pylist") else list(column), dtype=np.float64)


def _longer(x: np.ndarray, norm: float, query: bool = False) -> np.ndarray:
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(norm * norm - (x ** 2).sum(1), 0))
    return np.column_stack([x, extra])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id; -inf is none."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    at = at[scores[at] > -np.inf]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("j,ij->i", q, x)


def _brute(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = queries.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, leaf, x = b.column("id").to_numpy(), b.column("leaf").to_numpy(), _array(b.column("vec"))
            out = []
            for i, v in zip(qid, q):
                s = x @ v
                s[ids == i] = -np.inf
                at = _best(s, ids, k)
                out.append((np.full(len(at), i), ids[at], leaf[at], s[at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(4)], ["query", "id", "leaf", "score"])
    return run


def _compare(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if queries.empty or rows.empty:
            return empty
        x, ids = _array(rows["vec"]), rows["id"].to_numpy()
        leaves, column = np.unique(rows["leaf"].to_numpy(), return_inverse=True)
        out = []
        for qid, vec, wanted in zip(queries["query"].tolist(), queries["vec"], queries["leaves"]):
            rough = x @ np.asarray(vec, dtype=np.float64)
            rough[~np.isin(leaves, wanted)[column] | (ids == qid)] = -np.inf
            at = _best(rough, ids, k)
            out.append(pd.DataFrame({"query": qid, "id": ids[at], "score": rough[at]}))
        return pd.concat(out) if out else empty
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for every row of ``vectors`` that ``is_query`` marks, the k rows found with the
    largest inner product in double precision, the query's own id excluded, ties to the smaller id; all rows if fewer than k.

    Null, zero and non-finite vectors and rows without id take no part. Vectors meet only vectors of their own length.
    Repeated ids are one vector (the first by value). Other columns are ignored. Empty tables give no rows."""
    rows = vectors.where(usable(vec_col) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.min(vec_col).alias("vec"), F.max(F.coalesce(is_query, F.lit(False))).alias("query"))
    rows = saved(rows, "vectors")
    out = None
    for d in sorted(r[0] for r in rows.select(F.size("vec").alias("d")).distinct().collect()):
        one = _search(rows.where(F.size("vec") == d), k, target)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = rows.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score")).limit(0)
    best = top_per_group(out, ["query"], [F.desc("score"), F.asc("id")], k)
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _search(rows: DataFrame, k: int, target: float) -> DataFrame:
    spark = rows.sparkSession
    sc = spark.sparkContext
    norm = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0] ** 0.5
    sample = sorted((r.id, r.vec) for r in bounded(rows, "id", SAMPLE).select("id", "vec").collect())       # bounded
    if not sample:
        sample = sorted((r.id, r.vec) for r in rows.select("id", "vec").limit(1).collect())
    tree = Tree(_longer(np.array([v for _, v in sample], dtype=np.float64), norm))
    shared = sc.broadcast((tree, norm))
    vec = rows.schema["vec"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, norm = shared.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), b.column("query"), pa.array(tree.place(_longer(_array(b.column("vec")), norm)))],
                                                 ["id", "vec", "query", "leaf"])
    index = saved(rows.mapInArrow(place, f"id long, vec {vec}, query boolean, leaf int"), "index")
    # calibration: ranks at which the leaves of true neighbours are visited
    some = sorted((r.id, r.vec) for r in bounded(index.where("query"), "id", CALIBRATE, seed=23).select("id", "vec").collect())
    most = tree.leaves
    if some:
        q = (np.array([i for i, _ in some]), np.array([v for _, v in some], dtype=np.float64))
        near = index.select("id", "leaf", "vec").mapInArrow(_brute(sc.broadcast(q), k), "query long, id long, leaf int, score double")
        truth = top_per_group(near, ["query"], [F.desc("score"), F.asc("id")], k).select("query", "leaf").collect()
        order = {i: {leaf: n for n, leaf in enumerate(tree.visits(v, tree.leaves), 1)} for i, v in zip(q[0].tolist(), _longer(q[1], norm, True))}
        at = np.sort([order[t.query][t.leaf] for t in truth])
        most = int(at[min(len(at) - 1, int(np.ceil(target * len(at))))]) if len(at) else tree.leaves
    # shards: leaves in tree order, packed up to SHARD rows; larger leaves are split
    counts = dict(index.groupBy("leaf").agg(F.count("*").alias("n")).collect())                     # a row per leaf of the tree
    shard_of, parts, shard, load = {}, {}, 0, 0
    for leaf in range(tree.leaves):
        n = counts.get(leaf, 0)
        if load and load + n > SHARD:
            shard, load = shard + 1, 0
        parts[leaf] = max(1, -(-n // SHARD))
        shard_of[leaf] = shard
        shard, load = (shard + parts[leaf], 0) if parts[leaf] > 1 else (shard, load + n)
    blocks = max(1, -(-index.where("query").count() // QUERIES))
    plan = sc.broadcast((tree, norm, most, shard_of, parts))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, norm, most, shard_of, parts = plan.value
        for d in batches:
            out = []
            for i, v in zip(d["id"].tolist(), d["vec"]):
                to: dict[int, list[int]] = {}
                for leaf in tree.visits(_longer(np.asarray(v, dtype=np.float64)[None], norm, True)[0], most):
                    for p in range(parts[leaf]):
                        to.setdefault(shard_of[leaf] + p, []).append(leaf)
                out += [(s, i, v, leaves) for s, leaves in to.items()]
            yield pd.DataFrame(out, columns=["shard", "query", "vec", "leaves"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, _, shard_of, parts = plan.value
        for d in batches:
            leaf = d["leaf"].to_numpy()
            yield d.assign(shard=[shard_of[x] + h % parts[x] for x, h in zip(leaf.tolist(), d["h"].tolist())])[["shard", "id", "vec", "leaf"]]

    asked = (index.where("query").select("id", "vec").mapInPandas(route, f"shard int, query long, vec {vec}, leaves array<int>")
             .withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")))
    held = (index.select("id", "vec", "leaf", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h")).mapInPandas(deal, f"shard int, id long, vec {vec}, leaf int")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    return asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInPandas(_compare(k), "query long, id long, score double")
