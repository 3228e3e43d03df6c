"""Archetypes: clustering, naming rules, soft membership, model reuse."""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import written
from .ranking import global_positions

SILHOUETTE_TOLERANCE = 0.005
# The indicators whose mean z-score a rule looks at, and the rules in order; the first one that holds names the cluster.
TRAITS = {
    "dense": ("leisure.food_10min", "leisure.nightlife_10min", "shops.shops_10min"),
    "remote": ("health.gp_walk_min", "health.pharmacy_walk_min", "shops.supermarket_walk_min", "education.primary_school_walk_min",
               "health.dentist_walk_min"),
    "greenery": ("green.green_share_500m", "green.forest_meadow_ha_1km"),
    "culture": ("leisure.culture_walk_min",),
    "university": ("education.university_walk_min",),
    "nightlife": ("leisure.nightlife_10min",),
    "industry": ("environment.industrial_ha_1km",),
    "playgrounds": ("family.playgrounds_500m",),
    "shops": ("shops.shops_10min",),
    "transit": ("transit.departures_per_h_500m",),
}
NAMING = (
    ("historic_core", (("dense", ">", 2.0), ("culture", "<", -1.0))),
    ("urban_mix", (("dense", ">", 0.8),)),
    ("student_buzz", (("university", "<", -1.0), ("nightlife", ">", 0.5))),
    ("industrial_edge", (("industry", ">", 1.0),)),
    ("quiet_outskirts", (("remote", ">", 1.0),)),
    ("estate_blocks", (("playgrounds", ">", 0.5), ("shops", ">", 0.3))),
    ("green_residential", (("greenery", ">", 0.5),)),
    ("urban_mix", (("transit", ">", 0.3),)),
)
OTHERWISE = "family_suburb"


def name_cluster(z: str) -> Column:
    """Archetype of a centroid given as a map column indicator -> z-score; an indicator it lacks counts as 0."""
    def holds(trait: str, sign: str, threshold: float) -> Column:
        scores = [F.coalesce(F.col(z)[F.lit(i)], F.lit(0.0)) for i in TRAITS[trait]]
        mean = reduce(Column.__add__, scores) / len(scores)
        return mean > threshold if sign == ">" else mean < threshold

    named = [F.when(reduce(Column.__and__, (holds(*test) for test in tests)), F.lit(name)) for name, tests in NAMING]
    return F.coalesce(*named, F.lit(OTHERWISE))


BLOCK = 256         # rows whose distances to the centres of all starts are in memory at once
FEW = 4096          # rows that are not worth a task of their own


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``z`` (and ``cluster``, where there is one) of a batch as one row: numbers with a 1 after each vector, the sum of their squares."""
    for b in batches:
        if b.num_rows:
            x = np.ones((b.num_rows, len(b.column("z").flatten()) // b.num_rows + 1))
            x[:, :-1] = np.asarray(b.column("z").flatten(), "<f8").reshape(b.num_rows, -1)
            label = np.asarray(b.column("cluster"), "<i4").tobytes() if "cluster" in b.schema.names else None
            yield pa.record_batch([pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([b.num_rows], pa.int64()), pa.array([float((x[:, :-1] ** 2).sum())]),
                                   pa.array([label], pa.binary())], names=["block", "n", "q", "label"])


def _blocks(df: DataFrame, name: str) -> RDD:
    """Vectors packed, written and dealt evenly over the cores, for iterations that read them again and again, each as one stage without
    a plan. Executors keep them as Python left them, in memory or on disk; what is lost is read again."""
    n, rows = df.sparkSession.sparkContext.defaultParallelism, df.count()
    n = n * -(-df.rdd.getNumPartitions() // n) if rows > n * FEW else max(1, -(-rows // FEW))
    return written(df.repartition(n).mapInArrow(_pack, "block binary, n long, q double, label binary"), name).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def _total(blocks: RDD, part: Callable[[Iterator[tuple]], Iterator[np.ndarray]]) -> np.ndarray:
    """Sum of the arrays that ``part`` makes of the blocks, one a task."""
    return reduce(np.add, blocks.mapPartitions(part).collect())


def _rows(packed: Iterator[tuple]) -> Iterator[tuple[np.ndarray, float, np.ndarray | None]]:
    for block, n, q, label in packed:
        yield np.frombuffer(block, "<f8").reshape(n, -1), q, None if label is None else np.frombuffer(label, "<i4")


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows ``x`` with a 1 behind and ``centres`` (start, cluster, dimension + 1) as ``_sided`` gives them: whether a centre is
    the start's nearest one (of equal ones the first), and its squared distance less the row's own square."""
    starts, k, d = centres.shape
    gap = (centres.reshape(-1, d) @ x.T).reshape(starts, k, len(x))
    least = gap.min(1)
    hit = gap == least[:, None, :]
    if np.count_nonzero(hit) != starts * len(x):
        hit = gap.argmin(1)[:, None, :] == np.arange(k)[None, :, None]
    return hit, least


def _sided(centres: Sequence[np.ndarray]) -> np.ndarray:
    """-2 times the centres and their squares behind, so that a product with a row gives their distance; absent centres are infinitely far."""
    out = np.zeros((len(centres), max(len(c) for c in centres), centres[0].shape[1] + 1))
    out[:, :, -1] = np.inf
    for i, c in enumerate(centres):
        out[i, :len(c), :-1], out[i, :len(c), -1] = -2 * c, (c ** 2).sum(1)
    return out


def _sums(centres: np.ndarray):
    """One task's part of a round of all starts: each cluster's sums and rows (last column), then the costs."""
    def run(packed: Iterator[tuple]) -> Iterator[np.ndarray]:
        starts, k, d = centres.shape
        total, cost = np.zeros((starts * k, d)), np.zeros(starts)
        for rows, q, _ in _rows(packed):
            cost += q
            for lo in range(0, len(rows), BLOCK):
                x = rows[lo:lo + BLOCK]
                hit, least = _nearest(x, centres)
                total += hit.reshape(starts * k, len(x)).astype(np.float64) @ x
                cost += least.sum(1)
        yield np.concatenate([total.ravel(), cost])
    return run


def lloyd(vectors: DataFrame, first: Sequence[np.ndarray], rounds: int = 300, tol: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Centres and cost of each start after Lloyd's rounds, as ``KMeans`` does them: until no centre moves by more than ``tol``;
    a centre without rows stays. All starts take their round in one job of one stage, which reads the ``vectors`` (z) once; the
    driver gets the sums of each task."""
    blocks = _blocks(vectors.select("z"), "blocks")
    at = {i: c.copy() for i, c in enumerate(first)}
    cost, moving = dict.fromkeys(at, 0.0), list(at)
    for _ in range(rounds):
        centres = _sided([at[s] for s in moving])
        got = _total(blocks, _sums(centres))
        total = got[:-len(moving)].reshape(centres.shape)
        still = []
        for i, s in enumerate(moving):
            cost[s] = float(got[i - len(moving)])
            sums, n = total[i, :len(at[s]), :-1], total[i, :len(at[s]), -1:]
            to = np.where(n > 0, sums / np.maximum(n, 1), at[s])
            if ((to - at[s]) ** 2).sum(1).max() > tol * tol:
                still.append(s)
            at[s] = to
        moving = still
        if not moving:
            break
    blocks.unpersist()
    return [(at[i], cost[i]) for i in range(len(first))]


def _labels(centres: dict[int, np.ndarray]):
    """Adds the nearest centre for each number of clusters, as ``label<k>``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.ones((b.num_rows, next(iter(centres.values())).shape[1] + 1))
                x[:, :-1] = np.asarray(b.column("z").flatten(), "<f8").reshape(b.num_rows, -1)
                got = [pa.array(_nearest(x, _sided([c]))[0][0].argmax(0).astype(np.int32)) for c in centres.values()]
                yield pa.RecordBatch.from_arrays([*b.columns, *got], [*b.schema.names, *[f"label{k}" for k in centres]])
    return run


def train_kmeans(pooled: DataFrame, ks: Sequence[int] = (6, 7, 8), inits: int = 10, at_once: int = 4) -> DataFrame:
    """Cluster the habitable cells for each k (best of ten starts by training cost), keep the largest k whose silhouette is within
    the tolerance of the best. Returns (city, cell_id, z, cluster, centre, k, silhouette): labels, centres and choice of one
    training in one table. The first centres of each start are independent jobs of ``KMeans``, a few at a time; all starts then
    move their centres together."""
    data = written(pooled.where("habitable").select("city", "cell_id", "z"), "vectors")
    features = data.select(array_to_vector("z").alias("features")).persist()        # one copy for all starts, which else keep one each
    tries = [(k, i) for k in ks for i in range(inits)]
    with ThreadPoolExecutor(at_once) as pool:
        first = list(pool.map(lambda t: np.array(KMeans(k=t[0], seed=42 + t[1], maxIter=0).fit(features).clusterCenters()), tries))
    features.unpersist()
    ends = lloyd(data, first)
    fits = {k: min((e for t, e in zip(tries, ends) if t[0] == k), key=lambda e: e[1])[0] for k in ks}
    named = written(data.mapInArrow(_labels(fits), T.StructType([*data.schema.fields, *[T.StructField(f"label{k}", T.IntegerType()) for k in ks]])), "labels")
    judged = named.withColumn("features", array_to_vector("z"))
    sil = {k: round(ClusteringEvaluator(predictionCol=f"label{k}").evaluate(judged), 4) for k in ks}       # all rows, through sums per cluster
    k = max(x for x, v in sil.items() if v >= max(sil.values()) - SILHOUETTE_TOLERANCE)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in fits[k]])             # k rows of numbers
    return judged.select("city", "cell_id", "z", F.col(f"label{k}").alias("cluster"), centres[F.col(f"label{k}")].alias("centre"),
                         F.lit(k).alias("k"), F.lit(sil[k]).alias("silhouette"))


def split(labelled: DataFrame, test_every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Stratified 80/20 split: in the order of a hash every fifth cell of each cluster is held out."""
    placed = global_positions(labelled.withColumn("__h", F.xxhash64("city", "cell_id", F.lit(42))), ["cluster"], [F.asc("__h"), F.asc("city"), F.asc("cell_id")], "__pos").drop("__h")
    held = F.col("__pos") % test_every == 0
    return placed.where(~held).drop("__pos"), placed.where(held).drop("__pos")


def _slopes(layers: Sequence[int], w: np.ndarray):
    """One task's part of loss, rows and gradient of a perceptron with sigmoid layers and softmax at the end."""
    def run(packed: Iterator[tuple]) -> Iterator[np.ndarray]:
        ws, total, loss, number = _layered(layers, w), np.zeros(len(w)), 0.0, 0
        grads = _layered(layers, total)
        for rows, _, label in _rows(packed):
            for lo in range(0, len(rows), 4 * BLOCK):
                h, y = [rows[lo:lo + 4 * BLOCK]], label[lo:lo + 4 * BLOCK]
                for m in ws[:-1]:
                    out = np.ones((len(y), m.shape[1] + 1))
                    out[:, :-1] = 1 / (1 + np.exp(-np.clip(h[-1] @ m, -700, 700)))
                    h.append(out)
                z = h[-1] @ ws[-1]
                z -= z.max(1, keepdims=True)
                delta = np.exp(z)
                every = delta.sum(1, keepdims=True)
                each = np.arange(len(y))
                loss, number = loss + float(np.log(every).sum() - z[each, y].sum()), number + len(y)
                delta /= every
                delta[each, y] -= 1
                for i in range(len(ws) - 1, -1, -1):
                    grads[i] += h[i].T @ delta
                    if i:
                        own = h[i][:, :-1]
                        delta = (delta @ ws[i][:-1].T) * own * (1 - own)
        yield np.concatenate([[loss, number], total])
    return run


def _layered(layers: Sequence[int], w: np.ndarray) -> list[np.ndarray]:
    """Views of each layer's weights as (inputs and the constant, outputs), in the order that Spark keeps them."""
    out, at = [], 0
    for n, m in zip(layers, layers[1:]):
        out.append(w[at:at + (n + 1) * m].reshape(n + 1, m))
        at += (n + 1) * m
    return out


def _line(value: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, f: float, g: np.ndarray, go: np.ndarray, step: float):
    """A point along ``go`` that lowers the value enough and where its slope has flattened (strong Wolfe conditions): (point, value, gradient);
    None where 20 steps find no lower one."""
    slope, low, high, best = float(g @ go), 0.0, np.inf, None
    for _ in range(20):
        to = w + step * go
        f1, g1 = value(to)
        if not np.isfinite(f1) or f1 > f + 1e-4 * step * slope:
            high = step
        else:
            if best is None or f1 < best[1]:
                best = to, f1, g1
            along = float(g1 @ go)
            if abs(along) <= 0.9 * abs(slope):
                return to, f1, g1
            low, high = (step, high) if along < 0 else (low, step)
        step = (low + high) / 2 if np.isfinite(high) else 2 * step
    return best


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int, tol: float, memory: int = 10) -> np.ndarray:
    """L-BFGS with the memory and the ends of Spark's: ``rounds`` iterations, a value as far under the largest of the last twenty as
    ``tol`` of the first one, or a gradient as small as ``tol`` of the value."""
    f, g = value(w)
    first, seen, steps = abs(f), [f], []
    for _ in range(rounds):
        go, weights = -g, []
        for s, y in reversed(steps):
            weights.append(float(s @ go) / float(s @ y))
            go = go - weights[-1] * y
        if steps:
            s, y = steps[-1]
            go = go * (float(s @ y) / float(y @ y))
        for (s, y), a in zip(steps, reversed(weights)):
            go = go + s * (a - float(y @ go) / float(s @ y))
        if float(go @ g) >= 0:
            go, steps = -g, []
        found = _line(value, w, f, g, go, 1.0 if steps else 1 / max(float(np.linalg.norm(go)), 1e-12))
        if found is None:
            if not steps:
                break
            steps = []                                                   # once more along the gradient
            continue
        to, f1, g1 = found
        if float((to - w) @ (g1 - g)) > 0:
            steps = [*steps, (to - w, g1 - g)][-memory:]
        w, f, g = to, f1, g1
        done = len(seen) >= 2 and abs(f - max(seen)) <= tol * first
        seen = [*seen, f][-20:]
        if done or np.linalg.norm(g) <= max(tol * f, 1e-8):
            break
    return w


def perceptron(train: DataFrame, layers: Sequence[int], rounds: int = 600, tol: float = 1e-6, seed: int = 42):
    """Spark's multilayer perceptron for the rows (z, cluster), from its own first weights; an iteration reads the packed rows in one
    job of one stage and multiplies them block by block."""
    blocks = _blocks(train.select("z", F.col("cluster").cast("int").alias("cluster")), "learned")
    one = train.sparkSession.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], ["features", "cluster"])
    bare = MultilayerPerceptronClassifier(layers=list(layers), labelCol="cluster", featuresCol="features", maxIter=0, seed=seed)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        got = _total(blocks, _slopes(layers, w))
        return got[0] / got[1], got[2:] / got[1]
    w = minimise(value, bare.fit(one).weights.toArray(), rounds, tol)
    blocks.unpersist()
    return bare.copy({bare.initialWeights: Vectors.dense(w)}).fit(one)


def train_membership(labelled: DataFrame, d: int, k: int) -> tuple[PipelineModel, float]:
    """Multilayer perceptron (32, 16) from vector to cluster; returns the model and its held-out accuracy."""
    tr, te = split(labelled)
    model = PipelineModel([perceptron(tr, [d, 32, 16, k])])
    scored = model.transform(te.withColumn("cluster", F.col("cluster").cast("double")))
    return model, float(scored.agg(F.avg((F.col("prediction") == F.col("cluster")).cast("double"))).first()[0])


def memberships(model: PipelineModel, pooled: DataFrame) -> DataFrame:
    """Cells with ``proba``: probability per cluster."""
    df = pooled.withColumn("features", array_to_vector("z"))
    return model.transform(df).withColumn("proba", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def merge_probabilities(df: DataFrame, cluster_ids: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``probs``: map archetype -> summed probability of its clusters (ids in order of first appearance)."""
    ids = list(dict.fromkeys(cluster_ids))
    arms = [x for a in ids for x in (F.lit(a), sum((F.col("proba")[i] for i, c in enumerate(cluster_ids) if c == a), F.lit(0.0)))]
    return df.select(*keys, F.create_map(*arms).alias("probs"))


def group_archetype(df: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """Weighted mean probability per archetype, the most likely one, and those of at least half a percent."""
    long = df.select(*keys, weight.alias("__w"), F.explode("probs").alias("archetype", "p"))
    mean = long.groupBy(*keys, "archetype").agg((F.sum(F.col("p") * F.col("__w")) / F.sum("__w")).alias("p"))
    top = F.min_by("archetype", F.struct(-F.round("p", 9), F.col("archetype")))
    return mean.groupBy(*keys).agg(top.alias("archetype"), F.round(F.max("p"), 3).alias("p"), F.map_from_entries(F.array_sort(F.collect_list(
        F.when(F.col("p") >= 0.005, F.struct("archetype", F.round("p", 3).alias("p")))))).alias("probs"))


def share_by_city(df: DataFrame, label: str) -> DataFrame:
    """Share of each archetype among a city's cells."""
    n = df.groupBy("city", label).agg(F.count("*").alias("n"))
    return n.join(n.groupBy("city").agg(F.sum("n").alias("all")), "city").select("city", label, F.round(F.col("n") / F.col("all"), 3).alias("share"))


def load_or_train(spark: SparkSession, root: str, version: str, train: Callable[[], tuple[PipelineModel, dict]]) -> tuple[PipelineModel, dict, bool]:
    """Reuse the stored model when it was trained on this content (``session.fingerprint``), else train and store it.
    Returns (model, metrics, reused)."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/metrics/_SUCCESS")        # written last
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        metrics = json.loads(spark.read.schema("value string").text(f"{root}/metrics").first()[0])
        if metrics.get("dataVersion") == version:
            return PipelineModel.load(f"{root}/model"), metrics, True
    model, metrics = train()
    metrics = {**metrics, "dataVersion": version}
    model.write().overwrite().save(f"{root}/model")
    spark.createDataFrame([(json.dumps(metrics),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/metrics")
    return model, metrics, False


