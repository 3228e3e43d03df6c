import numpy as np
from pyspark.sql import functions as F

from placewise.operators import archetypes
from placewise.operators import graph as GR, prefs as PF


def test_preferences_reach_the_ridge_optimum(spark):
    rnd = np.random.default_rng(3)
    crit = ("transit", "green", "price")
    rows, xs = [], []
    for _ in range(40):
        a, b = rnd.integers(0, 100, 3), rnd.integers(0, 100, 3)
        choice = "a" if (a - b) @ np.array([2.0, 1.0, -1.0]) + rnd.normal(0, 20) > 0 else "b"
        rows.append((7, {c: float(v) for c, v in zip(crit, a)}, {c: float(v) for c, v in zip(crit, b)}, choice))
        xs.append((a - b) / 100.0 * (1 if choice == "a" else -1))
    df = spark.createDataFrame(rows, "user long, a map<string,double>, b map<string,double>, choice string")
    got = PF.fit_preferences(df, crit).first()
    x, w = np.array(xs), np.array(got.w)
    miss = 1 / (1 + np.exp(x @ w))
    assert np.abs(w - 2 * (miss[:, None] * x).sum(0)).max() < 1e-5      # gradient of the penalised likelihood
    assert got.levels["price"] == 0 and max(got.levels.values()) == 5 and got.confidence > 0.7


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 9), (4, 5), (7, 8), (8, 6), (6, 7)]
    e = spark.createDataFrame([("c", u, v) for a, b in pairs for u, v in ((a, b), (b, a))], "city string, u long, v long")
    n = spark.createDataFrame([("c", i) for i in range(1, 11)], "city string, node long")
    got = {r.node: r.comp for r in GR.components(n, e, ["city"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 10: 10}
    big = GR.largest_component(n, GR.components(n, e, ["city"]), ["city"])
    assert sorted(r.node for r in big.collect()) == [1, 2, 3, 9]


def test_names_of_centroids_follow_the_first_rule_that_holds(spark):
    rows = [("historic_core", {"leisure.food_10min": 7.0, "leisure.culture_walk_min": -1.5}), ("urban_mix", {"leisure.food_10min": 7.0}),
            ("student_buzz", {"education.university_walk_min": -1.1, "leisure.nightlife_10min": 0.6}), ("industrial_edge", {"environment.industrial_ha_1km": 1.1}),
            ("quiet_outskirts", {"health.gp_walk_min": 5.5}), ("estate_blocks", {"family.playgrounds_500m": 0.6, "shops.shops_10min": 0.4}),
            ("green_residential", {"green.green_share_500m": 1.1}), ("urban_mix", {"transit.departures_per_h_500m": 0.4}), ("family_suburb", {})]
    df = spark.createDataFrame(rows, "want string, zm map<string,double>").withColumn("got", archetypes.name_cluster("zm"))
    assert [r.got for r in df.collect()] == [w for w, _ in rows]


def _tables(spark, folder, n):
    """A folder with one table of n rows, written over what was there."""
    spark.range(n).selectExpr("id", "cast(id * id AS double) AS x").write.mode("overwrite").parquet(f"{folder}/part.parquet")


def test_changed_tables_are_computed_anew(spark, tmp_path):
    from placewise.session import data_version, stored
    folder = str(tmp_path / "data")
    _tables(spark, folder, 10)
    first = data_version(spark, folder)
    count = lambda: stored(spark, folder, "sum", lambda: spark.read.parquet(f"{folder}/part.parquet").selectExpr("sum(x) AS s")).first()["s"]
    assert count() == 285.0 and data_version(spark, folder) == first
    _tables(spark, folder, 11)
    assert data_version(spark, folder) != first and count() == 385.0


def test_fingerprint_is_of_the_content(spark):
    from placewise.session import fingerprint
    df = spark.range(1000).selectExpr("id", "id % 7 AS g", "array(id, 1.5D) AS a")
    same = df.orderBy("g", F.desc("id")).repartition(3).select("a", "id", "g")
    assert fingerprint(df) == fingerprint(same)
    assert len({fingerprint(x) for x in (df, df.where("id < 999"), df.union(df.where("id = 5")), df.withColumn("g", F.col("g") + 1), df.limit(0))}) == 5


def test_model_is_trained_again_when_the_content_changes(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler

    from placewise.session import fingerprint
    calls = []

    def use(n):
        df = spark.range(n).select(archetypes.array_to_vector(F.array(F.col("id").cast("double"))).alias("v"), "id")

        def train():
            calls.append(n)
            return Pipeline(stages=[StandardScaler(inputCol="v", outputCol="w")]).fit(df), {"n": n}
        return archetypes.load_or_train(spark, str(tmp_path / "model"), fingerprint(df.select("id")), train)[1:]
    assert [use(n)[1] for n in (20, 20, 21, 21, 20)] == [False, True, False, True, False] and calls == [20, 21, 20]
    assert use(20)[0]["n"] == 20


def test_split_is_stratified(spark):
    df = spark.range(1000).selectExpr("'c' AS city", "id AS cell_id", "CASE WHEN id < 700 THEN 0 WHEN id < 990 THEN 1 ELSE 2 END AS cluster")
    train, held = archetypes.split(df)
    assert {r.cluster: r["count"] for r in held.groupBy("cluster").count().collect()} == {0: 140, 1: 58, 2: 2}
    assert train.count() == 800 and train.join(held, "cell_id").count() == 0


def test_starts_of_clustering_share_their_jobs_and_end_as_single_ones(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(4)
    rows = [("a", i, True, [float(v) for v in rng.normal(0, 1, 3)]) for i in range(700)]
    df = spark.createDataFrame(rows, "city string, cell_id long, habitable boolean, z array<double>").coalesce(2)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    out = archetypes.train_kmeans(df, ks=(6, 7), inits=6).collect()
    ran = jobs() - before
    k = out[0]["k"]
    features, before = df.withColumn("features", array_to_vector("z")), jobs()
    single = [KMeans(k=k, seed=42 + i, maxIter=300).fit(features) for i in range(6)]
    alone = jobs() - before
    best = min(single, key=lambda m: m.summary.trainingCost)
    label = {r["cell_id"]: r["prediction"] for r in best.transform(features).collect()}
    assert len(out) == 700 and all(label[r["cell_id"]] == r["cluster"] for r in out)
    assert all(np.allclose(r["centre"], best.clusterCenters()[r["cluster"]], atol=1e-9) for r in out)
    assert ran < 1.5 * alone                    # twelve starts: one after the other they took twice the jobs of six and more


def test_perceptron_learns_as_sparks_in_one_stage_an_iteration(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(8)
    z = rng.normal(0, 1, (900, 3))
    rows = [([float(v) for v in x], int(x[0] > 0) + int(x[0] * x[1] > 0.3)) for x in z]
    df = spark.createDataFrame(rows, "z array<double>, cluster int").withColumn("features", array_to_vector("z")).repartition(3)
    layers, label = [3, 8, 4, 3], df.withColumn("cluster", F.col("cluster").cast("double"))
    ours = archetypes.perceptron(df, layers, rounds=100)
    theirs = MultilayerPerceptronClassifier(layers=layers, labelCol="cluster", featuresCol="features", maxIter=100, seed=42).fit(label)
    right = lambda m: m.transform(label).agg(F.avg((F.col("prediction") == F.col("cluster")).cast("double"))).first()[0]
    assert right(ours) > 0.95 and right(ours) > right(theirs) - 0.03
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    blocks, jobs = archetypes._blocks(df.select("z", "cluster"), "b"), scheduler.numTotalJobs()
    w = ours.weights.toArray()
    loss, n, grad = (lambda got: (got[0], got[1], got[2:]))(archetypes._total(blocks, archetypes._slopes(layers, w)))
    assert scheduler.numTotalJobs() == jobs + 1 and n == 900
    p = np.array([r.probability.toArray()[int(r.cluster)] for r in ours.transform(label).collect()])
    assert abs(loss + np.log(p).sum()) < 1e-6                      # the weights mean to Spark's model what they mean here
    e = np.zeros(len(w))
    e[7] = 1e-6
    up, down = (archetypes._total(blocks, archetypes._slopes(layers, w + s * e))[0] for s in (1, -1))
    assert abs((up - down) / 2e-6 - grad[7]) < 1e-2


def test_vectors_of_cells_need_no_scores(spark, monkeypatch):
    """The rows are those of ``pooled``, but no table of scores is written for them."""
    from placewise.plans import model_queries as MQ
    d, names, stored = "/root/testdata/sf0.001", [], MQ.stored
    monkeypatch.setattr(MQ, "stored", lambda s, f, name, build: (names.append(name), stored(s, f, name, build))[1])
    with monkeypatch.context() as m:
        m.setattr(MQ, "scores", lambda *a: (_ for _ in ()).throw(AssertionError("scores")))
        got = MQ.vectors(spark, d).collect()
    want = MQ.pooled(spark, d).select("city", "cell_id", "habitable", "z").collect()
    assert sorted(got) == sorted(want) and len(got) == 200 and names == ["pooled-vectors", "pooled"]
