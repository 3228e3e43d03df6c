import random

from pyspark.sql import functions as F

from placewise.operators import search as SE


def brute(queries, entries, limit):
    out = set()
    for qid, text in queries:
        want = text.lower().split(" ")
        hits = {}
        for eid, label, kind, lat, lon in entries:
            folded = label.lower()
            if not all(any(e.startswith(t) for e in folded.split(" ")) for t in want):
                continue
            score = SE.KIND_BOOST[kind] + (100 if folded == text.lower() else 60 if folded.startswith(text.lower()) else 0) - len(folded) * 0.1
            key, row = (folded, kind, round(lat, 3), round(lon, 3)), (-round(score, 6), eid)
            hits[key] = min(hits.get(key, row), row)
        out |= {(qid, i + 1, e) for i, (_, e) in enumerate(sorted(hits.values())[:limit])}
    return out


def test_tree_equals_brute_force_at_any_bound(spark):
    rnd = random.Random(3)
    words = ["brand", "brand1", "brand12", "b", "br", "oak", "oakwood", "averyveryverylongtoken", "averyveryverylongtower"]
    entries = [(f"e{i:04d}", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))), rnd.choice(list(SE.KIND_BOOST)), rnd.randint(0, 9) / 10, 1.0) for i in range(400)]
    asks = list(enumerate(["b", "br", "brand", "brand1", "brand12 oak", "oak b", "oakw", "x", "oak x", "averyveryverylongto", "averyveryverylongtow", "averyv", "brand brand"]))
    index = SE.entries(spark.createDataFrame(entries, "entry_id string, label string, kind string, lat double, lon double"))
    q = spark.createDataFrame(asks, "query_id long, q string")
    want = brute(asks, entries, 8)
    for bound in (3, 40, 20_000):
        got = {(r.query_id, r.rank, r.entry_id) for r in SE.search(q, index, 8, bound).collect()}
        assert got == want, bound


def test_no_leaf_passes_the_bound(spark):
    # a token in every entry, and 20,000 that start with the same letters
    rows = spark.range(20_000).select(F.concat(F.lit("e"), "id").alias("entry_id"), F.concat(F.lit("shop brand#"), "id").alias("label"), F.lit("poi").alias("kind"),
                                      (F.col("id") / 100).alias("lat"), F.lit(1.0).alias("lon"))
    index = SE.entries(rows)
    tree = SE.prefix_tree(index, 500)
    leaf = SE.leaves(tree, 500)
    post = SE._postings(index, tree, leaf, 500)
    per = {(r.leaf, r.shard): r.n for r in post.groupBy("leaf", "ended", "shard").agg(F.count("*").alias("n")).collect()}
    assert sum(per.values()) == 40_000
    assert max(n for (_, s), n in per.items()) < 1000                       # shards by hash: about the bound
    assert leaf.where("shards > 1").count() == 1                            # 'shop' alone cannot be split
    q = spark.createDataFrame([(1, "shop brand#12345"), (2, "brand#777 shop")], "query_id long, q string")
    asked = SE._asked(q.select("query_id", F.col("q").alias("fq"), F.split("q", " ").alias("qt")), leaf)
    assert {r.leaf for r in asked.collect()} == {"brand#123", "brand#77"}    # the rarer token's leaf, not 'shop'
    assert [(r.query_id, r.entry_id) for r in SE.search(q, index, 1, 500).orderBy("query_id").collect()] == [(1, "e12345"), (2, "e777")]
