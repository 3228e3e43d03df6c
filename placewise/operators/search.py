"""Accent-insensitive search for a whole table of queries at once."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import fold
from ..session import broadcast_if_small, written
from .ranking import top_per_group

# Score bonus per kind of entry.
KIND_BOOST = {"district": 30.0, "place": 25.0, "poi": 10.0, "address": 0.0}

BOUND = 20_000   # postings of a leaf of the prefix tree
DEPTH = 12       # letters after which the tree is not split further


def entries(labels: DataFrame) -> DataFrame:
    """(entry_id, label, kind, lat, lon) plus the folded label and its distinct tokens; unlabelled rows are dropped."""
    e = labels.withColumn("folded", fold(F.col("label"))).where("folded <> ''")
    return e.withColumn("tokens", F.array_distinct(F.split("folded", " ")))


def postings(index: DataFrame) -> DataFrame:
    """(prefix, entry_id): the first two characters of every token."""
    return (index.select("entry_id", F.explode("tokens").alias("t"))
            .select(F.substring("t", 1, 2).alias("prefix"), "entry_id").distinct())


def prefix_tree(index: DataFrame, bound: int = BOUND) -> DataFrame:
    """(t, n, leaf, ended): every distinct token with the number of its entries and its leaf of the prefix tree.

    A prefix is split by its next letter while more than ``bound`` postings start with it, so a token's leaf is its shortest prefix
    within the bound. A token that ends inside the split part has a leaf of its own (``ended``); the tree stops at ``DEPTH`` letters.
    Counts come from distinct tokens, so no frequent prefix is ever gathered in one task."""
    tokens = index.select(F.explode("tokens").alias("t")).where("t <> ''").groupBy("t").agg(F.count("*").alias("n"))
    steps = tokens.selectExpr("t", "n", f"explode(sequence(1, least(length(t), {DEPTH}))) AS k").selectExpr("t", "n", "k", "substring(t, 1, k) AS p")
    heavy = steps.groupBy("p").agg(F.sum("n").alias("all")).where(F.col("all") > bound).select("p")
    # nodes over the bound: at most DEPTH * postings / bound; the depth reached by a token is how many of them lie on its way
    deep = steps.join(broadcast_if_small(heavy), "p").groupBy("t").agg(F.max("k").alias("d"))
    d = F.coalesce("d", F.lit(0))
    at = F.least(d + 1, F.length("t"), F.lit(DEPTH)).cast("int")
    return (tokens.join(deep, "t", "left").withColumn("leaf", F.substring(F.col("t"), F.lit(1), at))
            .select("t", "n", "leaf", ((d == F.length("t")) & (d < DEPTH)).alias("ended")))


def leaves(tree: DataFrame, bound: int = BOUND) -> DataFrame:
    """(leaf, ended, n, shards): postings of each leaf; a leaf that no further letter can split is cut into shards by entry."""
    return tree.groupBy("leaf", "ended").agg(F.sum("n").alias("n")).withColumn("shards", F.ceil(F.col("n") / bound).cast("int"))


def _postings(index: DataFrame, tree: DataFrame, leaf: DataFrame, bound: int) -> DataFrame:
    """Entries once per token with (leaf, ended, shard). Tokens over the bound are few and met first, so that the join of the
    others has at most ``bound`` rows a key."""
    rows = index.select("entry_id", "folded", "kind", "lat", "lon", "tokens", F.explode("tokens").alias("t")).where("t <> ''")
    hot = broadcast_if_small(tree.where(F.col("n") > bound).select("t", "leaf", "ended"))
    cold = tree.where(F.col("n") <= bound).select("t", "leaf", "ended")
    rows = rows.join(hot, "t").unionByName(rows.join(hot, "t", "left_anti").join(cold, "t"))
    wide = broadcast_if_small(leaf.where("shards > 1").select("leaf", "ended", "shards"))
    return (rows.join(wide, ["leaf", "ended"], "left")
            .withColumn("shard", F.pmod(F.xxhash64("entry_id"), F.coalesce("shards", F.lit(1))).cast("int")).drop("shards", "t"))


def _asked(queries: DataFrame, leaf: DataFrame) -> DataFrame:
    """(query_id, fq, qt, leaf, ended, shard): the leaves in which a query's rarest token can begin a token of an entry.

    Leaves under the query token, or the one leaf that the token passes; a token that meets no leaf rules its query out."""
    nodes = leaf.selectExpr("*", "explode(sequence(1, length(leaf))) AS k").selectExpr("substring(leaf, 1, k) AS node", "k = length(leaf) AS last", "leaf", "ended", "n", "shards")
    parts = queries.select("query_id", F.explode(F.array_distinct("qt")).alias("t")).where("t <> ''")
    steps = parts.selectExpr("*", f"explode(sequence(1, least(length(t), {DEPTH}))) AS k").selectExpr("query_id", "t", "substring(t, 1, k) AS node", "k = length(t) AS whole")
    met = steps.join(nodes, "node").where("whole OR (last AND NOT ended)")
    size = met.groupBy("query_id", "t").agg(F.sum("n").alias("n"))
    rarest = (parts.join(size, ["query_id", "t"], "left").groupBy("query_id")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t")).alias("b")).select("query_id", F.col("b.t").alias("t")))
    where = met.join(rarest, ["query_id", "t"]).selectExpr("query_id", "leaf", "ended", "explode(sequence(0, shards - 1)) AS shard")
    return queries.join(where, "query_id")


def search(queries: DataFrame, index: DataFrame, limit: int = 8, bound: int = BOUND, tree: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, entry_id, score): every query token must start some entry token.

    A query enters the prefix tree by its rarest token and meets the postings of that token's leaves, each at most ``bound`` rows
    (more: cut into shards). Candidates are scored in place; only the best rows per (query, place) and per query leave the map tasks.
    ``tree`` is ``prefix_tree(index, bound)`` where the caller has stored it; like ``index`` it is read more than once."""
    q = queries.withColumn("fq", fold(F.col("q"))).where("fq <> ''").select("query_id", "fq", F.split("fq", " ").alias("qt"))
    tree = written(prefix_tree(index, bound), "prefix-tree") if tree is None else tree
    leaf = leaves(tree, bound)
    hit = _asked(q, leaf).join(_postings(index, tree, leaf, bound), ["leaf", "ended", "shard"]).where(
        F.expr("forall(qt, t -> exists(tokens, e -> startswith(e, t)))"))
    boost = F.create_map(*[F.lit(x) for kv in KIND_BOOST.items() for x in kv])[F.col("kind")]
    text = F.when(F.col("folded") == F.col("fq"), 100.0).when(F.col("folded").startswith(F.col("fq")), 60.0).otherwise(0.0)
    hit = hit.withColumn("score", F.round(boost + text - F.length("folded") * 0.1, 6))
    place = ["query_id", "folded", "kind", F.round("lat", 3).alias("la"), F.round("lon", 3).alias("lo")]
    best = hit.groupBy(*place).agg(F.min(F.struct((-F.col("score")).alias("neg"), "entry_id")).alias("b"))
    best = best.select("query_id", F.col("b.entry_id").alias("entry_id"), (-F.col("b.neg")).alias("score"))
    return top_per_group(best, ["query_id"], [F.desc("score"), F.asc("entry_id")], limit)


def merge(primary: DataFrame, secondary: DataFrame, limit: int, enough: int = 3) -> DataFrame:
    """Secondary results are appended where the primary ones are few, unless the same folded name lies within 0.003 by
    0.0045 degrees of a result already there.  Columns: query_id, rank, folded, lat, lon, label."""
    few = primary.groupBy("query_id").agg(F.count("*").alias("n"))
    s = secondary.join(few, "query_id", "left").where(F.coalesce("n", F.lit(0)) < min(enough, limit)).drop("n")
    near = lambda c, eps: F.abs(F.col(f"s.{c}") - F.col(f"p.{c}")) < eps
    same = (F.col("s.query_id") == F.col("p.query_id")) & (F.col("s.folded") == F.col("p.folded")) & near("lat", 0.003) & near("lon", 0.0045)
    fresh = s.alias("s").join(primary.alias("p"), same, "left_anti")
    both = primary.withColumn("src", F.lit(0)).unionByName(fresh.withColumn("src", F.lit(1)))
    # duplicates among the appended rows: an earlier one with the same name nearby wins
    a, b = both.where("src = 1").alias("s"), both.where("src = 1").alias("p")
    later = a.join(b, same & (F.col("p.rank") < F.col("s.rank")), "left_semi").select("s.query_id", "s.rank")
    both = both.join(later.withColumn("src", F.lit(1)), ["query_id", "rank", "src"], "left_anti")
    return top_per_group(both.withColumnRenamed("rank", "r0"), ["query_id"], [F.asc("src"), F.asc("r0")], limit) \
        .select("query_id", "rank", "src", "label", "folded", "lat", "lon")
