"""Sharding on a consistent-hash ring with bounded loads, in DataFrame operations only.

Every shard has ``VNODES`` virtual nodes on a ring of 2^32 positions; a row belongs to the next node clockwise of its key's
hash. Loads are bounded by equal shares of the rows (at most one apart): a shard takes the rows of its own arcs first, what it
cannot hold goes on clockwise to the next nodes of shards with room. Positions move only where shards are over or under full.

The walk is solved on counts: one row per arc, so the table has shards x nodes rows whatever the input. Overflow units and
free places are numbered around the ring from the point where the overflow carried on is least; the k-th overflow unit goes to
the k-th place. Rows then only need their rank inside their arc, which is found without bringing an arc into one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from placewise.operators.ranking import global_positions

from .common import saved

VNODES = 64
GRID = 4096           # cells of the ring for looking up the next node
RING = 1 << 32


def position(key: Column) -> Column:
    """Place on the ring: the first 32 bits of the key's md5. A null key has the place of the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int) -> DataFrame:
    """(arc, at, shard): virtual nodes in ring order."""
    nodes = spark.range(shards * VNODES).select(F.floor(F.col("id") / VNODES).cast("int").alias("shard"), position(F.concat(F.lit("node "), F.col("id").cast("string"))).alias("at"))
    nodes = nodes.groupBy("at").agg(F.min("shard").alias("shard"))
    return nodes.select((F.row_number().over(W.orderBy("at")) - 1).alias("arc"), "at", "shard")       # shards x VNODES rows


def _lookup(nodes: DataFrame) -> DataFrame:
    """(cell, nexts): the nodes of each grid cell in order, and after them the first node beyond it."""
    spark = nodes.sparkSession
    width = RING // GRID
    inside = nodes.groupBy((F.col("at") / width).cast("long").alias("cell")).agg(F.array_sort(F.collect_list(F.struct("at", "arc"))).alias("own"))
    cells = spark.range(GRID).withColumnRenamed("id", "cell").join(F.broadcast(inside), "cell", "left")
    after = F.first(F.col("own")[0], ignorenulls=True).over(W.orderBy("cell").rowsBetween(1, W.unboundedFollowing))
    first = F.first(F.col("own")[0], ignorenulls=True).over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    beyond = F.coalesce(after, first)
    return cells.select("cell", F.concat(F.coalesce("own", F.array().cast("array<struct<at:bigint,arc:int>>")),
                                         F.array(F.struct(F.lit(RING).cast("long").alias("at"), beyond["arc"].alias("arc")))).alias("nexts"))


def plan(nodes: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """(arc, lo, hi, shard, base): rows ranked lo..hi-1 of an arc go to the slots of ``shard`` from ``base`` on."""
    zero = F.lit(0).cast("long")
    arcs = nodes.join(counts, "arc", "left").withColumn("n", F.coalesce("n", zero))
    total = F.sum("n").over(W.partitionBy())
    cap = F.floor(total / shards) + (F.col("shard") < F.pmod(total, F.lit(shards))).cast("long")
    own = W.partitionBy("shard").orderBy("arc")
    earlier = own.rowsBetween(W.unboundedPreceding, -1)
    arcs = arcs.withColumn("cap", cap).withColumn("used", F.least("cap", F.coalesce(F.sum("n").over(earlier), zero)))
    arcs = arcs.withColumn("took", F.least(F.col("n"), F.col("cap") - F.col("used")))
    arcs = arcs.withColumn("filled", F.sum("took").over(W.partitionBy("shard"))).withColumn("over", F.col("n") - F.col("took"))
    nodes_of, number = F.count("*").over(W.partitionBy("shard")), F.row_number().over(own) - 1
    room = F.col("cap") - F.col("filled")
    arcs = arcs.withColumn("free", F.floor(room / nodes_of) + (number < F.pmod(room, nodes_of)).cast("long"))
    arcs = arcs.withColumn("free_at", F.col("filled") + F.coalesce(F.sum("free").over(earlier), zero))
    around = arcs.withColumn("net", F.sum(F.col("over") - F.col("free")).over(W.orderBy("arc")))
    start = F.min(F.struct("net", "arc")).over(W.partitionBy())["arc"]
    around = around.withColumn("turn", F.pmod(F.col("arc") - start - 1, F.count("*").over(W.partitionBy())))
    before = W.orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    around = around.withColumn("d", F.coalesce(F.sum("over").over(before), zero)).withColumn("s", F.coalesce(F.sum("free").over(before), zero))
    give = around.where("over > 0").select(F.col("d").alias("k"), F.struct("d", "arc", "took").alias("give"))
    take = around.where("free > 0").select(F.col("s").alias("k"), F.struct("s", "shard", "free_at").alias("take"))
    steps = give.unionByName(take, allowMissingColumns=True).groupBy("k").agg(F.max("give").alias("give"), F.max("take").alias("take"))
    upto = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    steps = steps.select("k", F.last("give", ignorenulls=True).over(upto).alias("give"), F.last("take", ignorenulls=True).over(upto).alias("take"),
                         F.lead("k").over(W.orderBy("k")).alias("next"))
    all_over = arcs.agg(F.sum("over").alias("total"))
    steps = steps.join(F.broadcast(all_over)).withColumn("length", F.coalesce("next", "total") - F.col("k"))     # one row
    lo = F.col("give.took") + F.col("k") - F.col("give.d")
    moved = steps.where("length > 0").select(F.col("give.arc").alias("arc"), lo.alias("lo"), (lo + F.col("length")).alias("hi"), F.col("take.shard").alias("shard"),
                                             (F.col("take.free_at") + F.col("k") - F.col("take.s")).alias("base"))
    return arcs.where("took > 0").select("arc", zero.alias("lo"), F.col("took").alias("hi"), "shard", F.col("used").alias("base")).unionByName(moved)


def assign(rows: DataFrame, shards: int, key: str) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard). Shards differ by one row at most.

    Rows of one key start at one place and spread clockwise from there when they fill a shard, so a key with a third of all
    rows is no hot spot. Null keys are a key of their own; repeated rows get slots of their own; columns named shard or slot
    are replaced and all others pass through (select what is needed first: the rows are written once)."""
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    names = rows.columns
    nodes = saved(ring(spark, shards), "ring")
    width = RING // GRID
    placed = rows.select(F.struct(*names).alias("row"), position(F.col(key)).alias("at"), F.monotonically_increasing_id().alias("u"))
    look = F.broadcast(_lookup(nodes))                                             # GRID rows
    placed = placed.withColumn("cell", (F.col("at") / width).cast("long")).join(look, "cell")
    placed = placed.select("row", "at", "u", F.filter("nexts", lambda x: x["at"] >= F.col("at"))[0]["arc"].alias("arc"))
    # the order inside an arc follows the ring; u only parts rows of one key
    ranked = global_positions(placed, ["arc"], [F.asc("at"), F.asc("u")])
    counts = ranked.groupBy("arc").agg(F.count("*").alias("n"))
    places = (plan(nodes, counts, shards).groupBy("arc").agg(F.collect_list(F.struct("lo", "hi", "shard", "base")).alias("parts")))
    rank = F.col("pos") - 1
    out = ranked.join(F.broadcast(saved(places, "places")), "arc")                 # a row per arc
    part = F.filter("parts", lambda p: (rank >= p["lo"]) & (rank < p["hi"]))[0]
    return out.select("row", rank.alias("r"), part.alias("p")).select("row.*", F.col("p.shard").alias("shard"), (F.col("p.base") + F.col("r") - F.col("p.lo")).alias("slot"))
