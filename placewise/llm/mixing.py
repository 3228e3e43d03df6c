"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source gets a target from its weight, at most ``most`` times its own size; what a source cannot take goes to the others
by weight until none is above its limit. Within a source each document is expected target / size times. Documents are ordered
by size, their expected copies are summed up from one random offset, and a document is taken once for each integer the sum
passes. Copies of a document so differ by one at most from their expectation, and as neighbours in the order have like sizes,
the words taken miss the target by about one large document only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from placewise.operators.ranking import global_positions

from .common import saved

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``. Sources in code point order, null last, take the weights in turn."""
    order = W.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("ratio", F.col("source_size") / F.col("w"))
    # sources reach their limit in the order of size over weight; the level is what the others get per unit of weight
    by = W.orderBy("ratio", F.asc_nulls_last("source"))
    s = s.withColumn("size_before", F.coalesce(F.sum("source_size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("w_left", F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)))
    level = (F.lit(share) * F.sum("source_size").over(W.partitionBy()) - F.lit(most) * F.col("size_before")) / F.col("w_left")
    s = s.withColumn("level", level).withColumn("limit", F.lit(most) * F.col("source_size"))
    fits = F.col("level") * F.col("w") < F.col("limit")
    reached = F.min(F.when(fits, F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(W.partitionBy())["level"]
    return s.select("source", "source_size", F.coalesce(F.least(F.col("limit"), reached * F.col("w")), F.col("limit")).alias("target"))


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, seed: int = 42, key: str = "doc_id", row: str | None = None) -> DataFrame:
    """(key, source, size, source_size, target, copies) for every row of ``docs`` (key, text, source): how often it is taken.

    Null texts have size 0. Null sources are one source. A source without words has target 0 and is not taken. Rows with one
    size are ordered by a hash of their key and by the key; repeated rows are taken independently. ``row`` names a column of unique numbers
    to be handed on, by which rows are known again where keys repeat or are null. Other columns are ignored."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(F.col(key).alias("key"), "source", word_count("text").alias("size"), number.alias("u"))
    h = F.coalesce(_hash(F.col("key").cast("string")), F.lit(0).cast("long"))
    rows = saved(rows.withColumn("h", h).withColumn("src", F.coalesce("source", F.lit("")))
                 .withColumn("none", F.col("source").isNull()), "sizes")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = goal.withColumn("src", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()).drop("source")
    ranked = global_positions(rows, ["none", "src"], [F.asc("size"), F.asc("h"), F.asc_nulls_first("key"), F.asc("u")])
    out = ranked.join(goal, ["none", "src"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _hash(F.concat(F.lit(f"{seed} "), F.col("src"))) / F.lit(4294967296.0)
    upto = lambda n: F.floor(start + n * rate)
    return out.select(F.col("key").alias(key), *([F.col("u").alias(row)] if row else []), "source", "size", "source_size", "target", (upto(F.col("pos")) - upto(F.col("pos") - 1)).cast("long").alias("copies"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
s AS (SELECT *, source_size / w AS ratio,
  coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
  sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
  sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * size_before::DOUBLE) / w_left::DOUBLE AS level, 2.0::DOUBLE * source_size AS top FROM s),
f AS (SELECT level AS reached FROM l WHERE level * w < top ORDER BY ratio, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, coalesce(least(top, (SELECT reached FROM f) * w), top) AS target FROM l),
r AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, coalesce(('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT, 0), doc_id NULLS FIRST) AS pos,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, ('0x' || md5('42 ' || coalesce(d.source, ''))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, ((floor(u + pos * rate) - floor(u + (pos - 1) * rate))::BIGINT * size)::BIGINT AS taken FROM r
"""
