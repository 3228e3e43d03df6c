"""Resampling of documents towards a target distribution: hashed n-gram importance weights and a Gumbel-top-k draw.

Every run of 1 to ``n`` consecutive words is a feature and falls into one of ``buckets`` by its crc32. A bucket's gain says
how much more of it the target holds than the corpus; a document's weight is the sum of the gains of its features, read from
one array of ``buckets`` integers. A weight plus Gumbel noise from a hash of the id is the score, and the documents of the
highest scores are the draw.

The draw never sorts the corpus: the scored rows are written once, exact counting jobs over the score column narrow the range
of the score that holds the cutoff, each to a sixteenth, and in the end over the ids of the rows tied at it. Only rows at or
above the cutoff are range-partitioned and numbered.
"""
from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placewise.operators.ranking import global_positions

from .common import saved

# word bytes are digits, A-Z, a-z and all bytes of non-ASCII characters; A-Z are lower-cased, all others part words
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
SPLITS = 16             # parts into which one counting job cuts the range of the cutoff
COUNT_BYTES = 1 << 22   # counts of a task are held in memory, one per bucket; words of a text are counted in pieces of this size


def words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; none for null."""
    return (text or "").encode().translate(_WORDS).split()


def features(found: list[bytes], n: int) -> Iterator[bytes]:
    yield from found
    for k in range(2, n + 1):
        yield from (b" ".join(run) for run in zip(*(found[i:] for i in range(k))))


def bucket_counts(docs: DataFrame, buckets: int, n: int = 1) -> np.ndarray:
    """Features per bucket over all texts: every task folds its own to at most ``buckets`` sums before the shuffle."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            seen: Counter = Counter()
            for text in b.column(0):
                seen.update(features(words(text.as_py()), n))
                if len(seen) > COUNT_BYTES // 64:
                    _add(total, seen)
                    seen.clear()
            _add(total, seen)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})
    sums = docs.select("text").mapInArrow(fold, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def _add(total: np.ndarray, seen: Counter) -> None:
    if seen:
        at = np.fromiter(map(crc32, seen.keys()), np.int64, len(seen)) % len(total)
        total += np.bincount(at, np.fromiter(seen.values(), np.int64, len(seen)), len(total)).astype(np.int64)


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the smoothed frequency ratio) per bucket."""
    k, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log(float((t + 1) * (all_s + k)) / float((s + 1) * (all_t + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int, scale: int = 1000) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, n: int = 1, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, n_words, u) of every row; u numbers the rows."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for doc_id, text in zip(ids, b.column(1)):
                found = words(text.as_py())
                at = np.fromiter(map(crc32, features(found, n)), np.int64)
                weight = int(gain[at % buckets].sum())
                out.append((len(at), weight, weight + gumbel(doc_id, seed), len(found)))
            cols = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4
            yield pa.record_batch([pa.array(ids, pa.int64()), *cols, b.column(2)], names=["doc_id", "n_features", "weight", "score", "n_words", "u"])
    return (docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("u"))
            .mapInArrow(weigh, "doc_id long, n_features long, weight long, score long, n_words long, u long"))


def smallest_reaching(rows: DataFrame, value: str, low: int, high: int, k: int) -> tuple[int, int]:
    """The smallest x in [low, high] with at least ``k`` rows where value <= x, and how many rows lie below it.

    A numeric bisection, four halvings a job: each job counts the rows under 15 inner thresholds, exactly."""
    below = 0
    while low < high:
        marks = sorted({low + (high - low) * i // SPLITS for i in range(SPLITS)} - {high})
        found = rows.agg(*[F.count(F.when(F.col(value) <= m, 1)) for m in marks]).first()
        upto = next((i for i, n in enumerate(found) if n >= k), len(marks))
        if upto:
            below, low = found[upto - 1], marks[upto - 1] + 1
        if upto < len(marks):
            high = marks[upto]
    return low, below


def draw(scored: DataFrame, k: int) -> DataFrame:
    """``scored`` (a written table with doc_id, score, u and others) with ``rank`` 1..k for the ``k`` highest scores.

    Ties go to the smaller doc_id, null ids last; rows equal in both are numbered in the order they were read. Others have null."""
    if k <= 0:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    keyed = scored.select((-F.col("score")).alias("fall"), "doc_id")
    ends = keyed.agg(F.min("fall"), F.max("fall"), F.count("*")).first()
    if ends[2] == 0:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cut, better = smallest_reaching(keyed, "fall", ends[0], ends[1], k)
    tied = keyed.where((F.col("fall") == cut) & F.col("doc_id").isNotNull())
    ids = tied.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    chosen = -F.col("score") < cut
    at = -F.col("score") == cut
    if ids[2] >= k - better:        # the ids decide; else all tied rows with an id are in, and those without fill up
        last, _ = smallest_reaching(tied, "doc_id", ids[0], ids[1], k - better)
        chosen = chosen | (at & F.coalesce(F.col("doc_id") <= last, F.lit(False)))
    else:
        chosen = chosen | at
    some = global_positions(scored.where(chosen), [], [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("u")], "rank")
    some = some.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")).cast("long"))
    return some.unionByName(scored.where(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, n: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    ``percent`` of the documents with at least ``least_words`` words are drawn, rounded down. Null and empty texts have no
    features, weight 0, and are never drawn while least_words > 0. A null doc_id hashes as an empty string and ranks last among
    ties. Repeated rows are scored and drawn one by one. Other columns are ignored; an empty table gives an empty result, an
    empty target gains that favour buckets rare in the corpus."""
    gain = gains(bucket_counts(docs, buckets, n), bucket_counts(target, buckets, n))
    scored = saved(weighed(docs, gain, n, seed), "weights")
    fit = F.col("n_words") >= least_words
    able = scored.where(fit)
    out = draw(able, able.count() * percent // 100).unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# crc32 is taken per distinct word from its UTF-8 bytes by the byte table, which a recursive query builds
ORACLE = r"""
WITH RECURSIVE shift(i, k, v) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM shift WHERE k < 8),
lut AS (SELECT list(v ORDER BY i) AS l FROM shift WHERE k = 8),
low AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
blow AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
c AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM low) GROUP BY word),
bc AS (SELECT word, count(*) AS n FROM blow GROUP BY word),
vocab AS (SELECT word FROM c UNION SELECT word FROM bc),
hexed AS (SELECT word, hex(encode(word)) AS h FROM vocab),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS b FROM hexed, lut),
s AS (SELECT b, sum(n)::BIGINT AS s FROM c JOIN crc USING (word) GROUP BY b),
t AS (SELECT b, sum(n)::BIGINT AS t FROM bc JOIN crc USING (word) GROUP BY b),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::BIGINT AS ss, (SELECT coalesce(sum(t), 0) FROM t)::BIGINT AS tt),
g AS (SELECT r.b, floor(1000 * ln(((coalesce(t, 0) + 1) * (ss + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (tt + 10000))::DOUBLE))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN s ON s.b = r.b LEFT JOIN t ON t.b = r.b, tot),
wg AS (SELECT word, gain FROM crc JOIN g USING (b)),
f AS (SELECT doc_id, count(*)::BIGINT AS n, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(ws) AS word FROM low) JOIN wg USING (word) GROUP BY doc_id),
d AS (SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || sha256('2024:' || documents.doc_id)[1:8])::BIGINT AS h FROM documents LEFT JOIN f ON f.doc_id = documents.doc_id),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
k AS (SELECT (10 * count(*)) // 100 AS k FROM e WHERE n_features >= 20),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM e WHERE n_features >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN pos <= (SELECT k FROM k) THEN pos END::BIGINT AS rank FROM e LEFT JOIN r USING (doc_id)
"""
