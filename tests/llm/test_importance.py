"""Importance resampling against a plain Python version."""
import hashlib
import math
import re
from zlib import crc32

from placewise.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, n):
    w = WORD.findall((text or "").encode().lower())
    return w, [b" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def _plain(rows, target, buckets, n, percent, least):
    count = lambda texts: [sum(x) for x in zip([0] * buckets, *([[1 if crc32(f) % buckets == b else 0 for b in range(buckets)] for t in texts for f in _features(t, n)[1]]))]
    s, t = count(r[1] for r in rows), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in rows:
        w, f = _features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc32(x) % buckets] for x in f)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def _got(spark, rows, target, **more):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, u int, rank int")     # columns that clash
    df = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), **more)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_plain_version(spark):
    rows = [(i, " ".join("abcdefghij"[(i * k) % 10] + "Xé"[k % 2] for k in range(i % 40))) for i in range(150)]
    rows += [(None, "one Two three " * 9), (None, None), (7, rows[7][1]), (501, ""), (502, " .,\x00\t"), (503, "Word " * 30_000), (504, "É\x85é ÀB-c")]
    rows += [(600, "same words here again " * 6)] * 40                                                          # rows equal in score and id
    for n, percent, least in ((1, 10, 20), (2, 37, 3), (1, 100, 0), (1, 0, 0)):
        assert _got(spark, rows, ["aX Cé hX", None, "same words"], buckets=50, n=n, percent=percent, least_words=least) == _plain(rows, ["aX Cé hX", None, "same words"], 50, n, percent, least)


def test_ties_at_the_cutoff_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(i, 5, i) for i in range(100)] + [(None, 5, 200), (300, 9, 300)], "doc_id long, score long, u long")
    ranked = {r.doc_id: r.rank for r in importance.draw(scored, 31).collect() if r["rank"]}
    assert ranked == {300: 1, **{i: i + 2 for i in range(30)}}
    assert sum(r["rank"] is not None for r in importance.draw(scored, 102).collect()) == 102


def test_empty_tables(spark):
    assert _got(spark, [], ["a b"]) == []
    assert _got(spark, [(1, "a b")], [])[0][1] == 2
