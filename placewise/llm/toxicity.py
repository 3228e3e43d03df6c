"""Toxicity scores from averaged subword embeddings.

A word is the bag of its character n-grams (with word borders) and of itself, each an embedding; a word's vector is the
mean of its bag, a text's vector the mean over its distinct words, and a linear softmax reads the text's vector. The mean is
weighed up a little in long texts, where a telling word is one among many harmless ones. Embeddings and softmax are trained
jointly by full-batch Adam in numpy, on a bounded sample of the labelled rows. Unseen words and misspellings are scored by
the n-grams they share with known words.
"""
from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import bounded, release, wider

SAMPLE = (2_500, 1_000)   # labelled rows of class 0 and of class 1 to learn from, about
DIM = 4
GRAMS = (3, 4, 5)
MIN_DOCS = 12          # subwords in fewer learning texts have no embedding
EPOCHS = 60
RATE = 0.3
DECAY = 1e-4
THRESHOLD = 0.7
EPS = 1e-4            # damps the steps of subwords with small gradients, which are mostly noise
GAIN = 30.0           # fixed scale of the averaged vector: a few telling words among hundreds must move the softmax
BLANKS = 60           # words without meaning added to every text: a few odd words do not decide on a short one
USUAL = 100           # distinct words (blanks included) of a text whose mean is taken as it is
LONG = 0.3            # power of the length by which longer texts' means weigh more
CACHE = 200_000       # words a task remembers
BUCKETS = 1 << 22     # in which subwords are counted

WORD = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}]*")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def subwords(word: str) -> set[str]:
    w = f"<{word}>"
    return {w, *(w[i:i + n] for n in GRAMS for i in range(len(w) - n + 1))}


def share_of_word(n):
    """What one of ``n`` distinct words weighs in its text's vector: the mean, weighed by length."""
    return ((n + BLANKS) / USUAL) ** LONG / (n + BLANKS)


class _Groups:
    """Sums of rows by group and their transpose, for a sparse matrix with one weight per entry."""

    def __init__(self, row: np.ndarray, col: np.ndarray, weight: np.ndarray, rows: int, cols: int):
        self.shape, self.parts = (rows, cols), []
        for a, b in ((row, col), (col, row)):
            in_order = len(a) < 2 or bool((a[1:] >= a[:-1]).all())
            order = slice(None) if in_order else np.argsort(a, kind="stable").astype(np.int32)
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
            self.parts.append((a[first] if len(a) else a, first, b.astype(np.int32, copy=False), weight[order].astype(np.float32, copy=False)))
            del order

    def _sum(self, k: int, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[k], x.shape[1]), np.float32)
        at, first, other, weight = self.parts[k]
        if len(first):
            for i, column in enumerate(np.ascontiguousarray(x.T)):       # a column at a time: small temporaries
                out[at, i] = np.add.reduceat(column.take(other) * weight, first)
        return out

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self._sum(0, x)

    def back(self, x: np.ndarray) -> np.ndarray:
        return self._sum(1, x)


class Model:
    """``scores``: what a subword adds to the difference of the two logits before averaging (its embedding through the
    softmax, folded after training); ``bias``."""

    def __init__(self, scores: dict[str, float], bias: float):
        self.scores, self.bias, self.known = scores, bias, {}

    def word(self, w: str) -> float:
        s = self.known.get(w)
        if s is None:
            found = [x for x in map(self.scores.get, subwords(w)) if x is not None]
            s = sum(found) / len(found) if found else 0.0
            if len(self.known) >= CACHE:
                self.known.clear()
            if len(w) <= 64:
                self.known[w] = s
        return s

    def __call__(self, text: str | None) -> float:
        w = set(words(text))
        mean = math.fsum(map(self.word, w)) * share_of_word(len(w))      # fsum: the order of a set does not matter
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, mean + self.bias))))


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Without rows of both classes the model says the share of label 1 for every text."""
    y = np.asarray(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return Model({}, float(60 * (2 * y.mean() - 1)) if len(y) else -60.0)
    # flat arrays of 32-bit numbers: this runs in the driver, where lists of words would be the largest thing
    number: dict[str, int] = {}
    length, flat = array("i"), array("i")
    for t in texts:
        found = [number.setdefault(x, len(number)) for x in sorted(set(words(t)))]
        length.append(len(found))
        flat.extend(found)
    w = np.asarray(flat)
    d = np.repeat(np.arange(len(texts), dtype=np.int32), length)
    c = share_of_word(np.asarray(length, np.int64))[d].astype(np.float32)
    seen = np.bincount(w, minlength=len(number))                       # texts a word occurs in
    to_text = _Groups(d, w, c, len(texts), len(number))
    del d, c
    # subwords are counted in buckets of hashes first: most of those too rare never become strings of a table
    buckets = array("i", bytes(4 * BUCKETS))
    for x, k in zip(number, seen.tolist()):
        for g in subwords(x):
            buckets[hash(g) % BUCKETS] += k
    grams: dict[str, int] = {}
    per_word, flat = array("i"), array("i")
    for x in number:
        found = [grams.setdefault(g, len(grams)) for g in sorted(subwords(x)) if buckets[hash(g) % BUCKETS] >= MIN_DOCS]
        per_word.append(len(found))
        flat.extend(found)
    owner, col = np.repeat(np.arange(len(number), dtype=np.int32), per_word), np.asarray(flat)
    often = np.bincount(col, weights=seen[owner], minlength=len(grams)) >= MIN_DOCS
    kept, subs = [g for g, k in zip(grams, often.tolist()) if k], int(often.sum())
    keep, vocabulary = often[col], len(number)
    owner, col = owner[keep], (np.cumsum(often, dtype=np.int32) - 1)[col[keep]]
    del flat, number, grams, buckets, keep
    per_word = np.bincount(owner, minlength=vocabulary).astype(np.float32)
    to_word = _Groups(owner, col, 1 / per_word[owner], vocabulary, subs)
    del owner, col
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (subs, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)       # both classes weigh the same
    target = np.stack([1 - y, y], 1)
    for step in range(1, epochs + 1):
        emb, out, bias = params
        text = to_text.apply(to_word.apply(emb))
        z = GAIN * text @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) * share[:, None] / len(y)
        grads = [to_word.back(to_text.back(GAIN * g @ out.T)) + DECAY * emb / subs, GAIN * text.T @ g, g.sum(0)]
        for i, grad in enumerate(grads):
            m[i] += 0.1 * (grad - m[i])
            v[i] += 0.01 * (grad * grad - v[i])
            params[i] = params[i] - RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + EPS)
    emb, out, bias = params
    line = GAIN * (out[:, 1] - out[:, 0])
    score = (emb @ line).tolist()
    return Model(dict(zip(kept, score)), float(bias[1] - bias[0]))


def _payload(model: Model) -> dict:
    return {"scores": model.scores, "bias": model.bias}


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """Train on a bounded sample of the documents (doc_id, text) that ``labels`` (doc_id, toxic) marks: about ``sample``
    labelled rows of either class, chosen by a hash of doc_id. Rows whose label is neither 0 nor 1 are left out."""
    rows = []
    for label, n in enumerate(sample):
        some = bounded(labels.where(F.col("toxic") == label).select("doc_id", "toxic"), "doc_id", n)
        rows += docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").collect()        # ``some`` is bounded by n
    rows.sort(key=lambda r: (r.doc_id, r.text or "", r.toxic))
    return train([r.text for r in rows], [r.toxic for r in rows])


def _scorer(payload):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = Model(**payload.value)
        for b in batches:
            score = [model(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*b.schema.names, "__score"])
    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (text, ...) with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 if score >= threshold).

    Null and empty texts and texts without letters get the score of a text without known words. Only the text is read;
    repeated rows get equal scores; other columns pass through, but columns named score or predicted are replaced."""
    docs = docs.drop("score", "predicted", "__score")
    payload = docs.sparkSession.sparkContext.broadcast(_payload(model))       # bounded by the learning sample
    out = docs.mapInArrow(_scorer(payload), wider(docs, __score="double")).withColumnRenamed("__score", "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
