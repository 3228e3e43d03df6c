"""Language of a text: known words first, then ever shorter character n-grams.

A word seen in learning votes with its log frequency in every language. An unseen word is read as its character n-grams
(with word borders), the longest length at which any n-gram is known; shorter ones only where none of that length is.
A text's votes are added up; the softmax of the sums is the score.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import bounded_per, release, wider

SAMPLE = 8_000        # learning documents, about
LONGEST = 5           # characters of the longest n-gram
SMOOTH = 0.5
CACHE = 100_000       # unseen words a task remembers
UNKNOWN = "und"

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


class Model:
    """``langs`` in order; ``tables[0]``: word -> log frequencies, ``tables[n]``: n-gram -> log frequencies."""

    def __init__(self, langs: list[str], tables: list[dict[str, np.ndarray]]):
        self.langs, self.tables, self.unseen = langs, tables, {}

    @staticmethod
    def learn(counts: list[tuple[str, str, int]]) -> "Model":
        """From (lang, word, count) rows."""
        langs = sorted({c[0] for c in counts})
        if not langs:
            return Model([], [{} for _ in range(LONGEST + 1)])
        at = {x: i for i, x in enumerate(langs)}
        raw: list[dict[str, list[int]]] = [{} for _ in range(LONGEST + 1)]
        for lang, word, k in counts:
            i = at[lang]
            raw[0].setdefault(word, [0] * len(langs))[i] += k
            for n in range(1, LONGEST + 1):
                table = raw[n]
                for g in _grams(word, n):
                    row = table.get(g)
                    if row is None:
                        row = table[g] = [0] * len(langs)
                    row[i] += k
        tables = []
        for table in raw:
            m = np.array(list(table.values()), dtype=np.float64).reshape(-1, len(langs)) + SMOOTH
            tables.append(dict(zip(table, np.log(m) - np.log(m.sum(0)))))
        return Model(langs, tables)

    def vote(self, word: str) -> np.ndarray:
        v = self.tables[0].get(word)
        if v is None:
            v = self.unseen.get(word)
        if v is None:
            v = np.zeros(len(self.langs))
            for n in range(LONGEST, 0, -1):
                known = [x for x in map(self.tables[n].get, _grams(word, n)) if x is not None]
                if known:
                    v = sum(known) / len(known)
                    break
            if len(self.unseen) >= CACHE:
                self.unseen.clear()
            if len(word) <= 64:
                self.unseen[word] = v
        return v

    def __call__(self, text: str | None) -> tuple[str, float]:
        bag = Counter(words(text))
        if not bag or not self.langs:
            return UNKNOWN, 0.0
        order = sorted(bag)                               # a fixed order of addition
        votes = np.zeros(len(self.langs))
        for lo in range(0, len(order), 10_000):
            part = order[lo:lo + 10_000]
            votes += np.array([bag[w] for w in part], dtype=np.float64) @ np.stack([self.vote(w) for w in part])
        p = np.exp(votes - votes.max())
        best = int(votes.argmax())                        # ties: the smaller language name
        return self.langs[best], float(p[best] / p.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        bags: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            bags.setdefault(lang, Counter()).update(words(text.as_py()))
        rows = [(lang, w, k) for lang, bag in bags.items() for w, k in bag.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                         ["lang", "word", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` documents (doc_id, text, lang) with a language, chosen by a hash of doc_id, of a rare
    language more than its share. Words that
    occur once teach nothing reliable and are left out. Without rows, every text is ``und``."""
    some = bounded_per(docs.where("lang IS NOT NULL").select("doc_id", "text", "lang"), "doc_id", sample, F.col("lang"))
    counts = (some.select("lang", "text").mapInArrow(_count, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")).where("n > 1"))
    return Model.learn(sorted((r.lang, r.word, r.n) for r in counts.collect()))        # bounded by the sample


def _predictor(payload):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = Model(*payload.value)
        for b in batches:
            found = [model(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             [*b.schema.names, "__lang", "__score"])
    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, ...) with ``lang_pred`` (a learned language; ``und`` for null texts and texts without letters) and
    ``score`` (0 to 1; 0 for ``und``). Only the text is read; columns named lang_pred or score are replaced, others pass
    through; repeated rows get equal results."""
    docs = docs.drop("lang_pred", "score", "__lang", "__score")
    payload = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables))     # bounded by the learning sample
    schema = wider(docs, __lang="string", __score="double")
    return docs.mapInArrow(_predictor(payload), schema).withColumnsRenamed({"__lang": "lang_pred", "__score": "score"})
