"""Tokens against tiktoken, classifiers by held-out accuracy, edge cases of the text operators."""
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from placewise.llm import bpe, common, language_id, toxicity
from placewise.llm.common import fold

VOCABULARY = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
ODD = ["a", "the", " ", "  ", "\n", "é", "ß", "\u3000", "\x1c", "\x85", "\xa0", "1", "½", "中", "😀", "\u0301", "<", "'s", "'ll", "-", "\t", "\r\n", "qu", "\u200b", "Ⅷ", "٣", "\x00"]


def _texts(n):
    rng = random.Random(1)
    for k in range(n):
        yield "".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) if k % 3 else "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x2FFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(20))


def test_transducer_equals_tiktoken():
    own, other = bpe.Encoder(VOCABULARY), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
    rng = random.Random(2)
    for t in [*_texts(2000), "a" * 30_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), " " * 5000]:
        ids = own(t)
        assert ids == other.encode_ordinary(t)
        assert bpe.decoded(ids, own.transduce.bytes_of) == t


def test_stream_keeps_characters_whole():
    text = "aé中😀" * 50
    for step in (1, 2, 3, 5, 7):
        s, data = bpe.Utf8Stream(), text.encode()
        assert "".join(s.feed(data[i:i + step]) for i in range(0, len(data), step)) + s.close() == text
    s = bpe.Utf8Stream()
    assert s.feed(b"a\xe4\xb8") + s.close() == "a\ufffd" and bpe.decoded([10 ** 9], {}) == "\ufffd"


def test_encode_and_decode_tables(spark):
    rows = [(1, "héllo  world", "x"), (2, None, "x"), (3, "", "x"), (1, "héllo  world", "x"), (None, "a b " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert sorted(map(str, bpe.recode(docs, VOCABULARY).select(*out.columns).collect())) == sorted(map(str, out.collect()))
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.doc_id or 0, r.decoded) for r in out.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert bpe.encode(docs.where("doc_id > 9"), VOCABULARY).count() == 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 3) != 1))
    held = toxicity.score(docs.join(labels, "doc_id").where(fold("doc_id", 3) == 1), model).groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in held}
    assert n.get((0, 1), 0) <= 0.03 * n[0, 0] and n[1, 1] >= 0.6 * (n[1, 1] + n.get((1, 0), 0)), n
    assert model.word("id1ots") > 20 * abs(model.word("thing"))
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "123 !!", "a"), (3, "123 !!", "a"), (None, "idiot " * 50_000, None)], "doc_id long, text string, score string")
    out = toxicity.score(odd, model).collect()
    assert len(out) == 5 and len({r.score for r in out[:4]}) == 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_toxicity_without_both_classes():
    assert toxicity.train([], [])("x") < 0.01 and toxicity.train(["a", "b"], [1, 1])("x") > 0.99 and toxicity.train(["a"], [0])(None) < 0.01


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(fold("doc_id", 4) != 2))
    r = language_id.predict(docs.where(fold("doc_id", 4) == 2), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert r > 0.95
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 !?", "a"), (4, "der die und", "a"), (4, "der die und", "a"), (None, "the " * 50_000, None)], "doc_id long, text string, score string")
    out = language_id.predict(odd, model).collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "de", "de", "en"] and all(0 <= r.score <= 1 for r in out)
    nothing = language_id.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language_id.predict(docs.limit(3), nothing).collect()} == {"und"}


def test_rare_languages_stay_in_a_bounded_sample(spark):
    words = {"aa": "molo kiru vano", "bb": "shtep drokk unvar"}
    rows = [(i, words["bb" if i % 400 == 0 else "aa"], "bb" if i % 400 == 0 else "aa") for i in range(4000)]       # ten of 4,000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some = common.bounded_per(docs, "doc_id", 200, F.col("lang"), least=100)
    n = {r.lang: r["count"] for r in some.groupBy("lang").count().collect()}
    assert n["bb"] == 10 and 100 < n["aa"] < 300
    model = language_id.fit(docs, sample=200)
    got = language_id.predict(spark.createDataFrame([(1, "drokk shtep"), (2, "kiru molo")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "bb", 2: "aa"}


def test_training_memory_follows_the_frequent_subwords():
    """Words that occur once make most subwords of a corpus; the driver must not keep them all."""
    import random
    import tracemalloc
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14))
    usual = [word() for _ in range(200)]
    texts = [" ".join([*rng.sample(usual, 30), *(word() for _ in range(60))]) for _ in range(400)]
    labels = [int(usual[0] in t) for t in texts]
    tracemalloc.start()
    model = toxicity.train(texts, labels, epochs=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.scores) > 1000
    assert peak < 70e6


def test_training_without_words():
    model = toxicity.train(["", None, "123"], [0, 1, 0], epochs=2)
    assert 0 < model("") == model("9") < 1
