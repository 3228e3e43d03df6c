"""The pipeline's stages on a small table, each against what it must do to its own input."""
import corpus_pipeline
from placewise.llm.common import saved


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, d), name)
        sizes.append(docs.count())
        assert docs.columns[:5] == corpus_pipeline.COLUMNS
        assert docs.join(before.withColumnRenamed("text", "old"), "doc_id").where("text <> old").count() == 0
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] and sizes[4] == sizes[5] > 0 and sizes[2] >= 0.8 * sizes[0]
    assert docs.where("n_tokens <> size(ids) OR n_tokens = 0").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "minhash_dedup", "mixing", "byte_bpe"]


def _docs(spark, rows):
    return saved(spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int"), "rows")


def test_one_of_each_without_and_with_repeated_ids(spark):
    text = lambda g, end="": " ".join(f"w{g}x{k}" for k in range(60)) + end
    rows = [(5, text(0), "a"), (3, text(0, " more"), "a"), (None, text(0), "b"),          # near copies: 3 stays
            (7, text(1), "a"), (7, text(1), "a"), (7, text(2), "a"), (8, text(2), "a"),   # one document: one row stays
            (None, text(3), "a"), (None, text(3), "b"), (None, text(4), "a"),             # without id: one of each text stays
            (None, None, "a"), (None, "", "a"), (9, None, "a")]                           # no words: all stay
    got = corpus_pipeline.one_of_each(spark, _docs(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [3, 7, 9]
    assert sorted(r.text or "" for r in got if r.doc_id is None) == sorted(["", "", text(3), text(4)])
    assert [r.text for r in got if r.doc_id == 3] == [text(0, " more")] and [r.text for r in got if r.doc_id == 7][0] in (text(1), text(2))


def test_mixed_without_and_with_repeated_ids(spark):
    rows = [(1, f"one two {k}", "a") for k in range(6)] + [(None, f"three four {k}", "a") for k in range(6)] + [(k, f"five six {k}", "b") for k in range(20, 60)]
    got = [r.text for r in corpus_pipeline.mixed(spark, _docs(spark, rows), "").collect()]
    times = {t: got.count(t) for _, t, _ in rows}
    assert max(times.values()) <= 2 and set(got) == {t for t, n in times.items() if n}
    assert all(times[t] == 2 for _, t, s in rows if s == "a")                # the small source is taken up to its limit
    assert sum(times.values()) in (77, 78, 79)                               # 1.5 times 52 documents of three words


def test_next_stage_drops_what_a_worker_kept():
    """Workers outlive a stage: the encoder's tables must not lie beside the next stage's model."""
    import gc
    import weakref

    import pyarrow as pa
    import public_tokenizers

    from placewise.llm import bpe, common, language_id

    class Payload:
        id, value = 1, (lambda v: (v.ranks, v.pattern))(bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    encoder = bpe._compile(bpe.Encoder, Payload)
    assert bpe._compile(bpe.Encoder, Payload) is encoder and encoder("some unusual wordings") and common._kept
    left = weakref.ref(encoder)
    del encoder
    rows = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["a b a"]})
    assert [b.num_rows for b in language_id._count(iter([rows]))] == [2]
    gc.collect()
    assert left() is None and not common._kept


def test_one_of_each_shuffles_few_texts(spark):
    """Texts go to the confirming tasks and to the last join, and no third time."""
    import random

    r = random.Random(5)
    texts = [" ".join("%012x" % r.getrandbits(48) for _ in range(1500)) for _ in range(200)]
    docs = _docs(spark, [(i, t, "a") for i, t in enumerate(texts + texts[:20])])
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def shuffled():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        assert saved(corpus_pipeline.one_of_each(spark, docs, ""), "kept").count() == 200
        moved = sum(v for k, v in shuffled().items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    size = sum(len(t) for t in texts + texts[:20])
    assert moved < 2.5 * size, (moved, size)
