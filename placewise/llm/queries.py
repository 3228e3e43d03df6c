"""The registered queries of this subpackage and their SQL twins."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, importance, mixing, vector_codes
from .common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return wrap


@query("op1_minhash_dedup")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op4_toxicity")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labelled documents of the learning folds; every document is scored by its text alone."""
    from . import toxicity
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op10_language_id")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from documents of the learning folds with a language; every document is judged by its text alone."""
    from . import language_id
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(fold("doc_id", 4) != 2))
    return language_id.predict(docs, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op2_byte_bpe")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with the public 50k byte-level vocabulary, and the ids decoded again."""
    import public_tokenizers

    from . import bpe
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.recode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_embedding_dedup")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"), low=0.9)


@query("op5_vector_search")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import search
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op6_sharding")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards whose row counts are at most one apart."""
    from .sharding import assign
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign(docs, 24, "doc_id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_mixing", mixing.ORACLE)
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), [5, 2, 1], share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op8_chat_format", chat.ORACLE)
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op9_url_filter")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge
    return judge(table(spark, sf_dir, "pages"), RULES)


@query("op11_importance", importance.ORACLE)
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's words."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_vector_codes", vector_codes.oracle())
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op13_lm_score")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the learning folds' texts; every document is scored."""
    from . import pitman_yor
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pitman_yor.fit(docs.where(fold("doc_id", 5) != 1))
    return pitman_yor.score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                                                F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("pipeline")
def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
