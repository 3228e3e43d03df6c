"""A training corpus from documents: without toxic text, in known languages, without near-duplicates, mixed, as tokens."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from placewise.llm import bpe, language_id, minhash_dedup, mixing, toxicity
from placewise.llm.common import fold, saved, table
from placewise.session import broadcast_if_small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_LANG_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold, learned from the labelled documents of the learning folds."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language: rejected are texts without letters and texts no language explains better than
    all others together."""
    model = language_id.fit(docs.where(fold("doc_id", 4) != 2))
    return language_id.predict(docs.select(*COLUMNS), model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANG_SCORE)).select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, written, so that every reader sees the same numbers."""
    return saved(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8): the one of the smallest doc_id, rows without id last.

    Rows that repeat a doc_id are one document and leave one row. A row without id is a document of its own: it goes where
    its text repeats or nearly repeats another and stays otherwise. Texts without words repeat nothing."""
    rows = _numbered(docs)
    # texts are moved by the last join only: ids are settled on a table without them
    keys = saved(rows.select("row", "doc_id", F.xxhash64("text").alias("hash")), "keys")
    first = keys.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("row").alias("document"), F.count("*").alias("n")).where("n > 1")
    repeated = saved(keys.join(first, "doc_id").where("row <> document").select("row", "document"), "repeated")
    document = F.coalesce("document", "row")
    texts = rows.select("row", "text").join(broadcast_if_small(repeated), "row", "left").select(document.alias("doc_id"), "text")
    group = (minhash_dedup.near_duplicates(texts, width=5, percent=80)
             .groupBy(F.col("doc_id").alias("document")).agg(F.min("component_id").alias("component")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "row")
    kept = (keys.join(repeated, "row", "left").withColumn("document", document).join(group, "document")
            .groupBy("component").agg(F.min_by("row", order).alias("row")).select("row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows that repeat a doc_id, or have none, are taken one by one."""
    rows = _numbered(docs)
    copies = mixing.mix(rows, [5, 2, 1], share=1.5, most=2.0, row="row").where("copies > 0").select("row", "copies")
    return rows.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; ids that do not give the text back are refused."""
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.recode(docs.select(*COLUMNS), vocabulary)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.where(same).select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("toxicity", drop_toxic), ("language_id", known_language), ("minhash_dedup", one_of_each), ("mixing", mixed), ("byte_bpe", tokens)]
ORACLE_SQL = None          # no stage but the mix can be said in SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
