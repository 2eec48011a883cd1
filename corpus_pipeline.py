"""A corpus from raw documents to packed training sequences: five stages, each over all its predecessor kept.

Documents are ``doc_id, text, source`` and whatever other columns they have, under any names but those that a stage's
operator says it replaces. Rows may repeat, ids may be shared or null, texts may be null, empty or very long, and the
table may be empty; each stage says what becomes of such rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import language_id, line_dedup, mixing, near_dedup, packing
from marginalia.llm.common import table
from marginalia.scratch import new_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was recognised; ``lang`` becomes the recognised one.

    Null texts and those without a letter go, and all go where no row has a label to learn from. Equal texts are
    judged alike; a tie of two languages goes to the first by name.
    """
    judged = language_id.identify(docs).where(F.col("lang_pred") != language_id.UNDETERMINED)
    return judged.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand at an earlier place; one that consisted of nothing else goes.

    Earlier is by id, null first, and place. Of equal rows one counts as the first. Null and empty texts stay.
    """
    cut = line_dedup.dedup_passages(docs).where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): one of the smallest id.

    Repeated rows, rows under one id and near-duplicates without an id leave one row too. Null and empty texts stay.
    """
    return near_dedup.without_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most.

    Null sources are one source. Null and empty texts count no words. Rows alike in id, source and size are taken or
    left together.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, copies included, in sequences of 2048 tokens; null and empty texts are the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remember=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Cross-parsing with suffix automata and byte-pair encoding can't be said in SQL; tests/llm/test_pipeline.py holds each
#: stage's rows against a plain version over the stage's own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``; each one's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    top = new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
