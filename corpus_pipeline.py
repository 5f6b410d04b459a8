"""A corpus from raw documents to packed sequences, stage by stage; each stage's result is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelake.llm import langid, ngram_join, packing, pii, suffix
from lecturelake.llm.common import crc_mod, discard, read, short_batches, stored
from lecturelake.llm.queries import SURROGATE_KEY, TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told; where lang is null, it becomes the language found. Columns other than
    those of documents go here, as in every stage."""
    short_batches(spark)
    found = langid.identify(docs, langid.learn(docs, crc_mod(F.col("doc_id"), 4) != 2))
    return found.filter(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near-duplicates."""
    short_batches(spark)
    return ngram_join.keep_one(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 400 bytes or more, and those of over 50 words, that occur elsewhere too; a document may be left empty."""
    short_batches(spark)
    return _documents(suffix.remove_repeats(docs, n_words=51).withColumn("text", F.col("kept_text")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates."""
    return _documents(pii.pseudonymize(docs, SURROGATE_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens."""
    short_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", pack)]

#: Compression, hashed classes and keyed surrogates have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once the next one's is written."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return docs
