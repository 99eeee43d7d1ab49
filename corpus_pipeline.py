"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents, whatever
these are: columns that share a name with one that an operator makes are kept as they are. Rows are
told apart by id and text, so repeated and null ids are allowed, and rows of one id stay or go each
by its own text. Null texts count as empty. Texts of any length go whole. Empty tables give empty
tables; without labels nothing is rejected, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from faultline.llm.bpe import round_trip
from faultline.llm.decontaminate import drop_contaminated
from faultline.llm.exact_dedup import drop_exact_duplicates
from faultline.llm.ngram_join import drop_near_duplicates
from faultline.llm.quality import keep_good
from faultline.sources.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects (score below one half) go. Null and empty texts have the score of the labels' share."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are the same but for white space one stays: the longest, then the smallest id (null first), then any one. Null, empty and white texts are one group."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays (null last), of equal ids the smallest digest of the text. Texts without words, null or not, are nobody's duplicates and stay."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts have no words and stay; items without words match nothing."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: number and digest of its token ids, and digest of the text that they decode to. A null or empty text has no tokens."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: The classifier, the similarity classes and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
