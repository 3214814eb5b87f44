"""From raw documents to packed sequences: five stages over the whole corpus, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import lines, mixing, ngram_join, packing, quality
from quire.llm.common import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null or empty text has no features and is scored by the share of good labels alone; rows equal in
    text fare alike; columns are docs' own, whatever they are called; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality.keep_good(docs, labels)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that five or more of them share; the largest doc_id keeps them.

    A null text becomes empty; rows that share the largest doc_id all keep the line, a null doc_id is
    below all others; n_chars is counted anew; other columns pass through; an empty table stays empty.
    """
    out = lines.drop_repeated_lines(docs).drop("n_lines", "n_dropped")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard of 0.8 or more: the smallest doc_id.

    Rows without words or without doc_id stay; rows that share the doc_id that stays all stay; columns
    are docs' own; an empty table stays empty.
    """
    return ngram_join.one_per_group(docs, n=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents in the order of the mix, a row for each time that one is taken.

    Null and blank texts are never taken; a null source is a source of its own; a document taken in part
    keeps its first words; rows equal in doc_id, source and text are each taken as their places say; an
    empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's pieces with their places in sequences of 4096 tokens.

    A null text is its end token alone; a null doc_id stays null; repeated rows are packed as often as
    they come; other columns are ignored; an empty table stays empty.
    """
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard", near_duplicate_stage), ("source_mixing", mixing_stage), ("packing", packing_stage)]

#: Neither the classifier nor the tokens can be expressed in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
